"""Extraction against a second, plain implementation, and what the ratios decide where elements and names tell nothing."""

import html as entities
import re
import time

import numpy as np
import pytest

from cairn.llm import html

from .conftest import SF

BLOCKS = r"</?(?:p|h[1-6]|div|li|ul|ol|table|tr|td|th|blockquote|section|pre)\b[^>]*>"


def of_article(page: str) -> str:
    """The article's text by patterns, for pages like those of the table: one article, adverts as <div class="ad">."""
    found = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)
    inner = re.sub(r'<!--.*?-->|<div class="ad">.*?</div>', "", found.group(1), flags=re.S)
    parts = (re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", x)) for x in re.split(BLOCKS, inner))
    return "\n".join(x for x in (" ".join(entities.unescape(p).split()) for p in parts) if x)


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").collect()]


def unmarked(page: str) -> str:
    """The page without article elements, classes and ids."""
    return re.sub(r' (?:class|id)=(?:"[^"]*"|[^\s>]+)', "", re.sub(r"<(/?)(?:article|main)\b", r"<\1div", page))


def test_every_page_as_the_plain_implementation(pages):
    assert [html.main_text(p) for p in pages] == [of_article(p) for p in pages]


def test_pages_that_tell_nothing_by_element_or_name(pages):
    differ = [p for p in pages if html.main_text(unmarked(p)) != of_article(p)]
    assert len(differ) <= len(pages) // 500


ADVERTS = '<div><a href="1">Cheap offers here</a></div><div><a href="2">More offers to see</a></div><div><a href="3">Offers</a> now</div><div><a href="4">Buy the last</a></div>'


def page_of(k: int, marked: bool, adverts: bool) -> tuple[str, list[str]]:
    rng = np.random.default_rng(k)
    texts = ["Title of it", *(" ".join(["word"] * int(rng.integers(30, 90))) for _ in range(8)), "Short end."]
    lines = [f"<h2>{texts[0]}</h2>", *(f"<p>{t}</p>" for t in texts[1:])]
    if adverts:
        lines.insert(5, ADVERTS)
    box = "article" if marked else "div"
    side = "".join(f"<div><a href={i}>link number {i}</a></div>" for i in range(12))
    plain = "".join(f"<div><span>entry {i}</span></div>" for i in range(60))
    return f"<body><div>Some notice.</div><div>{side}</div><{box}>{''.join(lines)}</{box}><div>{side}</div><div>{plain}</div><div>Terms and imprint</div></body>", texts


@pytest.mark.parametrize("marked", [True, False])
@pytest.mark.parametrize("adverts", [True, False])
def test_ratios_decide(monkeypatch, marked, adverts):
    for k in range(20):
        page, texts = page_of(k, marked, adverts)
        assert html.main_text(page) == "\n".join(texts)
    # without the method (each line as good as any other) menus of links and adverts are taken in
    monkeypatch.setattr(html, "smoothed", lambda x: np.ones(len(x)))
    monkeypatch.setattr(html, "threshold", lambda x: 0.0)
    page, texts = page_of(1, marked, adverts)
    same = html.main_text(page) == "\n".join(texts)
    assert same == (marked and not adverts)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><h1>T</h1><div><p>First paragraph of it.</p><p>Second one of it.</p></div></body>", "T\nFirst paragraph of it.\nSecond one of it."),
        (f"<div><h1>T</h1><section><h2>A</h2><p>{'a ' * 300}</p></section><section><h2>B</h2><p>b b b</p></section></div>", f"T\nA\n{('a ' * 300).strip()}\nB\nb b b"),
        (f"<article><p>{'long ' * 60}</p><p><a href=x>See the report</a></p><p>{'long ' * 60}</p></article>", f"{('long ' * 60).strip()}\nSee the report\n{('long ' * 60).strip()}"),
        ("<p>Only.</p>", "Only."),
        ("<div><div><div></div></div></div>", ""),
        ("<a href=1>Only a link</a>", "Only a link"),
    ],
)
def test_regions(page, want):
    assert html.main_text(page) == want


def test_stray_end_tags_cost_nothing():
    began = time.time()
    assert html.main_text("<div>" * 30_000 + "text" + "</span></section>" * 30_000 + "</div>" * 30_000) == "text"
    assert time.time() - began < 10
