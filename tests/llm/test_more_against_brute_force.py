"""The other operators against plain Python, exact round trips, or held-out accuracy."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from .test_against_brute_force import components, rows_of


@pytest.fixture(params=["odd", "documents", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_suffix_dedup(docs):
    from cairn.llm import substrings

    texts = {}
    for r in docs.collect():
        texts[r.doc_id] = (r.text or "").encode()
    seen, want = set(), {}
    for i in sorted(texts):
        t, gone = texts[i], np.zeros(len(texts[i]), bool)
        for k in range(len(t) - 99):
            s = t[k : k + 100]
            if s in seen:
                gone[k : k + 100] = True
            seen.add(s)
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        want[i] = (len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest())
    rows = rows_of(substrings.dedup_substrings(docs))
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]


def test_vectors(spark):
    from cairn.llm import vectors

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    rows = [[float(x) for x in centres[i % 12] * (1 + i % 3) + rng.normal(size=24) * 0.12 * (i % 5)] for i in range(240)]
    rows += [rows[3], [2 * x for x in rows[3]], None, [0.0] * 24, [float("nan")] + rows[4][1:], [None] + rows[4][1:], [float("inf")] + rows[4][1:], [1.0, 2.0], [-0.0, 2.0], [0.0, 2.0], []]
    table = spark.createDataFrame([(i, r, "x") for i, r in enumerate(rows)], "vec_id long, embedding array<float>, label string")
    f32 = [None if r is None or any(x is None for x in r) else np.array(r, np.float32).astype(float) for r in rows]
    ok = [v is not None and len(v) > 0 and np.isfinite(v).all() and v.any() for v in f32]
    links = []
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if ok[a] and ok[b] and len(f32[a]) == len(f32[b]) and f32[a] @ f32[b] / np.linalg.norm(f32[a]) / np.linalg.norm(f32[b]) >= 0.9:
                links.append((a, b))
    degree, label = Counter(x for pair in links for x in pair), components(range(len(rows)), links)
    for block in (8192, 40):
        got = rows_of(vectors.near_vectors(table, block=block))
        assert len(got) == len(rows)
        for r in got:
            i = r["vec_id"]
            assert (r["n_links"], r["component_id"], r["kept"]) == (degree[i], label[i], label[i] == i), i
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_languages(docs):
    import zlib

    from cairn.llm import langid

    lang = {r.doc_id: r.lang for r in docs.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = rows_of(langid.identify(docs))
    assert len(rows) == docs.count()
    right = []
    for r in rows:
        i = r["doc_id"]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, texts[i] or "")))
        if r["held_out"] and len((texts[i] or "").split()) > 10:
            right.append(r["lang_pred"] == lang[i])
    assert not right or sum(right) >= 0.95 * len(right)


@pytest.mark.parametrize("n", [1, 2, 4, 6, 9, 20])
def test_codewords_differ(n):
    from cairn.llm import langid

    codes = langid.codewords(n)
    distance = [(codes[i] != codes[j]).sum() for i in range(n) for j in range(i)]
    assert not distance or min(distance) >= (1 if n <= 2 else 2)


PAGE = """<!DOCTYPE html><html><head><title>Head</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<aside class="sidebar"><p>Side words that are long enough to look like text, were they not in a sidebar.</p></aside>
<article><h1>Title &amp; more</h1><p>First   paragraph<br>with <b>bold</b> and <a href="x">a link</a>.<p>Second &eacute; one.<ul><li>Item one<li>Item two</ul>
<div class="ad">Buy now.</div><pre>code   here</pre></article>
<section id="comments"><p>A reader says something here that is as long as a paragraph of the article is.</p></section><form><label>Name</label><input></form><footer>&copy; 2020</footer></body></html>"""


def test_html(spark):
    from cairn.llm import html

    want = "Title & more\nFirst paragraph with bold and a link.\nSecond é one.\nItem one\nItem two\ncode here"
    bare = "<div class=nav><a href=1>a</a></div><p>Some text that is long enough to count as content here.</p><p>Another text that is long enough to count as content.</p><div id=footer>x</div>"
    pages = [(1, "u", PAGE, 1), (2, None, None, 2), (3, "u", "", 3), (4, "u", bare, 4), (5, "u", "<article><p>unclosed", 5), (1, "u", PAGE, 1), (6, "u", "no markup at all", 6), (7, "u", "<div " * 2000, 7)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, text int")
    got = rows_of(html.extract(table))
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert text[1] == want and text[2] == text[3] == "" and text[5] == "unclosed" and text[6] == "no markup at all"
    assert text[4] == "Some text that is long enough to count as content here.\nAnother text that is long enough to count as content."
    assert html.extract(table.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [(20, 18, 900, 1200, 1000, 120, 90, 80, 60), (30, 120, 150, 4000, 160, 140, 120, 100), (10, 9000, 10, 5), (5, 5, 5, 5, 9000)])
@pytest.mark.parametrize("line", ["<p>{}</p>", "<div><p>{}</p></div>", "<h2>{}</h2>"])
def test_html_without_article_keeps_every_line(sizes, line):
    """Beside very long paragraphs, short ones and headings at both ends are text too; lists of links outside of the text aren't."""
    from cairn.llm import html

    texts = ["x" * (n - 1) + str(k) for k, n in enumerate(sizes)]
    body = "".join(line.format(t) for t in texts)
    assert html.main_text(f"<html><body>{body}</body></html>") == "\n".join(texts)
    links = "<ul><li><a href=1>Home</a></li><li><a href=2>About</a></li></ul>"
    assert html.main_text(f"<body>{links}<div><h1><a href=3>Title</a></h1>{body}</div>{links}</body>") == "\n".join(["Title", *texts])


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div class="content no-sidebar"><article><p>Body.</p></article></div>', "Body."),
        ('<div class="has-sidebar"><article><p>Body.</p></article></div>', "Body."),
        ('<div class="sidebar" id="menu"><main><p>Body.</p></main></div>', "Body."),
        ('<article><header class="entry-header"><h1>Title</h1></header><p>Body.</p></article>', "Title\nBody."),
        ('<article><header class="header"><h1>Title</h1></header><p>Body.</p></article>', "Title\nBody."),
        ('<article><div class="post-header"><h1>Title</h1></div><p>Body.</p></article>', "Title\nBody."),
        ('<article><h2 id="related-work">A</h2><p>a</p><h2 id="side-effects">B</h2><p>b</p><h2 id="menu">C</h2><p>c</p></article>', "A\na\nB\nb\nC\nc"),
        (f'<div class="widget"><p>{"word " * 50}</p></div><p>Rest.</p>', ("word " * 50).strip() + "\nRest."),
        ('<div class="nav"><a href="1">Long names of many other pages</a></div><p>Text.</p>', "Text."),
        ('<article><p>Body.</p><div class="share-buttons">Share</div><div class="ad-slot">Buy</div><div class="related-posts">More</div></article>', "Body."),
        (f'<article><p>Body with <span class="ad">buy</span> text.</p><div id="comments">{"said " * 50}</div></article>', "Body with text."),
    ],
)
def test_html_names_count_as_a_whole(page, want):
    from cairn.llm import html

    assert html.main_text(page) == want


def test_html_names_are_read_in_time():
    import time

    from cairn.llm import html

    began = time.time()
    assert html.main_text(f'<div class="{"advert_" * 400}!"><p>Text.</p></div>') == "Text."
    assert time.time() - began < 5


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>T</title><body><article><p>Body.</p></article></body></html>", "Body."),
        ("<html><head><title>T</title><meta charset=utf-8><body class=x><p>Body.</p>", "Body."),
        ("<head><title>T</title><p>Body.</p>", "Body."),
        ("<head><title>T</title>Body.", "Body."),
        ("<head><title>T</title><style>p{}</style><script>x</script><noscript><p>Enable</p></noscript></head><body><p>Body.</p></body>", "Body."),
    ],
)
def test_html_head_that_is_not_closed(page, want):
    from cairn.llm import html

    assert html.main_text(page) == want


def test_counts_after_edits(docs):
    from cairn.llm import counts, tokens

    table = tokens.chunk_ids(tokens.default_path())
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = rows_of(counts.after_line_dedup(docs))
    assert len(rows) == docs.count()
    for r in rows:
        text = texts[r["doc_id"]]
        cut = text
        for a, b in counts.repeated_lines(text):
            cut = cut[:a] + cut[b:]
        assert r["n_tokens"] == len(tokens.encode(text, table)) // 4
        assert r["n_tokens_after"] == len(tokens.encode(cut, table)) // 4


def test_any_edits_keep_counts():
    from cairn.llm import counts, tokens

    table, rng = tokens.chunk_ids(tokens.default_path()), random.Random(2)
    for _ in range(150):
        text = "".join(rng.choice("ab \n.é,") for _ in range(rng.randint(0, 3000))).encode()
        tree = counts.CountTree(text, table)
        for _ in range(6):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 1, 3, 50, 900]))
            new = "".join(rng.choice("xy \n") for _ in range(rng.choice([0, 0, 1, 40]))).encode()
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text and tree.total == len(tokens.encode(text, table)) // 4
