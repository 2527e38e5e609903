"""Main text of web pages: parser events to lines, text-to-tag ratios, Gaussian smoothing, threshold clusters.

The standard library's parser streams events; tags of blocks end a line. What
can't be content goes first: elements that hold none (menus, footers, forms, scripts
and the like), and elements whose role, class or id says so. A class or id counts
as a whole, never on a heading, nor on an element that holds an article or, where none
is marked elsewhere, most of the text outside links (but for reader comments).

Of the lines left, the ratio of characters outside links to tags is smoothed along
the page, and a threshold between the two clusters of ratios tells strong lines:
those whose smoothed and own ratio both reach it. They choose the region: from the page
down, the element is entered that holds the title and all but a small share of
the strong text that follows the title (what stands before a title, as adverts do,
doesn't count). Marked articles are entered if they hold most of the strong text,
and only those of them that hold some. Within the region, neighbouring lines of
mostly links go if the smoothed ratio of one is below the threshold, as in lists of
links and adverts; a link between paragraphs stays, as its neighbours lift it.
No heading and no line of plain text in the region goes for being short.

Nulls: a null page is empty and has the empty text, as has a page without text.
Empty table: no rows. Repeated rows: each is extracted. Ties: of elements that fit alike the
inner one is the region. Very long pages: time grows with the length. Other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

#: Elements by what they do to a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
OUTSIDE = frozenset("head title nav footer aside form script style noscript template button select textarea iframe object svg canvas dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Names of what is outside, of what is so in a page but not in an article, and of reader comments.
OUTER = (
    r"ads?|advert[^\W_]*|adbox|adsense|sponsor[^\W_]*|promo[^\W_]*|banner|cookie[^\W_]*|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|sidebar|side|widgets?|menu|nav|navbar|navigation|"
    r"breadcrumbs?|footer|foot|share|sharing|social|related|recommend[^\W_]*|toolbar|skip|pagination|pager"
)
OF_PAGE, OF_READERS = "header|masthead", "comments?|commentlist|respond|disqus"
#: Words that may stand beside such a name in a class or id and change nothing: cookie-notice, ad-slot, share-buttons, but not no-sidebar or related-work.
BESIDE = r"area|bar|block|box|button|buttons|container|inner|item|items|left|links?|list|outer|page|posts?|right|section|site|slot|thread|top|bottom|unit|wrap|wrapper|\d+"


def _name(words: str) -> re.Pattern:
    """A class or id that is one of the words, or made of them and of words that change nothing."""
    beside = rf"(?:(?:{words}|{BESIDE})[-_]+)*"
    return re.compile(rf"{beside}(?:{words})(?:[-_]+(?:{words}|{BESIDE}))*", re.IGNORECASE)


IN_PAGE, IN_ARTICLE, COMMENTS = _name(f"{OUTER}|{OF_PAGE}|{OF_READERS}"), _name(f"{OUTER}|{OF_READERS}"), _name(OF_READERS)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What may stand in a head: anything else ends a head that wasn't closed.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
UNNAMED = HEADINGS | {"html", "body", "article", "main"}
CLOSES_P = BLOCK - {"option", "legend", "summary", "caption"}
SIGMA = 1.0
#: Share of the strong text that may stand outside the region, and share that marked articles must hold.
STRAY, MARKED = 0.05, 0.5


class Line:
    """text, tags, characters in links, number of the article and of the innermost element, level of the heading (0: none)."""

    __slots__ = ("text", "tags", "linked", "article", "element", "heading")

    def __init__(self, text: str, tags: int, linked: int, article: int, element: int, heading: int):
        self.text, self.tags, self.linked, self.article, self.element, self.heading = text, tags, linked, article, element, heading

    def own(self) -> int:
        return max(0, len(self.text) - self.linked)


class Lines(HTMLParser):
    """The lines that aren't known to be outside the content, and the tree of elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, int]] = []
        self.names: Counter[str] = Counter()  # of the open elements
        # of each element, numbered as they open (0 is the page): the one around it
        self.around = [0]
        self.out = self.articles = self.links = 0
        self.article: list[int] = []
        # elements named as outside: number, the one around it, whether it holds reader comments, an article, stands in one, how much text
        self.named: list[int] = []
        self.outer: dict[int, int] = {}
        self.readers: set[int] = set()
        self.holders: set[int] = set()
        self.within: set[int] = set()
        self.sizes: dict[int, int] = {}
        self.made: list[tuple[list[tuple[str, bool, int]], int, int, int, int]] = []
        self.parts: list[tuple[str, bool, int]] = []
        self.tags = 0

    def end_line(self) -> None:
        if self.parts:
            heading = next((int(x[0][1]) for x in reversed(self.open[-4:]) if x[0] in HEADINGS), 0)
            self.made.append((self.parts, self.tags, self.article[-1] if self.article else 0, self.open[-1][3] if self.open else 0, heading))
        self.parts, self.tags = [], 0

    def lines(self) -> list[Line]:
        """The lines that are left once it is known which named elements are outside."""
        held = dict(self.sizes)
        for number in sorted(self.outer, reverse=True):
            held[self.outer[number]] = held.get(self.outer[number], 0) + held.get(number, 0)
        outside, marked = {0: False}, any(article for _, _, article, *_ in self.made)
        for number in sorted(self.outer):
            most = 2 * held.get(number, 0) > held.get(0, 0) and number not in self.readers and (number in self.within or not marked)
            outside[number] = outside[self.outer[number]] or not (most or number in self.holders)
        out = []
        for parts, tags, article, element, heading in self.made:
            parts = [x for x in parts if not outside[x[2]]]
            text = " ".join("".join(x[0] for x in parts).split())
            if text:
                out.append(Line(text, tags, sum(len(data) for data, link, _ in parts if link), article, element, heading))
        return out

    def handle_starttag(self, tag, attrs):
        if tag == "body" or (tag not in IN_HEAD and self.open and self.open[-1][0] == "head"):
            self.close("head")
        if tag in CLOSES_P and self.names["p"] and any(x[0] == "p" for x in self.open[-4:]):
            self.close("p")
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and self.open and self.open[-1][0] == tag:
            self.close(tag)
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if tag == "br":
            self.parts.append((" ", True, self.named[-1] if self.named else 0))
        if tag in VOID:
            return
        given = dict(attrs)
        words = f"{given.get('class') or ''} {given.get('id') or ''}".split()
        out = tag in OUTSIDE or (tag == "header" and not self.article) or (given.get("role") or "").lower() in ROLES or "hidden" in given
        out = out or (given.get("aria-hidden") == "true" or "display:none" in (given.get("style") or "").replace(" ", "").lower())
        link = tag == "a" and "href" in given
        number = len(self.around)
        self.around.append(self.open[-1][3] if self.open else 0)
        self.open.append((tag, out, link, number))
        self.names[tag] += 1
        names = IN_ARTICLE if self.article else IN_PAGE
        if tag not in UNNAMED and any(names.fullmatch(x) for x in words):
            self.outer[number] = self.named[-1] if self.named else 0
            self.named.append(number)
            if any(COMMENTS.fullmatch(x) for x in words):
                self.readers.add(number)
            if self.article:
                self.within.add(number)
        self.out += out
        self.links += link
        if tag in ("article", "main"):
            self.articles += 1
            self.holders.update(self.named)
            self.article.append(self.articles)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.close(tag)

    def close(self, tag: str) -> None:
        if not self.names[tag]:
            return
        if tag in BLOCK:
            self.end_line()
        name = ""
        while name != tag:
            name, out, link, number = self.open.pop()
            self.names[name] -= 1
            if self.named and self.named[-1] == number:
                self.named.pop()
            if name in BLOCK:
                self.end_line()
            self.out -= out
            self.links -= link
            if name in ("article", "main") and self.article:
                self.article.pop()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in VOID:
            self.close(tag)

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and not data.isspace():
            self.close("head")
        if not self.out:
            named = self.named[-1] if self.named else 0
            self.parts.append((data, self.links > 0, named))
            if not self.links:
                self.sizes[named] = self.sizes.get(named, 0) + len(data.strip())


def smoothed(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma) + 1
    w = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    return np.convolve(np.pad(x, reach, mode="edge"), w / w.sum(), mode="valid")


def threshold(x: np.ndarray) -> float:
    """Between the means of the two clusters of x that are nearest in squares."""
    low, high = float(x.min()), float(x.max())
    for _ in range(50):
        middle = (low + high) / 2
        if not (x > middle).any() or (x > middle).all():
            return low
        new = float(x[x <= middle].mean()), float(x[x > middle].mean())
        if new == (low, high):
            break
        low, high = new
    # lines of text differ among themselves too: only what lies far below the upper cluster is not text
    return min((low + high) / 2, high / 4)


def region(lines: list[Line], strong: np.ndarray, around: list[int]) -> np.ndarray:
    """Which lines stand in the innermost element that holds the title and nearly all the strong text after it."""
    levels = [x.heading for x in lines if x.heading]
    title = next((i for i, x in enumerate(lines) if x.heading == min(levels)), 0) if levels else None
    weight = np.where(strong, [x.own() for x in lines], 0)
    if title is not None:
        weight[:title] = 0
    if not weight.any():  # nothing strong after the title: all text counts
        weight = np.array([x.own() for x in lines])
    whole, stray = weight.sum(), STRAY * weight.sum()
    # an element's weight and number of lines; it follows the elements around it, so sums go from the last to the first
    held, count = np.zeros(len(around)), np.zeros(len(around), np.int64)
    for x, w in zip(lines, weight.tolist(), strict=True):
        held[x.element] += w
        count[x.element] += 1
    for e in range(len(around) - 1, 0, -1):
        held[around[e]] += held[e]
        count[around[e]] += count[e]
    path = set()  # the elements that the title stands in
    if title is not None:
        e = lines[title].element
        while e:
            path.add(e)
            e = around[e]
    # an element that is but one line is no region, unless it holds all lines there are
    fits = [e for e in range(1, len(around)) if whole - held[e] <= stray and (title is None or e in path) and (count[e] > 1 or count[e] == len(lines))]
    chosen = fits[-1] if fits else 0
    inside = np.zeros(len(around), bool)
    inside[chosen] = True
    for e in range(1, len(around)):
        inside[e] |= inside[around[e]]
    return inside[[x.element for x in lines]]


def main_text(page: str) -> str:
    parser = Lines()
    parser.feed(page)
    HTMLParser.goahead(parser, True)
    parser.end_line()
    lines = parser.lines()
    if not lines:
        return ""
    ratio = np.array([x.own() / max(1, x.tags) for x in lines], float)
    even = smoothed(ratio)
    cut = threshold(even)
    strong = (even >= cut) & (ratio >= cut)
    weight = np.where(strong, [x.own() for x in lines], 0)
    marked = np.array([x.article for x in lines])
    if weight[marked > 0].sum() >= MARKED * max(1, weight.sum()):
        inside = np.isin(marked, np.unique(marked[strong & (marked > 0)]))
    else:
        inside = region(lines, strong, parser.around)
    links = np.array([2 * x.linked > len(x.text) and not x.heading for x in lines])
    run = np.cumsum(np.concatenate([[True], links[1:] != links[:-1]]))
    links &= np.isin(run, np.unique(run[links & (even < cut)]))
    return "\n".join(x.text for x, kept in zip(lines, inside & ~links, strict=True) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    given = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return given.mapInArrow(read, "page_id long, url string, text string, n_chars long")
