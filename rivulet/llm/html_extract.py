"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's HTML parser reports tags and text; every block becomes a line.  A line's ratio is its own
characters per tag: link text of a line that is mostly links counts for nothing, neither does the text of a part that
names itself as a menu, advert, comment and the like, and a ratio counts up to CAP.  The ratios are smoothed with a
Gaussian along the page, where every container's edge is a step of its own, so a dense article does not lift the
advert beside it.  Lines above a threshold of the page's own spread form the content cluster.

The region is the innermost container that holds nearly all content characters and leaves boilerplate outside; parts
of it that hold no content line go if they name themselves or if the region is only a wrapper, everything else in it stays.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import small_batches

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big center cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
HIDDEN = frozenset("head script style template noscript iframe object svg math canvas audio video map select textarea button datalist title".split())
APART = frozenset("nav footer aside form menu dialog fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("html body article main section div center table td form".split())
BOUND = SECTIONS | frozenset("ul ol dl blockquote nav footer header aside".split())
CLOSES = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "th", "p"), "th": ("th", "p"), "option": ("option",)}
CLOSE_P = BOUND | HEADINGS | frozenset(("p", "pre", "hr", "figure", "address", "details", "summary", "tr"))
# Words in class, id or role that name what is not the article ...
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead topbar footer colophon sidebar aside complementary contentinfo search cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe subscription signup login form comment comments commentlist respond replies discussion disqus share sharing social related recommended "
    "recommendations widget widgets pagination pager skip".split()
)
# ... and words that may stand beside them in one name: sidebar-left, comments-area, related-posts.
LAYOUT = frozenset(
    "site page main left right top bottom inner outer list area box block blocks wrap wrapper container section panel bar link links item items col column row "
    "primary secondary global fixed sticky mobile desktop first last slot unit zone holder group thread policy message buttons icons media posts stories articles text title".split()
)
OWN = frozenset("post entry article story content".split())  # what names the article itself
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")
UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
CAP = 100.0


def weight_of(attrs, article: bool) -> float:
    """0 for an element whose class, id or role names something else than content, 0.5 if one part of a name does, else 1.

    A name counts whole: sidebar-left is a sidebar, share-price and platform-form say nothing of the kind.
    """
    faint = own = False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return 0.0
        if not value or name not in ("class", "id", "role"):
            continue
        for token in CAMEL.sub(r"\1-\2", value).lower().split():
            parts = set(WORD.findall(token))
            if article:
                parts.discard("header")
            own |= not parts.isdisjoint(OWN)
            if not parts.isdisjoint(NAMED):
                if parts <= NAMED | LAYOUT:
                    return 0.0
                faint = True
    return 0.5 if faint and not own and not article else 1.0


class Lines(HTMLParser):
    """Lines (text, tags, link characters, node, heading, place) and the tree of containers, in linear time.

    Per container: its parent, the weight of its text, whether it is part of an article element, its tag.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool, int]] = []
        self.parent, self.weight, self.article, self.kind = [0], [1.0], [False], [""]
        self.open: list[tuple[str, int, bool]] = []  # name, node around it, whether text around it is hidden
        self.scopes = [Counter()]  # open elements by name, per open container
        self.held: Counter = Counter()  # open containers by name
        self.node, self.hidden = 0, False
        self.text: list[str] = []
        self.tags = self.link = self.links = self.place = 0
        self.heading = 0

    def read(self, html: str) -> None:
        last = html.rfind(">") + 1
        rest = UNFINISHED.search(html, last)  # a tag that never ends is no text
        self.feed(html[: rest.start()] if rest else html)
        self.close()
        self.flush()

    # what the parser refuses or searches again and again for: declarations and comments without an end
    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def parse_comment(self, i, report=1):
        end = self.rawdata.find("-->", i + 4) if self.unended is None or i < self.unended else -1
        if end >= 0:
            return end + 3
        self.unended = i if self.unended is None else min(self.unended, i)
        return self.parse_bogus_comment(i)

    unended: int | None = None

    def goahead(self, end):
        self.unended = None
        super().goahead(end)

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip() if self.text else ""
        if text:
            self.lines.append((text, self.tags, self.link, self.node, self.heading > 0, self.place))
            self.place += 1
            self.tags = self.link = 0
        self.text.clear()

    def enter(self, tag: str, weight: float, article: bool) -> None:
        self.parent.append(self.node)
        self.weight.append(min(weight, self.weight[self.node]))
        self.article.append(article)
        self.kind.append(tag)
        self.node = len(self.parent) - 1
        self.place += 1

    def pop(self) -> str:
        tag, node, hidden = self.open.pop()
        if tag in BOUND:
            self.scopes.pop()
            self.held[tag] -= 1
        self.scopes[-1][tag] -= 1
        self.links -= tag == "a"
        self.heading -= tag in HEADINGS
        if node != self.node:
            self.flush()
            self.node = node
            self.place += 1
        self.hidden = hidden
        return tag

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            elif tag == "hr":
                self.flush()
            return
        inline = tag in INLINE
        if not inline:
            self.flush()
            closes = CLOSES.get(tag, ("p",) if tag in CLOSE_P else ())
            while any(self.scopes[-1][c] for c in closes):
                self.pop()
        inside = self.article[self.node]
        weight = 1.0
        if tag not in ("html", "body"):
            named = tag in APART or tag == "header" and not inside
            weight = 0.0 if named else weight_of(attrs, inside) if attrs else 1.0
            if weight == 0.5 and (inline or tag not in SECTIONS):
                weight = 1.0
        body = tag in ("article", "main") or any(n == "role" and v in ("main", "article") or n == "itemprop" and v == "articleBody" for n, v in attrs)
        self.open.append((tag, self.node, self.hidden))
        self.scopes[-1][tag] += 1
        if tag in BOUND:
            self.scopes.append(Counter())
            self.held[tag] += 1
        if tag in BOUND or weight == 0.0 or body:
            self.flush()
            self.enter(tag, weight, inside or body and weight > 0 and self.weight[self.node] > 0)
        self.hidden = self.hidden or tag in HIDDEN
        self.links += tag == "a"
        self.heading += tag in HEADINGS

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE:
            self.flush()
        # a container's end closes what is open in it; another element's end must be open in the container
        if self.held[tag] if tag in BOUND else self.scopes[-1][tag]:
            while self.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)
            if self.links:
                self.link += len(data)


def smoothed(values: np.ndarray, places: np.ndarray, sigma: float) -> np.ndarray:
    """values at integer places convolved with a Gaussian, weights renormalised over the places that hold a value."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    axis, there = np.zeros(places[-1] - places[0] + 1), np.zeros(places[-1] - places[0] + 1)
    at = places - places[0]
    axis[at], there[at] = values, 1
    return np.convolve(axis, kernel)[reach:][at] / np.convolve(there, kernel)[reach:][at]


def own_characters(lines, weight, article) -> np.ndarray:
    """Characters of each line that speak for it: none of a named part, none of a line of links outside an article."""
    return np.array([weight[x[3]] * (len(x[0]) if article[x[3]] else 0 if x[2] > 0.6 * len(x[0]) else max(1, len(x[0]) - x[2])) for x in lines])


def content_lines(lines, own: np.ndarray, sigma: float, share: float) -> np.ndarray:
    """Which lines' smoothed ratios reach share of the standard deviation of the page's (or the best line's, if that is lower)."""
    ratio = np.minimum(own / np.array([max(1, x[1]) for x in lines]), CAP)
    curve = smoothed(ratio, np.array([x[5] for x in lines]), sigma)
    speaks = own > 0
    if not speaks.any():
        return speaks
    return speaks & (curve >= min(share * curve.std(), curve[speaks].max()))


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.5, dominant: float = 0.8, use_ratio: bool = True, use_names: bool = True) -> str:
    """The content blocks of a page joined by newlines; empty for null, empty or text-free pages.

    share: of the standard deviation of the page's smoothed ratios, what a content line must reach; dominant: of the
    content characters, what a container must hold to be the region. use_ratio and use_names switch a source of
    evidence off, to measure what it contributes.
    """
    if not html:
        return ""
    page = Lines()
    page.read(html)
    lines = page.lines
    if not lines:
        return ""
    if not use_ratio:
        return "\n".join(x[0] for x in lines)
    weight, article = (page.weight, page.article) if use_names else ([1.0] * len(page.parent), [False] * len(page.parent))
    own = own_characters(lines, weight, article)
    content = content_lines(lines, own, sigma, share)
    if not content.any():
        if not any(weight[x[3]] > 0 for x in lines):
            return ""
        content = np.array([weight[x[3]] > 0 for x in lines])  # nothing but lines of links
    parent, n = page.parent, len(page.parent)
    held, noise, all_in = [0.0] * n, [0] * n, [0] * n
    for x, ok in zip(lines, content.tolist(), strict=True):
        if ok:
            held[x[3]] += len(x[0]) * (3 if article[x[3]] else 1)
        all_in[x[3]] += 1
    for k in range(n - 1, 0, -1):  # children come after their parents
        held[parent[k]] += held[k]
    for x, o in zip(lines, own.tolist(), strict=True):
        noise[x[3]] += o == 0 or held[x[3]] == 0
    best: list[int] = [0] * n
    for k in range(n - 1, 0, -1):
        noise[parent[k]] += noise[k]
        if held[k] > held[best[parent[k]]] or best[parent[k]] == 0:
            best[parent[k]] = k
    # down to the innermost container that holds nearly all, while something that is no content is left outside
    root = 0
    while best[root] and page.kind[best[root]] in SECTIONS and held[best[root]] >= dominant * held[root]:
        child = best[root]
        if noise[root] == noise[child] and (article[root] or not article[child]):
            if page.kind[root] not in ("", "html", "body"):
                break
        root = child
    above, k = set(), root
    while k:
        k = parent[k]
        above.add(k)
    wrapper = page.kind[root] in ("", "html", "body") or not any(ok and x[3] == root for x, ok in zip(lines, content.tolist(), strict=True))
    # state of each container: outside the region, inside it, or inside a part that goes
    inside, keep = [False] * n, [False] * n
    for k in range(n):
        if k == root:
            inside[k], keep[k] = True, weight[k] > 0
        elif k and inside[parent[k]]:
            inside[k] = True
            gone = weight[k] == 0 or held[k] == 0 and parent[k] == root and wrapper and not article[k]
            keep[k] = keep[parent[k]] and not gone
    first = next(i for i, x in enumerate(lines) if inside[x[3]])
    titled = any(x[4] and keep[x[3]] for x in lines)
    flat = page.kind[root] in ("", "html", "body")
    spread = np.flatnonzero(content & np.array([inside[x[3]] for x in lines]))
    out = []
    for i, (x, ok) in enumerate(zip(lines, content.tolist(), strict=True)):
        if inside[x[3]]:
            if keep[x[3]] and (ok or not flat or x[3] != root or x[4] or len(spread) and spread[0] < i < spread[-1]):
                out.append(x[0])
        elif i < first and x[4] and x[3] in above and weight[x[3]] > 0 and (page.kind[x[3]] not in ("", "html", "body") or not titled):
            out.append(x[0])  # a heading right above the region is its title
    return "\n".join(out)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row, from its whole html.

    Null or empty html: empty text, 0; repeated rows each give a row; an empty table gives none; other columns are
    ignored. Pages that are not well formed are read as far as the parser can tell: a declaration or comment without
    an end reaches to the next >, a tag without an end at the end of the page is dropped. Time is linear in the page.
    """

    def run(batches):
        for b in small_batches(batches, 8 << 20):
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_query(pages: DataFrame) -> DataFrame:
    return extract(pages)
