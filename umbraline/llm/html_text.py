"""Main text of web pages: text-to-tag ratios of lines, smoothed and clustered.

The standard library's streaming parser turns a page into lines: runs of text between
block-level tags, each with the number of tags met in it and the path of open elements.
Each line has a text-to-tag ratio (text inside links doesn't count); a Gaussian smooths the
ratios along the page, and two clusters of their logarithms (a threshold between the
centres) part content from the rest.

What elements are called only weighs on the ratio: an element whose class, id or state
says that it is no part of an article divides the smoothed ratios of its lines by
``1 / DOUBT``, once for each such element around them, so a page on which all content lies in
such elements keeps it.  Elements that HTML itself sets apart (nav, footer, ...) weigh zero.

The content region is the lowest element that holds two thirds of the content lines'
characters, or the article around it.  In the region stay the lines whose own and smoothed
ratios belong to the content cluster; lines of a kind (same parent, same tag) with one of
these; lines between them that aren't made of links (in an article: from its first line to
its last); and headings right before them.  Lines that weigh less than the region's content
never stay but by their own ratio.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import narrowed, slices

# Element names of the HTML standard.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title iframe object svg canvas audio video math textarea".split())
APART = frozenset("nav footer aside menu button select dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Blocks that hold a run of text rather than other blocks: never a content region.
TEXT_BLOCKS = HEADINGS | frozenset("p li td th dd dt pre blockquote figcaption summary address".split())
#: Words in a class, id or role that mark what is no part of an article.
DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|gdpr|hidden|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|popup|promo\w*|related|replies|reply|respond|search|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)
#: What a doubtful element leaves of its lines' ratios.
DOUBT = 0.001
#: Share of the content's characters that the region holds.
REGION = 2 / 3
#: Lines at most of an element of its own with the title.
TITLE_LINES = 4
#: Open elements that a new one of the same kind (or any block, for p) closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass(slots=True)
class Node:
    tag: str
    parent: Node | None
    depth: int
    weight: float
    silent: bool
    link: bool
    soft: bool = False  # inline in an article and doubted for a class word only


@dataclass(slots=True)
class Line:
    node: Node
    parts: list[tuple[float, bool, str]]  # weight, whether in a link, text
    tags: int
    plain: bool = True  # whether any of it stands outside soft elements
    weight: float = 0.0  # the most of any part
    size: int = 0  # characters of the parts of that weight
    linked: int = 0  # those of them in links

    def __post_init__(self):
        if not self.plain:
            self.parts = [(w * DOUBT, link, t) for w, link, t in self.parts]
        self.weight = max(w for w, _, t in self.parts if t.strip())
        for w, link, t in self.parts:
            if w == self.weight:
                n = len(" ".join(t.split()))
                self.size += n
                self.linked += n * link

    def text(self, least: float) -> str:
        """What is left without the inline elements that weigh less."""
        return " ".join("".join(t for w, _, t in self.parts if w >= least).split())


@dataclass
class Page(HTMLParser):
    """Parser events gathered into lines."""

    lines: list[Line] = field(default_factory=list)

    def __post_init__(self):
        HTMLParser.__init__(self, convert_charrefs=True)
        self.node = Node("", None, 0, 1.0, False, False)
        self.parts: list[tuple[float, bool, str]] = []
        self.tags, self.plain = 0, False

    def flush(self) -> None:
        if self.parts:
            if any(t and not t.isspace() for _, _, t in self.parts):
                self.lines.append(Line(self._block(), self.parts, self.tags, self.plain))
            self.parts = []
        self.tags, self.plain = 0, False

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for line numbers

    def _block(self) -> Node:
        node = self.node
        while node.parent is not None and node.tag not in BLOCKS:
            node = node.parent
        return node

    def _close(self, tags: set[str]) -> None:
        """Close the nearest open element of these, if no other block stands between."""
        node = self.node
        while node.parent is not None:
            if node.tag in tags:
                self.node = node.parent
                return
            if node.tag in BLOCKS:
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.flush()
            self._close({"p"})
            if tag in CLOSES:
                self._close(CLOSES[tag])
        if tag == "br":
            self._add("\n")
        self.tags += 1
        if tag in VOID:
            return
        if tag == "body" or tag in BLOCKS and self.node.tag == "head":
            self._close_head()
        node, soft = self.node, self.node.soft
        if tag in APART or tag == "header" and not self._within("article", "main"):
            weight = 0.0
        else:
            doubt = 2 if tag == "form" else _doubtful(tag, attrs) if attrs else 0
            # A word in a class says little of a part of an article's sentence.
            if doubt == 1 and tag not in BLOCKS and self._within("article"):
                doubt, soft = 0, True
            weight = node.weight * DOUBT if doubt else node.weight
        self.node = Node(tag, node, node.depth + 1, weight, node.silent or tag in SILENT, node.link or tag == "a", soft)

    def _close_head(self) -> None:
        """Close an open head, and what is open in it."""
        node = self.node
        while node.parent is not None:
            if node.tag == "head":
                self.node = node.parent
                return
            node = node.parent

    def _within(self, *tags: str) -> bool:
        node = self.node
        while node is not None:
            if node.tag in tags:
                return True
            node = node.parent
        return False

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        node = self.node
        while node.parent is not None and node.tag != tag:
            if node.tag in ("article", "main", "body") and tag not in ("body", "html"):
                return  # a stray end tag doesn't end a region
            node = node.parent
        if node.parent is not None:
            self.node = node.parent

    def _add(self, data: str) -> None:
        node = self.node
        self.parts.append((node.weight, node.link, data))
        self.plain = self.plain or not node.soft and not data.isspace()

    def handle_data(self, data: str) -> None:
        if not self.node.silent:
            self._add(data)

    def end(self) -> list[Line]:
        self.close()
        self.flush()
        return self.lines


def _doubtful(tag: str, attrs: list) -> int:
    """2 if its attributes say that an element is hidden, 1 if a name says that it is no part of an article, else 0."""
    named = 0
    for k, v in attrs:
        if k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", "").lower():
            return 2
        if v and k in ("class", "id", "role", "aria-label") and tag not in ("html", "body", "article", "main") and DOUBTFUL.search(v):
            named = 1
    return named


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; weights that fall off the page's ends are left out."""
    reach = max(1, int(np.ceil(3 * sigma)))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, weights)[reach : reach + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def threshold(values: np.ndarray) -> float:
    """Between the centres of two clusters of the values (one-dimensional 2-means)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        mid = (low + high) / 2
        below, above = values[values <= mid], values[values > mid]
        new = (float(below.mean()) if len(below) else low, float(above.mean()) if len(above) else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def content_lines(lines: list[Line], sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each line, whether its smoothed ratio belongs to the content cluster, and its own too."""
    own = np.array([(x.size - x.linked) / max(1, x.tags) for x in lines])
    weight = np.array([x.weight for x in lines])
    smooth = np.log1p(smoothed(np.where(weight > 0, own, 0.0), sigma) * weight)
    top = threshold(smooth)
    content = (smooth >= top) & (smooth > 0)
    return content, content & (np.log1p(own * weight) >= top)


def main_lines(lines: list[Line], sigma: float = 1.0, clusters: bool = True) -> list[str]:
    """The blocks of the content region, in page order.

    Without ``clusters`` every line with a weight is content; that is for comparison only.
    """
    if clusters:
        content, strong = content_lines(lines, sigma) if lines else (np.zeros(0, bool),) * 2
    else:
        content = strong = np.array([x.weight > 0 for x in lines], bool)
    if not content.any():
        return []
    # The lowest element with most of the content: an article rather than its longest paragraph.
    held: dict[int, int] = {}
    nodes: dict[int, Node] = {}
    weights: dict[float, int] = {}
    for x, keep in zip(lines, content, strict=True):
        if keep:
            weights[x.weight] = weights.get(x.weight, 0) + x.size
            node = x.node
            while node is not None:
                held[id(node)] = held.get(id(node), 0) + x.size
                nodes[id(node)] = node
                node = node.parent
    total, least = sum(weights.values()), max(weights, key=lambda w: (weights[w], w))
    region = max((n for k, n in nodes.items() if held[k] >= REGION * total and (n.tag not in TEXT_BLOCKS or n.parent is None)), key=lambda n: n.depth)
    above = region
    while above is not None and above.tag != "article":
        above = above.parent
    region = above or region
    inside = [_inside(x.node, region) for x in lines]
    kind = [(id(x.node.parent if x.node.tag in TEXT_BLOCKS else x.node), x.node.tag) for x in lines]
    sure = [i for i, x in enumerate(lines) if inside[i] and strong[i] and x.weight >= least] or [i for i in range(len(lines)) if inside[i] and content[i]]
    kinds = {kind[i] for i in sure}
    alike = [i for i, x in enumerate(lines) if inside[i] and x.weight >= least and kind[i] in kinds]
    whole = [i for i in range(len(lines)) if inside[i] and region.tag == "article"]
    first, last = min(alike + sure + whole), max(alike + sure + whole)
    while first and lines[first - 1].node.tag in HEADINGS and lines[first - 1].weight >= least and (inside[first - 1] or lines[first - 1].node.parent is region.parent):
        first -= 1
        inside[first] = True
    # A few lines with a heading right before a region that is no article: title and byline in an element of their own.
    own = _beside(lines[first - 1].node, region) if first and region.tag != "article" else None
    head = []
    while own is not None and len(head) < first and _beside(lines[first - 1 - len(head)].node, region) is own:
        head.append(first - 1 - len(head))
    if 0 < len(head) <= TITLE_LINES and any(lines[i].node.tag in HEADINGS for i in head) and all(lines[i].weight >= least and 2 * lines[i].linked <= lines[i].size for i in head):
        first = head[-1]
        for i in head:
            inside[i] = True
    out = []
    for i, x in enumerate(lines):
        between = first <= i <= last and (region.tag == "article" or 2 * x.linked <= x.size)
        if inside[i] and (strong[i] or x.weight >= least and (between or kind[i] in kinds)) and (text := x.text(min(least, x.weight))):
            out.append(text)
    return out


def _beside(node: Node | None, region: Node) -> Node | None:
    """The sibling of the region that holds a node; None if none does."""
    while node is not None and node.parent is not region.parent:
        node = node.parent
    return None if node is region else node


def _inside(node: Node | None, region: Node) -> bool:
    while node is not None:
        if node is region:
            return True
        node = node.parent
    return False


def main_text(html: str | None, sigma: float = 1.0) -> str:
    if not html:
        return ""
    page = Page()
    page.feed(html)
    return "\n\n".join(main_lines(page.end(), sigma))


def extract(pages: DataFrame, sigma: float = 1.0, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep``, ``text`` and ``n_chars`` (code points) for every page.

    Null, empty and text-free pages give an empty text; broken markup is read as far as
    the parser goes; repeated rows stay; columns not named are not read.  A page whose only
    text stands in elements that HTML sets apart (nav, footer, ...) has none.
    """
    rows = narrowed(pages, *keep, html_column)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(keep)):
                texts = [main_text(h, sigma) for h in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return rows.mapInArrow(run, f"{kinds}, text string, n_chars long")
