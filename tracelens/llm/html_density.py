"""Main-text extraction from HTML by composite text density.

Each node of the page's tree has C characters and T tags below it, of which LC characters and LT tags are in links. Its
composite density is C/T * ln(C/LC * T/LT) / ln(ln(C/(C-LC) * LC + body's LC / body's C * C + e) + e - 1), counts of 0
standing as 1: characters for each tag, pressed down where links hold them (e - 1 keeps the divisor at 1 or more on pages
without links). A node's density sum adds its block children's densities (inline ones would make a paragraph the main subtree).
The subtree with the greatest sum is the main one, and is kept whole; but where no article or main element marks it, its block
children that are mostly links and less dense than the whole path go. The path from it up to the body gives two thresholds, the
greatest and the least density on it. Of what hangs from the path, block children and the runs of text and inline children
between them, that is kept whose own density reaches the greatest, block children too that reach the least and hold blocks
whose densities add up to the greatest, and headings (blocks with no other text) right before something kept. So link lists,
menus, notices and footers beside the main subtree go, inside an article too; those within it stay.

Scripts, styles, navigation, headers and footers of the page, sidebars, forms, notices, adverts and reader comments are cut
from the tree first, by element, role and class or id; they would otherwise lend the body their density. A class or id counts
as a whole: all its words must be words of boilerplate, or of its layout beside one at least (has-sidebar, overflow-hidden and
print-area are none). What holds an article or main element that stays, or more than half of the page's text outside links, is
never cut, scripts and the like apart. Where an article or main element is there, path nodes outside it are not considered.

Null or empty html, and pages without a body text, give the empty text. Broken markup is read as browsers mend it: an open
paragraph ends where another block begins, an unfinished tag at the end is dropped. White space inside a block becomes one
space, blocks are joined by one space; nothing is capped, and very long pages are read one at a time. Of subtrees with equal sums
the first is the main one. Equal rows give equal texts, a row each; rows without page_id are kept; an empty table gives an empty
one. page_id: any integer type. Extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

#: Fixed values of HTML: elements without content, elements whose content is no markup, block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
ENDS_P = BLOCK - frozenset("br option select head html body title legend td th tr tbody thead tfoot".split())
#: What an opening tag closes first, if it is open inside the nearest of the given limits.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements, roles and words of class and id that mark what isn't article text.
NOISE_TAGS = frozenset("script style noscript template svg canvas iframe object embed head nav footer aside form button select textarea input dialog menu".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert newsletter subscribe subscription signup login popup modal overlay"
    " nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget related recommended share sharing social footer header masthead topbar toolbar comment comments disqus respond reply replies pagination pager skip print hidden".split()
)

#: Words that may stand beside those in one class or id name.
NOISE_PARTS = frozenset("bar block bottom box button buttons container footer global icon icons inner item items left link links list main outer posts primary right secondary section site slot top unit wrap wrapper".split())
#: Noise whatever it holds: no text of the page is in them.
NEVER_TEXT = frozenset("script style noscript template svg canvas iframe object embed head select textarea input button".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(/?)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'/=>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("chars", "density", "headings", "kids", "link_chars", "link_tags", "noise", "parent", "tag", "tags", "total")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.kids, self.noise = tag, parent, [], False
        self.chars = self.tags = self.link_chars = self.link_tags = self.headings = 0
        self.density = self.total = 0.0


def _names_noise(name: str) -> bool:
    """Whether a whole class or id names boilerplate; names with a colon hold under conditions only."""
    if ":" in name:
        return False
    words = [w.lower() for w in _WORD.findall(name)]
    return any(w in NOISE_WORDS for w in words) and all(w in NOISE_WORDS or w in NOISE_PARTS for w in words)


def _is_noise(tag: str, attributes: str, inside: bool) -> bool:
    if tag in NOISE_TAGS or (tag == "header" and not inside):
        return True
    if not attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
        if name == "role" and value.lower() in NOISE_ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body") and any(map(_names_noise, value.split())):
            return True
    return False


def parse(page: str) -> Node:
    """The page's tree; texts are str entries among a node's kids."""
    root = Node("#root", None)
    here, at, articles = root, 0, 0
    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            here.kids.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            node = here
            while node is not root and node.tag != tag and not (tag not in BLOCK and node.tag in BLOCK):
                node = node.parent
            if node is not root and node.tag == tag:
                while here is not node:
                    here = here.parent
                here = node.parent
                articles -= tag in ("article", "main")
            elif tag == "p":
                here.kids.append(Node("p", here))
            continue
        if tag in ENDS_P:
            node = here
            while node is not root and node.tag != "p" and (node.tag not in BLOCK):
                node = node.parent
            if node.tag == "p":
                here = node.parent
        if tag in CLOSES:
            closed, limits = CLOSES[tag]
            node = here
            while node is not root and node.tag not in limits:
                if node.tag in closed:
                    here = node.parent
                node = node.parent
        new = Node(tag, here)
        new.noise = _is_noise(tag, m[3], articles > 0)
        here.kids.append(new)
        if tag in VOID or m[4] or (m[3] or "").endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
            if tag == "textarea" or tag == "title":
                new.kids.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            continue
        articles += tag in ("article", "main")
        here = new
    rest = page[at:]
    if rest:
        cut = re.search(r"<[a-zA-Z/!?][^>]*\Z", rest)
        here.kids.append(rest[: cut.start()] if cut else rest)
    return root


def _spare(root: Node) -> None:
    """Takes the mark of noise from what holds an article or main that stays, or most of the page's text outside links."""
    nodes, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        nodes.append((node, linked))
        if node.tag not in NEVER_TEXT:
            stack += [(k, linked or k.tag == "a") for k in node.kids if not isinstance(k, str)]
    sizes: dict[Node, int] = {}
    for node, linked in reversed(nodes):
        own = 0 if linked or node.tag in NEVER_TEXT else _own_chars(node.kids)
        sizes[node] = own + sum(sizes.get(k, 0) for k in node.kids if not isinstance(k, str))
    holders: set[Node] = set()
    for node, _ in reversed(nodes):
        kids = [k for k in node.kids if not isinstance(k, str) and not k.noise]
        holds = any(k in holders or (k.tag in ("article", "main") and sizes.get(k, 0)) for k in kids)
        if node.noise and node.tag not in NEVER_TEXT and (holds or 2 * sizes[node] > sizes[root]):
            node.noise = False
        if holds:
            holders.add(node)


def _order(root: Node) -> list[Node]:
    """Nodes that aren't noise, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [k for k in reversed(node.kids) if not isinstance(k, str) and not k.noise]
    return out


def _density(c: int, t: int, lc: int, lt: int, share: float) -> float:
    base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
    return c / max(1, t) * math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))) / math.log(base + math.e - 1)


def _own_chars(kids: list) -> int:
    return sum(len(" ".join(html.unescape(k).split())) for k in kids if isinstance(k, str))


def measure(root: Node) -> tuple[list[Node], float]:
    """The nodes that aren't noise, measured, and the share of the body's text in links."""
    nodes = _order(root)
    for node in nodes:
        node.chars = _own_chars(node.kids)
    for node in reversed(nodes):
        for k in node.kids:
            if not isinstance(k, str) and not k.noise:
                node.chars += k.chars
                node.tags += 1 + k.tags
                node.headings += k.headings
                node.link_chars += k.link_chars
                node.link_tags += k.link_tags + (k.tag == "a")
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
        if node.tag in HEADINGS:
            node.headings = node.chars
    body = next((n for n in nodes if n.tag == "body"), root)
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in nodes:
        node.total = sum(k.density for k in node.kids if not isinstance(k, str) and not k.noise and k.tag in BLOCK)
    return nodes, share


def _run_density(run: list, share: float) -> float:
    """Of texts and inline children side by side, as if an element held them; of one child alone, its own."""
    kids = [k for k in run if not isinstance(k, str) and not k.noise]
    own = _own_chars(run)
    if len(kids) == 1 and not own:
        return kids[0].density
    return _density(own + sum(k.chars for k in kids), sum(1 + k.tags for k in kids), sum(k.link_chars for k in kids), sum(k.link_tags + (k.tag == "a") for k in kids), share)


def _dense(node: Node, low: float, high: float) -> bool:
    """Whether a subtree beside the path is as dense as the path's densest node, or no less dense than its least and holds blocks
    whose densities add up to that."""
    return node.density >= high or (node.density >= low and max(n.total for n in _order(node)) >= high)


def _prune(node: Node, on: Node, low: float, high: float, share: float) -> None:
    """Takes from a node of the path what is not dense enough; `on` is the path's next node below it."""
    kept: list = []
    headings: list = []
    run: list = []

    def settle(entries: list, keep: bool, heading: bool = False) -> None:
        if keep:
            kept.extend(headings + entries)
        elif not heading:
            kept.append(" ")
        headings[:] = entries if heading and not keep else []

    for k in [*node.kids, None]:
        if k is not None and (isinstance(k, str) or (k is not on and (k.noise or k.tag not in BLOCK))):
            run.append(k)
            continue
        if any(k.strip() if isinstance(k, str) else k.chars and not k.noise for k in run):
            settle(run, _run_density(run, share) >= high)
        run = []
        if k is not None and (k is on or k.chars):
            settle([k], k is on or _dense(k, low, high), k.headings == k.chars)
    node.kids = kept


def _text(node: Node) -> str:
    out: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.noise:
            out.append(" ")
        elif x.tag in BLOCK:
            out.append(" ")
            stack.append(" ")
            stack += reversed(x.kids)
        else:
            stack += reversed(x.kids)
    # references are decoded piece by piece where tags cut them, as in the page
    return " ".join("".join(html.unescape(s) for s in out).split())


def main_text(page: str) -> str:
    root = parse(page)
    _spare(root)
    nodes, share = measure(root)
    top = next((n for n in nodes if n.tag == "body"), root)
    holders = [n for n in nodes if n.tag in ("article", "main") and n.chars]
    if holders:
        top = max(holders, key=lambda n: n.chars)
    inner = _order(top)
    best = max(inner, key=lambda n: n.total)
    path = [best]
    while path[-1] is not top:
        path.append(path[-1].parent)
    low, high = min(n.density for n in path), max(n.density for n in path)
    if not holders:
        best.kids = [" " if not isinstance(k, str) and k.tag in BLOCK and 2 * k.link_chars > k.chars and k.density < low else k for k in best.kids]
    for node, on in zip(path[1:], path, strict=False):
        _prune(node, on, low, high, share)
    return _text(top)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, from pages(page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 1 << 20):
                texts = [main_text(p) for p in texts_of(part.column("html"))]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
