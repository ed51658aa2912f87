"""Main text of HTML pages by tree scoring.

Each block of text is a paragraph with points for its length and commas. Points pass to the
parent in full, to the grandparent by half and on with less, LEVELS up, and a container's score is
discounted by its link density. The best container tells where the article is. Elements that by tag, role or
name are menus, headers, footers, sidebars, notices, adverts, forms or comments neither score nor appear.

An `article` or `main` around the best container is kept whole, with siblings that score well next to it. Without
one, siblings of the best container and of those around it are kept unless they are mostly links; right below the
body they must hold prose (a paragraph, heading, item or the like) or score well. A class or id names furniture if its parts, at
hyphens, underscores and capitals, are all words of furniture or neutral ones beside them.

Time grows in proportion to the page, whatever its nesting.

Defined cases: null or empty html, and pages without text, give ''; unclosed or stray tags
are repaired as browsers do in the common cases; repeated rows and pages of one id give a result each; ties go to
the earlier container; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icspark.llm.common import small_batches

# Element names of the HTML standard, and words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
FURNITURE = frozenset("aside button canvas datalist dialog footer form head header iframe input label menu nav object select svg".split()) | RAW
FURNITURE_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
FURNITURE_WORD = frozenset("ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs combx comment comments consent cookie cookies disqus disclaimer footer gdpr header masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted related remark replies reply rss share sharing shoutbox sidebar skyscraper social sponsor sponsored subscribe toolbar widget".split())
NEUTRAL_WORD = frozenset("area bar block bottom box button buttons container content fixed global group holder inner item items left link links list main outer overlay page panel posts primary right row secondary section site slot sticky the top unit widget wrap wrapper".split())
PROSE = frozenset("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: Elements at which the search for one to close looks; the first that it doesn't close ends it.
STOPS = frozenset("dd dl dt head li menu ol option select table td th tr ul".split())
#: Levels that points pass up; a sibling's least share of the best score, or least points; most linked share of siblings.
LEVELS, SIBLING_SHARE, SIBLING_POINTS, PROSE_LINKED, MOST_LINKED = 6, 0.2, 10, 0.25, 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")


class Node:
    """block and stop: the nearest element of that kind, itself included."""

    __slots__ = ("tag", "parent", "items", "drop", "score", "chars", "linked", "prose", "block", "stop")

    def __init__(self, tag: str, parent: "Node | None", drop: bool):
        self.tag, self.parent, self.drop = tag, parent, drop
        self.items: list = []
        self.score, self.chars, self.linked, self.prose = 0.0, 0, 0, False
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.stop = self if tag in STOPS else parent.stop if parent is not None else None


def _names_furniture(name: str) -> bool:
    """Whether one class or id names furniture as a whole."""
    parts = [x.lower() for x in _NAME.findall(name)]
    return any(x in FURNITURE_WORD for x in parts) and all(x in FURNITURE_WORD or x in NEUTRAL_WORD or x.isdigit() for x in parts)


def _furniture(tag: str, attrs: str) -> bool:
    if tag in FURNITURE:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "role" and value.lower() in FURNITURE_ROLE or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name in ("class", "id") and any(map(_names_furniture, value.split())):
            return True
    return False


def parse(html: str) -> Node:
    """A tree of nodes; text stands as strings among their items."""
    root = here = Node("#root", None, False)
    open_: dict[str, int] = {}  # open elements by tag
    at, n, last = 0, len(html), html.rfind(">")

    def back_to(node: Node) -> Node:
        """Close what is open inside node."""
        now = here
        while now is not node:
            open_[now.tag] -= 1
            now = now.parent
        return node

    while at < n:
        m = _TOKEN.search(html, at) if at <= last else None
        end = m.start() if m else n
        if end > at:
            here.items.append(html[at:end])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_.get(tag):
                node = here
                while node.tag != tag:
                    node = node.parent
                here = back_to(node.parent)
            continue
        if tag in BLOCK and here.block.tag == "p":  # a block ends an open paragraph, through inline elements
            here = back_to(here.block.parent)
        if tag in CLOSES:
            while here.stop is not None and here.stop.tag in CLOSES[tag]:
                here = back_to(here.stop.parent)
        node = Node(tag, here, here.drop or _furniture(tag, m[3]))
        here.items.append(node)
        if tag in RAW and tag not in VOID:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else n
        elif tag not in VOID and not m[3].endswith("/"):
            here = node
            open_[tag] = open_.get(tag, 0) + 1
    return root


def _blocks(root: Node) -> list[tuple[Node, str]]:
    """(block element, text) in page order; inline text joins its block, a line break is white space."""
    out: list[tuple[Node, str]] = []
    parts: list[str] = []
    owner = root

    def end():
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((owner, text))

    stack: list[tuple[Node, int]] = [(root, 0)]
    while stack:
        node, k = stack.pop()
        if k == 0 and node.tag in BLOCK:
            end()
            owner = node
        while k < len(node.items):
            item = node.items[k]
            k += 1
            if isinstance(item, str):
                parts.append(item)
            elif item.drop:
                if item.tag in BLOCK:
                    end()
            elif item.tag == "br":
                parts.append(" ")
            else:
                stack.append((node, k))
                stack.append((item, 0))
                break
        else:
            if node.tag in BLOCK:
                end()
                owner = node.parent.block
    end()
    return out


def _measure(root: Node) -> list[Node]:
    """Characters, linked characters and prose of every kept node; nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in reversed(node.items) if not isinstance(x, str) and not x.drop]
    for node in reversed(order):
        node.chars += sum(len(x.strip()) for x in node.items if isinstance(x, str))
        if node.tag == "a":
            node.linked = node.chars
        node.prose |= node.tag in PROSE and node.chars > 0
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.prose |= node.prose
    return order


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    blocks = _blocks(root)
    if not blocks:
        return ""
    order = _measure(root)
    for block, text in blocks:
        points = 1 + text.count(",") + min(len(text) / 100, 3.0)
        up = block.parent if block.tag in PROSE and block.parent else block
        for level in range(LEVELS):
            up.score += points * (1 if not level else 0.5 if level == 1 else 1 / (3 * level))
            up = up.parent
            if up is None:
                break
    best = max((x for x in order if x.score > 0), key=_final, default=root)
    whole, own = _article(best)
    kept = set()  # nodes inside the article
    for node in order:
        if id(node) in whole or node.parent is not None and id(node.parent) in kept:
            kept.add(id(node))
    return "\n\n".join(text for block, text in blocks if id(block) in kept or id(block) in own)


def _final(x: Node) -> float:
    return x.score * (1 - x.linked / max(x.chars, 1))


def _article(best: Node) -> tuple[set[int], set[int]]:
    """(ids of the nodes that are kept whole, ids of those of which only text of their own is)."""
    home = best
    while home is not None and home.tag not in ("article", "main"):
        home = home.parent
    top, least = home or best, max(SIBLING_POINTS, SIBLING_SHARE * _final(best))
    whole, own = {id(top)}, set()

    def siblings(node: Node):
        return [x for x in node.parent.items if not isinstance(x, str) and not x.drop and x is not node and x.chars]

    scores = lambda x: x.score > 0 and _final(x) >= least
    linked = lambda x: x.linked / x.chars
    if home is not None:
        return (whole | {id(x) for x in siblings(top) if scores(x)} if top.parent else whole), own
    while top.parent is not None and top.parent.tag not in ("body", "html", "#root"):
        whole |= {id(x) for x in siblings(top) if linked(x) < MOST_LINKED}
        own.add(id(top.parent))
        top = top.parent
    if top.parent is not None:
        whole |= {id(x) for x in siblings(top) if scores(x) or x.prose and linked(x) < PROSE_LINKED}
    return whole, own


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page; row by row, no shuffle."""
    small_batches(pages.sparkSession)
    thin = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return thin.mapInArrow(go, "page_id long, url string, text string, n_chars long")
