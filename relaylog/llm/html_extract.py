"""Main text of web pages by scoring the element tree.

The page becomes a tree. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are cut off by their elements, roles and class names. By its name alone no element goes that holds an
article, main element or first heading, or most of the paragraph text; there the points decide. Each paragraph then earns points for its length
and its commas and passes them on to its ancestors, less the further up; the share of text in links is taken off
a container's points. The best container is kept, with those of its siblings that read like the same article.

A block ends where a block element begins or ends. White space in a block becomes single spaces; blocks are
joined by line feeds in page order.

Defined results: null and empty pages give an empty text. A page without any paragraph gives the text that is
left after cutting off. Unclosed and stray tags are taken as browsers take them in the common cases. Repeated
rows get equal results, extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from relaylog.llm.common import map_slices

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>""",
    re.S,
)
# What is no text after the last ">" of a page.
OPEN_END = re.compile(r"<[!?].*", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary"}
# An opening tag closes an open element of its group, up to the nearest of the enclosing elements.
GROUPS = {
    "p": (("p",), ("td", "th", "button", "table")), "li": (("li",), ("ul", "ol", "menu", "dir")), "dl": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "option": (("option",), ("select", "datalist")),
    "head": (("head",), ("html",)),
}
CLOSES = {"li": "li", "dt": "dl", "dd": "dl", "tr": "tr", "td": "td", "th": "td", "option": "option", "body": "head"}
GROUPED = frozenset(t for members, within in GROUPS.values() for t in (*members, *within))
CUT_TAGS = frozenset("nav footer aside form button select input textarea dialog menu fieldset audio video head".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
CUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu "
    "topbar toolbar breadcrumb breadcrumbs sidebar aside rail widget widgets footer foot copyright comment comments commentlist "
    "disqus reply replies respond discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "pagination pager skip masthead header paywall teaser teasers hidden".split()
)
# Inside an article these may as well name a part of it, so prose decides.
WEAK_NAMES = frozenset("discussion header masthead teaser teasers overlay banner rail aside foot respond reply replies hidden".split())
# What follows one of these in a name tells of a state or a part, not of the element: has-sidebar, overflow-hidden.
MODIFIERS = frozenset("has no not with without overflow".split())
KEEP_TAGS = frozenset("html body article main".split())
GOOD_NAMES = frozenset("article body content entry main page post story text blog prose".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd div section article h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
LEAST_PARAGRAPH = 25


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None
    children: list = field(default_factory=list)  # nodes and texts
    points: float = 0.0
    scored: bool = False
    # By name in GROUPS, the element that a new one of the group would close here.
    open: dict = field(default_factory=dict)


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return out


def opened(node: Node, around: dict) -> dict:
    """What a new element of each group would close inside ``node``; ``around`` says it for its parent."""
    out = dict(around)
    for group, (members, within) in GROUPS.items():
        if node.tag in within:
            out.pop(group, None)
        elif node.tag in members:
            out.setdefault(group, node)
    return out


def parse(page: str) -> Node:
    """The element tree, without comments and without the content of scripts and the like.

    Linear in the page: an end tag walks up only where such an element is open, what an opening tag closes is known
    at every element, and no tag is looked for after the last ``>``.
    """
    root = Node("html", {}, None)
    at, counts = root, Counter()
    place, size, last = 0, len(page), page.rfind(">")

    def leave(node: Node) -> Node:
        """Close all elements up to ``node``."""
        here = at
        while here is not node:
            counts[here.tag] -= 1
            here = here.parent
        counts[node.tag] -= 1
        return node.parent

    while place < size:
        found = TOKEN.search(page, place) if place <= last else OPEN_END.search(page, place)
        text = page[place : found.start() if found else size]
        if text:
            at.children.append(text)
        if not found or place > last:
            break
        place = found.end()
        tag = found["tag"] or found["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if found["end"] or found["end2"]:
            if counts[tag]:
                node = at
                while node.tag != tag:
                    node = node.parent
                at = leave(node)
            continue
        raw = found["attrs"] or found["attrs2"] or ""
        if tag == "html":
            root.attrs = {**attributes(raw), **root.attrs} if raw else root.attrs
            continue
        for group in ("p" if tag in ENDS_PARAGRAPH else None, CLOSES.get(tag)):
            if group and at.open.get(group):
                at = leave(at.open[group])
        node = Node(tag, attributes(raw) if raw else {}, at)
        at.children.append(node)
        if tag in VOID or raw.endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, place)
            shut = page.find(">", end.start()) if end else -1
            place = shut + 1 if shut >= 0 else size
            continue
        node.open = opened(node, at.open) if tag in GROUPED else at.open
        counts[tag] += 1
        at = node
    return root


def cut_off(node: Node, in_article: bool) -> bool:
    """Whether an element is no part of an article, by its tag, role or style."""
    tag, attrs = node.tag, node.attrs
    if tag in CUT_TAGS or tag in RAW:
        return True
    if tag == "label" and ("for" in attrs or any(isinstance(c, Node) and c.tag in ("input", "select", "textarea") for c in node.children)):
        return True
    if tag == "header":
        return not in_article or not any(isinstance(c, Node) and c.tag in HEADINGS for c in node.children)
    if not attrs or tag in KEEP_TAGS:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    return attrs.get("role", "").lower() in CUT_ROLES


def named_off(node: Node, names: frozenset[str] = CUT_NAMES) -> bool:
    """Whether a part of the class or id names something that is no part of an article."""
    if not node.attrs:
        return False
    parts = set()
    for name in f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".split():
        for part in NAME_PARTS.findall(name):
            if part.lower() in MODIFIERS:
                break
            parts.add(part.lower())
    return bool(parts & names) and not (node.tag in HEADINGS and "header" in parts)


def prune(root: Node) -> None:
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        node.children = [c for c in node.children if not isinstance(c, Node) or not cut_off(c, inside)]
        stack.extend((c, inside) for c in node.children if isinstance(c, Node))
    facts, prose, core = holdings(root)
    # Paragraph text of articles and main elements.
    told = sum(prose[id(n)] for n in core_elements(root))
    stack = [(root, False, False)]
    while stack:
        node, in_article, in_core = stack.pop()
        in_article = in_article or node.tag == "article"
        in_core = in_core or node.tag in ("article", "main")

        def stays(c: Node) -> bool:
            # An article within an article is a reader's comment or the like.
            if c.tag in KEEP_TAGS or not named_off(c) or core[id(c)] and not in_article:
                return True
            if in_core and not named_off(c, CUT_NAMES - WEAK_NAMES):
                length, links, _ = facts[id(c)]
                return prose[id(c)] >= LEAST_PARAGRAPH and 4 * links < length
            return 2 * prose[id(c)] > prose[id(root)] and (in_core or not told)

        node.children = [c for c in node.children if not isinstance(c, Node) or stays(c)]
        stack.extend((c, in_article, in_core) for c in node.children if isinstance(c, Node))


def core_elements(root: Node) -> list[Node]:
    """The outermost articles and main elements that are not named as something else."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag in ("article", "main") and not named_off(node):
            out.append(node)
        else:
            stack.extend(c for c in node.children if isinstance(c, Node))
    return out


def holdings(root: Node) -> tuple[dict, dict[int, float], dict[int, bool]]:
    """Of every element: measures, paragraph text outside links, and whether it holds an article, main element or first heading."""
    facts, order = measure(root)
    prose: dict[int, float] = {}
    core: dict[int, bool] = {}
    for node in order:
        below = [c for c in node.children if isinstance(c, Node)]
        length, links, _ = facts[id(node)]
        if node.tag in PARAGRAPHS and not any(c.tag in BLOCKS for c in below):
            prose[id(node)] = length - links if length >= LEAST_PARAGRAPH else 0
        else:
            prose[id(node)] = sum(prose[id(c)] for c in below)
        core[id(node)] = any(core[id(c)] or c.tag in ("article", "main", "h1") and not named_off(c) for c in below)
    return facts, prose, core


def measure(root: Node) -> tuple[dict[int, tuple[int, int, int]], list[Node]]:
    """Text length, link length and commas of every element; and all elements, children before parents."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node))
    order.reverse()
    facts: dict[int, tuple[int, int, int]] = {}
    for node in order:
        length = links = commas = 0
        for c in node.children:
            if isinstance(c, Node):
                a, b, k = facts[id(c)]
                length, links, commas = length + a, links + b, commas + k
            else:
                length += len(c.strip())
                commas += c.count(",") + c.count("，") + c.count("、")
        facts[id(node)] = (length, length if node.tag == "a" else links, commas)
    return facts, order


def best_container(root: Node, facts: dict, order: list[Node]) -> Node | None:
    """The element with the most points after the discount for links."""
    candidates: dict[int, Node] = {}
    for node in order:
        if node.tag not in PARAGRAPHS or any(isinstance(c, Node) and c.tag in BLOCKS for c in node.children):
            continue
        length, _, commas = facts[id(node)]
        if length < LEAST_PARAGRAPH:
            continue
        points = 1 + commas + min(length / 100, 3)
        above, depth = node.parent, 0
        while above is not None and depth < 5:
            if not above.scored:
                above.scored = True
                names = {p.lower() for p in NAME_PARTS.findall(f"{above.attrs.get('class', '')} {above.attrs.get('id', '')}")}
                above.points = {"article": 25.0, "main": 15.0, "div": 5.0, "section": 5.0}.get(above.tag, 0.0) + 15.0 * bool(names & GOOD_NAMES)
                candidates[id(above)] = above
            above.points += points * (1.0, 0.5, 0.2, 0.1, 0.05)[depth]
            above, depth = above.parent, depth + 1
    if not candidates:
        return None
    return max(candidates.values(), key=lambda n: discounted(n, facts))


def discounted(node: Node, facts: dict) -> float:
    length, links, _ = facts[id(node)]
    return node.points * (1 - links / max(1, length))


def chosen(best: Node, facts: dict) -> list:
    """The best container and those siblings that belong to it.

    Where the container lies in an article (or main element) the whole article is meant, and its siblings are asked.
    """
    around = best
    while around.parent is not None and around.tag not in ("article", "main"):
        around = around.parent
    least = max(10.0, 0.2 * discounted(best, facts))
    in_article = around.tag in ("article", "main")
    best = around if in_article else best
    if best.parent is None:
        return [best]
    out = []
    before = True
    for node in best.parent.children:
        if node is best:
            before = False
            out.append(node)
        elif isinstance(node, Node):
            length, links, _ = facts[id(node)]
            density = links / max(1, length)
            if in_article:
                # Beside an article only another article, or a heading above it within the main element.
                fits = node.tag == "article" and not named_off(node) or before and node.tag in HEADINGS and best.parent.tag == "main"
                if fits and density < 0.5 and (node.tag != "article" or discounted(node, facts) >= least):
                    out.append(node)
                continue
            heading = before and node.tag in HEADINGS
            prose = node.tag in ("p", "blockquote", "pre") and density < 0.25 and length >= LEAST_PARAGRAPH
            if heading or prose or discounted(node, facts) >= least and density < 0.5:
                out.append(node)
    return out


def blocks_of(nodes: list) -> list[str]:
    """Texts of all blocks in page order."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        line.clear()
        if text:
            out.append(text)

    stack: list = list(reversed(nodes))
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            line.append(item)
        else:
            block = item.tag in BLOCKS
            if block:
                flush()
                stack.append(None)
            elif item.tag == "br":
                line.append(" ")
            stack.extend(reversed(item.children))
    flush()
    return out


def extract(page: str | None) -> str:
    """Main text of one page."""
    if not page:
        return ""
    root = parse(page.replace("\x00", ""))
    prune(root)
    facts, order = measure(root)
    best = best_container(root, facts, order)
    if best is None:
        lone = next((n for n in reversed(order) if n.tag in ("article", "main")), root)
        return "\n".join(blocks_of([lone]))
    return "\n".join(blocks_of(chosen(best, facts)))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every row."""

    def work():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = [extract(page) for page in part.column("html").to_pylist()]
            return pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

        return step

    return map_slices(pages.select("page_id", "url", "html"), "html", work, "page_id bigint, url string, text string")
