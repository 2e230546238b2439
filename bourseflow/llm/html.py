"""Main text of web pages by composite text density.

A page becomes a tree of elements. Every node has its characters, tags, link
characters and link tags; its density is characters per tag, adjusted for links
(the more of its text is linked, the lower). A node's sum is that of its
children's densities. Elements that are never the article (navigation, footers,
forms, ...) are cut off first, and so are parts whose class, id or role marks them
as such (notices, advertisements, comments, ...), unless they hold most of the
page: more than half of the unlinked characters of its ``article`` and ``main``
elements, or of all where it has none. Such a mark is a wrapper's ("has-sidebar"), and densities decide
inside it. The subtree with the largest sum is the core; the smallest density on
the path from it up to the body is the threshold, and what is as dense as that,
beside the core, belongs to the text too. A core inside an ``article`` or ``main``
element stands for that element, so there the page's own marking decides, not the
sums.

Defined cases: null and empty pages, and pages without text, give the empty
text; unclosed and stray tags are mended as browsers do for blocks (a new
block closes an open paragraph); ties go to the first node in page order;
equal rows each get a row; pages are read whole; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names with a fixed meaning.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset("script style noscript template head nav footer aside form iframe object svg canvas button select textarea menu dialog audio video input label".split())
SUBJECT = frozenset("article main".split())
#: Words of class, id and role values that mark parts outside the article.
NOISE = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "cookie cookies consent notice gdpr popup modal overlay newsletter subscribe subscription signup comment comments disqus reply replies respond share sharing "
    "social related recommended widget masthead topbar toolbar pagination pager search login complementary contentinfo disclaimer alert skip".split()
)
_TOKEN = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Node:
    __slots__ = ("name", "noise", "marked", "plain", "subject", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "keep")

    def __init__(self, name: str, noise: bool, marked: bool, parent: Node | None):
        self.name, self.noise, self.marked, self.parent = name, noise, marked, parent
        self.plain = self.subject = 0
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.keep = False


def _is_noise(name: str, attrs: list[tuple[str, str | None]], inside_subject: bool) -> bool:
    if name in NEVER or (name == "header" and not inside_subject):
        return True
    return name not in ("body", "html", *SUBJECT) and any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)


def _is_marked(name: str, attrs: list[tuple[str, str | None]]) -> bool:
    if name in ("body", "html", *SUBJECT):
        return False
    values = [v for k, v in attrs if k in ("class", "id", "role") and v]
    return any(t.lower() in NOISE for v in values for t in _TOKEN.findall(v))


def _judge_marks(root: Node) -> None:
    """Marked nodes are noise, unless they hold most of the page's text."""
    order, stack = [], [(root, False, False)]
    while stack:
        node, linked, inside = stack.pop()
        order.append(node)
        linked, inside = linked or node.name == "a", inside or node.name in SUBJECT
        own = 0 if linked else sum(len(c.strip()) for c in node.children if isinstance(c, str))
        node.plain, node.subject = own, own if inside else 0
        stack += [(c, linked, inside) for c in node.children if not isinstance(c, str) and not c.noise]
    for node in reversed(order):
        if node.parent is not None:
            node.parent.plain += node.plain
            node.parent.subject += node.subject
    for node in order:
        held, total = (node.subject, root.subject) if root.subject else (node.plain, root.plain)
        node.noise |= node.marked and 2 * held <= total


class Builder(HTMLParser):
    """Tree of a page, mending what is not closed."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", False, False, None)
        self.subjects = 0
        self.open: Counter[str] = Counter()  # elements around the current place, by name

    def handle_starttag(self, name: str, attrs) -> None:
        if name in BLOCK and name != "br":
            self._close("p", barrier=("article", "section", "div", "td", "body", "li", "blockquote", "main", "button"))
        if name in ("li", "dd", "dt", "td", "th", "tr", "option"):
            same = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
            for n in same:
                self._close(n, barrier=("ul", "ol", "table", "dl", "tr", "select") if name not in ("tr",) else ("table",))
        node = Node(name, _is_noise(name, attrs, self.subjects > 0), _is_marked(name, attrs), self.at)
        self.at.children.append(node)
        if name not in VOID:
            self.at = node
            self.open[name] += 1
            self.subjects += name in SUBJECT

    def handle_startendtag(self, name: str, attrs) -> None:
        self.handle_starttag(name, attrs)
        if name not in VOID and name not in BLOCK:
            self.handle_endtag(name)

    def _close(self, name: str, barrier: tuple[str, ...]) -> None:
        if not self.open[name]:
            return
        node = self.at
        while node is not self.root and node.name != name and node.name not in barrier:
            node = node.parent
        if node.name == name and node is not self.root:
            self._leave(node)

    def _leave(self, node: Node) -> None:
        done = False
        while not done:
            done = self.at is node
            self.subjects -= self.at.name in SUBJECT
            self.open[self.at.name] -= 1
            self.at = self.at.parent

    def handle_endtag(self, name: str) -> None:
        if not self.open[name]:
            return
        node = self.at
        # an inline end tag does not close blocks around it
        while node is not self.root and node.name != name:
            if name not in BLOCK and node.name in BLOCK:
                return
            node = node.parent
        if node is not self.root:
            self._leave(node)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def _measure(root: Node) -> list[Node]:
    """Counts, densities and sums, without recursion; nodes in page order, noise left out."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in reversed(node.children) if not isinstance(c, str) and not c.noise]
    for node in reversed(order):
        node.chars = sum(len(c.strip()) if isinstance(c, str) else 0 if c.noise else c.chars for c in node.children)
        inner = [c for c in node.children if not isinstance(c, str) and not c.noise]
        node.tags = sum(c.tags + 1 for c in inner)
        node.link_chars = node.chars if node.name == "a" else sum(c.link_chars for c in inner)
        node.link_tags = sum(c.link_tags + (c.name == "a") for c in inner)
    body = next((n for n in order if n.name == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(order):
        if node.chars:
            linked, plain = node.link_chars, node.chars - node.link_chars
            per_tag = node.chars / max(1, node.tags)
            base = log(node.chars / max(1, plain) * linked + share * node.chars + e)
            node.density = per_tag * log(max(1.0, node.chars / max(1, linked) * max(1, node.tags) / max(1, node.link_tags)) + 1e-9 + 1, base) if base > 1 else per_tag
            node.density = max(0.0, node.density)
        node.total = sum(c.density for c in node.children if not isinstance(c, str) and not c.noise)
        if node.total == 0.0:
            node.total = node.density
    return order


def main_text(html: str | None) -> str:
    """The article's text, blocks joined by one space."""
    builder = Builder()
    builder.feed(html or "")
    builder.close()
    _judge_marks(builder.root)
    order = _measure(builder.root)
    body = next((n for n in order if n.name == "body"), builder.root)
    inside = [n for n in order if n.chars]
    if not inside:
        return ""
    core = max(inside, key=lambda n: n.total)  # the first of equals
    path, node = [], core
    while node is not None:
        path.append(node)
        if node is body:
            break
        node = node.parent
    for node in path:
        if node.name in SUBJECT:
            core = node
    threshold = min(n.density for n in path)
    if not any(n.name in SUBJECT for n in path):
        # beside the core, what is as dense as the sparsest node around it
        for node in inside:
            node.keep = node.density >= threshold and node not in path
    core.keep = True
    parts: list[str] = []
    stack: list[tuple[object, bool]] = [(builder.root, False)]
    while stack:
        item, kept = stack.pop()
        if isinstance(item, str):
            if kept:
                parts.append(item)
            continue
        if item.noise:
            parts.append(" " if item.name in BLOCK else "")
            continue
        kept = kept or item.keep
        edge = [(" ", True)] if item.name in BLOCK else []
        stack += [*edge, *((c, kept) for c in reversed(item.children)), *edge]
    return " ".join("".join(parts).split())


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` with ``_text``."""
    names = pages.columns

    def step(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(names.index(html_column))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "_text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return pages.mapInArrow(step, f"{fields}, _text string")


def report(pages: DataFrame) -> DataFrame:
    """The registered query."""
    found = extract(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("_text").alias("text"), F.char_length("_text").cast("bigint").alias("n_chars"))
