"""Main text of web pages by consensus host paths.

Each page's containers are scored and its best one votes for its generalised path (tags and classes from the root,
numbers taken out). The votes of a host are counted in Spark, and every page is read again: the containers on its
host's winning path give its text, or, where they would miss some of the page's article, its own best container.

The article is never cut: the best container is the outermost one that is marked as content, if all that counts
outside it stands in boxes that are not so marked, or else the smallest one with all that counts.

What is no content is left out wherever it stands: by tag (menus, headers, footers, sidebars, forms, scripts, styles)
and by a whole class, id or role (the same, and adverts, notices and reader comments). Never by class, id or role:
article, main, and a container with most of the page's text, unless one that is marked as content stands outside it. A
heading (header) and the captions inside an article are its text.

Defined cases: a null or empty page, or one without content, has the empty text and no vote; a null url or one without a
host belongs to the host "", which has no consensus, so its pages use their own best container; ties of votes go to the
larger sum of scores, then to the smaller path; broken markup is read leniently (blocks close an open paragraph, an end
tag without its start tag is skipped, an open comment, script or style runs to the end of the page); a very long page is
read whole; repeated pages vote each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, cut
from .urls import host_of

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noframes".split())
SKIPPED = frozenset("head nav header footer aside form button select option svg canvas object audio video menu dialog".split()) | RAW
BLOCKS = frozenset(
    "address article blockquote body br center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
) | (SKIPPED - {"button", "select", "option", "svg", "canvas", "object", "audio", "video"})
CONTAINERS = frozenset("article main section div td body html center".split())
#: Start tags that close an open element of the named ones.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Names in class, id or role that mark what is no content, as a whole or with a usual word before or behind.
NO_CONTENT = re.compile(
    r"(?:(?:site|global|main|primary|secondary|top|bottom)[-_])?"
    r"(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|side-bar|aside|complementary|contentinfo"
    r"|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|comments?|respond|disqus|replies|reply|share|sharing|social|related|recommended|widget|toolbar|pagination|pager|hidden)"
    r"(?:[-_]*(?:\d+|lists?|box|bar|block|container|wrapper|area|section|form|links?|buttons?|slot|unit|menu|banner|notice|consent|popup|modal|widget|thread|posts|articles|stories))?"
)
CONTENT = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|side-bar|aside|complementary|contentinfo"
    r"|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|comments?|respond|disqus|replies|reply|share|sharing|social|related|recommended|widget|toolbar|pagination|pager|hidden)(?:$|[^a-z])"
)
CONTENT = re.compile(r"(?:^|[^a-z])(?:article|content|post|entry|story|main|body|text)(?:$|[^a-z])")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Containers marked as content must have this share of a page's text to be its article by the page alone.
KEEPS_MARKED = 0.5


class Node:
    __slots__ = ("tag", "path", "parent", "marked", "skipped", "chars", "first", "last", "own", "inside", "hard", "doubt")

    def __init__(self, tag: str, marks: str, classes: str, parent: "Node | None", first: int):
        self.tag, self.parent, self.first, self.last, self.chars, self.own = tag, parent, first, -1, 0, 0
        name = tag + "".join("." + re.sub(r"\d+", "#", c) for c in sorted(set(classes.lower().split())))
        self.path = f"{parent.path}/{name}" if parent else name
        self.marked = tag in ("article", "main") or bool(marks and CONTENT.search(marks))
        self.inside = bool(parent and (parent.inside or parent.tag in ("article", "main")))
        self.hard = bool(parent and parent.hard) or tag in SKIPPED and not (tag == "header" and self.inside)
        self.skipped = self.hard
        self.doubt = tag not in ("body", "html", "article", "main") and any(NO_CONTENT.fullmatch(m) and not (m == "header" and self.inside) for m in marks.split())


def skip(every: list[Node], runs: list[tuple[Node | None, str]]) -> None:
    """Sets ``skipped``; ``every`` has each element after the one it stands in."""
    if not any(n.doubt for n in every):
        return
    count(runs)
    total = every[0].chars
    sure: list[Node] = []  # marked as content, and in nothing doubtful
    doubtful: set[int] = set()
    for node in every:
        if node.doubt or id(node.parent) in doubtful:
            doubtful.add(id(node))
        elif node.marked and node.chars:
            sure.append(node)
    # what is in a doubtful element is itself in doubt, so an outer ``sure`` one is outside it unless it holds it
    for node in every:
        if node.doubt and 2 * node.chars > total:
            above = {id(up) for up in ancestors(node)}
            node.doubt = any(id(n) not in above for n in sure)
        node.skipped = node.skipped or node.doubt or bool(node.parent and node.parent.skipped)
    for node in every:
        node.chars = node.own = 0


def parse(page: str) -> tuple[list[Node], list[tuple[Node | None, str]]]:
    """The containers in page order, and the runs: text with its element, or (None, "") where a block begins or ends."""
    nodes: list[Node] = []
    every: list[Node] = []
    runs: list[tuple[Node | None, str]] = []
    root = Node("#", "", "", None, 0)
    stack = [root]
    at, size = 0, len(page)

    def text(until: int) -> None:
        if until > at:
            runs.append((stack[-1], page[at:until]))

    def pop(depth: int) -> None:
        while len(stack) > depth:
            stack.pop().last = len(runs)

    while at < size:
        found = TOKEN.search(page, at)
        if found is None:
            text(size)
            break
        text(found.start())
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            runs.append((None, ""))
        if found[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            # an inline end tag doesn't close the block it stands in
            if depth and (tag in BLOCKS or not any(n.tag in BLOCKS for n in stack[depth + 1 :])):
                pop(depth)
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p" or stack[i].tag in CONTAINERS or stack[i].tag in ("table", "ul", "ol", "blockquote")), 0)
            if depth and stack[depth].tag == "p":
                pop(depth)
        if tag in CLOSES:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in CLOSES[tag] or stack[i].tag in CONTAINERS - {"td"} or stack[i].tag in ("table", "ul", "ol", "dl", "select")), 0)
            if depth and stack[depth].tag in CLOSES[tag]:
                pop(depth)
        marks = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in MARKS.finditer(found[3])} if found[3] else {}
        node = Node(tag, " ".join(marks.values()).lower(), marks.get("class", ""), stack[-1], len(runs))
        if tag in RAW and not found[3].endswith("/"):
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if found[3].endswith("/") and tag not in BLOCKS:
            continue
        stack.append(node)
        every.append(node)
        if tag in CONTAINERS:
            nodes.append(node)
    pop(0)
    skip([root, *every], runs)
    return [root, *nodes], runs


def count(runs: list[tuple[Node | None, str]]) -> None:
    """Sets what counts: ``chars`` of each node with all below it, and ``own`` of a container without those below it."""
    for node, run in runs:
        if node is None or node.skipped:
            continue
        above = [node]
        while above[-1].parent is not None:
            above.append(above[-1].parent)
        if any(up.tag == "a" for up in above):  # the text of links counts for no container
            continue
        size = len(run) - run.count(" ") - run.count("\n")
        for up in above:
            up.chars += size
        next(up for up in above if up.tag in CONTAINERS or up.parent is None).own += size


def on_path(nodes: list[Node], path: str) -> list[Node]:
    return [n for n in nodes if n.path == path and not n.skipped]


def outermost(nodes: list[Node]) -> list[Node]:
    """The containers marked as content that stand in no other one."""
    out = []
    for node in nodes:
        up = node.parent
        while up is not None and not up.marked:
            up = up.parent
        if node.marked and up is None and not node.skipped:
            out.append(node)
    return out


def whole(chosen: list[Node], nodes: list[Node]) -> bool:
    """Whether these containers have the article: all that counts outside them is in boxes not marked as content."""
    if sum(n.chars for n in chosen) == nodes[0].chars:
        return True
    tops = outermost(nodes)
    ids = {id(n) for n in chosen}
    if not ids <= {id(n) for n in tops} or any(n.chars for n in tops if id(n) not in ids):
        return False
    if chosen[0].tag in ("article", "main"):
        return True
    above = {id(up): up for n in chosen for up in ancestors(n)}
    return not any(up.own for up in above.values())


def ancestors(node: Node) -> Iterator[Node]:
    while node.parent is not None:
        node = node.parent
        yield node


def best(nodes: list[Node], runs: list[tuple[Node | None, str]]) -> Node | None:
    """A container whose path has the article; see above. Alike containers stand together: their path selects all."""
    root = nodes[0]
    if not root.chars:
        return None
    sums: dict[str, int] = {}
    for node in (tops := outermost(nodes)):
        sums[node.path] = sums.get(node.path, 0) + node.chars
    if tops:
        top = max(tops, key=lambda n: (sums[n.path], n.chars))
        if sums[top.path] >= KEEPS_MARKED * root.chars and whole([n for n in tops if n.path == top.path], nodes):
            return top
    # nodes are in page order, so the last one with everything is the deepest
    return [n for n in nodes if n.chars == root.chars and not n.skipped][-1]


def gather(chosen: list[Node], runs: list[tuple[Node | None, str]]) -> str:
    """The text of these elements: white space inside a block is one space, and blocks are joined by one."""
    blocks, now, covered = [], [], 0
    for top in chosen:
        if top.first < covered:  # inside one that was read
            continue
        covered = top.last
        for node, run in runs[top.first : top.last]:
            if node is None:
                blocks.append("".join(now))
                now = []
            elif not node.skipped:
                now.append(entities.unescape(run))
        blocks.append("".join(now))
        now = []
    return " ".join(" ".join(blocks).split())


def vote(page: str | None) -> tuple[str | None, int]:
    """The path that a page votes for, and its score."""
    nodes, runs = parse(page or "")
    count(runs)
    top = best(nodes, runs)
    return (None, 0) if top is None else (top.path, top.chars)


def extract(page: str | None, path: str | None) -> str:
    nodes, runs = parse(page or "")
    count(runs)
    top = best(nodes, runs)
    if top is None:
        return ""
    chosen = on_path(nodes, path) if path else []
    if not chosen or not sum(n.chars for n in chosen) or not (whole(chosen, nodes) or covers(chosen, on_path(nodes, top.path))):
        chosen = on_path(nodes, top.path)
    return gather(chosen, runs)


def covers(chosen: list[Node], article: list[Node]) -> bool:
    """Whether each container of the article that has text is, or is in, a chosen one."""
    ids = {id(n) for n in chosen}
    return all(id(n) in ids or any(id(up) in ids for up in ancestors(n)) for n in article if n.chars)


def consensus(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row for each host: ``__host`` and ``__path``, the path with most votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [vote(h.as_py()) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v[0] for v in votes], pa.string()), pa.array([v[1] for v in votes], pa.int64())], names=["__host", "__path", "score"])

    votes = pages.select(host_of(F.col(url)).alias("__host"), F.col(html).alias("html")).where("__host <> '' AND html IS NOT NULL").mapInArrow(run, "__host string, __path string, score long")
    # a hot host's votes meet as one row for each task and path
    counted = votes.where("__path IS NOT NULL").groupBy("__host", "__path").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))
    order = F.struct(-F.col("n"), -F.col("score"), F.col("__path"))
    return counted.groupBy("__host").agg(F.min_by("__path", order).alias("__path"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """For every page ``key``, url, text and n_chars."""
    kind = pages.schema[key].dataType.simpleString()
    winners = cut(consensus(pages, url, html))
    found = attach(pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("__host")), winners, ["__host"], "__path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py(), p.as_py()) for h, p in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["key", "url", "text", "n_chars"])

    return found.select("key", "url", "html", "__path").mapInArrow(run, f"key {kind}, url string, text string, n_chars long")


def texts(pages: DataFrame) -> DataFrame:
    """The query's digest: page_id, url, text and n_chars."""
    return main_text(pages).withColumnRenamed("key", "page_id")
