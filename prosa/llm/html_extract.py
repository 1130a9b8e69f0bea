"""Main text of web pages by wrapper induction.

Pages of a host come from few templates. For each host up to `pivots` pages are pivots (the smallest hash of each bucket of
pages). Every other page's tree is aligned to each pivot's by simple tree matching, and what is learnt of the pivot's nodes is added up:

* Constant nodes: a text that stays the same on the pages of its layout is template. A page is a copy of the pivot, and says nothing here,
  if it agrees with it in the slots that vary over the host and this is most of the page's own text; a page that shares no text with a pivot
  is of another layout.
* Constant structure: the main region is found from the root down, into the block that holds at least `main_share` of the text that varies
  over all pages. A block beside that region is template, whatever it says on each page, if it stands at its place with the same structure (runs of
  like siblings count as one) on the pages of the host and holds little text (`small_share` of the region's). So menus, adverts and footers go whose
  texts change from page to page.

What remains are the varying slots, the content. Names are a second witness, for hosts with few pages and for blocks without a fixed place: landmark
elements and roles, and classes and ids that consist of such names alone, are no content; where a page marks its article or main part, only
what is inside is.

Bounds of the evidence: template needs at least `least_pages` (4; for equal texts inside an article `article_pages`, 20) compared pages of
the host, so hosts with fewer have no template beyond the names; and at least `present_share` of the compared pages, so that rarer
layouts and notices, and those of which no pivot is an example, stay content. Headings go only where their text is constant.

Pages are compared where they are read; what leaves a task are sums by pivot and two bits for each node and page. Pivots are joined by
host: they are broadcast if their measured size allows it, else pages are shuffled and skewed hosts split. A page is parsed whole; inline markup
doesn't nest, so unclosed inline tags do no harm. Lists of siblings of any length get the same largest match; long ones (over MOST_CELLS steps) are
matched by rows of numbers, subtrees of equal structure are weighed once, and memory grows with the length to the power of 1.5.

Defined cases: null or empty html has the text ""; a page of any length and depth is read whole; a null url belongs to the host ""; repeated rows
each get a row; of equally heavy matches the one of the later siblings counts; hosts with a single page have no template beyond the
names; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prosa.llm.common import broadcast_if_small, stage, worker_cache

#: Comments, start tags (a quote opens a value only after an equals sign), end tags, declarations, and a tag that the end of the page cuts off.
_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>|</([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>|<[a-zA-Z][^>]*+\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_WORD = re.compile(r"[a-z]+")
#: Element names of HTML and the names that mark what isn't main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg select object canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mtable mtr mtd semantics annotation".split()
)
LANDMARKS = frozenset("nav footer aside form head button dialog menu fieldset".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
MARKS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead banner footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr notice notices "
    "newsletter popup comment comments disqus pagination pager".split()
)
#: Words that say nothing beside a mark, as in "site-footer".
NEUTRAL = frozenset("site page main top bottom left right global wrapper container box block bar area list section inner primary secondary".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Plain elements nested deeper get no node of their own: their children join the element around them. They still open and close.
MOST_DEPTH = 200
#: Steps of a match of two lists of siblings that are taken one by one; beyond, by rows of numbers, with the same result, and with at least so many rows between two that are kept.
MOST_CELLS, BAND = 40_000, 16
#: Counters that a task holds before it sends them on.
MOST_COUNTERS = 2_000_000


@dataclass(frozen=True)
class ExtractOptions:
    constant_share: float = 0.8
    least_pages: int = 4
    article_share: float = 0.95
    article_pages: int = 20
    copy_share: float = 0.8
    present_share: float = 0.2
    main_share: float = 0.7
    small_share: float = 0.1
    pivots: int = 4


class Node:
    __slots__ = ("chars", "children", "hidden", "key", "plain", "shape", "slot", "tag", "text")

    def __init__(self, tag: str, key: str, hidden: bool):
        self.tag, self.key, self.hidden, self.children, self.text, self.slot, self.shape, self.chars, self.plain = tag, key, hidden, [], None, -1, 0, 0, -1


def _described(tag: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """What identifies an element beside its position, and whether it is a landmark. inside: within an article."""
    hidden = tag in LANDMARKS or tag == "header" and not inside
    if not attributes or attributes.isspace():
        return tag, hidden
    key = tag
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            key = f"{key} {value}" if name == "class" else key
            for token in value.split():
                words = set(_WORD.findall(token))
                if words & MARKS and words <= MARKS | NEUTRAL or "header" in words and words <= NEUTRAL | {"header"} and not inside and tag not in HEADINGS:
                    hidden = hidden or tag not in ("html", "body")
        elif name == "role":
            hidden = hidden or value in ROLES
            key = f"{key} main" if value == "main" else key
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    return key, hidden


def _content(node: Node) -> bool:
    return node.tag in CONTENT or node.key.endswith(" main")


def parse(page: str) -> Node:
    """The tree of block elements; texts are leaves (tag "#") with character references decoded and white space collapsed."""
    root = Node("#root", "#root", False)
    open_nodes, run, at = [root], [], 0
    skip = ""  # an inline landmark that is open
    articles = 0
    opened: dict[str, int] = {}  # open elements by name

    def flush() -> None:
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                leaf = Node("#", "#", False)
                leaf.text = text
                open_nodes[-1].children.append(leaf)

    def close_to(depth: int) -> None:
        nonlocal articles
        flush()
        for node in open_nodes[depth:]:
            articles -= node.tag in CONTENT
            opened[node.tag] -= 1
        del open_nodes[depth:]

    find = _TOKEN.search
    while m := find(page, at):
        if m.start() > at and not skip:
            run.append(page[at : m.start()])
        at = m.end()
        if name := m[1]:
            tag = name.lower()
            if tag in RAW:
                if not m[2].endswith("/") or tag != "svg":
                    end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(page, at)
                    at = end.end() if end else len(page)
                continue
            if tag in INLINE:
                if not skip and m[2] and _described(tag, m[2], True)[1]:
                    skip = tag
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif not skip:
                    run.append(" ")
                continue
            skip = ""
            flush()
            for k in range(len(open_nodes) - 1, 0, -1):  # elements that end here without saying so
                node = open_nodes[k]
                if node.tag == "p" or node.tag in CLOSES.get(tag, ()):
                    close_to(k)
                elif node.tag in SCOPES.get(tag, ()) or tag not in CLOSES:
                    break
            key, hidden = _described(tag, m[2], articles > 0)
            node = Node(tag, key, hidden)
            if len(open_nodes) > MOST_DEPTH and (not hidden or any(x.hidden for x in open_nodes)) and (not _content(node) or any(_content(x) for x in open_nodes)):
                node.children = open_nodes[-1].children
            else:
                open_nodes[-1].children.append(node)
            if not m[2].endswith("/"):
                open_nodes.append(node)
                opened[tag] = opened.get(tag, 0) + 1
                articles += tag in CONTENT
        elif name := m[3]:
            tag = name.lower()
            if tag in INLINE:
                skip = "" if skip == tag else skip
                continue
            if tag == "br":
                run.append(" ")
                continue
            for k in range(len(open_nodes) - 1 if opened.get(tag) else 0, 0, -1):
                if open_nodes[k].tag == tag:
                    skip = ""
                    close_to(k)
                    break
        elif skip:
            continue
    if at < len(page) and not skip:
        run.append(page[at:])
    flush()
    return root


def leaves(node: Node, inside: bool = False):
    """(leaf, inside an article or main) of what no landmark holds, in page order."""
    stack = [(node, inside)]
    while stack:
        node, inside = stack.pop()
        if node.tag == "#":
            yield node, inside
        elif not node.hidden:
            inside = inside or _content(node)
            stack.extend((x, inside) for x in reversed(node.children))


def every_node(root: Node) -> list[Node]:
    """All nodes in page order, landmarks included."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def measured(nodes: list[Node]) -> None:
    """Gives each node its structure (runs of like siblings count once) and its characters. nodes: in page order."""
    for node in reversed(nodes):
        if node.tag == "#":
            node.shape, node.chars = 1, len(node.text)
        else:
            shapes, chars = [node.key], 0
            for x in node.children:
                chars += x.chars
                if x.shape != shapes[-1]:
                    shapes.append(x.shape)
            node.shape, node.chars = hash(tuple(shapes)), chars


def numbered(page: str) -> Node:
    """A pivot: its nodes have numbers, in page order."""
    root = parse(page)
    nodes = every_node(root)
    for k, node in enumerate(nodes):
        node.slot = k
    measured(nodes)
    return root


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """The text leaves among matches()."""
    return [(x, y) for x, y in matches(a, b) if x.tag == "#"]


def matches(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of nodes that a largest order-keeping match of both trees sets side by side (simple tree matching)."""
    weights: dict[tuple[int, int], int] = {}

    def plain(x: Node) -> int:
        """1 for an element without children, 2 for one with a text only, else 0."""
        if x.plain < 0:
            x.plain = 1 if not x.children else 2 if len(x.children) == 1 and x.children[0].tag == "#" else 0
        return x.plain

    def weight(x: Node, y: Node) -> int:
        if x.key != y.key:
            return 0
        p, q = plain(x), plain(y)
        if p and q:
            return p if p == q else 1
        if (id(x), id(y)) not in weights:
            weights[id(x), id(y)] = 1 + matched(x.children, y.children, None)
        return weights[id(x), id(y)]

    def matched(xs: list[Node], ys: list[Node], take) -> int:
        """The weight of the best match of two lists of siblings; take gets its pairs."""
        total, i, end_x, end_y = 0, 0, len(xs), len(ys)
        while i < end_x and i < end_y and (p := plain(xs[i])) and p == plain(ys[i]) and xs[i].key == ys[i].key:  # equal plain siblings at either end are in some best match
            total += p
            if take:
                take(xs[i], ys[i])
            i += 1
        while end_x > i and end_y > i and (p := plain(xs[end_x - 1])) and p == plain(ys[end_y - 1]) and xs[end_x - 1].key == ys[end_y - 1].key:
            end_x, end_y = end_x - 1, end_y - 1
            total += p
            if take:
                take(xs[end_x], ys[end_y])
        left, right = xs[i:end_x], ys[i:end_y]
        if not left or not right:
            return total
        return total + (by_rows if len(left) * len(right) > MOST_CELLS else whole)(left, right, take)

    def whole(left: list[Node], right: list[Node], take) -> int:
        best = [[0] * (len(right) + 1)]
        own = [[weight(x, y) for y in right] for x in left]
        for row in own:
            above, now = best[-1], [0]
            for j, w in enumerate(row):
                now.append(max(above[j] + w, above[j + 1], now[j]) if w else max(above[j + 1], now[j]))
            best.append(now)
        if take:
            p, q = len(left), len(right)
            while p and q:
                if own[p - 1][q - 1] and best[p][q] == best[p - 1][q - 1] + own[p - 1][q - 1]:
                    p, q = p - 1, q - 1
                    take(left[p], right[q])
                elif best[p][q] == best[p - 1][q]:
                    p -= 1
                else:
                    q -= 1
        return best[-1][-1]

    kinds: dict[tuple, int] = {}
    kind_of: dict[int, int] = {}

    def kind(x: Node) -> int:
        """A number for the element and all below it: nodes with the same number have the same weight with any other."""
        if id(x) not in kind_of:
            kind_of[id(x)] = kinds.setdefault((x.key, tuple(map(kind, x.children))), len(kinds))
        return kind_of[id(x)]

    def by_rows(left: list[Node], right: list[Node], take) -> int:
        """whole() with a row of weights at a time. Of the best weights every `step`-th row is kept; the way back makes those between again."""
        mine, theirs = [kind(x) for x in left], [kind(y) for y in right]
        distinct = {n: y for n, y in zip(reversed(theirs), reversed(right))}
        order = {n: j for j, n in enumerate(distinct)}
        columns = np.array([order[n] for n in theirs])
        weights = {n: np.array([weight(x, y) for y in distinct.values()], np.int32) for n, x in dict(zip(mine, left)).items()}

        def after(above: np.ndarray, i: int) -> np.ndarray:
            return np.append(np.int32(0), np.maximum.accumulate(np.maximum(above[1:], above[:-1] + weights[mine[i]][columns])))

        step = max(BAND, math.isqrt(len(left)))
        row, kept = np.zeros(len(right) + 1, np.int32), []
        for i in range(len(left)):
            if take and i % step == 0:
                kept.append(row)
            row = after(row, i)
        total = int(row[-1])
        if take:
            q = len(right)
            for start in range((len(kept) - 1) * step, -1, -step):
                best = [kept.pop()]
                for i in range(start, min(start + step, len(left))):
                    best.append(after(best[-1], i))
                p = len(best) - 1
                while p and q:
                    w = weights[mine[start + p - 1]][columns[q - 1]]
                    if w and best[p][q] == best[p - 1][q - 1] + w:
                        p, q = p - 1, q - 1
                        take(left[start + p], right[q])
                    elif best[p][q] == best[p - 1][q]:
                        p -= 1
                    else:
                        q -= 1
        return total

    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        if plain(x) == plain(y) == 2:
            pairs.append((x.children[0], y.children[0]))
        elif x.children and y.children:
            matched(x.children, y.children, lambda p, q: todo.append((p, q)))
    return pairs


@dataclass(frozen=True)
class Template:
    """What a pivot shows: numbers of its leaves that are template by their text and of its blocks that are by their structure; most characters of such a block on a page."""

    pivot: Node
    constant: frozenset
    blocks: frozenset = frozenset()
    most: float = 0.0

    def marked(self, root: Node) -> set[int]:
        """The ids of the nodes of a page, measured before, that are template."""
        out = set()
        for x, y in matches(self.pivot, root):
            if x.slot in self.constant and x.text == y.text or x.slot in self.blocks and x.shape == y.shape and y.chars <= self.most:
                out.add(id(y))
        return out


def main_text(page: str, pivot: Node | None, constant: frozenset) -> str:
    """The content blocks of a page, joined by newlines. constant: numbers of the pivot's leaves that are template."""
    return content_text(page, [Template(pivot, constant)] if pivot and constant else [])


def content_text(page: str, known: list[Template]) -> str:
    """main_text() by several pivots: what any of them shows to be template goes."""
    root = parse(page)
    if known:
        measured(every_node(root))
        gone: set[int] = set().union(*(t.marked(root) for t in known))
        stack = [root]
        while stack:
            node = stack.pop()
            node.children = [x for x in node.children if id(x) not in gone]
            stack += node.children
    found = list(leaves(root))
    if any(inside for _, inside in found):
        found = [(leaf, inside) for leaf, inside in found if inside]
    return "\n".join(leaf.text for leaf, _ in found)


def _pivot(page: str) -> Node:
    cache = worker_cache("pivots")
    if page not in cache:
        if len(cache) > 500:
            cache.clear()
        cache[page] = numbered(page)
    return cache[page]


class Evidence:
    """Sums over the pages compared to one pivot, by number of its nodes: how often a block was found, how often with the same structure, its characters, and how often a text was the same."""

    def __init__(self, size: int):
        self.pages, self.sums = 0, np.zeros((4, size), np.int64)

    def add(self, pivot: Node, root: Node, copy_share: float) -> tuple[np.ndarray, np.ndarray, bool]:
        """Adds a page, measured before; returns which leaves have the same text, which were aligned, and whether most of the page's text is that of the pivot."""
        same, aligned, placed, shaped, chars, held = [], [], [], [], [], 0
        for x, y in matches(pivot, root):
            if x.tag == "#":
                aligned.append(x.slot)
                if x.text == y.text:
                    same.append(x.slot)
                    held += y.chars
            else:
                placed.append(x.slot)
                chars.append(y.chars)
                if x.shape == y.shape:
                    shaped.append(x.slot)
        self.pages += 1
        self.sums[0, placed] += 1
        self.sums[1, shaped] += 1
        self.sums[2, placed] += np.array(chars, np.int64)
        self.sums[3, same] += 1
        bits = np.zeros((2, self.sums.shape[1]), bool)
        bits[0, same] = bits[1, aligned] = True
        return bits[0], bits[1], held > copy_share * root.chars

    def blocks(self, pivot: Node, options: ExtractOptions) -> tuple[list[int], float]:
        """Numbers of the pivot's blocks that are template by their structure, and the most characters that such a block has on a page."""
        placed, shaped, chars, same = self.sums
        varying = chars.copy()  # without the texts that were the same as the pivot's
        nodes = every_node(pivot)
        constant = {id(x): int(same[x.slot]) * len(x.text) for x in nodes if x.tag == "#"}
        for x in reversed(nodes):
            if x.tag != "#":
                constant[id(x)] = sum(constant[id(y)] for y in x.children)
                varying[x.slot] -= constant[id(x)]
        mean = lambda x: varying[x.slot] / max(1, placed[x.slot])
        region, beside = pivot, []
        while True:
            within = [x for x in region.children if any(y.tag != "#" for y in x.children)]
            best = max(within, key=lambda x: varying[x.slot], default=None)
            if best is None or _content(region) or varying[best.slot] < options.main_share * max(1, varying[region.slot]):
                break
            beside += [x for x in region.children if x is not best]
            region = best
        most, out = options.small_share * mean(region), []
        for block in beside:
            stack = [block]
            while stack:
                x = stack.pop()
                if x.tag == "#" or x.tag in HEADINGS or x.tag == "head":
                    continue
                enough = placed[x.slot] >= max(options.least_pages, options.present_share * self.pages) and shaped[x.slot] >= options.constant_share * placed[x.slot]
                if enough and mean(x) <= most and not any(y.tag in HEADINGS for y in every_node(x)):
                    out.append(x.slot)
                else:
                    stack += x.children
        return sorted(out), 2 * most


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1))
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))


SUMS = "host string, bucket int, pages long, akin long, sums binary"


def _sum_rows(held: dict) -> pa.RecordBatch:
    """A row of SUMS for each (host, bucket): (pages, akin, sums as a matrix of numbers)."""
    keys = list(held)
    columns = ([k[0] for k in keys], [k[1] for k in keys], [held[k][0] for k in keys], [held[k][1] for k in keys], [held[k][2].astype(np.int64).tobytes() for k in keys])
    types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["host", "bucket", "pages", "akin", "sums"])


def _added(rows: DataFrame) -> DataFrame:
    """SUMS with one row for each (host, bucket). A task sends a row for each at a time, so these groups are as small as the number of tasks."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("sums").to_pylist())
        pages, akin = (sum(table.column(c).to_pylist()) for c in ("pages", "akin"))
        return pa.Table.from_batches([_sum_rows({(table.column("host")[0].as_py(), table.column("bucket")[0].as_py()): (pages, akin, total)})])

    return rows.groupBy("host", "bucket").applyInArrow(add, SUMS)


def _bits(data: bytes, size: int | None = None) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=size).astype(np.int64)


def templates(pages: DataFrame, options: ExtractOptions) -> DataFrame:
    """host and known: (pivot's html, constant, blocks and most of its Template) of each pivot. pages: with_host()."""
    bucket = F.pmod(F.xxhash64("page_id", "url"), F.lit(options.pivots)).cast("int")
    order = F.struct(F.xxhash64("page_id", "url", F.lit("pivot")).alias("h"), F.col("page_id").alias("id"), F.xxhash64("html").alias("page"))
    full = pages.where("html <> ''").withColumn("bucket", bucket)
    first = stage(full.groupBy("host", "bucket").agg(F.min(order).alias("first")).select("host", "bucket", "first.*"), "pivots")
    same_page = (full.host == first.host) & (full.bucket == first.bucket) & (F.xxhash64("page_id", "url", F.lit("pivot")) == first.h) & (F.xxhash64("html") == first.page)
    pivots = stage(full.join(first, same_page).select(first.host, first.bucket, F.col("html").alias("pivot")).dropDuplicates(["host", "bucket"]), "pivot-pages")
    grouped = stage(pivots.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("bucket", "pivot"))).alias("own")), "pivot-groups")  # at most options.pivots; staged, so that its size is known and pages need no shuffle

    def compare(batches):
        """For each page and pivot two bits by node; in between and at the end the sums of an Evidence by pivot, as rows of SUMS."""
        held: dict = {}
        for batch in batches:
            rows = []
            for host, page, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                root = None
                for p in own:
                    if page == p["pivot"]:
                        continue
                    if root is None:
                        root = parse(page)
                        measured(every_node(root))
                    pivot = _pivot(p["pivot"])
                    key = host, p["bucket"]
                    if key not in held:
                        held[key] = Evidence(len(every_node(pivot)))
                    same, aligned, near = held[key].add(pivot, root, options.copy_share)
                    rows.append((*key, near, np.packbits(same).tobytes(), np.packbits(aligned).tobytes(), None))
            if rows:
                yield _page_rows(rows)
            if sum(e.sums.size for e in held.values()) > MOST_COUNTERS:
                yield _evidence_rows(held)
                held = {}
        if held:
            yield _evidence_rows(held)

    compared = stage(full.join(broadcast_if_small(grouped), "host").select("host", "html", "own").mapInArrow(compare, PAGES), "page-evidence")
    by_page = compared.where("sums is null")

    def count_same(batches):
        held: dict = {}
        for batch in batches:
            for host, bucket, same in zip(*(batch.column(c).to_pylist() for c in ("host", "bucket", "same"))):
                pages, _, total = held.get((host, bucket), (0, 0, 0))
                held[host, bucket] = pages + 1, 0, total + _bits(same)
        yield _sum_rows(held)

    everywhere = _added(by_page.select("host", "bucket", "same").mapInArrow(count_same, SUMS))

    def vary(batches):
        """The characters of the pivot's leaves where too few of all pages agree with it, 0 for the others."""
        for batch in batches:
            out = []
            for pages, sums, pivot in zip(*(batch.column(c).to_pylist() for c in ("pages", "sums", "pivot"))):
                nodes = every_node(_pivot(pivot))
                chars = np.array([len(x.text) if x.tag == "#" else 0 for x in nodes], np.int32)
                out.append(np.where(np.frombuffer(sums, np.int64)[: len(nodes)] < options.constant_share * pages, chars, 0).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["host", "bucket", "lens"])

    key = ["host", "bucket"]
    lens = stage(pivots.join(everywhere, key).select("host", "bucket", "pages", "sums", "pivot").mapInArrow(vary, "host string, bucket int, lens binary"), "slot-lengths")

    def tell(batches):
        """Of pages that are no copies: how often each leaf was the same and aligned, on those that share any text."""
        held: dict = {}
        for batch in batches:
            for host, bucket, near, same, aligned, own in zip(*(batch.column(c).to_pylist() for c in ("host", "bucket", "near", "same", "aligned", "lens"))):
                own = np.frombuffer(own, np.int32)
                bits = _bits(same, len(own))
                if near and (not own.any() or bits @ own > options.copy_share * own.sum()):
                    continue
                pages, akin, total = held.get((host, bucket), (0, 0, np.zeros(2 * len(own), np.int64)))
                if bits.any():
                    akin, total = akin + 1, total + np.concatenate([bits, _bits(aligned, len(own))])
                held[host, bucket] = pages + 1, akin, total
        yield _sum_rows(held)

    told = _added(by_page.join(broadcast_if_small(lens), key).select("host", "bucket", "near", "same", "aligned", "lens").mapInArrow(tell, SUMS))
    shaped = _added(compared.where("sums is not null").select("host", "bucket", "pages", F.lit(0).cast("long").alias("akin"), "sums"))

    def decide(batches):
        for batch in batches:
            constant, blocks, most = [], [], []
            for pivot, pages, akin, sums, all_pages, shapes in zip(*(batch.column(c).to_pylist() for c in ("pivot", "pages", "akin", "sums", "all_pages", "shapes"))):
                root = _pivot(pivot)
                nodes = every_node(root)
                size = len(nodes)
                inside = {id(x) for x, y in leaves(root) if y}
                own: list[int] = []
                if sums is not None:
                    n, n_aligned = np.frombuffer(sums, np.int64).reshape(2, size)
                    for x in nodes:
                        if x.tag == "#" and n[x.slot] >= options.present_share * pages:
                            seen = n[x.slot]
                            if akin >= options.article_pages and seen >= options.article_share * akin if id(x) in inside else seen >= options.least_pages and seen >= options.constant_share * n_aligned[x.slot]:
                                own.append(x.slot)
                evidence = Evidence(size)
                evidence.pages, evidence.sums = all_pages, np.frombuffer(shapes, np.int64).reshape(4, size)
                found, limit = evidence.blocks(root, options)
                constant.append(own)
                blocks.append(found)
                most.append(limit)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(constant, pa.list_(pa.int32())), pa.array(blocks, pa.list_(pa.int32())), pa.array(most, pa.float64())], names=["host", "pivot", "constant", "blocks", "most"])

    judged = pivots.join(shaped.select(*key, F.col("pages").alias("all_pages"), F.col("sums").alias("shapes")), key).join(told.select(*key, "pages", "akin", "sums"), key, "left")
    known = judged.select("host", "pivot", "pages", "akin", "sums", "all_pages", "shapes").mapInArrow(decide, "host string, pivot string, constant array<int>, blocks array<int>, most double")
    return stage(known.where(F.size("constant") + F.size("blocks") > 0).groupBy("host").agg(F.collect_list(F.struct("pivot", "constant", "blocks", "most")).alias("known")), "templates")


PAGES = "host string, bucket int, near boolean, same binary, aligned binary, sums binary, pages long"


def _page_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([1] * len(rows), pa.int64())], names=["host", "bucket", "near", "same", "aligned", "sums", "pages"])


def _evidence_rows(held: dict) -> pa.RecordBatch:
    n = len(held)
    nothing = [None] * n
    columns = ([k[0] for k in held], [k[1] for k in held], nothing, nothing, nothing, [e.sums.tobytes() for e in held.values()], [e.pages for e in held.values()])
    types = (pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["host", "bucket", "near", "same", "aligned", "sums", "pages"])


def extract(pages: DataFrame, options: ExtractOptions = ExtractOptions()) -> DataFrame:
    """page_id, url, text and n_chars, a row per page."""
    hosted = with_host(pages)
    known = templates(hosted, options)

    def read(batches):
        for batch in batches:
            texts = [content_text(page, [Template(_pivot(k["pivot"]), frozenset(k["constant"]), frozenset(k["blocks"]), k["most"]) for k in own or ()]) for page, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return hosted.join(broadcast_if_small(known), "host", "left").select("page_id", "url", "html", "known").mapInArrow(read, "page_id long, url string, text string, n_chars long")
