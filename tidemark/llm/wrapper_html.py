"""Main text of web pages by wrapper induction.

Pages of one host with one layout (the labels of the outer elements) share a template. One page of such a group,
the first in the order of a hash, is its reference, and every page of the group is aligned with it by simple tree
matching (the largest order-preserving match of nodes with equal labels). How often each node of the reference is
met, and how often with the same text, is counted over all pages, first in each partition. Nodes whose text is
the same on all pages are template, the others are slots, and the innermost node that holds most of the varying
prose is the content slot. Prose counts wherever it stands; that it is marked as an article or main part doubles its weight, a
word of class, id or role that is usual for boilerplate takes it down to an eighth. The wrapper of a group is the way to
its slot and the hashes of its constant texts. Every page is read with it.

Within the slot, navigation, page headers and footers, asides, forms, scripts and styles are left out by element;
adverts, notices, reader comments and the like by the words of class, id and role, unless the marked block holds most of
the slot's text: such a word on a container says nothing about what it holds. Character references are
decoded, white space inside a block becomes one space, blocks are joined by one space.

Null html counts as empty: text is empty. Pages without a host form a host of their own. A group with less than
three different pages, or whose pages are copies of one another for the most part, has no constants. Unclosed and
stray tags are repaired as browsers do in the common cases. Trees are aligned whole: a run of equal neighbours
(paragraphs, list items, rows) is one node, and so is a stretch of siblings whose labels all recur (headings and paragraphs in
turn). Parsing, measuring and aligning take time near linear in the page. Equally heavy slots: the first one. Repeated rows get a row each; an
empty table gives an empty result; extra columns, of whatever name, are not carried.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.session import bound_batches, settle

#: Trees and wrappers of up to so many bytes in all are broadcast; more are joined by page.
BROADCAST_BYTES = 32 << 20
#: Siblings with a label that more than so many of them have are one node where they stand together; of paragraphs, items and rows any run is.
LONG_RUN = 8
#: Weights of prose in the choice of the slot, and the share of a block's text from which on it is a container, whatever its marks.
MARKED, TOLD, CONTAINER = 0.125, 2.0, 0.8
#: Counts of nodes that a task holds before it passes them on.
HELD_NODES = 200_000

# fixed values: element names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
DROPPED = frozenset("nav footer aside form script style noscript template button select textarea iframe object svg canvas head title dialog menu".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
IMPLIED = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
SAME = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
# our own list of words of class, id and role that are usual for boilerplate: evidence, not a rule
MARKS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|comments?|commentlist|respond|replies|disqus|sidebar|side-bar|rail|widget\w*|menu|nav|navbar|navigation|breadcrumbs?|footer|foot|masthead|topbar|share|sharing|social|related|recommended|newsletter|subscribe|subscription|popup|modal|overlay|pagination|pager|skip-link|search|complementary|contentinfo|toolbar|tags|legal|disclaimer)(?:$|[\s_-])", re.I)
OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|[!?])")
ITEMS = frozenset("p li tr dt dd td th option br hr h1 h2 h3 h4 h5 h6 blockquote pre".split())
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Node:
    __slots__ = ("tag", "mark", "children", "hash", "size", "prose")

    def __init__(self, tag: str, mark: str = ""):
        self.tag, self.mark, self.children = tag, mark, []
        self.hash, self.size, self.prose = 0, 0, 0.0

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.mark}" if self.mark else self.tag

    @property
    def dropped(self) -> bool:
        return self.tag in DROPPED

    @property
    def marked(self) -> bool:
        return bool(self.mark and self.tag not in ("body", "html", "article", "main") and MARKS.search(self.mark))


def measure(root: Node) -> Node:
    """root with, for each node: the hash of its texts in order, characters that may be content, and weighted prose; links and boilerplate elements have none."""
    todo: list = [(root, 1.0, False)]
    while todo:
        x, weight, done = todo.pop()
        if not done:
            if x.dropped or x.tag == "a":
                weight = 0.0
            elif x.marked:
                weight *= MARKED if weight > 1e-9 else 1.0
            elif x.tag in ("article", "main") and weight <= 1.0:
                weight *= TOLD
            todo.append((x, weight, True))
            todo.extend((c, weight, False) for c in x.children if isinstance(c, Node))
            continue
        parts, x.size, x.prose = [], 0, 0.0
        for c in x.children if x.tag not in RAW else ():
            if isinstance(c, Node):
                if c.tag not in RAW and c.hash != NOTHING:
                    parts.append(f"\0{c.hash}")
                x.size += c.size
                x.prose += c.prose
            elif text := " ".join(c.split()):
                parts.append(text)
                x.size += len(text)
                x.prose += len(text) * weight
        if x.dropped:
            x.size = 0
        # a node around one other has the hash of that one: what tells texts apart is text
        x.hash = int(parts[0][1:]) if len(parts) == 1 and parts[0].startswith("\0") else xxhash.xxh64_intdigest("\n".join(parts)) if parts else NOTHING
    return root


NOTHING = 0


def _closed_by(tag: str, stack: list[Node]) -> int:
    """How many open elements a start tag leaves open."""
    if tag in IMPLIED:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in SAME.get(tag, (tag,)):
                return k
            if stack[k].tag in IMPLIED[tag]:
                break
    elif tag in CLOSES_P:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p" or stack[k].tag in HEADINGS and tag in HEADINGS:
                return k
            if stack[k].tag not in INLINE:
                break
    return len(stack)


class _Ends:
    """Where markup ends in a text; what is not found once is not looked for again, so that a page is read in linear time."""

    def __init__(self, text: str):
        self.text, self.none = text, set()

    def find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        found = self.text.find(what, at)
        if found < 0:
            self.none.add(what)
        return found

    def tag(self, at: int) -> int:
        """The position of the > that closes a tag whose attributes begin at `at`, or -1; a > in quotes closes none."""
        closing = self.find(">", at)
        while closing >= 0:
            quote = min((k for k in (self.find('"', at), self.find("'", at)) if k >= 0), default=-1)
            if quote < 0 or quote > closing:
                return closing
            end = self.find(self.text[quote], quote + 1)
            if end < 0:
                return closing
            at = end + 1
            if closing < at:
                closing = self.find(">", at)
        return -1


def parse(text: str) -> Node:
    """The document as a tree; text children are strings with references undecoded."""
    root, ends = Node("#root"), _Ends(text)
    stack, at, n, opened = [root], 0, len(text), Counter()
    while at < n:
        m = OPEN.search(text, at) if ends.find(">", at) >= 0 else None
        if m is None:
            stack[-1].children.append(text[at:])
            break
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        tag = m[2]
        if tag is None:
            at = m.start()
            for start, end in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
                if text.startswith(start, at):
                    to = ends.find(end, at + len(start))
                    if start == "<![CDATA[":
                        stack[-1].children.append(text[at + 9 : to if to >= 0 else n].replace("&", "&amp;"))
                    at = n if to < 0 else to + len(end)
                    break
            continue
        close = ends.tag(m.end())
        if close < 0:
            stack[-1].children.append(text[m.start() :])
            break
        rest, at, tag = text[m.end() : close], close + 1, tag.lower()
        if m[1]:
            if opened[tag]:  # else the tag closes nothing, which is known without a look at all open elements
                k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag)
                opened.subtract(x.tag for x in stack[k:])
                del stack[k:]
            continue
        mark = " ".join(" ".join((a or b or c).split()) for _, a, b, c in ATTR.findall(rest)) if rest.strip() else ""
        node = Node(tag, mark)
        left = _closed_by(tag, stack)
        opened.subtract(x.tag for x in stack[left:])
        del stack[left:]
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(text, at)
            close = ends.find(">", end.end()) if end else -1
            node.children.append(text[at : end.start() if close >= 0 else n])
            at = close + 1 if close >= 0 else n
        elif tag not in VOID and not rest.endswith("/"):
            stack.append(node)
            opened[tag] += 1
    return measure(root)


def content(node: Node, constants: frozenset[int] = frozenset(), inside: bool = False) -> str:
    """Text of a subtree without boilerplate; constant blocks are left out too where they are given."""
    out: list[str] = []
    todo: list = [(node, inside, node.size)]
    while todo:
        x, within, around = todo.pop()
        if isinstance(x, str):
            out.append(entities.unescape(x) if "&" in x else x)
            continue
        if x is not node:
            if x.dropped or x.tag == "header" and not within:
                out.append(" ")
                continue
            if x.marked:
                if x.size <= CONTAINER * around:
                    out.append(" ")
                    continue
                around = x.size
            if constants and x.tag not in INLINE and x.hash in constants:
                continue
        within = within or x.tag in ("article", "main")
        gap = x.tag not in INLINE
        if gap:
            out.append(" ")
            todo.append((" ", within, around))
        todo.extend((c, within, around) for c in reversed(x.children))
    return " ".join("".join(out).split())


def blocks(node: Node) -> list[tuple[str, list[Node]]]:
    """The block children of a node in order: (label, nodes). Equal neighbours, and stretches of siblings with labels that recur, are one."""
    kids = [c for c in node.children if isinstance(c, Node) and c.tag not in INLINE | RAW | VOID]
    times = Counter(c.label for c in kids)
    out: list[tuple[set[str], list[Node]]] = []
    for c in kids:
        often, last = times[c.label] > LONG_RUN, out[-1] if out else (set(), [])
        if out and (often and all(times[x] > LONG_RUN for x in last[0]) or c.tag in ITEMS and last[0] == {c.label}):
            last[0].add(c.label)
            last[1].append(c)
        else:
            out.append(({c.label}, [c]))
    return [("+".join(sorted(labels)), run) for labels, run in out]


@dataclass
class Tree:
    """Nodes in document order: label, parent's number, hash of the text, characters of prose of its own; links and boilerplate have no prose."""

    label: list[str]
    parent: list[int]
    text: list[int]
    prose: list[int]

    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.label]
        for k, p in enumerate(self.parent[1:], 1):
            out[p].append(k)
        return out

    def dump(self) -> str:
        return json.dumps([self.label, self.parent, self.text, self.prose])

    @classmethod
    def load(cls, text: str) -> Tree:
        return cls(*json.loads(text))


def skeleton(root: Node) -> Tree:
    """The tree of blocks."""
    out, todo = Tree([], [], [], []), [("#root", [root], -1)]
    while todo:
        label, run, parent = todo.pop()
        number, prose = len(out.label), sum(x.prose for x in run)
        out.label.append(label)
        out.parent.append(parent)
        out.text.append(run[0].hash if len(run) == 1 else xxhash.xxh64_intdigest("\n".join(str(x.hash) for x in run)))
        out.prose.append(prose)
        todo.extend((name, nodes, number) for name, nodes in reversed(blocks(run[0]) if len(run) == 1 else []))
    whole = list(out.prose)
    for k in range(1, len(out.label)):  # own prose is what children don't have
        out.prose[out.parent[k]] = max(0.0, out.prose[out.parent[k]] - whole[k])
    return out


def layout(tree: Tree) -> int:
    """A hash of the labels of the outer elements, each once, in order: root, document, body and their children."""
    depth = [0] * len(tree.label)
    for k, p in enumerate(tree.parent[1:], 1):
        depth[k] = depth[p] + 1
    return xxhash.xxh64_intdigest("\n".join(dict.fromkeys(f"{d} {x}" for d, x in zip(depth, tree.label) if d <= 3))) - (1 << 63)


def _heaviest(pairs: list[tuple[int, int, int]], n: int) -> list[tuple[int, int]]:
    """Of pairs (place here, place there, weight) those of the heaviest chain that ascends in both.

    Pairs are taken by rows; a Fenwick tree holds the heaviest chain that ends at or before each place there: pairs x log n steps.
    """
    best: list[int] = [-1] * (n + 1)  # numbers of pairs
    total, before = [0] * len(pairs), [-1] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: (pairs[k][0], -pairs[k][1]))  # within a row from the right, so that none follows another
    for k in order:
        _, v, weight = pairs[k]
        at, top = v, -1
        while at > 0:
            if best[at] >= 0 and (top < 0 or total[best[at]] > total[top]):
                top = best[at]
            at -= at & -at
        total[k], before[k] = weight + (total[top] if top >= 0 else 0), top
        at = v + 1
        while at <= n:
            if best[at] < 0 or total[best[at]] < total[k]:
                best[at] = k
            at += at & -at
    k = max(range(len(pairs)), key=total.__getitem__, default=-1)
    out = []
    while k >= 0:
        out.append(pairs[k][:2])
        k = before[k]
    return out[::-1]


def simple_tree_matching(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Node pairs of the largest match of two trees that keeps labels, order and parents.

    Only siblings with equal labels are compared, of which there are few on either side, for what recurs is one node.
    """
    kids_a, kids_b = a.children(), b.children()
    chains: dict[tuple[int, int], list[tuple[int, int]]] = {}
    size: dict[tuple[int, int], int] = {}
    equal: dict[tuple[int, int], list[tuple[int, int]]] = {}
    todo = [(0, 0, False)]
    while todo:  # children first, without recursion: pages may be nested deeply
        i, j, ready = todo.pop()
        p, q = kids_a[i], kids_b[j]
        if not ready:
            places: dict[str, list[int]] = {}
            for v, y in enumerate(q):
                places.setdefault(b.label[y], []).append(v)
            equal[i, j] = [(u, v) for u, x in enumerate(p) for v in places.get(a.label[x], ())]
            todo.append((i, j, True))
            todo.extend((p[u], q[v], False) for u, v in equal[i, j])
            continue
        chains[i, j] = _heaviest([(u, v, size[p[u], q[v]]) for u, v in equal.pop((i, j))], len(q))
        size[i, j] = 1 + sum(size[p[u], q[v]] for u, v in chains[i, j])
    matched, todo = [], [(0, 0)] if a.label[0] == b.label[0] else []
    while todo:
        i, j = todo.pop()
        matched.append((i, j))
        todo.extend((kids_a[i][u], kids_b[j][v]) for u, v in chains[i, j])
    return matched


def induce(reference: Tree, pages: int, met: dict[int, int], same: dict[int, int]) -> str:
    """The wrapper of a group, as JSON: way to the content slot (label, number among equal siblings) and constant texts.

    pages: different pages of the group; met and same: pages on which a node of the reference is found, and with its text.
    """
    kids, n = reference.children(), len(reference.label)
    fixed = [pages >= 3 and met.get(k, 0) >= 2 and met.get(k, 0) == same.get(k, 0) for k in range(n)]
    varying = sum(p for p, f in zip(reference.prose, fixed) if not f)
    if 10 * varying < 3 * sum(reference.prose):  # copies of one page: that they agree says nothing
        fixed = [False] * n
    whole = [0 if f else p for p, f in zip(reference.prose, fixed)]
    for k in range(n - 1, 0, -1):
        whole[reference.parent[k]] += whole[k]
    way, node = [], 0
    while whole[0]:
        inner = [k for k in kids[node] if kids[k] or reference.label[k].split(".")[0] not in ITEMS]
        heaviest = max(inner, key=lambda k: whole[k], default=None)
        if heaviest is None or 10 * whole[heaviest] < 6 * whole[0]:
            break
        way.append([reference.label[heaviest], sum(reference.label[c] == reference.label[heaviest] for c in kids[node] if c < heaviest)])
        node = heaviest
    constant, todo = [], [0]
    while todo:
        k = todo.pop()
        if fixed[k]:
            constant.append(reference.text[k])
        else:
            todo += kids[k]
    return json.dumps({"slot": way, "constant": constant})


def main_text(root: Node, wrapper: str | None) -> str:
    """Main text of one page, by the wrapper of its group."""
    told = json.loads(wrapper) if wrapper else {"slot": [], "constant": []}
    nodes = [root]
    for label, k in told["slot"]:
        kids = [run for name, run in blocks(nodes[0]) if name == label]
        if not kids:
            break
        nodes = kids[min(k, len(kids) - 1)]
    constants = frozenset(told["constant"])
    return " ".join(t for t in (content(x, constants, x.tag in ("article", "main")) for x in nodes) if t)


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _sourced(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of().alias("host")).withColumn("h", F.xxhash64("html"))


def _told(pages: DataFrame, groups: DataFrame, by_page: DataFrame, column: str):
    """pages with `column` of their groups (host, layout), joined by page; or, if these are small, as they are with a broadcast of it."""
    size = groups.agg(F.sum(F.octet_length(column) + F.octet_length("host") + 100)).first()[0] or 0
    if size > BROADCAST_BYTES:
        return pages.join(by_page.join(groups, ["host", "layout"]).select("host", "h", column), ["host", "h"], "left"), None
    found = {(r["host"], r["layout"]): r[column] for r in groups.select("host", "layout", column).collect()}
    return pages.withColumn(column, F.lit(None).cast("string")), pages.sparkSession.sparkContext.broadcast(found)


def wrappers(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """host, layout, wrapper: induced from all pages of each group; and host, h, layout of every different page."""
    sourced = _sourced(pages)

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees = [skeleton(parse(x)) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([layout(t) for t in trees], pa.int64()), pa.array([t.dump() for t in trees], pa.string())], names=["host", "h", "layout", "tree"])

    shaped = settle(sourced.select("host", "h", "html").mapInArrow(shapes, "host string, h long, layout long, tree string"), "shapes")
    by_page = settle(shaped.select("host", "h", "layout").distinct(), "pages-by-layout")
    groups = shaped.groupBy("host", "layout").agg(F.min_by("tree", F.struct("h", "tree")).alias("reference")).join(by_page.groupBy("host", "layout").count(), ["host", "layout"])
    groups = settle(groups.withColumnRenamed("count", "pages"), "references")
    few = groups.where("pages >= 3")
    rows, shared = _told(shaped, few, by_page, "reference")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}
        trees: dict[tuple, tuple[str, Tree]] = {}

        def passed() -> pa.RecordBatch:
            cols = list(zip(*((*k, *v) for k, v in held.items()))) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["host", "layout", "node", "met", "same"])

        for b in batches:
            for host, number, tree, reference in zip(*(b.column(k).to_pylist() for k in range(4))):
                reference = shared.value.get((host, number)) if shared is not None else reference
                if reference is None:
                    continue
                if trees.get((host, number), ("",))[0] != reference:
                    if len(trees) > 1_000:
                        trees.clear()
                    trees[host, number] = (reference, Tree.load(reference))
                a, own = trees[host, number][1], Tree.load(tree)
                for i, j in simple_tree_matching(a, own):
                    count = held.setdefault((host, number, i), [0, 0])
                    count[0] += 1
                    count[1] += a.text[i] == own.text[j]
            if len(held) > HELD_NODES:
                yield passed()
                held.clear()
        yield passed()

    counted = rows.select("host", "layout", "tree", "reference").mapInArrow(align, "host string, layout long, node int, met long, same long").groupBy("host", "layout", "node").agg(F.sum("met").alias("met"), F.sum("same").alias("same"))
    by_group = groups.join(counted.groupBy("host", "layout").agg(F.collect_list(F.struct("node", "met", "same")).alias("nodes")), ["host", "layout"], "left")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for reference, n, nodes in zip(*(b.column(k).to_pylist() for k in (2, 3, 4))):
                nodes = nodes or []
                out.append(induce(Tree.load(reference), n, {x["node"]: x["met"] for x in nodes}, {x["node"]: x["same"] for x in nodes}))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["host", "layout", "wrapper"])

    learned = by_group.select("host", "layout", "reference", "pages", "nodes").mapInArrow(learn, "host string, layout long, wrapper string")
    return settle(learned, "wrappers"), by_page


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    bound_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    learned, by_page = wrappers(pages)
    rows, shared = _told(_sourced(pages), learned, by_page, "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = []
            for page, host, wrapper in zip(*(b.column(k).to_pylist() for k in (2, 3, 4))):
                root = parse(page)
                text.append(main_text(root, shared.value.get((host, layout(skeleton(root)))) if shared is not None else wrapper))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "host", "wrapper").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
