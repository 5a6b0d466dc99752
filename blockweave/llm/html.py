"""Main text of web pages by wrapper induction.

Pages of one host are aligned in small groups. The wrapper begins as the first
page's tree; each further page is matched to it by simple tree matching and adds
the nodes that it has besides. A wrapper node whose own text is the same on all
pages of a group is template; one whose text varies is a content slot.

The content root is the smallest subtree that holds most of the text in varying
slots. An article landmark takes its place if it holds most of that text, or
where nothing varies because a page stands alone. Inside, blocks that are the same on
all pages of a group with several articles are left out, and so are menus,
headers, footers, sidebars, notices, adverts, forms, scripts and comments, by
their elements and by the names in their class, id or role.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import materialize, released, small, stage_dir
from .urls import host_of

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S)
LABELS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I | re.S)
#: Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIP = frozenset("head nav footer aside form script style noscript template iframe button select option textarea svg canvas object dialog menu title".split())
CLOSES_P = BLOCK - {"body", "html"}
#: Words of class, id and role names that mark what is not the article.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar menu navbar nav navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice alert comment comments discussion disqus reply replies share sharing social newsletter subscribe subscription signup login search popup modal related recommended footer masthead copyright pager pagination toolbar widget skip contentinfo complementary".split())
#: So many different articles in a group show that a block on all its pages belongs to none of them.
ARTICLES = 4


class Node:
    """An element of a page. slot is the wrapper's node that it is matched with."""

    __slots__ = ("tag", "labels", "kids", "up", "shape", "size", "slot", "mass")

    def __init__(self, tag: str, labels: frozenset = frozenset(), up: Node | None = None):
        self.tag, self.labels, self.up = tag, labels, up
        self.kids: list = []
        self.shape = self.slot = None
        self.size = self.mass = 0

    def elements(self) -> list[Node]:
        return [k for k in self.kids if k.__class__ is Node]


class Slot:
    """A node of the wrapper: its children in order, the texts it had, and the pages (by name) that it stands on."""

    __slots__ = ("tag", "kids", "texts", "pages", "shape", "size")

    def __init__(self, tag: str):
        self.tag = tag
        self.kids: list[Slot] = []
        self.texts: set = set()
        self.pages: set = set()
        self.shape, self.size = None, 0

    def elements(self) -> list[Slot]:
        return self.kids


def words_in(attributes: str) -> frozenset:
    found = LABELS.findall(attributes) if attributes and not attributes.isspace() else ()
    return frozenset(w for a, b, c in found for w in re.split(r"[^a-z]+", (a or b or c).lower()) if w)


def parse(page: str) -> list[Node]:
    """The nodes of the page's tree in page order, the root first. Missing end tags are implied; nesting may be of any depth."""
    root = Node("#root")
    nodes, stack, at = [root], [root], 0
    open_: dict[str, int] = {}
    lower = None

    def shut(i: int) -> None:
        for n in stack[i:]:
            open_[n.tag] -= 1
        del stack[i:]

    while True:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            stack[-1].kids.append(entities.unescape(text))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            # an end tag of nothing that is open needs no search of the stack
            for i in range(len(stack) - 1, 0, -1) if open_.get(tag) else ():
                if stack[i].tag == tag:
                    shut(i)
                    break
                if stack[i].tag in ("article", "body", "html") and tag not in BLOCK:
                    break
            continue
        if tag in CLOSES_P:
            closes = {"p"} | ({"li"} if tag == "li" else {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {"tr", "td", "th"} if tag == "tr" else set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    shut(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        attributes = m[3] or m[6] or ""
        node = Node(tag, words_in(attributes), stack[-1])
        stack[-1].kids.append(node)
        nodes.append(node)
        if tag in RAW:
            lower = lower or page.lower()
            end = lower.find(f"</{tag}", at) if len(lower) == len(page) else page.find(f"</{tag}", at)
            at = len(page) if end < 0 else end
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            open_[tag] = open_.get(tag, 0) + 1
    return nodes


def shapes(nodes: list) -> None:
    """Gives each node a hash of the element names of its subtree, and its size. Parents stand before children."""
    for n in reversed(nodes):
        kids = n.elements()
        n.shape, n.size = hash((n.tag, *[k.shape for k in kids])), 1 + sum(k.size for k in kids)


def in_order(root: Slot) -> list[Slot]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += reversed(n.kids)
    return out


def own_text(node: Node) -> str:
    return " ".join(" ".join(k for k in node.kids if k.__class__ is str).split())


class Matcher:
    """Simple tree matching: the most node pairs that keep order and ancestry.

    What two subtrees have in common depends on their shapes alone, so each
    pair of shapes is worked out once, children first, without recursion.
    """

    def __init__(self):
        #: (shape, shape) -> (score, matched child numbers)
        self.known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def _table(self, a, b) -> list | None:
        """Works out a pair, or gives the pairs of children that must come first."""
        xs, ys = a.elements(), b.elements()
        if a.shape == b.shape:
            self.known[a.shape, b.shape] = a.size, [(i, i) for i in range(len(xs))]
            return None
        # children of one shape at both ends are paired directly, which is optimal
        low, top = 0, min(len(xs), len(ys))
        while low < top and xs[low].shape == ys[low].shape:
            low += 1
        tail = 0
        while tail < top - low and xs[-1 - tail].shape == ys[-1 - tail].shape:
            tail += 1
        inner, outer = xs[low : len(xs) - tail], ys[low : len(ys) - tail]
        by_tag: dict[str, list[int]] = {}
        for j, y in enumerate(outer):
            by_tag.setdefault(y.tag, []).append(j)
        missing = {(x.shape, outer[j].shape): (x, outer[j]) for x in inner for j in by_tag.get(x.tag, ()) if (x.shape, outer[j].shape) not in self.known}
        if missing:
            return list(missing.values())
        best = [[0] * (len(outer) + 1)]
        for x in inner:
            last, row = best[-1], [0]
            scores = {j: self.known[x.shape, outer[j].shape][0] for j in by_tag.get(x.tag, ())}
            for j in range(len(outer)):
                row.append(max(last[j + 1], row[j], last[j] + scores.get(j, 0)))
            best.append(row)
        middle, i, j = [], len(inner), len(outer)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                middle.append((low + i, low + j))
        score = 1 + best[-1][-1] + sum(x.size for x in xs[:low]) + sum(x.size for x in xs[len(xs) - tail :])
        ends = [(len(xs) - k, len(ys) - k) for k in range(tail, 0, -1)]
        self.known[a.shape, b.shape] = score, [(k, k) for k in range(low)] + middle[::-1] + ends
        return None

    def children(self, a, b) -> list[tuple[int, int]]:
        """The matched children of two nodes, by number."""
        return self._of(a, b)[1]

    def score(self, a, b) -> int:
        return self._of(a, b)[0]

    def _of(self, a, b) -> tuple[int, list[tuple[int, int]]]:
        stack = [(a, b)]
        while stack:
            x, y = stack[-1]
            if (x.shape, y.shape) in self.known:
                stack.pop()
                continue
            first = self._table(x, y)
            if first is None:
                stack.pop()
            else:
                stack += first
        return self.known[a.shape, b.shape]


def added(node: Node, name: int) -> Slot:
    """A new part of the wrapper for a subtree that it lacks."""
    root = Slot(node.tag)
    stack = [(node, root)]
    while stack:
        n, slot = stack.pop()
        n.slot = slot
        slot.texts.add(own_text(n))
        slot.pages.add(name)
        for k in n.elements():
            own = Slot(k.tag)
            slot.kids.append(own)
            stack.append((k, own))
    return root


def induce(trees: list[list[Node]], names: list[int]) -> None:
    """Merges the trees, as lists of nodes, into one wrapper; all nodes get their slots."""
    for nodes in trees:
        shapes(nodes)
    wrapper = added(trees[0][0], names[0])
    for nodes, name in zip(trees[1:], names[1:]):
        shapes(in_order(wrapper))
        matcher, stack = Matcher(), [(wrapper, nodes[0])]
        while stack:
            slot, node = stack.pop()
            node.slot = slot
            slot.texts.add(own_text(node))
            slot.pages.add(name)
            kids, pairs = node.elements(), matcher.children(slot, node)
            stack += [(slot.kids[i], kids[j]) for i, j in pairs]
            # what the page has besides goes behind the slot of its neighbour
            partner = {j: i for i, j in pairs}
            new: dict[int, list[Slot]] = {}
            after = -1
            for j, kid in enumerate(kids):
                if j in partner:
                    after = partner[j]
                else:
                    new.setdefault(after, []).append(added(kid, name))
            if new:
                slot.kids = [x for i in range(-1, len(slot.kids)) for x in (*slot.kids[max(i, 0) : i + 1], *new.get(i, ()))]


def boilerplate(node: Node, inside: bool) -> bool:
    return node.tag in SKIP or (node.tag == "header" and not inside) or not node.labels.isdisjoint(MARKS)


def template(node: Node, pages: int) -> bool:
    """The node stands on all distinct pages of its group with the same text."""
    return pages > 1 and node.slot is not None and len(node.slot.texts) == 1 and len(node.slot.pages) == pages


def weigh(nodes: list[Node], pages: int) -> None:
    """Gives each node the length of the text in content slots below it."""
    for n in reversed(nodes):
        if boilerplate(n, False):
            n.mass = 0
        else:
            n.mass = (0 if template(n, pages) else len(own_text(n))) + sum(k.mass for k in n.elements())


def landmarks(nodes: list[Node], names: tuple[str, ...]) -> list[Node]:
    """The outermost landmarks of these names that do not stand in boilerplate."""
    out, closed = [], set()
    for n in nodes[1:]:
        if id(n.up) in closed or boilerplate(n, False):
            closed.add(id(n))
        elif n.tag in names or (names[0] == "main" and "main" in n.labels):
            out.append(n)
            closed.add(id(n))
    return out


def content_roots(nodes: list[Node], pages: int) -> tuple[list[Node], bool]:
    """The subtrees that hold the article, and whether landmarks name them."""
    weigh(nodes, pages)
    at = nodes[0]
    total = at.mass
    for names in (("article",), ("main",)):
        found = landmarks(nodes, names)
        # varying text decides: a landmark without most of it is not where the article is
        if found and 2 * sum(n.mass for n in found) >= total:
            return found, True
    while total:
        best = max(at.elements(), key=lambda k: k.mass, default=None)
        if best is None or best.tag not in BLOCK or 5 * best.mass < 4 * total or best.tag in ("p", "li", "td"):
            break
        at = best
    return [at], False


def constants(nodes: list[Node], pages: int) -> set[int]:
    """Nodes in whose subtrees nothing varies between the pages of the group."""
    out: set[int] = set()
    for n in reversed(nodes):
        if template(n, pages) and all(id(k) in out for k in n.elements()):
            out.add(id(n))
    return out


def blocks(root: Node, pages: int, marked: bool, out: list[list[str]], left_out: set[int]) -> None:
    """Collects the text of the blocks in page order; out[-1] is the open one. Blocks in left_out are."""
    stack: list = [root]
    while stack:
        k = stack.pop()
        if k is None:
            out.append([])
        elif k.__class__ is str:
            out[-1].append(k)
        elif k.tag == "br":
            out[-1].append(" ")
        elif k is root or not boilerplate(k, marked) and (k.tag not in BLOCK or id(k) not in left_out):
            drop_own = not marked and template(k, pages)
            if k.tag in BLOCK and k is not root:
                out.append([])
                stack.append(None)
            stack += [x for x in reversed(k.kids) if not (drop_own and x.__class__ is str)]


def text_of(nodes: list[Node], pages: int, notices: bool) -> str:
    roots, marked = content_roots(nodes, pages)
    left_out = set() if notices or not marked else constants(nodes, pages)
    out: list[list[str]] = [[]]
    for root in roots:
        out.append([])
        blocks(root, pages, marked, out, left_out)
    return "\n".join(t for t in (" ".join("".join(b).split()) for b in out) if t)


def texts_of(group: list[str]) -> list[str]:
    """The main text of each page of one host."""
    distinct = list(dict.fromkeys(group))
    trees = [parse(p) for p in distinct]
    if len(distinct) > 1:
        induce(trees, list(range(len(distinct))))
    without = [text_of(t, len(distinct), False) for t in trees]
    # fewer articles than that may be copies of one another, whose equal blocks must stay
    if len({t for t in without if t}) < ARTICLES:
        without = [text_of(t, len(distinct), True) for t in trees]
    found = dict(zip(distinct, without))
    return [found[p] for p in group]


def main_text(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", group_size: int = 16) -> DataFrame:
    """id_col, url_col, text and n_chars for every row of pages.

    The pages of a host are dealt into as many groups as it has times
    group_size pages, by a hash of url, id and page, and each group is aligned
    in one task. So a host with very many pages is spread over tasks, and which
    pages meet depends on neither partitions nor order. A group holds its
    different pages at a time; the memory for a page is in proportion to it, and
    its nesting may be of any depth. A host with one page, or whose pages are
    all the same, has no varying slots: there only landmarks and names decide.
    Null and empty html give an empty text; null urls form one host; repeated
    rows are each extracted; other columns are ignored; an empty table gives no
    rows.
    """
    spark, host = pages.sparkSession, host_of(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col), F.col(url_col).cast("string").alias(url_col), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("bw_html"), host.alias("bw_host"))
    hosts = pages.select(host.alias("h")).groupBy("h").agg(F.ceil(F.count(F.lit(1)) / F.lit(group_size)).alias("k"))
    hosts = materialize(spark, hosts.where("k > 1"), stage_dir(spark), "hosts")
    rows = rows.join(small(hosts, 200), F.col("bw_host").eqNullSafe(F.col("h")), "left")
    rows = rows.withColumn("bw_h", F.xxhash64(url_col, id_col, "bw_html")).withColumn("bw_group", F.pmod("bw_h", F.coalesce("k", F.lit(1)))).drop("h", "k")
    schema = StructType([StructField(id_col, pages.schema[id_col].dataType), StructField(url_col, StringType()), StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        ids, urls, group, last = [], [], [], None
        seen: dict[str, str] = {}

        def flush():
            texts = texts_of(group)
            out = pa.RecordBatch.from_arrays([pa.concat_arrays(ids).cast(target[0].type), pa.array(urls, pa.string()).cast(target[1].type), pa.array(texts, pa.string()).cast(target[2].type), pa.array([len(t) for t in texts], pa.int64())], schema=target)
            ids.clear(), urls.clear(), group.clear(), seen.clear()
            return out

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (1, 2, 3, 4)]
            for i, (url, page, *own) in enumerate(zip(*columns)):
                if own != last and group:
                    yield flush()
                last = own
                ids.append(batch.column(0).slice(i, 1))
                urls.append(url)
                group.append(seen.setdefault(page, page))
        if group:
            yield flush()

    rows = rows.select(id_col, url_col, "bw_html", "bw_host", "bw_group", "bw_h")
    return rows.repartition("bw_host", "bw_group").sortWithinPartitions("bw_host", "bw_group", "bw_h").mapInArrow(released(run), schema)
