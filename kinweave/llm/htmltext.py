"""Main text of web pages with the help of a style tree for each site.

The DOMs of a host's pages are merged: a node of the tree stands for all
elements with the same chain of tags, class names, id and role (digits left
out, so the tree's size follows the site's design and not its number of
pages). Every element and every block of text is counted. For each node

* presentation importance is the entropy of its child sequences over its
  instances, runs of equal children taken as one, to the base of the instances;
* content importance of a node that holds text is one minus the mean, over its
  distinct blocks of text, of log_m(instances with that block), m being the
  instances; it is drawn towards that of the same node over all sites, which
  counts as ``KIN`` instances, so that small sites lean on the others;
* composite importance is (1 - g^l) * presentation + g^l * children, with l
  child sequences, g = 0.9 and children the mean, by instances, of the node's
  own content and of its child nodes that have text in them; of a node that
  never has child elements it is the content importance.

What an element calls itself is a prior: a node's log odds are those of its
importance against ``THRESHOLD``, plus ``IN_MAIN`` inside an ``article`` or
``main`` element, less ``NAMED`` if its tag, role, class or id (or those of an
element around it) say that it is a menu, header, footer, sidebar, advert,
notice, comment or the like. ``NAMED`` is out of the tree's reach: readers'
comments and sidebars differ from page to page just as articles do, which
entropy can't tell. A node of at least ``LEAST`` instances loses its branch if
its log odds and those of all nodes below it are negative; nodes of fewer
instances go by the prior alone. If the tree alone would take more of a page
than it leaves, the page's unnamed branches stay, so that neither copies of a
page nor single ones lose their text. Equal pages of a host count once.

Forms, scripts, styles and elements that are not shown never count as text. If
a page has an ``article`` (or else ``main``) element with text, its text is
that element's. Classes and ids never put ``html`` or ``body`` aside, nor do
names that speak of the layout (``has-sidebar``); an ``article`` or ``main``
element inside an element that its class or id puts aside is read if the page
has no other and it holds more text than what stands outside.

Both passes read whole pages, one page at a time. A node with one instance
only is counted with its parent and not by itself, so names made up at random
do not make a tree large. Defined results: null or empty html, or a page
without main text, gives the empty text with 0 characters; a null or odd url
belongs to the host of that text; broken markup is read leniently (an unclosed
comment or script reaches to the end); repeated rows give repeated results;
only the named columns are read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.storage import materialize
from kinweave.llm.textbytes import tidy

GAMMA, THRESHOLD, LEAST, KIN = 0.9, 0.7, 8, 256
IN_MAIN, NAMED = 1.5, 6.0
#: Up to so many judged nodes in all (24 bytes each) their table is broadcast; beyond it is joined by host and one of ``SALTS``.
SMALL_NODES, SALTS = 200_000, 16

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|iframe|select)\b[^>]*>.*?(?:</\1\b[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "head", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot"}
PLAIN_SIBLING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
FORM_TAGS = frozenset("form head button fieldset label".split())
ASIDE_TAGS = frozenset("nav footer aside menu dialog".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status".split())
#: Names of what stands beside an article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside rail widget cookie cookies consent gdpr notice notices alert popup modal overlay subscribe subscription newsletter signup login paywall share sharing social related recommended comment comments disqus respond replies pagination pager toolbar search copyright".split()
)
HEADER_WORDS = frozenset(("header", "topbar"))
MAIN_WORDS = frozenset("article entry post content story main".split())
MAIN_TAGS = frozenset(("article", "main"))
#: First words of names that say what a page has or how it is laid out, not what the element is.
LAYOUT_WORDS = frozenset("has have no not without with layout is hide show".split())
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


#: The mark of the empty child sequence.
NO_CHILD = xxhash.xxh64_intdigest("") >> 1
#: What an element calls itself.
PLAIN, ASIDE, FORM = range(3)


class Node:
    __slots__ = ("block", "by_tree", "children", "firm", "inside", "main", "parent", "path", "state", "tag")

    def __init__(self, tag: str, path: int, up: Node | None, state: int, main: str, by_tree: bool = False, firm: bool = False):
        self.tag, self.path, self.state, self.main, self.by_tree, self.firm = tag, path, state, main, by_tree, firm
        self.parent, self.inside = (up.path, bool(up.main)) if up else (0, False)
        self.block = self if tag in BLOCK else up.block if up else None
        self.children: list[str] = []


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def _unseen(tag: str, at: dict[str, str]) -> bool:
    """Forms and elements that are not shown: no part of any text, whatever the tree says."""
    if tag in FORM_TAGS:
        return True
    if not at:
        return False
    if "hidden" in at or at.get("aria-hidden", "").lower() == "true":
        return True
    return "none" in at.get("style", "") and bool(re.search(r"display\s*:\s*none", at["style"]))


def _prior(tag: str, at: dict[str, str], in_main: bool) -> tuple[int, bool]:
    """What an element calls itself, and whether it is its tag or role that says so."""
    if tag in ASIDE_TAGS or tag == "header" and not in_main or at and at.get("role", "").lower() in ASIDE_ROLES:
        return ASIDE, True
    if not at or tag in ("html", "body"):
        return PLAIN, False
    words: set[str] = set()
    for name in f"{at.get('class', '')} {at.get('id', '')}".split():
        parts = [w.lower() for w in re.split(r"[\W_]+", CAMEL.sub(" ", name))]
        if parts[0] not in LAYOUT_WORDS:
            words.update(parts)
    if words & MAIN_WORDS and not words & {"comment", "comments", "related", "sidebar", "ad", "ads"}:
        return PLAIN, False
    return (ASIDE if words & ASIDE_WORDS or not in_main and words & HEADER_WORDS else PLAIN), False


class Parser:
    """Reads a page into blocks of text, each with the nodes that it stands in; node numbers are remembered over pages."""

    def __init__(self) -> None:
        self.ids: dict[tuple[int, str], int] = {}

    def _id(self, parent: int, key: str) -> int:
        found = self.ids.get((parent, key))
        if found is None:
            if len(self.ids) > 100_000:
                self.ids.clear()
            found = self.ids[parent, key] = xxhash.xxh64_intdigest(key, parent) >> 1
        return found

    def blocks(self, page: str, removed: frozenset[int] = frozenset(), stats: Counter | None = None) -> list[tuple[str, str, bool]]:
        """(kind of main element around it, after ~ if a name puts it aside, or '', block, whether the tree alone removes it) of every block that its names do not remove, in page order.

        With ``stats``, also counts (path, parent, prior, 0, child sequence) of
        each element and (path, parent, prior, 1, block) of each block, forms
        and the like left out. The prior is what the element or one around it
        calls itself, and -1 less that inside a main element.
        """
        root = Node("#", 1, None, PLAIN, "")
        stack = [root]
        out: list[tuple[str, str, bool]] = []
        parts: list[str] = []
        holder = root

        def prior_of(node: Node) -> int:
            return -1 - node.state if node.inside else node.state

        def flush() -> None:
            if parts:
                text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
                parts.clear()
                if text:
                    if stats is not None:
                        stats[holder.path, holder.parent, prior_of(holder), 1, xxhash.xxh64_intdigest(text) >> 1] += 1
                    if not holder.state:
                        out.append((holder.main, text, holder.by_tree))

        def pop() -> None:
            node = stack.pop()
            if stats is not None and node.state != FORM:
                stats[node.path, node.parent, prior_of(node), 0, xxhash.xxh64_intdigest(" ".join(node.children)) >> 1] += 1

        def add_text(a: int, b: int) -> None:
            nonlocal holder
            top = stack[-1]
            block = top.block or top
            # An inline element put aside is no part of its block.
            if b > a and top.state == block.state and (not top.state or stats is not None and top.state != FORM):
                if not parts:
                    if page[a:b].isspace():
                        return
                    holder = block
                parts.append(page[a:b])

        end = 0
        for m in TOKEN.finditer(page):
            add_text(end, m.start())
            end = m.end()
            tag = m[3] or m[6]
            if not tag:
                continue
            tag = tag.lower()
            if m[2] or m[5]:
                if tag in BLOCK:
                    flush()
                if tag == "p" and all(x.tag != "p" for x in stack):
                    continue
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i].tag in ("td", "th", "table") and tag not in BLOCK:
                        break  # an inline end tag doesn't close a cell
                continue
            if tag == "br":
                if parts:
                    parts.append(" ")
                continue
            if tag in BLOCK:
                flush()
            if tag in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i].tag in BLOCK:
                        break
            elif tag in PLAIN_SIBLING:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag or tag in ("td", "th") and stack[i].tag in ("td", "th") or tag in ("dt", "dd") and stack[i].tag in ("dt", "dd"):
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i].tag in PLAIN_SIBLING[tag]:
                        break
            raw = m[4] if m[3] else m[7]
            at = _attributes(raw) if raw and not raw.isspace() else {}
            up = stack[-1]
            key = tag
            if at:
                key += "".join(mark + ".".join(sorted({DIGITS.sub("", c) for c in at[name].split()})) for name, mark in (("class", "."), ("id", "#"), ("role", "@")) if name in at)
            if not up.children or up.children[-1] != key:
                up.children.append(key)
            if tag in VOID:
                continue
            path = self._id(up.path, key)
            main = tag if tag in MAIN_TAGS and up.main not in ("article", "~article") else up.main
            state, firm = _prior(tag, at, bool(up.main))
            firm = firm or up.firm
            if up.state == FORM or _unseen(tag, at):
                state = FORM
            if up.state and state != FORM:
                if not state and tag in MAIN_TAGS and not up.main and not firm:
                    main = "~" + tag
                else:
                    state = max(state, up.state)
            by_tree = up.by_tree or path in removed
            stack.append(Node(tag, path, up, state, main, by_tree, firm))
            if (m[4] or m[7] or "").rstrip().endswith("/") and tag not in BLOCK:
                pop()
        add_text(end, len(page))
        flush()
        while len(stack) > 1:
            pop()
        return out

    def text(self, page: str | None, removed: frozenset[int] = frozenset()) -> str:
        if not page:
            return ""
        found = self.blocks(page, removed)
        if sum(len(t) for _, t, low in found if low) <= sum(len(t) for _, t, low in found if not low):
            found = [x for x in found if not x[2]]
        size: Counter = Counter()
        for k, t, _ in found:
            size[k] += len(t)
        best = next((k for k in ("article", "main") if k in size), None) or max(("~article", "~main", ""), key=size.__getitem__)
        return "\n".join(t for k, t, _ in found if k == best)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@]*@)?([^/?#:]*)", 1)), F.lit(""))


def log_odds(importance: float, prior: int) -> float:
    """Of a node's being part of the article; ``prior`` as Parser counts it."""
    x = min(max(importance, 0.01), 0.99)
    named = prior if prior >= 0 else -1 - prior
    return math.log(x / (1 - x)) - math.log(THRESHOLD / (1 - THRESHOLD)) + (IN_MAIN if prior < 0 else 0.0) - NAMED * (named == ASIDE)


def composite(rows: list[tuple]) -> list[tuple[int, int, int, float, float, float]]:
    """(path, prior, instances, importance, log odds, largest log odds of it and the nodes below) of the nodes of one tree.

    rows: (path, parent, prior, instances, sum of n ln n over child sequences,
    child sequences, those that are not empty, instances of blocks, content
    importance); path 0 stands for a parent's single nodes.
    """
    own = {r[0]: r for r in rows if r[0]}
    below: dict[int, list[int]] = {}
    inner: dict[int, list[tuple[float, int]]] = {}
    for path, parent, _, m, _, _, _, block_m, _ in rows:
        if path:
            below.setdefault(parent, []).append(path)
        elif block_m:
            inner.setdefault(parent, []).append((1.0, m))
    order, todo, started = [], [p for p, r in own.items() if r[1] not in own], set()
    while todo:
        p = todo.pop()
        if p not in started:
            started.add(p)
            order.append(p)
            todo += below.get(p, [])
    out = []
    peak: dict[int, float] = {}
    for p in reversed(order):
        _, parent, prior, m, nlogn, styles, with_children, block_m, content = own[p]
        m = m or 1  # an element still open at the end of a page
        shape = 1.0 if m <= 1 else max(0.0, (math.log(m) - nlogn / m) / math.log(m))
        parts = inner.get(p, []) + ([(content, block_m)] if block_m else [])
        if not parts:  # no text in it: nothing to remove, nothing to tell its parent
            out.append((p, prior, m, 1.0, 0.0, 0.0))
            continue
        rest = sum(v * w for v, w in parts) / sum(w for _, w in parts)
        g = GAMMA ** styles if with_children else 1.0
        value = (1 - g) * shape + g * rest
        inner.setdefault(parent, []).append((value, m))
        odds = log_odds(value, prior)
        peak[p] = max(odds, peak.get(p, odds))
        if m >= LEAST:
            peak[parent] = max(peak[p], peak.get(parent, peak[p]))
        out.append((p, prior, m, value, odds, peak[p]))
    return out


def style_tree(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, prior, instances, importance, odds and peak (see composite) of every node of every site's tree that has two instances or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                stats: dict[str, Counter] = {}
                for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if page:
                        parser.blocks(page, stats=stats.setdefault(host, Counter()))
                rows = [(h, *k, n) for h, c in stats.items() for k, n in c.items()]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["host", "path", "parent", "prior", "kind", "mark", "n"])

    # Copies of a page would make its paragraphs look like boilerplate.
    seen = pages.select(host_of(F.col(url_col)).alias("host"), html_col).distinct().mapInArrow(tidy(count), "host string, path long, parent long, prior int, kind int, mark long, n long")
    marks = materialize(seen.groupBy("host", "path", "parent", "prior", "kind", "mark").agg(F.sum("n").alias("n")), "style-marks")
    style, block = F.col("kind") == 0, F.col("kind") == 1
    content = lambda m, mean_log: F.when(m > 1, 1 - mean_log / F.log(m)).otherwise(1.0)
    nodes = marks.groupBy("host", "path", "parent", "prior").agg(
        F.coalesce(F.sum(F.when(style, F.col("n"))), F.lit(0)).alias("m"),
        F.coalesce(F.sum(F.when(style, F.col("n") * F.log("n"))), F.lit(0.0)).alias("nlogn"),
        F.count(F.when(style, 1)).alias("styles"),
        F.count(F.when(style & (F.col("mark") != NO_CHILD), 1)).alias("with_children"),
        F.coalesce(F.sum(F.when(block, F.col("n"))), F.lit(0)).alias("block_m"),
        F.avg(F.when(block, F.log("n"))).alias("block_log"),
    )
    # The same node over all sites: one row a block first, so that a block of a million pages is one number.
    everywhere = marks.where(block).groupBy("path", "mark").agg(F.sum("n").alias("n")).groupBy("path").agg(F.sum("n").alias("all_m"), F.avg(F.log("n")).alias("all_log"))
    everywhere = materialize(everywhere, "style-blocks")
    kin = F.least(F.col("all_m") - F.col("block_m"), F.lit(KIN))
    both = (F.col("block_m") * content(F.col("block_m"), F.col("block_log")) + kin * content(F.col("all_m"), F.col("all_log"))) / (F.col("block_m") + kin)
    nodes = nodes.join(everywhere, "path", "left").withColumn("content", F.coalesce(both, F.lit(1.0))).drop("block_log", "all_m", "all_log")
    nodes = materialize(nodes, "style-nodes")
    often = nodes.where("greatest(m, block_m) > 1")
    # Nodes with one instance stay as a number of their parent's.
    once = nodes.where("greatest(m, block_m) = 1").groupBy("host", "parent").agg(F.count(F.lit(1)).alias("m"), F.max("block_m").alias("block_m"))
    once = once.join(often.select("host", F.col("path").alias("parent")), ["host", "parent"], "left_semi")
    tree = often.unionByName(once.select("host", F.lit(0).cast("long").alias("path"), "parent", F.lit(0).alias("prior"), "m", F.lit(0.0).alias("nlogn"), F.lit(1).cast("long").alias("styles"), F.lit(0).cast("long").alias("with_children"), "block_m", F.lit(1.0).alias("content")))

    def assemble(table: pa.Table) -> pa.Table:
        """A group is one site's tree, bounded by its design."""
        got = composite(list(zip(*(table.column(c).to_pylist() for c in ("path", "parent", "prior", "m", "nlogn", "styles", "with_children", "block_m", "content")), strict=True)))
        cols = list(zip(*got, strict=True)) if got else [[]] * 6
        host = pa.array([table.column("host")[0].as_py()] * len(got), pa.string())
        return pa.table([host, *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True))], names=["host", "path", "prior", "instances", "importance", "odds", "peak"])

    return tree.groupBy("host").applyInArrow(assemble, "host string, path long, prior int, instances long, importance double, odds double, peak double")


def judged(tree: DataFrame) -> DataFrame:
    """host and the unnamed nodes that the tree removes (nothing in them is worth more; named ones need no list)."""
    low = (F.col("instances") >= LEAST) & F.col("prior").isin(PLAIN, -1 - PLAIN) & (F.col("peak") < 0)
    return tree.where(low).groupBy("host").agg(F.collect_set("path").alias("removed"))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""
    found = materialize(judged(style_tree(pages, url_col=url_col, html_col=html_col)), "style-judged")
    few = (found.agg(F.sum(F.size("removed"))).first()[0] or 0) <= SMALL_NODES
    slim = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("link"), F.col(html_col).alias("markup"), host_of(F.col(url_col)).alias("host"))
    if few:
        joined = slim.join(F.broadcast(found), "host", "left")
    else:
        # A host may hold a third of all pages: they are dealt out, and its nodes go to each part.
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = slim.withColumn("salt", F.pmod(F.xxhash64("page", "markup"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    joined = joined.select("page", "link", "markup", "removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        sets: dict[tuple[int, ...], frozenset[int]] = {}

        def as_set(x: list[int] | None) -> frozenset[int]:
            key = tuple(x or ())
            if key not in sets:
                sets.clear() if len(sets) > 1000 else None
                sets[key] = frozenset(key)
            return sets[key]

        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = [parser.text(page, as_set(x)) for page, x in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kind = joined.schema["page"].dataType.simpleString()
    return joined.mapInArrow(tidy(run), f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
