"""Approximate nearest neighbours: an NN-descent graph built by Spark joins, searched greedily.

Equal vectors are one node of the graph, named by their smallest id, so a
vector of many copies costs no more than one.

Building. A first graph comes from ``SORTS`` orders of the nodes by signs of
random projections: neighbours in such an order share many signs, and each
block of ``BLOCK`` nodes gives its nodes their best ``K`` of the block. Then
rounds of NN-descent follow until under ``DELTA`` of the edges are new: each node is joined to the nodes that list it
or that it lists, so that all neighbours of a centre meet there and every pair
with a new edge is scored; a pair becomes an edge if it beats the worst edge
of one of its ends, and the lists are joined with what was found. At a centre
stand at most 2 K nodes (of the nodes that list it, the K closest), so no hub
gathers more.

Searching. Queries are nodes of the graph. A search holds a pool of the best
nodes seen; in each step the ``WIDTH`` best ones not yet opened are joined to
their lists of ids, and the ids not in the pool yet, once for each query, to
their vectors; the query's vector goes there, and the scores go back. No row
holds more than two vectors while searching. Pools and lists are bounded by parameters and
don't grow with the data.

Scores while building and searching use unit vectors in single precision (8
bits cannot order near copies); the whole pool is scored again by
double-precision cosines of the original vectors.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and rows with null ids, take no part; nor do vectors of another
length than the most common (ties: the longer). Rows with the query's id are
its own. Fewer candidates than k: all that are found. Equal cosines: smaller
id first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.storage import materialize
from kinweave.llm.topk import matrix, usable, usual_length

K, SORTS, BLOCK, DELTA = 32, 4, 512, 0.001
WIDTH, STEPS, POOL = 64, 5, 400


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision."""
    x = x / np.abs(x).max(1)[:, None]
    return (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)


def _bytes(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a binary column of equal lengths as single-precision vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _binary(q: np.ndarray) -> pa.Array:
    n, dim = q.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * dim * q.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(q))])


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def _prepare(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    planes = np.random.default_rng(17).normal(size=(SORTS, dim, 62))
    for batch in batches:
        x = matrix(batch.column(1), dim)
        bits = [((x @ p > 0) @ (1 << np.arange(61, -1, -1, dtype=np.int64))).astype(np.int64) for p in planes]
        codes = np.stack(bits, 1)
        yield pa.record_batch([batch.column(0), _binary(unit(x)), _lists(codes.ravel(), np.full(len(x), SORTS), pa.int64())], names=["node", "q", "codes"])


def top_lists(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of edges, the k best distinct b of each a: a, b, s in order of a and falling s."""
    o = np.lexsort((-s, b, a))
    a, b, s = a[o], b[o], s[o]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, s = a[keep], b[keep], s[keep]
    o = np.lexsort((b, -s, a))
    a, b, s = a[o], b[o], s[o]
    head = np.flatnonzero(np.diff(a, prepend=a[0] - 1 if len(a) else 0))
    rank = np.arange(len(a)) - np.repeat(head, np.diff(np.append(head, len(a))))
    return a[rank < k], b[rank < k], s[rank < k]


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Best K of each node within its block of the order."""
    for batch in batches:
        n = batch.num_rows
        for a in range(0, n, BLOCK):
            lo = max(0, min(a, n - BLOCK))
            part = batch.slice(lo, BLOCK)
            node, x = part.column(0).to_numpy(), _bytes(part.column(1), dim)
            s = x @ x.T
            np.fill_diagonal(s, -9)
            k = min(K, len(node) - 1)
            if k < 1:
                continue
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            mine = np.arange(a - lo, min(len(node), a - lo + BLOCK))
            yield pa.record_batch([pa.array(node[mine]), _lists(node[top[mine]].ravel(), np.full(len(mine), k), pa.int64()), _lists(np.take_along_axis(s, top, 1)[mine].ravel(), np.full(len(mine), k), pa.float32())], names=["node", "nb", "s"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, lists old and found: the K best; edges that were not old are new."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            node = part.column(0).to_numpy()
            row, b, s, old = [], [], [], []
            for ids, score, was in ((1, 2, True), (3, 4, False)):
                lists, scores = part.column(ids), part.column(score)
                n = lists.value_lengths().fill_null(0).to_numpy()
                row.append(np.repeat(np.arange(len(node)), n))
                b.append(lists.flatten().to_numpy())
                s.append(scores.flatten().to_numpy())
                old.append(np.full(len(b[-1]), was))
            row, b, s = np.concatenate(row), np.concatenate(b), np.concatenate(s)
            known = set(zip(row[: len(old[0])].tolist(), b[: len(old[0])].tolist(), strict=True))
            r, b, s = top_lists(row, b, s, K)
            new = np.array([x not in known for x in zip(r.tolist(), b.tolist(), strict=True)], bool)
            count = np.bincount(r, minlength=len(node))
            yield pa.record_batch([pa.array(node), _lists(b, count, pa.int64()), _lists(s, count, pa.float32()), _lists(new, count, pa.bool_())], names=["node", "nb", "s", "new"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their first column, in batches that split no value of it."""
    rest = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        # What came before and has the key of this batch's first row belongs to it; of each batch the last key may go on.
        if rest and rest[0].column(0)[0].as_py() != key[0]:
            yield pa.concat_batches(rest)
            rest = []
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield pa.concat_batches([*rest, batch.slice(0, cut)])
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.concat_batches(rest)


def _meet(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """At each centre all pairs with a new edge are scored; those that beat an end's worst edge go out, the best K an end."""
    for batch in _whole(batches):
        centre = batch.column(0).to_numpy()
        heads = np.append(np.flatnonzero(np.diff(centre, prepend=centre[0] - 1)), len(centre))
        for at in range(0, len(heads) - 1, 256):
            ends = heads[at : at + 257]
            m, q, bound, new = batch.slice(ends[0], ends[-1] - ends[0]).columns[1:]
            n = np.diff(ends)
            width = int(n.max())
            if width < 2:
                continue
            slot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row = np.repeat(np.arange(len(n)), n)
            ids = np.full((len(n), width), -1, np.int64)
            ids[row, slot] = m.to_numpy()
            x = np.zeros((len(n), width, dim), np.float32)
            x[row, slot] = _bytes(q, dim)
            low = np.full((len(n), width), np.inf, np.float32)
            low[row, slot] = bound.to_numpy()
            fresh = np.zeros((len(n), width), bool)
            fresh[row, slot] = new.to_numpy(zero_copy_only=False)
            s = np.matmul(x, x.transpose(0, 2, 1))
            ok = (s > low[:, :, None]) & (fresh[:, :, None] | fresh[:, None, :]) & (ids[:, None, :] >= 0) & (ids[:, :, None] != ids[:, None, :])
            c, i, j = np.nonzero(ok)
            a, b, v = top_lists(ids[c, i], ids[c, j], s[c, i, j], K)
            if len(a):
                yield pa.record_batch([pa.array(a), pa.array(b), pa.array(v, pa.float32())], names=["a", "b", "s"])


def build(nodes: DataFrame, dim: int) -> DataFrame:
    """node, nb, s of every node of ``nodes`` (node, q, codes)."""
    first = None
    for t in range(SORTS):
        order = nodes.select(F.col("codes")[t].alias("c"), "node", "q").repartitionByRange("c").sortWithinPartitions("c", "node").select("node", "q")
        part = order.mapInArrow(lambda b: _blocks(b, dim), "node long, nb array<long>, s array<float>")
        first = part if first is None else first.unionByName(part)
    lists = first.groupBy("node").agg(F.flatten(F.collect_list("nb")).alias("nb1"), F.flatten(F.collect_list("s")).alias("s1"))
    merged = "node long, nb array<long>, s array<float>, new array<boolean>"
    none = lists.select("node", F.array().cast("array<long>").alias("nb"), F.array().cast("array<float>").alias("s"), "nb1", "s1")
    # A node that shares no block with another has no list yet; it stays in, with none.
    graph = materialize(nodes.select("node").join(none, "node", "left").mapInArrow(_merge, merged), "graph")
    while True:
        data = graph.join(nodes.select("node", "q"), "node").select("node", "q", F.when(F.size("nb") < K, F.lit(-9.0)).otherwise(F.array_min("s")).cast("float").alias("bound"), "nb", "s", "new")
        edges = data.select("node", F.explode(F.arrays_zip("nb", "s", "new")).alias("e")).select("node", "e.nb", "e.s", "e.new")
        # Those that list the centre, the K closest; those that the centre lists. Vectors join once for each.
        near = Window.partitionBy("nb").orderBy(F.desc("s"), "node")
        listing = edges.withColumn("r", F.row_number().over(near)).where(F.col("r") <= K).select(F.col("nb").alias("c"), F.col("node").alias("m"), "new")
        meeting = listing.unionByName(edges.select(F.col("node").alias("c"), F.col("nb").alias("m"), "new")).repartition("m").groupBy("c", "m").agg(F.max("new").alias("new"))
        meeting = meeting.join(data.select(F.col("node").alias("m"), "q", "bound"), "m")
        centres = meeting.select("c", "m", "q", "bound", "new").repartition("c").sortWithinPartitions("c")
        found = centres.mapInArrow(lambda b: _meet(b, dim), "a long, b long, s float")
        best = Window.partitionBy("a").orderBy(F.desc("s"), "b")
        found = found.repartition("a").distinct().withColumn("r", F.row_number().over(best)).where(F.col("r") <= K)
        found = found.groupBy("a").agg(F.collect_list(F.struct("b", "s")).alias("f")).select(F.col("a").alias("node"), F.col("f.b").alias("nb1"), F.col("f.s").alias("s1"))
        graph = materialize(graph.select("node", "nb", "s").join(found, "node", "left").mapInArrow(_merge, merged), "graph")
        fresh, edges = graph.agg(F.sum(F.size(F.filter("new", lambda x: x))), F.sum(F.size("nb"))).first()
        if not edges or fresh < DELTA * edges:
            break
    return graph.select("node", "nb", "s")


def _score(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Nodes met and their queries' vectors: query, ids, s."""
    for batch in batches:
        if not batch.num_rows:
            continue
        query, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        s = np.einsum("nd,nd->n", _bytes(batch.column(2), dim), _bytes(batch.column(3), dim))
        o = np.argsort(query, kind="stable")
        names, n = np.unique(query, return_counts=True)
        yield pa.record_batch([pa.array(names), _lists(node[o], n, pa.int64()), _lists(s[o], n, pa.float32())], names=["query", "ids", "s"])


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """New pool of each query: the POOL best seen, which of them are opened, and the WIDTH best that are opened next."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            out = []
            for query, *lists in zip(part.column(0).to_pylist(), *part.columns[2:], strict=True):
                i, v, done = (x.values.flatten().to_numpy(zero_copy_only=False) for x in lists)
                _, i, v = top_lists(np.zeros(len(i), np.int64), i, v, POOL)
                i, v = i[i != query], v[i != query]
                ahead = i[~np.isin(i, done)][:WIDTH]
                out.append((query, i, v, np.concatenate([done, ahead]), ahead))
            arrays = [pa.array([r[c] for r in out], pa.list_(kind)) for c, kind in ((1, pa.int64()), (2, pa.float32()), (3, pa.int64()), (4, pa.int64()))]
            yield pa.record_batch([part.column(0), part.column(1), *arrays], names=["query", "q", "ids", "s", "opened", "ahead"])


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, id and score of the k nearest found of each query."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vec_col)) & F.exists(vec_col, lambda x: x != 0) & F.col(id_col).isNotNull())
    dim = usual_length(rows, vec_col)
    if not dim:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    rows = rows.where(F.size(vec_col) == dim).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("is_query"))
    # The smallest ids of each vector suffice: k besides the query's own.
    few = Window.partitionBy("v").orderBy("id")
    members = rows.select("id", "v").withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1)
    nodes = materialize(members.groupBy("v").agg(F.min("id").alias("node"), F.array_sort(F.collect_list("id")).alias("members")).withColumn("h", F.xxhash64("v")), "vectors")
    codes = materialize(nodes.select("node", "v").mapInArrow(lambda b: _prepare(b, dim), "node long, q binary, codes array<long>"), "codes")
    graph = build(codes, dim)
    links, coded = graph.select("node", "nb"), codes.select("node", F.col("q").alias("y"))

    asked = rows.where("is_query").select("id", "v").withColumn("h", F.xxhash64("v"))
    asked = materialize(asked.join(nodes.select("h", "v", "node"), ["h", "v"]).select(F.col("id").alias("query_id"), "node").distinct(), "queries")
    ask = asked.select("node").distinct().join(codes.select("node", "q"), "node").select(F.col("node").alias("query"), "q")
    ask = materialize(ask, "query-nodes")
    none = F.array().cast("array<long>"), F.array().cast("array<float>")
    state = ask.select("query", "q", none[0].alias("ids"), none[1].alias("s"), F.array("query").alias("opened"), F.array("query").alias("ahead"))
    pooled = "query long, q binary, ids array<long>, s array<float>, opened array<long>, ahead array<long>"
    for _ in range(STEPS):
        opening = state.select("query", F.explode("ahead").alias("node")).join(links, "node").groupBy("query").agg(F.flatten(F.collect_list("nb")).alias("met"))
        unseen = F.array_except("met", F.concat("opened", "ids"))
        met = state.select("query", "q", "ids", "opened").join(opening, "query").select("query", "q", F.explode(unseen).alias("node"))
        met = met.join(coded, "node").select("query", "node", "q", "y")
        scored = met.mapInArrow(lambda b: _score(b, dim), "query long, ids array<long>, s array<float>")
        both = scored.select("query", F.lit(None).cast("binary").alias("q"), "ids", "s", none[0].alias("opened")).unionByName(state.select("query", "q", "ids", "s", "opened"))
        grouped = both.groupBy("query").agg(F.max("q").alias("q"), F.collect_list("ids").alias("ids"), F.collect_list("s").alias("s"), F.collect_list("opened").alias("opened"))
        state = materialize(grouped.mapInArrow(_pool, pooled), "pools")
    near = state.select("query", F.explode(F.array_distinct(F.concat(F.array("query"), "ids"))).alias("node"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z)
    normed = nodes.select("node", "v", "members", F.sqrt(dot("v", "v")).alias("norm"))
    pair = near.join(normed, "node").join(normed.select(F.col("node").alias("query"), F.col("v").alias("w"), F.col("norm").alias("wnorm")), "query")
    cosine = dot("v", "w") / (F.col("norm") * F.col("wnorm"))
    pair = pair.select("query", "members", cosine.alias("score"))
    full = asked.withColumnRenamed("node", "query").join(pair, "query").select("query_id", F.explode("members").alias("id"), "score").where("id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
