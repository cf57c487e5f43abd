"""Exact top-k inner-product search by distributed histogram selection.

Queries are taken in blocks of at most ``QUERY_BLOCK``, whatever their number.
For a block, every pass scores all candidates where they lie, as integer
matrix products, and no score leaves its task: a task hands out, for each
query, counts of scores in 256 equal bins of the interval that can still hold
the k-th score. Summed over all tasks the counts tell the bin, the interval
shrinks to it, and passes go on until it holds one value. A last pass hands
out the scores above the k-th value and, of those equal to it, each task's
smallest ids, as many as are missing; the global order breaks the ties.

A task may leave out the counts of bins below its own k-th score: the k-th
score of all candidates is no smaller, so those bins cannot hold it.

Defined results: vectors that are null, or hold null or non-finite components,
and rows with null ids take no part; nor do vectors of another length than the
most common (ties: the longer). A candidate with the query's id is the query's
own row. Repeated ids among queries are one query; repeated candidate rows are
candidates each. Fewer than k candidates: all of them. Components are
quantised to floor(256 * x); scores are 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.storage import materialize

SCALE = 256
BINS = 256
#: Bounds what the driver holds and broadcasts at a time: queries times components times 8 bytes.
QUERY_BLOCK = 8192
SUB = 512


def usable(vector: Column) -> Column:
    """Neither null nor holding null, NaN or infinite components, and not empty."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def usual_length(rows: DataFrame, vec_col: str) -> int:
    top = rows.groupBy(F.size(vec_col).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return int(top["n"]) if top else 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column of equal lengths as float64."""
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def quantise(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x)


def scores(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products, candidates by queries; exact in doubles below 2**53, in 64-bit integers beyond."""
    limit = np.abs(c).max(initial=0) * np.abs(q).max(initial=0) * c.shape[1]
    if limit < 2**53:
        return (c @ q.T).astype(np.int64)
    with np.errstate(invalid="ignore"):
        return c.astype(np.int64) @ q.astype(np.int64).T


def block_of(ids: np.ndarray, q: np.ndarray, reach: float, k: int) -> SimpleNamespace:
    """A block of queries with the interval [low, low + span) that holds each one's k-th score, and how many are wanted from it."""
    bound = np.ceil(np.sqrt((q * q).sum(1)) * reach) + 1  # Cauchy and Schwarz
    bound = np.minimum(bound, 2.0**60).astype(np.int64)
    width = np.maximum(1, -(-(2 * bound + 1) // BINS))
    return SimpleNamespace(ids=ids, q=q, k=k, low=-bound, span=2 * bound + 1, width=width, need=np.full(len(ids), k), done=np.zeros(len(ids), bool))


def _counts(batches: Iterator[pa.RecordBatch], block: SimpleNamespace, dim: int) -> Iterator[pa.RecordBatch]:
    n = len(block.ids)
    total = np.zeros((n, BINS), np.int64)
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            ids = batch.column(0).slice(a, 4096).to_numpy()
            c = quantise(matrix(batch.column(1).slice(a, 4096), dim))
            for b in range(0, n, SUB):
                s = scores(c, block.q[b : b + SUB])
                at = (s - block.low[b : b + SUB]) // block.width[b : b + SUB]
                inside = (s >= block.low[b : b + SUB]) & (s - block.low[b : b + SUB] < block.span[b : b + SUB]) & (ids[:, None] != block.ids[b : b + SUB])
                cell = np.where(inside, at, BINS) + np.arange(s.shape[1]) * (BINS + 1)
                got = np.bincount(cell.ravel(), minlength=s.shape[1] * (BINS + 1)).reshape(-1, BINS + 1)
                total[b : b + SUB] += got[:, :BINS]
    above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total
    q, at = np.nonzero((total > 0) & (above < block.need[:, None]) & ~block.done[:, None])
    yield pa.record_batch([pa.array(q, pa.int32()), pa.array(at, pa.int32()), pa.array(total[q, at])], names=["q", "bin", "n"])


def _winners(batches: Iterator[pa.RecordBatch], block: SimpleNamespace, dim: int) -> Iterator[pa.RecordBatch]:
    """Scores above the k-th, and the smallest ids of those equal to it."""
    n, k = len(block.ids), block.k
    held: list[pd.DataFrame] = []

    def best(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts).sort_values(["q", "score", "id"], ascending=[True, False, True]).groupby("q", sort=False).head(k)

    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            ids = batch.column(0).slice(a, 4096).to_numpy()
            c = quantise(matrix(batch.column(1).slice(a, 4096), dim))
            for b in range(0, n, SUB):
                s = scores(c, block.q[b : b + SUB])
                own = ids[:, None] == block.ids[b : b + SUB]
                i, j = np.nonzero((s >= block.low[b : b + SUB]) & ~own)
                part = pd.DataFrame({"q": (j + b).astype(np.int32), "id": ids[i], "score": s[i, j]})
                # More than k a query in this block only by ties at the k-th score.
                held.append(best([part]))
            if len(held) > 64:
                held = [best(held)]
    if held:
        out = best(held)
        yield pa.record_batch([pa.array(out.q.to_numpy(), pa.int32()), pa.array(out.id.to_numpy(), pa.int64()), pa.array(out.score.to_numpy(), pa.int64())], names=["q", "id", "score"])


def search(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, id and score of the k highest integer inner products of each query."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull())
    dim = usual_length(rows, vec_col)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long").withColumnRenamed("vec_id", id_col)
    if not dim:
        return empty
    rows = rows.where(F.size(vec_col) == dim).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("is_query"))
    slim = rows.select("id", "v")
    queries = rows.where("is_query").groupBy("id").agg(F.min("v").alias("v"))
    floor = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.floor(x * SCALE).cast("double") * F.floor(x * SCALE).cast("double"))
    size = queries.count()
    reach = float(np.sqrt(slim.agg(F.max(floor)).first()[0] or 0.0))
    blocks = -(-size // QUERY_BLOCK)
    out = []
    for part in range(blocks):
        # About QUERY_BLOCK queries: the driver holds a block at a time, never all.
        some = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == part).orderBy("id").collect()
        if not some:
            continue
        block = block_of(np.array([r.id for r in some]), quantise(np.array([r.v for r in some])), reach, k)
        while not block.done.all():
            block = _refine(slim, block, dim)
        found = _run(slim, block, dim, _winners, "q int, id long, score long")
        names = spark.createDataFrame(pd.DataFrame({"q": np.arange(len(block.ids), dtype=np.int32), "query_id": block.ids}))
        order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        top = top.join(F.broadcast(names), "q").select("query_id", "rank", F.col("id").alias(id_col), "score")
        # Blocks after each other: a finished one is a table of k rows a query, not a plan that is carried on.
        out.append(top if blocks == 1 else materialize(top, "topk"))
    while len(out) > 1:
        out = [a.unionByName(b) for a, b in zip(out[::2], out[1::2], strict=False)] + ([out[-1]] if len(out) % 2 else [])
    return out[0] if out else empty


def _run(slim: DataFrame, block: SimpleNamespace, dim: int, work, schema: str) -> DataFrame:
    sent = slim.sparkSession.sparkContext.broadcast(block)
    return slim.mapInArrow(lambda batches: work(batches, sent.value, dim), schema)


def _refine(slim: DataFrame, block: SimpleNamespace, dim: int) -> SimpleNamespace:
    """One pass: counts of all tasks, summed by query and bin, tell the bin of each query's k-th score."""
    counts = _run(slim, block, dim, _counts, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
    # At most k bins a query can matter: each counts one candidate at least.
    near = counts.withColumn("upto", upto).where(F.col("upto") - F.col("n") < block.k)
    rows = near.groupBy("q").agg(F.collect_list(F.struct("bin", "n", "upto")).alias("bins")).collect()
    new = SimpleNamespace(**{k: v.copy() if isinstance(v, np.ndarray) else v for k, v in vars(block).items()})
    seen = np.zeros(len(block.ids), bool)
    for r in rows:
        seen[r.q] = True
        hit = min((b for b in r.bins if b.upto >= block.need[r.q]), key=lambda b: b.upto, default=None)
        if hit is None:  # fewer candidates than wanted: all of them
            new.done[r.q] = True
            continue
        new.low[r.q] = block.low[r.q] + hit.bin * block.width[r.q]
        new.need[r.q] = block.need[r.q] - (hit.upto - hit.n)
        if block.width[r.q] == 1:
            new.done[r.q] = True
        else:
            new.span[r.q] = block.width[r.q]
            new.width[r.q] = max(1, -(-block.width[r.q] // BINS))
    new.done |= ~seen
    return new
