import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import neighbours, topk


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 16))
    x[200:260] = x[200]  # a group of copies
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)]
    rows += [(2000, None, "a"), (2050, [1.0, float("nan")] + [0.0] * 14, "a"), (2051, [None] + [1.0] * 15, "a"), (2100, [0.0] * 16, "a"), (None, x[5].tolist(), "a"), (2150, [1.0, 2.0], "a"), (2200, [float("inf")] + [0.0] * 15, "a")]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)


def _expected(x, ids, score, queries, k=5):
    out = {}
    for q in queries:
        s = score(x, x[ids == q][0])
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[q] = [(int(ids[keep][o]), s[keep][o]) for o in order]
    return out


def test_exact_search_matches_brute_force(table):
    x, df = table
    x = x.astype(np.float32).astype(float)
    ids = np.append(np.arange(700), 2100)
    full = np.vstack([x, np.zeros(16)])
    want = _expected(np.floor(256 * full), ids, lambda a, q: (a @ q).astype(int), [i for i in ids if i % 50 == 0])
    got = {}
    for r in topk.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want


def test_blocks_of_queries_change_nothing(table, monkeypatch):
    _, df = table
    rows = lambda: sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect())
    want = rows()
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    assert rows() == want


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [-1e6, 3.0])], "vec_id long, embedding array<float>")
    for search in (topk.search, neighbours.nearest):
        assert [(r.query_id, r.rank, r.vec_id) for r in search(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
        assert search(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_large_components_stay_exact():
    c = np.array([[2.0**30, 1.0], [2.0**30, 2.0]])
    assert topk.scores(c, c).tolist() == [[2**60 + 1, 2**60 + 2], [2**60 + 2, 2**60 + 4]]


def test_nearest_recall_and_copies(table):
    x, df = table
    x = x.astype(np.float32).astype(float)
    ids = np.arange(700)
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    queries = [i for i in range(700) if i % 50 == 0]
    want = _expected(unit, ids, lambda a, q: (a @ q).round(12), queries)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == queries and all(len(v) == 5 for v in got.values())
    recall = np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 5 for q in queries])
    assert recall >= 0.9
    assert [a for a, _ in got[200]] == [201, 202, 203, 204, 205]
    for q in queries:
        for v, s in got[q]:
            assert abs(s - unit[q] @ unit[v]) < 1e-12


def test_near_copies_keep_their_order(spark):
    # Different vectors at a cosine of about 0.9999: their order is finer than 8 bits.
    rng = np.random.default_rng(8)
    x = (rng.normal(size=16) + 0.01 * rng.normal(size=(1500, 16))).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    queries = list(range(0, 1500, 50))
    want = _expected(unit, np.arange(1500), lambda a, q: a @ q, queries)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {a for a, _ in want[q]}) / 5 for q in queries]) >= 0.9


def test_no_row_holds_many_vectors(table, monkeypatch):
    # Rows with the 32 vectors of a list made the search the peak of an executor's memory; rows of 64 met at a centre.
    _, df = table
    widest, write = {}, neighbours.materialize
    handed, mapped = [], type(df).mapInArrow

    def written(frame, name):
        out = write(frame, name)
        for c, kind in out.dtypes:
            if kind == "binary":
                widest[f"{name}.{c}"] = out.agg(F.max(F.octet_length(c))).first()[0]
        return out

    def handing(frame, *args, **more):
        handed.append(frame.schema.simpleString())
        return mapped(frame, *args, **more)

    monkeypatch.setattr(type(df), "mapInArrow", handing)
    monkeypatch.setattr(neighbours, "materialize", written)
    monkeypatch.setattr(neighbours, "STEPS", 1)
    neighbours.nearest(df, F.col("vec_id") % 50 == 0)
    assert widest and set(widest.values()) == {16 * 4}, widest
    assert handed and not [x for x in handed if "array<struct" in x or "array<binary" in x]


def test_batches_split_no_centre():
    import pyarrow as pa

    keys = [1, 1, 1, 2, 3, 3, 3, 3, 3, 3, 4, 7, 7]
    for size in range(1, 15):
        parts = [pa.record_batch([pa.array(keys[a : a + size], pa.int64()), pa.array(range(a, min(a + size, len(keys))), pa.int64())], names=["c", "m"]) for a in range(0, len(keys), size)]
        out = list(neighbours._whole(iter([parts[0].slice(0, 0), *parts])))
        assert [x for b in out for x in b.column(1).to_pylist()] == list(range(len(keys)))
        assert sum(len(set(b.column(0).to_pylist())) for b in out) == len(set(keys))
    assert list(neighbours._whole(iter([]))) == []
