"""Near-duplicate documents by b-bit MinHash.

A text's words are cut at ASCII white space after lower-casing A-Z; its set is
that of its shingles of ``words`` words (of the whole sequence, if it has
fewer). Documents are linked if their sets' Jaccard similarity reaches the
threshold; a document's component is named by its smallest id.

1. One pass over the texts gives each document its set's size and 128-bit
   code and 38 band keys of 5 whole minima each. A pair at the threshold of 0.8
   shares no band with a chance of 3e-7.
2. Documents with equal sets are one class; only its smallest id goes on.
3. Candidates come from bands. Those that share one get 1024 minima, mixed,
   cut down to 2 low bits and packed by bit planes; similarity is estimated from
   the counts of equal 2-bit values, corrected for chance collisions (a quarter
   agree by chance). Pairs below the threshold by more than ``MARGIN`` (4.4
   standard errors) or with sizes that rule the threshold out are dropped. All
   others are confirmed on their full sets.
4. A bucket of a band is not expanded into pairs. First every member meets the
   bucket's smallest id. Then, as long as a bucket holds more than one
   component, members meet the most similar members of other components, at most
   two rounds; at last, always, all pairs between different components that are still
   untested are confirmed, so no link between components is lost. Buckets are
   compared in blocks of about ``BLOCK`` members by word operations, whatever
   their size, and only pairs to confirm leave a block, each from the first
   band that it shares.
5. Components are found by alternating large-star and small-star joins.

Defined results: texts without words (null or empty too) have size 0, are
linked with nothing and are kept. Rows with equal ids count as one document;
rows with a null id are linked with nothing, their component is null and they
are kept. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.storage import materialize
from kinweave.llm.textbytes import ASCII_LOWER, SPACES, byte_table, mix, row_slices, text_buffer, tidy, word_hashes, word_spans

U64, U32 = np.uint64, np.uint32
BANDS, ROWS, HASHES = 38, 5, 1024
SLICE = 1 << 20
BLOCK = 2048
MARGIN = 0.065
HOT_KEYS, HOT_ROWS = 10_000, 256
WORDS64 = HASHES // 64
_TABLE = byte_table(77)
_RNG = np.random.default_rng(9)
_A = (_RNG.integers(0, 1 << 31, HASHES, dtype=np.uint64) * 2 + 1).astype(U32)
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(U32)
_MULT = _RNG.integers(1, 1 << 62, 16, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle codes of each text, one after the other, and n + 1 offsets into them."""
    low = ASCII_LOWER[raw]
    start, end, row = word_spans(low, offsets, SPACES)
    h = word_hashes(low, start, end, _TABLE)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    # Words per shingle: fewer than ``words`` only if the text has no more.
    size = np.minimum(count, words)
    shingles = np.where(count == 0, 0, count - size + 1)
    owner = np.repeat(np.arange(n), shingles)
    at = first[owner] + np.arange(len(owner)) - (np.cumsum(shingles) - shingles)[owner]
    code = np.zeros(len(owner), np.uint64)
    for i in range(words):
        inside = i < size[owner]
        code += np.where(inside, h[np.minimum(at + i, max(len(h) - 1, 0))] * _MULT[i % 16], U64(0)) if len(h) else U64(0)
    code = mix(code + size[owner].astype(np.uint64))
    o = np.lexsort((code, owner))
    code, owner = code[o], owner[o]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    code, owner = code[keep], owner[keep]
    return code, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def minima(code: np.ndarray, at: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """(sets, hashes) minima; of empty sets, the largest value."""
    n = len(at) - 1
    out = np.full((n, hashes), 0xFFFFFFFF, U32)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        x = (code >> U64(32)).astype(U32)
        buf = np.empty_like(x)
        begin = at[:-1][full]
        for k in range(hashes):
            np.multiply(x, _A[k], out=buf)
            np.add(buf, _B[k], out=buf)
            out[full, k] = np.minimum.reduceat(buf, begin)
    return out


def planes(m: np.ndarray) -> np.ndarray:
    """(sets, 2 * WORDS64) words: the lowest bits of the mixed minima, then the second lowest.

    The low bits of A * x + B depend on those of x alone, so in small sets chance
    collisions would not be independent; mixing (murmur's finaliser) makes them so.
    """
    m = m ^ (m >> U32(16))
    m *= U32(0x85EBCA6B)
    m ^= m >> U32(13)
    m *= U32(0xC2B2AE35)
    m ^= m >> U32(16)
    out = [np.packbits((m >> U32(k)) & U32(1), axis=1, bitorder="little").view(np.int64) for k in (0, 1)]
    return np.concatenate(out, axis=1)


def band_keys(m: np.ndarray) -> np.ndarray:
    keys = np.empty((len(m), BANDS), np.int64)
    for b in range(BANDS):
        h = np.full(len(m), b + 1, np.uint64)
        for r in range(ROWS):
            h = mix(h * U64(0x100000001B3) + m[:, b * ROWS + r])
        keys[:, b] = h.view(np.int64)
    return keys


FACTS = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("ca", pa.int64()), ("cb", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _facts(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_buffer(batch.column(1))
        for a, b in row_slices(offsets, SLICE):
            code, at = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
            n = np.diff(at)
            m = minima(code, at, BANDS * ROWS)
            total = np.concatenate([[U64(0)], np.cumsum(mix(code ^ U64(0xA5A5A5A5)), dtype=np.uint64)])
            other = np.concatenate([[U64(0)], np.cumsum(mix(code * U64(0xD6E8FEB86659FD93)), dtype=np.uint64)])
            ca, cb = (t[at[1:]] - t[at[:-1]] for t in (total, other))
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(ca.view(np.int64)), pa.array(cb.view(np.int64)), _rows_of(band_keys(m))], schema=FACTS)


def _rows_of(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(np.ascontiguousarray(v).ravel()))


def _signatures(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_buffer(batch.column(1))
        for a, b in row_slices(offsets, SLICE):
            code, at = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
            yield pa.record_batch([batch.column(0).slice(a, b - a), _rows_of(planes(minima(code, at)))], names=["rep", "sig"])


def estimate(p: str, q: str) -> Column:
    """Collision-corrected similarity of two signatures, columns of WORDS64 words for each of two bit planes."""
    differ = sum((F.bit_count(F.col(p)[w].bitwiseXOR(F.col(q)[w]).bitwiseOR(F.col(p)[w + WORDS64].bitwiseXOR(F.col(q)[w + WORDS64]))) for w in range(WORDS64)), F.lit(0))
    return ((1 - differ / HASHES) - 0.25) / 0.75


def _confirm(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets reach the threshold."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        (ra, oa), (rb, ob) = text_buffer(batch.column(2)), text_buffer(batch.column(3))
        for i, j in row_slices(oa + ob, 2 * SLICE):
            x, ax = shingle_sets(ra[oa[i] : oa[j]], oa[i : j + 1] - oa[i], words)
            y, ay = shingle_sets(rb[ob[i] : ob[j]], ob[i : j + 1] - ob[i], words)
            for k in range(j - i):
                s, t = x[ax[k] : ax[k + 1]], y[ay[k] : ay[k + 1]]
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep[i + k] = both > 0 and 100 * both >= percent * (len(s) + len(t) - both)
        if keep.any():
            yield pa.record_batch([batch.column(c).filter(pa.array(keep)) for c in (0, 1)], names=["a", "b"])


def _cross(table: pa.Table, percent: int, most: int) -> pa.Table:
    """Of a block pair of one bucket: pairs of different components that may reach the threshold, the ``most`` likeliest of each member (0: all)."""
    rep, comp, n, side = (table.column(c).to_numpy() for c in ("rep", "comp", "n", "side"))
    sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(len(rep), -1).view(np.uint64)
    marks = table.column("marks").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
    pivot, band = table.column("pivot").to_numpy(), table.column("band")[0].as_py()
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    aa, bb = [], []
    floor = percent / 100 - MARGIN
    for s in range(0, len(left), 256):
        i = left[s : s + 256]
        differ = np.zeros((len(i), len(right)), np.uint16)
        for w in range(WORDS64):
            x = (sig[i, w][:, None] ^ sig[right, w]) | (sig[i, w + WORDS64][:, None] ^ sig[right, w + WORDS64])
            differ += np.bitwise_count(x)
        est = ((1 - differ / HASHES) - 0.25) / 0.75
        low, high = np.minimum(n[i][:, None], n[right]), np.maximum(n[i][:, None], n[right])
        ok = (est >= floor) & (comp[i][:, None] != comp[right]) & (100 * low >= percent * high)
        ok &= (rep[i] != pivot[i])[:, None] & (rep[right] != pivot[right])  # those met already
        r, c = np.nonzero(ok)
        ok[r, c] = (marks[i[r]] == marks[right[c]]).argmax(1) == band
        if most:
            est = np.where(ok, est, -1)
            for _ in range(min(most, len(right))):
                k = est.argmax(1)
                good = est[np.arange(len(i)), k] >= floor
                aa.append(rep[i[good]])
                bb.append(rep[right[k[good]]])
                est[np.arange(len(i)), k] = -1
        else:
            r, c = np.nonzero(ok & (rep[i][:, None] < rep[right]) if len(left) == len(right) and (left == right).all() else ok)
            aa.append(rep[i[r]])
            bb.append(rep[right[c]])
    a = np.concatenate(aa) if aa else np.zeros(0, np.int64)
    b = np.concatenate(bb) if bb else np.zeros(0, np.int64)
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    return pa.table({"a": pa.array(hi, pa.int64()), "b": pa.array(lo, pa.int64())})


def _crossing(percent: int, most: int):
    return lambda table: _cross(table, percent, most)


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join with a table of one row a key, whose column ``size`` says how many rows of ``left`` have it.

    Keys with a share of 1 / ``HOT_KEYS`` of all rows or more are at most
    HOT_KEYS in number: their rows stay where they are and meet a broadcast of
    that many rows. All others are joined by key, none of them large.
    """
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = F.broadcast(right.where(F.col(size) >= least).drop(size))
    rest = left.join(F.broadcast(right.where(F.col(size) >= least).select(*keys)), keys, "left_anti")
    return left.join(hot, keys).unionByName(rest.join(right.where(F.col(size) < least).drop(size), keys))


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of every node of ``links`` (a > b), by large-star and small-star rounds."""
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = materialize(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "node")
        mark = now


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    facts = slim.mapInArrow(tidy(lambda batches: _facts(batches, words)), "doc long, n long, ca long, cb long, bands array<long>")
    facts = materialize(facts, "minhash")
    linked = facts.where((F.col("n") > 0) & F.col("doc").isNotNull())
    classes = materialize(linked.groupBy("n", "ca", "cb").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    total = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    member = materialize(hot_join(linked.select("doc", "n", "ca", "cb"), classes, ["n", "ca", "cb"], "copies", total).select("doc", "rep").distinct(), "members")
    own = member.where("doc = rep").select("rep").distinct()
    reps = materialize(linked.join(own, linked.doc == own.rep, "left_semi").select(F.col("doc").alias("rep"), "n", "bands"), "reps")

    banded = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("top"), F.count(F.lit(1)).alias("size")).where("pivot < top").drop("top")
    shared = materialize(shared.withColumn("rows", F.col("size")), "bands")
    inside = materialize(hot_join(banded, shared, ["key"], "rows", BANDS * total).distinct(), "buckets")
    near = inside.select("rep").distinct()
    texts = materialize(slim.join(near.withColumnRenamed("rep", "doc"), "doc", "left_semi"), "bucket-texts")
    sigs = texts.mapInArrow(tidy(lambda batches: _signatures(batches, words)), "rep long, sig array<long>")
    marks = F.transform("bands", lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int"))
    facts_of = materialize(reps.join(near, "rep", "left_semi").select("rep", "n", marks.alias("marks")).join(sigs, "rep").dropDuplicates(["rep"]), "signatures")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a > b) by full sets."""
        with_a = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a")
        full = with_a.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
        return full.mapInArrow(tidy(lambda batches: _confirm(batches, words, percent)), "a long, b long")

    star = inside.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    one, two = (facts_of.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "ab")
    star = star.join(one, "a").join(two, "b")
    fits = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (estimate("sa", "sb") >= percent / 100 - MARGIN)
    tested = materialize(star.where(fits).select("a", "b"), "pairs")
    links = materialize(confirmed(tested), "confirmed")
    comps, stuck = materialize(components(links), "components"), False
    for most in (2, 2, 0):
        # A capped round that finds only tested pairs would find them again; what its cap hid is left to the last round.
        if most and stuck:
            continue
        labelled = inside.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        split = labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
        open_ = labelled.join(split, "key").join(facts_of, "rep")
        # A large bucket is compared block by block: each member goes to the pairs of blocks that hold its own.
        g = F.ceil(F.col("size") / BLOCK).cast("int")
        open_ = open_.withColumn("mine", F.pmod(F.xxhash64("rep"), g).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), g - 1)))
        open_ = open_.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "band", "rep", "comp", "n", "sig", "marks", "pivot", F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"))
        pairs = open_.groupBy("key", "i", "j").applyInArrow(_crossing(percent, most), "a long, b long").distinct()
        pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        stuck = pairs.isEmpty()
        if stuck:
            continue
        more = materialize(confirmed(pairs), "confirmed")
        tested = tested.unionByName(pairs)
        links = links.unionByName(more)
        comps = materialize(components(links), "components")
    # A document with several rows under one id may stand in several classes: they are one.
    names = member.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("doc", F.coalesce("comp", "rep").alias("comp")).groupBy("doc").agg(F.min("comp").alias("comp"))
    out = facts.select("doc", "n").join(names, "doc", "left")
    component = F.coalesce("comp", "doc")
    return out.select(F.col("doc").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))
