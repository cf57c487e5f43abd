"""Removal of repeated passages by a depth-limited radix sort of suffixes.

Suffixes (places in the texts' UTF-8 bytes) need ordering only as far as the
threshold: two places whose next ``length`` bytes agree are equal, and a group
of equal places is exactly a repeated window. The order of the digits is free
as long as equal windows have equal digits, so the most significant digit is
one that lets neighbouring places travel together: a window's rarest-looking
16 bytes, its minimiser (the leftmost smallest hash among them). A window of
50 bytes has one minimiser, and runs of about 17 neighbouring windows share it.

* Pass 1 sorts the minimisers, one entry for each that a chunk of documents
  holds. Groups of one document are dropped, with all their suffixes.
* Pass 2 takes the live runs only. Inside a chunk windows are sorted by the
  codes of their first and second halves (two digits of 64 bits each, so equal
  means equal bytes up to a chance of 2**-128 a pair); all but the first
  document of a group are marked at once. What is still unmarked travels once
  a chunk, as the bytes of its run, to the task of its minimiser, where the
  same two digits are sorted over all chunks.
* A minimiser in more than ``HOT`` documents would gather its runs in one
  task; its windows travel by their own digits instead, one for each chunk.

A group's smallest doc_id keeps its window; the others' bytes are removed. All
three stages read the same shuffled chunks of documents (Spark reuses the
exchange), so texts move once; what a group of copies sends is bounded by the
number of chunks, not of copies. Rows are dealt to chunks by id and text, so
neither null nor repeated ids meet in one. A chunk is about ``CHUNK`` bytes,
longer only if one text (or many equal rows) is. Nothing is sampled or capped.

Defined results: null text is empty; texts shorter than the window lose
nothing; a null id counts as larger than all others; rows with equal ids do
not remove each other's bytes; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.textbytes import BASE, byte_table, mix, release, span_hash, text_buffer

U64 = np.uint64
GRAM = 16
CHUNK = 8 << 20
PIECE = 1 << 19
HOT = 4096
_POS = U64((1 << 24) - 1)
_TABLE = byte_table()
LAST_ID = np.iinfo(np.int64).max


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal or different lengths as one compressed blob; bytes of equal weight stand together."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        flat = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if a.itemsize > 1 and len(a) else a.tobytes()
        out.append(flat)
    body = b"".join(out)
    return len(body).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(body, asbytes=True)


def unpack(blob: bytes, *kinds: tuple[type, int]) -> list[np.ndarray]:
    """Inverse of pack, given dtype and length of each array."""
    body = pa.Codec("zstd", 1).decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    out, at = [], 0
    for kind, n in kinds:
        size = np.dtype(kind).itemsize
        part = np.frombuffer(body, np.uint8, n * size, at)
        at += n * size
        out.append(np.ascontiguousarray(part.reshape(size, n).T).view(kind).ravel() if size > 1 and n else part.view(kind))
    return out


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first byte, last byte, starts, ends) of ranges of about PIECE bytes; a longer text is cut with an overlap, so every window lies in one piece.

    starts and ends: for each text part in the piece, the places where windows may start.
    """
    a, n = 0, len(offsets) - 1
    while a < n:
        if offsets[a + 1] - offsets[a] > 2 * PIECE:
            lo, hi = int(offsets[a]), int(offsets[a + 1]) - length + 1
            for s in range(lo, max(hi, lo), PIECE):
                e = min(s + PIECE, hi)
                yield s, e + length - 1, np.array([s]), np.array([e])
            a += 1
            continue
        b = int(np.searchsorted(offsets, offsets[a] + PIECE, side="right")) - 1
        b = min(max(b, a + 1), n)
        while b > a + 1 and offsets[b] - offsets[b - 1] > 2 * PIECE:
            b -= 1
        yield int(offsets[a]), int(offsets[b]), offsets[a:b], np.maximum(offsets[a + 1 : b + 1] - length + 1, offsets[a:b])
        a = b


def runs(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key of the minimiser, first window, number of windows, and offset of the minimiser from the first window, for every run."""
    span = length - GRAM + 1
    found: list[tuple[np.ndarray, ...]] = []
    for lo, hi, starts, ends in pieces(offsets, length):
        n = hi - lo - length + 1
        if n <= 0:
            continue
        h = mix(span_hash(_TABLE[raw[lo:hi]], GRAM))
        g = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= span:
            g = np.minimum(g[: len(g) - size], g[size:])
            size *= 2
        if size < span:
            g = np.minimum(g[: len(g) - (span - size)], g[span - size :])
        at = (g & _POS).astype(np.int64)
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, np.minimum(starts - lo, n), 1)
        np.add.at(edge, np.minimum(ends - lo, n), -1)
        ok = np.cumsum(edge[:n]) > 0
        first = ok.copy()
        first[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
        begin = starts - lo
        begin = begin[(begin < n)]
        first[begin] |= ok[begin]
        s = np.flatnonzero(first)
        if not len(s):
            continue
        last = ok.copy()
        last[:-1] &= ~ok[1:] | first[1:]
        e = np.flatnonzero(last)
        p = at[s]
        found.append((mix(h[p] ^ U64(BASE)), s + lo, e - s + 1, p - s))
    if not found:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def digits(raw: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the two halves of the windows at ``starts`` (ascending)."""
    half = length // 2
    a, b = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(starts, lo + PIECE))
        v = _TABLE[raw[lo : int(starts[j - 1]) + length]]
        at = starts[i:j] - lo
        h = span_hash(v, half)
        a[i:j] = mix(h[at])
        rest = length - half
        b[i:j] = mix((h if rest == half else span_hash(v, rest))[at + half])
        i = j
    return a, b


def group_min(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each window the smallest id of its group; the order is that of the digits, singles leave after the first."""
    n = len(a)
    least = ids.copy()
    if n < 2:
        return least
    order = np.argsort(a)
    x = a[order]
    same = x[1:] == x[:-1]
    live = np.zeros(n, bool)
    live[1:] |= same
    live[:-1] |= same
    o = order[live]
    if not len(o):
        return least
    o = o[np.lexsort((ids[o], b[o], a[o]))]
    head = np.ones(len(o), bool)
    head[1:] = (a[o[1:]] != a[o[:-1]]) | (b[o[1:]] != b[o[:-1]])
    group = np.cumsum(head) - 1
    least[o] = ids[o[head]][group]
    return least


def spread(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of runs, and the run of each."""
    run = np.repeat(np.arange(len(n)), n)
    before = np.cumsum(n) - n
    return start[run] + (np.arange(len(run)) - before[run]), run


def _chunk(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk in one order on every pass, its bytes, offsets and ids."""
    table = table.sort_by([("doc", "ascending"), ("text", "ascending")]).combine_chunks()
    raw, offsets = text_buffer(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string()))
    ids = table.column("doc").fill_null(int(LAST_ID)).to_numpy().astype(np.int64)
    return table, raw, offsets, ids


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


ENTRIES = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("m", pa.int32()), ("blob", pa.binary())])
REPLIES = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])
E_SQL = "bucket int, chunk long, kind int, n int, m int, blob binary"
R_SQL = "chunk long, kind int, n int, blob binary"


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((key >> U64(33)) * U64(buckets)) >> U64(31)).astype(np.int32)


def _cuts(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of a sorted array."""
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    for i, a in enumerate(at):
        yield int(bucket[a]), int(a), int(at[i + 1]) if i + 1 < len(at) else len(bucket)


def local_keys(key: np.ndarray, row: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a chunk, in order; the documents that hold each; whether they have different ids."""
    o = np.lexsort((row, key))
    k, r = key[o], row[o]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    new = head.copy()
    new[1:] |= r[1:] != r[:-1]
    at = np.flatnonzero(head)
    tail = np.append(at[1:], len(k)) - 1
    return k[head], np.add.reduceat(new.astype(np.int64), at) if len(at) else at, ids[r[tail]] != ids[r[at]] if len(at) else at.astype(bool)


def remove_repeats(docs: DataFrame, *, length: int = 50, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, carry: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with ``keep_text`` also kept_text (null for null; bytes that no longer form a character are dropped), and the columns named in ``carry``; ``prefix`` is put in front of the names of results."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(parts, -(-total // CHUNK))
    buckets = chunks
    doc = F.col(id_col).cast("long")
    kind = docs.schema[id_col].dataType.simpleString()
    x = docs.select(F.pmod(F.xxhash64(doc, F.col(text_col)), F.lit(chunks)).alias("chunk"), doc.alias("doc"), F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry)])
    x = x.repartition(chunks, "chunk")

    def first_digit(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        table, raw, offsets, ids = _chunk(table)
        key, start, _, _ = runs(raw, offsets, length)
        row = np.searchsorted(offsets, start, side="right") - 1
        key, held, differ = local_keys(key, row, ids)
        bucket = _bucket(key, buckets)
        out = [(b, chunk, 0, j - i, 0, pack(_deltas(key[i:j]), np.minimum(held[i:j], 65535).astype(np.uint16))) for b, i, j in _cuts(bucket)]
        return _rows(out, ENTRIES)

    def first_groups(table: pa.Table) -> pa.Table:
        chunks_of, keys, held = [], [], []
        for chunk, n, blob in zip(table.column("chunk").to_pylist(), table.column("n").to_pylist(), table.column("blob").to_pylist(), strict=True):
            k, h = unpack(blob, (np.uint64, n), (np.uint16, n))
            keys.append(np.cumsum(k, dtype=np.uint64))
            held.append(h.astype(np.int64))
            chunks_of.append(np.full(n, chunk))
        k, h, c = np.concatenate(keys), np.concatenate(held), np.concatenate(chunks_of)
        o = np.argsort(k)
        k, h, c = k[o], h[o], c[o]
        head = np.ones(len(k), bool)
        head[1:] = k[1:] != k[:-1]
        group = np.cumsum(head) - 1
        live = (np.bincount(group) > 1)[group]  # one entry a chunk: in two chunks at least
        hot = (np.bincount(group, h) > HOT)[group]
        k, c, hot = k[live], c[live], hot[live]
        o = np.lexsort((k, c))
        k, c, hot = k[o], c[o], hot[o]
        at = np.flatnonzero(np.diff(c, prepend=c[0] - 1 if len(c) else 0))
        out = [(int(c[i]), 0, int(j - i), pack(_deltas(k[i:j]), hot[i:j].astype(np.uint8))) for i, j in zip(at, np.append(at[1:], len(c)), strict=True)] if len(c) else []
        return _rows(out, REPLIES)

    def second_digits(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows([], ENTRIES)
        chunk = left.column("chunk")[0].as_py()
        table, raw, offsets, ids = _chunk(left)
        key, start, n, off = runs(raw, offsets, length)
        row = np.searchsorted(offsets, start, side="right") - 1
        keys, _, differ = local_keys(key, row, ids)
        everywhere, hot = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        for m, blob in zip(right.column("n").to_pylist(), right.column("blob").to_pylist(), strict=True):
            k, f = unpack(blob, (np.uint64, m), (np.uint8, m))
            everywhere.append(np.cumsum(k, dtype=np.uint64))
            hot.append(f)
        everywhere, hot = np.concatenate(everywhere), np.concatenate(hot)
        wide = np.isin(keys, everywhere)
        burning = np.isin(keys, everywhere[hot > 0])
        at = np.searchsorted(keys, key)
        live = (differ | wide)[at]
        key, start, n, off, row, at = (v[live] for v in (key, start, n, off, row, at))
        wide, burning = wide[at], burning[at]
        if not len(key):
            return _rows([], ENTRIES)
        o = np.argsort(start, kind="stable")
        key, start, n, off, row, wide, burning = (v[o] for v in (key, start, n, off, row, wide, burning))
        place, run = spread(start, n)
        a, b = digits(raw, place, length)
        doc = ids[row][run]
        least = group_min(a, b, doc)
        marked = doc > least
        out = []
        # Marked here already: as runs of places, on their way to the last stage.
        s, m, r = _marks(place, marked, row[run])
        if len(s):
            out.append((int(chunk % buckets), chunk, 1, len(s), 0, pack((s - offsets[r]).astype(np.int32), m.astype(np.int32), r.astype(np.int32))))
        # Unmarked windows that other chunks may hold too.
        open_ = ~marked  # the group's smallest id, at every place that it has the window
        each = np.zeros(len(key), bool)
        each[run[open_]] = True
        go = each & wide & ~burning
        if go.any():
            i = np.flatnonzero(go)
            i = i[np.argsort(_bucket(key[i], buckets), kind="stable")]
            for bucket, f, t in _cuts(_bucket(key[i], buckets)):
                j = i[f:t]
                byte, _ = spread(start[j], n[j] + length - 1)
                body = raw[byte]
                out.append((bucket, chunk, 2, len(j), len(body), pack((start[j] - offsets[row[j]]).astype(np.int32), n[j].astype(np.uint8 if length < 256 else np.int32), row[j].astype(np.int32), ids[row[j]], body)))
        alone = open_ & burning[run]
        if alone.any():
            i = np.flatnonzero(alone)
            i = i[np.argsort(a[i])]
            for bucket, f, t in _cuts(_bucket(a[i], buckets)):
                j = i[f:t]
                r = row[run[j]]
                out.append((bucket, chunk, 3, len(j), 0, pack(a[j], b[j], (place[j] - offsets[r]).astype(np.int32), r.astype(np.int32), ids[r])))
        return _rows(out, ENTRIES)

    def second_groups(table: pa.Table) -> pa.Table:
        out, aa, bb, doc, place, row, where = [], [], [], [], [], [], []
        for chunk, kind, n, m, blob in zip(*(table.column(c).to_pylist() for c in ("chunk", "kind", "n", "m", "blob")), strict=True):
            if kind == 1:
                out.append((chunk, 1, n, blob))
                continue
            if kind == 2:
                s, w, r, d, body = unpack(blob, (np.int32, n), (np.uint8 if length < 256 else np.int32, n), (np.int32, n), (np.int64, n), (np.uint8, m))
                w = w.astype(np.int64)
                base = np.cumsum(w + length - 1) - (w + length - 1)
                p, run = spread(base, w)
                a, b = digits(body, p, length)
                p = s[run] + (p - base[run])
                r, d = r[run], d[run]
            else:
                a, b, p, r, d = unpack(blob, (np.uint64, n), (np.uint64, n), (np.int32, n), (np.int32, n), (np.int64, n))
            for x, v in ((aa, a), (bb, b), (doc, d), (place, p.astype(np.int64)), (row, r), (where, np.full(len(a), chunk))):
                x.append(v)
        if aa:
            a, b, d, p, r, c = map(np.concatenate, (aa, bb, doc, place, row, where))
            aa, bb, doc, place, row, where = [], [], [], [], [], []
            least = group_min(a, b, d)
            mark = d > least
            p, r, c = p[mark], r[mark], c[mark]
            o = np.lexsort((p, r, c))
            p, r, c = p[o], r[o], c[o]
            if len(p):
                at = np.flatnonzero(np.diff(c, prepend=c[0] - 1))
                for i, j in zip(at, np.append(at[1:], len(c)), strict=True):
                    s, m, rr = _marks(p[i:j], np.ones(j - i, bool), r[i:j])
                    out.append((int(c[i]), 1, len(s), pack(s.astype(np.int32), m.astype(np.int32), rr.astype(np.int32))))
        return _rows(out, REPLIES)

    def one(work):
        def run(table: pa.Table) -> pa.Table:
            try:
                return work(table)
            finally:
                release()

        return run

    def two(work):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            try:
                return work(left, right)
            finally:
                release()

        return run

    final = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + ([("kept_text", pa.string())] if keep_text else []))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            out = _rows([], final)
            for i in range(len(carry)):
                out = out.append_column(f"carry_{i}", pa.array([], left.column(f"carry_{i}").type))
            return out
        table, raw, offsets, _ = _chunk(left)
        change = np.zeros(len(raw) + 1, np.int32)
        for n, blob in zip(right.column("n").to_pylist(), right.column("blob").to_pylist(), strict=True):
            s, m, r = unpack(blob, (np.int32, n), (np.int32, n), (np.int32, n))
            s = offsets[r] + s
            np.add.at(change, s, 1)
            np.add.at(change, s + m - 1 + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        removed = np.concatenate([[0], np.cumsum(gone)])
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        at = offsets[:-1][np.diff(offsets) > 0]
        begin[at] = gone[at]
        spans = np.concatenate([[0], np.cumsum(begin)])
        rows, there = [], table.column("text").is_valid().to_pylist()
        for i, d in enumerate(table.column("doc").to_pylist()):
            a, b = offsets[i], offsets[i + 1]
            cutout = int(removed[b] - removed[a])
            kept = raw[a:b][~gone[a:b]].tobytes() if cutout else raw[a:b].tobytes()
            row = (d, int(b - a), cutout, int(spans[b] - spans[a]), hashlib.sha256(kept).hexdigest())
            rows.append((*row, kept.decode("utf-8", "ignore") if there[i] else None) if keep_text else row)
        out = _rows(rows, final)
        for i in range(len(carry)):
            out = out.append_column(f"carry_{i}", table.column(f"carry_{i}"))
        return out

    entries = x.groupBy("chunk").applyInArrow(one(first_digit), E_SQL)
    replies = entries.groupBy("bucket").applyInArrow(one(first_groups), R_SQL)
    entries = x.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(two(second_digits), E_SQL)
    replies = entries.groupBy("bucket").applyInArrow(one(second_groups), R_SQL)
    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    schema += "".join(f", carry_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    out = x.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(two(cut), schema)
    fixed = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * keep_text
    return out.select(F.col("doc").cast(kind).alias(id_col), *[F.col(c).alias(prefix + c) for c in fixed], *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)])


def _marks(place: np.ndarray, marked: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked neighbouring places of one document: first place, number, row."""
    p, r = place[marked], row[marked]
    head = np.ones(len(p), bool)
    head[1:] = (p[1:] != p[:-1] + 1) | (r[1:] != r[:-1])
    at = np.flatnonzero(head)
    return p[at], np.append(at[1:], len(p)) - at, r[at]
