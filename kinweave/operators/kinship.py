"""Kinship matrices (A2, J2, J3, N2): sums of z z' by chromosome, and leave-out matrices by subtraction.

A matrix of all samples is handled in tiles of ``TILE`` x ``TILE`` doubles, of
which the upper triangle is kept. A task multiplies its own variants with BLAS
and hands out the tiles of each chromosome it saw; tiles of one place are added
as they stream by, so no task holds more than one sum. Leaving chromosomes out
is a subtraction from the total of all chromosomes, tile by tile, so C folds
cost one pass over the variants. Only the task that decomposes a fold's matrix
holds it whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from kinweave.operators import linalg
from kinweave.sources.shared import materialize

TILE = 512
#: Pairs of samples: doubles of a block in bytes, blocks to a side that keep the tasks of a cluster busy, pairs handed out at once.
BLOCK_BYTES = 32 << 20
SPREAD = 16
STRIP = 1 << 18


def dosage_matrix(column: pa.Array, keep: np.ndarray | None = None) -> np.ndarray:
    """(variants, samples) doubles of a list column; NULL is NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    return x if keep is None else x[:, keep]


TILES = "chrom string, i int, j int, m long, k binary"


def chromosome_sums(variants: DataFrame, keep: np.ndarray | None = None) -> DataFrame:
    """chrom, i, j (i <= j), m (variants) and k (a tile of the sum of z z') of every chromosome."""
    kinds = pa.schema([("chrom", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("m", pa.int64()), ("k", pa.binary())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        counts: dict[str, int] = {}
        for batch in batches:
            chrom = np.array(batch.column(0).to_pylist())
            z = linalg.standardise(dosage_matrix(batch.column(1), keep))
            for c in np.unique(chrom):
                own = z[chrom == c]
                sums[c] = sums.get(c, 0) + own.T @ own
                counts[c] = counts.get(c, 0) + len(own)
        for c, s in sums.items():
            for i in range(0, len(s), TILE):
                js = range(i, len(s), TILE)
                tiles = [np.ascontiguousarray(s[i : i + TILE, j : j + TILE]).tobytes() for j in js]
                n = len(tiles)
                yield pa.record_batch([pa.array([c] * n), pa.array([i // TILE] * n, pa.int32()), pa.array([j // TILE for j in js], pa.int32()), pa.array([counts[c]] * n, pa.int64()), pa.array(tiles, pa.binary())], schema=kinds)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of runs of equal (i, j, chrom)."""
        key, m, total = None, 0, np.zeros(0)

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([key[2]]), pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([m], pa.int64()), pa.array([total.tobytes()], pa.binary())], schema=kinds)

        for batch in batches:
            for row in range(batch.num_rows):
                c, i, j, count = (batch.column(x)[row].as_py() for x in range(4))
                tile = np.frombuffer(batch.column(4)[row].as_buffer())
                if (i, j, c) != key:
                    if key is not None:
                        yield out()
                    key, m, total = (i, j, c), 0, np.zeros(len(tile))
                m += count
                total = total + tile
        if key is not None:
            yield out()

    rows = variants.select(F.col("chrom").cast("string").alias("chrom"), "dosage")
    return rows.mapInArrow(partial, TILES).repartition("i", "j", "chrom").sortWithinPartitions("i", "j", "chrom").mapInArrow(add, TILES)


def fold_tiles(sums: DataFrame, folds: dict[str, set[str]]) -> DataFrame:
    """fold, i, j, k: tiles of the kinship of each fold, given the chromosomes that it leaves out."""

    def subtract(table: pa.Table) -> pa.Table:
        chroms, counts = table.column("chrom").to_pylist(), table.column("m").to_pylist()
        tiles = [np.frombuffer(b.as_buffer()) for b in table.column("k").combine_chunks()]
        total, m = sum(tiles), sum(counts)
        out = []
        for out_of in folds.values():
            own = [x for x, c in enumerate(chroms) if c in out_of]
            left = m - sum(counts[x] for x in own)
            out.append(((total - sum(tiles[x] for x in own)) / left if own else total / left).tobytes())
        n = len(out)
        return pa.table({"fold": pa.array(list(folds)), "i": pa.array([table.column("i")[0].as_py()] * n, pa.int32()), "j": pa.array([table.column("j")[0].as_py()] * n, pa.int32()), "k": pa.array(out, pa.binary())})

    return sums.groupBy("i", "j").applyInArrow(subtract, "fold string, i int, j int, k binary")


def fold_factors(panel: DataFrame, folds: dict[str, set[str]]) -> DataFrame:
    """fold, chrom, variant_idx, dosage: the variants of each fold's kinship, given the chromosomes that it leaves out."""
    plan = panel.sparkSession.createDataFrame([(f, sorted(c)) for f, c in folds.items()], "fold string, out array<string>")
    return panel.select(F.col("chrom").cast("string").alias("chrom"), "variant_idx", "dosage").join(F.broadcast(plan), F.expr("NOT array_contains(out, chrom)"))


def assembled(table: pa.Table, n: int) -> np.ndarray:
    """The whole matrix of a fold from its tiles."""
    out = np.empty((n, n))
    for i, j, k in zip(table.column("i").to_pylist(), table.column("j").to_pylist(), table.column("k").combine_chunks(), strict=True):
        a, b = slice(i * TILE, min((i + 1) * TILE, n)), slice(j * TILE, min((j + 1) * TILE, n))
        tile = np.frombuffer(k.as_buffer()).reshape(a.stop - a.start, -1)
        out[a, b] = tile
        out[b, a] = tile.T
    return out


def pair_kinship(calls: DataFrame, loco: bool = False, digits: int | None = None) -> DataFrame:
    """A2, J2 on a long table: i, j (i <= j) and k, the mean product of standardised dosages over variants that both have; with ``loco`` also chrom, the chromosome left out, for those that both have (NULL where none is left). ``digits`` rounds k, halves away from 0.

    Samples are dealt into blocks, packed variant by variant; a task multiplies
    two blocks and hands out strips of their pairs. What travels is each packed
    block once for every block: few and large ones (``BLOCK_BYTES`` of doubles),
    but enough for ``SPREAD`` to a side.
    """
    from kinweave.operators.genotype import standardise

    types = dict(calls.dtypes)
    z = standardise(calls).where("iid IS NOT NULL AND variant_idx IS NOT NULL").select("iid", "variant_idx", "chrom", "z")
    own = z.groupBy("iid").agg(F.collect_list(F.struct("variant_idx", "chrom", "z")).alias("s"))
    own = materialize(own.select("iid", F.col("s.variant_idx").alias("v"), F.col("s.chrom").alias("c"), F.col("s.z").alias("z")), "samples")
    got = own.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("m")).first()
    n_blocks = max(1, -(-got.n // max(TILE, min(BLOCK_BYTES // (8 * (got.m or 1)), -(-got.n // SPREAD)))))

    def flat(column: pa.ChunkedArray) -> np.ndarray:
        return pa.concat_arrays([x.flatten() for x in column.chunks]).to_numpy(zero_copy_only=False)

    def packed(x: np.ndarray) -> pa.Array:
        return pa.array([pa.compress(np.ascontiguousarray(x.T), codec="zstd", asbytes=True)], pa.binary())

    def pack(table: pa.Table) -> pa.Table:
        n = table.num_rows
        v, first, at = np.unique(flat(table.column("v")), return_index=True, return_inverse=True)
        at = at + np.repeat(np.arange(n), pa.compute.list_value_length(table.column("v")).to_numpy()) * len(v)
        seen = np.bincount(at, minlength=n * len(v)).reshape(n, -1)
        z = np.bincount(at, flat(table.column("z")), n * len(v)).reshape(n, -1)
        lists = [pa.array([x], t) for x, t in ((table.column("iid").combine_chunks(), blocks_of.field("iid").type), (v, blocks_of.field("v").type), (flat(table.column("c"))[first], blocks_of.field("c").type))]
        return pa.table([table.column("block")[:1], *lists, packed(z), pa.nulls(1, pa.binary()) if (seen == 1).all() else packed(seen.astype(float))], schema=blocks_of)

    def unpacked(blob: bytes | None, n: int, own: np.ndarray, names: np.ndarray) -> np.ndarray:
        """(samples, names) of a packed block; what it lacks is 0."""
        x = np.ones((len(own), n)) if blob is None else np.frombuffer(pa.decompress(blob, 8 * n * len(own), codec="zstd")).reshape(len(own), n)
        if len(own) == len(names):
            return x.T
        out = np.zeros((len(names), n))
        out[np.searchsorted(names, own)] = x
        return out.T

    def multiply(one: dict, two: dict, same: bool) -> Iterator[pa.RecordBatch]:
        sides = [(b["iid"], b["v"].to_numpy(zero_copy_only=False), b["c"].to_numpy(zero_copy_only=False), b["z"], b["seen"]) for b in (one, two)]
        names, first = np.unique(np.concatenate([s[1] for s in sides]), return_index=True)
        chrom = np.concatenate([s[2] for s in sides])[first]
        za, zb = (unpacked(x, len(ids), v, names) for ids, v, _, x, _ in sides)
        full = all(s[4] is None and len(s[1]) == len(names) for s in sides)
        ma, mb = (None, None) if full else (unpacked(m, len(ids), v, names) for ids, v, _, _, m in sides)
        places = [(c, np.flatnonzero(chrom == c)) for c in np.unique(chrom)] if loco else []
        parts = [(c, za[:, p], zb[:, p].T, float(len(p)), *((None, None) if full else (ma[:, p], mb[:, p].T))) for c, p in places]
        (left, right), n = (sides[0][0], sides[1][0]), len(zb)
        step = max(1, STRIP // n)
        for at in range(0, len(za), step):
            rows = slice(at, min(at + step, len(za)))
            start = at if same else 0  # pairs before the strip's own samples are those of other strips
            total = za[rows] @ zb[start:].T
            every = float(len(names)) if full else ma[rows] @ mb[start:].T
            upper = np.arange(start, n) >= np.arange(rows.start, rows.stop)[:, None] if same else None
            for c, sa, sb, m, na, nb in parts or [(None, None, None, 0.0, None, None)]:
                if loco:
                    m = m if full else na[rows] @ nb[:, start:]
                    with np.errstate(all="ignore"):
                        k = (total - sa[rows] @ sb[:, start:]) / (every - m)
                else:
                    with np.errstate(all="ignore"):
                        k = total / every
                keep = upper
                if not full:
                    both = (m if loco else every) > 0
                    keep = both if keep is None else keep & both
                if keep is None:
                    k, i, j = k.ravel(), np.repeat(np.arange(rows.start, rows.stop), n), np.tile(np.arange(n), rows.stop - rows.start)
                else:
                    i, j = np.nonzero(keep)
                    k, i, j = k[keep], i + rows.start, j + start
                if digits is not None:
                    k = np.trunc(k * 10.0**digits + np.copysign(np.nextafter(0.5, 0), k)) / 10.0**digits + 0.0
                whole = np.isfinite(k)
                part = [left.take(pa.array(i)), right.take(pa.array(j)), pa.array(k, mask=None if whole.all() else ~whole)]
                yield pa.record_batch([pa.array(np.full(len(k), c), kinds.field("chrom").type), *part] if loco else part, schema=kinds)

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        return pa.table(one.columns + two.columns, schema=pairs_of) if one.num_rows and two.num_rows else pairs_of.empty_table()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one, two = ({x: batch.column(x + end)[row] for x in ("iid", "v", "c", "z", "seen")} for end in ("", "_"))
                for b in (one, two):
                    b |= {x: b[x].values for x in ("iid", "v", "c")} | {x: b[x].as_py() for x in ("z", "seen")}
                yield from multiply(one, two, batch.column("a")[row].as_py() == batch.column("b")[row].as_py())

    schema = (f"chrom {types['chrom']}, " if loco else "") + f"i {types['iid']}, j {types['iid']}, k double"
    held = {"iid": f"array<{types['iid']}>", "v": f"array<{types['variant_idx']}>", "c": f"array<{types['chrom']}>", "z": "binary", "seen": "binary"}
    block = ", ".join(f"{x} {kind}" for x, kind in {"block": "int", **held}.items())
    pair = ", ".join(f"{x}{end} {kind}" for end in ("", "_") for x, kind in {"a": "int", "b": "int", **held}.items())
    kinds, blocks_of, pairs_of = (to_arrow_schema(_parse_datatype_string(x)) for x in (schema, block, pair))
    blocks = own.withColumn("block", F.pmod(F.xxhash64("iid"), F.lit(n_blocks)).cast("int")).groupBy("block").applyInArrow(pack, block)
    left = blocks.select(F.col("block").alias("a"), F.explode(F.sequence("block", F.lit(n_blocks - 1))).alias("b"), *held)
    right = blocks.select(F.explode(F.sequence(F.lit(0), "block")).alias("a_"), F.col("block").alias("b_"), *[F.col(x).alias(f"{x}_") for x in held])
    # By number: few and small rows would else be put together into few tasks, whose results are large.
    tasks = n_blocks * (n_blocks + 1) // 2
    rows = left.repartition(tasks, "a", "b").groupBy("a", "b").cogroup(right.repartition(tasks, "a_", "b_").groupBy("a_", "b_")).applyInArrow(meet, pair).mapInArrow(pairs, schema)
    return rows.select(*(["chrom"] if loco else []), F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "k")
