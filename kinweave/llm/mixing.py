"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

Sources, in code-point order with null last, weigh 1, 2, 3, repeating, and
share all words of the input; no source gets more than ``CAP`` times its own
words, and what it cannot take is shared again by weight among the others.

A source takes every document floor(target / size) times and, for the rest of
its target, once more the documents whose hash lies below a threshold. The
threshold is found without sorting documents: words are summed by source and
the leading bits of the hash, the bucket in which the running sum passes the
budget is the boundary, and only its documents are summed again by the next
bits. Four levels of 12 bits leave one id in the last bucket; where several
rows share it (equal or null ids) four more levels go by a hash of the text.
The last bucket is taken if that brings the sum nearer to the budget.

Defined results: null text has size 0 and is taken 0 times; a null source is
a source of its own; an empty table gives an empty table; a null id hashes as
the empty string; rows with equal ids and texts are taken alike. Only the named
columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
WEIGHTS = (1, 2, 3)
#: Buckets of a source are at most 2**BITS a level.
BITS, LEVELS = 12, 4
#: Up to so many sources their table (about 60 bytes a row) is broadcast; beyond it is joined by key.
SMALL_SOURCES = 100_000


def size_of(text: Column) -> Column:
    """Words of a text, as runs of characters between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column, seed: str = "mix") -> Column:
    """48 bits of the id's MD5, the same in every engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def text_hash_of(text: Column) -> Column:
    """48 bits of the text's MD5; null is empty. Orders rows of one id."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """src, source_size, target, full (whole passes over the source) and rest (words of one more, partial pass), a row a source.

    ``sizes`` has src and source_size. A source is capped when its share at the
    common rate is above the cap. In the order of cap by weight the capped ones
    come first, so one running sum finds the rate, as a quotient of integers.
    """
    order = Window.orderBy(F.col("src").isNull(), "src")
    s = sizes.withColumn("n", F.row_number().over(order))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("n") - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")
    s = s.withColumn("w", weight).withColumn("top", F.lit(CAP) * F.col("source_size"))
    all_rows = Window.partitionBy()
    before = Window.orderBy(F.col("top") / F.col("w"), "n").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns(
        {
            "num": F.sum("source_size").over(all_rows) - F.coalesce(F.sum("top").over(before), F.lit(0)),
            "den": F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        }
    )
    open_ = F.when(F.col("num") * F.col("w") <= F.col("top") * F.col("den"), F.struct(F.col("top") / F.col("w"), "n", "num", "den"))
    s = s.withColumn("rate", F.min(open_).over(all_rows))
    share = F.col("rate.num") * F.col("w")
    target = F.when(share > F.col("top") * F.col("rate.den"), F.col("top").cast("double")).otherwise(share.cast("double") / F.col("rate.den").cast("double"))
    s = s.withColumn("target", F.coalesce(target, F.lit(0.0)))
    full = F.when(F.col("source_size") > 0, F.least(F.lit(CAP), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0)).cast("long")
    s = s.withColumn("full", full)
    return s.select("src", "source_size", "target", "full", F.greatest(F.lit(0.0), F.col("target") - F.col("full") * F.col("source_size")).alias("rest"))


def source_key(source: Column) -> Column:
    """A source as a join key; null is a source of its own."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> tuple[DataFrame, DataFrame, bool]:
    """Narrow rows (mix_id, k, size, h, g); the plan, a row a source: k, source_size, target, full, and the hashes below which documents go in once more; whether the plan is small enough to broadcast."""
    rows = docs.select(F.col(id_col).alias("mix_id"), F.col(source_col).alias("src"), size_of(F.col(text_col)).alias("size"), hash_of(F.col(id_col), seed).alias("h"), text_hash_of(F.col(text_col)).alias("g"))
    rows = materialize(rows, "mix-sizes").withColumn("k", source_key(F.col("src")))
    plan = source_targets(rows.groupBy("src").agg(F.sum("size").alias("source_size")))
    plan = materialize(plan.withColumn("k", source_key(F.col("src"))).drop("src"), "mix-targets")
    small = plan.count() <= SMALL_SOURCES

    def near(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    def boundary(own: DataFrame, budget: DataFrame, key: str) -> DataFrame:
        """k, b, rest, words, many: the value of ``key`` at which the running sum passes the budget, what is left of it there, the words at that value and whether several rows have them."""
        cut, found = own.select("k", key, "size").join(near(budget), "k"), None
        for level in range(LEVELS):
            shift = (LEVELS - 1 - level) * BITS
            by = cut.groupBy("k", "rest", F.shiftright(key, shift).alias("b")).agg(F.sum("size").alias("words"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
            by = by.withColumn("upto", F.sum("words").over(Window.partitionBy("k").orderBy("b")))
            edge = by.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
            found = edge.select("k", "b", (F.col("rest") - (F.col("upto") - F.col("words"))).alias("rest"), "words", (F.col("n") > 1).alias("many"))
            if level < LEVELS - 1:
                cut = own.select("k", key, "size", F.shiftright(key, shift).alias("b")).join(near(found.drop("words", "many")), ["k", "b"]).drop("b")
        return found

    # The last bucket goes in if its words overshoot by less than they would be missed.
    limit = F.when(F.col("words") - F.col("rest") < F.col("rest"), F.col("b") + 1).otherwise(F.col("b"))
    by_id = materialize(boundary(rows, plan.select("k", "rest").where("rest > 0"), "h"), "mix-boundary")
    edges = by_id.where("NOT many").select("k", limit.alias("below"), F.lit(None).cast("long").alias("at_id"), F.lit(None).cast("long").alias("below_text"))
    shared = by_id.where("many")
    if not shared.isEmpty():
        inside = rows.join(near(shared.select("k", F.col("b").alias("h"))), ["k", "h"])
        by_text = boundary(inside, shared.select("k", "rest"), "g").select("k", limit.alias("below_text"))
        edges = edges.unionByName(shared.join(by_text, "k").select("k", F.col("b").alias("below"), F.col("b").alias("at_id"), "below_text"))
    plan = plan.join(near(edges), "k", "left")
    return rows, materialize(plan.drop("rest"), "mix-plan"), small


def passes(h: Column, g: Column) -> Column:
    """How often a document is taken, given its hashes and its source's row of the plan."""
    return (F.col("full") + F.when((h < F.col("below")) | (h == F.col("at_id")) & (g < F.col("below_text")), 1).otherwise(0)).cast("long")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", **options: str) -> DataFrame:
    """id, size, source_size, target and taken of every row."""
    rows, plan, small = mix_plan(docs, id_col=id_col, **options)
    out = rows.join(F.broadcast(plan) if small else plan, "k")
    return out.select(F.col("mix_id").alias(id_col), "size", "source_size", "target", (F.col("size") * passes(F.col("h"), F.col("g"))).cast("long").alias("taken"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its own columns."""
    _, plan, small = mix_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed)
    plan = plan.select(F.col("k").alias("mix_k"), "full", "below", "at_id", "below_text")
    own = docs.withColumn("mix_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("mix_row", source_key(F.col(source_col)).alias("mix_k"), hash_of(F.col(id_col), seed).alias("mix_h"), text_hash_of(F.col(text_col)).alias("mix_g"))
    out = own.join(F.broadcast(plan) if small else plan, "mix_k")
    return out.withColumn("mix_times", passes(F.col("mix_h"), F.col("mix_g"))).where("mix_times > 0").select("mix_row", F.explode(F.sequence(F.lit(1), F.col("mix_times")))).select("mix_row.*")


SQL = r"""
WITH rows AS (
  SELECT doc_id, source AS src,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h,
         CAST('0x' || substr(md5(coalesce(text, '')), 1, 12) AS BIGINT) AS g
  FROM documents),
sizes AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY src IS NULL, src) AS n FROM rows GROUP BY src),
weighed AS (SELECT *, (n - 1) % 3 + 1 AS w, 3 * source_size AS top FROM sizes),
summed AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(top) OVER b, 0) AS BIGINT) AS num,
         CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS BIGINT) AS den
  FROM weighed WINDOW b AS (ORDER BY top / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rate AS (SELECT num AS rnum, den AS rden FROM summed WHERE num * w <= top * den ORDER BY top / w, n LIMIT 1),
plan0 AS (SELECT src, source_size, CASE WHEN rnum * w > top * rden THEN CAST(top AS DOUBLE) ELSE CAST(rnum * w AS DOUBLE) / CAST(rden AS DOUBLE) END AS target FROM summed, rate),
plan1 AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS passes FROM plan0),
plan2 AS (SELECT *, greatest(0.0, target - passes * source_size) AS rest FROM plan1),
run AS (
  SELECT r.src, r.h, r.g, p.rest, sum(r.size) AS words, sum(sum(r.size)) OVER (PARTITION BY r.src ORDER BY r.h, r.g) AS upto
  FROM rows r JOIN plan2 p ON r.src IS NOT DISTINCT FROM p.src WHERE p.rest > 0 GROUP BY r.src, r.h, r.g, p.rest),
edge AS (
  SELECT src, h, CASE WHEN upto - rest < rest - (upto - words) THEN g + 1 ELSE g END AS below
  FROM run WHERE upto > rest AND upto - words <= rest)
SELECT r.doc_id, r.size, p.source_size, p.target, CAST(r.size * (p.passes + CASE WHEN r.h < e.h OR (r.h = e.h AND r.g < e.below) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rows r JOIN plan2 p ON r.src IS NOT DISTINCT FROM p.src LEFT JOIN edge e ON r.src IS NOT DISTINCT FROM e.src
"""
