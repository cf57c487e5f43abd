"""Phenotype preparation (F2-F8, N15, N16, W1, A3, A9, A13) on long tables: iid, pheno_idx, pheno, value or text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.special import norm_ppf_col

#: Words of text phenotypes on a no < partial < yes scale; words of a tier are synonyms.
TIERS = (
    ("0", "absent", "f", "false", "low", "n", "neg", "negative", "no", "non", "none", "wild type", "wt"),
    ("inter", "intermediate", "leaky", "maybe", "medium", "mid", "mixed", "partial", "some", "variable", "weak"),
    ("1", "high", "mutant", "pos", "positive", "present", "t", "true", "y", "yes"),
)


def average_rank(phenos: DataFrame, ties: str = "average") -> DataFrame:
    """rank and n of every value that isn't NULL within its phenotype."""
    own = Window.partitionBy("pheno_idx").orderBy("value")
    same = Window.partitionBy("pheno_idx", "value")
    every = Window.partitionBy("pheno_idx")
    rows = phenos.where(F.col("value").isNotNull())
    rank, size = F.rank().over(own), F.count(F.lit(1)).over(same)
    by = {"average": rank + (size - 1) / 2, "min": rank, "max": rank + size - 1, "ordinal": F.row_number().over(Window.partitionBy("pheno_idx").orderBy("value", "iid")), "dense": F.dense_rank().over(own)}
    return rows.withColumn("rank", by[ties].cast("double")).withColumn("n_obs", F.count(F.lit(1)).over(every))


def rank_normalise(phenos: DataFrame, c: float = 3 / 8, ties: str = "average") -> DataFrame:
    """Value becomes the normal quantile of (rank - c) / (n - 2c + 1); NULL stays NULL."""
    ranked = average_rank(phenos, ties)
    done = ranked.withColumn("value", norm_ppf_col((F.col("rank") - c) / (F.col("n_obs") - 2 * c + 1))).drop("rank", "n_obs")
    return done.unionByName(phenos.where(F.col("value").isNull()))


def level_counts(phenos: DataFrame) -> DataFrame:
    """pheno_idx, pheno, levels and rarest (count of the rarest level)."""
    per = phenos.where(F.col("value").isNotNull()).groupBy("pheno_idx", "pheno", "value").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("pheno_idx", "pheno").agg(F.count(F.lit(1)).alias("levels"), F.min("n").alias("rarest"))


def discrete_mask(phenos: DataFrame, most: int = 3) -> DataFrame:
    """phenotypes of 2 to ``most`` levels."""
    return level_counts(phenos).withColumn("discrete", F.col("levels").between(2, most))


def degenerate(phenos: DataFrame, least: int = 10) -> DataFrame:
    """F8: fewer than two levels, or a rarest level of fewer than ``least`` samples."""
    return level_counts(phenos).withColumn("degenerate", (F.col("levels") < 2) | (F.col("rarest") < least))


def one_vs_rest(phenos: DataFrame, *, mark: str = "_", book: DataFrame | None = None) -> DataFrame:
    """0/1 indicators of each level (of two levels only the higher); missing stays missing.

    An indicator is named after its phenotype, ``mark`` and the level, or, where
    ``book`` (pheno, code, label) knows the level, two underscores and the label
    with characters that don't suit file names as underscores.
    """
    levels = phenos.where(F.col("value").isNotNull()).select("pheno_idx", "pheno", F.col("value").alias("level")).distinct()
    every = Window.partitionBy("pheno_idx")
    levels = levels.withColumn("k", F.row_number().over(every.orderBy("level"))).withColumn("n", F.count(F.lit(1)).over(every)).where("n > 2 OR k = n")
    number = F.when(F.col("level") == F.floor("level"), F.col("level").cast("bigint").cast("string")).otherwise(F.col("level").cast("string"))
    tag = F.concat(F.lit(mark), F.replace(number, F.lit("-"), F.lit("m")))
    if book is not None:
        labels = F.broadcast(book.select("pheno", F.col("code").cast("double").alias("level"), "label").dropDuplicates(["pheno", "level"]))
        levels = levels.join(labels, ["pheno", "level"], "left")
        tag = F.coalesce(F.concat(F.lit("__"), F.regexp_replace("label", r"[^\w.-]+", "_")), tag)
    rows = phenos.join(levels.withColumn("tag", tag).drop("pheno", "label"), "pheno_idx")
    return rows.select("iid", "pheno_idx", "pheno", F.concat(F.col("pheno"), F.col("tag")).alias("indicator"), F.when(F.col("value").isNotNull(), (F.col("value") == F.col("level")).cast("int")).alias("value"))


def parse_levels(spec: str) -> dict[str, list[str]]:
    """'column=low,high;other=a,b,c'."""
    out = {}
    for part in filter(None, (p.strip() for p in spec.split(";"))):
        name, eq, labels = part.partition("=")
        found = [x.strip().lower() for x in labels.split(",") if x.strip()]
        if not eq or len(found) < 2 or len(set(found)) != len(found):
            raise ValueError(f"levels need 'column=label,label': {part!r}")
        out[name.strip()] = found
    return out


def text_codes(texts: DataFrame, levels: dict[str, list[str]] | None = None) -> DataFrame:
    """Pheno, label, code, n, how (numeric, explicit, tiers or alphabetical) of text phenotypes, a row a label.

    A phenotype whose texts are all numbers is numeric; one with an explicit
    order takes it; one within the tiers takes the tiers that occur, counted
    from 0; any other is coded in alphabetical order and is unordered.
    """
    levels = levels or {}
    label = F.lower(F.trim("text"))
    seen = texts.where(F.col("text").isNotNull()).groupBy("pheno", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    tier = F.coalesce(*[F.when(F.col("label").isin(*words), F.lit(i)) for i, words in enumerate(TIERS)])
    given = F.coalesce(*[F.when((F.col("pheno") == c) & (F.col("label") == v), F.lit(i)) for c, vs in levels.items() for i, v in enumerate(vs)], F.lit(None).cast("int"))
    every = Window.partitionBy("pheno")
    rows = seen.withColumn("tier", tier).withColumn("given", given)
    rows = rows.withColumn("numeric", F.min(F.col("label").try_cast("double").isNotNull()).over(every)).withColumn("tiered", F.min(F.col("tier").isNotNull()).over(every))
    explicit = F.col("pheno").isin(*levels) if levels else F.lit(False)
    how = F.when(explicit, "explicit").when(F.col("numeric"), "numeric").when(F.col("tiered"), "tiers").otherwise("alphabetical")
    rows = rows.withColumn("how", how)
    order = F.dense_rank().over(every.orderBy("order")) - 1
    rows = rows.withColumn("order", F.when(F.col("how") == "explicit", F.lpad(F.col("given").cast("string"), 6, "0")).when(F.col("how") == "tiers", F.col("tier").cast("string")).otherwise(F.col("label"))).withColumn("code", order.cast("double"))
    rows = rows.withColumn("code", F.when(F.col("how") == "numeric", F.col("label").try_cast("double")).otherwise(F.col("code")))
    return rows.select("pheno", "label", "code", "n", "how", (explicit & F.col("given").isNull()).alias("unlisted"))


def encode(texts: DataFrame, codes: DataFrame) -> DataFrame:
    """Values of text phenotypes by their codes; refuses labels that an explicit order leaves out."""
    left_out = [f"{r.pheno}={r.label}" for r in codes.where("unlisted").limit(5).collect()]
    if left_out:
        raise ValueError(f"labels without a place in the given order: {', '.join(left_out)}")
    own = codes.select("pheno", F.col("label").alias("l"), F.col("code").alias("value"))
    rows = texts.withColumn("l", F.lower(F.trim("text"))).join(F.broadcast(own), ["pheno", "l"], "left")
    return rows.select("iid", "pheno_idx", "pheno", "value")


def na_groups(phenos: DataFrame) -> DataFrame:
    """A3: pheno_idx, pheno, pattern (code of the set of samples without a value), missing and kept."""
    gone = F.array_sort(F.collect_list(F.when(F.col("value").isNull(), F.col("iid").cast("string"))))
    per = phenos.groupBy("pheno_idx", "pheno").agg(gone.alias("gone"), F.count("value").alias("kept"))
    return per.select("pheno_idx", "pheno", F.md5(F.array_join("gone", ",").cast("binary")).alias("pattern"), F.size("gone").cast("long").alias("missing"), "kept")


def prepare(phenos: DataFrame, *, missing_code: float | None = None, categorical: tuple[str, ...] = (), rint: bool = True, rint_discrete: bool = True, ties: str = "average", flags: bool = False, book: DataFrame | None = None) -> DataFrame:
    """F7, in order: missing code, one-vs-rest, discrete mask, guard against -9, rank normalisation of what isn't raw.

    Indicators stay raw, and with ``rint_discrete`` off all discrete phenotypes.
    Without a missing code, -9 in a discrete phenotype that stays untransformed
    would be read as a level and is refused. ``flags`` adds the column raw.
    """
    if missing_code is not None:
        phenos = phenos.withColumn("value", F.when(F.col("value") != missing_code, F.col("value")))
    if categorical:
        lacking = sorted(set(categorical) - {r.pheno for r in phenos.select("pheno").distinct().collect()})
        if lacking:
            raise ValueError(f"no phenotype is named {', '.join(lacking)}")
        ones = one_vs_rest(phenos.where(F.col("pheno").isin(*categorical)), mark="__lvl", book=book).select("iid", "pheno_idx", F.col("indicator").alias("pheno"), F.col("value").cast("double").alias("value"), F.lit(True).alias("raw"))
        phenos = phenos.where(~F.col("pheno").isin(*categorical)).select("iid", "pheno_idx", "pheno", "value", F.lit(False).alias("raw")).unionByName(ones)
        # Column numbers after the expansion; the table of names is small.
        names = phenos.select("pheno_idx", "pheno").distinct().withColumn("new", F.row_number().over(Window.orderBy("pheno_idx", "pheno")) - 1)
        if names.groupBy("pheno").count().where("count > 1").limit(1).count():
            raise ValueError("an indicator has the name of another phenotype")
        phenos = phenos.join(F.broadcast(names), ["pheno_idx", "pheno"]).select("iid", F.col("new").alias("pheno_idx"), "pheno", "value", "raw")
    else:
        phenos = phenos.select("iid", "pheno_idx", "pheno", "value", F.lit(False).alias("raw"))
    discrete = discrete_mask(phenos).select("pheno_idx", "discrete")
    phenos = phenos.join(F.broadcast(discrete), "pheno_idx", "left").withColumn("discrete", F.coalesce("discrete", F.lit(False)))
    if not rint_discrete:
        phenos = phenos.withColumn("raw", F.col("raw") | F.col("discrete"))
    untouched = F.col("discrete") if not rint else F.col("discrete") & F.col("raw")
    if missing_code is None:
        bad = [r.pheno for r in phenos.where((F.col("value") == -9) & untouched).select("pheno").distinct().limit(5).collect()]
        if bad:
            raise ValueError(f"discrete phenotypes hold -9, which would be read as a level: {', '.join(bad)}; name it as the missing code")
    phenos = phenos.drop("discrete")
    if rint:
        done = rank_normalise(phenos.where("NOT raw"), ties=ties)
        phenos = done.unionByName(phenos.where("raw"))
    return phenos if flags else phenos.drop("raw")
