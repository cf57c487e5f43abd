"""Sinks (K1-K15): tables as TSV or Parquet, bundles, codebooks and run records."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column order of a result table; a bundle adds threshold and significant, and clumping LDGroup.
GWAS_COLUMNS = ("sid_index", "SNP", "Chr", "GenDist", "ChrPos", "PValue", "SnpWeight", "SnpWeightSE", "EffectSize", "SnpFractVarExpl", "Mixing", "Nullh2", "Pheno", "PhenoCount")


def write_tsv(df: DataFrame, path: str) -> None:
    """K1: unquoted, tab-separated, with a header."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a path, local or remote."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = file_system(spark, path)
    return fs.exists(place)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, place = file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(place)) if fs.exists(place) else []


def move(spark: SparkSession, old: str, new: str) -> None:
    """Renames a file or folder; what was there goes first."""
    fs, source = file_system(spark, old)
    _, target = file_system(spark, new)
    fs.mkdirs(target.getParent())
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"cannot rename {old} to {new}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, place = file_system(spark, path)
    fs.mkdirs(place.getParent())
    out = fs.create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file of the driver; Spark's own readers pass over names that begin with a dot."""
    fs, place = file_system(spark, path)
    stream = fs.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_file(df: DataFrame, path: str) -> None:
    """K1, K7: a small table as one tab-separated file of exactly this name."""
    spark, part = df.sparkSession, f"{path}.part"
    write_tsv(df.coalesce(1), part)
    (name,) = [x for x in children(spark, part) if x.startswith("part-")] or [None]
    move(spark, f"{part}/{name}", path)
    fs, place = file_system(spark, part)
    fs.delete(place, True)


def write_bundle(results: DataFrame, path: str, parts: int | None = None, *, append: bool = False) -> None:
    """K3: a Parquet folder ordered by phenotype and p-value, so row-group statistics prune by phenotype. ``append`` adds a batch to it; its schema must be the same."""
    spark = results.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if append and exists(spark, path) and [(f.name, f.dataType) for f in spark.read.parquet(path).schema] != [(f.name, f.dataType) for f in results.schema]:
        raise ValueError(f"{path}: its columns differ from those to append")
    results.repartitionByRange(n, "Pheno", "PValue").sortWithinPartitions("Pheno", F.col("PValue").asc_nulls_last()).write.mode("append" if append else "overwrite").parquet(path)


def write_named(rows: DataFrame, outdir: str, file: str, *, by: str = "Pheno", drop: bool = False, order: str | None = "PValue", compress: bool = False) -> None:
    """<outdir>/<phenotype>/<file> for each phenotype, tab-separated with a header; ``{}`` in the name stands for the phenotype.

    Tasks write the rows, one file a phenotype; the driver only renames files.
    """
    from urllib.parse import unquote

    spark, part = rows.sparkSession, f"{outdir}/.{file.replace('{}', 'x')}.part"
    rows = rows.withColumn("folder", F.regexp_replace(by, "/", "_"))
    rows = rows.drop(by) if drop else rows
    dealt = rows.repartition("folder")
    dealt = dealt.sortWithinPartitions("folder", F.col(order).asc_nulls_last()) if order else dealt
    out = dealt.write.mode("overwrite").partitionBy("folder").option("sep", "\t").option("header", True).option("quote", "")
    (out.option("compression", "gzip") if compress else out).csv(part)
    for folder in children(spark, part):
        if not folder.startswith("folder="):
            continue
        name = unquote(folder.removeprefix("folder="))
        for k, x in enumerate(x for x in children(spark, f"{part}/{folder}") if x.startswith("part-")):
            if k:
                raise OSError(f"{name}: more than one file")
            move(spark, f"{part}/{folder}/{x}", f"{outdir}/{name}/{file.format(name)}")
    fs, place = file_system(spark, part)
    fs.delete(place, True)


def write_per_pheno(results: DataFrame, minima: DataFrame, thresholds: DataFrame, outdir: str, inflation: DataFrame | None = None) -> None:
    """K2: gwas.tsv, perms.tsv, threshold.txt and, where ``inflation`` is given, lambda_gc.txt of each phenotype.

    minima: Pheno and perm_min_p; thresholds: Pheno and threshold.
    """
    spark = results.sparkSession
    extra = [c for c in results.columns if c == "LDGroup"]
    write_named(results.select(*GWAS_COLUMNS, *extra), outdir, "gwas.tsv")
    write_named(minima.select("Pheno", "perm_min_p"), outdir, "perms.tsv", drop=True, order=None)
    for r in thresholds.collect():  # a row a phenotype
        write_text(spark, f"{outdir}/{r.Pheno.replace('/', '_')}/threshold.txt", f"{r.threshold:.6e}\n")
    for r in inflation.collect() if inflation is not None else ():
        write_text(spark, f"{outdir}/{r.Pheno.replace('/', '_')}/lambda_gc.txt", f"{r.LambdaGC:.6f}\n")


def write_pairs(table: DataFrame, outdir: str, *, parquet: bool = False) -> None:
    """The pair table of each phenotype, and where a threshold is known that and the pairs below it."""
    spark = table.sparkSession
    own = table.select(*[c for c in table.columns if c not in ("Pheno", "threshold", "signif")], "Pheno")
    if parquet:
        own.repartition("Pheno").sortWithinPartitions("rank").write.mode("overwrite").option("compression", "zstd").partitionBy("Pheno").parquet(f"{outdir}/tier2")
    else:
        write_named(own, outdir, "{}.tier2.first_assoc.txt.gz", order="rank", compress=True)
    known = table.where(F.col("threshold").isNotNull())
    for r in known.select("Pheno", "threshold").distinct().collect():
        write_text(spark, f"{outdir}/{r.Pheno.replace('/', '_')}/{r.Pheno.replace('/', '_')}.threshold.txt", f"x\n{r.threshold}\n")
    write_named(known.where("signif").select(*own.columns), outdir, "{}.signif_pairs.txt", order="rank")


def merge_bundles(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Shards together; refuses none, or schemas that differ."""
    if not paths:
        raise ValueError("no shard to merge")
    schemas = [spark.read.parquet(p).schema for p in paths]
    for p, schema in zip(paths, schemas, strict=True):
        if schema != schemas[0]:
            raise ValueError(f"{p}: its schema differs from that of {paths[0]}")
    return spark.read.schema(schemas[0]).parquet(*paths)


def bundle_from_tree(spark: SparkSession, outdir: str) -> DataFrame:
    """K4: the bundle's rows from a tree of gwas.tsv and threshold.txt files."""
    from kinweave.sources import files

    rows = files.read_gwas_tree(spark, outdir)
    limits = files.read_threshold(spark, outdir).select(F.col("pheno").alias("folder"), "threshold")
    out = rows.join(F.broadcast(limits), "folder", "left").withColumn("significant", F.coalesce(F.col("PValue") < F.col("threshold"), F.lit(False)))
    extra = [c for c in rows.columns if c == "LDGroup"]
    return out.select(*GWAS_COLUMNS, "threshold", "significant", *extra)


def gather_shards(spark: SparkSession, outdir: str, target: str) -> int:
    """K5: the parts of all shards become one bundle folder; files move, rows are not rewritten. Number of shards."""
    top = f"{outdir}/.bundle_parts"
    shards = [x for x in children(spark, top) if x.startswith("shard") and x.endswith(".parquet")]
    if not shards:
        return 0
    merge_bundles(spark, [f"{top}/{x}" for x in shards])  # refuses parts that differ
    stage = f"{target}.part"
    fs, place = file_system(spark, stage)
    fs.delete(place, True)
    for shard in shards:
        for x in children(spark, f"{top}/{shard}"):
            if x.endswith(".parquet"):
                move(spark, f"{top}/{shard}/{x}", f"{stage}/{shard.removesuffix('.parquet')}-{x}")
    move(spark, stage, target)
    fs.delete(file_system(spark, top)[1], True)
    return len(shards)


def merge_inflation(shards: list[DataFrame]) -> DataFrame:
    """K8: inflation tables of all shards in the order of phenotypes."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return out.orderBy("PhenoIndex")


def wide_matrix(phenos: DataFrame) -> DataFrame:
    """K6: transformed phenotypes in the layout of the input, a column a phenotype in index order."""
    names = [r.pheno for r in phenos.select("pheno_idx", "pheno").distinct().orderBy("pheno_idx").collect()]
    return phenos.groupBy(F.col("iid").alias("Strain")).pivot("pheno", names).agg(F.first("value"))


def write_json(spark: SparkSession, path: str, record: dict) -> None:
    """A small record of the driver, written whole to a new name that then takes the old one's place in one step."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(record | {"ts": time.time()}, sort_keys=True).encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(part, target, options)


def run_record(spark: SparkSession, arguments: dict) -> dict:
    """What is needed to repeat a run."""
    conf = dict(spark.sparkContext.getConf().getAll())
    keep = ("spark.master", "spark.app.id", "spark.executor.memory", "spark.sql.shuffle.partitions")
    return {"spark": spark.version, "arguments": arguments, "conf": {k: conf[k] for k in keep if k in conf}}
