"""Scans and sinks. Identifiers are read as strings; schemas are given, never inferred, for text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.sources.lines import read_lines, variants


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where=None) -> DataFrame:
    """A Parquet file or partitioned folder; columns and filters reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = True, comment: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema).option("sep", sep).option("header", header).option("mode", "FAILFAST")
    return (reader.option("comment", comment) if comment else reader).csv(path)


def stack(frames: list[DataFrame]) -> DataFrame:
    """Union by name over the union of columns, with the file each row came from."""
    named = [f.withColumn("_source_path", F.col("_metadata.file_path")) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def gmt(spark: SparkSession, path: str) -> DataFrame:
    """set, description, member, rank."""
    cells = spark.read.text(path).where("trim(value) <> ''").select(F.split("value", "\t").alias("c"))
    long = cells.select(F.col("c")[0].alias("set"), F.col("c")[1].alias("description"), F.posexplode(F.slice("c", F.lit(3), F.greatest(F.size("c") - 2, F.lit(0)))).alias("pos", "member"))
    return long.where("member <> ''").select("set", "description", "member", (F.col("pos") + 1).alias("rank"))


def write_gmt(members: DataFrame, path: str, name: str, description: str, member: str, rank: str) -> None:
    lines = members.groupBy(name, description).agg(F.transform(F.array_sort(F.collect_list(F.struct(rank, member))), lambda x: x[member]).alias("m"))
    lines.select(F.concat_ws("\t", name, description, F.array_join("m", "\t"))).write.mode("overwrite").text(path)


def gtf(spark: SparkSession, path: str, features: tuple[str, ...] = ("gene", "transcript", "exon")) -> DataFrame:
    """chrom, feature, start, end (0-based half-open), strand, gene_id, transcript_id, gene_name."""
    c = spark.read.text(path).where("not value like '#%'").select(F.split("value", "\t").alias("c")).where(F.size("c") >= 9)
    attribute = lambda k: F.nullif(F.regexp_extract(F.col("c")[8], rf'{k} "([^"]*)"', 1), F.lit(""))
    rows = c.select(F.col("c")[0].alias("chrom"), F.col("c")[2].alias("feature"), (F.col("c")[3].cast("long") - 1).alias("start"), F.col("c")[4].cast("long").alias("end"), F.col("c")[6].alias("strand"), *[attribute(k).alias(k) for k in ("gene_id", "transcript_id", "gene_name")])
    return rows.where(F.col("feature").isin(*features))


def bed(spark: SparkSession, path: str, more: str = "") -> DataFrame:
    return delimited(spark, path, f"chrom string, start long, end long{', ' + more if more else ''}", header=False, comment="#")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """header, sequence: records begin at > ; line breaks in a sequence go."""
    r = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    return r.select(F.trim(F.substring_index("value", "\n", 1)).alias("header"), F.upper(F.regexp_replace(F.expr("substr(value, instr(value, '\\n') + 1)"), r"\s", "")).alias("sequence"))


def maf(spark: SparkSession, path: str, authority: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and quarantined variants of a tab-separated file: chrom, start, end, ref, alt, barcode. authority: patient."""
    raw = variants(read_lines(spark, path))
    source = F.concat_ws("#", "source_file", F.col("source_line").cast("string"))
    rows = raw.withColumns({"source_row": source, "patient": F.substring("barcode", 1, 12)}).join(authority.select("patient", F.lit(True).alias("known_")).distinct(), "patient", "left")
    reason = F.when((F.col("start") < 1) | (F.col("end") < F.col("start")) | F.col("start").isNull(), "bad_interval").when(F.col("known_").isNull(), "unknown_patient")
    rows = rows.withColumn("reason", reason).drop("known_")
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def to_long(df: DataFrame, entity: str, name: str = "sample", value: str = "value") -> DataFrame:
    """Entities by samples to (entity, sample, value), without the missing ones."""
    return df.unpivot([entity], [c for c in df.columns if c != entity], name, value).where(F.col(value).isNotNull())


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """zstd Parquet by partition; only the partitions that df has are replaced."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(by).parquet(path)


def write_ordered(df: DataFrame, path: str, order: list[str]) -> None:
    """Totally ordered files: ranges over the files, sorted within each."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
