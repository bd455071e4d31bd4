"""Incremental jobs: new files are worked off once, results are replaced by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assaylake.operators.genome import segment_calls
from assaylake.operators.joins import as_of
from assaylake.sources.lines import numbered, placed, variants


def _kept(batch: DataFrame, number: int, path: str, by: str) -> DataFrame:
    """Writes a batch's rows under their partition and batch number, and gives all rows that the batch's partitions have up to it.
    A batch that runs again replaces its own rows, so none is kept twice."""
    spark = batch.sparkSession
    touched = [r[0] for r in batch.select(by).distinct().collect()]
    batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by, "batch").parquet(path)
    kept = spark.read.schema(batch.withColumn("batch", F.lit(number)).schema).parquet(path)
    return kept.where(F.col(by).isin(touched) & (F.col("batch") <= number)).drop("batch")


def segment_stream(spark: SparkSession, incoming: str, schema: str, entities: DataFrame, out: str, checkpoint: str, ledger: str | None = None, files: int = 4) -> StreamingQuery:
    """STR-01. Segment files (patient, chrom, start, end, value) to entity calls (entities: entity, chrom, mid). Segments are kept
    in the ledger by patient; a batch's patients are called again from all their segments and their partitions overwritten, so
    a patient split over files and batches, and a batch that runs again, leave what one run over all files leaves. The patients
    of a batch are named to the reader of the ledger: as many as `files` files bring."""

    def work(batch: DataFrame, number: int) -> None:
        segments = _kept(batch, number, ledger or f"{out.rstrip('/')}-segments", "patient").distinct()
        points = entities.crossJoin(segments.select("patient").distinct())
        mapped = as_of(points, segments, ["patient", "chrom"], "mid", "start", "end", ["value"])
        calls = segment_calls(mapped, ["patient", "entity"], "value", 0.3, -0.3)
        calls.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("patient").parquet(out)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(incoming)
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Partitions of the event ledger and of its counts.
BUCKETS = 64


def event_ledger(spark: SparkSession, incoming: str, schema: str, key: str, at: str, delay: str, group: list[str], out: str, checkpoint: str, ledger: str | None = None, files: int = 4) -> StreamingQuery:
    """STR-02. Events are kept once by id in a ledger, in buckets of their group; groups that a batch touches are counted again
    from the ledger (their buckets' rows only) and replace what was there. `out` has group, n, first and last time, by bucket.

    Late events count like others: nothing is told from a watermark. Events of one id have one group and lie `delay` apart at
    most, so duplicates are searched for among the ledger's rows of that time only; an id again after that is another event.
    A batch that runs again, or events dealt to batches in another way, give the same table."""

    def work(batch: DataFrame, number: int) -> None:
        path = ledger or f"{out.rstrip('/')}-ledger"
        # The first batch of a fresh ledger has nothing before it.
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*group), F.lit(BUCKETS)).cast("int"))
        low, high = rows.agg(F.min(at) - F.expr(f"interval {delay}"), F.max(at) + F.expr(f"interval {delay}")).first()
        if low is None:
            return
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
            known = spark.read.schema(rows.withColumn("batch", F.lit(number)).schema).parquet(path).where((F.col("batch") < number) & F.col(at).between(low, high))
            rows = rows.join(known.select("bucket", key).distinct(), ["bucket", key], "left_anti")
        rows = rows.dropDuplicates([key]).select(*batch.columns, "bucket")
        counts = _kept(rows, number, path, "bucket").groupBy("bucket", *group).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
        counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(out)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(incoming)
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def variant_stream(spark: SparkSession, incoming: str, out: str, checkpoint: str, per_trigger: int = 1) -> StreamingQuery:
    """STR-03. Delimited variant files, a few a trigger, with their variant id, file and line: the same for any split size, trigger
    or rerun. A batch's rows are a partition of their own, which it replaces if it runs again."""

    def work(batch: DataFrame, number: int) -> None:
        rows = variants(numbered(batch)).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    lines = placed(spark.readStream.option("maxFilesPerTrigger", per_trigger).text(incoming))
    return lines.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
