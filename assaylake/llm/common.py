"""What the operators of this subpackage share: the shared folder, written tables, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}

#: Arrow batches end at this size, so a run of very long texts can't fill a Python worker.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of our own only where that is unset, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-assaylake-")
    return f"file://{_own[app]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: cuts the lineage and outlives lost executors.

    Shuffle files of the job go as soon as the table is written; nothing reads them any more."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the time of the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that saved() wrote and that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def arrow(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes as well as by rows, and lets Python workers import this package where they see its folder."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def gathered(df: DataFrame) -> pa.Table:
    """The rows of df, which must be bounded, on the driver and in their order. They travel as compressed Arrow batches, so the
    driver's JVM, which holds results until Python has them, holds a part of their size."""
    arrow(df.sparkSession)

    def packed(batches):
        for b in batches:
            if b.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(b)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch"])

    parts = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in df.mapInArrow(packed, "batch binary").toArrow().column("batch")]
    return pa.concat_tables(parts) if parts else df.limit(0).toArrow()


def numbered_rows(rows: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """rows with a unique number in the order of key and text, also where a key repeats; equal rows are alike, so the numbers don't depend on how rows lie."""
    own = rows.withColumn("by_", F.xxhash64(text)).repartitionByRange(F.col(key), F.col("by_")).sortWithinPartitions(key, "by_", text)
    return own.withColumn(name, F.monotonically_increasing_id()).drop("by_")


def free(name: str, df: DataFrame) -> str:
    """name, or name with underscores added until df has no such column."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id as text: the contracts' fold rule."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def sampled(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About `bound` rows chosen by a hash of the key, all rows if there are fewer; the same rows for any partitioning."""
    n = df.count()
    if n <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < int(bound / n * (1 << 30)))
