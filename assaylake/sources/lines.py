"""Lines of text files with a stable identity: file and line number, for any split of the files.

Spark cuts files into blocks and reads each from start to end. A block's lines are numbered as they are read; how many lines the
earlier blocks of the file have, a sum by block tells. Both don't depend on which task reads a block, so a line keeps its number
under another split size, another cluster and a rerun. Compressed files are one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of a tab-separated variant file.
VARIANT = "chrom string, start long, end long, ref string, alt string, barcode string"


def placed(lines: DataFrame) -> DataFrame:
    """lines: a text source's, batch or stream. file, block (where it begins), value."""
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def numbered(lines: DataFrame) -> DataFrame:
    """lines: from placed. file, line (from 1), value."""

    def count(batches):
        now, n = None, 0
        for b in batches:
            files, blocks = b.column(0).to_pylist(), b.column(1).to_pylist()
            place = np.empty(b.num_rows, np.int64)
            for i, own in enumerate(zip(files, blocks)):
                if own != now:
                    now, n = own, 0
                n += 1
                place[i] = n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place)], ["file", "block", "value", "at"])

    own = lines.mapInArrow(count, "file string, block long, value string, at long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = own.groupBy("file", "block").agg(F.count("*").alias("n")).withColumn("before", before).select("file", "block", "before")
    return own.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("at")).alias("line"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return numbered(placed(spark.read.text(path)))


def variants(lines: DataFrame, header: bool = True) -> DataFrame:
    """lines: file, line, value of tab-separated variant files. The variant's columns, variant_id, source_file (its name), source_line;
    the first line of each file is its header. A line that doesn't parse has nulls."""
    body = lines.where("line > 1") if header else lines
    rows = body.select("file", "line", F.from_csv("value", VARIANT, {"sep": "\t"}).alias("v")).select("v.*", F.element_at(F.split("file", "/"), -1).alias("source_file"), F.col("line").alias("source_line"))
    ident = F.concat(F.lit("var:"), F.substring(F.sha2(F.concat_ws(":", "chrom", "start", "end", "ref", "alt"), 256), 1, 20))
    return rows.withColumn("variant_id", ident)
