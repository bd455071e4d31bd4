"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import discard, saved


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of it and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (any orderable type, u <> v). Returns node, root: the least node it can reach; nodes without edges have no row.

    Every round is a written table; the number of rounds grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    now, before = saved(edges.select("u", "v").where("u <> v").distinct(), "edges"), None
    while True:
        digest = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31)), F.bit_xor(F.xxhash64("v", "u"))).first())
        if digest == before or not digest[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = digest
        now, old = saved(_small(_large(now)), "edges"), now
        discard(old)
