"""The driver's tables in the roles of the data model, and the register of queries over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
#: Rows a task is meant to hold at once.
ROWS = 500_000


class Tables:
    """t.orders is the table; the methods are the roles."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def parts(self, *tables: str) -> int:
        """How many tasks work on all rows of the tables is dealt to: about ROWS rows each, so that a task's memory does not grow
        with the tables. Counts come from the files' footers."""
        return max(self.spark.sparkContext.defaultParallelism, -(-sum(getattr(self, t).count() for t in tables) // ROWS))

    def sales(self) -> DataFrame:
        """Line items with their customer, nation and part. Orders get their customers first: line items move for orders and
        parts only, dealt to as many tasks as they need."""
        n = self.parts("lineitem")
        known = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(self.nation), F.col("c_nationkey") == F.col("n_nationkey"))
        sold = self.lineitem.repartition(n, "l_orderkey").join(known, F.col("l_orderkey") == F.col("o_orderkey"))
        return sold.join(self.part.repartition(n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))

    def measurements(self) -> DataFrame:
        """cohort, sample, entity, value: log of spending of a customer on a brand; sums are in cents, so exact."""
        cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
        return self.sales().groupBy(F.col("n_name").alias("cohort"), F.col("c_custkey").alias("sample"), F.col("p_brand").alias("entity")).agg(F.log1p(cents / 100.0).alias("value"))

    def membership(self) -> DataFrame:
        """target, entity, weight: part types with their brands; the weight is the largest size."""
        return self.part.groupBy(F.col("p_type").alias("target"), F.col("p_brand").alias("entity")).agg(F.max("p_size").cast("double").alias("weight"))

    def patients(self) -> DataFrame:
        return self.customer.join(F.broadcast(self.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("cohort"), F.col("c_custkey").alias("sample"))


#: The same roles in SQL, for WITH clauses.
MEASUREMENTS = """m AS (SELECT n_name AS cohort, c_custkey AS sample, p_brand AS entity,
 ln(1 + sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0) AS value
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
MEMBERSHIP = "mem AS (SELECT p_type AS target, p_brand AS entity, CAST(max(p_size) AS DOUBLE) AS weight FROM part GROUP BY ALL)"
PATIENTS = "pat AS (SELECT n_name AS cohort, c_custkey AS sample FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def query(name: str, sql: str | None = None):
    """Registers a function of Tables; `sql` is the same result in DuckDB SQL."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add
