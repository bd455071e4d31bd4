"""Checks that report instead of failing; each rule is one aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_report(df: DataFrame, key: list[str]) -> DataFrame:
    """rows, null_keys, repeated_keys."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    per = df.groupBy(*key).agg(F.count("*").alias("times_"))
    return per.agg(F.coalesce(F.sum("times_"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(missing, F.col("times_"))), F.lit(0)).alias("null_keys"), F.count_if((F.col("times_") > 1) & ~missing).alias("repeated_keys"))


def domain_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, violations: rows for which the rule isn't true."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def coverage(left: DataFrame, right: DataFrame, key: list[str], least: float) -> DataFrame:
    """matched, total, fraction, passed."""
    seen = left.join(right.select(*key).distinct().withColumn("hit_", F.lit(1)), key, "left")
    out = seen.agg(F.count("hit_").alias("matched"), F.count("*").alias("total"))
    return out.withColumn("fraction", F.col("matched") / F.col("total")).withColumn("passed", F.col("fraction") >= least)


def leaks(df: DataFrame, unit: str, fold: str) -> DataFrame:
    return df.groupBy(unit).agg(F.count_distinct(fold).alias("folds")).where("folds > 1")


def table_hash(df: DataFrame) -> DataFrame:
    """rows and two digests that don't depend on the order of rows; doubles are rounded to 12 places."""
    flat = [F.round(c, 12) if t in ("double", "float") else F.col(c) for c, t in sorted(df.dtypes)]
    h = F.xxhash64(*flat)
    return df.select(h.alias("h")).agg(F.count("*").alias("rows"), F.bit_xor("h").alias("xor"), F.sum(F.pmod("h", F.lit(1 << 31))).alias("sum"))


def availability(df: DataFrame, value: Column, reasons: list[tuple[Column, str]]) -> DataFrame:
    """value_ and reason_: the first reason whose condition holds; null with a value, never zero for missing."""
    reason = reduce(lambda acc, r: acc.when(*r), reasons[1:], F.when(*reasons[0]))
    return df.withColumn("reason_", reason).withColumn("value_", F.when(F.col("reason_").isNull(), value))


def forbidden_columns(df: DataFrame, roles: dict[str, str], forbidden: set[str]) -> list[str]:
    """Columns whose declared role is forbidden, or that have none."""
    return sorted(c for c in df.columns if roles.get(c, "undeclared") in forbidden | {"undeclared"})
