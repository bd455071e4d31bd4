"""Ranks, folds, top-k, multiple testing, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def folds(patients: DataFrame, cohort: str, patient: str, k: int, seed: str = "fold") -> DataFrame:
    """Adds fold: position mod k in the order of sha256(seed|cohort|patient) within the cohort."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col(cohort).cast("string"), F.col(patient).cast("string")), 256)
    return patients.withColumn("fold", (F.row_number().over(Window.partitionBy(cohort).orderBy(h, patient)) - 1) % k)


def outer_splits(assigned: DataFrame, k: int) -> DataFrame:
    """One row a patient and outer fold: split test, validation (the next fold) or train."""
    rows = assigned.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    split = F.when(F.col("fold") == F.col("outer_fold"), "test").when(F.col("fold") == (F.col("outer_fold") + 1) % k, "validation").otherwise("train")
    return rows.withColumn("split", split)


def average_rank(value: str, by: list[str]) -> Column:
    """Rank within the group, ties averaged."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def rank_percentile(value: str, by: list[str]) -> Column:
    return average_rank(value, by) / F.count("*").over(Window.partitionBy(*by))


def fold_percentile(order: list[Column], by: list[str]) -> Column:
    """1 - r / (n - 1) with r from 0; a single row has 1."""
    n = F.count("*").over(Window.partitionBy(*by))
    return F.when(n == 1, 1.0).otherwise(1 - (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / (n - 1))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int | Column, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def benjamini_hochberg(df: DataFrame, p: str, by: list[str], tie: list[str], total: Column | None = None, out: str = "q") -> DataFrame:
    """Adds adjusted p-values within the group: the least of p * m / rank over this and larger p, at most 1. m is the group's
    non-null p-values or `total`; null p stay null."""
    known = F.col(p).isNotNull() & ~F.isnan(p)
    m = F.count(F.when(known, 1)).over(Window.partitionBy(*by)) if total is None else total
    up = Window.partitionBy(*by).orderBy(F.when(known, 0).otherwise(1), p, *tie)
    step = df.withColumn("bh_", F.when(known, F.col(p) * m / F.row_number().over(up)))
    down = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return step.withColumn(out, F.when(known, F.least(F.lit(1.0), F.min("bh_").over(down)))).drop("bh_")


def tied_interval(df: DataFrame, score: str, by: list[str], k: int) -> DataFrame:
    """Adds rank_min, rank_max, rank_mid and the chance of being among the first k when ties are broken at random."""
    low = F.rank().over(Window.partitionBy(*by).orderBy(F.desc(score)))
    n = F.count("*").over(Window.partitionBy(*by, score))
    out = df.withColumns({"rank_min": low, "rank_max": low + n - 1})
    width = F.col("rank_max") - F.col("rank_min") + 1
    hit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (k - F.col("rank_min") + 1) / width))
    return out.withColumns({"rank_mid": (F.col("rank_min") + F.col("rank_max")) / 2, "hit_at_k": hit})


def leaderboard(scores: DataFrame, by: list[str], within: list[str], score: str, target: str) -> DataFrame:
    """by: the entity's key, within: its universe. .7 best + .3 mean of the best five; rank, size and best target."""
    ranked = scores.withColumn("r_", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), target)))
    best = ranked.groupBy(*by).agg(F.max(score).alias("best"), F.avg(F.when(F.col("r_") <= 5, F.col(score))).alias("mean5"), F.min_by(target, "r_").alias("top_target"))
    out = best.withColumn("score", 0.7 * F.col("best") + 0.3 * F.col("mean5"))
    others = [c for c in by if c not in within]
    return out.withColumns({"rank": F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("score"), *others)), "universe": F.count("*").over(Window.partitionBy(*within))})


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def islands(df: DataFrame, by: list[str], start: str, end: str, out: str = "island_") -> DataFrame:
    """Adds the number, within by, of the union of overlapping or touching half-open intervals that a row has part in."""
    before = F.max(end).over(Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    fresh = df.withColumn("new_", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    return fresh.withColumn(out, F.sum("new_").over(Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0))).drop("new_")


def merged_intervals(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """by, start, end of the unions of overlapping or touching half-open intervals."""
    return islands(df, by, start, end).groupBy(*by, "island_").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island_")


def reliability(df: DataFrame, probability: str, label: str, bins: int = 10) -> DataFrame:
    """bin, n, confidence, accuracy, gap over equal-width bins."""
    at = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    out = df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("confidence"), F.avg(F.col(label).cast("double")).alias("accuracy"))
    return out.withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))


def pair_sample(left: DataFrame, a: str, right: DataFrame, b: str, budget: int, stride: int) -> DataFrame:
    """Deterministic label-free pairs: the i-th of `budget` is entity i mod n and target (i * stride + i div n) mod m. Every
    entity is there once at least if budget >= n; a stride that shares no factor with m spreads over the targets."""
    index = lambda df, c: df.select(c).distinct().withColumn("i_", (F.row_number().over(Window.orderBy(c)) - 1).cast("long"))
    x, y = index(left, a), index(right, b)
    n, m = x.count(), y.count()
    if not n or not m:
        return x.select(a).join(y.select(b)).limit(0)
    i = left.sparkSession.range(min(budget, n * m)).select(F.col("id"), (F.col("id") % n).alias("x_"), ((F.col("id") * stride + F.floor(F.col("id") / n)) % m).alias("y_"))
    return i.join(x, i.x_ == x.i_).drop("i_").join(y, F.col("y_") == y.i_).select(a, b).distinct()
