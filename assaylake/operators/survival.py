"""Survival: log-rank, Kaplan-Meier, one-step Cox, concordance. One row a patient and entity: group, time, event, high or value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def median_split(df: DataFrame, entity: list[str], value: str) -> DataFrame:
    m = df.groupBy(*entity).agg(F.percentile(value, 0.5).alias("med_"))
    return df.join(m, entity).withColumn("high", F.col(value) >= F.col("med_")).drop("med_")


def risk_table(df: DataFrame, by: list[str], time: str, event: str, **sums) -> DataFrame:
    """by, time, deaths, at_risk and, for each name, its sum over those at risk (`name_r`) and dying (`name_d`)."""
    at = df.groupBy(*by, time).agg(F.sum(event).alias("deaths"), F.count("*").alias("leaving"), *[F.sum(c).alias(f"{n}_l") for n, c in sums.items()], *[F.sum(c * F.col(event)).alias(f"{n}_d") for n, c in sums.items()])
    later = Window.partitionBy(*by).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumns({"at_risk": F.sum("leaving").over(later), **{f"{n}_r": F.sum(f"{n}_l").over(later) for n in sums}})


def logrank(df: DataFrame, by: list[str], time: str, event: str, high: str) -> DataFrame:
    """observed, expected, variance, chi2 of the high group; null chi2 with a reason where it can't be computed."""
    r = risk_table(df, by, time, event, high=F.col(high).cast("int")).where("deaths > 0")
    n, d, h = F.col("at_risk"), F.col("deaths"), F.col("high_r")
    var = F.when(n > 1, d * (h / n) * (1 - h / n) * (n - d) / (n - 1)).otherwise(0.0)
    out = r.groupBy(*by).agg(F.sum("high_d").alias("observed"), F.sum(d * h / n).alias("expected"), F.sum(var).alias("variance"))
    ok = F.col("variance") > 1e-12
    return out.withColumn("chi2", F.when(ok, F.pow(F.col("observed") - F.col("expected"), 2) / F.col("variance"))).withColumn("reason", F.when(~ok, "no_variance"))


def kaplan_meier(df: DataFrame, by: list[str], time: str, event: str, horizons: list[float]) -> DataFrame:
    """by, horizon, survival, at_risk (still there at the horizon), events up to it."""
    r = risk_table(df, by, time, event)
    up = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    hazard = F.when(F.col("deaths") < F.col("at_risk"), F.log1p(-F.col("deaths") / F.col("at_risk"))).otherwise(-1e9)
    steps = r.withColumn("logs_", F.sum(hazard).over(up)).withColumn("cum_", F.sum("deaths").over(up))
    grid = steps.withColumn("horizon", F.explode(F.array(*[F.lit(float(h)) for h in horizons])))
    past = F.col(time) <= F.col("horizon")
    return grid.groupBy(*by, "horizon").agg(
        F.coalesce(F.exp(F.max_by(F.when(past, F.col("logs_")), F.when(past, F.col(time)))), F.lit(1.0)).alias("survival"),
        F.coalesce(F.sum(F.when(F.col(time) >= F.col("horizon"), F.col("leaving"))), F.lit(0)).alias("at_risk"), F.coalesce(F.sum(F.when(past, F.col("deaths"))), F.lit(0)).alias("events"),
    )


def cox_one_step(df: DataFrame, by: list[str], time: str, event: str, value: str) -> DataFrame:
    """Score over information at 0 with Breslow ties: beta, se, z."""
    x = F.col(value)
    r = risk_table(df, by, time, event, x=x, xx=x * x).where("deaths > 0")
    mean = F.col("x_r") / F.col("at_risk")
    out = r.groupBy(*by).agg(F.sum(F.col("x_d") - F.col("deaths") * mean).alias("u"), F.sum(F.col("deaths") * (F.col("xx_r") / F.col("at_risk") - mean * mean)).alias("i"), F.sum("deaths").alias("events"))
    ok = F.col("i") > 1e-12
    return out.select(*by, "events", F.when(ok, F.col("u") / F.col("i")).alias("beta"), F.when(ok, 1 / F.sqrt("i")).alias("se"), F.when(ok, F.col("u") / F.sqrt("i")).alias("z"))


def concordance(df: DataFrame, by: list[str], time: str, event: str, risk: str) -> DataFrame:
    """Harrell's C. Pairs meet within `by` (a bounded cohort), the earlier side being an event; equal risks count a half."""
    a = df.where(F.col(event) == 1).select(*by, F.col(time).alias("t1"), F.col(risk).alias("r1"))
    b = df.select(*by, F.col(time).alias("t2"), F.col(risk).alias("r2")).groupBy(*by, "t2", "r2").agg(F.count("*").alias("n2"))
    a = a.groupBy(*by, "t1", "r1").agg(F.count("*").alias("n1"))
    w = F.col("n1") * F.col("n2")
    out = a.join(b, by).where("t1 < t2").groupBy(*by).agg(F.sum(w).alias("pairs"), F.sum(w * F.when(F.col("r1") > F.col("r2"), 1.0).when(F.col("r1") == F.col("r2"), 0.5).otherwise(0.0)).alias("good"))
    return out.select(*by, "pairs", (F.col("good") / F.col("pairs")).alias("c_index"))


def replication(df: DataFrame, effect: str, ref: str, p: str, c: str):
    same = F.signum(effect) == F.signum(ref)
    return F.when(F.col(p).isNull(), "not_tested").when(same & (F.col(p) < 0.05) & (F.col(c) >= 0.55), "replicated").when(same & (F.col(p) < 0.1), "suggestive").when(~same & (F.col(p) < 0.05), "opposite").otherwise("not_replicated")


def geometric_priority(functional, clinical):
    """Geometric mean of two scores; one alone is halved; neither: null."""
    return F.when(functional.isNotNull() & clinical.isNotNull(), F.sqrt(functional * clinical)).otherwise(0.5 * F.coalesce(functional, clinical))
