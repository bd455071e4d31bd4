"""Activity of targets from their members' measurements, and scalings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.operators.windows import rank_percentile


def rank_mean(values: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """values: by, entity, value. members: target, entity, weight. Weighted mean rank percentile of the members that were measured."""
    ranks = values.select(*by, "entity", rank_percentile("value", by).alias("pct"))
    met = ranks.join(members, "entity")
    return met.groupBy(*by, "target").agg((F.sum(F.col("pct") * F.col("weight")) / F.sum("weight")).alias("score"), F.count("*").alias("members"))


def ssgsea(values: DataFrame, members: DataFrame, by: list[str], least: int = 2, power: float = 0.25) -> DataFrame:
    """Rank-weighted enrichment minus the mean outside the set, by the closed form of the walk's sum; ties by entity."""
    w = Window.partitionBy(*by)
    ranks = values.select(*by, "entity", F.row_number().over(w.orderBy("value", "entity")).alias("r"), F.count("*").over(w).alias("n"))
    r, n = F.col("r").cast("double"), F.first("n")
    size = F.count("*")
    score = F.sum(F.pow(r, F.lit(1 + power))) / F.sum(F.pow(r, F.lit(power))) - (n * (n + 1) / 2 - F.sum(r)) / F.nullif(n - size, F.lit(0))
    return ranks.join(members.select("target", "entity"), "entity").groupBy(*by, "target").agg(score.alias("score"), size.alias("members")).where(F.col("members") >= least)


def ucell(values: DataFrame, members: DataFrame, by: list[str], max_rank: int) -> DataFrame:
    """Capped-rank U statistic; members that weren't measured have the largest rank."""
    sizes = members.groupBy("target").agg(F.count("*").alias("m"))
    ranks = values.select(*by, "entity", F.least(F.rank().over(Window.partitionBy(*by).orderBy(F.desc("value"))), F.lit(max_rank)).alias("r"))
    got = ranks.join(members.select("target", "entity"), "entity").groupBy(*by, "target").agg(F.sum("r").alias("s"), F.count("*").alias("seen"))
    low = F.col("m") * (F.col("m") + 1) / 2
    u = F.col("s") + (F.col("m") - F.col("seen")) * max_rank - low
    return got.join(sizes, "target").withColumn("score", 1 - u / (F.col("m") * max_rank - low)).select(*by, "target", "score")


def zscore(df: DataFrame, by: list[str], value: str, train: Column, out: str = "z") -> DataFrame:
    """Mean and population deviation of the training rows, applied to all; a deviation of 0 counts as 1. A key without training rows is null."""
    fit = df.where(train).groupBy(*by).agg(F.avg(value).alias("m_"), F.stddev_pop(value).alias("s_"))
    return df.join(fit, by, "left").withColumn(out, (F.col(value) - F.col("m_")) / F.when(F.col("s_") > 1e-12, F.col("s_")).otherwise(F.when(F.col("s_").isNotNull(), 1.0))).drop("m_", "s_")


def program(values: DataFrame, weights: DataFrame, sample: str, train: Column, least: int = 5) -> DataFrame:
    """Training z-scores times signed weights over the root of their squares; fewer than `least` members: null."""
    z = zscore(values, ["entity"], "value", train)
    met = z.join(weights, "entity").where("z is not null")
    s = F.sum(F.col("z") * F.col("weight")) / F.sqrt(F.sum(F.col("weight") * F.col("weight")))
    return met.groupBy(sample, "target").agg(F.when(F.count("*") >= least, s).alias("score"), F.count("*").alias("members"))


def log_cpm(counts: DataFrame, sample: str, value: str, factor: str | None = None, prior: float = 0.5) -> DataFrame:
    """log2 counts per million of the library times its frozen factor, with a prior count scaled to the library."""
    lib = counts.groupBy(sample).agg((F.sum(value) * (F.first(factor) if factor else F.lit(1.0))).alias("lib_"))
    mean = lib.agg(F.avg("lib_").alias("mean_"))
    out = counts.join(lib, sample).join(F.broadcast(mean))
    p = prior * F.col("lib_") / F.col("mean_")
    return out.withColumn("logcpm", F.log2((F.col(value) + p) / (F.col("lib_") + 2 * p) * 1e6)).drop("lib_", "mean_")


def robust_z(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median and 1.4826 MAD; null where the MAD is 0."""
    med = df.groupBy(*by).agg(F.percentile(value, 0.5).alias("med_"))
    dev = df.join(med, by).withColumn("dev_", F.abs(F.col(value) - F.col("med_")))
    mad = dev.groupBy(*by).agg(F.percentile("dev_", 0.5).alias("mad_"))
    return dev.join(mad, by).withColumn("robust_z", (F.col(value) - F.col("med_")) / F.when(F.col("mad_") > 0, 1.4826 * F.col("mad_"))).drop("med_", "dev_", "mad_")


def region_means(probes: DataFrame, regions: DataFrame, by: list[str], probe: str, region: str, value: str, least: int) -> DataFrame:
    """Mean of a region's informative probes; null below `least` of them."""
    met = probes.join(regions, probe).groupBy(*by, region).agg(F.count(value).alias("informative"), F.avg(value).alias("mean"))
    return met.withColumn("mean", F.when(F.col("informative") >= least, F.col("mean")))


def source_means(values: DataFrame, labelled: DataFrame, patient: str, node: str, channel: str, value: str) -> DataFrame:
    """Mean and availability of each channel over patients that carry no label."""
    free = values.join(labelled.select(patient).distinct(), patient, "left_anti")
    return free.groupBy(node, channel).agg(F.avg(value).alias("mean"), F.count(value).alias("available"))


def centred_sites(sites: DataFrame, site: str, owner: str, sample: str, value: str) -> DataFrame:
    """Sites of one owner only, repeats averaged, minus the site's median."""
    n = sites.groupBy(site).agg(F.count_distinct(owner).alias("o_"), F.min(owner).alias(owner)).where("o_ = 1").drop("o_")
    one = sites.drop(owner).join(n, site).groupBy(site, owner, sample).agg(F.avg(value).alias("v_"))
    return one.join(one.groupBy(site).agg(F.percentile("v_", 0.5).alias("med_")), site).withColumn("centred", F.col("v_") - F.col("med_")).select(site, owner, sample, "centred")
