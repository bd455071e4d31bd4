"""Single-cell style tables: summaries, metacells, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.scalars import safe_corr


def type_summary(df: DataFrame, entity: str, kind: str, donor: str, value: str) -> DataFrame:
    """entity, kind, detection, mean, donors and the entity's tau over kinds."""
    by = df.groupBy(entity, kind).agg(F.avg((F.col(value) > 0).cast("double")).alias("detection"), F.avg(value).alias("mean"), F.count_distinct(donor).alias("donors"))
    top = by.groupBy(entity).agg(F.max("mean").alias("top_"), F.count("*").alias("k_"), F.sum("mean").alias("s_"))
    tau = F.when((F.col("k_") > 1) & (F.col("top_") > 0), (F.col("k_") - F.col("s_") / F.col("top_")) / (F.col("k_") - 1))
    return by.join(top, entity).select(entity, kind, "detection", "mean", "donors", tau.alias("tau"))


def metacells(counts: DataFrame, cell: str, group: str, entity: str, value: str, scale: float = 1e4) -> DataFrame:
    """Sums of a metacell's cells, to `scale` a library, log1p."""
    s = counts.groupBy(group, entity).agg(F.sum(value).alias("n_"), F.count_distinct(cell).alias("cells"))
    lib = s.groupBy(group).agg(F.sum("n_").alias("lib_"))
    return s.join(lib, group).select(group, entity, "cells", F.log1p(F.col("n_") / F.col("lib_") * scale).alias("value"))


def feature_vectors(df: DataFrame, key: list[str], kind: str, kinds: list, rho: str, q: str) -> DataFrame:
    """Per declared kind rho, |rho|, -log10 q and availability, in columns; another kind raises."""
    odd = df.where(~F.col(kind).isin(kinds)).limit(1).collect()
    if odd:
        raise ValueError(f"undeclared kind {odd[0][kind]!r}")
    pick = lambda k, c: F.max(F.when(F.col(kind) == k, c))
    cols = []
    for k in kinds:
        cols += [pick(k, F.col(rho)).alias(f"{k}_rho"), pick(k, F.abs(rho)).alias(f"{k}_abs"), pick(k, -F.log10(F.greatest(F.col(q), F.lit(1e-300)))).alias(f"{k}_q"), F.coalesce(F.bool_or(F.col(kind) == k), F.lit(False)).alias(f"{k}_available")]
    return df.groupBy(*key).agg(*cols)


def paired_contexts(left: DataFrame, right: DataFrame, keys: DataFrame, on: list[str], x: str, y: str) -> DataFrame:
    out = keys.join(left, on, "left").join(right, on, "left")
    return out.withColumn("reason", F.when(F.col(x).isNull() & F.col(y).isNull(), "neither").when(F.col(x).isNull(), "no_expression").when(F.col(y).isNull(), "no_activity"))


def coverage_counts(df: DataFrame, cohort: str, entity: str) -> DataFrame:
    """cohorts, union, intersection and the spread of detected entities a cohort."""
    seen = df.select(cohort, entity).distinct()
    per = seen.groupBy(cohort).agg(F.count("*").alias("n"))
    each = seen.groupBy(entity).agg(F.count("*").alias("c"))
    k = per.agg(F.count("*").alias("cohorts"), F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"), F.avg("n").alias("mean"), F.max("n").alias("most"))
    both = each.join(F.broadcast(k.select("cohorts"))).agg(F.count("*").alias("union"), F.count_if(F.col("c") == F.col("cohorts")).alias("intersection"))
    return k.join(both)


def donor_effects(df: DataFrame, by: list[str], donor: str, x: str, y: str, least: int) -> DataFrame:
    """Correlation within each donor, then the unweighted Fisher-z mean, its t and direction consistency over donors."""
    per = df.groupBy(*by, donor).agg(safe_corr(x, y).alias("r"), F.count("*").alias("n")).where((F.col("n") >= least) & F.col("r").isNotNull() & ~F.isnan("r"))
    z = F.atanh(F.least(F.greatest(F.col("r"), F.lit(-0.999999)), F.lit(0.999999)))
    out = per.withColumn("z_", z).groupBy(*by).agg(F.count("*").alias("donors"), F.avg("z_").alias("m_"), F.stddev_samp("z_").alias("s_"), F.avg((F.col("z_") > 0).cast("double")).alias("up_"))
    return out.select(*by, "donors", F.tanh("m_").alias("effect"), F.when(F.col("s_") > 1e-12, F.col("m_") / (F.col("s_") / F.sqrt("donors"))).alias("t"), F.greatest("up_", 1 - F.col("up_")).alias("consistency"))
