"""Evidence supports, scores, ledgers and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions.scalars import clip, minus_log10, stable_id


def expression_summary(df: DataFrame, by: list[str], sample: str, value: str, n_samples: Column) -> DataFrame:
    """Exact quantiles, moments and detection; n_samples is the cohort's size."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_distinct(sample).alias("samples"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.25).alias("q25"),
        F.percentile(value, 0.75).alias("q75"), F.var_samp(value).alias("variance"), (F.count_if(F.col(value) > 0) / F.first(n_samples)).alias("detection_rate"),
    )


def bulk_support(df: DataFrame, by: list[str], effect: str, fdr: str, target: str) -> DataFrame:
    """Largest |effect| weighted by -log10 FDR / 10 (at most 1), the effect of largest size, the least FDR, distinct targets."""
    weight = F.abs(effect) * clip(minus_log10(F.col(fdr)) / 10, 0.0, 1.0)
    return df.groupBy(*by).agg(F.max(weight).alias("support"), F.max_by(effect, F.struct(F.abs(effect), F.col(effect))).alias("effect"), F.min(fdr).alias("min_fdr"), F.count_distinct(target).alias("targets"))


def signed_support(effect: Column, q: Column) -> Column:
    return F.tanh(F.abs(effect)) * clip(minus_log10(q) / 10, 0.0, 1.0)


def cell_support(df: DataFrame, by: list[str], effect: str, q: str, patients: str, status: str, bulk_sign: str, tiers: dict[str, float]) -> DataFrame:
    """Signed support, saturating in patients, halved against the bulk sign, scaled by the replication tier."""
    tier = F.coalesce(*[F.when(F.col(status) == k, F.lit(v)) for k, v in tiers.items()], F.lit(0.0))
    match = F.when(F.signum(effect) == F.col(bulk_sign), 1.0).otherwise(0.5)
    s = signed_support(F.col(effect), F.col(q)) * F.least(F.lit(1.0), F.log1p(patients) / F.log1p(F.lit(20.0))) * match * tier
    return df.groupBy(*by).agg(F.max(s).alias("support"))


def interaction_support(df: DataFrame, by: list[str], event: str, assay: str, levels: list[tuple[str, float]], default: float) -> DataFrame:
    """log1p of distinct events, saturating at 10, times the best assay level."""
    low = F.lower(assay)
    level = reduce(lambda acc, r: acc.when(low.rlike(r[0]), r[1]), levels[1:], F.when(low.rlike(levels[0][0]), levels[0][1])).otherwise(default)
    out = df.groupBy(*by).agg(F.count_distinct(event).alias("events"), F.max(level).alias("level"))
    return out.withColumn("support", F.least(F.lit(1.0), F.log1p("events") / F.log1p(F.lit(10.0))) * F.col("level"))


def drug_support(hits: DataFrame, by: list[str], status: str, effect: str, overlap: str, tiers: dict[str, float]) -> DataFrame:
    """Replication tier (single-resource effects are damped by tanh), times the overlap of targets, saturating at 3; the best of a pair."""
    tier = F.coalesce(*[F.when(F.col(status) == k, F.lit(v)) for k, v in tiers.items()], 0.5 * F.tanh(F.abs(effect)))
    return hits.groupBy(*by).agg(F.max(tier * F.least(F.lit(1.0), F.col(overlap) / 3)).alias("support"), F.array_join(F.array_sort(F.collect_set(status)), ";").alias("statuses"))


def fused_score(df: DataFrame, supports: dict[str, float], directions: list[str], strong: float, weak: float) -> DataFrame:
    """score: mean of the supports there are, weighted, times 0.75 + 0.25 * share of agreeing directions. label and missing sources."""
    there = sum(F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in supports.items())
    total = sum(F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in supports.items())
    known = sum((F.coalesce(F.col(d), F.lit(0)) != 0).cast("int") for d in directions)
    agree = F.when(known > 0, F.abs(sum(F.coalesce(F.col(d), F.lit(0)) for d in directions)) / known).otherwise(1.0)
    score = F.when(there > 0, total / there * (0.75 + 0.25 * agree))
    missing = F.concat_ws(";", *[F.when(F.col(c).isNull(), c) for c in supports])
    return df.withColumns({"score": score, "missing": missing}).withColumn("label", F.when(F.col("score") >= strong, "strong").when(F.col("score") >= weak, "weak").otherwise("unlabeled"))


def contributions(parts: dict[str, DataFrame], pair: list[str], support: str) -> DataFrame:
    stacked = reduce(DataFrame.unionByName, [df.select(*pair, F.lit(n).alias("source"), F.col(support).alias("support")) for n, df in parts.items()])
    return stacked.groupBy(*pair, "source").agg(F.max("support").alias("support"))


def fold_consensus(df: DataFrame, by: list[str], fold: str, direction: str, probability: str, percentile: str, folds: int) -> DataFrame:
    """The direction of most folds (then probability, then name); selection frequency, stability and means over agreeing folds."""
    votes = df.groupBy(*by, direction).agg(F.count_distinct(fold).alias("votes"), F.sum(probability).alias("weight"), F.avg(probability).alias("probability"), F.avg(percentile).alias("percentile"))
    w = Window.partitionBy(*by)
    out = votes.withColumns({"all_": F.sum("votes").over(w), "r_": F.row_number().over(w.orderBy(F.desc("votes"), F.desc(F.round("weight", 9)), direction))}).where("r_ = 1")
    return out.select(*by, direction, "votes", (F.col("votes") / folds).alias("frequency"), (F.col("votes") / F.col("all_")).alias("stability"), "probability", "percentile")


def leave_one_out(df: DataFrame, key: list[str], cohort: str, effect: str, weight: Column) -> DataFrame:
    """For each row the meta features of the other cohorts: totals of the key minus the row's own; cohorts are unique in a key."""
    z = F.atanh(F.least(F.greatest(F.col(effect), F.lit(-0.999)), F.lit(0.999)))
    rows = df.withColumns({"z_": z, "w_": weight, "p_": (F.col(effect) > 0).cast("int")})
    all_ = Window.partitionBy(*key)
    less = lambda c: F.sum(c).over(all_) - c
    n, w, wz, wzz, pos = less(F.lit(1)), less(F.col("w_")), less(F.col("w_") * F.col("z_")), less(F.col("w_") * F.col("z_") * F.col("z_")), less(F.col("p_"))
    out = rows.withColumns({"others": n, "sw_": w, "swz_": wz, "swzz_": wzz, "pos_": pos})
    mean = F.when(F.col("others") > 0, F.col("swz_") / F.col("sw_"))
    q = F.when(F.col("others") > 0, F.greatest(F.lit(0.0), F.col("swzz_") - F.col("swz_") * F.col("swz_") / F.col("sw_")))
    return out.select(*key, cohort, "others", F.tanh(mean).alias("mean_effect"), q.alias("q"), F.when(q > 1e-12, F.greatest(F.lit(0.0), 1 - (F.col("others") - 1) / q)).otherwise(0.0).alias("i2"), F.when(F.col("others") > 0, F.greatest("pos_", F.col("others") - F.col("pos_")) / F.col("others")).alias("consistency"))


def recurrence(df: DataFrame, pair: list[str], target: str, cohort: str, label: str, k: float) -> DataFrame:
    """(positives + k * target prevalence) / (cohorts + k)."""
    prior = df.groupBy(target).agg(F.avg(F.col(label).cast("double")).alias("prior"))
    n = df.groupBy(*pair).agg(F.sum(label).alias("positives"), F.count_distinct(cohort).alias("cohorts"))
    return n.join(prior, target).withColumn("recurrence", (F.col("positives") + k * F.col("prior")) / (F.col("cohorts") + k))


def two_level_mean(df: DataFrame, outer: list[str], inner: list[str], value: str, least: int) -> DataFrame:
    """Mean within the inner units, then over them; null with a reason below `least` units."""
    unit = df.groupBy(*outer, *inner).agg(F.avg(value).alias("u_"))
    out = unit.groupBy(*outer).agg(F.avg("u_").alias("mean"), F.stddev_samp("u_").alias("sd"), F.count("u_").alias("units"), F.avg(F.greatest("u_", F.lit(0.0))).alias("positive"), F.avg(F.greatest(-F.col("u_"), F.lit(0.0))).alias("negative"))
    return out.withColumn("reason", F.when(F.col("units") < least, "too_few_units")).withColumn("mean", F.when(F.col("reason").isNull(), F.col("mean")))


def canonical_experiments(df: DataFrame, parts: list[str], anchor: str, source: str, record: str) -> DataFrame:
    """Rows with one anchor and equal parts are one experiment, without an anchor each row is its own."""
    loose = F.concat(F.lit("row:"), F.col(record).cast("string"))
    key = F.when(F.col(anchor).isNotNull(), stable_id("exp", F.col(anchor), *[F.col(p) for p in parts])).otherwise(loose)
    return df.withColumn("experiment", key).groupBy("experiment").agg(F.count("*").alias("records"), F.count_distinct(source).alias("sources"), F.array_join(F.array_sort(F.collect_set(F.col(source).cast("string"))), ";").alias("source_list"), F.min(record).alias("first_record"))


def duplicate_report(df: DataFrame, key: list[str], source: str, top: int) -> DataFrame:
    out = df.groupBy(*key).agg(F.count_distinct(source).alias("sources"), F.count("*").alias("rows")).where("sources > 1")
    return out.orderBy(F.desc("sources"), F.desc("rows"), *key).limit(top)


def relationships(facts: DataFrame, by: list[str], counts: dict[str, str], occurrence: str) -> DataFrame:
    """Facts, occurrences and distinct non-empty values of each listed column."""
    return facts.groupBy(*by).agg(F.count("*").alias("facts"), F.sum(occurrence).alias("occurrences"), *[F.count_distinct(F.nullif(F.col(c), F.lit(""))).alias(n) for c, n in counts.items()])


def ledger(df: DataFrame, candidate: list[str], study: str, kind: str, direction: str, accepted: str) -> DataFrame:
    """Contexts to studies to candidates. Conflicts are values: directions that differ within a study, or between studies."""
    by_study = df.groupBy(*candidate, study).agg(
        *[F.count_if(F.col(kind) == k).alias(f"{k}_") for k in ("direct", "network", "bridge", "prediction")], F.array_sort(F.collect_set(direction)).alias("d_"), F.avg(F.col(accepted).cast("double")).alias("a_")
    )
    one = F.when(F.size("d_") == 1, F.col("d_")[0])
    return by_study.groupBy(*candidate).agg(
        F.count("*").alias("studies"), *[F.sum(f"{k}_").alias(k) for k in ("direct", "network", "bridge", "prediction")],
        (F.count_if(F.size("d_") > 1) > 0).alias("conflict_within"), (F.count_distinct(one) > 1).alias("conflict_between"), F.avg("a_").alias("accepted"),
    )


def top_events(df: DataFrame, candidate: list[str], parent: str, weight: str, direction: str, most: int) -> DataFrame:
    """One event a parent, the heaviest `most` kept; counts, share of weight kept, conflict of directions among the kept."""
    best = df.withColumn("r_", F.row_number().over(Window.partitionBy(*candidate, parent).orderBy(F.desc(weight), direction))).where("r_ = 1")
    ranked = best.withColumn("k_", F.row_number().over(Window.partitionBy(*candidate).orderBy(F.desc(weight), parent)))
    kept = F.col("k_") <= most
    return ranked.groupBy(*candidate).agg(
        F.count("*").alias("events"), F.count_if(kept).alias("kept"), (F.sum(F.when(kept, F.col(weight)).otherwise(0.0)) / F.sum(weight)).alias("weight_kept"), (F.count_distinct(F.when(kept, F.col(direction))) > 1).alias("conflict")
    )


def relationship_class(observed: Column, predicted: Column, supported: Column) -> Column:
    return F.when(observed, "observed_core").when(predicted, "predicted_candidate").when(supported, "model_supported").otherwise("exploratory")


def ensemble_summary(df: DataFrame, seed: str, fold: str, metrics: list[str]) -> DataFrame:
    """metric, mean, sd, sem over seeds of the folds' means."""
    long = df.unpivot([seed, fold], metrics, "metric", "value")
    per = long.groupBy(seed, "metric").agg(F.avg("value").alias("v_"))
    return per.groupBy("metric").agg(F.count("*").alias("seeds"), F.avg("v_").alias("mean"), F.stddev_samp("v_").alias("sd")).withColumn("sem", F.col("sd") / F.sqrt("seeds"))


def nodes_and_edges(edges: DataFrame, src: tuple[str, str], dst: tuple[str, str], role: str) -> tuple[DataFrame, DataFrame]:
    """Typed nodes with role flags and degree, undirected edges told apart by hash ids."""
    e = edges.select(F.concat(F.lit(src[0] + ":"), src[1]).alias("a"), F.concat(F.lit(dst[0] + ":"), dst[1]).alias("b"), role).distinct()
    e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), role).withColumn("edge_id", stable_id("edge", F.col("a"), F.col("b"), F.col(role)))
    ends = e.select(F.explode(F.array("a", "b")).alias("node"), role)
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.count_distinct(role).alias("roles")), e
