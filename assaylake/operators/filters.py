"""Eligibility, labelling and edge filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def detection_scope(values: DataFrame, samples: DataFrame, cohort: str, entity: str, sample: str, value: str, rate: float, cohorts: int) -> DataFrame:
    """cohort, entity, n_detected, detection_rate, eligible, scope over the whole grid of cohorts and entities; a measurement that
    isn't there is not detected."""
    n = samples.groupBy(cohort).agg(F.count_distinct(sample).alias("n_samples"))
    grid = n.join(values.select(entity).distinct())
    seen = values.where(F.col(value) > 0).groupBy(cohort, entity).agg(F.count_distinct(sample).alias("n_detected"))
    out = grid.join(seen, [cohort, entity], "left").fillna(0, ["n_detected"])
    out = out.withColumn("detection_rate", F.col("n_detected") / F.col("n_samples")).withColumn("eligible", F.col("detection_rate") >= rate)
    many = F.count(F.when(F.col("eligible"), 1)).over(Window.partitionBy(entity))
    scope = F.when(many >= cohorts, "shared").when(F.col("eligible"), "cancer_local").otherwise("not_eligible")
    return out.withColumn("scope", scope)


def most_variable(values: DataFrame, by: list[str], entity: str, value: str, least: float, k: int) -> DataFrame:
    v = values.groupBy(*by, entity).agg(F.var_samp(value).alias("variance")).where(F.col("variance") >= least)
    return v.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("variance", 9)), entity))).where(F.col("rank") <= k)


def association_label(q: Column, rho: Column) -> Column:
    return F.when((q <= 0.05) & (F.abs(rho) >= 0.20), "strong").when((q <= 0.10) & (F.abs(rho) >= 0.15), "weak").otherwise("unlabeled")


def holdout_policy(edges: DataFrame, held_out: Column, contract: str) -> DataFrame:
    """edges: relation, cohort, provenance (static, unlabeled_context, outcome_derived). Contracts S and T drop reference context
    and the held-out cohort's outcome edges; S also unlabeled context except expressed_in."""
    outcome = (F.col("provenance") == "outcome_derived") & (F.col("cohort") == held_out)
    reference = F.col("provenance") == "reference_context"
    context = (F.col("provenance") == "unlabeled_context") & (F.col("relation") != "expressed_in") if contract == "S" else F.lit(False)
    reason = F.when(reference, "reference_context").when(outcome, "held_out_outcome").when(context, "unlabeled_context")
    return edges.withColumn("dropped", reason)


def role_contract(edges: DataFrame, roles: DataFrame, key: list[str]) -> DataFrame:
    """Adds reject_reason: no role, wrong polarity or fold, direct target or outcome-derived edges."""
    out = edges.join(F.broadcast(roles), key, "left")
    reason = (
        F.when(F.col("allowed_polarity").isNull(), "no_role").when(F.col("outcome"), "outcome_derived").when(F.col("direct_target"), "direct_target")
        .when((F.col("allowed_polarity") != "any") & (F.col("allowed_polarity") != F.col("polarity")), "polarity").otherwise(F.lit(None))
    )
    return out.withColumn("reject_reason", reason)


def isolation(external: DataFrame, used: DataFrame, study: str, pair: tuple[str, str]) -> DataFrame:
    """Flags and reasons: which external rows share a study, a pair or an entity with anything used."""
    a, b = pair
    mark = lambda cols, name: used.select(*cols).distinct().withColumn(name, F.lit(True))
    out = external.join(mark([study], "study_used"), study, "left").join(mark([a, b], "pair_used"), [a, b], "left").join(mark([a], "entity_used"), a, "left").fillna(False, ["study_used", "pair_used", "entity_used"])
    reasons = F.array_compact(F.array(*[F.when(F.col(c), c) for c in ("study_used", "pair_used", "entity_used")]))
    return out.withColumns({"provenance_ok": ~F.col("study_used"), "pair_held_out": ~F.col("study_used") & ~F.col("pair_used"), "entity_held_out": ~F.col("study_used") & ~F.col("entity_used"), "reasons": F.array_join(reasons, ";")})


def physical(assay_class: Column, family: Column, subtypes: Column, allowed: dict[str, list[str]]) -> Column:
    """Class and family are physical, and so is every listed subtype (split at |)."""
    rest = F.array_except(F.split(subtypes, r"\|"), F.array(*[F.lit(x) for x in allowed["subtype"]]))
    return assay_class.isin(*allowed["class"]) & family.isin(*allowed["family"]) & (F.size(rest) == 0)
