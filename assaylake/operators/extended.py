"""Operators that put several others together: binding edges, bridges, fusions, screens, subtypes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions.scalars import safe_corr
from assaylake.operators.genesets import rank_biased_overlap, weighted_jaccard
from assaylake.operators.stats import rank_pairs


def typed_binding(facts: DataFrame, by_gene: DataFrame, by_accession: DataFrame, mapped: float = 1.0, loose: float = 0.4) -> DataFrame:
    """facts: entity, gene, accession, cohort, assay, exact. by_*: lookup, protein, weight. One edge per entity, protein, cohort and
    assay; the weight of an exact fact is `mapped`, of another `loose`, times the mapping's; the routes that led there.

    An accession may name many proteins, so its facts are put together before they meet them: the largest and the least weight
    give the largest product, whatever the mapping's sign."""
    by = ["entity", "protein", "cohort", "assay"]
    base, route = F.when(F.col("exact"), mapped).otherwise(loose), lambda r: F.lit(r).alias("accession_")
    gene = facts.join(by_gene, F.col("gene") == F.col("lookup")).select(*by, (base * F.col("weight")).alias("weight"), route(False))
    held = facts.groupBy("entity", F.col("accession").alias("lookup"), "cohort", "assay").agg(F.max(base).alias("high_"), F.min(base).alias("low_"))
    product = F.greatest(F.col("high_") * F.col("weight"), F.col("low_") * F.col("weight"))
    both = gene.unionByName(held.join(by_accession, "lookup").select(*by, product.alias("weight"), route(True)))
    named = F.concat_ws(";", F.when(F.bool_or("accession_"), "accession"), F.when(~F.bool_and("accession_"), "gene"))
    return both.groupBy(*by).agg(F.max("weight").alias("weight"), named.alias("routes"))


def relation_counts(df: DataFrame, by: list[str], label: str, bits: str) -> DataFrame:
    """Strong and weak relations, the union of assay bits and how many assays it names."""
    return df.groupBy(*by).agg(F.count_if(F.col(label) == "strong").alias("strong"), F.count_if(F.col(label) == "weak").alias("weak"), F.bit_or(bits).alias("bits")).withColumn("assays", F.bit_count("bits"))


def assay_detail(facts: DataFrame, details: DataFrame, exact: list[str], loose: list[str], detail: str) -> DataFrame:
    """Detail by the exact key first, then by the looser one with a lower strength; unmatched facts stay."""
    pick = lambda k: details.groupBy(*k).agg(F.min(detail).alias("d_"))
    one = facts.join(pick(exact).withColumnRenamed("d_", "one_"), exact, "left").join(pick(loose).withColumnRenamed("d_", "two_"), loose, "left")
    strength = F.when(F.col("one_").isNotNull(), "exact").when(F.col("two_").isNotNull(), "loose").otherwise("none")
    return one.withColumns({"detail": F.coalesce("one_", "two_"), "strength": strength}).drop("one_", "two_")


def absorbed(facts: DataFrame, lineage: DataFrame, event: str, candidate: list[str]) -> DataFrame:
    """How many facts of a candidate the lineage already counts, and how many it doesn't."""
    seen = facts.join(lineage.select(event).distinct().withColumn("hit_", F.lit(1)), event, "left")
    return seen.groupBy(*candidate).agg(F.count("hit_").alias("already"), F.count_if(F.col("hit_").isNull()).alias("fresh"))


def bridge(perturbed: DataFrame, binding: DataFrame, protein: str, target: str, entity: str, q: str, cut: float) -> DataFrame:
    """entity, target, proteins: a protein whose perturbation moves the target also binds the entity."""
    hits = perturbed.where(F.col(q) <= cut).select(protein, target).distinct()
    return hits.join(binding.select(protein, entity).distinct(), protein).groupBy(entity, target).agg(F.count_distinct(protein).alias("proteins"))


def dependent_fisher(p_values: DataFrame, dependence: DataFrame, relation: str, readout: str, p: str) -> DataFrame:
    """Brown's scaling: chi2 = -2 sum log p, over c with f degrees of freedom from the covariances of the readouts there are.
    dependence: a, b (a < b), rho. A pair without rho counts as unknown: Bonferroni's bound is given beside it."""
    known = p_values.where(F.col(p).isNotNull())
    stat = known.groupBy(relation).agg(F.sum(-2 * F.ln(F.greatest(F.col(p), F.lit(1e-300)))).alias("x"), F.count("*").alias("k"), F.min(p).alias("least"))
    left, right = known.select(relation, F.col(readout).alias("a")), known.select(relation, F.col(readout).alias("b"))
    r = F.col("rho")
    cov = F.when(r >= 0, r * (3.25 + 0.75 * r)).otherwise(r * (3.27 + 0.71 * r))
    pairs = left.join(right, relation).where("a < b").join(F.broadcast(dependence), ["a", "b"], "left").groupBy(relation).agg(F.sum(cov).alias("cov"), F.count_if(r.isNull()).alias("unknown"))
    out = stat.join(pairs, relation, "left").fillna(0, ["cov", "unknown"])
    var = 4 * F.col("k") + 2 * F.col("cov")
    out = out.withColumns({"scale": var / (4 * F.col("k")), "df": 8 * F.col("k") * F.col("k") / var})
    return out.select(relation, "k", (F.col("x") / F.col("scale")).alias("chi2"), "df", "unknown", F.least(F.lit(1.0), F.col("k") * F.col("least")).alias("bonferroni"))


def chi2_tail(x: Column, df: Column) -> Column:
    """Upper tail for any df > 0: the regularised incomplete gamma by its series or continued fraction."""

    def tail(x: pd.Series, df: pd.Series) -> pd.Series:
        def one(v, k):
            if v is None or k is None or not (v == v and k == k):
                return None
            a, z = k / 2, v / 2
            if z <= 0:
                return 1.0
            front = math.exp(a * math.log(z) - z - math.lgamma(a))
            if z < a + 1:
                term = total = 1 / a
                n = a
                while abs(term) > 1e-17 * total:
                    n += 1
                    term *= z / n
                    total += term
                return 1 - front * total
            b, c, h = z + 1 - a, 1e300, 1 / (z + 1 - a)
            d = h
            for i in range(1, 500):
                an = -i * (i - a)
                b += 2
                d = 1 / (an * d + b)
                c = b + an / c
                h *= d * c
                if abs(d * c - 1) < 1e-15:
                    break
            return front * h

        return pd.Series([one(a, b) for a, b in zip(x, df)], dtype=float)

    return F.pandas_udf(tail, "double")(x.cast("double"), df.cast("double"))


def cross_screen(df: DataFrame, screen: str, model: str, item: str, value: str) -> DataFrame:
    """Percentile of a response within its screen and item, averaged over the screens of a model."""
    w = Window.partitionBy(screen, item)
    pct = (F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(screen, item, value)) - 1) / 2) / F.count("*").over(w)
    return df.withColumn("pct_", pct).groupBy(model, item).agg(F.avg("pct_").alias("response"), F.count_distinct(screen).alias("screens"))


def conditions(df: DataFrame, by: list[str], condition: list[str], fold: str, x: str, y: str, least: int) -> DataFrame:
    """Correlation per key and condition over all rows, and the share of folds whose own sign agrees with it."""
    whole = df.groupBy(*by, *condition).agg(safe_corr(x, y).alias("rho"), F.count("*").alias("n")).where(F.col("n") >= least)
    folds = df.groupBy(*by, *condition, fold).agg(safe_corr(x, y).alias("r_"))
    met = folds.join(whole, [*by, *condition]).where("r_ is not null and not isnan(r_)")
    return met.groupBy(*by, *condition).agg(F.first("n").alias("n"), F.first("rho").alias("rho"), F.avg((F.signum("r_") == F.signum("rho")).cast("double")).alias("agreement"))


def masked_pairs(x: DataFrame, y: DataFrame, by: list[str], sample: str, xs: tuple[str, str], ys: tuple[str, str], least: int) -> DataFrame:
    """Spearman on the samples that both have; ranks are computed anew for each mask. Entities with the same samples share a mask,
    so the ranks of a target are computed once a mask and not once a pair."""
    mask = lambda df, e: df.groupBy(*by, e).agg(F.xxhash64(F.array_join(F.array_sort(F.collect_list(F.col(sample).cast("string"))), ",")).alias("mask_"))
    xm = x.join(mask(x, xs[0]), [*by, xs[0]])
    masks = xm.select(*by, "mask_", sample).distinct()
    ym = y.join(masks, [*by, sample])  # a target's values under every mask that has the sample
    n = ym.groupBy(*by, "mask_", ys[0]).agg(F.count("*").alias("n_")).where(F.col("n_") >= least)
    whole = xm.groupBy(*by, "mask_", xs[0]).agg(F.count("*").alias("full_"))
    # A target that lacks samples of the mask narrows it; the entity's ranks then are over the narrower one.
    pairs = xm.join(ym.select(*by, "mask_", sample, *ys), [*by, "mask_", sample]).join(n, [*by, "mask_", ys[0]]).join(whole, [*by, "mask_", xs[0]])
    even, odd = pairs.where("n_ = full_"), pairs.where("n_ < full_")

    def rho(df):
        k = [*by, xs[0], ys[0]]
        rank = lambda v: F.rank().over(Window.partitionBy(*k).orderBy(v)) + (F.count("*").over(Window.partitionBy(*k, v)) - 1) / 2
        return df.select(*k, rank(xs[1]).alias("rx_"), rank(ys[1]).alias("ry_")).groupBy(*k).agg(F.count("*").alias("n"), safe_corr("rx_", "ry_").alias("rho"))

    return rho(even).unionAll(rho(odd))


def similarity_fusion(views: dict[str, tuple[DataFrame, float]], a: str = "a", b: str = "b") -> DataFrame:
    """Weighted mean over the views that have a pair; a, b, similarity, views."""
    out = None
    for name, (df, w) in views.items():
        part = df.select(a, b, F.col("similarity").alias("s_"), F.lit(float(w)).alias("w_"))
        out = part if out is None else out.unionByName(part)
    return out.where("s_ is not null").groupBy(a, b).agg((F.sum(F.col("s_") * F.col("w_")) / F.sum("w_")).alias("similarity"), F.count("*").alias("views"))


def paired_arms(a: DataFrame, b: DataFrame, key: list[str], by: list[str], label: str, score: str) -> DataFrame:
    """Squared-error difference of two arms on the same rows and labels, and the sign test's counts; unequal keys raise."""
    own = lambda df, n: df.select(*key, label, F.lit(n).alias("n_"))
    odd = own(a, 1).unionByName(own(b, -1)).groupBy(*key, label).agg(F.sum("n_").alias("n_")).where("n_ <> 0")
    if not odd.isEmpty():
        raise ValueError("the arms don't hold the same rows and labels")
    both = a.select(*key, *by, label, F.col(score).alias("sa")).join(b.select(*key, F.col(score).alias("sb")), key)
    d = F.pow(F.col("sa") - F.col(label), 2) - F.pow(F.col("sb") - F.col(label), 2)
    return both.withColumn("d_", d).groupBy(*by).agg(F.count("*").alias("n"), F.avg("d_").alias("difference"), F.count_if(F.col("d_") < 0).alias("a_better"), F.count_if(F.col("d_") > 0).alias("b_better"))


def residualised(df: DataFrame, by: list[str], value: str, covariate: str, train: Column) -> DataFrame:
    """value minus its regression on the covariate, fitted on the training rows; missing values stay missing."""
    fit = df.where(train).groupBy(*by).agg(F.regr_slope(value, covariate).alias("b_"), F.regr_intercept(value, covariate).alias("a_"))
    return df.join(fit, by, "left").withColumn("residual", F.col(value) - F.col("a_") - F.col("b_") * F.col(covariate)).drop("a_", "b_")


def context_subtypes(ranked: DataFrame, pathway: str, cohort: str, member: str, weight: str, most: int = 4, least: float = 0.25) -> DataFrame:
    """Subtypes of the cohorts of each pathway: half rank-biased overlap, half weighted Jaccard, then average linkage cut at the
    number of groups of the best silhouette; CONSERVED below `least`, UNAVAILABLE under three cohorts. The pairs are Spark's work;
    what a pathway's clustering gets is its cohorts' square matrix only, which the number of cohorts bounds."""
    rbo = rank_biased_overlap(ranked, [pathway], cohort, member)
    wj = weighted_jaccard(ranked, [pathway], cohort, member, weight)
    sim = rbo.join(wj, [pathway, "a", "b"]).withColumn("s", 0.5 * F.col("rbo") + 0.5 * F.col("similarity"))
    names = ranked.groupBy(pathway).agg(F.array_sort(F.collect_set(cohort)).alias("names"))
    packed = names.join(sim.groupBy(pathway).agg(F.collect_list(F.struct("a", "b", "s")).alias("pairs")), pathway, "left")

    def cluster(names: list[str], pairs) -> list[tuple[str, int, str]]:
        n = len(names)
        if n < 3:
            return [(c, 0, "UNAVAILABLE") for c in names]
        at, d = {c: i for i, c in enumerate(names)}, np.ones((n, n))
        np.fill_diagonal(d, 0)
        for p in pairs or []:
            d[at[p["a"]], at[p["b"]]] = d[at[p["b"]], at[p["a"]]] = 1 - p["s"]
        groups, best = [[i] for i in range(n)], (least, None)
        while len(groups) > 1:
            if 2 <= len(groups) <= most:
                label = np.zeros(n, int)
                for k, g in enumerate(groups):
                    label[g] = k
                widths = []
                for i in range(n):
                    own = [j for j in groups[label[i]] if j != i]
                    inner = d[i, own].mean() if own else None
                    outer = min(d[i, g].mean() for k, g in enumerate(groups) if k != label[i])
                    widths.append(0.0 if inner is None or max(inner, outer) == 0 else (outer - inner) / max(inner, outer))
                if np.mean(widths) > best[0] + 1e-12:
                    best = (float(np.mean(widths)), label.copy())
            x, y = min(((d[np.ix_(groups[i], groups[j])].mean(), i, j) for j in range(len(groups)) for i in range(j)), key=lambda v: (round(v[0], 12), v[1], v[2]))[1:]
            groups = sorted([g for k, g in enumerate(groups) if k not in (x, y)] + [sorted(groups[x] + groups[y])])
        if best[1] is None:
            return [(c, 1, "CONSERVED") for c in names]
        order = {}
        for k in best[1].tolist():
            order.setdefault(k, len(order) + 1)
        return [(c, order[k], "HETEROGENEOUS") for c, k in zip(names, best[1].tolist())]

    found = F.udf(cluster, "array<struct<cohort:string,subtype:int,status:string>>")
    return packed.select(pathway, F.explode(found("names", "pairs")).alias("c")).select(pathway, F.col("c.cohort").alias(cohort), "c.subtype", "c.status")


def lasso_screen(x: DataFrame, y: DataFrame, by: list[str], sample: str, xs: tuple[str, str], ys: tuple[str, str], cut: float, most: int) -> DataFrame:
    """The entities of each target with |rho| of `cut` or more on the given (training) rows, the best `most`."""
    r = rank_pairs(x, y, by, sample, xs, ys).where(F.abs("rho") >= cut)
    return r.withColumn("rank", F.row_number().over(Window.partitionBy(*by, ys[0]).orderBy(F.desc(F.round(F.abs("rho"), 9)), xs[0]))).where(F.col("rank") <= most)


def expert_frame(universe: DataFrame, folds: DataFrame, experts: dict[str, DataFrame], key: list[str], pair: list[str], k: int) -> DataFrame:
    """One row a candidate: the mean of its fold labels, a fold by a hash of the pair (so all cohorts of it share one), and each
    expert's value with availability; a missing expert value stays null."""
    out = universe.join(folds.groupBy(*key).agg(F.avg("label").alias("soft_target")), key, "left")
    out = out.withColumn("fold", F.pmod(F.xxhash64(*pair), F.lit(k)).cast("int"))
    for name, df in experts.items():
        out = out.join(df.select(*key, F.col("value").alias(name)), key, "left").withColumn(f"{name}_available", F.col(name).isNotNull())
    return out


def mixed_channels(genes: DataFrame, entities: DataFrame, target: str, k: int) -> DataFrame:
    """genes: target, p. entities: target, association. -log10 p (over 10, at most 1) and the mean association; the geometric mean where both are."""
    g = genes.select(target, F.least(F.lit(1.0), -F.log10(F.greatest("p", F.lit(1e-300))) / 10).alias("gene_score"))
    e = entities.groupBy(target).agg(F.avg("association").alias("entity_score"), F.count("*").alias("entities"))
    both = g.join(e, target, "full_outer")
    score = F.when(F.col("gene_score").isNotNull() & F.col("entity_score").isNotNull(), F.sqrt(F.col("gene_score") * F.greatest("entity_score", F.lit(0.0)))).otherwise(F.coalesce("gene_score", "entity_score"))
    return both.withColumn("score", score).orderBy(F.desc(F.round("score", 9)), target).limit(k)
