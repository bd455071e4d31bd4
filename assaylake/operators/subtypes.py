"""Subtypes of cohorts with a bootstrap stability gate: per pathway, and over all pathways (programs).

Per pathway the similarity of two cohorts is half the rank-biased overlap of their ranked members, half their weighted Jaccard.
Average linkage is cut where the silhouette is best among cuts without a group under `smallest`. A cut stands if its silhouette
reaches `least` and if bootstrap replicates find it again: mean adjusted Rand index `stable` or more. A replicate repeats each
member by a Poisson(1) count from a hash of seed, replicate, pathway and member: profiles are ranked anew with these repeats, and the counts
don't depend on partitioning or company. Replicates are dealt out in shares of SHARE, so one pathway's work spreads over tasks;
what a share gets is its pathway's profiles, cohorts times members.

Programs: a pair's value in a pathway is `raw` times its similarity plus the rest if the pathway is split and has both in one
subtype; the mean over families of means over pathways is clustered the same way, replicates weigh pathways by Poisson counts.

Statuses: HETEROGENEOUS (the cut stands), CONSERVED (one group), UNAVAILABLE (too few cohorts, or a cohort with too few members).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.operators.genesets import overlap_weights

SHARE = 25
_CUTS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def poisson(seed: int, replicate: int, scope: str, names: list[str]) -> np.ndarray:
    """Poisson(1) counts of names, by hash."""
    u = np.array([xxhash.xxh64_intdigest(f"{replicate}|{scope}|{x}", seed) for x in names], float) / 2**64
    return np.searchsorted(_CUTS, u, "right")


def similarity(ranks: np.ndarray, weights: np.ndarray, count: np.ndarray, p: float = 0.98, depth: int = 200) -> np.ndarray:
    """Similarity of all pairs of rows; ranks: 1, 2, .. or 0 where a member is missing; weights: as many, not negative; count: repeats of each member."""
    n = len(ranks)
    h = np.array(overlap_weights(depth, p))
    place, length = np.full((n, int(count.sum())), depth + 1), np.zeros(n, int)
    slot, turn = np.repeat(np.arange(len(count)), count), np.concatenate([np.arange(c) for c in count]) if len(count) else np.zeros(0, int)
    for i in range(n):
        order = np.argsort(np.where(ranks[i] > 0, ranks[i], np.iinfo(np.int64).max), kind="stable")
        order = order[ranks[i][order] > 0]
        first = np.zeros(len(count), int)
        first[order] = np.cumsum(count[order]) - count[order]
        own = ranks[i][slot] > 0
        place[i, own] = np.minimum(first[slot[own]] + turn[own] + 1, depth + 1)
        length[i] = min(depth, int(count[order].sum()))
    d = np.maximum(length[:, None], length[None])
    worse = np.maximum(place[:, None, :], place[None, :, :])
    met = (worse <= depth).sum(-1)
    tail = np.where(d > 0, p ** d.astype(float) / np.maximum(d, 1), 0.0)
    rbo = met * (h[d] + tail) - np.where(worse <= depth, h[np.minimum(worse, depth + 1) - 1], 0.0).sum(-1)
    w = weights * count
    low = np.minimum(w[:, None, :], w[None, :, :]).sum(-1)
    total = w.sum(-1)
    high = total[:, None] + total[None] - low
    out = 0.5 * rbo + 0.5 * np.divide(low, high, out=np.zeros_like(low, dtype=float), where=high > 0)
    np.fill_diagonal(out, 1.0)
    return out


def linkage_cuts(distance: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Labels of average linkage with 1 to most groups; the nearest groups merge, of ties those of the first rows."""
    n = len(distance)
    d, size = distance.astype(float).copy(), np.ones(n)
    label, out = np.arange(n), {}
    np.fill_diagonal(d, np.inf)
    for k in range(n, 0, -1):
        if k <= most:
            out[k] = np.unique(label, return_inverse=True)[1]
        if k == 1:
            break
        i, j = sorted(divmod(int(np.argmin(np.round(d, 12))), n))
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = d[j] = d[:, j] = np.inf
        size[i] += size[j]
        label[label == label[j]] = label[i]
    return out


def silhouette(distance: np.ndarray, label: np.ndarray) -> float:
    n, k = len(label), label.max() + 1
    member = np.equal.outer(label, np.arange(k)).astype(float)
    sums, size = distance @ member, member.sum(0)
    own = size[label]
    inner = sums[np.arange(n), label] / np.maximum(own - 1, 1)
    outer = np.where(member > 0, np.inf, sums / size).min(1)
    width = np.divide(outer - inner, np.maximum(inner, outer), out=np.zeros(n), where=np.maximum(inner, outer) > 0)
    return float(np.where(own > 1, width, 0.0).mean())


def rand_index(a: np.ndarray, b: np.ndarray) -> float:
    """Adjusted for chance."""
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    pairs = lambda x: float((x * (x - 1) / 2).sum())
    both, left, right, every = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), len(a) * (len(a) - 1) / 2
    expected = left * right / every if every else 0.0
    top = (left + right) / 2
    return 1.0 if top == expected else (both - expected) / (top - expected)


def best_cut(s: np.ndarray, most: int, smallest: int) -> tuple[int, float, np.ndarray]:
    """Groups, silhouette and labels of the best cut; one group if none is allowed."""
    found = (1, 0.0, np.zeros(len(s), int))
    cuts = linkage_cuts(1 - np.clip(s, 0, 1), most)
    for k in range(2, min(most, len(s) // smallest) + 1):
        if np.bincount(cuts[k]).min() >= smallest and ((width := silhouette(1 - np.clip(s, 0, 1), cuts[k])) > found[1] + 1e-12 or found[0] == 1):
            found = (k, width, cuts[k])
    return found


def _mean(s: np.ndarray) -> float:
    return float(s[np.triu_indices(len(s), 1)].mean()) if len(s) > 1 else 1.0


def pathway_subtypes(profiles: DataFrame, pathway: str, cohort: str, member: str, weight: str, *, replicates: int = 200, most: int = 4, least: float = 0.25, stable: float = 0.75, smallest: int = 2, cohorts: int = 3, members: int = 1, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """profiles: pathway, cohort, member, weight (once each). The subtypes: pathway, cohort, subtype, status, k, proposed,
    silhouette, ari, similarity, low, high (the mean similarity and its bootstrap interval); and the pairs: pathway, a, b, similarity.
    Members are ranked by weight, then name."""
    kinds = {f.name: f.dataType.simpleString() for f in profiles.schema}
    one = profiles.where(F.col(member).isNotNull()).groupBy(pathway, cohort).agg(F.collect_list(F.struct(F.col(member).cast("string").alias("m"), F.col(weight).cast("double").alias("w"))).alias("ms"))
    packed = one.groupBy(pathway).agg(F.array_sort(F.collect_list(F.struct(F.col(cohort).alias("c"), "ms"))).alias("cs"))
    shares = -(-replicates // SHARE)
    dealt = packed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares)))).repartition(pathway, "share").select(pathway, "cs", "share")

    def work(batches):
        for b in batches:
            out = []
            for i, (name, cs, share) in enumerate(zip(*(c.to_pylist() for c in b.columns))):
                fit = [c for c in cs if len(c["ms"]) >= members]
                if len(fit) < cohorts:
                    if not share:
                        out.append((i, 0, None, None, None, None, [-1] * len(cs), []))
                    continue
                names = sorted({m["m"] for c in fit for m in c["ms"]})
                at = {m: k for k, m in enumerate(names)}
                ranks, weights = np.zeros((len(fit), len(names)), np.int64), np.zeros((len(fit), len(names)))
                for row, c in enumerate(fit):
                    for k, m in enumerate(sorted(c["ms"], key=lambda m: (-m["w"], m["m"]))):
                        ranks[row, at[m["m"]]], weights[row, at[m["m"]]] = k + 1, m["w"]
                s = similarity(ranks, weights, np.ones(len(names), int))
                k, width, label = best_cut(s, most, smallest)
                if not share:
                    known = {c["c"]: int(v) for c, v in zip(fit, label)}
                    pairs = [(fit[x]["c"], fit[y]["c"], float(s[x, y])) for x in range(len(fit)) for y in range(x + 1, len(fit))]
                    out.append((i, 0, k, width, None, _mean(s), [known.get(c["c"], -1) for c in cs], pairs))
                    continue
                for r in range((share - 1) * SHARE + 1, min(share * SHARE, replicates) + 1):
                    again = similarity(ranks, weights, poisson(seed, r, str(name), names))
                    ari = rand_index(label, linkage_cuts(1 - np.clip(again, 0, 1), k)[k]) if k > 1 and width >= least else None
                    out.append((i, r, k, width, ari, _mean(again), [], []))
            at, *rest = zip(*out) if out else [()] * 8
            types = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int32())]
            columns = [pa.array(x, t) for x, t in zip(rest, types)]
            kind = b.column(1).type.value_type.field("c").type
            pairs = pa.array([[{"a": x, "b": y, "s": z} for x, y, z in p] for p in rest[-1]], pa.list_(pa.struct([("a", kind), ("b", kind), ("s", pa.float64())])))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns, pairs], [pathway, "replicate", "k", "silhouette", "ari", "mean", "labels", "pairs"])

    schema = f"`{pathway}` {kinds[pathway]}, replicate int, k int, silhouette double, ari double, mean double, labels array<int>, pairs array<struct<a:{kinds[cohort]},b:{kinds[cohort]},s:double>>"
    made = dealt.mapInArrow(work, schema)
    boot = made.where("replicate > 0").groupBy(pathway).agg(F.avg("ari").alias("ari"), F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    base = made.where("replicate = 0").drop("ari").join(boot, pathway, "left").join(packed.select(pathway, F.transform("cs", lambda c: c["c"]).alias("names")), pathway)
    stands = (F.col("k") > 1) & (F.col("silhouette") >= least) & (F.coalesce("ari", F.lit(0.0)) >= stable)
    rows = base.withColumn("stands", stands).select("*", F.explode(F.arrays_zip("names", "labels")).alias("x"))
    gone = F.col("x.labels") < 0
    one_ = lambda c: F.when(~gone, c)
    subtypes = rows.select(
        pathway, F.col("x.names").alias(cohort), F.when(gone, 0).when(F.col("stands"), F.col("x.labels") + 1).otherwise(1).alias("subtype"),
        F.when(gone, "UNAVAILABLE").when(F.col("stands"), "HETEROGENEOUS").otherwise("CONSERVED").alias("status"),
        F.when(gone, 0).when(F.col("stands"), F.col("k")).otherwise(1).alias("k"), F.when(gone, 0).otherwise(F.col("k")).alias("proposed"),
        one_(F.col("silhouette")).alias("silhouette"), one_(F.col("ari")).alias("ari"), one_(F.col("mean")).alias("similarity"), one_(F.col("low")).alias("low"), one_(F.col("high")).alias("high"),
    )
    pairs = base.select(pathway, F.explode("pairs").alias("p")).select(pathway, "p.a", "p.b", F.col("p.s").alias("similarity"))
    return subtypes, pairs


def program_subtypes(subtypes: DataFrame, pairs: DataFrame, families: DataFrame, pathway: str, cohort: str, family: str, *, raw: float = 0.7, replicates: int = 200, most: int = 6, least: float = 0.25, stable: float = 0.75, smallest: int = 2, cohorts: int = 3, pathways: int = 1, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """From the results of pathway_subtypes and pathway -> family: cohort, subtype, status, k, proposed, silhouette, ari; and the
    program similarities: a, b, similarity, pathways. A pair without a common pathway has the mean of the others."""
    known = subtypes.where("status <> 'UNAVAILABLE'")
    enough = known.groupBy(cohort).agg(F.count_distinct(pathway).alias("n_")).where(F.col("n_") >= pathways)
    label = known.select(pathway, F.col(cohort).alias("c_"), "subtype", (F.col("k") > 1).alias("split_"))
    of = lambda c: label.select(pathway, F.col("c_").alias(c), F.col("subtype").alias(f"s_{c}"), *(["split_"] if c == "a" else []))
    valued = pairs.join(enough.select(F.col(cohort).alias("a")), "a").join(enough.select(F.col(cohort).alias("b")), "b").join(of("a"), [pathway, "a"]).join(of("b"), [pathway, "b"]).join(families, pathway)
    value = F.when(F.col("split_"), raw * F.col("similarity") + (1 - raw) * (F.col("s_a") == F.col("s_b")).cast("double")).otherwise(F.col("similarity"))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("replicate"), F.col(pathway)), F.lit(1 << 30)) / float(1 << 30)
    drawn: Column = sum(((u >= float(c)).cast("int") for c in _CUTS[1:]), (u >= float(_CUTS[0])).cast("int"))
    every = valued.withColumn("v_", value).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).withColumn("m_", F.when(F.col("replicate") == 0, 1).otherwise(drawn)).where("m_ > 0")
    by_family = every.groupBy("replicate", family, "a", "b").agg((F.sum(F.col("m_") * F.col("v_")) / F.sum("m_")).alias("v_"), F.count("*").alias("n_"))
    means = by_family.groupBy("replicate", "a", "b").agg(F.avg("v_").alias("s"), F.sum("n_").alias("n"))
    packed = means.groupBy("replicate").agg(F.array_sort(F.collect_list(F.struct("a", "b", "s"))).alias("pairs"))
    names = enough.agg(F.array_sort(F.collect_list(cohort)).alias("names"))
    base = packed.where("replicate = 0").select(F.col("pairs").alias("base"))
    rows = packed.join(F.broadcast(base)).join(F.broadcast(names)).select("replicate", "pairs", "base", "names").repartition("replicate")

    def matrix(names, pairs):
        at, s = {c: i for i, c in enumerate(names)}, np.full((len(names), len(names)), np.nan)
        for p in pairs:
            s[at[p["a"]], at[p["b"]]] = s[at[p["b"]], at[p["a"]]] = p["s"]
        s[np.isnan(s)] = np.nanmean(s) if np.isfinite(s).any() else 0.0
        np.fill_diagonal(s, 1.0)
        return np.clip(s, 0, 1)

    def work(batches):
        for b in batches:
            out = []
            for r, pairs, first, who in zip(*(c.to_pylist() for c in b.columns)):
                if len(who) < cohorts:
                    continue
                k, width, label = best_cut(matrix(who, first), most, smallest)
                ari = rand_index(label, linkage_cuts(1 - matrix(who, pairs), k)[k]) if r and k > 1 and width >= least else None
                out.append((r, k, width, ari, label.tolist() if not r else []))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int32())])], ["replicate", "k", "silhouette", "ari", "labels"])

    made = rows.mapInArrow(work, "replicate int, k int, silhouette double, ari double, labels array<int>")
    boot = made.agg(F.avg("ari").alias("ari"))
    stands = (F.col("k") > 1) & (F.col("silhouette") >= least) & (F.coalesce("ari", F.lit(0.0)) >= stable)
    split = made.where("replicate = 0").drop("ari").join(F.broadcast(boot)).join(F.broadcast(names)).withColumn("stands", stands).select("*", F.explode(F.arrays_zip("names", "labels")).alias("x"))
    found = split.select(F.col("x.names").alias(cohort), F.when(F.col("stands"), F.col("x.labels") + 1).otherwise(1).alias("subtype"), F.when(F.col("stands"), "HETEROGENEOUS").otherwise("CONSERVED").alias("status"), F.when(F.col("stands"), F.col("k")).otherwise(1).alias("k"), F.col("k").alias("proposed"), "silhouette", "ari")
    everyone = subtypes.select(cohort).distinct().join(found, cohort, "left")
    out = everyone.select(cohort, F.coalesce("subtype", F.lit(0)).alias("subtype"), F.coalesce("status", F.lit("UNAVAILABLE")).alias("status"), F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("proposed", F.lit(0)).alias("proposed"), "silhouette", "ari")
    return out, means.where("replicate = 0").select("a", "b", F.col("s").alias("similarity"), F.col("n").alias("pathways"))
