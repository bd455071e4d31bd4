"""Ranked sets, rank-biased overlap, set similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions.scalars import stable_id


def ranked_sets(rows: DataFrame, by: list[str], member: str, order: list[Column], least: int, most: int) -> DataFrame:
    """by, set_id, member, rank, size: groups of `least` members or more, their first `most`."""
    w = Window.partitionBy(*by)
    out = rows.withColumns({"rank": F.row_number().over(w.orderBy(*order)), "n_": F.count("*").over(w)}).where((F.col("n_") >= least) & (F.col("rank") <= most))
    return out.withColumn("size", F.least("n_", F.lit(most))).withColumn("set_id", stable_id("set", *[F.col(c) for c in by])).select(*by, "set_id", member, "rank", "size")


def overlap_weights(depth: int, p: float) -> list[float]:
    """H(d): the weight that agreement up to d gives, for 0..depth."""
    out = [0.0]
    for t in range(1, depth + 1):
        out.append(out[-1] + (1 - p) * p ** (t - 1) / t)
    return out


def rank_biased_overlap(ranked: DataFrame, within: list[str], name: str, member: str, p: float = 0.98, depth: int = 200) -> DataFrame:
    """within, a, b, rbo of all pairs of lists of a group: a shared member at worse rank m adds H(D) - H(m - 1) + p^D / D, with D
    the longer list's length, at most `depth`. Lists that share nothing have 0."""
    r = ranked.where(F.col("rank") <= depth)
    sizes = r.groupBy(*within, name).agg(F.max("rank").alias("len_"))
    pairs = sizes.withColumnsRenamed({name: "a", "len_": "la"}).join(sizes.withColumnsRenamed({name: "b", "len_": "lb"}), within).where("a < b").withColumn("d_", F.greatest("la", "lb"))
    h = F.array(*[F.lit(x) for x in overlap_weights(depth, p)])
    left, right = r.select(*within, F.col(name).alias("a"), member, F.col("rank").alias("ra")), r.select(*within, F.col(name).alias("b"), member, F.col("rank").alias("rb"))
    met = left.join(right, [*within, member]).where("a < b").select(*within, "a", "b", F.greatest("ra", "rb").alias("m_"))
    both = pairs.join(met, [*within, "a", "b"], "left").withColumn("h_", h)
    share = F.element_at("h_", F.col("d_") + 1) - F.element_at("h_", F.col("m_")) + F.pow(F.lit(p), F.col("d_").cast("double")) / F.col("d_")
    return both.groupBy(*within, "a", "b").agg(F.coalesce(F.sum(F.when(F.col("m_").isNotNull(), share)), F.lit(0.0)).alias("rbo"))


def weighted_jaccard(rows: DataFrame, within: list[str], name: str, token: str, weight: str) -> DataFrame:
    """within, a, b, similarity: sum of lesser over sum of greater weights; the union follows from the totals."""
    total = rows.groupBy(*within, name).agg(F.sum(weight).alias("t_"))
    pairs = total.withColumnsRenamed({name: "a", "t_": "ta"}).join(total.withColumnsRenamed({name: "b", "t_": "tb"}), within).where("a < b")
    x, y = rows.select(*within, F.col(name).alias("a"), token, F.col(weight).alias("wa")), rows.select(*within, F.col(name).alias("b"), token, F.col(weight).alias("wb"))
    low = x.join(y, [*within, token]).where("a < b").groupBy(*within, "a", "b").agg(F.sum(F.least("wa", "wb")).alias("low"))
    out = pairs.join(low, [*within, "a", "b"], "left").fillna(0.0, ["low"])
    return out.select(*within, "a", "b", (F.col("low") / (F.col("ta") + F.col("tb") - F.col("low"))).alias("similarity"))


def consensus(rows: DataFrame, by: list[str], fold: str, effect: str, least: int) -> DataFrame:
    """Relations of `least` folds or more that agree on the sign: folds, direction, consistency, mean effect."""
    s = F.signum(effect)
    out = rows.groupBy(*by).agg(F.count_distinct(fold).alias("folds"), F.sum(s).alias("net"), F.count("*").alias("n"), F.avg(effect).alias("mean_effect"))
    return out.where(F.col("folds") >= least).select(*by, "folds", F.when(F.col("net") > 0, "positive").when(F.col("net") < 0, "negative").otherwise("mixed").alias("direction"), (F.abs("net") / F.col("n")).alias("consistency"), "mean_effect")


def match_custom(query: DataFrame, sets: DataFrame, name: str, member: str, k: int) -> DataFrame:
    """Known sets nearest to one input set by Jaccard."""
    q = query.select(member).distinct()
    n = q.agg(F.count("*").alias("nq"))
    s = sets.select(name, member).distinct()
    hit = s.join(q.withColumn("hit_", F.lit(1)), member, "left").groupBy(name).agg(F.count("hit_").alias("shared"), F.count("*").alias("size"))
    out = hit.join(F.broadcast(n)).withColumn("jaccard", F.col("shared") / (F.col("size") + F.col("nq") - F.col("shared")))
    return out.orderBy(F.desc("jaccard"), name).limit(k).select(name, "shared", "size", "jaccard")
