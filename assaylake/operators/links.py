"""Candidates for unseen links: negatives by degree stratum, an additive score, metrics at a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.operators.graph import _written

SLICES = 64
CUTS = 64


def _digest(seed: str, *parts) -> Column:
    """The first 32 bits of sha256(seed|parts)."""
    text = F.concat_ws("|", F.lit(seed), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def _stratum(degree: str) -> Column:
    """Number of binary digits of the degree; 0 without edges."""
    return F.when(F.col(degree) > 0, F.length(F.bin(degree))).otherwise(0).cast("int")


def _numbered(targets: DataFrame, b: str, seed: str) -> DataFrame:
    """Adds place: 0.. within the stratum in order of (hash slice, hash, b), from a slice's own order and the sizes of the slices
    before it, so that no stratum is sorted by one task."""
    t = targets.withColumn("hash_", _digest(seed, b)).withColumn("slice_", F.col("hash_") % SLICES)
    sizes = t.groupBy("stratum", "slice_").agg(F.count("*").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy("stratum").orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("stratum", "slice_", F.coalesce(before, F.lit(0)).alias("start_"))
    own = F.row_number().over(Window.partitionBy("stratum", "slice_").orderBy("hash_", b)) - 1
    return t.withColumn("own_", own).join(starts, ["stratum", "slice_"]).select(b, "stratum", (F.col("start_") + F.col("own_")).alias("place"))


def candidates(edges: DataFrame, a: str, b: str, per_stratum: int, seed: str = "negatives", of_a: DataFrame | None = None, of_b: DataFrame | None = None) -> DataFrame:
    """a, b, held_out: every held-out edge, and for each entity `per_stratum` draws of targets from each stratum of train degree.
    of_a, of_b: tables of a or b (one row each) whose other columns are added, null where they have no row; they meet entities and
    targets before the draws, so that pairs need not move for them.

    edges: a, b and split (train or test, one row a pair). A draw is a hash of entity, stratum and number, so it does not depend
    on partitioning; draws that meet a train edge are left out, those that meet a held-out edge are that edge. Pairs grow with
    entities times strata (the logarithm of the largest degree), not with entities times targets. Null ends have no links.
    """
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    degree = known.groupBy(b).agg(F.count_if(F.col("split") == "train").alias("degree_"))
    xs, ys = ([] if of is None else [c for c in of.columns if c != key] for of, key in ((of_a, a), (of_b, b)))
    targets = _numbered(degree.select(b, _stratum("degree_").alias("stratum")), b, seed)
    sizes = targets.groupBy("stratum").agg(F.count("*").alias("size_"))
    strata = sizes.agg(F.collect_list(F.struct("stratum", "size_")).alias("strata_"))  # one row of at most 65 strata
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few entities make many draws
    entities = (known.select(a).distinct() if of_a is None else known.select(a).distinct().join(of_a, a, "left")).repartition(tasks, a)
    draws = entities.join(F.broadcast(strata)).select(a, *xs, F.explode("strata_").alias("s_"))
    draws = draws.select(a, *xs, F.col("s_.stratum").alias("stratum"), F.col("s_.size_").alias("size_"), F.explode(F.sequence(F.lit(1), F.lit(per_stratum))).alias("draw_"))
    places = targets if of_b is None else targets.join(of_b, b, "left")
    drawn = draws.withColumn("place", _digest(seed, a, F.col("stratum"), F.col("draw_")) % F.col("size_")).join(places, ["stratum", "place"])
    marks = drawn.select(a, b, *xs, *ys, F.lit(False).alias("train_"), F.lit(False).alias("held_"))
    seen = known if of_a is None else known.join(of_a, a, "left")
    seen = seen if of_b is None else seen.join(of_b, b, "left")
    marks = marks.unionByName(seen.select(a, b, *xs, *ys, (F.col("split") == "train").alias("train_"), (F.col("split") != "train").alias("held_")))
    met = marks.groupBy(a, b, *xs, *ys).agg(F.bool_or("train_").alias("train_"), F.bool_or("held_").alias("held_out"))
    return met.where("not train_").drop("train_")


def moments(rows: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Center and scale of each feature over the rows that have it; no label is read. A feature without spread has scale 1."""
    ok = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    one = rows.agg(*[F.avg(c).alias(f"m_{f}") for f, c in ok.items()], *[F.stddev_samp(c).alias(f"s_{f}") for f, c in ok.items()]).first()
    return {f: (one[f"m_{f}"] or 0.0, one[f"s_{f}"] or 1.0) for f in features}


def additive_score(rows: DataFrame, weights: dict[str, float], scaling: dict[str, tuple[float, float]]) -> DataFrame:
    """Adds score, the weighted sum of standardised features, and missing, the names of the features a row lacks: null and
    not-a-number count as missing and add nothing, so nothing imputed promotes a candidate."""
    known = {f: F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) for f in weights}
    parts = [F.when(known[f], (F.col(f) - F.lit(float(scaling[f][0]))) / F.lit(float(scaling[f][1])) * F.lit(float(w))).otherwise(0.0) for f, w in weights.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return rows.withColumns({"score": total, "missing": F.concat_ws(",", *[F.when(~known[f], F.lit(f)) for f in weights])})


def budget_metrics(rows: DataFrame, by: list[str], score: str, label: str, budgets: list[int]) -> DataFrame:
    """by, budget, n, positives, prevalence, precision, recall, average_precision: ranked by score, highest first.

    Rows of one score are a block: a budget that ends inside it counts its expected hits, and average precision takes precision
    at the block's end, so no order among ties is needed. Only blocks are ranked, within bins of scores; offsets of bins are
    summed beside. Groups without a positive have null recall and average precision.
    """
    blocks = rows.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score_")).agg(F.count("*").alias("n_"), F.count_if(F.col(label)).alias("p_"))
    blocks = _written(blocks, "score-blocks")
    cuts = blocks.groupBy(*by).agg(F.percentile_approx("score_", F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)]), F.lit(10_000)).alias("cuts_"))
    binned = blocks.join(cuts, by) if by else blocks.join(F.broadcast(cuts))
    binned = binned.withColumn("bin_", F.size(F.filter("cuts_", lambda c: c < F.col("score_")))).drop("cuts_")
    high = Window.partitionBy(*by).orderBy(F.desc("bin_")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = binned.groupBy(*by, "bin_").agg(F.sum("n_").alias("bn_"), F.sum("p_").alias("bp_"))
    offsets = offsets.select(*by, "bin_", F.coalesce(F.sum("bn_").over(high), F.lit(0)).alias("n0_"), F.coalesce(F.sum("bp_").over(high), F.lit(0)).alias("p0_"))
    up = Window.partitionBy(*by, "bin_").orderBy(F.desc("score_")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = binned.withColumns({"cn_": F.sum("n_").over(up), "cp_": F.sum("p_").over(up)}).join(offsets, [*by, "bin_"])
    ranked = ranked.withColumns({"cn_": F.col("cn_") + F.col("n0_"), "cp_": F.col("cp_") + F.col("p0_")})
    taken = [F.least(F.greatest(F.lit(float(k)) - (F.col("cn_") - F.col("n_")), F.lit(0.0)), F.col("n_").cast("double")) for k in budgets]
    hits = [F.sum(F.col("p_") * t / F.col("n_")).alias(f"hits_{i}") for i, t in enumerate(taken)]
    one = ranked.groupBy(*by).agg(F.sum("n_").alias("n"), F.sum("p_").alias("positives"), F.sum(F.col("p_") * F.col("cp_") / F.col("cn_")).alias("ap_"), *hits)
    each = one.withColumn("at_", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("budget"), F.col(f"hits_{i}").alias("hits")) for i, k in enumerate(budgets)])))
    some = F.col("positives") > 0
    return each.select(
        *by, "at_.budget", "n", "positives", (F.col("positives") / F.col("n")).alias("prevalence"), (F.col("at_.hits") / F.least("at_.budget", "n")).alias("precision"),
        F.when(some, F.col("at_.hits") / F.col("positives")).alias("recall"), F.when(some, F.col("ap_") / F.col("positives")).alias("average_precision"),
    )
