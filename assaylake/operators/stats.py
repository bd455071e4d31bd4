"""Correlations, meta-analysis, enrichment and metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions.scalars import safe_corr
from assaylake.operators.windows import average_rank


def rank_pairs(x: DataFrame, y: DataFrame, by: list[str], sample: str, xs: tuple[str, str], ys: tuple[str, str]) -> DataFrame:
    """by, entity, target, n, rho: Spearman over the samples of the group; x and y are complete over them (entity, value)."""
    rx = x.select(*by, sample, xs[0], average_rank(xs[1], [*by, xs[0]]).alias("rx_"))
    ry = y.select(*by, sample, ys[0], average_rank(ys[1], [*by, ys[0]]).alias("ry_"))
    pairs = rx.join(ry, [*by, sample]).groupBy(*by, xs[0], ys[0])
    return pairs.agg(F.count("*").alias("n"), safe_corr("rx_", "ry_").alias("rho"))


def t_of(rho: Column, n: Column, covariates: int = 0) -> Column:
    df = n - 2 - covariates
    return rho * F.sqrt(df / F.greatest(1 - rho * rho, F.lit(1e-15)))


def partial(r, x: str, y: str, given: list[str]) -> Column:
    """Partial correlation from pairwise ones by the recursion over the covariates; r(a, b) is the column of a pair."""
    if not given:
        return r(x, y)
    z, rest = given[0], given[1:]
    xy, xz, yz = partial(r, x, y, rest), partial(r, x, z, rest), partial(r, y, z, rest)
    return F.try_divide(xy - xz * yz, F.sqrt(F.greatest((1 - xz * xz) * (1 - yz * yz), F.lit(0.0))))


def partial_rank_pairs(x: DataFrame, y: DataFrame, z: DataFrame, by: list[str], sample: str, xs: tuple[str, str], ys: tuple[str, str], covariates: list[str]) -> DataFrame:
    """As rank_pairs, adjusted for the columns of z; one shuffle of pairs, the covariates ride along with both sides."""
    rz = z.select(*by, sample, *[average_rank(c, by).alias(f"z_{c}") for c in covariates])
    rx = x.select(*by, sample, xs[0], average_rank(xs[1], [*by, xs[0]]).alias("rx_")).join(rz, [*by, sample])
    ry = y.select(*by, sample, ys[0], average_rank(ys[1], [*by, ys[0]]).alias("ry_"))
    names = {"x": "rx_", "y": "ry_", **{c: f"z_{c}" for c in covariates}}
    order = list(names)
    sums = [safe_corr(names[a], names[b]).alias(f"c_{a}_{b}") for i, a in enumerate(order) for b in order[i + 1 :]]
    stats = rx.join(ry, [*by, sample]).groupBy(*by, xs[0], ys[0]).agg(F.count("*").alias("n"), *sums)
    r = lambda a, b: F.col(f"c_{a}_{b}" if order.index(a) < order.index(b) else f"c_{b}_{a}")
    return stats.select(*by, xs[0], ys[0], "n", r("x", "y").alias("rho"), partial(r, "x", "y", covariates).alias("rho_adjusted"))


def impact(before: Column, after: Column, least: float = 0.15, share: float = 0.5) -> Column:
    strong = F.abs(before) >= least
    return F.when(before.isNull() | after.isNull(), "unavailable").when(~strong, "weak_before").when(F.signum(before) != F.signum(after), "sign_flip").when(F.abs(after) < share * F.abs(before), F.when(F.abs(after) < least, "lost").otherwise("attenuated")).otherwise("retained")


def fisher_meta(df: DataFrame, by: list[str], rho: str, weight: Column) -> DataFrame:
    """Weighted mean of atanh, back-transformed; the weights are n - 3 or the like."""
    z = F.sum(weight * F.atanh(F.least(F.greatest(F.col(rho), F.lit(-0.999999)), F.lit(0.999999)))) / F.sum(weight)
    return df.groupBy(*by).agg(F.tanh(z).alias("rho_meta"), (z * F.sqrt(F.sum(weight))).alias("z"), F.count("*").alias("k"))


def random_effects(df: DataFrame, by: list[str], effect: str, se: str) -> DataFrame:
    """DerSimonian-Laird: two aggregates, the second with 1 / (variance + tau2)."""
    w, b = 1 / (F.col(se) * F.col(se)), F.col(effect)
    one = df.groupBy(*by).agg(F.count("*").alias("k"), F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), F.sum(w * b).alias("swb"), F.sum(w * b * b).alias("swbb"))
    q = F.col("swbb") - F.col("swb") * F.col("swb") / F.col("sw")
    c = F.col("sw") - F.col("sww") / F.col("sw")
    one = one.select(*by, "k", q.alias("q"), F.when((F.col("k") > 1) & (c > 0), F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / c)).otherwise(0.0).alias("tau2"))
    v = 1 / (F.col(se) * F.col(se) + F.col("tau2"))
    two = df.join(one, by).groupBy(*by).agg(F.first("k").alias("k"), F.first("q").alias("q"), F.first("tau2").alias("tau2"), (F.sum(v * b) / F.sum(v)).alias("beta"), F.sqrt(1 / F.sum(v)).alias("se"))
    i2 = F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / F.col("q"))).otherwise(0.0)
    return two.withColumns({"i2": i2, "z": F.col("beta") / F.col("se")})


def log_factorials(spark, n: int) -> Column:
    """Array column of ln(i!) for 0..n, a running sum; for small n (each step copies the array), log_factorial takes any."""
    start = F.struct(F.lit(0.0).alias("s"), F.array(F.lit(0.0)).alias("a"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda acc, i: F.struct((acc["s"] + F.ln(i)).alias("s"), F.concat(acc["a"], F.array(acc["s"] + F.ln(i))).alias("a")), lambda acc: acc["a"])


def log_factorial(n: Column) -> Column:
    """ln(n!) in closed form: Stirling's series at n + 9, less the eight factors stepped over."""
    x = n.cast("double") + 9
    y = 1 / (x * x)
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x
    return series - sum((F.ln(x - k) for k in range(2, 9)), F.ln(x - 1))


def _upper_tail(ln, hit: Column, drawn: Column, size: Column, total: Column) -> Column:
    choose = lambda a, b: ln(a) - ln(b) - ln(a - b)
    top = F.least(drawn, size)
    low = F.greatest(hit, drawn + size - total, F.lit(0))
    return F.when(low > top, 0.0).otherwise(F.aggregate(F.sequence(low, top), F.lit(0.0), lambda s, i: s + F.exp(choose(size, i) + choose(total - size, drawn - i) - choose(total, drawn)))).cast("double")


def hypergeometric_tail(lf: Column, hit: Column, drawn: Column, size: Column, total: Column) -> Column:
    """P[X >= hit] for `drawn` of `total` with `size` marked; lf: array of log factorials."""
    return _upper_tail(lambda n: F.element_at(lf, (n + 1).cast("int")), hit, drawn, size, total)


def enrichment_p(hit: Column, drawn: Column, size: Column, total: Column) -> Column:
    """As hypergeometric_tail for a universe of any size: nothing is built or broadcast that grows with it."""
    return _upper_tail(log_factorial, hit, drawn, size, total)


def simes(df: DataFrame, by: list[str], p: str, tie: list[str]) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(*by).orderBy(p, *tie))
    n = F.count(p).over(Window.partitionBy(*by))
    return df.where(F.col(p).isNotNull()).withColumn("s_", F.col(p) * n / r).groupBy(*by).agg(F.least(F.lit(1.0), F.min("s_")).alias("p_simes"), F.count("*").alias("tests"))


def binary_metrics(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """auroc and average precision with ties, brier, log loss; null where one class is missing."""
    y = F.col(label).cast("double")
    tied = df.groupBy(*by, score).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    down = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    steps = tied.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down), "below": F.coalesce(F.sum("neg").over(up), F.lit(0.0))})
    ranked = steps.groupBy(*by).agg(
        (F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.try_divide(F.lit(1.0), F.try_divide(F.lit(1.0), F.sum("pos") * F.sum("neg")))).alias("auroc"),
        (F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.try_divide(F.lit(1.0), F.try_divide(F.lit(1.0), F.sum("pos")))).alias("average_precision"),
    )
    s = F.least(F.greatest(F.col(score), F.lit(1e-12)), F.lit(1 - 1e-12))
    plain = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"), F.avg(-(y * F.ln(s) + (1 - y) * F.ln(1 - s))).alias("log_loss"))
    return plain.join(ranked, by)


def regression_metrics(df: DataFrame, by: list[str], truth: str, guess: str) -> DataFrame:
    e = F.col(truth) - F.col(guess)
    sse, sst = F.sum(e * e), F.var_pop(truth) * F.count("*")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(sst > 0, 1 - sse / sst).alias("r2"))


def bootstrap_difference(df: DataFrame, unit: str, a: str, b: str, replicates: int, seed: int = 1) -> DataFrame:
    """Percentile interval of mean(a) - mean(b) when units are resampled; a unit's Poisson weight comes from a hash of seed,
    replicate and unit, so it doesn't depend on partitioning. Replicate sums are pre-aggregated before they meet."""
    per = df.groupBy(unit).agg(F.sum(F.col(a) - F.col(b)).alias("d"), F.count("*").alias("n"))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("rep"), F.col(unit)), F.lit(1 << 30)) / float(1 << 30)
    cuts, p, total = [], math.exp(-1), 0.0
    for k in range(12):
        total += p
        cuts.append(total)
        p /= k + 1
    weight = sum(((u >= c).cast("int") for c in cuts[1:]), (u >= cuts[0]).cast("int"))
    reps = per.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight)
    means = reps.groupBy("rep").agg((F.sum(F.col("w") * F.col("d")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    point = per.agg((F.sum("d") / F.sum("n")).alias("difference"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.count("m").alias("replicates")).join(point)


def jaccard_pairs(members: DataFrame, group: str, item: str) -> DataFrame:
    """a, b, shared, jaccard of groups that share an item; groups meet by item, sizes are joined afterwards."""
    m = members.select(group, item).distinct()
    left, right = m.withColumnRenamed(group, "a"), m.withColumnRenamed(group, "b")
    shared = left.join(right, item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    n = m.groupBy(group).agg(F.count("*").alias("size"))
    out = shared.join(n.withColumnRenamed(group, "a").withColumnRenamed("size", "na"), "a").join(n.withColumnRenamed(group, "b").withColumnRenamed("size", "nb"), "b")
    return out.withColumn("jaccard", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b", "shared", "jaccard")


def interaction_hc3(df: DataFrame, by: list[str], y: str, x: str, group: str) -> DataFrame:
    """Slopes of y on x in two groups (0, 1), their difference and its HC3 standard error: two passes, no per-group fit."""
    g = [*by, group]
    first = df.groupBy(*g).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.covar_pop(x, y).alias("cxy"))
    first = first.where("vx > 0 and n > 3").withColumn("slope", F.col("cxy") / F.col("vx")).withColumn("icept", F.col("my") - F.col("slope") * F.col("mx"))
    dx = F.col(x) - F.col("mx")
    lev = 1 / F.col("n") + dx * dx / (F.col("n") * F.col("vx"))
    res = (F.col(y) - F.col("icept") - F.col("slope") * F.col(x)) / (1 - lev)
    second = df.join(first, g).groupBy(*g).agg(F.first("n").alias("n"), F.first("slope").alias("slope"), (F.sum(dx * dx * res * res) / F.pow(F.first(F.col("n") * F.col("vx")), 2)).alias("var"))
    pick = lambda k, c: F.max(F.when(F.col(group) == k, F.col(c)))
    out = second.groupBy(*by).agg(pick(0, "slope").alias("slope_0"), pick(1, "slope").alias("slope_1"), (pick(0, "var") + pick(1, "var")).alias("v"))
    return out.withColumns({"difference": F.col("slope_1") - F.col("slope_0"), "se": F.sqrt("v")}).withColumn("z", F.col("difference") / F.col("se")).drop("v")
