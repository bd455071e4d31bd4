"""Modules of entities by their signed edge profiles."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.operators.graph import _written

SEEDS = 4096  #: entities, least by hash, among which the first centers are chosen


def profile_space(edges: DataFrame, entity: str, target: str, weight: str, components: int) -> DataFrame:
    """entity, z: the entity's row of the signed entity x target matrix in the space of its first singular vectors, of length 1.

    The decomposition is the distributed one of MLlib: the driver holds vectors as long as the number of targets, never rows.
    Repeated edges are summed; rows of zeros have a zero z.
    """
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    e = _written(edges.groupBy(F.col(entity).alias("e_"), F.col(target).alias("t_")).agg(F.sum(F.col(weight).cast("double")).alias("w_")), "profile-edges")
    names = [r.t_ for r in e.select("t_").distinct().orderBy("t_").collect()]
    spark, n = edges.sparkSession, len(names)
    if not n:
        return edges.select(entity).limit(0).withColumn("z", F.array().cast("array<double>"))
    kind = e.schema["t_"].dataType.simpleString()
    places = spark.createDataFrame(list(zip(names, range(n))), f"t_ {kind}, i_ int")
    rows = e.join(places, "t_").groupBy("e_").agg(F.array_sort(F.collect_list(F.struct("i_", "w_"))).alias("row_")).select("row_")
    found = RowMatrix(rows.rdd.map(lambda r: Vectors.sparse(n, [(x.i_, x.w_) for x in r.row_])), numCols=n).computeSVD(min(components, n), False)
    v = found.V.toArray()
    axes = spark.createDataFrame([(name, [float(x) for x in v[i]]) for i, name in enumerate(names)], f"t_ {kind}, v_ array<double>")
    placed = e.join(axes, "t_").groupBy("e_").agg(*[F.sum(F.col("w_") * F.col("v_")[j]).alias(f"z{j}") for j in range(v.shape[1])])
    raw = F.array(*[F.col(f"z{j}") for j in range(v.shape[1])])
    norm = F.sqrt(sum((F.col(f"z{j}") * F.col(f"z{j}") for j in range(v.shape[1])), F.lit(0.0)))
    return placed.select(F.col("e_").alias(entity), F.when(norm > 1e-12, F.transform(raw, lambda x: x / norm)).otherwise(F.transform(raw, lambda x: x * 0)).alias("z"))


def spread_centers(z: np.ndarray, k: int) -> np.ndarray:
    """k rows, each the farthest from those before it; ties by place. The first is the first row."""
    chosen, far = [0], None
    while len(chosen) < min(k, len(z)):
        d = ((z - z[chosen[-1]]) ** 2).sum(1)
        far = d if far is None else np.minimum(far, d)
        chosen.append(int(np.argmax(np.round(far, 9))))
    return z[chosen]


def assigned(space: DataFrame, entity: str, k: int, rounds: int = 50) -> DataFrame:
    """entity, label: Lloyd's rounds over all rows from centers spread over a hash-ordered sample of SEEDS rows; the same for any order of rows."""
    from pyspark.mllib.clustering import KMeans, KMeansModel
    from pyspark.mllib.linalg import Vectors

    space = _written(space, "profile-space")
    first = space.orderBy(F.xxhash64(entity), entity).limit(SEEDS).select("z").collect()
    start = spread_centers(np.array([r.z for r in first]), k)
    points = space.select("z").rdd.map(lambda r: Vectors.dense(r.z))
    fit = KMeans.train(points, len(start), maxIterations=rounds, initialModel=KMeansModel([Vectors.dense(c) for c in start]))
    centers = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in fit.centers])
    distance = lambda c: F.round(F.aggregate(F.zip_with("z", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x), 9)
    near = F.transform(centers, distance)
    return space.select(entity, (F.array_position(near, F.array_min(near)) - 1).cast("int").alias("label"))


def medians(rows: DataFrame, by: str, value: str, bins: int = 255) -> DataFrame:
    """by, median: the exact median of a group's values. Values are cut into bins by quantiles of all; only the bins that hold a
    group's middle are numbered, so no group is sorted, or held, by one task. rows are read three times."""
    rows = rows.select(by, F.col(value).cast("double").alias("v_")).where("v_ is not null")
    edges = sorted(set(rows.agg(F.percentile_approx("v_", F.array(*[F.lit((i + 1) / (bins + 1)) for i in range(bins)]), F.lit(10_000))).first()[0] or []))
    bin_ = F.size(F.filter(F.array(*[F.lit(float(x)) for x in edges]), lambda x: x < F.col("v_"))) if edges else F.lit(0)
    counts = rows.withColumn("bin_", bin_).groupBy(by, "bin_", "v_").agg(F.count("*").alias("c_"))
    sizes = counts.groupBy(by, "bin_").agg(F.sum("c_").alias("in_"))
    up = Window.partitionBy(by).orderBy("bin_")
    sizes = sizes.withColumns({"before_": F.sum("in_").over(up) - F.col("in_"), "n_": F.sum("in_").over(Window.partitionBy(by))})
    low, high = F.floor((F.col("n_") + 1) / 2), F.floor(F.col("n_") / 2) + 1
    holds = sizes.where((low > F.col("before_")) & (low <= F.col("before_") + F.col("in_")) | (high > F.col("before_")) & (high <= F.col("before_") + F.col("in_")))
    placed = counts.join(holds, [by, "bin_"]).withColumn("to_", F.col("before_") + F.sum("c_").over(Window.partitionBy(by, "bin_").orderBy("v_")))
    takes = lambda at: F.max(F.when((at <= F.col("to_")) & (at > F.col("to_") - F.col("c_")), F.col("v_")))
    return placed.groupBy(by).agg(((takes(low) + takes(high)) / 2).alias("median"))


def modules(edges: DataFrame, entity: str, target: str, weight: str, components: int = 32, most: int = 40) -> tuple[DataFrame, DataFrame]:
    """Members and summary of modules of entities with like signed profiles; null ends or weights are no edges.

    members: entity, module, member_rank, strength (sum of |weight|), n_edges, positive, negative, representative.
    summary: module, members, targets, n_edges, mean_abs, median_abs, representative, top_targets (25 by summed |weight|).
    There are sqrt(n / 2) modules, 2 to `most`. A module's representative is its strongest member (ties: the least); modules are
    numbered in the order of their representatives, so numbers don't depend on the order of rows.
    """
    e, named = labelled_members(edges, entity, target, weight, components, most)
    return ranked_members(named, entity), module_summary(e, named, entity, target, weight)


def labelled_members(edges: DataFrame, entity: str, target: str, weight: str, components: int = 32, most: int = 40) -> tuple[DataFrame, DataFrame]:
    """The edges without nulls, and every entity with its module, that module's head_ and what its own edges sum up to."""
    e = edges.where(F.col(entity).isNotNull() & F.col(target).isNotNull() & F.col(weight).isNotNull()).select(entity, target, weight)
    e = _written(e, "module-edges")
    strength = e.groupBy(entity).agg(F.sum(F.abs(weight)).alias("strength"), F.count("*").alias("n_edges"), F.count_if(F.col(weight) > 0).alias("positive"), F.count_if(F.col(weight) < 0).alias("negative"))
    n = strength.count()
    if n < 2:
        labelled = strength.select(entity, F.lit(0).alias("label"))
    else:
        labelled = assigned(profile_space(e, entity, target, weight, min(components, n)), entity, min(most, n, max(2, round(math.sqrt(n / 2)))))
    joined = _written(labelled.join(strength, entity), "module-labels")
    order = F.struct((-F.round("strength", 9)).alias("s"), F.col(entity).alias("name"))
    heads = joined.groupBy("label").agg(F.min(order).getField("name").alias("head_"))
    heads = heads.withColumn("module", F.row_number().over(Window.orderBy("head_")))  # at most `most` rows
    return e, _written(joined.join(F.broadcast(heads), "label"), "module-members")


def ranked_members(named: DataFrame, entity: str) -> DataFrame:
    ranked = F.row_number().over(Window.partitionBy("module").orderBy(F.desc(F.round("strength", 9)), entity))
    return named.select(entity, "module", ranked.alias("member_rank"), "strength", "n_edges", "positive", "negative", (F.col(entity) == F.col("head_")).alias("representative"))


def module_summary(e: DataFrame, named: DataFrame, entity: str, target: str, weight: str) -> DataFrame:
    inside = e.join(named.select(entity, "module"), entity).select("module", target, F.abs(weight).alias("abs_"))
    sums = _written(inside.groupBy("module", target).agg(F.round(F.sum("abs_"), 9).alias("s_")), "module-targets")
    own = named.groupBy("module").agg(F.count("*").alias("members"), F.sum("n_edges").alias("n_edges"), (F.sum("strength") / F.sum("n_edges")).alias("mean_abs"), F.min("head_").alias("representative"))
    targets, middle = sums.groupBy("module").agg(F.count("*").alias("targets")), medians(inside, "module", "abs_").withColumnRenamed("median", "median_abs")
    summary = own.join(targets, "module").join(middle, "module").select("module", "members", "targets", "n_edges", "mean_abs", "median_abs", "representative")
    top = sums.withColumn("r_", F.row_number().over(Window.partitionBy("module").orderBy(F.desc("s_"), target))).where("r_ <= 25")
    tops = top.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("r_", F.col(target).alias("t")))).getField("t").alias("top_targets"))
    return summary.join(tops, "module")
