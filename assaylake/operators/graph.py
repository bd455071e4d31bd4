"""Edges, neighbourhoods, bounded paths, components, communities, rewiring."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage by a table in the cluster's shared folder."""
    spark = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.mkdtemp(prefix='spark-graph-')}"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def neighbourhood(edges: DataFrame, node, limit: int, offset: int = 0, roles: list[str] | None = None) -> DataFrame:
    """Edges (a, b, role, weight) that touch a node, heaviest first, paged."""
    hit = edges.where((F.col("a") == node) | (F.col("b") == node))
    hit = hit.where(F.col("role").isin(roles)) if roles else hit
    return hit.orderBy(F.desc("weight"), "a", "b", "role").offset(offset).limit(limit)


def layered_paths(first: DataFrame, middle: DataFrame, last: DataFrame, per_query: int, parts: int | None = None) -> DataFrame:
    """first(source, m1), middle(m1, m2), last(m2, target): paths source-m1-(m2)-target with at most one middle edge; shorter,
    then lexically first, at most `per_query` a source and target. No middle edge: m1 is m2. Ends are put together before
    sources meet them, no more than `per_query` of a length from an m1 to a target; parts: tasks that paths are dealt to."""
    kind = first.schema["m1"].dataType
    ends = last.select("m2", "target").distinct()
    near = ends.select(F.col("m2").alias("m1"), "target", F.lit(2).alias("length"), F.lit(None).cast(kind).alias("m2"))
    far = middle.where("m1 <> m2").select("m1", "m2").distinct().join(ends, "m2").select("m1", "target", F.lit(3).alias("length"), "m2")
    own = Window.partitionBy("m1", "target", "length").orderBy("m2")
    few = near.unionAll(far.withColumn("r_", F.row_number().over(own)).where(F.col("r_") <= per_query).drop("r_"))
    dealt = lambda df, *by: df.repartition(parts, *by) if parts else df
    paths = dealt(first.select("source", "m1"), "m1").distinct().join(dealt(few, "m1"), "m1").select("source", "target", "m1", "m2", "length")
    w = Window.partitionBy("source", "target").orderBy("length", "m1", F.col("m2").asc_nulls_first())
    return dealt(paths, "source", "target").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_query)


def best_paths(edges: DataFrame, start: DataFrame, hops: int, beam: int | None = None) -> DataFrame:
    """start(node). Simple paths of up to `hops` directed edges (a, b, weight) by product of |weight| clipped to [0, 1]; all paths,
    or with a `beam` those that follow from the best so many of each start at each hop (a stated search width).

    With a beam, steps that can't be among the best are left out where front and edges meet: a path whose last node has beam + hops
    edges has beam steps, whatever it may not visit again, no worse than the last of these edges."""
    w = F.least(F.greatest(F.abs("weight"), F.lit(0.0)), F.lit(1.0))
    e = edges.select("a", "b", w.alias("w")).groupBy("a", "b").agg(F.max("w").alias("w"))
    front = start.select(F.col("node").alias("start"), F.array("node").alias("path"), F.lit(1.0).alias("score"), F.col("node").alias("at"))
    if beam is not None:
        e = _written(e, "path-edges")
        turn = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w")))
        least = _written(e.withColumn("r_", turn).where(F.col("r_") <= beam + hops).where(F.col("r_") == beam + hops).select("a", F.col("w").alias("least_")), "path-least")
    found = None
    for _ in range(hops):
        met, fits = front, F.lit(True)
        if beam is not None:
            bars = front.join(least, front["at"] == least["a"]).groupBy("start").agg(F.max(F.col("score") * F.col("least_")).alias("bar_"))
            met, fits = front.join(bars, "start", "left"), F.col("bar_").isNull() | (F.round(F.col("score") * F.col("w"), 12) >= F.round("bar_", 12))
        step = met.join(e, met["at"] == e["a"]).where(~F.array_contains("path", F.col("b"))).where(fits)
        step = step.select("start", F.concat("path", F.array("b")).alias("path"), (F.col("score") * F.col("w")).alias("score"), F.col("b").alias("at"))
        rank = F.row_number().over(Window.partitionBy("start").orderBy(F.desc(F.round("score", 12)), "path"))
        front = step if beam is None else _written(step.withColumn("r_", rank).where(F.col("r_") <= beam).drop("r_"), "path-front")
        found = front if found is None else found.unionAll(front)
    return found.select("start", F.col("at").alias("end"), "path", "score")


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v): node, component = the least node it can reach. A round sends each node to the least neighbour of its least
    neighbour (itself counted), and edges that still join two places are the next round's; so later rounds read what is left only."""
    left, sent = _written(edges.select("u", "v"), "component-edges"), []
    while True:
        both = left.unionAll(left.select("v", "u"))
        near = _written(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("near")), "component-near")
        up = near.select(F.col("node").alias("near"), F.col("near").alias("place"))
        sent.append(_written(near.join(up, "near").select("node", "place"), "component-places"))
        at = lambda c: sent[-1].select(F.col("node").alias(c), F.col("place").alias(f"{c}_"))
        moved = left.join(at("u"), "u").join(at("v"), "v").where("u_ <> v_")
        left = _written(moved.select(F.least("u_", "v_").alias("u"), F.greatest("u_", "v_").alias("v")).distinct(), "component-edges")
        if left.isEmpty():
            break
    now = sent.pop()
    while sent:  # a place that had no edge left is the least of its component
        last = now.select(F.col("node").alias("place"), F.col("place").alias("least_"))
        now = _written(sent.pop().join(last, "place", "left").select("node", F.coalesce("least_", "place").alias("place")), "components")
    return now.select("node", F.col("place").alias("component"))


def communities(edges: DataFrame, rounds: int) -> DataFrame:
    """edges(u, v, weight): label propagation, `rounds` synchronous steps; each node takes the label of most weight, ties to the
    least label; a node's own label counts with its heaviest edge, which stops labels from swapping."""
    both = edges.select("u", "v", "weight").unionAll(edges.select("v", "u", "weight"))
    own = both.groupBy("u").agg(F.max("weight").alias("weight")).select("u", F.col("u").alias("v"), "weight")
    both = _written(both.unionAll(own), "community-edges")
    now = both.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = both.join(now, both.v == now.node).groupBy("u", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("u").agg(F.max_by("label", F.struct(F.round("w", 9), -F.col("label"))).alias("label"))
        now = _written(best.withColumnRenamed("u", "node"), "communities")
    return now


def rewired(edges: DataFrame, src: str, dst: str, kind: str, seed: int) -> DataFrame:
    """The targets of each kind dealt anew to its edges by hash order: counts of sources and targets stay. The ranks are per
    kind and hash slice, so that no kind is one task's sort."""
    h = lambda *c: F.xxhash64(F.lit(seed), *c)
    slices = F.pmod(h(src, dst, F.lit("slice")), F.lit(64))
    e = edges.withColumn("slice_", slices)
    a = e.withColumn("i_", F.row_number().over(Window.partitionBy(kind, "slice_").orderBy(h(src, dst, F.lit("a")), src, dst)))
    b = e.select(kind, "slice_", F.col(dst).alias("new_dst"), F.row_number().over(Window.partitionBy(kind, "slice_").orderBy(h(src, dst, F.lit("b")), src, dst)).alias("i_"))
    return a.join(b, [kind, "slice_", "i_"]).drop("slice_", "i_")


def split_known(edges: DataFrame, a: str, b: str, share: float, seed: str = "links"):
    """train or test by a hash of the pair."""
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col(a).cast("string"), F.col(b).cast("string")), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return edges.withColumn("split", F.when(u < share, "train").otherwise("test"))


def degree_prior(train: DataFrame, candidates: DataFrame, a: str, b: str) -> DataFrame:
    """Candidates that aren't train edges, scored by the product of their ends' train degrees."""
    da, db = train.groupBy(a).agg(F.count("*").alias("da")), train.groupBy(b).agg(F.count("*").alias("db"))
    fresh = candidates.join(train.select(a, b), [a, b], "left_anti")
    return fresh.join(da, a, "left").join(db, b, "left").fillna(0, ["da", "db"]).withColumn("score", F.col("da") * F.col("db"))
