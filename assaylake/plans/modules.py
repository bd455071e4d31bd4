"""Modules of signed profiles over the driver tables."""

from pyspark.sql import functions as F

from assaylake.operators import modules as M
from assaylake.operators.graph import _written
from assaylake.plans.binding import query


def edges(t):
    """Parts are entities; targets are buyers' nations by return flag; the weight is the log of a part's quantity there against
    the quantity that the part's and the target's totals make expected."""
    q = _written(t.sales().groupBy("p_partkey", F.concat_ws("|", "n_name", "l_returnflag").alias("place")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q")), "module-quantities")
    part, place, whole = q.groupBy("p_partkey").agg(F.sum("q").alias("qp")), q.groupBy("place").agg(F.sum("q").alias("qt")), q.agg(F.sum("q").alias("qa"))
    met = q.join(part, "p_partkey").join(place, "place").join(F.broadcast(whole))
    return met.select("p_partkey", "place", F.log(F.col("q") * F.col("qa") / (F.col("qp") * F.col("qt"))).alias("w"))


@query("ml06_profile_modules")
def _(t):
    _, named = M.labelled_members(edges(t), "p_partkey", "place", "w")
    return M.ranked_members(named, "p_partkey").withColumn("strength", F.round("strength", 6))


@query("ml06_module_summary")
def _(t):
    _, summary = M.modules(edges(t), "p_partkey", "place", "w")
    return summary.select("module", "members", "targets", "n_edges", F.round("mean_abs", 6).alias("mean_abs"), F.round("median_abs", 6).alias("median_abs"), "representative", F.array_join("top_targets", ",").alias("top_targets"))
