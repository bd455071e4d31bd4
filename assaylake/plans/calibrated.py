"""Calibrated combinations, models and stability over the driver tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from assaylake.operators import grouping as GR
from assaylake.operators import interaction as I
from assaylake.operators import nulls as N
from assaylake.operators import penalised as P
from assaylake.operators import screen as SC
from assaylake.operators import subtypes as ST
from assaylake.plans.association import DENSE, pairs, sparse, t_tail
from assaylake.plans.binding import query


@query("sta09_empirical_fisher")
def _(t):
    """Parts are relations, line numbers readouts; p is a price's place among a readout's, dependence the correlation of two
    readouts' p over parts that have both, unknown below 100 of them; lines 6 and 7 are duplicates of one assay."""
    per = t.lineitem.groupBy("l_partkey", "l_linenumber").agg(F.min("l_extendedprice").alias("price"))
    price = t.lineitem.groupBy("l_linenumber", "l_extendedprice").agg(F.count("*").alias("c"))
    up = Window.partitionBy("l_linenumber").orderBy("l_extendedprice")
    p = (F.sum("c").over(up) - F.col("c") / 2) / F.sum("c").over(Window.partitionBy("l_linenumber"))
    placed = price.withColumn("p", p).select("l_linenumber", F.col("l_extendedprice").alias("price"), "p")
    own = per.join(placed, ["l_linenumber", "price"]).select("l_partkey", F.col("l_linenumber").alias("line"), F.when(F.col("line") > 5, 6).otherwise(F.col("line")).alias("assay"), "p")
    other = own.select("l_partkey", F.col("line").alias("b"), F.col("p").alias("q"))
    both = own.join(other, "l_partkey").where("line < b").groupBy(F.col("line").alias("a"), "b").agg(F.count("*").alias("n"), F.corr("p", "q").alias("rho"))
    found = N.empirical_fisher(own, both.where("n >= 100"), "l_partkey", "line", "assay", "p", 20_000)
    return found.select("l_partkey", "k", F.round("p", 9).alias("p"), "method")


def brand_profiles(t):
    """Part types are pathways, nations of suppliers cohorts, brands members with their line counts."""
    s = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return s.groupBy(F.col("p_type").alias("pathway"), F.col("n_name").alias("cohort"), F.col("p_brand").alias("member")).agg(F.count("*").cast("double").alias("weight"))


GATE = ("silhouette", "ari", "similarity", "low", "high")


@query("gst04_subtypes")
def _(t):
    found, _ = ST.pathway_subtypes(brand_profiles(t), "pathway", "cohort", "member", "weight")
    return found.select("pathway", "cohort", "subtype", "status", "k", "proposed", *[F.round(c, 9).alias(c) for c in GATE])


@query("gst05_programs")
def _(t):
    found, near = ST.pathway_subtypes(brand_profiles(t), "pathway", "cohort", "member", "weight")
    families = t.part.select(F.col("p_type").alias("pathway"), F.split("p_type", " ")[0].alias("family")).distinct()
    programs, _ = ST.program_subtypes(found, near, families, "pathway", "cohort", "family")
    return programs.select("cohort", "subtype", "status", "k", "proposed", F.round("silhouette", 9).alias("silhouette"), F.round("ari", 9).alias("ari"))


SCREEN = ("mean_rho", "meta_rho", "agreement", "p")


@query("sc03_exact_effects", f"""WITH {DENSE}, c AS (SELECT cohort, entity, target, corr(rx, ry) AS rho FROM rx JOIN ry USING (cohort, sample) GROUP BY ALL HAVING count(*) >= 3), z AS (SELECT *, atanh(greatest(least(rho, 0.999999), -0.999999)) AS z FROM c WHERE rho IS NOT NULL AND NOT isnan(rho)),
g AS (SELECT entity, target, count(*) AS sources, avg(rho) AS mean_rho, tanh(avg(z)) AS meta_rho, greatest(count(*) FILTER (rho > 0), count(*) FILTER (rho <= 0)) / count(*) AS agreement, avg(z) AS m, stddev_samp(z) AS sd FROM z GROUP BY ALL HAVING count(*) >= 3 AND abs(tanh(avg(z))) >= 0.02),
r AS (SELECT *, sources - 1 AS df, m / (sd / sqrt(sources)) / sqrt(pow(m / (sd / sqrt(sources)), 2) + sources - 1) AS q FROM g)
SELECT entity, target, sources, round(mean_rho, 6) AS mean_rho, round(meta_rho, 6) AS meta_rho, round(agreement, 6) AS agreement, round({t_tail("q", "df")}, 6) AS p, row_number() OVER (PARTITION BY entity ORDER BY round(abs(meta_rho), 9) DESC, round(agreement, 9) DESC, target) AS rank FROM r QUALIFY rank <= 25""")
def _(t):
    found = SC.combined(pairs(t, min_n=3), "entity", "target", least=0.02)
    return found.select("entity", "target", "sources", *[F.round(c, 6).alias(c) for c in SCREEN], "rank")


@query("sc03_screened_effects")
def _(t):
    """As sc03_exact_effects, for the pairs that sketches propose."""
    x, y, samples = sparse(t)
    found = SC.screened_pairs(x, y, samples, "cohort", "sample", ("entity", "value"), ("target", "score"), least=0.02)
    return found.select("entity", "target", "sources", *[F.round(c, 6).alias(c) for c in SCREEN], "rank")


def folded(samples):
    """Five folds by a checksum of the sample."""
    return samples.select("cohort", "sample", (F.crc32(F.col("sample").cast("string").cast("binary")) % 5).cast("int").alias("fold"))


def ridge_of(x, y, samples):
    return P.ridge(x, y, folded(samples), ["cohort"], "sample", "fold", ("entity", "value"), ("target", "score"))


@query("ml02_spectral_ridge")
def _(t):
    """Out-of-fold predictions of all targets from all entities, penalty by the next fold."""
    x, y, samples = sparse(t)
    return ridge_of(x, y, samples).select("cohort", "sample", "target", "fold", "observed", F.round("predicted", 6).alias("predicted"), F.round("baseline", 6).alias("baseline"), "penalty")


@query("ml03_lasso_weights")
def _(t):
    """Weights and selection frequency of the entities that screened Lasso models of the folds use."""
    x, y, samples = sparse(t)
    w = P.screened_lasso(x, y, folded(samples), ["cohort"], "sample", "fold", ("entity", "value"), ("target", "score"), fdr=0.25)
    return P.selection(w, ["cohort"], "target", "entity").select("cohort", "target", "entity", "folds", "frequency", F.round("weight", 6).alias("weight"), "same_sign")


@query("ml04_fitted_arms")
def _(t):
    """Three arms on the same held-out rows: spending by brand, quantity by part size, both."""
    x, y, samples = sparse(t)
    sizes = t.sales().groupBy(F.col("n_name").alias("cohort"), F.col("c_custkey").alias("sample"), F.concat(F.lit("size:"), F.col("p_size")).alias("entity")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("value"))
    features = x.withColumn("kind", F.lit("brand")).unionByName(sizes.withColumn("kind", F.lit("size")))
    arms = {"one": ["brand"], "two": ["size"], "both": ["brand", "size"]}
    found = P.arm_metrics(P.ridge_arms(features, y, folded(samples), ["cohort"], "sample", "fold", ("entity", "value"), ("target", "score"), "kind", arms), ["target"])
    return found.select("target", "arm", "n", *[F.round(c, 6).alias(c) for c in ("rmse", "r2", "skill")])


@query("sc05_metacell_groups")
def _(t):
    """Vectors are cells, labels types, a vector's number by seven its donor; donors 0 to 4 fit the space and the radius."""
    cells = t.embeddings.select("vec_id", "label", (F.col("vec_id") % 7).alias("donor"), "embedding")
    train = F.col("donor") < 5
    space = GR.local_space(cells, "embedding", train, 8)
    found, _ = GR.disjoint_groups(space, ["donor", "label"], "vec_id", "z", train)
    return found.select("donor", "label", "vec_id", "seed")


@query("sta13_hc3")
def _(t):
    """Price on quantity, returned lines against others, with discount and tax as covariates, by brand."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "l_extendedprice", "l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("returned"), "l_discount", "l_tax")
    found = I.interaction(rows, ["p_brand"], "l_extendedprice", "l_quantity", "returned", ["l_discount", "l_tax"])
    return found.select("p_brand", "n", "n_0", "n_1", "unknown", "reason", *[F.round(c, 4).alias(c) for c in ("slope_0", "slope_1", "difference", "difference_se", "difference_low", "difference_high")], F.round("p", 8).alias("p"), F.round("q", 8).alias("q"))
