"""The composed operators over the driver tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from assaylake.operators import blocks as B
from assaylake.operators import extended as X
from assaylake.operators import stats as S
from assaylake.operators import windows as W
from assaylake.plans.association import DENSE, RANKED, pairs, query_members, ranked
from assaylake.plans.binding import MEASUREMENTS, query


@query("agg21_typed_binding", """WITH f AS (SELECT l_suppkey AS entity, l_partkey AS gene, l_linenumber AS accession, l_linestatus AS cohort, l_returnflag AS assay, l_tax < 0.04 AS exact FROM lineitem), g AS (SELECT p_partkey AS lookup, p_brand AS protein, p_size / 50.0 AS weight FROM part), a AS (SELECT DISTINCT p_size AS lookup, p_brand AS protein, 0.5 AS weight FROM part WHERE p_size < 4),
u AS (SELECT entity, protein, cohort, assay, CASE WHEN exact THEN 1.0 ELSE 0.4 END * weight AS w, 'gene' AS route FROM f JOIN g ON gene = lookup UNION ALL SELECT entity, protein, cohort, assay, CASE WHEN exact THEN 1.0 ELSE 0.4 END * weight, 'accession' FROM f JOIN a ON accession = lookup)
SELECT entity, protein, cohort, assay, round(max(w), 6) AS weight, string_agg(DISTINCT route, ';' ORDER BY route) AS routes FROM u GROUP BY ALL""")
def _(t):
    f = t.lineitem.select(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("gene"), F.col("l_linenumber").alias("accession"), F.col("l_linestatus").alias("cohort"), F.col("l_returnflag").alias("assay"), (F.col("l_tax") < 0.04).alias("exact"))
    g = t.part.select(F.col("p_partkey").alias("lookup"), F.col("p_brand").alias("protein"), (F.col("p_size") / 50.0).alias("weight"))
    a = t.part.where("p_size < 4").select(F.col("p_size").alias("lookup"), F.col("p_brand").alias("protein"), F.lit(0.5).alias("weight")).distinct()
    return X.typed_binding(f, g, a).withColumn("weight", F.round("weight", 6))


@query("agg23_relation_counts", "SELECT l_suppkey, l_linestatus, count(*) FILTER (WHERE l_discount > 0.0799) AS strong, count(*) FILTER (WHERE l_discount > 0.0399 AND l_discount <= 0.0799) AS weak, bit_or(1 << l_linenumber) AS bits, bit_count(bit_or(1 << l_linenumber)) AS assays FROM lineitem GROUP BY ALL")
def _(t):
    label = F.when(F.col("l_discount") > 0.0799, "strong").when(F.col("l_discount") > 0.0399, "weak").otherwise("unlabeled")
    return X.relation_counts(t.lineitem.withColumns({"label": label, "bit": F.expr("shiftleft(1, l_linenumber)")}), ["l_suppkey", "l_linestatus"], "label", "bit")


@query("agg26_assay_detail", """WITH f AS (SELECT l_orderkey, l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), d AS (SELECT * FROM lineitem WHERE l_returnflag = 'A'), e AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS d FROM d GROUP BY ALL), o AS (SELECT l_orderkey, min(l_linenumber) AS d FROM d GROUP BY 1)
SELECT f.l_orderkey AS l_orderkey, f.l_partkey AS l_partkey, f.l_suppkey AS l_suppkey, n, coalesce(e.d, o.d) AS detail, CASE WHEN e.d IS NOT NULL THEN 'exact' WHEN o.d IS NOT NULL THEN 'loose' ELSE 'none' END AS strength FROM f LEFT JOIN e ON f.l_orderkey = e.l_orderkey AND f.l_suppkey = e.l_suppkey LEFT JOIN o ON f.l_orderkey = o.l_orderkey""")
def _(t):
    f = t.lineitem.where("l_returnflag = 'R'").groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return X.assay_detail(f, t.lineitem.where("l_returnflag = 'A'"), ["l_orderkey", "l_suppkey"], ["l_orderkey"], "l_linenumber")


@query("agg27_absorption", "SELECT l_suppkey, count(*) FILTER (WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) AS already, count(*) FILTER (WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) AS fresh FROM lineitem GROUP BY 1")
def _(t):
    return X.absorbed(t.lineitem, t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", ["l_suppkey"])


@query("agg29_bridge", "SELECT b.l_suppkey AS entity, p.p_type AS target, count(DISTINCT p.p_brand) AS proteins FROM (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size <= 3) p JOIN (SELECT DISTINCT p_brand, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey) b ON p.p_brand = b.p_brand GROUP BY ALL")
def _(t):
    bind = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", F.col("l_suppkey").alias("entity"))
    return X.bridge(t.part.withColumnRenamed("p_type", "target"), bind, "p_brand", "target", "entity", "p_size", 3)


@query("sta08_dependent_fisher", """WITH pv AS (SELECT l_suppkey, l_returnflag AS r, min(l_extendedprice) / 210001.0 AS p FROM lineitem GROUP BY ALL), s AS (SELECT l_suppkey, sum(-2 * ln(p)) AS x, count(*) AS k, min(p) AS m FROM pv GROUP BY 1), dep AS (SELECT 'A' AS a, 'N' AS b, 0.5 AS rho UNION ALL SELECT 'A', 'R', -0.2),
c AS (SELECT x.l_suppkey, sum(CASE WHEN rho >= 0 THEN rho * (3.25 + 0.75 * rho) ELSE rho * (3.27 + 0.71 * rho) END) AS cov, count(*) FILTER (WHERE rho IS NULL) AS un FROM pv x JOIN pv y ON x.l_suppkey = y.l_suppkey AND x.r < y.r LEFT JOIN dep ON a = x.r AND b = y.r GROUP BY 1)
SELECT l_suppkey, k, round(x / ((4 * k + 2 * coalesce(cov, 0)) / (4 * k)), 5) AS chi2, round(8 * k * k / (4 * k + 2 * coalesce(cov, 0)), 6) AS df, coalesce(un, 0) AS unknown, round(least(1, k * m), 6) AS bonferroni FROM s LEFT JOIN c USING (l_suppkey)""")
def _(t):
    pv = t.lineitem.groupBy("l_suppkey", F.col("l_returnflag").alias("r")).agg((F.min("l_extendedprice") / 210001.0).alias("p"))
    dep = t.spark.createDataFrame([("A", "N", 0.5), ("A", "R", -0.2)], "a string, b string, rho double")
    return X.dependent_fisher(pv, dep, "l_suppkey", "r", "p").withColumns({"chi2": F.round("chi2", 5), "df": F.round("df", 6), "bonferroni": F.round("bonferroni", 6)})


@query("sta14_cross_screen", "WITH r AS (SELECT l_returnflag, l_suppkey, l_linenumber, (rank() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_linenumber, l_extendedprice) - 1) / 2.0) / count(*) OVER (PARTITION BY l_returnflag, l_linenumber) AS pct FROM lineitem) SELECT l_suppkey, l_linenumber, round(avg(pct), 6) AS response, count(DISTINCT l_returnflag) AS screens FROM r GROUP BY ALL")
def _(t):
    return X.cross_screen(t.lineitem, "l_returnflag", "l_suppkey", "l_linenumber", "l_extendedprice").withColumn("response", F.round("response", 6))


@query("sta15_conditions", "WITH w AS (SELECT l_suppkey, l_returnflag, corr(l_extendedprice, l_tax) AS rho, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 30), f AS (SELECT l_suppkey, l_returnflag, l_linenumber, corr(l_extendedprice, l_tax) AS r FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_returnflag, any_value(n) AS n, round(any_value(rho), 6) AS rho, round(avg(CASE WHEN sign(r) = sign(rho) THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM f JOIN w USING (l_suppkey, l_returnflag) WHERE r IS NOT NULL AND NOT isnan(r) GROUP BY ALL")
def _(t):
    return X.conditions(t.lineitem, ["l_suppkey"], ["l_returnflag"], "l_linenumber", "l_extendedprice", "l_tax", 30).withColumns({"rho": F.round("rho", 6), "agreement": F.round("agreement", 6)})


def order_values(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy(F.col("n_name").alias("cohort"), F.col("c_custkey").alias("sample"), F.col("o_orderpriority").alias("target")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double").alias("score"))


@query("sta03_masked", f"""WITH {MEASUREMENTS}, y AS (SELECT n_name AS cohort, c_custkey AS sample, o_orderpriority AS target, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS score FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
p AS (SELECT cohort, entity, target, value, score FROM m JOIN y USING (cohort, sample)), r AS (SELECT cohort, entity, target, rank() OVER (PARTITION BY cohort, entity, target ORDER BY value) + (count(*) OVER (PARTITION BY cohort, entity, target, value) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY cohort, entity, target ORDER BY score) + (count(*) OVER (PARTITION BY cohort, entity, target, score) - 1) / 2.0 AS ry FROM p)
SELECT cohort, entity, target, count(*) AS n, round(corr(rx, ry), 6) + 0.0 AS rho FROM r GROUP BY ALL HAVING count(*) >= 12""")
def _(t):
    m, y = t.measurements(), order_values(t)
    r = B.associate(m, y, m.select("cohort", "sample").distinct(), ["cohort"], "sample", ("entity", "value"), ("target", "score"), fill=None, min_n=12, tested=False)
    return r.where("n >= 12").select("cohort", "entity", "target", "n", F.round("rho", 6).alias("rho"))


@query("sta03_nuisance", """WITH m AS (SELECT n_name AS cohort, c_custkey AS sample, p_brand AS entity, ln(1 + sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0) AS value, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS own FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
y AS (SELECT n_name AS cohort, c_custkey AS sample, o_orderpriority AS target, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS score FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
j AS (SELECT cohort, entity, target, own, c_acctbal AS a, rank() OVER w1 + (count(*) OVER (PARTITION BY cohort, entity, target, value) - 1) / 2.0 AS x, rank() OVER w2 + (count(*) OVER (PARTITION BY cohort, entity, target, score) - 1) / 2.0 AS y FROM m JOIN y USING (cohort, sample) JOIN customer ON sample = c_custkey WINDOW w1 AS (PARTITION BY cohort, entity, target ORDER BY value), w2 AS (PARTITION BY cohort, entity, target ORDER BY score)),
s AS (SELECT cohort, entity, target, count(*) AS n, count(*) * var_pop(a) AS aa, count(*) * covar_pop(x, a) AS xa, count(*) * covar_pop(y, a) AS ya, count(*) * covar_pop(own, a) AS ca, count(*) * var_pop(x) AS xx, count(*) * var_pop(y) AS yy, count(*) * var_pop(own) AS cc, count(*) * covar_pop(x, y) AS xy, count(*) * covar_pop(x, own) AS xc, count(*) * covar_pop(y, own) AS yc FROM j GROUP BY ALL HAVING count(*) >= 12),
r AS (SELECT cohort, entity, target, n, xx - xa * xa / aa AS xx, yy - ya * ya / aa AS yy, cc - ca * ca / aa AS cc, xy - xa * ya / aa AS xy, xc - xa * ca / aa AS xc, yc - ya * ca / aa AS yc FROM s)
SELECT cohort, entity, target, n, round((xy - xc * yc / cc) / sqrt((xx - xc * xc / cc) * yy), 6) AS rho_adjusted, n - 4 AS df FROM r""")
def _(t):
    """Spending against order value, over the samples that have both; quantity is the entity's own nuisance, the balance a covariate."""
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    m = t.sales().groupBy(F.col("n_name").alias("cohort"), F.col("c_custkey").alias("sample"), F.col("p_brand").alias("entity")).agg(F.log1p(cents / 100.0).alias("value"), F.sum(F.col("l_quantity").cast("long")).cast("double").alias("own"))
    samples = t.patients().join(t.customer.select(F.col("c_custkey").alias("sample"), F.col("c_acctbal").alias("a")), "sample")
    r = B.associate(m, order_values(t), samples, ["cohort"], "sample", ("entity", "value"), ("target", "score"), numbers=["a"], fill=None, nuisance="own", min_n=12, tested=False)
    return r.where("n >= 12").select("cohort", "entity", "target", "n", F.round("rho_adjusted", 6).alias("rho_adjusted"), "df")


@query("sta16_fusion", """WITH a AS (SELECT x.p_brand AS a, y.p_brand AS b, count(DISTINCT x.p_type) / 150.0 AS s FROM part x JOIN part y ON x.p_type = y.p_type AND x.p_brand < y.p_brand  GROUP BY ALL), b AS (SELECT x.p_brand AS a, y.p_brand AS b, count(DISTINCT x.p_size) / 50.0 AS s FROM part x JOIN part y ON x.p_size = y.p_size AND x.p_brand < y.p_brand GROUP BY ALL)
SELECT a, b, round(sum(s * w) / sum(w), 6) AS similarity, count(*) AS views FROM (SELECT *, 0.7 AS w FROM a UNION ALL SELECT *, 0.3 FROM b) GROUP BY ALL""")
def _(t):
    def view(df, item, size):
        m = df.select("p_brand", item).distinct()
        return m.withColumnRenamed("p_brand", "a").join(m.withColumnRenamed("p_brand", "b"), item).where("a < b").groupBy("a", "b").agg((F.count("*") / size).alias("similarity"))

    return X.similarity_fusion({"types": (view(t.part, "p_type", 150.0), 0.7), "sizes": (view(t.part, "p_size", 50.0), 0.3)}).withColumn("similarity", F.round("similarity", 6))


@query("sta22_paired_arms", "WITH r AS (SELECT l_returnflag, pow(l_discount * 9 - y, 2) - pow(l_tax * 11 - y, 2) AS d FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS y FROM lineitem) QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1) SELECT l_returnflag, count(*) AS n, round(avg(d), 6) AS difference, count(*) FILTER (WHERE d < 0) AS a_better, count(*) FILTER (WHERE d > 0) AS b_better FROM r GROUP BY 1")
def _(t):
    key, values = ["l_orderkey", "l_linenumber"], ["l_returnflag", "l_linestatus", "l_discount", "l_tax"]
    once = t.lineitem.repartition(t.parts("lineitem"), *key).groupBy(*key).agg(F.count("*").alias("c"), *[F.min(c).alias(c) for c in values]).where("c = 1")
    rows = once.withColumn("y", (F.col("l_linestatus") == "O").cast("double"))
    arm = lambda s: rows.select("l_orderkey", "l_linenumber", "l_returnflag", "y", s.alias("s"))
    return X.paired_arms(arm(F.col("l_discount") * 9), arm(F.col("l_tax") * 11), ["l_orderkey", "l_linenumber"], ["l_returnflag"], "y", "s").withColumn("difference", F.round("difference", 6))


@query("sur06_residual", f"WITH {MEASUREMENTS}, x AS (SELECT m.*, c_acctbal FROM m JOIN customer ON sample = c_custkey), f AS (SELECT entity, regr_slope(value, c_acctbal) AS b, regr_intercept(value, c_acctbal) AS a FROM x WHERE sample % 5 > 0 GROUP BY 1) SELECT sample, entity, round(value - a - b * c_acctbal, 6) AS residual FROM x LEFT JOIN f USING (entity)")
def _(t):
    x = t.measurements().join(t.customer.select(F.col("c_custkey").alias("sample"), "c_acctbal"), "sample")
    return X.residualised(x, ["entity"], "value", "c_acctbal", F.col("sample") % 5 > 0).select("sample", "entity", F.round("residual", 6).alias("residual"))


@query("ml03_screen", f"WITH {DENSE}, c AS (SELECT cohort, target, entity, corr(rx, ry) AS rho, count(*) AS n FROM rx JOIN ry USING (cohort, sample) GROUP BY ALL) SELECT cohort, target, entity, n, round(rho, 6) AS rho, row_number() OVER (PARTITION BY cohort, target ORDER BY round(abs(rho), 9) DESC, entity) AS rank FROM c WHERE abs(rho) >= 0.1 QUALIFY rank <= 5")
def _(t):
    r = pairs(t, least=0.1)
    return W.top_k(r, ["cohort", "target"], [F.desc(F.round(F.abs("rho"), 9)), F.col("entity")], 5).select("cohort", "target", "entity", "n", F.round("rho", 6).alias("rho"), "rank")


@query("ml08_experts")
def _(t):
    key = ["s", "p"]
    base = t.lineitem.select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 100).alias("p"), "l_linenumber", "l_discount", "l_tax", (F.col("l_returnflag") == "R").cast("double").alias("label"))
    experts = {n: base.where(F.col("l_linenumber") == i).groupBy(*key).agg(F.max(c).alias("value")) for n, i, c in (("one", 1, "l_discount"), ("two", 2, "l_tax"))}
    return X.expert_frame(base.select(*key).distinct(), base, experts, key, key, 5).withColumn("soft_target", F.round("soft_target", 6))


@query("qry01_mixed", """WITH n AS (SELECT (SELECT count(*) FROM part) AS total, (SELECT count(*) FROM part WHERE p_size > 47) AS drawn), s AS (SELECT p_type AS target, count(*) AS size, count(*) FILTER (WHERE p_size > 47) AS hit FROM part GROUP BY 1), k AS (SELECT target, hit, size, total, drawn, unnest(range(greatest(hit, 0), least(size, drawn) + 1)) AS i FROM s, n),
g AS (SELECT target, least(1, -log10(greatest(sum(exp(lgamma(size + 1.0) - lgamma(i + 1.0) - lgamma(size - i + 1.0) + lgamma(total - size + 1.0) - lgamma(drawn - i + 1.0) - lgamma(total - size - drawn + i + 1.0) - lgamma(total + 1.0) + lgamma(drawn + 1.0) + lgamma(total - drawn + 1.0))), 1e-300)) / 10) AS gs FROM k GROUP BY 1),
e AS (SELECT p_type AS target, avg(l_discount) AS es, count(*) AS entities FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT target, round(gs, 6) AS gene_score, round(es, 6) AS entity_score, entities, round(sqrt(gs * es), 6) AS score FROM g JOIN e USING (target)""")
def _(t):
    sets = t.part.groupBy(F.col("p_type").alias("target")).agg(F.count("*").alias("size"), F.count_if(F.col("p_size") > 47).alias("hit"))
    drawn = query_members(t).count()
    n = t.part.agg(F.count("*").alias("total")).withColumn("drawn", F.lit(drawn))
    genes = sets.join(F.broadcast(n)).select("target", S.enrichment_p(F.col("hit"), F.col("drawn"), F.col("size"), F.col("total")).alias("p"))
    entities = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_type").alias("target"), F.col("l_discount").alias("association"))
    return X.mixed_channels(genes, entities, "target", 100).withColumns({c: F.round(c, 6) for c in ("gene_score", "entity_score", "score")})


@query("gst05_program_similarity", f"""WITH {RANKED}, w AS (SELECT member % 4 AS family, name, member, 1.0 / rank AS w FROM rk), t AS (SELECT family, name, sum(w) AS t FROM w GROUP BY ALL), l AS (SELECT x.family AS family, x.name AS a, y.name AS b, sum(least(x.w, y.w)) AS low FROM w x JOIN w y ON x.family = y.family AND x.member = y.member AND x.name < y.name GROUP BY ALL),
s AS (SELECT a.name AS a, b.name AS b, coalesce(low, 0) / (a.t + b.t - coalesce(low, 0)) AS s FROM t a JOIN t b ON a.family = b.family AND a.name < b.name LEFT JOIN l ON l.family = a.family AND l.a = a.name AND l.b = b.name) SELECT a, b, round(avg(s), 6) AS similarity, count(*) AS families FROM s GROUP BY ALL""")
def _(t):
    from assaylake.operators.genesets import weighted_jaccard

    w = ranked(t).withColumn("w", 1.0 / F.col("rank")).withColumn("family", F.col("member") % 4)
    per = weighted_jaccard(w, ["family"], "name", "member", "w")
    return per.groupBy("a", "b").agg(F.round(F.avg("similarity"), 6).alias("similarity"), F.count("*").alias("families"))
