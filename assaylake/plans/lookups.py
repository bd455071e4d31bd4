"""Normalised source tables, context-keyed tests, and user-level look-ups: compositions of the operators."""

from pyspark.sql import functions as F

from assaylake.functions.scalars import safe_corr, stable_id
from assaylake.operators import graph as G
from assaylake.operators import joins as J
from assaylake.operators import stats as S
from assaylake.operators import survival as U
from assaylake.operators import windows as W
from assaylake.operators.blocks import adjusted_p
from assaylake.plans.association import DENSE, pairs, t_tail
from assaylake.plans.binding import MEASUREMENTS, query
from assaylake.plans.evidence import SURV, survival
from assaylake.plans.shape import NEAR, near

R6 = lambda *names: {n: F.round(n, 6) for n in names}


@query("id19_functional", "SELECT l_orderkey, l_partkey AS gene, 'fold' AS source, CASE WHEN l_linestatus = 'O' THEN -(l_discount - 0.04) ELSE l_discount - 0.04 END AS effect, CASE WHEN l_tax > 0 THEN l_tax END AS q, l_tax > 0 AS available, CASE WHEN l_tax <= 0 THEN 'no_q' END AS reason FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_partkey, 'splice', l_discount, NULL, false, 'not_tested' FROM lineitem WHERE l_returnflag = 'A'")
def _(t):
    one = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_partkey").alias("gene"), F.lit("fold").alias("source"), F.when(F.col("l_linestatus") == "O", -(F.col("l_discount") - 0.04)).otherwise(F.col("l_discount") - 0.04).alias("effect"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("q"), (F.col("l_tax") > 0).alias("available"), F.when(F.col("l_tax") <= 0, "no_q").alias("reason"))
    two = t.lineitem.where("l_returnflag = 'A'").select("l_orderkey", F.col("l_partkey").alias("gene"), F.lit("splice").alias("source"), F.col("l_discount").alias("effect"), F.lit(None).cast("double").alias("q"), F.lit(False).alias("available"), F.lit("not_tested").alias("reason"))
    return one.unionByName(two)


@query("id21_markers", "SELECT p_partkey, CASE WHEN p_size < 10 THEN regexp_extract(p_name || '_pS' || CAST(p_size AS VARCHAR), '_p([STY])([0-9]+)$', 2) END AS site, CASE WHEN p_size < 10 THEN 'phosphosite' WHEN p_brand < 'Brand#3' THEN 'exact' ELSE 'composite' END AS kind FROM part")
def _(t):
    label = F.when(F.col("p_size") < 10, F.concat("p_name", F.lit("_pS"), F.col("p_size").cast("string"))).otherwise(F.col("p_name"))
    site = F.nullif(F.regexp_extract(label, "_p([STY])([0-9]+)$", 2), F.lit(""))
    return t.part.select("p_partkey", site.alias("site"), F.when(site.isNotNull(), "phosphosite").when(F.col("p_brand") < "Brand#3", "exact").otherwise("composite").alias("kind"))


@query("id22_studies", "WITH RECURSIVE tok AS MATERIALIZED (SELECT DISTINCT l_orderkey AS r, l_partkey AS p FROM lineitem), f AS (SELECT r, min(r) OVER (PARTITION BY p) AS v FROM tok), e AS MATERIALIZED (SELECT r AS u, v FROM f UNION SELECT v, r FROM f), c(node, k) USING KEY (node) AS (SELECT DISTINCT u, u FROM e UNION (SELECT e.v, min(c.k) FROM c JOIN e ON c.node = e.u JOIN recurring.c AS now ON now.node = e.v WHERE c.k < now.k GROUP BY e.v)) SELECT node AS record, k AS study FROM c")
def _(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("r"), F.array(F.concat(F.lit("o"), "l_orderkey"), F.concat(F.lit("p"), "l_partkey")).alias("tokens"))
    tokens = rows.select("r", F.explode("tokens").alias("token"))
    first = tokens.groupBy("token").agg(F.min("r").alias("v"))  # a token ties its records to the least of them: no pairs within a token
    found = G.components(tokens.join(first, "token").select(F.col("r").alias("u"), "v").distinct())
    return found.select(F.col("node").alias("record"), F.col("component").alias("study"))


@query("id23_states", "WITH s AS (SELECT n_name AS cohort, c_custkey AS k, unnest(['balance', 'balance_positive', 'nation']) AS state, unnest([c_acctbal, CASE WHEN c_acctbal > 0 THEN c_acctbal END, CAST(c_nationkey AS DOUBLE)]) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT state, count(v) AS n, count(DISTINCT CASE WHEN v IS NOT NULL THEN k END) AS samples, count(DISTINCT CASE WHEN v IS NOT NULL THEN cohort END) AS cohorts, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS sd, min(v) AS least, max(v) AS most, CASE WHEN state LIKE 'balance%' THEN 'account' ELSE 'other' END AS grp FROM s GROUP BY state")
def _(t):
    wide = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("cohort"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance_positive"), F.col("c_nationkey").cast("double").alias("nation"))
    long = wide.unpivot(["cohort", "k"], ["balance", "balance_positive", "nation"], "state", "v")
    there = lambda c: F.count_distinct(F.when(F.col("v").isNotNull(), F.col(c)))
    return long.groupBy("state").agg(F.count("v").alias("n"), there("k").alias("samples"), there("cohort").alias("cohorts"), F.round(F.avg("v"), 5).alias("mean"), F.round(F.stddev_samp("v"), 5).alias("sd"), F.min("v").alias("least"), F.max("v").alias("most"), F.when(F.col("state").rlike("^balance"), "account").otherwise("other").alias("grp"))


@query("id25_assertions", "SELECT 'ev:' || substr(sha256(CAST(l_suppkey AS VARCHAR) || '|' || CAST(l_partkey AS VARCHAR) || '|' || l_returnflag), 1, 20) AS event_id, l_suppkey AS entity, l_partkey AS target, count(*) AS records FROM lineitem GROUP BY l_suppkey, l_partkey, l_returnflag")
def _(t):
    return t.lineitem.groupBy("l_suppkey", "l_partkey", "l_returnflag").agg(F.count("*").alias("records")).select(stable_id("ev", F.col("l_suppkey"), F.col("l_partkey"), F.col("l_returnflag")).alias("event_id"), F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("target"), "records")


@query("sta17_donor_pairs", "WITH d AS (SELECT p_brand, o_custkey, avg(l_extendedprice) AS x, avg(l_tax) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT p_brand, count(*) AS donors, round(corr(x, y), 6) AS r FROM d GROUP BY 1 HAVING count(*) >= 10")
def _(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    d = rows.groupBy("p_brand", "o_custkey").agg(F.avg("l_extendedprice").alias("x"), F.avg("l_tax").alias("y"))
    return d.groupBy("p_brand").agg(F.count("*").alias("donors"), F.round(safe_corr("x", "y"), 6).alias("r")).where("donors >= 10")


@query("sta21_state_edges", "SELECT p_type AS family, l_returnflag AS state, round(sum(p_size * (l_discount - 0.0431)) / sum(p_size), 6) AS effect, min(l_tax) AS min_fdr, count(*) AS edges FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def _(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_type").alias("family"), F.col("l_returnflag").alias("state")).agg(F.round(F.sum(F.col("p_size") * (F.col("l_discount") - 0.0431)) / F.sum("p_size"), 6).alias("effect"), F.min("l_tax").alias("min_fdr"), F.count("*").alias("edges"))


@query("sc02_context_associations", f"WITH {DENSE}, k AS (SELECT cohort, entity, target, corr(rx, ry) AS rho, count(*) AS n FROM rx JOIN ry USING (cohort, sample) GROUP BY ALL HAVING count(*) >= 55), p AS (SELECT *, {t_tail("rho", "(n - 2)")} AS p FROM k WHERE rho IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY p, entity, target) AS r, count(*) OVER (PARTITION BY cohort) AS m FROM p) SELECT cohort, entity, target, n, round(rho, 6) + 0.0 AS rho, round(least(1, min(p * m / r) OVER (PARTITION BY cohort ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r")
def _(t):
    r = pairs(t, tested=True, min_n=55).where("rho is not null")
    return adjusted_p(r, "p", ["cohort"]).select("cohort", "entity", "target", "n", F.round("rho", 6).alias("rho"), F.round("q", 6).alias("q"))


@query("sur07_fold_scan", f"""WITH {SURV.replace("PARTITION BY entity", "PARTITION BY entity, fold").replace("SELECT entity, time, sum(event) AS d", "SELECT entity, sample % 3 AS fold, time, sum(event) AS d")}, z AS (SELECT entity, fold, sum(xd - d * xr / n) AS u, sum(d * (xxr / n - (xr / n) * (xr / n))) AS i FROM rk WHERE d > 0 GROUP BY ALL), b AS (SELECT entity, u / i AS b, 1 / sqrt(i) AS s FROM z WHERE i > 1e-12),
oo AS (SELECT entity, count(*) AS k, sum(1 / (s * s)) AS sw, sum(1 / (s * s * s * s)) AS sww, sum(b / (s * s)) AS swb, sum(b * b / (s * s)) AS swbb FROM b GROUP BY 1), t AS (SELECT entity, k, CASE WHEN k > 1 THEN greatest(0, (swbb - swb * swb / sw - (k - 1)) / (sw - sww / sw)) ELSE 0 END AS tau2 FROM oo)
SELECT entity, any_value(k) AS k, round(sum(b / (s * s + tau2)) / sum(1 / (s * s + tau2)), 5) AS beta, round(sqrt(1 / sum(1 / (s * s + tau2))), 5) AS se FROM b JOIN t USING (entity) GROUP BY 1""")
def _(t):
    scan = U.cox_one_step(survival(t).withColumn("fold", F.col("sample") % 3), ["entity", "fold"], "time", "event", "value").where("beta is not null")
    return S.random_effects(scan, ["entity"], "beta", "se").select("entity", "k", F.round("beta", 5).alias("beta"), F.round("se", 5).alias("se"))


@query("gen03_accessibility", f"WITH {NEAR}, h AS (SELECT l_orderkey, l_linenumber, count(*) AS peaks, avg(be - bs) AS width FROM a JOIN b USING (chrom) WHERE s < be AND bs < e GROUP BY ALL), k AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) SELECT k.l_orderkey AS l_orderkey, k.l_linenumber AS l_linenumber, peaks, round(width, 6) AS width, CASE WHEN peaks IS NULL THEN 'not_covered' END AS reason FROM k LEFT JOIN h USING (l_orderkey, l_linenumber)")
def _(t):
    a, b = near(t)
    h = J.binned(a, b, ["chrom"], ("s", "e"), ("bs", "be"), 64, coarser=2).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("peaks"), F.round(F.avg(F.col("be") - F.col("bs")), 6).alias("width"))
    declared = t.lineitem.select("l_orderkey", "l_linenumber").distinct()
    return J.universe(h, declared, ["l_orderkey", "l_linenumber"], "peaks", "not_covered")


@query("ml04_three_arms", "WITH u AS (SELECT l_returnflag, l_extendedprice AS y, unnest(['one', 'two', 'both']) AS arm, unnest([1400.0 * l_quantity, 38000 + 100000 * l_tax, 1400.0 * l_quantity + 10000 * l_tax]) AS g FROM lineitem) SELECT l_returnflag, arm, count(*) AS n, round(sqrt(avg(pow(y - g, 2))), 4) AS rmse, round(1 - sum(pow(y - g, 2)) / (var_pop(y) * count(*)), 6) AS r2 FROM u GROUP BY ALL")
def _(t):
    q, x = F.col("l_quantity"), F.col("l_tax")
    wide = t.lineitem.select("l_returnflag", F.col("l_extendedprice").alias("y"), (1400.0 * q).alias("one"), (38000 + 100000 * x).alias("two"), (1400.0 * q + 10000 * x).alias("both"))
    long = wide.unpivot(["l_returnflag", "y"], ["one", "two", "both"], "arm", "g")
    return S.regression_metrics(long, ["l_returnflag", "arm"], "y", "g").select("l_returnflag", "arm", "n", F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


@query("qry04_support", "SELECT l_suppkey, l_partkey, l_discount FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.0799 AND l_suppkey BETWEEN 10 AND 30 ORDER BY l_discount DESC, l_suppkey, l_partkey LIMIT 100")
def _(t):
    hit = t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.0799) & F.col("l_suppkey").between(10, 30))
    return W.page(hit, [F.desc("l_discount"), F.col("l_suppkey"), F.col("l_partkey")], 100).select("l_suppkey", "l_partkey", "l_discount")


@query("qry06_expression_lookup", f"WITH {MEASUREMENTS} SELECT n.n_name AS cohort, count(m.value) AS n, round(avg(m.value), 6) AS mean, CASE WHEN count(m.value) = 0 THEN 'no_measurement' END AS reason FROM nation n LEFT JOIN m ON m.cohort = n.n_name AND m.entity = 'Brand#11' AND m.sample % 50 = 3 GROUP BY 1")
def _(t):
    m = t.measurements().where("entity = 'Brand#11' and sample % 50 = 3").groupBy("cohort").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return t.nation.select(F.col("n_name").alias("cohort")).join(m, "cohort", "left").select("cohort", F.coalesce("n", F.lit(0)).alias("n"), "mean", F.when(F.col("n").isNull(), "no_measurement").alias("reason"))


@query("qry07_interaction_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE l_suppkey = 7 AND l_linestatus = 'O' ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25 OFFSET 25")
def _(t):
    return W.page(t.lineitem.where("l_suppkey = 7 and l_linestatus = 'O'"), [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 25, 25).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
