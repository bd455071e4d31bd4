"""Evidence, survival and graph operators over the driver tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from assaylake.operators import evidence as E
from assaylake.operators import graph as G
from assaylake.operators import survival as U
from assaylake.plans.binding import MEASUREMENTS, PATIENTS, query

R6 = lambda *names: {n: F.round(n, 6) for n in names}


@query("agg01_summary", f"WITH {MEASUREMENTS}, {PATIENTS}, n AS (SELECT cohort, count(*) AS ns FROM pat GROUP BY 1) SELECT cohort, entity, count(*) AS n, count(DISTINCT sample) AS samples, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, round(var_samp(value), 6) AS variance, round(count(*) FILTER (WHERE value > 0) / any_value(ns), 6) AS detection_rate FROM m JOIN n USING (cohort) GROUP BY ALL")
def _(t):
    n = t.patients().groupBy("cohort").agg(F.count("*").alias("ns"))
    out = E.expression_summary(t.measurements().join(F.broadcast(n), "cohort"), ["cohort", "entity"], "sample", "value", F.col("ns"))
    return out.withColumns(R6("mean", "median", "q25", "q75", "variance", "detection_rate"))


NL = "least(greatest(-log10(greatest(l_tax / 100 + 0.000001, 1e-300)) / 10, 0), 1)"


@query("agg02_bulk_support", f"SELECT l_suppkey, l_returnflag, round(max(abs(l_discount - 0.043) * {NL}), 6) AS support, round(max_by(l_discount - 0.043, abs(l_discount - 0.043)), 6) AS effect, round(min(l_tax / 100 + 0.000001), 9) AS min_fdr, count(DISTINCT l_partkey) AS targets FROM lineitem GROUP BY ALL")
def _(t):
    rows = t.lineitem.withColumn("e", F.col("l_discount") - 0.043).withColumn("q", F.col("l_tax") / 100 + 0.000001)
    return E.bulk_support(rows, ["l_suppkey", "l_returnflag"], "e", "q", "l_partkey").withColumns(R6("support", "effect")).withColumn("min_fdr", F.round("min_fdr", 9))


@query("agg03_cell_support", f"SELECT l_suppkey, l_partkey % 50 AS k, round(max(tanh(abs(l_discount - 0.043)) * {NL} * least(1, ln(1 + l_quantity) / ln(21)) * CASE WHEN sign(l_discount - 0.043) = CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END THEN 1 ELSE 0.5 END * CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.6 ELSE 0 END), 9) AS support FROM lineitem GROUP BY ALL")
def _(t):
    rows = t.lineitem.withColumns({"k": F.col("l_partkey") % 50, "e": F.col("l_discount") - 0.043, "q": F.col("l_tax") / 100 + 0.000001, "sg": F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1)})
    return E.cell_support(rows, ["l_suppkey", "k"], "e", "q", "l_quantity", "l_returnflag", "sg", {"R": 1.0, "A": 0.6}).withColumn("support", F.round("support", 9))


@query("agg04_interaction_support", "SELECT l_suppkey, p_brand, count(DISTINCT l_orderkey) AS events, 1e0 * max(CASE WHEN regexp_matches(lower(p_type), 'promo|standard') THEN 1.0 WHEN lower(p_type) LIKE '%small%' THEN 0.6 ELSE 0.3 END) AS level, round(least(1, ln(1 + count(DISTINCT l_orderkey)) / ln(11)) * max(CASE WHEN regexp_matches(lower(p_type), 'promo|standard') THEN 1.0 WHEN lower(p_type) LIKE '%small%' THEN 0.6 ELSE 0.3 END), 6) AS support FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def _(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return E.interaction_support(rows, ["l_suppkey", "p_brand"], "l_orderkey", "p_type", [("promo|standard", 1.0), ("small", 0.6)], 0.3).withColumns(R6("support"))


@query("agg05_drug_support", "SELECT l_suppkey, l_partkey % 97 AS k, round(max(CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.75 ELSE 0.5 * tanh(abs(l_discount)) END * least(1, l_linenumber / 3)), 6) AS support, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS statuses FROM lineitem GROUP BY ALL")
def _(t):
    return E.drug_support(t.lineitem.withColumn("k", F.col("l_partkey") % 97), ["l_suppkey", "k"], "l_returnflag", "l_discount", "l_linenumber", {"R": 1.0, "A": 0.75}).withColumns(R6("support"))


FUSED = """g AS (SELECT l_suppkey AS s, l_partkey AS p, max(l_discount * 10) FILTER (WHERE l_returnflag = 'R') AS a, max(l_tax * 12) FILTER (WHERE l_returnflag = 'A') AS b, max(l_quantity / 50.0) FILTER (WHERE l_returnflag = 'N') AS c, max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END) FILTER (WHERE l_returnflag = 'R') AS da, min(CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END) FILTER (WHERE l_returnflag = 'A') AS db FROM lineitem GROUP BY ALL)"""


def fused(t):
    pick = lambda f, flag, v: f(F.when(F.col("l_returnflag") == flag, v))
    sg = F.when(F.col("l_linestatus") == "O", 1).otherwise(-1)
    return t.lineitem.groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).agg(
        pick(F.max, "R", F.col("l_discount") * 10).alias("a"), pick(F.max, "A", F.col("l_tax") * 12).alias("b"), pick(F.max, "N", F.col("l_quantity") / 50.0).alias("c"), pick(F.max, "R", sg).alias("da"), pick(F.min, "A", sg).alias("db")
    )


@query("agg06_score", f"""WITH {FUSED}, x AS (SELECT *, (CASE WHEN a IS NULL THEN 0 ELSE 0.5 END + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END) AS w, coalesce(a, 0) * 0.5 + coalesce(b, 0) * 0.3 + coalesce(c, 0) * 0.2 AS tot, CAST(da IS NOT NULL AS INT) + CAST(db IS NOT NULL AS INT) AS kn, abs(coalesce(da, 0) + coalesce(db, 0)) AS ag FROM g),
y AS (SELECT s, p, tot / w * (0.75 + 0.25 * CASE WHEN kn > 0 THEN ag / kn ELSE 1 END) AS score, concat_ws(';', CASE WHEN a IS NULL THEN 'a' END, CASE WHEN b IS NULL THEN 'b' END, CASE WHEN c IS NULL THEN 'c' END) AS missing FROM x) SELECT s, p, round(score, 6) AS score, missing, CASE WHEN score >= 0.7001 THEN 'strong' WHEN score >= 0.4001 THEN 'weak' ELSE 'unlabeled' END AS label FROM y""")
def _(t):
    return E.fused_score(fused(t), {"a": 0.5, "b": 0.3, "c": 0.2}, ["da", "db"], 0.7001, 0.4001).select("s", "p", F.round("score", 6).alias("score"), "missing", "label")


@query("agg07_contributions", "SELECT l_suppkey, l_partkey, source, max(v) AS support FROM (SELECT l_suppkey, l_partkey, 'tax' AS source, l_tax AS v FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_suppkey, l_partkey, 'discount', l_discount FROM lineitem WHERE l_returnflag = 'A') GROUP BY ALL")
def _(t):
    part = lambda flag, v: t.lineitem.where(F.col("l_returnflag") == flag).withColumn("v", F.col(v))
    return E.contributions({"tax": part("R", "l_tax"), "discount": part("A", "l_discount")}, ["l_suppkey", "l_partkey"], "v")


@query("agg08_consensus", "WITH v AS (SELECT l_suppkey, l_partkey % 40 AS k, l_linestatus, count(DISTINCT l_linenumber) AS votes, sum(l_discount) AS w, avg(l_discount) AS pr, avg(l_tax) AS pc FROM lineitem GROUP BY ALL), r AS (SELECT *, sum(votes) OVER (PARTITION BY l_suppkey, k) AS al, row_number() OVER (PARTITION BY l_suppkey, k ORDER BY votes DESC, round(w, 9) DESC, l_linestatus) AS r FROM v) SELECT l_suppkey, k, l_linestatus, votes, round(votes / 7, 6) AS frequency, round(votes / al, 6) AS stability, round(pr, 6) AS probability, round(pc, 6) AS percentile FROM r WHERE r = 1")
def _(t):
    out = E.fold_consensus(t.lineitem.withColumn("k", F.col("l_partkey") % 40), ["l_suppkey", "k"], "l_linenumber", "l_linestatus", "l_discount", "l_tax", 7)
    return out.withColumns(R6("frequency", "stability", "probability", "percentile"))


@query("agg09_leave_one_out", """WITH e AS (SELECT p_brand, n_name AS cohort, avg(l_discount) * 3 - 0.14 AS e, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL), s AS (SELECT *, count(*) OVER w - 1 AS others, sum(n) OVER w - n AS sw, sum(n * atanh(e)) OVER w - n * atanh(e) AS swz, sum(n * atanh(e) * atanh(e)) OVER w - n * atanh(e) * atanh(e) AS swzz, sum(CAST(e > 0 AS INT)) OVER w - CAST(e > 0 AS INT) AS pos FROM e WINDOW w AS (PARTITION BY p_brand))
SELECT p_brand, cohort, others, round(tanh(swz / sw), 6) AS mean_effect, round(greatest(0, swzz - swz * swz / sw), 6) AS q, round(greatest(pos, others - pos) / others, 6) AS consistency FROM s""")
def _(t):
    e = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    e = e.groupBy("p_brand", F.col("n_name").alias("cohort")).agg((F.avg("l_discount") * 3 - 0.14).alias("e"), F.count("*").alias("n"))
    return E.leave_one_out(e, ["p_brand"], "cohort", "e", F.col("n")).drop("i2").withColumns(R6("mean_effect", "q", "consistency"))


@query("agg10_recurrence", "WITH r AS (SELECT l_suppkey, p_type, l_linenumber AS cohort, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem JOIN part ON l_partkey = p_partkey), pr AS (SELECT p_type, avg(CAST(y AS DOUBLE)) AS prior FROM r GROUP BY 1) SELECT l_suppkey, p_type, CAST(sum(y) AS BIGINT) AS positives, count(DISTINCT cohort) AS cohorts, round((sum(y) + 2 * any_value(prior)) / (count(DISTINCT cohort) + 2), 6) AS recurrence FROM r JOIN pr USING (p_type) GROUP BY ALL")
def _(t):
    r = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return E.recurrence(r, ["l_suppkey", "p_type"], "p_type", "l_linenumber", "y", 2.0).select("l_suppkey", "p_type", "positives", "cohorts", F.round("recurrence", 6).alias("recurrence"))


@query("agg11_filtered", "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, round(avg(l_tax) FILTER (WHERE l_linestatus = 'O'), 6) AS open_tax, bool_or(l_quantity = 50) AS any_full, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FILTER (WHERE l_tax > 0.07) AS flags FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.round(F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_tax"))), 6).alias("open_tax"), F.bool_or(F.col("l_quantity") == 50).alias("any_full"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("l_tax") > 0.07, F.col("l_returnflag")))), ",").alias("flags"))


@query("agg12_donor_mean", "WITH u AS (SELECT p_brand, o_custkey, avg(l_discount - 0.0512) AS u FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT p_brand, round(CASE WHEN count(u) >= 700 THEN avg(u) END, 6) AS mean, round(stddev_samp(u), 6) AS sd, count(u) AS units, round(avg(greatest(u, 0)), 6) AS positive, round(avg(greatest(-u, 0)), 6) AS negative, CASE WHEN count(u) < 700 THEN 'too_few_units' END AS reason FROM u GROUP BY 1")
def _(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn("v", F.col("l_discount") - 0.0512)
    return E.two_level_mean(rows, ["p_brand"], ["o_custkey"], "v", 700).withColumns(R6("mean", "sd", "positive", "negative"))


@query("agg13_patient_mean", "WITH s AS (SELECT o_custkey, o_orderkey, avg(l_discount) AS v, count(*) FILTER (WHERE l_tax > 0) AS probes FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) SELECT o_custkey, round(avg(v), 9) AS mean, CAST(sum(probes) AS BIGINT) AS probes, count(*) AS samples FROM s GROUP BY 1")
def _(t):
    s = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.avg("l_discount").alias("v"), F.count_if(F.col("l_tax") > 0).alias("probes"))
    return s.groupBy("o_custkey").agg(F.round(F.avg("v"), 9).alias("mean"), F.sum("probes").alias("probes"), F.count("*").alias("samples"))


@query("agg14_burden", "SELECT n_name AS cohort, p_brand, count(DISTINCT o_custkey) FILTER (WHERE l_returnflag = 'R') AS mutated, count(*) FILTER (WHERE l_returnflag = 'R') AS events, count(DISTINCT o_custkey) AS callable, round(count(DISTINCT o_custkey) FILTER (WHERE l_returnflag = 'R') / count(DISTINCT o_custkey), 6) AS rate FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def _(t):
    hit = F.col("l_returnflag") == "R"
    mut = F.count_distinct(F.when(hit, F.col("o_custkey")))
    return t.sales().groupBy(F.col("n_name").alias("cohort"), "p_brand").agg(mut.alias("mutated"), F.count_if(hit).alias("events"), F.count_distinct("o_custkey").alias("callable"), F.round(mut / F.count_distinct("o_custkey"), 6).alias("rate"))


@query("agg15_any_all", "SELECT o_custkey, p_type, bool_or(l_returnflag = 'R') AS event, bool_or(l_returnflag = 'R') OR bool_and(l_linestatus = 'F') AS callable, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS burden, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS up FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def _(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    ev = F.bool_or(F.col("l_returnflag") == "R")
    return rows.groupBy("o_custkey", "p_type").agg(ev.alias("event"), (ev | F.bool_and(F.col("l_linestatus") == "F")).alias("callable"), F.sum(F.col("l_quantity").cast("long")).alias("burden"), F.round(F.avg(F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0)), 6).alias("up"))


@query("agg16_experiments", """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS rec, l_suppkey, l_returnflag, l_linestatus, CASE WHEN l_tax > 0 THEN l_partkey END AS pm FROM lineitem), k AS (SELECT *, CASE WHEN pm IS NOT NULL THEN 'exp:' || substr(sha256(CAST(pm AS VARCHAR) || '|' || l_returnflag || '|' || l_linestatus), 1, 20) ELSE 'row:' || CAST(rec AS VARCHAR) END AS experiment FROM r)
SELECT experiment, count(*) AS records, count(DISTINCT l_suppkey) AS sources, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ';' ORDER BY CAST(l_suppkey AS VARCHAR)) AS source_list, min(rec) AS first_record FROM k GROUP BY 1""")
def _(t):
    r = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rec"), "l_suppkey", "l_returnflag", "l_linestatus", F.when(F.col("l_tax") > 0, F.col("l_partkey")).alias("pm"))
    return E.canonical_experiments(r, ["l_returnflag", "l_linestatus"], "pm", "l_suppkey", "rec")


@query("agg17_duplicates", "SELECT l_partkey, l_returnflag, count(DISTINCT l_suppkey) AS sources, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) > 1 ORDER BY sources DESC, rows DESC, l_partkey, l_returnflag LIMIT 100")
def _(t):
    return E.duplicate_report(t.lineitem, ["l_partkey", "l_returnflag"], "l_suppkey", 100)


@query("agg18_relationships", "SELECT l_suppkey, l_partkey, count(*) AS facts, CAST(sum(l_linenumber) AS BIGINT) AS occurrences, count(DISTINCT l_returnflag) AS databases, count(DISTINCT CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_linestatus END) AS experiments FROM lineitem GROUP BY ALL")
def _(t):
    return E.relationships(t.lineitem.withColumn("x", F.when(F.col("l_linestatus") == "O", "").otherwise(F.col("l_linestatus"))), ["l_suppkey", "l_partkey"], {"l_returnflag": "databases", "x": "experiments"}, "l_linenumber")


@query("agg19_ledger", """WITH r AS (SELECT l_suppkey AS c, l_orderkey AS st, CASE l_linenumber % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'network' WHEN 2 THEN 'bridge' ELSE 'prediction' END AS k, l_returnflag AS d, CAST(l_linestatus = 'F' AS INT) AS a FROM lineitem), s AS (SELECT c, st, count(*) FILTER (WHERE k = 'direct') AS d1, count(*) FILTER (WHERE k = 'network') AS n1, count(*) FILTER (WHERE k = 'bridge') AS b1, count(*) FILTER (WHERE k = 'prediction') AS p1, count(DISTINCT d) AS nd, min(d) AS d, avg(CAST(a AS DOUBLE)) AS a FROM r GROUP BY ALL)
SELECT c, count(*) AS studies, CAST(sum(d1) AS BIGINT) AS direct, CAST(sum(n1) AS BIGINT) AS network, CAST(sum(b1) AS BIGINT) AS bridge, CAST(sum(p1) AS BIGINT) AS prediction, bool_or(nd > 1) AS conflict_within, count(DISTINCT CASE WHEN nd = 1 THEN d END) > 1 AS conflict_between, round(avg(a), 6) AS accepted FROM s GROUP BY 1""")
def _(t):
    k = F.element_at(F.array(*map(F.lit, ("direct", "network", "bridge", "prediction"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    r = t.lineitem.select(F.col("l_suppkey").alias("c"), F.col("l_orderkey").alias("st"), k.alias("k"), F.col("l_returnflag").alias("d"), (F.col("l_linestatus") == "F").cast("int").alias("a"))
    return E.ledger(r, ["c"], "st", "k", "d", "a").withColumns(R6("accepted"))


@query("agg20_top_events", "WITH b AS (SELECT l_suppkey, l_orderkey, l_extendedprice AS w, l_returnflag AS d FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_extendedprice DESC, l_returnflag) = 1), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, l_orderkey) <= 64 AS kept FROM b) SELECT l_suppkey, count(*) AS events, count(*) FILTER (WHERE kept) AS kept, round(sum(CASE WHEN kept THEN w ELSE 0 END) / sum(w), 6) AS weight_kept, count(DISTINCT CASE WHEN kept THEN d END) > 1 AS conflict FROM k GROUP BY 1")
def _(t):
    return E.top_events(t.lineitem, ["l_suppkey"], "l_orderkey", "l_extendedprice", "l_returnflag", 64).withColumns(R6("weight_kept"))


@query("agg22_edge_summary", "SELECT l_suppkey, count(*) AS edges, round(avg(CASE WHEN l_discount > 0.043 THEN 1.0 ELSE 0.0 END), 6) AS positive, round(avg(abs(l_discount - 0.043)), 6) AS mean_abs, round(max(abs(l_discount - 0.043)), 6) AS max_abs FROM lineitem GROUP BY 1")
def _(t):
    e = F.col("l_discount") - 0.043
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("edges"), F.round(F.avg(F.when(e > 0, 1.0).otherwise(0.0)), 6).alias("positive"), F.round(F.avg(F.abs(e)), 6).alias("mean_abs"), F.round(F.max(F.abs(e)), 6).alias("max_abs"))


@query("agg24_classes", "SELECT n_name AS cohort, CASE WHEN l_returnflag = 'R' THEN 'observed_core' WHEN l_discount >= 0.0799 THEN 'predicted_candidate' WHEN l_tax >= 0.0599 THEN 'model_supported' ELSE 'exploratory' END AS class, count(*) AS n, round(avg(l_discount), 6) AS probability FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def _(t):
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    c = E.relationship_class(F.col("l_returnflag") == "R", F.col("l_discount") >= 0.0799, F.col("l_tax") >= 0.0599)
    return rows.groupBy(F.col("n_name").alias("cohort"), c.alias("class")).agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("probability"))


NODES = "e AS (SELECT DISTINCT 'p:' || CAST(l_partkey AS VARCHAR) AS a, 's:' || CAST(l_suppkey AS VARCHAR) AS b, l_returnflag AS role FROM lineitem)"


@query("agg25_nodes", f"WITH {NODES}, x AS (SELECT a AS node, role FROM e UNION ALL SELECT b, role FROM e) SELECT node, count(*) AS degree, count(DISTINCT role) AS roles FROM x GROUP BY 1")
def _(t):
    return E.nodes_and_edges(t.lineitem.withColumnRenamed("l_returnflag", "role"), ("p", "l_partkey"), ("s", "l_suppkey"), "role")[0]


@query("agg28_ensemble", "WITH l AS (SELECT l_suppkey % 5 AS seed, l_linenumber AS fold, unnest(['discount', 'tax']) AS metric, unnest([l_discount, l_tax]) AS v FROM lineitem), p AS (SELECT seed, metric, avg(v) AS v FROM l GROUP BY ALL) SELECT metric, count(*) AS seeds, round(avg(v), 6) AS mean, round(stddev_samp(v), 8) AS sd, round(stddev_samp(v) / sqrt(count(*)), 8) AS sem FROM p GROUP BY 1")
def _(t):
    rows = t.lineitem.select((F.col("l_suppkey") % 5).alias("seed"), F.col("l_linenumber").alias("fold"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return E.ensemble_summary(rows, "seed", "fold", ["discount", "tax"]).withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 8), "sem": F.round("sem", 8)})


SURV = f"""{MEASUREMENTS}, o AS (SELECT o_custkey AS sample, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS time, CAST(bool_or(o_orderstatus = 'F') AS INT) AS event FROM orders GROUP BY 1),
sv AS (SELECT entity, sample, value, time, event FROM m JOIN o USING (sample) WHERE time > 0), hl AS (SELECT sv.*, value >= med AS high FROM sv JOIN (SELECT entity, median(value) AS med FROM sv GROUP BY 1) USING (entity)),
rt AS (SELECT entity, time, sum(event) AS d, count(*) AS l, sum(CAST(high AS INT)) AS hl, sum(CAST(high AS INT) * event) AS hd, sum(value) AS x, sum(value * value) AS xx, sum(value * event) AS xd FROM hl GROUP BY ALL),
rk AS (SELECT *, sum(l) OVER w AS n, sum(hl) OVER w AS h, sum(x) OVER w AS xr, sum(xx) OVER w AS xxr FROM rt WINDOW w AS (PARTITION BY entity ORDER BY time DESC))"""


def survival(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("sample")).agg(F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("time"), F.bool_or(F.col("o_orderstatus") == "F").cast("int").alias("event")).where("time > 0")
    return t.measurements().join(o, "sample")


@query("sur01_logrank", f"WITH {SURV}, z AS (SELECT entity, CAST(sum(hd) AS BIGINT) AS o, sum(d * h / n) AS e, sum(CASE WHEN n > 1 THEN d * (h / n) * (1 - h / n) * (n - d) / (n - 1) ELSE 0 END) AS v FROM rk WHERE d > 0 GROUP BY 1) SELECT entity, o AS observed, round(e, 6) AS expected, round(v, 6) AS variance, round(pow(o - e, 2) / v, 6) AS chi2 FROM z")
def _(t):
    return U.logrank(U.median_split(survival(t), ["entity"], "value"), ["entity"], "time", "event", "high").select("entity", "observed", *[F.round(c, 6).alias(c) for c in ("expected", "variance", "chi2")])


@query("sur02_kaplan_meier", f"WITH {SURV}, s AS (SELECT entity, time, d, l, sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE -1e9 END) OVER (PARTITION BY entity ORDER BY time) AS lg FROM rk), h AS (SELECT unnest([0.0, 365.25, 1095.75, 1826.25]) AS horizon) SELECT entity, CAST(horizon AS DOUBLE) AS horizon, round(coalesce(exp(max_by(lg, time) FILTER (WHERE time <= horizon)), 1), 6) AS survival, CAST(coalesce(sum(l) FILTER (WHERE time >= horizon), 0) AS BIGINT) AS at_risk, CAST(coalesce(sum(d) FILTER (WHERE time <= horizon), 0) AS BIGINT) AS events FROM s, h GROUP BY ALL")
def _(t):
    return U.kaplan_meier(survival(t), ["entity"], "time", "event", [0, 365.25, 1095.75, 1826.25]).withColumns(R6("survival"))


@query("sur03_cox", f"WITH {SURV}, z AS (SELECT entity, CAST(sum(d) AS BIGINT) AS events, sum(xd - d * xr / n) AS u, sum(d * (xxr / n - (xr / n) * (xr / n))) AS i FROM rk WHERE d > 0 GROUP BY 1) SELECT entity, events, round(u / i, 5) AS beta, round(1 / sqrt(i), 5) AS se, round(u / sqrt(i), 5) AS z FROM z")
def _(t):
    return U.cox_one_step(survival(t), ["entity"], "time", "event", "value").select("entity", "events", *[F.round(c, 5).alias(c) for c in ("beta", "se", "z")])


@query("sur04_concordance", "WITH o AS (SELECT o_custkey AS s, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS time, CAST(bool_or(o_orderstatus = 'F') AS INT) AS event FROM orders GROUP BY 1), d AS (SELECT c_nationkey, time, event, CAST(floor(c_acctbal / 100) AS BIGINT) AS r FROM o JOIN customer ON s = c_custkey) SELECT a.c_nationkey AS c_nationkey, count(*) AS pairs, round(avg(CASE WHEN a.r > b.r THEN 1.0 WHEN a.r = b.r THEN 0.5 ELSE 0 END), 6) AS c_index FROM d a JOIN d b ON a.c_nationkey = b.c_nationkey AND a.time < b.time WHERE a.event = 1 GROUP BY 1")
def _(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("time"), F.bool_or(F.col("o_orderstatus") == "F").cast("int").alias("event"))
    return U.concordance(o.join(t.customer, "c_custkey").withColumn("r", F.floor(F.col("c_acctbal") / 100)), ["c_nationkey"], "time", "event", "r").withColumns(R6("c_index"))


@query("sur05_priority", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax > 0 AND l_discount > 0 THEN sqrt(l_tax * l_discount) ELSE 0.5 * coalesce(CASE WHEN l_tax > 0 THEN l_tax END, CASE WHEN l_discount > 0 THEN l_discount END) END, 6) AS priority FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(U.geometric_priority(F.when(F.col("l_tax") > 0, F.col("l_tax")), F.when(F.col("l_discount") > 0, F.col("l_discount"))), 6).alias("priority"))


GE = "ge AS (SELECT 's' || CAST(l_suppkey AS VARCHAR) AS a, 'c' || CAST(o_custkey AS VARCHAR) AS b, l_returnflag AS role, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"


def edges(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("c"), "o_custkey").alias("b"), F.col("l_returnflag").alias("role")).agg(F.sum(F.col("l_quantity").cast("long")).alias("weight"))


@query("gr01_edges", f"WITH {GE} SELECT least(a, b) AS a, greatest(a, b) AS b, role, weight FROM ge")
def _(t):
    return edges(t).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "role", "weight")


@query("gr02_neighbourhood", f"WITH {GE} SELECT a, b, role, weight FROM ge WHERE (a = 's7' OR b = 's7') AND role IN ('R', 'A') ORDER BY weight DESC, a, b, role LIMIT 40 OFFSET 10")
def _(t):
    return G.neighbourhood(edges(t), "s7", 40, 10, ["R", "A"])


@query("gr03_paths", """WITH f AS (SELECT DISTINCT s_suppkey AS source, l_partkey AS m1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), mid AS (SELECT p_partkey AS m1, p_partkey + 1 AS m2 FROM part), l AS (SELECT p_partkey AS m2, p_brand AS target FROM part),
u AS (SELECT source, target, f.m1 AS m1, CAST(NULL AS BIGINT) AS m2, 2 AS length FROM f JOIN l ON f.m1 = l.m2 UNION SELECT source, target, f.m1, mid.m2, 3 FROM f JOIN mid ON f.m1 = mid.m1 JOIN l ON mid.m2 = l.m2)
SELECT source, target, m1, m2, length, row_number() OVER (PARTITION BY source, target ORDER BY length, m1, m2 NULLS FIRST) AS rank FROM u QUALIFY rank <= 3""")
def _(t):
    f = t.lineitem.select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("m1")).distinct()
    mid = t.part.select(F.col("p_partkey").alias("m1"), (F.col("p_partkey") + 1).alias("m2"))
    return G.layered_paths(f, mid, t.part.select(F.col("p_partkey").alias("m2"), F.col("p_brand").alias("target")), 3, t.parts("lineitem"))


@query("gr04_best_paths")
def _(t):
    e = edges(t).where("role = 'R'").select("a", "b", (F.col("weight") / 200).alias("weight"))
    both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    return G.best_paths(both, t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("node")), 4, 20)


@query("gr05_response_edges", "SELECT l_suppkey, l_partkey, CASE WHEN avg(l_discount - 0.0503) > 0 THEN 'up' ELSE 'down' END AS direction, round(min(l_tax), 6) AS fdr FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL HAVING min(l_tax) <= 0.0501")
def _(t):
    g = t.lineitem.where("l_returnflag = 'R'").groupBy("l_suppkey", "l_partkey").agg(F.avg(F.col("l_discount") - 0.0503).alias("e"), F.round(F.min("l_tax"), 6).alias("fdr")).where("fdr <= 0.0501")
    return g.select("l_suppkey", "l_partkey", F.when(F.col("e") > 0, "up").otherwise("down").alias("direction"), "fdr")


@query("gr06_components", """WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT l_orderkey AS u, -l_partkey AS v FROM lineitem), b AS MATERIALIZED (SELECT u, v FROM e UNION SELECT v, u FROM e), r(node, c) USING KEY (node) AS (SELECT DISTINCT u, u FROM b UNION (SELECT b.v, min(r.c) FROM r JOIN b ON r.node = b.u JOIN recurring.r AS now ON now.node = b.v WHERE r.c < now.c GROUP BY b.v)) SELECT node, c AS component FROM r""")
def _(t):
    return G.components(t.lineitem.select(F.col("l_orderkey").alias("u"), (-F.col("l_partkey")).alias("v")).distinct())


@query("gr07_communities")
def _(t):
    w = t.sales().groupBy(F.col("p_brand").alias("b"), "c_custkey").agg(F.lit(1).alias("one"))
    ids = w.select("b").distinct().withColumn("i", F.shiftrightunsigned(F.xxhash64("b"), 1))
    x = w.join(F.broadcast(ids), "b")
    sim = x.select(F.col("i").alias("u"), "c_custkey").join(x.select(F.col("i").alias("v"), "c_custkey"), "c_custkey").where("u < v").groupBy("u", "v").agg(F.count("*").cast("double").alias("weight"))
    return G.communities(sim, 3)


@query("gr08_rewired")
def _(t):
    e = t.lineitem.select("l_suppkey", "l_partkey", "l_returnflag").distinct()
    return G.rewired(e, "l_suppkey", "l_partkey", "l_returnflag", 5)


@query("gr09_link_candidates", """WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem), sp AS (SELECT *, CAST(CAST('0x' || substr(sha256('links|' || CAST(a AS VARCHAR) || '|' || CAST(b AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 < 0.8 AS tr FROM e), tn AS (SELECT a, b FROM sp WHERE tr),
da AS (SELECT a, count(*) AS da FROM tn GROUP BY 1), db AS (SELECT b, count(*) AS db FROM tn GROUP BY 1), c AS (SELECT a, b FROM e EXCEPT SELECT a, b FROM tn) SELECT a, b, coalesce(da, 0) * coalesce(db, 0) AS score FROM c LEFT JOIN da USING (a) LEFT JOIN db USING (b)""")
def _(t):
    e = G.split_known(t.lineitem.select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct(), "a", "b", 0.8)
    return G.degree_prior(e.where("split = 'train'"), e.select("a", "b"), "a", "b").select("a", "b", "score")
