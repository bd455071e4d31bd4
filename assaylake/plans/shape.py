"""Filters, joins, windows, set operations and checks over the driver tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from assaylake.operators import filters as L
from assaylake.operators import joins as J
from assaylake.operators import quality as Q
from assaylake.operators import windows as W
from assaylake.plans.binding import MEASUREMENTS, MEMBERSHIP, PATIENTS, query

DETECT = f"""WITH {MEASUREMENTS}, {PATIENTS}, n AS (SELECT cohort, count(DISTINCT sample) AS n_samples FROM pat GROUP BY 1),
d AS (SELECT cohort, entity, count(DISTINCT sample) AS n_detected FROM m WHERE value > 0 GROUP BY ALL),
g AS (SELECT n.cohort, e.entity, n_samples, coalesce(n_detected, 0) AS n_detected FROM n CROSS JOIN (SELECT DISTINCT entity FROM m) e LEFT JOIN d ON n.cohort = d.cohort AND e.entity = d.entity),
h AS (SELECT *, n_detected / n_samples AS rate, n_detected / n_samples >= 0.5 AS eligible FROM g)
SELECT cohort, entity, n_detected, round(rate, 6) AS detection_rate, eligible, CASE WHEN count(*) FILTER (WHERE eligible) OVER (PARTITION BY entity) >= 12 THEN 'shared' WHEN eligible THEN 'cancer_local' ELSE 'not_eligible' END AS scope FROM h"""


@query("flt01_detection", DETECT)
def _(t):
    out = L.detection_scope(t.measurements(), t.patients(), "cohort", "entity", "sample", "value", 0.5, 12)
    return out.select("cohort", "entity", "n_detected", F.round("detection_rate", 6).alias("detection_rate"), "eligible", "scope")


@query("flt02_variable", f"WITH {MEASUREMENTS}, v AS (SELECT cohort, entity, var_samp(value) AS v FROM m GROUP BY ALL) SELECT cohort, entity, round(v, 6) AS variance, row_number() OVER (PARTITION BY cohort ORDER BY round(v, 9) DESC, entity) AS rank FROM v WHERE v >= 0.01 QUALIFY rank <= 5")
def _(t):
    return L.most_variable(t.measurements(), ["cohort"], "entity", "value", 0.01, 5).withColumn("variance", F.round("variance", 6))


@query("flt03_labels", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <= 0.05 AND abs(l_discount * 4 - 0.2) >= 0.20 THEN 'strong' WHEN l_tax <= 0.10 AND abs(l_discount * 4 - 0.2) >= 0.15 THEN 'weak' ELSE 'unlabeled' END AS label FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", L.association_label(F.col("l_tax"), F.col("l_discount") * 4 - 0.2).alias("label"))


EDGES = """e AS (SELECT l_orderkey, l_linenumber, n_name AS cohort, CASE l_linestatus WHEN 'O' THEN 'expressed_in' ELSE 'binds' END AS relation,
CASE l_returnflag WHEN 'R' THEN 'outcome_derived' WHEN 'A' THEN 'unlabeled_context' ELSE CASE WHEN l_linenumber = 1 THEN 'reference_context' ELSE 'static' END END AS provenance FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def edges(t):
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    p = F.when(F.col("l_returnflag") == "R", "outcome_derived").when(F.col("l_returnflag") == "A", "unlabeled_context").when(F.col("l_linenumber") == 1, "reference_context").otherwise("static")
    return rows.select("l_orderkey", "l_linenumber", F.col("n_name").alias("cohort"), F.when(F.col("l_linestatus") == "O", "expressed_in").otherwise("binds").alias("relation"), p.alias("provenance"))


@query("flt04_holdout", f"WITH {EDGES}, d AS (SELECT cohort, CASE WHEN provenance = 'reference_context' THEN 'reference_context' WHEN provenance = 'outcome_derived' AND cohort = 'CHINA' THEN 'held_out_outcome' WHEN provenance = 'unlabeled_context' AND relation <> 'expressed_in' THEN 'unlabeled_context' END AS dropped FROM e) SELECT cohort, coalesce(dropped, 'kept') AS outcome, count(*) AS n FROM d GROUP BY ALL")
def _(t):
    return L.holdout_policy(edges(t), F.lit("CHINA"), "S").groupBy("cohort", F.coalesce("dropped", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


@query("flt05_roles", """SELECT coalesce(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'no_role' WHEN l_tax = 0.08 THEN 'outcome_derived' WHEN l_discount = 0 THEN 'direct_target' WHEN l_linestatus = 'O' AND l_linenumber % 2 = 1 THEN 'polarity' END, 'accepted') AS outcome, count(*) AS n FROM lineitem GROUP BY 1""")
def _(t):
    rows = t.lineitem.select("l_returnflag", "l_linestatus", F.when(F.col("l_linenumber") % 2 == 1, "neg").otherwise("pos").alias("polarity"), (F.col("l_tax") == 0.08).alias("outcome"), (F.col("l_discount") == 0).alias("direct_target"))
    roles = t.spark.createDataFrame([(a, b, "pos" if b == "O" else "any") for a in "RAN" for b in "OF" if a + b != "NF"], "l_returnflag string, l_linestatus string, allowed_polarity string")
    return L.role_contract(rows, roles, ["l_returnflag", "l_linestatus"]).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


@query("flt06_isolation", """WITH u AS (SELECT * FROM lineitem WHERE l_linenumber = 2), x AS (SELECT l_orderkey, l_linenumber, l_orderkey IN (SELECT l_orderkey FROM u) AS s, (l_suppkey, l_partkey) IN (SELECT (l_suppkey, l_partkey) FROM u) AS p, l_suppkey IN (SELECT l_suppkey FROM u) AS e FROM lineitem WHERE l_linenumber = 1)
SELECT l_orderkey, NOT s AS provenance_ok, NOT s AND NOT p AS pair_held_out, NOT s AND NOT e AS entity_held_out, concat_ws(';', CASE WHEN s THEN 'study_used' END, CASE WHEN p THEN 'pair_used' END, CASE WHEN e THEN 'entity_used' END) AS reasons FROM x""")
def _(t):
    used = t.lineitem.where("l_linenumber = 2")
    out = L.isolation(t.lineitem.where("l_linenumber = 1").select("l_orderkey", "l_suppkey", "l_partkey"), used, "l_orderkey", ("l_suppkey", "l_partkey"))
    return out.select("l_orderkey", "provenance_ok", "pair_held_out", "entity_held_out", "reasons")


FOLDS = f"{PATIENTS}, f AS (SELECT cohort, sample, (row_number() OVER (PARTITION BY cohort ORDER BY sha256('fold|' || cohort || '|' || CAST(sample AS VARCHAR)), sample) - 1) % 5 AS fold FROM pat)"


@query("win01_folds", f"WITH {FOLDS} SELECT cohort, sample, fold FROM f")
def _(t):
    return W.folds(t.patients(), "cohort", "sample", 5)


@query("flt07_splits", f"WITH {FOLDS} SELECT cohort, sample, o.outer_fold AS outer_fold, CASE WHEN fold = o.outer_fold THEN 'test' WHEN fold = (o.outer_fold + 1) % 5 THEN 'validation' ELSE 'train' END AS split FROM f, (SELECT unnest(range(5)) AS outer_fold) o")
def _(t):
    return W.outer_splits(W.folds(t.patients(), "cohort", "sample", 5), 5).select("cohort", "sample", "outer_fold", "split")


@query("flt08_physical", "SELECT p_partkey, p_size < 40 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AND len(list_filter(str_split(p_type, ' '), lambda x: x NOT IN ('ECONOMY', 'STANDARD', 'ANODIZED', 'STEEL', 'COPPER', 'BRASS', 'BURNISHED'))) = 0 AS physical FROM part")
def _(t):
    allowed = {"class": ["small"], "family": ["Brand#11", "Brand#12", "Brand#23"], "subtype": ["ECONOMY", "STANDARD", "ANODIZED", "STEEL", "COPPER", "BRASS", "BURNISHED"]}
    return t.part.select("p_partkey", L.physical(F.when(F.col("p_size") < 40, "small").otherwise("large"), F.col("p_brand"), F.translate("p_type", " ", "|"), allowed).alias("physical"))


@query("win02_rank", f"WITH {MEASUREMENTS} SELECT sample, entity, round((rank() OVER (PARTITION BY sample ORDER BY value) + (count(*) OVER (PARTITION BY sample, value) - 1) / 2.0) / count(*) OVER (PARTITION BY sample), 6) AS pct FROM m")
def _(t):
    return t.measurements().select("sample", "entity", F.round(W.rank_percentile("value", ["sample"]), 6).alias("pct"))


@query("win03_fold_percentile", "SELECT l_orderkey, l_linenumber, round(CASE WHEN count(*) OVER (PARTITION BY l_suppkey, l_returnflag) = 1 THEN 1.0 ELSE 1 - (row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) - 1) / (count(*) OVER (PARTITION BY l_suppkey, l_returnflag) - 1) END, 6) AS pct FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(W.fold_percentile([F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], ["l_suppkey", "l_returnflag"]), 6).alias("pct"))


@query("win04_top_k", "SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem QUALIFY rank <= 10")
def _(t):
    return W.top_k(t.lineitem, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 10).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("win05_bh", """WITH p AS (SELECT l_suppkey, l_orderkey, l_linenumber, CASE WHEN l_tax = 0.04 THEN NULL ELSE l_extendedprice / 210001.0 END AS p FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY p NULLS LAST, l_orderkey, l_linenumber) AS r, count(p) OVER (PARTITION BY l_suppkey) AS m FROM p)
SELECT l_orderkey, l_linenumber, round(CASE WHEN p IS NOT NULL THEN least(1.0, min(p * m / r) OVER (PARTITION BY l_suppkey ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END, 6) AS q FROM r""")
def _(t):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", F.when(F.col("l_tax") != 0.04, F.col("l_extendedprice") / 210001.0).alias("p"))
    return W.benjamini_hochberg(rows, "p", ["l_suppkey"], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.round("q", 6).alias("q"))


@query("win06_leaderboard", """WITH s AS (SELECT n_name AS cohort, s_suppkey AS entity, p_type AS target, max(l_extendedprice) AS score FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cohort, entity ORDER BY score DESC, target) AS r FROM s), b AS (SELECT cohort, entity, 0.7 * max(score) + 0.3 * avg(score) FILTER (WHERE r <= 5) AS score, min(target) FILTER (WHERE r = 1) AS top_target FROM r GROUP BY ALL)
SELECT cohort, entity, round(score, 4) AS score, top_target, row_number() OVER (PARTITION BY cohort ORDER BY score DESC, entity) AS rank, count(*) OVER (PARTITION BY cohort) AS universe FROM b""")
def _(t):
    s = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    s = s.groupBy(F.col("n_name").alias("cohort"), F.col("s_suppkey").alias("entity"), F.col("p_type").alias("target")).agg(F.max("l_extendedprice").alias("score"))
    return W.leaderboard(s, ["cohort", "entity"], ["cohort"], "score", "target").select("cohort", "entity", F.round("score", 4).alias("score"), "top_target", "rank", "universe")


@query("win07_tied_rank", "WITH r AS (SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS lo, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part) SELECT p_partkey, lo AS rank_min, lo + n - 1 AS rank_max, (lo + lo + n - 1) / 2.0 AS rank_mid, round(least(1.0, greatest(0.0, (10 - lo + 1) / n)), 6) AS hit_at_k FROM r")
def _(t):
    return W.tied_interval(t.part, "p_size", ["p_brand"], 10).select("p_partkey", "rank_min", "rank_max", "rank_mid", F.round("hit_at_k", 6).alias("hit_at_k"))


@query("win08_edge_budget", "SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_quantity DESC, l_orderkey, l_linenumber) <= CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 5 ELSE 8 END")
def _(t):
    cap = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 5).otherwise(8)
    return W.top_k(t.lineitem, ["l_suppkey", "l_returnflag"], [F.desc("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber")], cap).select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber")


@query("win09_displacement", """WITH s AS (SELECT n_name AS cohort, c_custkey AS k, c_acctbal AS a, c_acctbal + CASE WHEN c_mktsegment = 'BUILDING' THEN 500 ELSE 0 END AS b FROM customer JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT cohort, k, rank() OVER (PARTITION BY cohort ORDER BY a) + (count(*) OVER (PARTITION BY cohort, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY cohort ORDER BY b) + (count(*) OVER (PARTITION BY cohort, b) - 1) / 2.0 AS rb, row_number() OVER (PARTITION BY cohort ORDER BY a DESC, k) <= 10 AS ta, row_number() OVER (PARTITION BY cohort ORDER BY b DESC, k) <= 10 AS tb FROM s)
SELECT cohort, round(avg(abs(ra - rb)), 6) AS mean_shift, round(count(*) FILTER (WHERE ta AND tb) / count(*) FILTER (WHERE ta OR tb), 6) AS jaccard FROM r GROUP BY 1""")
def _(t):
    s = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("cohort"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("a"), (F.col("c_acctbal") + F.when(F.col("c_mktsegment") == "BUILDING", 500).otherwise(0)).alias("b"))
    top = lambda c: F.row_number().over(Window.partitionBy("cohort").orderBy(F.desc(c), "k")) <= 10
    r = s.select("cohort", W.average_rank("a", ["cohort"]).alias("ra"), W.average_rank("b", ["cohort"]).alias("rb"), top("a").alias("ta"), top("b").alias("tb"))
    return r.groupBy("cohort").agg(F.round(F.avg(F.abs(F.col("ra") - F.col("rb"))), 6).alias("mean_shift"), F.round(F.count_if(F.col("ta") & F.col("tb")) / F.count_if(F.col("ta") | F.col("tb")), 6).alias("jaccard"))


@query("win10_reliability", "SELECT CAST(least(floor(l_discount * 10 * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(l_discount * 10), 6) AS confidence, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(abs(avg(l_discount * 10) - avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END)), 6) AS gap FROM lineitem GROUP BY 1")
def _(t):
    out = W.reliability(t.lineitem.select((F.col("l_discount") * 10).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y")), "p", "y")
    return out.select("bin", "n", *[F.round(c, 6).alias(c) for c in ("confidence", "accuracy", "gap")])


DAY = "CAST(date_diff('day', DATE '1992-01-01', CAST({} AS DATE)) AS BIGINT)"


def day(c):
    return F.datediff(F.col(c), F.lit("1992-01-01").cast("date")).cast("long")


SPANS = f"iv AS (SELECT l_orderkey, l_linenumber, l_returnflag AS chrom, l_suppkey, l_partkey, least({DAY.format('o_orderdate')}, {DAY.format('l_shipdate')}) AS s, greatest({DAY.format('o_orderdate')}, {DAY.format('l_shipdate')}) + 1 AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def spans(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("chrom"), "l_suppkey", "l_partkey", F.least(day("o_orderdate"), day("l_shipdate")).alias("s"), (F.greatest(day("o_orderdate"), day("l_shipdate")) + 1).alias("e"))


@query("win11_union_length", f"""WITH {SPANS}, b AS (SELECT *, max(e) OVER (PARTITION BY chrom, l_suppkey ORDER BY s, e, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM iv),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, l_suppkey ORDER BY s, e, l_orderkey, l_linenumber) AS island FROM b), u AS (SELECT chrom, l_suppkey, island, max(e) - min(s) AS len FROM g GROUP BY ALL) SELECT chrom, l_suppkey, count(*) AS islands, CAST(sum(len) AS BIGINT) AS total FROM u GROUP BY ALL""")
def _(t):
    return W.merged_intervals(spans(t), ["chrom", "l_suppkey"], "s", "e").groupBy("chrom", "l_suppkey").agg(F.count("*").alias("islands"), F.sum(F.col("e") - F.col("s")).alias("total"))


@query("win12_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def _(t):
    return W.page(t.orders, [F.desc("o_totalprice"), F.col("o_orderkey")], 50, 100).select("o_orderkey", "o_totalprice")


@query("win13_monotone", "WITH x AS (SELECT o_custkey, o_totalprice < lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS down FROM orders) SELECT o_custkey, count(*) FILTER (WHERE down) AS violations FROM x GROUP BY 1")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.withColumn("down", F.col("o_totalprice") < F.lag("o_totalprice").over(w)).groupBy("o_custkey").agg(F.count_if("down").alias("violations"))


@query("win14_pairs", """WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS j FROM part), n AS (SELECT (SELECT count(*) FROM a) AS n, (SELECT count(*) FROM b) AS m),
k AS (SELECT unnest(range(least(5000, n * m))) AS id, n, m FROM n) SELECT DISTINCT s_suppkey, p_partkey FROM k JOIN a ON id % n = i JOIN b ON (id * 7919 + id // n) % m = j""")
def _(t):
    return W.pair_sample(t.supplier, "s_suppkey", t.part, "p_partkey", 5000, 7919)


@query("joi01_validated", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(t):
    return J.validated(t.orders.withColumnRenamed("o_custkey", "c_custkey"), t.customer, ["c_custkey"]).select("o_orderkey", "c_mktsegment")


@query("joi02_components", """WITH a AS (SELECT l_suppkey AS s, l_partkey AS p, max(l_discount) AS da FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), b AS (SELECT l_suppkey AS s, l_partkey AS p, max(l_tax) AS tb FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), c AS (SELECT l_suppkey AS s, max(l_quantity) AS qc FROM lineitem GROUP BY 1)
SELECT s, p, coalesce(da, 0) AS da, coalesce(tb, 0) AS tb, coalesce(qc, 0) AS qc FROM a FULL JOIN b USING (s, p) LEFT JOIN c USING (s)""")
def _(t):
    part = lambda flag, col, name: t.lineitem.where(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), F.col(col).alias(name))
    coarse = t.lineitem.groupBy(F.col("l_suppkey").alias("s")).agg(F.max("l_quantity").alias("qc"))
    return J.merge_components([(part("R", "l_discount", "da"), ["s", "p"]), (part("A", "l_tax", "tb"), ["s", "p"]), (coarse, ["s"])], ["s", "p"], {"da": 0, "tb": 0, "qc": 0}, t.parts("lineitem"))


@query("joi03_universe", "WITH u AS (SELECT s_suppkey AS s, r_regionkey AS r FROM supplier, region), v AS (SELECT l_suppkey AS s, n_regionkey AS r, sum(CAST(l_quantity AS BIGINT)) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) SELECT s, r, CAST(qty AS BIGINT) AS qty, CASE WHEN qty IS NULL THEN 'not_observed' END AS reason FROM u LEFT JOIN v USING (s, r)")
def _(t):
    v = t.sales().groupBy(F.col("l_suppkey").alias("s"), F.col("n_regionkey").alias("r")).agg(F.sum(F.col("l_quantity").cast("long")).alias("qty"))
    return J.universe(v, t.supplier.select(F.col("s_suppkey").alias("s")).join(F.broadcast(t.region.select(F.col("r_regionkey").alias("r")))), ["s", "r"], "qty", "not_observed")


@query("joi04_grid", f"WITH {MEASUREMENTS}, {MEMBERSHIP}, e AS (SELECT cohort, entity FROM m GROUP BY ALL HAVING count(*) >= 40) SELECT cohort, e.entity, t.target FROM e, (SELECT DISTINCT target FROM mem) t")
def _(t):
    e = t.measurements().groupBy("cohort", "entity").agg(F.count("*").alias("n")).where("n >= 40").select("cohort", "entity")
    return e.join(F.broadcast(t.membership().select("target").distinct()))


@query("joi05_drift", "SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS left_only, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS right_only, (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)) AS \"both\"")
def _(t):
    return J.key_drift(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("joi06_closure", "SELECT count(*) FILTER (WHERE a.l_orderkey IS NULL) AS only_right, count(*) FILTER (WHERE b.l_orderkey IS NULL) AS only_left FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 2) a FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 3 OR l_tax = 0) b ON a.l_orderkey = b.l_orderkey")
def _(t):
    d = J.key_drift(t.lineitem.where("l_linenumber = 2").select("l_orderkey"), t.lineitem.where("l_linenumber = 3 or l_tax = 0").select("l_orderkey"), ["l_orderkey"])
    return d.select(F.col("right_only").alias("only_right"), F.col("left_only").alias("only_left"))


BLOCKS = "bl AS (SELECT l_partkey AS chrom, o_orderkey AS b, {d0} - {d0} % 90 AS block_start, {d0} - {d0} % 90 + 60 + o_orderkey % 80 AS block_end, 'T' || l_partkey AS target_chrom, 1000 * (o_orderkey % 7) AS target_start, 100000 AS target_size, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM (SELECT DISTINCT l_partkey, o_orderkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey))".format(d0=DAY.format("o_orderdate"))


@query("joi07_lift", f"""WITH {SPANS}, {BLOCKS}, h AS (SELECT l_orderkey, l_linenumber, target_chrom, CASE WHEN strand = '+' THEN target_start + s - block_start ELSE target_size - (target_start + s - block_start + e - s) END AS ls, e - s AS w FROM iv JOIN bl ON l_partkey = bl.chrom WHERE s >= block_start AND e <= block_end),
g AS (SELECT l_orderkey, l_linenumber, count(*) AS n, min(target_chrom) AS tc, min(ls) AS ls, min(w) AS w FROM h GROUP BY ALL)
SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN tc END AS lifted_chrom, CASE WHEN n = 1 THEN ls + 1 END AS lifted_start, CASE WHEN n = 1 THEN ls + w END AS lifted_end, CASE WHEN n IS NULL THEN 'no_complete_aligned_block' WHEN n > 1 THEN 'ambiguous_complete_block' ELSE 'lifted' END AS status FROM iv LEFT JOIN g USING (l_orderkey, l_linenumber)""")
def _(t):
    base = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("chrom"), "o_orderkey", day("o_orderdate").alias("d")).distinct()
    lo = F.col("d") - F.col("d") % 90
    blocks = base.select("chrom", lo.alias("block_start"), (lo + 60 + F.col("o_orderkey") % 80).alias("block_end"), F.concat(F.lit("T"), "chrom").alias("target_chrom"), (1000 * (F.col("o_orderkey") % 7)).alias("target_start"), F.lit(100000).alias("target_size"), F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"))
    points = spans(t).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_orderkey", "l_linenumber", F.col("l_partkey").alias("chrom"), (F.col("s") + 1).alias("start"), F.col("e").alias("end"))
    return J.lift(points, blocks, "k", "chrom", "start", "end", 64).select("l_orderkey", "l_linenumber", "lifted_chrom", "lifted_start", "lifted_end", "status")


@query("joi08_as_of", f"""WITH p AS (SELECT event_id, user_id AS g, {DAY.format('ts')} AS d FROM events), sg AS (SELECT o_custkey AS g, {DAY.format('o_orderdate')} AS s, max({DAY.format('o_orderdate')} + o_orderkey % 400) AS e FROM orders GROUP BY ALL),
j AS (SELECT event_id, d, sg.s, sg.e FROM p ASOF LEFT JOIN sg ON p.g = sg.g AND p.d >= sg.s) SELECT event_id, CASE WHEN e >= d THEN s END AS start FROM j""")
def _(t):
    p = t.events.select("event_id", F.col("user_id").alias("g"), day("ts").alias("d"))
    sg = t.orders.groupBy(F.col("o_custkey").alias("g"), day("o_orderdate").alias("s")).agg(F.max(day("o_orderdate") + F.col("o_orderkey") % 400).alias("e")).withColumn("start", F.col("s"))
    return J.as_of(p, sg, ["g"], "d", "s", "e", ["start"]).select("event_id", "start")


NEAR = f"""{SPANS}, a AS (SELECT l_orderkey, l_linenumber, l_partkey AS chrom, s, e FROM iv WHERE chrom <> 'R'), b AS (SELECT l_orderkey AS bo, l_linenumber AS bl, l_partkey AS chrom, s AS bs, e AS be FROM iv WHERE chrom = 'R')"""


def near(t):
    """Intervals on a part: those of lines that were not returned, and those of the returned ones."""
    iv = spans(t).withColumn("flag", F.col("chrom")).withColumn("chrom", F.col("l_partkey"))
    b = iv.where("flag = 'R'").select(F.col("l_orderkey").alias("bo"), F.col("l_linenumber").alias("bl"), "chrom", F.col("s").alias("bs"), F.col("e").alias("be"))
    return iv.where("flag <> 'R'").select("l_orderkey", "l_linenumber", "chrom", "s", "e"), b


@query("joi09_distance", f"WITH {NEAR} SELECT l_orderkey, l_linenumber, bo, bl, greatest(bs - e, s - be, 0) AS distance FROM a JOIN b USING (chrom) WHERE s - 30 < be AND bs < e + 30 AND NOT (s < be AND bs < e)")
def _(t):
    a, b = near(t)
    out = J.binned(a, b, ["chrom"], ("s", "e"), ("bs", "be"), 64, within=30, coarser=2).where("not (s < be and bs < e)")
    return out.select("l_orderkey", "l_linenumber", "bo", "bl", F.greatest(F.col("bs") - F.col("e"), F.col("s") - F.col("be"), F.lit(0)).alias("distance"))


@query("joi10_overlap", f"WITH {NEAR} SELECT l_orderkey, l_linenumber, count(*) AS n, CAST(sum(least(e, be) - greatest(s, bs)) AS BIGINT) AS bp FROM a JOIN b USING (chrom) WHERE s < be AND bs < e GROUP BY ALL")
def _(t):
    a, b = near(t)
    return J.binned(a, b, ["chrom"], ("s", "e"), ("bs", "be"), 64, coarser=2).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.sum(F.least("e", "be") - F.greatest("s", "bs")).alias("bp"))


@query("joi11_routes", f"""WITH {MEMBERSHIP}, ev AS (SELECT l_orderkey * 10 + l_linenumber AS event, CASE WHEN l_linenumber % 2 = 0 THEN p_type ELSE p_brand END AS partner FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT event, target, min(route) AS route FROM (SELECT event, target, 'direct' AS route FROM ev JOIN (SELECT DISTINCT target FROM mem) ON partner = target UNION ALL SELECT event, target, 'member' FROM ev JOIN mem ON partner = entity) GROUP BY ALL""")
def _(t):
    ev = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event"), F.when(F.col("l_linenumber") % 2 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("partner"))
    return J.route_events(ev, t.membership(), "event", "partner", "target", "entity")


@query("joi12_attach", """WITH c AS (SELECT DISTINCT l_suppkey AS s, l_returnflag AS f, l_linestatus AS cohort FROM lineitem), ev AS (SELECT l_suppkey AS s, l_returnflag AS f, CASE WHEN l_linenumber % 3 > 0 THEN l_linestatus END AS cohort, l_orderkey AS ev FROM lineitem)
SELECT s, f, cohort, ev, 'local' AS scope FROM c JOIN ev USING (s, f, cohort) UNION ALL SELECT c.s, c.f, c.cohort, ev, 'global' FROM c JOIN ev ON c.s = ev.s AND c.f = ev.f WHERE ev.cohort IS NULL""")
def _(t):
    c = t.lineitem.select(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("cohort")).distinct()
    ev = t.lineitem.select(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_linestatus")).alias("cohort"), F.col("l_orderkey").alias("ev"))
    return J.attach_events(c, ev, ["s", "f"], "cohort")


@query("joi13_paths", "SELECT DISTINCT c_nationkey, l_suppkey, p_brand, p_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey")
def _(t):
    return t.sales().select("c_nationkey", "l_suppkey", "p_brand", "p_type").distinct()


@query("joi14_mask", "SELECT p_partkey, f.fold AS fold FROM part, (SELECT unnest(range(5)) AS fold) f WHERE (p_size & (1 << f.fold)) <> 0 AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = f.fold)")
def _(t):
    out = J.expand_mask(t.part.select("p_partkey", "p_size"), "p_size", 5)
    return out.join(t.supplier.select(F.col("s_nationkey").alias("fold")).distinct(), "fold", "left_semi").select("p_partkey", "fold")


@query("joi15_leaks", "SELECT o_custkey, count(DISTINCT o_orderkey % 3) AS folds FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(DISTINCT o_orderkey % 3) > 1")
def _(t):
    rows = J.validated(t.orders.withColumnRenamed("o_custkey", "c_custkey"), t.customer, ["c_custkey"], "inner").select(F.col("c_custkey").alias("o_custkey"), (F.col("o_orderkey") % 3).alias("fold"))
    return Q.leaks(rows, "o_custkey", "fold")


@query("set01_union", "SELECT c_nationkey AS k, 'customer' AS src FROM customer UNION SELECT s_nationkey, 'supplier' FROM supplier")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("src")).unionByName(t.supplier.select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("src"))).distinct()


@query("set02_except", "SELECT l_partkey, l_returnflag FROM lineitem WHERE l_linenumber = 1 EXCEPT ALL SELECT l_partkey, l_returnflag FROM lineitem WHERE l_linenumber = 2")
def _(t):
    side = lambda n: t.lineitem.where(F.col("l_linenumber") == n).select("l_partkey", "l_returnflag")
    return side(1).exceptAll(side(2))


@query("set03_axes", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def _(t):
    side = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return side("F").intersect(side("O"))


@query("set04_arms", "SELECT k, bool_or(a) AS in_bulk, bool_or(NOT a) AS in_cell FROM (SELECT l_orderkey AS k, true AS a FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT l_orderkey, false FROM lineitem WHERE l_linestatus = 'F') GROUP BY 1")
def _(t):
    side = lambda s: t.lineitem.where(F.col("l_linestatus") == s).select(F.col("l_orderkey").alias("k"))
    return J.two_arms(side("O"), side("F"), ["k"], ("bulk", "cell"))


@query("dq01_keys", "WITH g AS (SELECT CASE WHEN l_tax > 0 THEN l_orderkey END AS k, l_linenumber % 3 AS n, count(*) AS c FROM lineitem GROUP BY ALL) SELECT CAST(sum(c) AS BIGINT) AS rows, CAST(sum(c) FILTER (WHERE k IS NULL) AS BIGINT) AS null_keys, count(*) FILTER (WHERE c > 1 AND k IS NOT NULL) AS repeated_keys FROM g")
def _(t):
    return Q.key_report(t.lineitem.select(F.when(F.col("l_tax") > 0, F.col("l_orderkey")).alias("k"), (F.col("l_linenumber") % 3).alias("n")), ["k", "n"])


@query("dq02_domains", "SELECT 'probability' AS rule, count(*) FILTER (WHERE NOT (l_discount * 11 BETWEEN 0 AND 1)) AS violations FROM lineitem UNION ALL SELECT 'quantity', count(*) FILTER (WHERE NOT (l_quantity >= 2)) FROM lineitem")
def _(t):
    return Q.domain_report(t.lineitem, {"probability": (F.col("l_discount") * 11).between(0, 1), "quantity": F.col("l_quantity") >= 2})


@query("dq03_coverage", "SELECT count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS matched, count(*) AS total, round(count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders)) / count(*), 6) AS fraction, count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders)) / count(*) >= 0.6 AS passed FROM customer")
def _(t):
    return Q.coverage(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], 0.6).withColumn("fraction", F.round("fraction", 6))


@query("dq04_leaks", "SELECT l_partkey, count(DISTINCT l_suppkey % 5) AS folds FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey % 5) > 1")
def _(t):
    return Q.leaks(t.lineitem.select("l_partkey", (F.col("l_suppkey") % 5).alias("f")), "l_partkey", "f")


@query("dq05_table_hash")
def _(t):
    return Q.table_hash(t.lineitem)


@query("dq06_availability", "WITH r AS (SELECT l_orderkey, l_linenumber, l_discount, CASE WHEN l_tax = 0 THEN 'no_assay' WHEN l_quantity < 5 THEN 'too_few' END AS reason FROM lineitem) SELECT l_orderkey, l_linenumber, reason, CASE WHEN reason IS NULL THEN l_discount END AS value FROM r")
def _(t):
    out = Q.availability(t.lineitem, F.col("l_discount"), [(F.col("l_tax") == 0, "no_assay"), (F.col("l_quantity") < 5, "too_few")])
    return out.select("l_orderkey", "l_linenumber", F.col("reason_").alias("reason"), F.col("value_").alias("value"))
