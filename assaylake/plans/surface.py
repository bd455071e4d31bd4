"""Single-cell, genome, model, source and user-level queries over the driver tables."""

from pyspark.sql import functions as F

from assaylake.operators import cells as C
from assaylake.operators import genome as N
from assaylake.operators import ids as I
from assaylake.operators import joins as J
from assaylake.operators import models as M
from assaylake.operators import windows as W
from assaylake.plans.binding import MEASUREMENTS, query
from assaylake.plans.shape import DAY, day
from assaylake.sources import readers as S


@query("src01_scan", "SELECT l_suppkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def _(t):
    return S.scan(t.spark, f"{t.dir}/lineitem.parquet", ["l_suppkey", "l_quantity"], (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45))


@query("src03_stack", "SELECT src, count(*) AS n, count(c_acctbal) AS balances, count(s_acctbal) AS supplied FROM (SELECT 'customer.parquet' AS src, c_acctbal, NULL AS s_acctbal FROM customer UNION ALL SELECT 'supplier.parquet', NULL, s_acctbal FROM supplier) GROUP BY 1")
def _(t):
    out = S.stack([t.customer, t.supplier])
    return out.groupBy(F.regexp_extract("_source_path", r"/(\w+\.parquet)", 1).alias("src")).agg(F.count("*").alias("n"), F.count("c_acctbal").alias("balances"), F.count("s_acctbal").alias("supplied"))


@query("src09_long", "SELECT l_suppkey, sample, CAST(value AS BIGINT) AS value FROM (SELECT l_suppkey, sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag = 'R') AS R, sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag = 'A' AND l_tax > 0.079) AS A FROM lineitem GROUP BY 1) UNPIVOT (value FOR sample IN (R, A))")
def _(t):
    pick = lambda c: F.sum(F.when(c, F.col("l_quantity").cast("long")))
    wide = t.lineitem.groupBy("l_suppkey").agg(pick(F.col("l_returnflag") == "R").alias("R"), pick((F.col("l_returnflag") == "A") & (F.col("l_tax") > 0.079)).alias("A"))
    return S.to_long(wide, "l_suppkey")


@query("src10_staging", "SELECT 'screen_' || l_returnflag AS dataset, l_orderkey AS cell_line, l_partkey AS drug, CASE WHEN l_linestatus = 'O' THEN -l_discount ELSE l_discount END AS response FROM lineitem WHERE l_returnflag IN ('R', 'A')")
def _(t):
    stage = lambda flag: t.lineitem.where(F.col("l_returnflag") == flag).select(F.lit(f"screen_{flag}").alias("dataset"), F.col("l_orderkey").alias("cell_line"), F.col("l_partkey").alias("drug"), F.when(F.col("l_linestatus") == "O", -F.col("l_discount")).otherwise(F.col("l_discount")).alias("response"))
    return stage("R").unionByName(stage("A"))


@query("sc01_type_summary", "WITH g AS (SELECT p_brand, l_returnflag || l_linestatus AS kind, avg(CASE WHEN l_discount > 0 THEN 1.0 ELSE 0.0 END) AS detection, avg(l_discount) AS mean, count(DISTINCT l_suppkey) AS donors FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), t AS (SELECT p_brand, max(mean) AS top, count(*) AS k, sum(mean) AS s FROM g GROUP BY 1) SELECT p_brand, kind, round(detection, 6) AS detection, round(mean, 9) AS mean, donors, round((k - s / top) / (k - 1), 6) AS tau FROM g JOIN t USING (p_brand)")
def _(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn("kind", F.concat("l_returnflag", "l_linestatus"))
    return C.type_summary(rows, "p_brand", "kind", "l_suppkey", "l_discount").withColumns({"detection": F.round("detection", 6), "mean": F.round("mean", 9), "tau": F.round("tau", 6)})


@query("sc03_donor_effects", "WITH d AS (SELECT p_brand, l_suppkey, corr(l_extendedprice, l_discount) AS r, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING count(*) >= 8), z AS (SELECT p_brand, count(*) AS donors, avg(atanh(r)) AS m, stddev_samp(atanh(r)) AS s, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS up FROM d WHERE r IS NOT NULL GROUP BY 1) SELECT p_brand, donors, round(tanh(m), 6) AS effect, round(m / (s / sqrt(donors)), 6) AS t, round(greatest(up, 1 - up), 6) AS consistency FROM z")
def _(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return C.donor_effects(rows, ["p_brand"], "l_suppkey", "l_extendedprice", "l_discount", 8).withColumns({c: F.round(c, 6) for c in ("effect", "t", "consistency")})


@query("sc04_metacells", "WITH s AS (SELECT o_custkey % 200 AS g, l_suppkey, sum(CAST(l_quantity AS BIGINT)) AS n, count(DISTINCT o_custkey) AS cells FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), l AS (SELECT g, sum(n) AS lib FROM s GROUP BY 1) SELECT g, l_suppkey, cells, round(ln(1 + n / lib * 10000), 6) AS value FROM s JOIN l USING (g)")
def _(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", (F.col("o_custkey") % 200).alias("g"), "l_suppkey", F.col("l_quantity").cast("long").alias("n"))
    return C.metacells(rows, "o_custkey", "g", "l_suppkey", "n").withColumn("value", F.round("value", 6))


@query("sc06_features", "SELECT l_suppkey, " + ", ".join(f"round(max(l_discount - 0.05) FILTER (WHERE l_returnflag = '{k}'), 6) AS \"{k}_rho\", round(max(abs(l_discount - 0.05)) FILTER (WHERE l_returnflag = '{k}'), 6) AS \"{k}_abs\", round(max(-log10(l_tax + 0.01)) FILTER (WHERE l_returnflag = '{k}'), 6) AS \"{k}_q\", coalesce(bool_or(l_returnflag = '{k}'), false) AS \"{k}_available\"" for k in "RAN") + " FROM lineitem GROUP BY 1")
def _(t):
    rows = t.lineitem.select("l_suppkey", "l_returnflag", (F.col("l_discount") - 0.05).alias("rho"), (F.col("l_tax") + 0.01).alias("q"))
    out = C.feature_vectors(rows, ["l_suppkey"], "l_returnflag", list("RAN"), "rho", "q")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith(("_rho", "_abs", "_q"))})


@query("sc07_contexts", "WITH k AS (SELECT s_suppkey, f.f AS f FROM supplier, (SELECT DISTINCT l_returnflag AS f FROM lineitem) f), a AS (SELECT l_suppkey AS s_suppkey, l_returnflag AS f, max(l_quantity) AS x FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL), b AS (SELECT l_suppkey AS s_suppkey, l_returnflag AS f, max(l_linenumber) AS y FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL) SELECT s_suppkey, f, x, y, CASE WHEN x IS NULL AND y IS NULL THEN 'neither' WHEN x IS NULL THEN 'no_expression' WHEN y IS NULL THEN 'no_activity' END AS reason FROM k LEFT JOIN a USING (s_suppkey, f) LEFT JOIN b USING (s_suppkey, f)")
def _(t):
    keys = t.supplier.select("s_suppkey").join(F.broadcast(t.lineitem.select(F.col("l_returnflag").alias("f")).distinct()))
    side = lambda status, c, n: t.lineitem.where(F.col("l_linestatus") == status).groupBy(F.col("l_suppkey").alias("s_suppkey"), F.col("l_returnflag").alias("f")).agg(F.max(c).alias(n))
    return C.paired_contexts(side("F", "l_quantity", "x"), side("O", "l_linenumber", "y"), keys, ["s_suppkey", "f"], "x", "y")


@query("sc08_coverage", f"WITH {MEASUREMENTS}, s AS (SELECT DISTINCT cohort, entity FROM m WHERE value > 10.5), p AS (SELECT cohort, count(*) AS n FROM s GROUP BY 1), e AS (SELECT entity, count(*) AS c FROM s GROUP BY 1) SELECT (SELECT count(*) FROM p) AS cohorts, (SELECT min(n) FROM p) AS least, (SELECT median(n) FROM p) AS median, (SELECT round(avg(n), 6) FROM p) AS mean, (SELECT max(n) FROM p) AS most, (SELECT count(*) FROM e) AS \"union\", (SELECT count(*) FROM e WHERE c = (SELECT count(*) FROM p)) AS intersection")
def _(t):
    return C.coverage_counts(t.measurements().where("value > 10.5"), "cohort", "entity").withColumn("mean", F.round("mean", 6))


SEG = f"sg AS (SELECT o_custkey % 10 AS g, {DAY.format('o_orderdate')} AS s, max({DAY.format('o_orderdate')} + o_orderkey % 5) AS e, max_by(o_totalprice / 100000 - 1.4, {DAY.format('o_orderdate')} + o_orderkey % 5 + o_orderkey / 1e9) AS v FROM orders GROUP BY ALL)"


@query("gen01_segments", f"""WITH {SEG}, p AS (SELECT DISTINCT user_id % 10 AS g, {DAY.format('ts')} AS d FROM events), j AS (SELECT p.g, p.d, CASE WHEN sg.e >= p.d THEN v END AS v FROM p ASOF LEFT JOIN sg ON p.g = sg.g AND p.d >= sg.s)
SELECT g, d % 30 AS entity, round(avg(abs(v)), 6) AS burden, coalesce(bool_or(v >= 0.3 OR v <= -0.3), false) AS event, count(v) > 0 AS callable, round(avg(v), 6) AS signed_mean, coalesce(bool_or(v >= 0.3), false) AS gain, coalesce(bool_or(v <= -0.3), false) AS loss FROM j GROUP BY ALL""")
def _(t):
    end = day("o_orderdate") + F.col("o_orderkey") % 5
    sg = t.orders.groupBy((F.col("o_custkey") % 10).alias("g"), day("o_orderdate").alias("s")).agg(F.max(end).alias("e"), F.max_by(F.col("o_totalprice") / 100000 - 1.4, end + F.col("o_orderkey") / 1e9).alias("v"))
    p = t.events.select((F.col("user_id") % 10).alias("g"), day("ts").alias("d")).distinct()
    m = J.as_of(p, sg, ["g"], "d", "s", "e", ["v"]).withColumn("entity", F.col("d") % 30)
    return N.segment_calls(m, ["g", "entity"], "v", 0.3, -0.3).withColumns({"burden": F.round("burden", 6), "signed_mean": F.round("signed_mean", 6)})


@query("gen02_calls", "WITH l AS (SELECT l_partkey AS entity, l_suppkey AS patient, CAST(l_linenumber % 3 - 1 AS INT) AS v FROM lineitem), n AS (SELECT entity, count(DISTINCT patient) AS patients, count(*) FILTER (WHERE v = 0) AS zeros FROM l GROUP BY 1 HAVING count(DISTINCT patient) >= 25) SELECT entity, patient, v, patients, zeros FROM l JOIN n USING (entity) WHERE v <> 0")
def _(t):
    long = t.lineitem.select(F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("patient"), (F.col("l_linenumber") % 3 - 1).cast("int").alias("v"))
    return N.calls(long, "entity", "patient", "v", 25)


@query("gen06_kmers", """WITH s AS (SELECT item_id AS k, lower(text) AS s FROM benchmark), p AS (SELECT k, s, unnest(range(1, greatest(length(s) - 3, 1) + 1)) AS i FROM s), c AS (SELECT k, substr(s, i, 4) AS kmer, count(*) AS n FROM p WHERE regexp_full_match(substr(s, i, 4), '[a-z]{4}') GROUP BY ALL), e AS (SELECT kmer, log2(sum(n) / 10.0) AS v FROM c WHERE k % 2 = 0 GROUP BY 1)
SELECT k, round(sum(n * v) / sum(CASE WHEN v IS NOT NULL THEN n END), 6) AS score, CAST(sum(n) AS BIGINT) AS kmers, CAST(sum(CASE WHEN v IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS known FROM c LEFT JOIN e USING (kmer) GROUP BY 1""")
def _(t):
    c = N.kmers(t.benchmark.withColumnRenamed("item_id", "k"), "k", "text", 4)
    profile = c.where("k % 2 = 0").groupBy("kmer").agg(F.log2(F.sum("n") / 10.0).alias("log2_enrichment"))
    return N.preference(c, profile, "k").withColumn("score", F.round("score", 6))


@query("ml01_logistic")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("s"), F.col("l_linestatus").alias("f"), "l_quantity", (F.col("l_returnflag") == "R").cast("double").alias("y"))
    k = F.col("l_orderkey") % 5
    return M.hashed_logistic(rows, ["s", "f", "l_quantity"], "y", k < 3, k == 3, 256, (0.001, 0.1), True)[0].select("l_orderkey", "l_linenumber", F.round("probability_", 6).alias("probability"))


@query("ml02_ridge")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), "l_discount", "l_tax", "l_extendedprice", (F.col("l_orderkey") % 3).alias("fold"))
    return M.ridge_out_of_fold(rows, ["q", "l_discount", "l_tax"], "l_extendedprice", "fold", 3, 0.1).select("l_orderkey", "l_linenumber", F.round("prediction", 3).alias("prediction"))


@query("ml05_temperature", """WITH r AS (SELECT (l_discount - 0.045) * 80 AS z, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem), g AS (SELECT 0.25 + 3.75 * unnest(range(17)) / 16 AS t), s AS (SELECT t, avg(ln(1 + exp(-abs(z / t))) + greatest(z / t, 0) - z / t * y) AS nll FROM r, g GROUP BY 1) SELECT round(t, 6) AS temperature, round(nll, 6) AS nll FROM s ORDER BY round(nll, 12), t LIMIT 1""")
def _(t):
    rows = t.lineitem.select(((F.col("l_discount") - 0.045) * 80).alias("z"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    return M.temperature(rows, "z", "y", rounds=1).select(F.round("temperature", 6).alias("temperature"), F.round("nll", 6).alias("nll"))


@query("ml06_modules")
def _(t):
    return M.modules(t.embeddings, "embedding", "vec_id", 8, 12)


@query("ml07_blend", """WITH r AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, l_discount * 5 + 0.1 AS b, l_tax - 0.04 AS d, unnest([0.0, 0.5, 1.0, 2.0]) AS w FROM lineitem), s AS (SELECT w, y, least(greatest(b + w * d, 0), 1) AS s FROM r), g AS (SELECT w, s, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY w ORDER BY s) - n AS below FROM g), a AS (SELECT w, sum(p * (below + n / 2)) / (sum(p) * sum(n)) AS auroc FROM c GROUP BY 1), b AS (SELECT w, avg((s - y) * (s - y)) AS brier FROM s GROUP BY 1)
SELECT CAST(w AS DOUBLE) AS weight, round(auroc, 6) AS auroc, round(brier, 6) AS brier FROM a JOIN b USING (w) WHERE brier <= (SELECT brier FROM b WHERE w = 0) + 0.01 ORDER BY round(auroc, 9) DESC, w LIMIT 1""")
def _(t):
    rows = t.lineitem.select((F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_discount") * 5 + 0.1).alias("b"), (F.col("l_tax") - 0.04).alias("d"))
    return M.blend_weight(rows, "b", "d", "y", (0.5, 1.0, 2.0), 0.01).withColumns({"auroc": F.round("auroc", 6), "brier": F.round("brier", 6)})


@query("ml09_fold_slopes", """WITH o AS (SELECT p_brand, l_linenumber AS f, count(*) AS n, sum(l_quantity) AS x, sum(l_extendedprice) AS y, sum(l_quantity * l_quantity) AS xx, sum(l_quantity * l_extendedprice) AS xy FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), m AS (SELECT p_brand, f, sum(n) OVER w - n AS n, sum(x) OVER w - x AS x, sum(y) OVER w - y AS y, sum(xx) OVER w - xx AS xx, sum(xy) OVER w - xy AS xy FROM o WINDOW w AS (PARTITION BY p_brand))
SELECT p_brand, f AS l_linenumber, CAST(n AS BIGINT) AS n, round((xy - x * y / n) / (xx - x * x / n), 4) AS slope, round((y - (xy - x * y / n) / (xx - x * x / n) * x) / n, 3) AS intercept FROM m""")
def _(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn("q", F.col("l_quantity").cast("double"))
    return M.fold_slopes(rows, ["p_brand"], "l_linenumber", "q", "l_extendedprice").withColumns({"slope": F.round("slope", 4), "intercept": F.round("intercept", 3)})


@query("qry02_search", "SELECT DISTINCT kind, label FROM (SELECT 'part' AS kind, p_name AS label FROM part UNION ALL SELECT 'brand', p_brand FROM part UNION ALL SELECT 'nation', n_name FROM nation) WHERE label ILIKE '%1%' ORDER BY kind, label LIMIT 200")
def _(t):
    found = t.part.select(F.lit("part").alias("kind"), F.col("p_name").alias("label")).unionByName(t.part.select(F.lit("brand").alias("kind"), F.col("p_brand").alias("label"))).unionByName(t.nation.select(F.lit("nation").alias("kind"), F.col("n_name").alias("label")))
    return found.where(F.col("label").ilike("%1%")).distinct().orderBy("kind", "label").limit(200)


@query("qry03_browse", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(max(l_discount), 6) AS best FROM lineitem WHERE l_suppkey = 7 AND l_discount >= 0.05 GROUP BY ALL")
def _(t):
    return t.lineitem.where("l_suppkey = 7 and l_discount >= 0.05").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.max("l_discount"), 6).alias("best"))


@query("qry05_profile", "WITH g AS (SELECT l_suppkey, p_brand, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT l_suppkey, p_brand, n, returned, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, p_brand) AS rank FROM g QUALIFY rank <= 5")
def _(t):
    g = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    return W.top_k(g, ["l_suppkey"], [F.desc("n"), F.col("p_brand")], 5)


@query("qry08_sparse_key", """WITH k AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), h AS (SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE l_tax = 0.08 AND l_quantity = 50), x AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_tax = 0), v AS (SELECT l_suppkey AS s, l_partkey AS p, max(l_discount) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT q.s AS s, q.p AS p, q.v AS v, CASE WHEN h.s IS NULL THEN 'no_held_out_assay' WHEN x.p IS NULL THEN 'no_expression' WHEN v IS NULL THEN 'no_value' END AS reason FROM (SELECT k.s, k.p, v.v FROM k LEFT JOIN v USING (s, p)) q LEFT JOIN h ON q.s = h.s LEFT JOIN x ON q.p = x.p""")
def _(t):
    k = t.lineitem.select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    h = t.lineitem.where("l_tax = 0.08 and l_quantity = 50").select(F.col("l_suppkey").alias("s"), F.lit(1).alias("h")).distinct()
    x = t.lineitem.where("l_tax = 0").select(F.col("l_partkey").alias("p"), F.lit(1).alias("x")).distinct()
    v = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).agg(F.max("l_discount").alias("v"))
    out = k.join(v, ["s", "p"], "left").join(h, "s", "left").join(x, "p", "left")
    return out.select("s", "p", "v", F.when(F.col("h").isNull(), "no_held_out_assay").when(F.col("x").isNull(), "no_expression").when(F.col("v").isNull(), "no_value").alias("reason"))


@query("qry09_endpoints", "WITH p AS (SELECT c_nationkey, o_custkey, o_orderstatus AS ep, max(CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END) AS ev FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT c_nationkey, ep, count(DISTINCT o_custkey) AS patients, CAST(sum(ev) AS BIGINT) AS events FROM p GROUP BY ALL")
def _(t):
    p = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "o_custkey", F.col("o_orderstatus").alias("ep")).agg(F.max((F.col("o_totalprice") > 150000).cast("int")).alias("ev"))
    return p.groupBy("c_nationkey", "ep").agg(F.count_distinct("o_custkey").alias("patients"), F.sum("ev").alias("events"))


@query("id07_members", """WITH i AS (SELECT DISTINCT upper(p_brand) AS alias, CASE WHEN p_brand < 'Brand#2' THEN 'lnc' ELSE 'gene' END AS kind, CASE WHEN p_brand < 'Brand#4' THEN p_brand ELSE p_type END AS id FROM part), m AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS position, CASE l_linenumber % 3 WHEN 0 THEN 'lnc:' || p_brand WHEN 1 THEN 'GENE:' || p_brand ELSE p_brand || CASE WHEN l_tax = 0 THEN 'x' || CAST(l_orderkey AS VARCHAR) ELSE '' END END AS member, CASE l_linenumber % 3 WHEN 0 THEN 'LNC' WHEN 1 THEN 'GENE' ELSE '' END AS forced, upper(p_brand) || CASE WHEN l_linenumber % 3 = 2 AND l_tax = 0 THEN 'X' || CAST(l_orderkey AS VARCHAR) ELSE '' END AS alias FROM lineitem JOIN part ON l_partkey = p_partkey),
h AS (SELECT position, count(DISTINCT id) AS n, min(kind) AS kind, member FROM m JOIN i USING (alias) WHERE forced = '' OR upper(kind) = forced GROUP BY position, member) SELECT m.position AS position, m.member AS member, CASE WHEN row_number() OVER (PARTITION BY alias ORDER BY m.position) > 1 THEN 'duplicate' WHEN n IS NULL THEN 'unmapped' WHEN n > 1 THEN 'ambiguous' ELSE kind END AS state FROM m LEFT JOIN h ON m.position = h.position AND m.member = h.member""")
def _(t):
    i = t.part.select(F.upper("p_brand").alias("alias"), F.when(F.col("p_brand") < "Brand#2", "lnc").otherwise("gene").alias("kind"), F.when(F.col("p_brand") < "Brand#4", F.col("p_brand")).otherwise(F.col("p_type")).alias("id")).distinct()
    k = F.col("l_linenumber") % 3
    name = F.when(k == 0, F.concat(F.lit("lnc:"), "p_brand")).when(k == 1, F.concat(F.lit("GENE:"), "p_brand")).otherwise(F.concat("p_brand", F.when(F.col("l_tax") == 0, F.concat(F.lit("x"), F.col("l_orderkey").cast("string"))).otherwise("")))
    m = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), name.alias("member")).distinct()
    return I.classify_members(m, i)
