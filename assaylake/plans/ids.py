"""Identity operators over the driver tables."""

from pyspark.sql import functions as F

from assaylake.functions import scalars as X
from assaylake.operators import ids
from assaylake.plans.binding import query


@query("id01_barcodes", """WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE 'TCGA-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(c_custkey % 12 AS VARCHAR), 2, '0') || 'A' END AS barcode FROM customer)
SELECT c_custkey, CASE WHEN barcode LIKE 'TCGA-%' THEN substr(barcode, 1, 12) ELSE barcode END AS patient, CASE WHEN barcode LIKE 'TCGA-%' THEN substr(barcode, 1, 15) ELSE barcode END AS sample, CASE WHEN barcode LIKE 'TCGA-%' THEN substr(barcode, 14, 2) END AS sample_type FROM b""")
def _(t):
    code = F.concat(F.lit("TCGA-"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("-"), F.lpad((F.col("c_custkey") % 12).cast("string"), 2, "0"), F.lit("A"))
    b = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).otherwise(code).alias("b"))
    whole = F.when(F.col("b").rlike("^TCGA-"), F.substring("b", 1, 15)).otherwise(F.col("b"))
    return b.select("c_custkey", X.patient_of(F.col("b")).alias("patient"), whole.alias("sample"), X.sample_type(F.col("b")).alias("sample_type"))


@query("id02_canonical", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE upper(trim(p_brand)) || '-' || CAST(p_partkey AS VARCHAR) END AS ident FROM part")
def _(t):
    raw = F.when(F.col("p_partkey") % 7 == 0, F.lit(" na ")).otherwise(F.concat(F.lit("  "), F.lower("p_brand"), F.lit("-"), "p_partkey", F.lit("."), F.col("p_size"), F.lit(" ")))
    return t.part.select("p_partkey", X.canonical(raw).alias("ident"))


@query("id03_stable_id", "SELECT o_orderkey, 'ord:' || substr(sha256(CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR) || '|' || coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END, '')), 1, 20) AS id FROM orders")
def _(t):
    return t.orders.select("o_orderkey", X.stable_id("ord", F.col("o_orderkey"), F.col("o_custkey"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))).alias("id"))


@query("id04_crosswalk", """WITH a AS (SELECT DISTINCT upper(trim(unnest(regexp_split_to_array(p_name, '[ ;,|]')))) AS alias, p_brand AS kind, p_partkey AS key FROM part),
n AS (SELECT alias, kind, count(key) AS candidates FROM a GROUP BY ALL) SELECT a.alias, a.kind, a.key, candidates, CASE WHEN candidates = 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM a JOIN n USING (alias, kind) WHERE a.alias <> ''""")
def _(t):
    named = t.part.select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("kind"), F.translate("p_name", " ", "|").alias("a"))
    return ids.crosswalk(named, "key", "a", "kind").select("alias", "kind", "key", "candidates", "status")


@query("id05_priority", """WITH s AS (SELECT ps, pp, src, row_number() OVER (PARTITION BY ps, pp ORDER BY src) AS r FROM (
SELECT l_suppkey AS ps, l_partkey AS pp, 1 AS src FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_suppkey, l_partkey, 2 FROM lineitem WHERE l_returnflag = 'N' UNION ALL SELECT l_suppkey, l_partkey, 3 FROM lineitem)) SELECT ps, pp, src AS priority FROM s WHERE r = 1""")
def _(t):
    pick = lambda flag: t.lineitem.where(F.lit(True) if flag is None else F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("ps"), F.col("l_partkey").alias("pp"))
    return ids.by_priority([pick("R"), pick("N"), pick(None)], ["ps", "pp"])


@query("id06_resolution", """WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey AS drug, l_partkey AS gene FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN s.s_suppkey IS NOT NULL AND p.p_partkey IS NOT NULL THEN 'mapped' WHEN s.s_suppkey IS NOT NULL THEN 'drug_only' WHEN p.p_partkey IS NOT NULL THEN 'gene_only' ELSE 'unmapped' END AS status
FROM r LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey < 15) s ON drug = s_suppkey LEFT JOIN (SELECT * FROM part WHERE p_size < 25) p ON gene = p_partkey""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("drug"), F.col("l_partkey").alias("gene"))
    drugs = t.supplier.where("s_nationkey < 15").select(F.col("s_suppkey").alias("drug"), F.col("s_suppkey").alias("drug_id"))
    genes = t.part.where("p_size < 25").select(F.col("p_partkey").alias("gene"), F.col("p_partkey").alias("gene_id"))
    return ids.resolve(rows, drugs, genes).select("l_orderkey", "l_linenumber", "status")


@query("id08_coalesce", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, CAST(c_nationkey AS DOUBLE)) AS balance FROM customer")
def _(t):
    df = t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("Acct Bal."), F.col("c_nationkey").cast("double").alias("NATION_KEY"))
    return df.select("c_custkey", ids.coalesced(df, ["acct_bal", "nationkey"]).alias("balance"))


@query("id09_strict_bool", """WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN '0' WHEN 2 THEN NULL WHEN 3 THEN 'false' ELSE event_type END AS raw FROM events)
SELECT event_id, CASE WHEN raw IS NULL OR lower(raw) IN ('false', '0') THEN false WHEN lower(raw) IN ('true', '1') THEN true END AS flag FROM r""")
def _(t):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, "TRUE").when(k == 1, "0").when(k == 2, F.lit(None)).when(k == 3, "false").otherwise(F.col("event_type"))
    return t.events.select("event_id", X.strict_bool(raw).alias("flag"))


@query("id11_global_rows", """SELECT s_suppkey, r_name AS cohort FROM supplier, region WHERE s_nationkey % 6 = 0 UNION ALL
SELECT s_suppkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_nationkey % 6 <> 0""")
def _(t):
    placed = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = placed.select("s_suppkey", F.when(F.col("s_nationkey") % 12 == 0, "PAN").when(F.col("s_nationkey") % 6 != 0, F.col("r_name")).alias("cohort"))
    return ids.expand_global(rows, t.region.select(F.col("r_name").alias("cohort")), "cohort")


@query("id12_text", """SELECT event_id, CASE WHEN regexp_extract(props, '(?:^|[^0-9])([0-9]{6,9})(?:[^0-9]|$)', 1) <> '' THEN regexp_extract(props, '(?:^|[^0-9])([0-9]{6,9})(?:[^0-9]|$)', 1) END AS pmid,
CASE WHEN event_type LIKE 'a%' AND (event_type LIKE 'activat%' OR event_type = 'a') THEN 'positive' WHEN regexp_matches(lower(event_type), '^(up|pos|positive|increase)') THEN 'positive' WHEN regexp_matches(lower(event_type), '^(down|neg|negative|decrease|inhibit|repress|r$)') THEN 'negative' ELSE 'unknown' END AS direction FROM events""")
def _(t):
    return t.events.select("event_id", X.pmid(F.col("props")).alias("pmid"), X.direction(F.col("event_type")).alias("direction"))


RULES = [("steel|copper", "metal_hard"), ("brass|tin", "metal_soft"), ("anodized|plated", "coated")]


@query("id10_contexts", """WITH a AS (SELECT lower(n_name) AS alias, n_regionkey AS cohort FROM nation), txt AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'made in ' || lower(n_name) || '.' WHEN 2 THEN 'from ' || n_name || ', germany & japan' ELSE 'nowhere' END AS txt FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT s_suppkey, ' ' || regexp_replace(lower(txt), '[^a-z0-9]+', ' ', 'g') || ' ' AS p FROM txt), h AS (SELECT s_suppkey, count(DISTINCT cohort) AS n, min(cohort) AS one FROM p JOIN a ON contains(p, ' ' || alias || ' ') GROUP BY 1)
SELECT p.s_suppkey, CASE WHEN p IS NULL THEN 'global' WHEN n IS NULL THEN 'unmapped' WHEN n = 1 THEN 'exact' ELSE 'ambiguous' END AS context_status, CASE WHEN n = 1 THEN one END AS cohort FROM p LEFT JOIN h USING (s_suppkey)""")
def _(t):
    k, rows = F.col("s_suppkey") % 4, t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    txt = F.when(k == 1, F.concat(F.lit("made in "), F.lower("n_name"), F.lit("."))).when(k == 2, F.concat(F.lit("from "), "n_name", F.lit(", germany & japan"))).when(k == 3, "nowhere")
    found = ids.contexts(rows.select("s_suppkey", txt.alias("txt")), t.nation.select(F.lower("n_name").alias("alias"), F.col("n_regionkey").alias("cohort")), "txt")
    return found.select("s_suppkey", "context_status", F.col("cohort_").alias("cohort"))


@query("id13_taxonomy", """SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'steel|copper') THEN 'metal_hard' WHEN regexp_matches(lower(p_type), 'brass|tin') THEN 'metal_soft' WHEN regexp_matches(lower(p_type), 'anodized|plated') THEN 'coated' ELSE 'other' END AS class FROM part""")
def _(t):
    return t.part.select("p_partkey", ids.by_rules(F.col("p_type"), RULES, "other").alias("class"))


SPAN = "date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE))"


@query("id14_endpoints", f"""WITH c AS (SELECT o_custkey AS patient, CAST({SPAN} AS DOUBLE) AS t1, CAST(bool_or(o_orderstatus = 'F') AS INT) AS e1, CAST(count(*) AS DOUBLE) AS t2, CAST(bool_and(o_orderstatus <> 'P') AS INT) AS e2 FROM orders GROUP BY 1)
SELECT patient, 'OS' AS endpoint, t1 AS time, e1 AS event, t1 > 0 AS available FROM c UNION ALL SELECT patient, 'PFI', t2, e2, t2 > 0 FROM c""")
def _(t):
    days = F.datediff(F.max("o_orderdate"), F.min("o_orderdate"))
    c = t.orders.groupBy(F.col("o_custkey").alias("patient")).agg(days.alias("t1"), F.bool_or(F.col("o_orderstatus") == "F").alias("e1"), F.count("*").alias("t2"), F.bool_and(F.col("o_orderstatus") != "P").alias("e2"))
    return ids.endpoints(c, ["patient"], {"OS": ("t1", "e1"), "PFI": ("t2", "e2")})


@query("id15_most_complete", """WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS a, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS b, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS c FROM orders),
f AS (SELECT *, 1 + CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT) + CAST(c IS NOT NULL AS INT) AS filled FROM r) SELECT o_custkey, o_orderkey, filled FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY filled DESC, o_orderkey) = 1""")
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("a"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("b"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("c"))
    return ids.most_complete(rows, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "filled")


@query("id16_representative", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderpriority, o_orderkey) = 1")
def _(t):
    return ids.representative(t.orders, ["o_custkey"], [F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), F.col("o_orderpriority"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("id17_state_eligibility", """WITH s AS (SELECT n_name AS cohort, unnest([ {'state': 'balance', 'v': CASE WHEN c_acctbal > 0 THEN c_acctbal END}, {'state': 'segment', 'v': CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 END}]) AS u FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT cohort, u.state AS state, count(u.v) AS observed, round(1 - count(u.v) / count(*), 6) AS missing_rate, CASE WHEN count(u.v) = 0 THEN 'UNAVAILABLE' WHEN 1 - count(u.v) / count(*) > 0.5 THEN 'UNAVAILABLE' ELSE 'ELIGIBLE' END AS status, CASE WHEN count(u.v) = 0 THEN 'no_value' WHEN 1 - count(u.v) / count(*) > 0.5 THEN 'too_many_missing' END AS reason FROM s GROUP BY ALL""")
def _(t):
    wide = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("cohort"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.when(F.col("c_mktsegment") == "BUILDING", 1.0).alias("segment"))
    rate = 1 - F.count("v") / F.count("*")
    reason = F.when(F.count("v") == 0, "no_value").when(rate > 0.5, "too_many_missing")
    return wide.unpivot(["cohort"], ["balance", "segment"], "state", "v").groupBy("cohort", "state").agg(F.count("v").alias("observed"), F.round(rate, 6).alias("missing_rate"), F.when(reason.isNull(), "ELIGIBLE").otherwise("UNAVAILABLE").alias("status"), reason.alias("reason"))


@query("id18_point_response", """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) * CASE l_linestatus WHEN 'O' THEN 1e-9 ELSE 1e-6 END AS molar, CASE WHEN l_tax = 0 THEN NULL WHEN l_returnflag = 'R' THEN -l_discount ELSE l_discount END AS sensitivity, CASE WHEN l_tax = 0 THEN 'no_response' WHEN l_quantity <= 0 THEN 'no_dose' END AS reason FROM lineitem""")
def _(t):
    molar = F.col("l_quantity").cast("double") * F.when(F.col("l_linestatus") == "O", 1e-9).otherwise(1e-6)
    s = F.when(F.col("l_tax") != 0, F.when(F.col("l_returnflag") == "R", -F.col("l_discount")).otherwise(F.col("l_discount")))
    return t.lineitem.select("l_orderkey", "l_linenumber", molar.alias("molar"), s.alias("sensitivity"), F.when(F.col("l_tax") == 0, "no_response").when(F.col("l_quantity") <= 0, "no_dose").alias("reason"))


@query("id20_mutation_calls", """SELECT o_custkey AS patient, l_suppkey AS entity, count(*) FILTER (WHERE l_returnflag = 'R') AS n_events, bool_or(l_linestatus = 'F') AS callable,
CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') > 0 THEN 1 WHEN bool_or(l_linestatus = 'F') THEN 0 END AS mutated FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def _(t):
    n = F.count(F.when(F.col("l_returnflag") == "R", 1))
    call = F.bool_or(F.col("l_linestatus") == "F")
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("patient"), F.col("l_suppkey").alias("entity"))
    return rows.agg(n.alias("n_events"), call.alias("callable"), F.when(n > 0, 1).when(call, 0).alias("mutated"))


@query("id24_recovery", """WITH s1 AS (SELECT DISTINCT p_partkey AS lookup, p_brand AS id FROM part WHERE p_size > 30), s2 AS (SELECT p_name AS lookup, count(DISTINCT p_brand) AS n, min(p_brand) AS one FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN s1.id IS NOT NULL THEN 'step_1' WHEN s2.n > 1 THEN 'ambiguous' ELSE 'step_2' END AS status, CASE WHEN s1.id IS NOT NULL THEN s1.id WHEN s2.n = 1 THEN s2.one END AS id, CASE WHEN s1.id IS NOT NULL THEN 1 ELSE s2.n END AS candidates FROM part LEFT JOIN s1 ON p_partkey = s1.lookup LEFT JOIN s2 ON p_name = s2.lookup""")
def _(t):
    steps = [t.part.where("p_size > 30").select(F.col("p_partkey").alias("lookup"), F.col("p_brand").alias("id")), t.part.select(F.col("p_name").alias("lookup"), F.col("p_brand").alias("id"))]
    return ids.recover(t.part.select("p_partkey", "p_name"), "p_partkey", "p_name", steps).select("p_partkey", "status", F.col("id_").alias("id"), "candidates")


@query("id26_sample_match", """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_partkey AS sample, l_suppkey AS patient, l_returnflag <> 'R' AS tumour FROM lineitem), kn AS (SELECT p_partkey, p_partkey % 50 + 1 AS pat, p_size > 5 AS passed FROM part WHERE p_partkey % 3 > 0),
q AS (SELECT *, count(*) OVER (PARTITION BY sample) AS times FROM r) SELECT k, CASE WHEN patient NOT IN (SELECT pat FROM kn) THEN 'no_patient' WHEN NOT tumour THEN 'not_tumour' WHEN kn.p_partkey IS NULL THEN 'sample_mismatch' WHEN NOT passed THEN 'quality_excluded' WHEN times > 1 THEN 'several_unresolved' ELSE 'matched' END AS status FROM q LEFT JOIN kn ON sample = p_partkey""")
def _(t):
    rows = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_partkey").alias("sample"), F.col("l_suppkey").alias("patient"), (F.col("l_returnflag") != "R").alias("tumour"))
    known = t.part.where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("sample_"), (F.col("p_partkey") % 50 + 1).alias("patient_"), (F.col("p_size") > 5).alias("passed"))
    return ids.match_samples(rows, known, "k")
