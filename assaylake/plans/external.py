"""External evidence of four shapes over the driver tables."""

from pyspark.sql import functions as F

from assaylake.plans.binding import query
from assaylake.sources import external as X

CURATED = X.Database("curated", {"record": ["row id"], "entity_raw": ["name"], "context_raw": ["cancer type"], "method_raw": ["methods"], "pmid_raw": ["pubmed id"], "direction_raw": ["regulated"]}, ("literature", "experimental"))
MIXED = X.Database("mixed", {"record": ["id"], "entity_raw": ["RNA Symbol"], "context_raw": ["Disease Name"], "method_raw": ["Validated//Prediction Method"], "pmid_raw": ["PubMed_ID"], "direction_raw": ["Dysfunction Pattern"]},
                   ("unclear", "other"), [("predict|model", "computational", "predicted"), ("qpcr|blot|knock", "assay", "experimental")])
PREDICTED = X.Database("predicted", {"record": ["RDID"], "entity_raw": ["RNA_symbol"], "context_raw": ["disease_name"], "method_raw": ["method_name"]}, ("computational", "predicted"))
SCREEN = X.Database("screen", {"record": ["row"], "entity_raw": ["target"], "context_raw": ["cell"], "direction_raw": ["effect"]}, ("screen", "experimental"), suffix="(?i)(_x|up)$")


def sources(t):
    r = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_suppkey")
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.concat_ws(" ", "p_name", "p_size")
    up = F.when(F.col("l_quantity") > 40, "Up-regulated").when(F.col("l_quantity") > 10, "down-regulation")
    curated = x.where("l_returnflag = 'R'").select(r.alias("Row-ID"), name.alias("Name"), F.concat(F.lit("cancer of "), "n_name").alias("Cancer type"), F.lit("RT-qPCR").alias("methods"), F.concat(F.lit("PMID: "), F.col("l_orderkey") + 1).alias("PubMed ID"), up.alias("regulated"))
    how = F.when(F.col("l_linenumber") % 3 == 0, "Prediction by model").when(F.col("l_linenumber") % 3 == 1, "Western blot").otherwise("text")
    mixed = x.where("l_returnflag = 'N' and l_linestatus = 'O'").select(r.alias("ID"), F.upper(name).alias("RNA symbol"), "n_name", F.concat_ws(" and ", F.lower("n_name"), F.when(F.col("l_linenumber") == 2, "japan")).alias("disease name"), how.alias("Validated // Prediction method"), (F.col("l_orderkey") + 1).cast("double").alias("PubMed id"), F.lit("").alias("dysfunction pattern"))
    predicted = x.where("l_returnflag = 'N' and l_linestatus <> 'O'").select(r.alias("RDID"), F.col("p_name").alias("RNA_Symbol"), F.col("n_name").alias("Disease_Name"), F.lit(None).cast("string").alias("method_name"))
    screen = x.where("l_returnflag = 'A'").select(r.alias("row"), F.concat(name, F.when(F.col("l_linenumber") > 3, "_X").otherwise("")).alias("target"), F.when(F.col("l_linenumber") > 1, F.col("n_name")).alias("cell"), F.lit("reduced, low growth").alias("effect"))
    return [(curated, CURATED), (mixed, MIXED), (predicted, PREDICTED), (screen, SCREEN)]


SHOWN = ["database", "record", "entity", "entity_status", "cohort", "context_status", "method_class", "kind", "direction", "pmid", "trained_pmid", "role", "validation_eligible", "consistency_eligible"]


@query("src14_external", """WITH x AS (SELECT *, concat_ws(':', l_orderkey, l_linenumber, l_suppkey) AS record, p_name || ' ' || p_size AS name, l_quantity AS q, l_linenumber AS ln FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
r AS (SELECT 'curated' AS database, record, upper(name) AS k, NULL AS k2, lower(n_name) AS ctx, 'literature' AS method_class, 'experimental' AS kind, CASE WHEN q > 40 THEN 'up' WHEN q > 10 THEN 'down' ELSE 'unknown' END AS direction, l_orderkey + 1 AS pmid FROM x WHERE l_returnflag = 'R'
UNION ALL SELECT 'mixed', record, upper(name), NULL, CASE WHEN ln = 2 THEN concat_ws(' ', lower(n_name), 'japan') ELSE lower(n_name) END, CASE ln % 3 WHEN 0 THEN 'computational' WHEN 1 THEN 'assay' ELSE 'unclear' END, CASE ln % 3 WHEN 0 THEN 'predicted' WHEN 1 THEN 'experimental' ELSE 'other' END, 'unknown', l_orderkey + 1 FROM x WHERE l_returnflag = 'N' AND l_linestatus = 'O'
UNION ALL SELECT 'predicted', record, upper(p_name), NULL, lower(n_name), 'computational', 'predicted', 'unknown', NULL FROM x WHERE l_returnflag = 'N' AND l_linestatus <> 'O'
UNION ALL SELECT 'screen', record, upper(name) || CASE WHEN ln > 3 THEN '_X' ELSE '' END, upper(name), CASE WHEN ln > 1 THEN lower(n_name) END, 'screen', 'experimental', 'down', NULL FROM x WHERE l_returnflag = 'A'),
ix AS (SELECT upper(p_name || ' ' || p_size) AS alias, count(DISTINCT p_partkey) AS n, min(p_partkey) AS one FROM part GROUP BY 1), al AS (SELECT trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS alias, n_regionkey AS cohort FROM nation),
h AS (SELECT ctx, count(DISTINCT cohort) AS cn, min(cohort) AS c1 FROM (SELECT DISTINCT ctx FROM r) JOIN al ON contains(' ' || regexp_replace(ctx, '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || alias || ' ') GROUP BY 1), tr AS (SELECT o_orderkey + 1 AS pmid FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
m AS (SELECT database, record, CASE WHEN coalesce(a.n, b.n) = 1 THEN coalesce(a.one, b.one) END AS entity, CASE WHEN coalesce(a.n, b.n) IS NULL THEN 'unmapped' WHEN coalesce(a.n, b.n) > 1 THEN 'ambiguous' WHEN a.n IS NULL THEN 'mapped_short' ELSE 'mapped' END AS entity_status,
CASE WHEN cn = 1 THEN c1 END AS cohort, CASE WHEN r.ctx IS NULL THEN 'global' WHEN cn IS NULL THEN 'unmapped' WHEN cn = 1 THEN 'exact' ELSE 'ambiguous' END AS context_status, method_class, kind, direction, r.pmid AS pmid, tr.pmid IS NOT NULL AS trained_pmid
FROM r LEFT JOIN ix a ON k = a.alias LEFT JOIN ix b ON k2 = b.alias LEFT JOIN h ON r.ctx = h.ctx LEFT JOIN tr ON r.pmid = tr.pmid)
SELECT *, CASE kind WHEN 'predicted' THEN 'consistency' WHEN 'experimental' THEN 'validation' ELSE 'context' END AS role, entity IS NOT NULL AND cohort IS NOT NULL AND kind = 'experimental' AND NOT trained_pmid AS validation_eligible, entity IS NOT NULL AND cohort IS NOT NULL AND kind = 'predicted' AS consistency_eligible FROM m""")
def _(t):
    """Line items as records of four databases by their flags; a part's name and size is an alias, nations are aliases of regions."""
    names = t.part.select(F.concat_ws(" ", "p_name", "p_size").alias("alias"), F.col("p_partkey").alias("entity"))
    cohorts = t.nation.select(F.lower("n_name").alias("alias"), F.col("n_regionkey").alias("cohort"))
    trained = t.orders.where("o_orderstatus = 'F'").select((F.col("o_orderkey") + 1).alias("pmid"))
    return X.mapped(X.stacked(sources(t)), names, cohorts, trained).select(*SHOWN)
