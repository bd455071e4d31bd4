"""Link candidates ranked at a budget over the driver tables."""

from pyspark.sql import functions as F

from assaylake.operators import graph as G
from assaylake.operators import links as L
from assaylake.plans.binding import query

BUDGETS = [100, 1000, 10000]
WEIGHTS = {"affinity": 1.0, "reach": 0.5, "spread": 0.5}


def scored(t):
    """Suppliers and parts: four fifths of their links are known; affinity counts known links of the supplier's nation and the
    part's brand, reach and spread those of each end. Pairs whose nation and brand have none lack affinity."""
    e = G._written(G.split_known(t.lineitem.select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct(), "a", "b", 0.8), "link-edges")
    train = e.where("split = 'train'")
    nation, brand = t.supplier.select(F.col("s_suppkey").alias("a"), "s_nationkey"), t.part.select(F.col("p_partkey").alias("b"), "p_brand")
    met = train.join(nation, "a").join(brand, "b").groupBy("s_nationkey", "p_brand").agg(F.log1p(F.count("*")).alias("affinity"))
    da, db = train.groupBy("a").agg(F.count("*").alias("da")), train.groupBy("b").agg(F.count("*").alias("db"))
    pairs = L.candidates(e, "a", "b", 100, of_a=da.join(nation, "a", "full"), of_b=db.join(brand, "b", "full")).fillna(0, ["da", "db"])
    rows = pairs.join(met, ["s_nationkey", "p_brand"], "left").select(
        "a", "b", "held_out", (F.col("da") * F.col("db")).cast("double").alias("prior"), "affinity", F.log1p("da").alias("reach"), F.log1p("db").alias("spread")
    )
    rows = G._written(rows, "link-candidates")  # moments and scores read them, and nothing is drawn twice
    return L.additive_score(rows, WEIGHTS, L.moments(rows, list(WEIGHTS))).withColumn("score", F.round("score", 6))


H = "CAST('0x' || substr(sha256({}), 1, 8) AS BIGINT)"
SCORED = f"""e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem), sp AS (SELECT a, b, {H.format("'links|' || a || '|' || b")} / 4294967296.0 < 0.8 AS tr FROM e),
dg AS (SELECT b, count(*) FILTER (tr) AS d FROM sp GROUP BY 1), tg AS (SELECT b, CASE WHEN d > 0 THEN length(bin(d)) ELSE 0 END AS s, {H.format("'negatives|' || b")} AS h FROM dg),
nb AS (SELECT b, s, row_number() OVER (PARTITION BY s ORDER BY h % 64, h, b) - 1 AS place, count(*) OVER (PARTITION BY s) AS size FROM tg), st AS (SELECT DISTINCT s, size FROM nb),
dr AS (SELECT a, s, {H.format("'negatives|' || a || '|' || s || '|' || i")} % size AS place FROM (SELECT DISTINCT a FROM e) CROSS JOIN st CROSS JOIN (SELECT unnest(range(1, 101)) AS i)),
u AS ((SELECT a, b FROM dr JOIN nb USING (s, place) UNION SELECT a, b FROM sp WHERE NOT tr) EXCEPT SELECT a, b FROM sp WHERE tr),
tn AS (SELECT a, b, s_nationkey AS n, p_brand AS g FROM sp LEFT JOIN supplier ON a = s_suppkey LEFT JOIN part ON b = p_partkey WHERE tr),
af AS (SELECT n, g, ln(1 + count(*)) AS affinity FROM tn GROUP BY ALL), da AS (SELECT a, count(*) AS da FROM tn GROUP BY 1), db AS (SELECT b, count(*) AS db FROM tn GROUP BY 1),
f AS (SELECT u.a, u.b, sp.a IS NOT NULL AS held_out, CAST(coalesce(da, 0) * coalesce(db, 0) AS DOUBLE) AS prior, affinity, ln(1 + coalesce(da, 0)) AS reach, ln(1 + coalesce(db, 0)) AS spread FROM u LEFT JOIN sp ON u.a = sp.a AND u.b = sp.b
LEFT JOIN supplier ON u.a = s_suppkey LEFT JOIN part ON u.b = p_partkey LEFT JOIN af ON n = s_nationkey AND g = p_brand LEFT JOIN da ON da.a = u.a LEFT JOIN db ON db.b = u.b),
mo AS (SELECT avg(affinity) AS ma, stddev_samp(affinity) AS sa, avg(reach) AS mr, stddev_samp(reach) AS sr, avg(spread) AS ms, stddev_samp(spread) AS ss FROM f),
sc AS (SELECT a, b, held_out, prior, CASE WHEN affinity IS NULL THEN 'affinity' ELSE '' END AS missing, round(coalesce((affinity - ma) / sa, 0) + (reach - mr) / sr * 0.5 + (spread - ms) / ss * 0.5, 6) AS score FROM f CROSS JOIN mo)"""


@query("gr09_ranked_links", f"WITH {SCORED} SELECT a, b, held_out, missing, score FROM sc ORDER BY score DESC, a, b LIMIT 1000")
def _(t):
    return scored(t).orderBy(F.desc("score"), "a", "b").limit(1000).select("a", "b", "held_out", "missing", "score")


@query("gr09_budget_metrics", f"""WITH {SCORED}, v AS (SELECT 'additive' AS model, score, held_out FROM sc UNION ALL SELECT 'prior', prior, held_out FROM sc), bl AS (SELECT model, score, count(*) AS n, count(*) FILTER (held_out) AS p FROM v GROUP BY ALL),
r AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp FROM bl WINDOW w AS (PARTITION BY model ORDER BY score DESC)), k AS (SELECT unnest([100, 1000, 10000]) AS budget)
SELECT model, CAST(budget AS BIGINT) AS budget, CAST(sum(n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS positives, round(sum(p) / sum(n), 9) AS prevalence, round(sum(p * least(greatest(budget - (cn - n), 0), n) / n) / least(budget, sum(n)), 6) AS precision,
round(sum(p * least(greatest(budget - (cn - n), 0), n) / n) / sum(p), 6) AS recall, round(sum(p * cp / cn) / sum(p), 6) AS average_precision FROM r CROSS JOIN k GROUP BY model, budget""")
def _(t):
    long = scored(t).withColumnRenamed("score", "additive").unpivot(["held_out"], ["additive", "prior"], "model", "score")
    found = L.budget_metrics(long, ["model"], "score", "held_out", BUDGETS)
    return found.select("model", "budget", "n", "positives", F.round("prevalence", 9).alias("prevalence"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "average_precision")])
