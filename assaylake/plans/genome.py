"""Probe and exon maps, binding evidence from peaks, over the driver tables."""

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from assaylake.operators import genome as N
from assaylake.plans.binding import query
from assaylake.plans.shape import DAY, day

D = DAY.format("l_shipdate")
PROBE = f"""pr AS (SELECT l_orderkey * 10 + l_linenumber AS probe, l_suppkey AS chrom, {D} AS s, {D} + 2 AS e FROM lineitem),
rg AS (SELECT DISTINCT l_partkey AS entity, 'promoter' AS region, l_suppkey AS chrom, d - 10 AS s, d + 1 AS e FROM (SELECT l_partkey, l_suppkey, min({D}) AS d FROM lineitem GROUP BY ALL)
UNION SELECT DISTINCT l_partkey, 'distal', l_suppkey, {D}, {D} + 3 FROM lineitem WHERE l_quantity >= 40)"""


@query("gen04_probe_map", f"WITH {PROBE} SELECT DISTINCT probe, entity, region FROM pr JOIN rg ON pr.chrom = rg.chrom AND pr.s < rg.e AND rg.s < pr.e")
def _(t):
    """Lines are probes on a supplier's time line; a part's promoter is before its first shipment, its peaks are large shipments."""
    x = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("probe"), F.col("l_suppkey").alias("chrom"), F.col("l_partkey").alias("entity"), "l_quantity", day("l_shipdate").alias("start"))
    promoters = x.groupBy("entity", "chrom").agg(F.min("start").alias("d")).select("entity", "chrom", (F.col("d") - 10).alias("start"), (F.col("d") + 1).alias("end"))
    large = x.where("l_quantity >= 40").select("entity", "chrom", "start", (F.col("start") + 3).alias("end"), F.concat_ws("|", "probe", "entity", "chrom", "start").alias("peak"))
    return N.probe_regions(x.withColumn("end", F.col("start") + 2), promoters, large, large, 64)


@query("gen04_exon_unions", f"""WITH x AS (SELECT l_partkey AS entity, l_suppkey % 10 AS chrom, {D} AS s, {D} + 5 + CAST(l_quantity AS BIGINT) AS e FROM lineitem WHERE (l_linestatus = 'O') = (l_partkey % 2 = 0)),
i AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY entity, chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM x), g AS (SELECT *, sum(fresh) OVER (PARTITION BY entity, chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM i),
m AS (SELECT entity, chrom, island, min(s) AS s, max(e) AS e FROM g GROUP BY ALL) SELECT entity, chrom, count(*) AS exons, CAST(sum(e - s) AS BIGINT) AS bases FROM m GROUP BY ALL""")
def _(t):
    """Shipments are exons; their status is the release, even parts declare the open one."""
    x = t.lineitem.select(F.col("l_partkey").alias("entity"), F.col("l_linestatus").alias("release"), (F.col("l_suppkey") % 10).alias("chrom"), day("l_shipdate").alias("start"), (day("l_shipdate") + 5 + F.col("l_quantity").cast("long")).alias("end"))
    declared = t.part.select(F.col("p_partkey").alias("entity"), F.when(F.col("p_partkey") % 2 == 0, "O").otherwise("F").alias("release"))
    return N.exon_unions(x, declared).groupBy("entity", "chrom").agg(F.count("*").alias("exons"), F.sum(F.col("end") - F.col("start")).alias("bases"))


GRID = [(10, 1), (20, 3), (30, 5)]
BOUND = f"""gr AS (SELECT * FROM (VALUES (10, 1), (20, 3), (30, 5)) v(least_signal, least_p)),
pk AS (SELECT least_signal, least_p, p_brand AS protein, l_suppkey AS chrom, l_linenumber % 2 AS rep, {D} AS s, {D} + 4 AS e, l_quantity AS signal FROM lineitem JOIN part ON l_partkey = p_partkey JOIN gr ON l_quantity >= least_signal AND round(l_discount * 100) >= least_p),
i AS (SELECT *, CASE WHEN s <= max(e) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM pk WINDOW w AS (PARTITION BY least_signal, least_p, protein, chrom ORDER BY s, e)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY least_signal, least_p, protein, chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM i),
u AS (SELECT least_signal, least_p, protein, chrom, min(s) AS s, max(e) AS e, max(signal) AS best FROM g GROUP BY least_signal, least_p, protein, chrom, island HAVING count(DISTINCT rep) >= 2),
bl AS (SELECT DISTINCT l_suppkey AS chrom, {D} - {D} % 400 AS bs FROM lineitem),
li AS (SELECT u.*, CASE WHEN u.chrom % 2 = 0 THEN 1000 + s ELSE 5000 - (1000 + e) END AS ls, e - s AS w FROM u JOIN bl ON u.chrom = bl.chrom AND s >= bs AND e <= bs + 400),
ex AS (SELECT DISTINCT l_partkey AS entity, 'exon' AS kind, l_suppkey AS chrom, {D} + 1000 AS rs, {D} + 1005 AS re FROM lineitem), rg AS (SELECT * FROM ex UNION ALL SELECT entity, 'gene', chrom, min(rs), max(re) FROM ex GROUP BY entity, chrom),
ea AS (SELECT least_signal, least_p, protein, li.chrom, s, entity, max(best) AS best, bool_or(kind = 'exon') AS exonic FROM li JOIN rg ON li.chrom = rg.chrom AND ls < re AND rs < ls + w GROUP BY ALL),
he AS (SELECT least_signal, least_p, protein, entity, count(*) AS peaks, count(*) FILTER (exonic) AS exonic, max(best) AS best FROM ea GROUP BY ALL),
mp AS (SELECT DISTINCT p_brand AS protein, 'U:' || p_type AS protein_id FROM part), sh AS (SELECT protein, count(*) AS ids FROM mp GROUP BY 1),
br AS (SELECT least_signal, least_p, entity, protein, protein_id, peaks, exonic, best, 1.0 / ids AS weight FROM he JOIN mp USING (protein) JOIN sh USING (protein))"""


def bound(t, settings):
    """Brands are proteins on suppliers' time lines; two replicates by the line's parity; parts are entities on the other assembly."""
    d, odd, n = day("l_shipdate"), F.col("l_suppkey") % 2 == 1, t.parts("lineitem")
    strong = lambda s, p: (F.col("signal") >= s) & (F.col("log_p") >= p)
    lines = t.lineitem.select("l_partkey", F.col("l_suppkey").alias("chrom"), (F.col("l_linenumber") % 2).alias("rep"), d.alias("start"), F.col("l_quantity").alias("signal"), F.round(F.col("l_discount") * 100).alias("log_p"))
    lines = lines.where(reduce(or_, [strong(*g) for g in settings]))
    # Each setting's peaks are made where a protein's lines on a chromosome are, so that lines move once, not once a setting.
    x = lines.repartition(n, "l_partkey").join(t.part.repartition(n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    x = x.select(F.col("p_brand").alias("protein"), "chrom", "rep", "start", (F.col("start") + 4).alias("end"), "signal", "log_p").repartition(n, "protein", "chrom")
    grid = F.explode(F.array(*[F.struct(F.lit(s).alias("least_signal"), F.lit(p).alias("least_p")) for s, p in settings]))
    peaks, by = x.withColumn("g", grid).select("*", "g.*").drop("g"), ["least_signal", "least_p"]
    kept = N.reproducible_peaks(peaks, ["chrom", "protein", *by], "rep", strong(F.col("least_signal"), F.col("least_p")), 2)
    lo = d - d % 400
    blocks = t.lineitem.select(F.col("l_suppkey").alias("chrom"), lo.alias("block_start"), (lo + 400).alias("block_end"), F.concat(F.lit("T"), "l_suppkey").alias("target_chrom"), (lo + 1000).alias("target_start"), F.lit(5000).alias("target_size"), F.when(odd, "-").otherwise("+").alias("strand")).distinct()
    exons = t.lineitem.select(F.col("l_partkey").alias("entity"), F.lit("exon").alias("kind"), F.concat(F.lit("T"), "l_suppkey").alias("chrom"), (d + 1000).alias("start"), (d + 1005).alias("end"))
    # A gene of one exon is that exon: whatever meets it meets the exon.
    genes = exons.repartition(n, "entity", "chrom").groupBy("entity", F.lit("gene").alias("kind"), "chrom").agg(F.min("start").alias("start"), F.max("end").alias("end")).where(F.col("end") - F.col("start") > 5)
    mapping = t.part.select(F.col("p_brand").alias("protein"), F.concat(F.lit("U:"), "p_type").alias("protein_id"))
    return N.binding_rows(kept, blocks, exons.unionByName(genes), mapping, by, 64, parts=n), by


@query("gen05_binding", f"WITH {BOUND} SELECT entity, protein, protein_id, peaks, exonic, best, round(weight, 6) AS weight FROM br WHERE least_signal = 20")
def _(t):
    rows, _ = bound(t, [g for g in GRID if g[0] == 20])
    return rows.where("least_signal = 20").select("entity", "protein", "protein_id", "peaks", "exonic", "best", F.round("weight", 6).alias("weight"))


@query("gen05_thresholds", f"WITH {BOUND} SELECT CAST(least_signal AS INT) AS least_signal, CAST(least_p AS INT) AS least_p, count(*) AS links, count(DISTINCT entity) AS entities, count(DISTINCT protein_id) AS proteins, count(*) FILTER (exonic > 0) AS exonic_links FROM br GROUP BY ALL")
def _(t):
    return N.threshold_table(*bound(t, GRID))
