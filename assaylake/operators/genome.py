"""Segments, regions and sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.operators.graph import _written
from assaylake.operators.joins import binned, lift, validated
from assaylake.operators.windows import islands, merged_intervals


def segment_calls(mapped: DataFrame, by: list[str], value: str, gain: float, loss: float) -> DataFrame:
    """Unsigned burden, event and callability, signed mean and gain / loss flags of the segments mapped to an entity."""
    v = F.col(value)
    return mapped.groupBy(*by).agg(
        F.avg(F.abs(v)).alias("burden"), F.coalesce(F.bool_or((v >= gain) | (v <= loss)), F.lit(False)).alias("event"), (F.count(v) > 0).alias("callable"), F.avg(v).alias("signed_mean"),
        F.coalesce(F.bool_or(v >= gain), F.lit(False)).alias("gain"), F.coalesce(F.bool_or(v <= loss), F.lit(False)).alias("loss"),
    )


def calls(long: DataFrame, entity: str, patient: str, value: str, least: int) -> DataFrame:
    """Non-zero integer calls of entities with `least` patients or more; how many were zero is kept beside them."""
    n = long.groupBy(entity).agg(F.count_distinct(patient).alias("patients"), F.count_if(F.col(value) == 0).alias("zeros"))
    return long.where(F.col(value) != 0).join(n.where(F.col("patients") >= least), entity)


def kmers(sequences: DataFrame, key: str, sequence: str, k: int) -> DataFrame:
    """key, kmer, n: counts of k-mers of the letters a to z, lower-cased; others break a k-mer."""
    s = F.lower(sequence)
    rows = sequences.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(sequence) - k + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(k)))).alias("kmer"))
    return rows.where(F.col("kmer").rlike(f"^[a-z]{{{k}}}$")).groupBy(key, "kmer").agg(F.count("*").alias("n"))


def preference(counts: DataFrame, profile: DataFrame, key: str) -> DataFrame:
    """Count-weighted mean log2 enrichment of a sequence's k-mers, and how many of them have one."""
    met = counts.join(profile, "kmer", "left")
    return met.groupBy(key).agg((F.sum(F.col("n") * F.col("log2_enrichment")) / F.sum(F.when(F.col("log2_enrichment").isNotNull(), F.col("n")))).alias("score"), F.sum("n").alias("kmers"), F.sum(F.when(F.col("log2_enrichment").isNotNull(), F.col("n")).otherwise(0)).alias("known"))


def probe_regions(probes: DataFrame, promoters: DataFrame, links: DataFrame, peaks: DataFrame, width: int) -> DataFrame:
    """probe, entity, region: promoter where a probe meets the entity's promoter, distal where it meets a peak linked to it; both if both.

    probes(probe, chrom, start, end), promoters(entity, chrom, start, end), links(entity, peak), peaks(peak, chrom, start, end), all
    half-open. Repeated rows count once; a link to a peak that isn't there, or a peak with two places, is a ValueError.

    No row is paired twice, so the pairs, many more than the rows, are not shuffled to be made distinct: a probe with one place is
    one row, and of an entity's regions of a kind only the first that a probe meets pairs with it. Only pairs of probes with several
    places are made distinct.
    """
    at = ("chrom", "start", "end")
    one = lambda c: (F.min(c).eqNullSafe(F.max(c))) & F.count(c).isin(F.lit(0), F.count("*"))
    spots = peaks.groupBy("peak").agg(*[F.min(c).alias(c) for c in at], reduce(lambda a, b: a & b, map(one, at)).alias("one_"))
    linked = _written(links.select("entity", "peak", F.lit(True).alias("linked_")).join(spots, "peak", "full").drop("peak"), "probe-peaks")
    if not linked.where("one_ is null or not one_").isEmpty():
        raise ValueError("links name peaks that are not in the peak set, or peaks have two places")
    place = lambda df, distal: df.select("chrom", "entity", F.lit(distal).alias("distal_"), F.col("start").alias("rs_"), F.col("end").alias("re_")).where("rs_ < re_")
    before = Window.partitionBy("entity", "chrom", "distal_").orderBy("rs_", "re_").rowsBetween(Window.unboundedPreceding, -1)
    regions = place(promoters, False).unionByName(place(linked.where("linked_"), True)).withColumn("reach_", F.max("re_").over(before)).where("reach_ is null or reach_ < re_")

    def met(rows):
        pairs = binned(rows, regions, ["chrom"], ("start", "end"), ("rs_", "re_"), width).where("reach_ is null or reach_ <= start")
        return pairs.select("probe", "entity", F.when(F.col("distal_"), "distal").otherwise("promoter").alias("region"))

    rows = probes.select("probe", *at).dropna(subset=list(at)).repartition("probe").distinct()
    rows = _written(rows.withColumn("several_", F.count("*").over(Window.partitionBy("probe")) > 1), "probe-places")
    out, several = met(rows.where("not several_")), rows.where("several_")
    return out if several.isEmpty() else out.unionByName(met(several).distinct())


def exon_unions(exons: DataFrame, declared: DataFrame) -> DataFrame:
    """entity, chrom, start, end: exons(entity, release, chrom, start, end) of the release each entity declares, overlapping or
    touching ones united, so that no base of two transcripts counts twice."""
    own = validated(exons, declared.select("entity", "release"), ["entity", "release"], "inner")
    return merged_intervals(own.select("entity", "chrom", "start", "end"), ["entity", "chrom"], "start", "end")


def reproducible_peaks(peaks: DataFrame, by: list[str], replicate: str, passed, replicates: int, width: int | None = None) -> DataFrame:
    """by, start, end, peaks, best: unions of the peaks that pass, kept where `replicates` different replicates have part in one.
    by has chrom; peaks have start, end and signal; `passed` is a condition on a peak's row, null counts as not passed. Peaks stay
    in their union's task: rows already dealt by columns of `by` are not shuffled. width has no effect any more."""
    good = peaks.where(passed).dropna(subset=[*by, "start", "end"])
    placed, union = islands(good, by, "start", "end"), Window.partitionBy(*by, "island_")
    if replicates > 1:  # a peak alone in its union leaves before unions are sorted and counted
        near = Window.partitionBy(*by).orderBy("start", "end")
        placed = placed.withColumns({"last_": F.lag("island_").over(near), "next_": F.lead("island_").over(near)}).where("island_ = last_ or island_ = next_")
    placed = placed.withColumns({"us_": F.min("start").over(union), "ue_": F.max("end").over(union)})
    found = placed.where("start < ue_ and us_ < end").groupBy(*by, "us_", "ue_").agg(F.count("*").alias("peaks"), F.max("signal").alias("best"), F.count_distinct(replicate).alias("r_"))
    return found.where(F.col("r_") >= replicates).drop("r_").withColumnsRenamed({"us_": "start", "ue_": "end"})


def binding_rows(peaks: DataFrame, blocks: DataFrame, regions: DataFrame, mapping: DataFrame, by: list[str], width: int, experimental: float = 1.0, parts: int | None = None) -> DataFrame:
    """by, entity, protein_id, peaks, exonic, best, weight: peaks lifted to the annotation's assembly and met with the entities' regions.

    peaks: by, protein, chrom, start, end, best (as `reproducible_peaks` gives). regions: entity, kind (exon or gene), chrom, start,
    end on the target. mapping: protein, protein_id; one protein's ids share the weight. Peaks without one whole aligned block,
    and proteins without an id, give no row. An exon that lies in a gene counts as exonic once. parts: how many tasks the regions
    are dealt to; the peaks, which the lift reads twice, are written once.
    """
    keyed = _written(peaks, "binding-peaks").withColumn("peak_", F.struct(*by, "protein", "chrom", "start", "end")).withColumn("first_", F.col("start") + 1)
    lifted = lift(keyed, blocks, "peak_", "chrom", "first_", "end", width).where("status = 'lifted'")
    on = lifted.select(*by, "protein", "peak_", "best", F.col("lifted_chrom").alias("on_"), (F.col("lifted_start") - 1).alias("ls_"), F.col("lifted_end").alias("le_"))
    at = regions.select("entity", "kind", F.col("chrom").alias("on_"), F.col("start").alias("rs_"), F.col("end").alias("re_"))
    met = binned(on, at, ["on_"], ("ls_", "le_"), ("rs_", "re_"), width, parts=parts)
    each = met.groupBy(*by, "protein", "entity", "peak_").agg(F.max("best").alias("best"), F.bool_or(F.col("kind") == "exon").alias("exon_"))
    held = each.groupBy(*by, "protein", "entity").agg(F.count("*").alias("peaks"), F.count_if("exon_").alias("exonic"), F.max("best").alias("best"))
    ids = mapping.select("protein", "protein_id").where("protein_id is not null").distinct()
    share = ids.groupBy("protein").agg(F.count("*").alias("ids_"))
    return held.join(ids, "protein").join(share, "protein").select(*by, "entity", "protein", "protein_id", "peaks", "exonic", "best", (F.lit(experimental) / F.col("ids_")).alias("weight"))


def threshold_table(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, links, entities, proteins, exonic_links: how many binding rows each setting of the thresholds leaves."""
    return rows.groupBy(*by).agg(F.count("*").alias("links"), F.count_distinct("entity").alias("entities"), F.count_distinct("protein_id").alias("proteins"), F.count_if(F.col("exonic") > 0).alias("exonic_links"))
