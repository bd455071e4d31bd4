"""Validated, universe-preserving, interval and as-of joins; set operations on keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How much wider each coarser bin of binned() is.
STEP = 8


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def validated(left: DataFrame, right: DataFrame, key: list[str], how: str = "left", one_to_one: bool = False) -> DataFrame:
    """Many-to-one (or one-to-one) join; ValueError if a key is repeated on a side where it must not be."""
    for side, df in (("right", right), ("left", left)):
        if (side == "right" or one_to_one) and not repeated_keys(df, key).isEmpty():
            raise ValueError(f"repeated key on the {side} side: {key}")
    return left.join(right, key, how)


def merge_components(parts: list[tuple[DataFrame, list[str]]], key: list[str], fill: dict, tasks: int | None = None) -> DataFrame:
    """Outer merge of components: those with the whole key are stacked and summed up in one shuffle; those with a coarser key
    are joined to the result. fill: column to the value of a missing one; repeated keys give their largest values; tasks: how many
    the rows are dealt to."""
    whole = [df for df, k in parts if set(k) == set(key)]
    values = lambda df, k: [c for c in df.columns if c not in k]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), whole)
    names = [c for df in whole for c in values(df, key)]
    dealt = lambda df, by: df.repartition(tasks, *by) if tasks else df
    out = dealt(stacked, key).groupBy(*key).agg(*[F.max(c).alias(c) for c in names])
    for df, k in parts:
        if set(k) != set(key):
            out = dealt(out, k).join(df, k, "left")
    return out.fillna(fill)


def universe(rows: DataFrame, declared: DataFrame, key: list[str], value: str, reason: str) -> DataFrame:
    """Every declared key, with null and a reason where rows have none."""
    out = declared.join(rows, key, "left")
    return out.withColumn("reason", F.when(F.col(value).isNull(), reason))


def key_drift(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """side, n: keys on one side only; a single pass over both."""
    both = left.select(*key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(right.select(*key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    seen = both.groupBy(*key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return seen.agg(F.coalesce(F.sum(F.when(F.col("r") == 0, 1).otherwise(0)), F.lit(0)).alias("left_only"), F.coalesce(F.sum(F.when(F.col("l") == 0, 1).otherwise(0)), F.lit(0)).alias("right_only"), F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("both"))


def binned(left: DataFrame, right: DataFrame, by: list[str], l_span: tuple[str, str], r_span: tuple[str, str], width: int, within: int = 0, coarser: int = 0, parts: int | None = None) -> DataFrame:
    """Pairs of half-open intervals that overlap, or lie within a distance: equi-join on bins. A pair meets in several bins, and
    is taken in the first of them only, so nothing has to be deduplicated.

    coarser: this many more widths, each STEP times the one before. A pair meets in bins of the least width that holds the length
    of its longer interval, so a long interval is not cut into many rows; short ones have rows for each width a longer one may have.

    parts: how many tasks both sides are dealt to."""
    (ls, le), (rs, re) = l_span, r_span
    start, end, ways = F.col(ls) - within, F.col(le) + within, 2 * (coarser + 1)
    bin_ = lambda c, k: F.floor(c / (width * STEP**k)).cast("long")

    def places(s, e, even, odd):
        """A place is a bin and a turn: 2 k where the left interval is the longer one and has width k, 2 k + 1 where the right is."""
        own, out = F.lit(coarser), []
        for k in reversed(range(coarser)):
            own = F.when(e - s <= width * STEP**k, F.lit(k)).otherwise(own)
        for turn in range(ways):
            k = turn // 2
            if turn != 1:  # nothing is longer than an interval of the least width and has it
                low = bin_(s, k)
                out.append(F.when((odd if turn % 2 else even)(own, k), F.sequence(low * ways + turn, F.greatest(low, bin_(e - 1, k)) * ways + turn, F.lit(ways).cast("long"))).otherwise(F.array().cast("array<bigint>")))
        return F.when((s + e).isNotNull(), F.concat(*out))

    a = left.withColumn("place_", F.explode(places(start, end, lambda own, k: own == k, lambda own, k: own < k)))
    b = right.withColumn("place_", F.explode(places(F.col(rs), F.col(re), lambda own, k: own <= k, lambda own, k: own == k)))
    dealt = lambda df: df.repartition(parts, *by, "place_") if parts else df
    pairs = dealt(a).join(dealt(b), [*by, "place_"]).where((start < F.col(re)) & (F.col(rs) < end))
    turn = F.pmod("place_", F.lit(ways))
    first = F.greatest(bin_(start, coarser), bin_(F.col(rs), coarser))
    for k in reversed(range(coarser)):
        first = F.when(turn < 2 * k + 2, F.greatest(bin_(start, k), bin_(F.col(rs), k))).otherwise(first)
    return pairs.where(F.col("place_") == first * ways + turn).drop("place_")


def lift(points: DataFrame, blocks: DataFrame, ident: str, chrom: str, start: str, end: str, width: int = 1 << 16) -> DataFrame:
    """1-based closed intervals through aligned 0-based half-open blocks (chrom, block_start, block_end, target_chrom,
    target_start, target_size, strand). Adds lifted_chrom, lifted_start, lifted_end, status; nulls unless one block holds all."""
    p = points.withColumns({"s_": F.col(start) - 1, "e_": F.col(end)})
    # The block that holds an interval holds its first base: only blocks are cut into bins.
    bin_ = lambda c: F.floor(c / width).cast("long")
    at = p.select(ident, chrom, "s_", "e_", bin_(F.col("s_")).alias("bin_"))
    cut = blocks.where("block_start < block_end").withColumn("bin_", F.explode(F.sequence(bin_(F.col("block_start")), bin_(F.col("block_end") - 1))))
    met = at.join(cut, [chrom, "bin_"]).where("s_ >= block_start and e_ <= block_end and s_ < block_end and block_start < e_")
    offset = F.col("s_") - F.col("block_start")
    plus = F.col("strand") == "+"
    at = F.when(plus, F.col("target_start") + offset).otherwise(F.col("target_size") - (F.col("target_start") + offset + F.col("e_") - F.col("s_")))
    lifted = met.select(ident, "target_chrom", at.alias("ls"), (at + F.col("e_") - F.col("s_")).alias("le"))
    one = lifted.groupBy(ident).agg(F.count("*").alias("n"), F.min(F.struct("target_chrom", "ls", "le")).alias("t"))
    out = points.join(one, ident, "left")
    status = F.when(F.col("n").isNull(), "no_complete_aligned_block").when(F.col("n") > 1, "ambiguous_complete_block").otherwise("lifted")
    ok = F.col("n") == 1
    return out.select(*points.columns, F.when(ok, F.col("t.target_chrom")).alias("lifted_chrom"), F.when(ok, F.col("t.ls") + 1).alias("lifted_start"), F.when(ok, F.col("t.le")).alias("lifted_end"), status.alias("status"))


def as_of(points: DataFrame, segments: DataFrame, by: list[str], at: str, start: str, end: str, values: list[str]) -> DataFrame:
    """Of each point the segment with the greatest start <= it, if it ends at or after it: one sort of both, no pairs. Segments
    with equal starts: the last by end and values."""
    s = segments.select(*by, F.col(start).alias("pos_"), F.lit(0).alias("kind_"), F.struct(F.col(end).alias("end_"), *values).alias("seg_"))
    keep = F.struct(*[F.col(c) for c in points.columns])
    p = points.select(*by, F.col(at).alias("pos_"), F.lit(1).alias("kind_"), keep.alias("row_"))
    both = s.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("pos_", "kind_", "seg_").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("seg_", F.last("seg_", ignorenulls=True).over(w)).where("kind_ = 1")
    inside = F.col("seg_.end_") >= F.col("pos_")
    return seen.select("row_.*", *[F.when(inside, F.col(f"seg_.{v}")).alias(v) for v in values])


def route_events(events: DataFrame, membership: DataFrame, event: str, partner: str, target: str, member: str) -> DataFrame:
    """event, target, route: direct where the partner is a target itself, else via a member; direct wins."""
    targets = membership.select(target).distinct()
    direct = events.join(targets, F.col(partner) == F.col(target)).select(event, target, F.lit("direct").alias("route"))
    via = events.join(membership, F.col(partner) == F.col(member)).select(event, target, F.lit("member").alias("route"))
    return direct.unionAll(via).groupBy(event, target).agg(F.min("route").alias("route"))


def attach_events(candidates: DataFrame, events: DataFrame, pair: list[str], cohort: str) -> DataFrame:
    """Cohort events meet their own candidates, events without a cohort all candidates of the pair."""
    local = candidates.join(events.where(F.col(cohort).isNotNull()), [*pair, cohort]).withColumn("scope", F.lit("local"))
    spread = candidates.join(events.where(F.col(cohort).isNull()).drop(cohort), pair).withColumn("scope", F.lit("global"))
    return local.unionByName(spread)


def expand_mask(df: DataFrame, mask: str, k: int, out: str = "fold") -> DataFrame:
    """One row for each set bit of the first k."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(F.expr(f"({mask} & shiftleft(1, {out})) <> 0"))


def two_arms(a: DataFrame, b: DataFrame, key: list[str], names: tuple[str, str]) -> DataFrame:
    """All keys of two arms with in_ flags."""
    both = a.select(*key).distinct().withColumns({f"in_{names[0]}": F.lit(True), f"in_{names[1]}": F.lit(False)}).unionByName(b.select(*key).distinct().withColumns({f"in_{names[0]}": F.lit(False), f"in_{names[1]}": F.lit(True)}))
    return both.groupBy(*key).agg(*[F.bool_or(f"in_{n}").alias(f"in_{n}") for n in names])
