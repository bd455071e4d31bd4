"""Pairs screened by count-sketches of rank vectors, then measured exactly within each source.

Within a source (a donor) every entity has a vector of unit ranks over the source's samples; samples without a row count as
`fill`. A count-sketch adds each rank, times a sign, to one of `width` buckets; sign and bucket come from a hash of source and sample, the
same for entities and targets, so the product of two sketches is close to the sum of their correlations over sources. For each
entity the `proposed` targets of largest absolute product are kept: blocks of sketches meet once, and a block hands on its best
per entity only. These pairs, and no others, get their exact correlation in each source. The exact way without the screen is
`blocks.associate` by source and then `combined`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions.scalars import t_two_sided
from assaylake.operators.blocks import ranks, unit
from assaylake.operators.nulls import _mixed

#: Sketches in a block.
ROWS = 2048


def _vectors(values: DataFrame, samples: DataFrame, source: str, sample: str, name: str, value: str, fill: float, width: int, seed: int) -> DataFrame:
    """source, name, v (unit ranks), s (their sketch); constant vectors are left out."""
    place = samples.select(source, sample).distinct().withColumn("at_", F.row_number().over(Window.partitionBy(source).orderBy(sample)) - 1)
    sizes = place.groupBy(source).agg(F.count("*").alias("n_"))
    cells = values.join(place, [source, sample]).groupBy(source, name).agg(F.collect_list(F.struct("at_", F.col(value).cast("double").alias("v_"))).alias("cells_"))
    rows = cells.join(sizes, source).select(source, name, "cells_", "n_")
    kinds = [rows.schema[c].dataType.simpleString() for c in (source, name)]

    def sketched(batches):
        known: dict = {}
        for b in batches:
            cells, at = b.column(2).values, b.column(2).offsets.to_numpy()
            place, number = cells.field(0).to_numpy(zero_copy_only=False), cells.field(1).to_numpy(zero_copy_only=False)
            kept, vectors, sketches = [], [], []
            for i, (who, n) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist())):
                own = slice(at[i], at[i + 1])
                v = np.full((n, 1), float(fill))
                v[place[own], 0] = number[own]
                v = unit(ranks(v), np.full((n, 1), n**-0.5))[:, 0]
                if not np.isfinite(v).all():
                    continue
                if who not in known:
                    if len(known) > 1000:
                        known.clear()
                    with np.errstate(over="ignore"):
                        h = _mixed(np.arange(n, dtype=np.uint64) ^ np.uint64(xxhash.xxh64_intdigest(str(who), seed)))
                    known[who] = (h >> np.uint64(1)) % np.uint64(width), 1.0 - 2.0 * (h & np.uint64(1))
                bucket, sign = known[who]
                kept.append(i), vectors.append(v), sketches.append(np.bincount(bucket.astype(np.int64), v * sign, width))
            taken = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(taken), b.column(1).take(taken), pa.array(vectors, pa.list_(pa.float64())), pa.array(sketches, pa.list_(pa.float64()))], [source, name, "v", "s"])

    return rows.mapInArrow(sketched, f"`{source}` {kinds[0]}, `{name}` {kinds[1]}, v array<double>, s array<double>")


def _sums(vectors: DataFrame, name: str, sources: int) -> DataFrame:
    """name, k, s: a number of sources and the sum of sketches of every name that has `sources` of them."""
    parts = vectors.select(name, F.posexplode("s").alias("at", "x")).groupBy(name, "at").agg(F.sum("x").alias("x"), F.count("*").alias("k")).where(F.col("k") >= sources)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda z: z["x"])
    return parts.groupBy(name).agg(listed.alias("s"))


def proposed(x: DataFrame, y: DataFrame, entity: str, target: str, most: int) -> DataFrame:
    """entity, target: for each entity's sketch in x (entity, s) the targets of y (target, s) of the largest absolute products."""

    def packed(df, name, tag):
        def pack(batches):
            names, rows, kind = [], [], None
            for b in batches:
                kind = b.column(0).type
                names += b.column(0).to_pylist()
                rows += [r.values.to_numpy() for r in b.column(1)]
                while len(names) >= ROWS:
                    yield block(names[:ROWS], rows[:ROWS], kind)
                    names, rows = names[ROWS:], rows[ROWS:]
            if names:
                yield block(names, rows, kind)

        def block(names, rows, kind):
            return pa.RecordBatch.from_arrays([pa.array([names], pa.list_(kind)), pa.array([np.stack(rows).tobytes()], pa.binary())], [f"{tag}names", f"{tag}rows"])

        kind = df.schema[name].dataType.simpleString()
        return df.select(name, "s").mapInArrow(pack, f"{tag}names array<{kind}>, {tag}rows binary").withColumn("all_", F.lit(1))

    kinds = [d.schema[n].dataType.simpleString() for d, n in ((x, entity), (y, target))]

    def best(batches):
        for b in batches:
            for i in range(b.num_rows):
                who, whom = b.column(0)[i].values, b.column(1)[i].values
                m = np.abs(np.frombuffer(b.column(2)[i].as_py()).reshape(len(who), -1) @ np.frombuffer(b.column(3)[i].as_py()).reshape(len(whom), -1).T)
                k = min(most, len(whom))
                pick = np.argpartition(-m, k - 1, axis=1)[:, :k]
                row = np.repeat(np.arange(len(who)), k)
                yield pa.RecordBatch.from_arrays([who.take(pa.array(row)), whom.take(pa.array(pick.ravel())), pa.array(np.take_along_axis(m, pick, 1).ravel())], [entity, target, "product"])

    met = packed(x, entity, "x").join(packed(y, target, "y"), "all_").select("xnames", "ynames", "xrows", "yrows")
    found = met.mapInArrow(best, f"`{entity}` {kinds[0]}, `{target}` {kinds[1]}, product double")
    turn = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("product"), target))
    return found.withColumn("turn_", turn).where(F.col("turn_") <= most).select(entity, target)


def combined(effects: DataFrame, entity: str, target: str, *, sources: int = 3, least: float = 0.1, top: int = 25) -> DataFrame:
    """effects: entity, target, rho, a row a source. The mean, the unweighted Fisher mean, how many sources agree on the sign, and
    the p of a t test that the mean z is zero; the `top` pairs of an entity by absolute Fisher mean, agreement, target."""
    z = F.atanh(F.least(F.greatest("rho", F.lit(-0.999999)), F.lit(0.999999)))
    up = F.count_if(F.col("rho") > 0)
    g = effects.where("rho is not null").groupBy(entity, target).agg(
        F.count("*").alias("sources"), F.avg("rho").alias("mean_rho"), F.tanh(F.avg(z)).alias("meta_rho"), (F.greatest(up, F.count("*") - up) / F.count("*")).alias("agreement"), F.avg(z).alias("z_"), F.stddev_samp(z).alias("sd_")
    )
    g = g.where((F.col("sources") >= sources) & (F.abs("meta_rho") >= least))
    t = F.col("z_") / (F.col("sd_") / F.sqrt("sources"))
    p = F.when(F.col("sources") < 2, F.lit(None).cast("double")).when(F.col("sd_") <= 1e-12, 0.0).otherwise(t_two_sided(t, F.col("sources") - 1))
    turn = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc(F.round(F.abs("meta_rho"), 9)), F.desc(F.round("agreement", 9)), target))
    return g.withColumns({"p": p, "rank": turn}).where(F.col("rank") <= top).drop("z_", "sd_")


def screened_pairs(x: DataFrame, y: DataFrame, samples: DataFrame, source: str, sample: str, xs: tuple[str, str], ys: tuple[str, str], *, fill: float = 0.0, width: int = 128, top: int = 25, oversample: int = 4, sources: int = 3, least: float = 0.1, samples_least: int = 3, seed: int = 1) -> DataFrame:
    """As combined, for the pairs that the sketches propose. x, y: source, sample, name, value; sources of fewer samples are left out."""
    enough = samples.select(source, sample).distinct().groupBy(source).agg(F.count("*").alias("c_")).where(F.col("c_") >= samples_least).select(source)
    samples = samples.join(enough, source, "left_semi")
    vx, vy = (_vectors(v, samples, source, sample, *pair, fill, width, seed) for v, pair in ((x, xs), (y, ys)))
    pairs = proposed(_sums(vx, xs[0], sources), _sums(vy, ys[0], sources), xs[0], ys[0], top * oversample)
    dot = F.aggregate(F.zip_with("vx", "vy", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    left = pairs.join(vx.select(source, xs[0], F.col("v").alias("vx")), xs[0])
    exact = left.join(vy.select(source, ys[0], F.col("v").alias("vy")), [source, ys[0]]).select(xs[0], ys[0], dot.alias("rho"))
    return combined(exact, xs[0], ys[0], sources=sources, least=least, top=top)
