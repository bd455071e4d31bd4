"""Associations of all entities with all targets of a group by blocked rank matrices.

A vector is the values of one entity (or target) over the group's samples in a fixed order, collected from long rows; samples
without a row have a given value or are missing. Vectors are packed into blocks of about CELLS numbers, blocks of entities meet
blocks of targets of the same group, and each pair of blocks is one matrix product. What is shuffled is the long rows once and
each block once for every block of the other side; no row is made for a sample, entity and target.

Covariates (numbers and categories) are projected out: the design is an intercept, standardised numbers with missing ones at
the median, and one column a category but one, missing being a category of its own. Its rank counts for the degrees of freedom,
n - rank - 1. A nuisance of an entity's own is projected out of the entity's side alone, after the design.

Where values are complete, vectors are ranked and projected once, as they are packed. With missing values both sides keep raw
numbers, and entities and targets of equal masks share their ranks, design and product. Groups of fewer than min_n samples,
vectors without variance and pairs without degrees of freedom have a null rho. A group's samples must fit one vector.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.operators.graph import _written

#: Numbers in a block; rows in an output batch.
CELLS, ROWS = 1 << 20, 1 << 16
#: A group's vectors are dealt to as many partitions as they fill blocks, but to this many at most.
SALTS = 64


def ranks(m: np.ndarray) -> np.ndarray:
    """Average ranks of each column."""
    n = len(m)
    order = np.argsort(m, axis=0, kind="stable")
    own = np.take_along_axis(m, order, 0)
    place = np.broadcast_to(np.arange(n)[:, None], m.shape)
    new = np.ones(m.shape, bool)
    new[1:] = own[1:] != own[:-1]
    first = np.maximum.accumulate(np.where(new, place, 0), axis=0)
    ends = np.ones(m.shape, bool)
    ends[:-1] = new[1:]
    last = np.minimum.accumulate(np.where(ends, place, n)[::-1], axis=0)[::-1]
    out = np.empty(m.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, 0)
    return out


def basis(design: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span the design's."""
    u, s, _ = np.linalg.svd(design, full_matrices=False)
    return u[:, s > max(design.shape) * np.finfo(float).eps * (s[0] if len(s) else 1)]


def unit(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Columns projected on the complement of q, with length 1; NaN where nothing is left."""
    size = np.sqrt((m * m).sum(0))
    m = m - q @ (q.T @ m)
    left = np.sqrt((m * m).sum(0))
    return m / np.where(left > 1e-10 * np.maximum(size, 1), left, np.nan)


def t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail of Student's t: the incomplete beta function by its continued fraction; relative precision for small tails."""
    t, df = np.broadcast_arrays(np.abs(np.asarray(t, float)), np.asarray(df, float))
    known, at = np.unique(df, return_inverse=True)
    log_b = np.array([math.lgamma(v / 2 + 0.5) - math.lgamma(v / 2) - math.lgamma(0.5) if v > 0 else np.nan for v in known.ravel()])[at].reshape(df.shape)
    x = df / (df + t * t)
    near = x < (df / 2 + 1) / (df / 2 + 2.5)
    a, b, z = np.where(near, df / 2, 0.5), np.where(near, 0.5, df / 2), np.where(near, x, t * t / (df + t * t))
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (a + b) * z / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 101):
        for step in (m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / np.where(np.abs(c) < tiny, tiny, c)
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            h = h * d * c
        if np.abs(d * c - 1).max(initial=0) < 1e-15:
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_b + a * np.log(z) + b * np.log1p(-z)) / a
    inside = np.where(z > 0, front * h, 0.0)
    return np.clip(np.where(near, inside, 1 - inside), 0, 1)


def _design_of(z: list[dict], shape: tuple[int, int]) -> np.ndarray:
    """The design of a group's samples: place, then numbers, then categories."""
    rows = [list(s.values())[1:] for s in z]
    columns = [np.ones(len(rows))]
    for k in range(shape[0]):
        v = np.array([np.nan if r[k] is None else r[k] for r in rows], float)
        v = np.where(np.isfinite(v), v, np.median(v[np.isfinite(v)]) if np.isfinite(v).any() else 0.0)
        columns.append((v - v.mean()) / v.std() if v.std() > 0 else v * 0)
    for k in range(shape[0], sum(shape)):
        own = [(r[k] is not None, r[k] or "") for r in rows]
        columns += [np.array([x == c for x in own], float) for c in sorted(set(own))[1:]]
    return np.column_stack(columns)


def p_of(rho: np.ndarray, df: np.ndarray) -> np.ndarray:
    """p of correlations by Student's t; NaN where rho is."""
    t = np.abs(rho) * np.sqrt(np.maximum(df, 0) / np.maximum(1 - rho * rho, 1e-15))
    return np.where(np.isfinite(rho), t_tail(np.where(np.isfinite(t), t, 0), np.maximum(df, 1)), np.nan)


def masked_products(x: np.ndarray, own: np.ndarray | None, y: np.ndarray, design: np.ndarray, min_n: int):
    """n, rho, df of all columns of x with all of y over the samples that both have; own: nuisance columns of x."""
    shape = x.shape[1], y.shape[1]
    n, rho, df = np.zeros(shape, np.int64), np.full(shape, np.nan), np.zeros(shape, np.int64)
    mx = np.isfinite(x) if own is None else np.isfinite(x) & np.isfinite(own)
    groups = lambda m: [np.flatnonzero(at == g) for at in [np.unique(np.packbits(m.T, axis=1), axis=0, return_inverse=True)[1].ravel()] for g in range(at.max(initial=-1) + 1)]
    my = np.isfinite(y)
    for i in groups(mx):
        for j in groups(my):
            valid = mx[:, i[0]] & my[:, j[0]]
            at, count = np.ix_(i, j), int(valid.sum())
            n[at] = count
            if count < min_n:
                continue
            q = basis(design[valid])
            rx, taken = ranks(x[np.ix_(valid, i)]), np.zeros(len(i), np.int64)
            if own is not None:
                c = unit(own[np.ix_(valid, i)], q)
                taken = np.isfinite(c).all(0).astype(np.int64)
                c = np.where(taken, c, 0.0)
                rx = rx - q @ (q.T @ rx)
                rx = rx - c * (c * rx).sum(0)
            free = (count - q.shape[1] - taken - 1)[:, None]
            rho[at] = np.where(free > 0, np.clip(unit(rx, q).T @ unit(ranks(y[np.ix_(valid, j)]), q), -1, 1), np.nan)
            df[at] = free
    return n, rho, df


def _numbered(samples: DataFrame, by: list[str], sample: str, numbers: list[str], categories: list[str]) -> tuple[DataFrame, DataFrame]:
    """Each sample's place within its group; a row a group with its size and, if there are any, its covariates in that order."""
    own = samples.select(*by, sample, *[F.col(c).cast("double").alias(c) for c in numbers], *[F.col(c).cast("string").alias(c) for c in categories]).dropDuplicates([*by, sample])
    own = own.withColumn("at_", F.row_number().over(Window.partitionBy(*by).orderBy(sample)) - 1)
    listed = F.sort_array(F.collect_list(F.struct("at_", *numbers, *categories))) if numbers or categories else F.lit(None).cast("array<struct<at_:int>>")
    return own.select(*by, sample, "at_"), own.groupBy(*by).agg(F.count("*").cast("int").alias("n_"), listed.alias("z_"))


def _packed(values: DataFrame, place: DataFrame, groups: DataFrame, by: list[str], sample: str, name: str, columns: list[str], fill, shape: tuple[int, int], tag: str, raw: bool | None = None) -> DataFrame:
    """by, {tag}names, {tag}plain, {tag}adjusted, {tag}rank: blocks of vectors; raw (so without fill) plain has the numbers of all
    columns, else unit ranks, and adjusted those off the design. A group's size and design travel ahead of its vectors, once for each partition they are dealt to."""
    cells = F.collect_list(F.struct("at_", *[F.col(c).cast("double").alias(f"v{k}_") for k, c in enumerate(columns)]))
    raw, covariates = fill is None if raw is None else raw, sum(shape) > 0
    filled = values.groupBy(*by).agg(F.approx_count_distinct(name).alias("names_")).join(groups if covariates and not raw else groups.withColumn("z_", F.lit(None).cast(groups.schema["z_"].dataType)), by)
    filled = filled.withColumn("salts_", F.least(F.lit(SALTS), F.ceil(F.col("names_") * F.col("n_") / CELLS)).cast("int"))
    vectors = values.join(place, [*by, sample]).groupBy(*by, name).agg(cells.alias("cells_")).join(filled.select(*by, "salts_"), by)
    vectors = vectors.withColumn("salt_", F.pmod(F.xxhash64(name), F.col("salts_")).cast("int")).drop("salts_")
    designs = filled.select(*by, "n_", "z_", F.explode(F.sequence(F.lit(0), F.col("salts_") - 1)).alias("salt_"))
    rows = vectors.unionByName(designs, allowMissingColumns=True).repartition(*by, "salt_").withColumn("vector_", F.col("cells_").isNotNull())
    rows = rows.sortWithinPartitions(*by, "vector_", name).select(*by, name, "cells_", "z_", "vector_", "n_")
    nb, fields = len(by), values.select(*by, name).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields[:nb]), f"{tag}names array<{fields[nb].dataType.simpleString()}>", f"{tag}plain binary, {tag}adjusted binary, {tag}rank int"])

    def pack(batches):
        key, names, parts, n, kinds, q = None, [], [], 0, [], None

        def block():
            m = np.full((len(columns), n, len(names)), np.nan if fill is None else float(fill))
            for j, (at, vs) in enumerate(parts):
                for k, v in enumerate(vs):
                    m[k, at, j] = v
            plain = m if raw else unit(r := ranks(m[0]), np.full((n, 1), n**-0.5))
            adjusted = b"" if raw or not covariates else unit(r, q).tobytes()
            return pa.RecordBatch.from_arrays(
                [*(pa.array([v], t) for v, t in zip(key, kinds)), pa.array([names], pa.list_(kinds[nb])), pa.array([plain.tobytes()], pa.binary()), pa.array([adjusted], pa.binary()), pa.array([1 if q is None else q.shape[1]], pa.int32())],
                [f"c{i}" for i in range(nb + 4)],
            )

        for b in batches:
            kinds = [b.column(i).type for i in range(nb + 1)]
            cells, offsets = b.column(nb + 1).values, b.column(nb + 1).offsets.to_numpy()
            at_all, v_all = cells.field(0).to_numpy(zero_copy_only=False), [cells.field(1 + k).to_numpy(zero_copy_only=False) for k in range(len(columns))]
            keys, is_vector = list(zip(*(b.column(i).to_pylist() for i in range(nb)))), b.column(nb + 3).to_pylist()
            for i, who in enumerate(b.column(nb).to_pylist()):
                if names and (keys[i] != key or (len(names) + 1) * n > CELLS):
                    yield block()
                    names, parts = [], []
                if not is_vector[i]:
                    if keys[i] != key:
                        key, n = keys[i], b.column(nb + 4)[i].as_py()
                        q = basis(_design_of(b.column(nb + 2)[i].as_py(), shape)) if covariates and not raw else None
                    continue
                names.append(who)
                parts.append((at_all[offsets[i] : offsets[i + 1]].copy(), [v[offsets[i] : offsets[i + 1]].copy() for v in v_all]))
        if names:
            yield block()

    return rows.mapInArrow(pack, schema)


def associate(x: DataFrame, y: DataFrame, samples: DataFrame, by: list[str], sample: str, xs: tuple[str, str], ys: tuple[str, str], *, numbers: list[str] = (), categories: list[str] = (), fill: float | None = 0.0, nuisance: str | None = None, min_n: int = 2, least: float | None = None, tested: bool = True) -> DataFrame:
    """by, entity, target, n, rho, df, p: Spearman correlations of every entity with every target of its group.

    x, y: by, sample, name, value, one row a sample and name; samples: by, sample and the covariates. With fill None, samples
    without a row are missing (a null value too). With covariates also rho_adjusted; df and p are then those of rho_adjusted.
    With least, pairs below it in absolute rho (rho_adjusted) aren't returned, nor those without one. Without tested, no p."""
    raw = fill is None
    if nuisance and not raw:
        raise ValueError("an entity's own nuisance needs fill=None")
    place, groups = _numbered(samples, by, sample, list(numbers), list(categories))
    shape = len(numbers), len(categories)
    left = _packed(x, place, groups, by, sample, xs[0], [xs[1], *([nuisance] if nuisance else [])], fill, shape, "x")
    right = _packed(y, place, groups, by, sample, ys[0], [ys[1]], fill, shape, "y")
    met = left.join(right, by).join(groups.select(*by, "n_", *(["z_"] if raw else [])), by)
    met = met.select(*by, "xnames", "ynames", "xplain", "yplain", "xadjusted", "yadjusted", "xrank", "n_", *(["z_"] if raw else []))
    nb, adjusted = len(by), sum(shape) > 0
    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in x.select(*by).schema), f"`{xs[0]}` {x.schema[xs[0]].dataType.simpleString()}", f"`{ys[0]}` {y.schema[ys[0]].dataType.simpleString()}"]
    schema = ", ".join([*fields, "n long", "rho double", *(["rho_adjusted double"] if adjusted else []), "df long", *(["p double"] if tested else [])])

    def product(b, i, who, whom):
        n = b.column(nb + 7)[i].as_py()
        matrix = lambda c, names, layers=1: np.frombuffer(b.column(nb + c)[i].as_py(), float).reshape(layers, n, len(names))
        if raw:
            m, other = matrix(2, who, 1 + bool(nuisance)), matrix(3, whom)[0]
            count, rho, df = masked_products(m[0], m[1] if nuisance else None, other, _design_of(b.column(nb + 8)[i].as_py(), shape) if adjusted else np.ones((n, 1)), max(min_n, 2))
            return count, masked_products(m[0], None, other, np.ones((n, 1)), max(min_n, 2))[1] if adjusted else rho, rho, df
        plain = rho = np.clip(matrix(2, who)[0].T @ matrix(3, whom)[0], -1, 1) if n >= min_n else np.full((len(who), len(whom)), np.nan)
        df = n - b.column(nb + 6)[i].as_py() - 1
        if adjusted:
            rho = np.clip(matrix(4, who)[0].T @ matrix(5, whom)[0], -1, 1) if n >= min_n and df > 0 else plain * np.nan
        return np.full(rho.shape, n), plain, rho, np.full(rho.shape, df)

    def products(batches):
        for b in batches:
            for i in range(b.num_rows):
                who, whom = b.column(nb)[i].values, b.column(nb + 1)[i].values
                count, plain, rho, df = product(b, i, who, whom)
                pick = np.arange(rho.size) if least is None else np.flatnonzero((np.abs(rho) >= least).ravel())
                row, column = np.divmod(pick, max(1, len(whom)))
                for s in range(0, len(pick), ROWS):
                    at = pick[s : s + ROWS]
                    some = [m.ravel()[at] for m in (count, plain, *([rho] if adjusted else []), df)]
                    some += [p_of(rho.ravel()[at], some[-1])] if tested else []
                    kept = [pa.array(m, from_pandas=True) for m in some]
                    group = [pa.array([b.column(j)[i].as_py()] * len(at), b.column(j).type) for j in range(nb)]
                    columns = [*group, who.take(pa.array(row[s : s + ROWS])), whom.take(pa.array(column[s : s + ROWS])), *kept]
                    yield pa.RecordBatch.from_arrays(columns, [f"c{j}" for j in range(len(columns))])

    return met.mapInArrow(products, schema)


def availability(x: DataFrame, y: DataFrame, samples: DataFrame, by: list[str], xs: tuple[str, str], ys: tuple[str, str], numbers: list[str], categories: list[str], fill: float, min_n: int) -> DataFrame:
    """by, entity, n, df, tests, status of every entity of x: how many tests it takes part in, or why in none. A vector is constant
    if its rows, and the fill for samples without one, are all alike; df takes the design's columns as independent."""
    varied = [F.count_distinct(c) for c in categories]
    parameters = sum((c - 1 for c in varied), F.lit(1)) + sum(((F.max(c) > F.min(c)).cast("int") for c in numbers), F.lit(0))
    sizes = samples.groupBy(*by).agg(F.count("*").alias("n"), parameters.alias("parameters_"))

    def constant(df, pair):
        own = df.groupBy(*by, pair[0]).agg(F.count("*").alias("rows_"), F.min(pair[1]).alias("low_"), F.max(pair[1]).alias("high_"))
        return own.join(sizes, by).withColumn("constant", (F.col("low_") == F.col("high_")) & ((F.col("rows_") == F.col("n")) | (F.col("low_") == fill)))

    targets = constant(y, ys).groupBy(*by).agg(F.count_if(~F.col("constant")).alias("targets"))
    own = constant(x, xs).join(targets, by, "left").withColumn("df", F.col("n") - F.col("parameters_") - 1)
    status = F.when(F.col("n") < min_n, "too_few_samples").when(F.col("df") <= 0, "no_degrees_of_freedom").when(F.col("constant"), "constant_entity").when(F.coalesce("targets", F.lit(0)) == 0, "no_variable_target").otherwise("tested")
    out = own.withColumn("status", status).withColumn("tests", F.when(F.col("status") == "tested", F.col("targets")).otherwise(0))
    return out.select(*by, xs[0], "n", "df", "tests", "status")


def adjusted_p(df: DataFrame, p: str, by: list[str], total: str | Column | None = None, bins: int = 255) -> DataFrame:
    """df with q: Benjamini-Hochberg over the rows of a group; total is the declared number of tests where df holds only some of
    them (then q is an upper bound). Equal p are counted first, and the rest is cut into bins by quantiles of p, so no group is
    sorted by one task: ranks are a bin's offset plus the rank within, minima from the right those of later bins and within. df is
    written first: its p are met by equality later, so they must not be worked out twice."""
    df = _written(df, "tested")
    rows = df.where(F.col(p).isNotNull())
    tied = rows.groupBy(*by, p).agg(F.count("*").alias("c_"))
    edges = tied.agg(F.percentile_approx(p, F.array(*[F.lit((i + 1) / (bins + 1)) for i in range(bins)]), F.lit(10_000))).first()[0]
    edges = sorted(set(edges or []))
    bin_ = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col(p))) if edges else F.lit(0)
    tied = tied.withColumn("bin_", bin_)
    counts = tied.groupBy(*by, "bin_").agg(F.sum("c_").alias("in_"))
    key = by or [F.lit(1)]
    up = Window.partitionBy(*key).orderBy("bin_")
    counts = counts.withColumns({"before_": F.sum("in_").over(up.rowsBetween(Window.unboundedPreceding, -1)), "all_": F.sum("in_").over(Window.partitionBy(*key))})
    if isinstance(total, Column) or total:
        declared = total if isinstance(total, Column) else F.col(total)
        counts = counts.join(rows.groupBy(*by).agg(F.max(declared).alias("declared_")), by) if by else counts.join(F.broadcast(rows.agg(F.max(declared).alias("declared_"))))
    else:
        counts = counts.withColumn("declared_", F.col("all_"))
    own = Window.partitionBy(*by, "bin_").orderBy(p)
    placed = tied.join(counts, [*by, "bin_"]).withColumn("rank_", F.coalesce("before_", F.lit(0)) + F.sum("c_").over(own))
    placed = placed.withColumn("raw_", F.col(p) * F.col("declared_") / F.col("rank_"))
    later = placed.groupBy(*by, "bin_").agg(F.min("raw_").alias("least_"))
    later = later.withColumn("later_", F.min("least_").over(Window.partitionBy(*key).orderBy(F.desc("bin_")).rowsBetween(Window.unboundedPreceding, -1))).drop("least_")
    within = F.min("raw_").over(Window.partitionBy(*by, "bin_").orderBy(F.desc(p)))
    q = placed.join(later, [*by, "bin_"]).select(*by, p, F.least(F.lit(1.0), within, F.col("later_")).alias("q"))
    return df.join(q, [*by, p], "left")

