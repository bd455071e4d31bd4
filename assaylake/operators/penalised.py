"""Penalised models of all targets of a group on all its entities, with out-of-fold predictions.

Samples have a fold from 0 to k - 1. For each fold the next one picks the penalty by models of the other k - 2, and the model is
fitted again on all k - 1; nothing of a fold's own outcomes or features enters. Values are complete (samples without a row have
a given one); features are standardised on the rows that fit a model, and those without variance there are left out.

Ridge: where a group has no more entities than samples, pieces of its samples give centred sums of products by fold, which are
merged pair by pair; one decomposition of the features' correlations serves all targets and penalties, models on some of the
entities (arms) are read off the same sums, and predictions are made piece by piece. What a task holds is a group's entities times
entities and targets, whatever the number of samples. With more entities than samples, blocks of entities give their share of the
sample kernel Z Z' for every fold and phase, a fold's shares are added up one at a time by one task, which decomposes the sum
once, and every block of targets reads all its targets and penalties off that. What a task holds then is samples squared.

Lasso: entities are screened by rank correlation on the rows that fit a model. A target's screened entities meet in one task,
which keeps sums and products by fold; training moments are sums of those, the path over penalties is coordinate descent on
them, and so is the validation error. What a task holds is a target's screened entities times samples, and the entities squared.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.operators import blocks as B

PENALTIES = tuple(10.0**k for k in range(3, -4, -1))
RATIOS = tuple(float(x) for x in np.geomspace(1, 1e-3, 16))
#: A group's samples are dealt to this many pieces.
PIECES = 16


def _phases(fold: np.ndarray, f: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows that fit and rows that are asked: to pick the penalty, and to predict."""
    after = fold == (f + 1) % k
    return [(np.flatnonzero((fold != f) & ~after), np.flatnonzero(after)), (np.flatnonzero(fold != f), np.flatnonzero(fold == f))]


def _share(x: np.ndarray, fit: np.ndarray, ask: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Features used, and the kernel of the rows that fit with themselves and with those asked."""
    mean, sd = x[fit].mean(0), x[fit].std(0)
    keep = sd > 1e-12
    z = (x[:, keep] - mean[keep]) / sd[keep]
    return int(keep.sum()), z[fit] @ z[fit].T, z[ask] @ z[fit].T


def ridge(x: DataFrame, y: DataFrame, samples: DataFrame, by: list[str], sample: str, fold: str, xs: tuple[str, str], ys: tuple[str, str], *, folds: int = 5, fill: float = 0.0, penalties: tuple[float, ...] = PENALTIES, least: int = 3) -> DataFrame:
    """by, sample, target, fold, observed, predicted, baseline, penalty for every sample and target. baseline is the mean of the
    rows that fit; a null penalty: the intercept alone, which wins ties. Groups where a phase has fewer than `least` rows have no rows."""
    own = x.select(*by, sample, *xs, F.lit("").alias("kind_"))
    return ridge_arms(own, y, samples, by, sample, fold, xs, ys, "kind_", {"": [""]}, folds=folds, fill=fill, penalties=penalties, least=least).drop("arm")


def ridge_arms(x: DataFrame, y: DataFrame, samples: DataFrame, by: list[str], sample: str, fold: str, xs: tuple[str, str], ys: tuple[str, str], kind: str, arms: dict[str, list[str]], *, folds: int = 5, fill: float = 0.0, penalties: tuple[float, ...] = PENALTIES, least: int = 3) -> DataFrame:
    """As ridge, with arm: models on the entities whose `kind` is in the arm's list, all arms on the same rows of the same pass."""
    sizes = x.select(*by, xs[0]).distinct().groupBy(*by).agg(F.count("*").alias("entities_")).join(samples.select(*by, sample).distinct().groupBy(*by).agg(F.count("*").alias("n_")), by)
    sizes = sizes.select(*by, (F.col("entities_") <= F.col("n_")).alias("tall_"))
    tall, wide = sizes.agg(F.coalesce(F.bool_or("tall_"), F.lit(True)), F.coalesce(F.bool_or(~F.col("tall_")), F.lit(False))).first()
    how = {"folds": folds, "fill": fill, "penalties": penalties, "least": least}
    some = lambda flag: x if not (tall and wide) else x.join(sizes.where("tall_" if flag else "not tall_").select(*by), by, "left_semi")
    parts = [_by_moments(some(True), y, samples, by, sample, fold, xs, ys, kind, arms, **how)] if tall else []
    if wide:
        parts += [_by_kernel(some(False).where(F.col(kind).isin(kinds)), y, samples, by, sample, fold, xs, ys, **how).withColumn("arm", F.lit(arm)) for arm, kinds in arms.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


class Centred:
    """Rows counted, and their means, centred products of features with features and outcomes, squares of outcomes, and ranges of
    features; sums of two such are exact up to rounding whatever the means are."""

    def __init__(self, n, mean, products, squares, low, high):
        self.n, self.mean, self.products, self.squares, self.low, self.high = n, mean, products, squares, low, high

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> Centred:
        mx, my = x.mean(0), y.mean(0)
        zx, zy = x - mx, y - my
        return cls(len(x), np.concatenate([mx, my]), zx.T @ np.hstack([zx, zy]), (zy * zy).sum(0), x.min(0), x.max(0))

    @classmethod
    def read(cls, cells: bytes, p: int, q: int) -> Centred:
        v, ends = np.frombuffer(cells, float), np.cumsum([1, p + q, p * (p + q), q, p])
        n, mean, products, squares, low, high = np.split(v, ends)
        return cls(int(n[0]), mean, products.reshape(p, p + q), squares, low, high)

    def written(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.products.ravel(), self.squares, self.low, self.high]).tobytes()

    def __add__(self, other: Centred) -> Centred:
        n, p, gap = self.n + other.n, len(self.low), other.mean - self.mean
        share = self.n * other.n / n
        return Centred(n, self.mean + gap * (other.n / n), self.products + other.products + np.outer(gap[:p], gap) * share, self.squares + other.squares + gap[p:] ** 2 * share, np.minimum(self.low, other.low), np.maximum(self.high, other.high))


def _models(fit: Centred, columns: np.ndarray):
    """A function of penalties (a number, or one a target; infinite: no feature) that gives intercepts and coefficients of all features."""
    p = len(fit.low)
    sd = np.sqrt(np.diag(fit.products[:, :p]) / fit.n)
    keep = columns[(sd[columns] > 1e-12) & (fit.high[columns] > fit.low[columns])]
    d, u = np.linalg.eigh(fit.products[np.ix_(keep, keep)] / fit.n / np.outer(sd[keep], sd[keep]))
    turned, d = u.T @ (fit.products[keep, p:] / fit.n / sd[keep, None]), np.maximum(d, 0)

    def model(penalty):
        b = np.zeros((p, fit.products.shape[1] - p))
        b[keep] = u @ (turned / (d[:, None] + penalty * (len(keep) / fit.n))) / sd[keep, None]
        return fit.mean[p:] - fit.mean[:p] @ b, b

    return model


def _chosen(parts: list[Centred | None], f: int, columns: np.ndarray, grid: np.ndarray, least: int):
    """Intercepts, coefficients, baseline and penalty of the models that predict fold f; None where a phase has too few rows."""
    k = len(parts)
    some = lambda out: [m for g, m in enumerate(parts) if g not in out and m is not None]
    total = lambda out: reduce(lambda a, b: a + b, some(out)) if some(out) else None
    inner, after, rest, own = total({f, (f + 1) % k}), parts[(f + 1) % k], total({f}), parts[f]
    if any(m is None or m.n < least for m in (inner, after, rest, own)):
        return None
    p = len(after.low)
    covariance, squares = after.products / after.n, after.squares / after.n
    model, best = _models(inner, columns), (inner.mean[p:] - after.mean[p:]) ** 2 + squares
    chosen = np.full(len(squares), np.inf)
    for penalty in grid:
        start, b = model(penalty)
        error = (start + after.mean[:p] @ b - after.mean[p:]) ** 2 + squares + (b * (covariance[:, :p] @ b)).sum(0) - 2 * (b * covariance[:, p:]).sum(0)
        better = error < best - 1e-12 * np.maximum(1, best)
        chosen[better], best[better] = penalty, error[better]
    start, b = _models(rest, columns)(chosen)
    return start, b, rest.mean[p:], np.where(np.isinf(chosen), np.nan, chosen)


def _by_moments(x: DataFrame, y: DataFrame, samples: DataFrame, by: list[str], sample: str, fold: str, xs: tuple[str, str], ys: tuple[str, str], kind: str, arms: dict[str, list[str]], *, folds: int, fill: float, penalties: tuple[float, ...], least: int) -> DataFrame:
    """ridge_arms for groups of no more entities than samples."""
    nb, grid = len(by), np.array(sorted(penalties, reverse=True))
    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.select(*by).schema)
    piece = F.pmod(F.xxhash64(sample), F.lit(PIECES)).cast("int").alias("piece_")
    cell = lambda pair: F.struct(F.col(pair[0]).alias("k"), F.col(pair[1]).cast("double").alias("v"))
    known = samples.where(F.col(sample).isNotNull()).select(*by, piece, sample, F.col(fold).cast("int").alias("f_"))
    rows = known.unionByName(x.select(*by, piece, sample, cell(xs).alias("x_")), allowMissingColumns=True).unionByName(y.select(*by, piece, sample, cell(ys).alias("y_")), allowMissingColumns=True)
    names = x.groupBy(*by).agg(F.array_sort(F.collect_set(F.struct(F.col(xs[0]).alias("k"), F.col(kind).alias("kind")))).alias("names_"))
    heads = names.join(y.groupBy(*by).agg(F.array_sort(F.collect_set(ys[0])).alias("targets_")), by)

    def dealt(heads):
        """A row a sample with its cells, after a row with the head of its group: by, sample, f_, x_, y_ and the head's columns."""
        extra = [c for c in heads.columns if c not in by]
        every = heads.withColumn("piece_", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
        one = rows.unionByName(every, allowMissingColumns=True).repartition(*by, "piece_").groupBy(*by, "piece_", sample)
        own = one.agg(F.max("f_").alias("f_"), F.collect_list("x_").alias("x_"), F.collect_list("y_").alias("y_"), *[F.first(c, ignorenulls=True).alias(c) for c in extra])
        return own.sortWithinPartitions(*by, "piece_", F.col(sample).asc_nulls_first()).select(*by, sample, "f_", "x_", "y_", *extra)

    def chunks(batches, size):
        """key, head, samples, folds, x, y of runs of rows of one group; head: the batch and row of the head."""
        key, head, xi, yi, run = None, None, {}, {}, []

        def made():
            m, other = np.full((len(run), len(xi)), float(fill)), np.full((len(run), len(yi)), float(fill))
            for i, (*_, xc, yc) in enumerate(run):
                for at, names_, cells in ((m, xi, xc), (other, yi, yc)):
                    for c in cells:
                        at[i, names_[c["k"]]] = c["v"]
            return key, head, [r[0] for r in run], np.array([r[1] for r in run]), m, other

        for b in batches:
            keys, who, f_of = list(zip(*(b.column(j).to_pylist() for j in range(nb)))), b.column(nb).to_pylist(), b.column(nb + 1).to_pylist()
            for i in range(b.num_rows):
                if run and (keys[i] != key or len(run) >= size(xi, yi)):
                    yield made()
                    run = []
                if who[i] is None:
                    if keys[i] != key:
                        key, head = keys[i], b.slice(i, 1)
                        xi = {s["k"]: j for j, s in enumerate(b.column(nb + 4)[i].as_py() or [])}
                        yi = {t: j for j, t in enumerate(b.column(nb + 5)[i].as_py() or [])}
                elif f_of[i] is not None and keys[i] == key and xi and yi:
                    run.append((who[i], f_of[i], b.column(nb + 2)[i].as_py(), b.column(nb + 3)[i].as_py()))
        if run:
            yield made()

    def sums(batches):
        key, head, parts = None, None, {}

        def out():
            kinds = [s["kind"] for s in head.column(nb + 4)[0].as_py()]
            for f, m in sorted(parts.items()):
                yield pa.RecordBatch.from_arrays([*(head.column(j) for j in range(nb)), pa.array([f], pa.int32()), pa.array([kinds], pa.list_(pa.string())), pa.array([len(m.squares)], pa.int32()), pa.array([m.written()], pa.binary())], [*by, "f_", "kinds", "targets", "cells"])

        for own, new, _, f_of, m, other in chunks(batches, lambda xi, yi: max(1, B.CELLS // (len(xi) + len(yi)))):
            if key is not None and own != key:
                yield from out()
                parts = {}
            key, head = own, new
            for f in set(f_of.tolist()):
                part = Centred.of(m[f_of == f], other[f_of == f])
                parts[f] = parts[f] + part if f in parts else part
        if key is not None:
            yield from out()

    parts = dealt(heads).mapInArrow(sums, f"{key_fields}, f_ int, kinds array<string>, targets int, cells binary")
    gathered = parts.repartition(*by).sortWithinPartitions(*by, "f_")

    def solved(batches):
        key, group, kinds, parts = None, None, None, {}

        def out():
            for arm, chosen in arms.items():
                columns = np.flatnonzero([k in chosen for k in kinds])
                for f in range(folds):
                    model = _chosen([parts.get(g) for g in range(folds)], f, columns, grid, least)
                    if model is not None:
                        yield pa.RecordBatch.from_arrays([*group, pa.array([arm]), pa.array([f], pa.int32()), pa.array([np.concatenate([m.ravel() for m in model]).tobytes()], pa.binary())], [*by, "arm", "f", "cells"])

        for b in batches:
            for i in range(b.num_rows):
                own = tuple(b.column(j)[i].as_py() for j in range(nb))
                if key is not None and own != key:
                    yield from out()
                    parts = {}
                key, group, kinds = own, [b.column(j).slice(i, 1) for j in range(nb)], b.column(nb + 1)[i].as_py()
                f, m = b.column(nb)[i].as_py(), Centred.read(b.column(nb + 3)[i].as_py(), len(kinds), b.column(nb + 2)[i].as_py())
                parts[f] = parts[f] + m if f in parts else m
        if key is not None:
            yield from out()

    models = gathered.mapInArrow(solved, f"{key_fields}, arm string, f int, cells binary")
    listed = models.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("arm", "f", "cells"))).alias("models_"))
    kinds_of = [x.schema[sample].dataType.simpleString(), y.schema[ys[0]].dataType.simpleString()]

    def predicted(batches):
        last, tools, names_ = None, {}, None
        for key, head, who, f_of, m, other in chunks(batches, lambda xi, yi: max(1, B.ROWS // len(yi))):
            p, q = m.shape[1], other.shape[1]
            if key != last:
                last, tools, names_ = key, {}, head.column(nb + 5)[0].values
                for s in head.column(nb + 6)[0].as_py() or []:
                    v = np.frombuffer(s["cells"], float)
                    tools.setdefault(s["f"], []).append((s["arm"], v[:q], v[q : q + p * q].reshape(p, q), v[q + p * q : 2 * q + p * q], v[2 * q + p * q :]))
            samples_ = pa.array(who)
            for f, models_ in tools.items():
                at = np.flatnonzero(f_of == f)
                for arm, start, b, mean, penalty in models_ if len(at) else []:
                    row, size = np.repeat(at, q), len(at) * q
                    group = [pa.array([key[j]] * size, head.column(j).type) for j in range(nb)]
                    numbers = [pa.array(v, from_pandas=True) for v in (other[at].ravel(), (m[at] @ b + start).ravel(), np.tile(mean, len(at)), np.tile(penalty, len(at)))]
                    yield pa.RecordBatch.from_arrays([*group, samples_.take(pa.array(row)), names_.take(pa.array(np.tile(np.arange(q), len(at)))), pa.array(np.full(size, f, np.int32)), pa.array([arm] * size), *numbers], [*by, sample, ys[0], "fold", "arm", "observed", "predicted", "baseline", "penalty"])

    asked = dealt(heads.join(listed, by))
    return asked.mapInArrow(predicted, f"{key_fields}, `{sample}` {kinds_of[0]}, `{ys[0]}` {kinds_of[1]}, fold int, arm string, observed double, predicted double, baseline double, penalty double").select(*by, sample, ys[0], "fold", "arm", "observed", "predicted", "baseline", "penalty")


def _by_kernel(x: DataFrame, y: DataFrame, samples: DataFrame, by: list[str], sample: str, fold: str, xs: tuple[str, str], ys: tuple[str, str], *, folds: int, fill: float, penalties: tuple[float, ...], least: int) -> DataFrame:
    """ridge for groups of more entities than samples."""
    place, groups = B._numbered(samples, by, sample, [fold], [])
    left = B._packed(x, place, groups, by, sample, xs[0], [xs[1]], fill, (1, 0), "x", raw=True)
    right = B._packed(y, place, groups, by, sample, ys[0], [ys[1]], fill, (1, 0), "y", raw=True)
    assigned = groups.select(*by, F.transform("z_", lambda s: s[fold].cast("int")).alias("folds_"))
    nb, grid = len(by), np.array(sorted(penalties, reverse=True))
    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.select(*by).schema)

    def shares(batches):
        for b in batches:
            for i in range(b.num_rows):
                f_of = np.array(b.column(nb + 2)[i].as_py())
                m = np.frombuffer(b.column(nb + 1)[i].as_py(), float).reshape(len(f_of), len(b.column(nb)[i]))
                for f in range(folds):
                    phases = _phases(f_of, f, folds)
                    if min(len(r) for p in phases for r in p) < least:
                        continue
                    parts = [_share(m, *p) for p in phases]
                    cells = b"".join(a.tobytes() for _, *both in parts for a in both)
                    yield pa.RecordBatch.from_arrays([*(b.column(j).slice(i, 1) for j in range(nb)), pa.array([f], pa.int32()), pa.array([[n for n, *_ in parts]], pa.list_(pa.int64())), pa.array([cells], pa.binary())], [*by, "fold_", "used", "cells"])

    parts = left.select(*by, "xnames", "xplain").join(assigned, by).mapInArrow(shares, f"{key_fields}, fold_ int, used array<bigint>, cells binary")
    gathered = parts.join(assigned, by).repartition(*by, "fold_").sortWithinPartitions(*by, "fold_")

    def solve(key, f, used, cells, f_of):
        at, made = 0, []
        for n, (fit, ask) in zip(used, _phases(f_of, f, folds)):
            own, other = len(fit) * len(fit), len(ask) * len(fit)
            kernel, asked = cells[at : at + own].reshape(len(fit), -1), cells[at + own : at + own + other].reshape(len(ask), -1)
            at += own + other
            d, u = np.linalg.eigh(kernel / max(n, 1))
            made += [np.maximum(d, 0), u, asked / max(n, 1) @ u]
        return pa.RecordBatch.from_arrays([*key, pa.array([f], pa.int32()), pa.array([b"".join(np.ascontiguousarray(m).tobytes() for m in made)], pa.binary())], [*by, "fold_", "solved"])

    def added(batches):
        now, key, used, cells, f_of = None, None, None, None, None
        for b in batches:
            for i in range(b.num_rows):
                own = tuple(b.column(j)[i].as_py() for j in range(nb + 1))
                n, c = np.array(b.column(nb + 1)[i].as_py()), np.frombuffer(b.column(nb + 2)[i].as_py(), float)
                if own == now:
                    used, cells = used + n, cells + c
                    continue
                if now is not None:
                    yield solve(key, now[-1], used, cells, f_of)
                now, key, used, cells, f_of = own, [pa.array([b.column(j)[i].as_py()], b.column(j).type) for j in range(nb)], n, c, np.array(b.column(nb + 3)[i].as_py())
        if now is not None:
            yield solve(key, now[-1], used, cells, f_of)

    solved = gathered.mapInArrow(added, f"{key_fields}, fold_ int, solved binary")
    met = right.select(*by, "ynames", "yplain").join(solved, by).join(assigned, by).select(*by, "ynames", "yplain", "fold_", "solved", "folds_")
    kind = y.schema[ys[0]].dataType.simpleString()

    def predicted(batches):
        for b in batches:
            for i in range(b.num_rows):
                names, f, f_of = b.column(nb)[i].values, b.column(nb + 2)[i].as_py(), np.array(b.column(nb + 4)[i].as_py())
                v, cells, at = np.frombuffer(b.column(nb + 1)[i].as_py(), float).reshape(len(f_of), len(names)), np.frombuffer(b.column(nb + 3)[i].as_py(), float), 0
                tools = []
                for fit, ask in _phases(f_of, f, folds):
                    n, q = len(fit), len(ask)
                    tools.append((fit, ask, cells[at : at + n], cells[at + n : at + n + n * n].reshape(n, n), cells[at + n + n * n : at + n + n * n + q * n].reshape(q, n)))
                    at += n + n * n + q * n
                fit, ask, d, u, a = tools[0]
                mean = v[fit].mean(0)
                turned, best = u.T @ (v[fit] - mean), ((v[ask] - mean) ** 2).mean(0)
                chosen = np.full(v.shape[1], -1)
                for j, penalty in enumerate(grid):
                    error = ((a @ (turned / (d[:, None] + penalty)) + mean - v[ask]) ** 2).mean(0)
                    better = error < best - 1e-12 * np.maximum(1, best)
                    chosen[better], best[better] = j, error[better]
                fit, ask, d, u, a = tools[1]
                mean, penalty = v[fit].mean(0), np.where(chosen < 0, np.inf, grid[np.maximum(chosen, 0)])
                guess = a @ (u.T @ (v[fit] - mean) / (d[:, None] + penalty)) + mean
                who, whom = np.repeat(ask, len(names)), np.tile(np.arange(len(names)), len(ask))
                group = [pa.array([b.column(j)[i].as_py()] * len(who), b.column(j).type) for j in range(nb)]
                numbers = [pa.array(m, from_pandas=True) for m in (v[ask].ravel(), guess.ravel(), np.tile(mean, len(ask)), np.tile(np.where(chosen < 0, np.nan, penalty), len(ask)))]
                yield pa.RecordBatch.from_arrays([*group, pa.array(who.astype(np.int32)), names.take(pa.array(whom)), pa.array(np.full(len(who), f, np.int32)), *numbers], [*by, "at_", ys[0], "fold", "observed", "predicted", "baseline", "penalty"])

    out = met.mapInArrow(predicted, f"{key_fields}, at_ int, `{ys[0]}` {kind}, fold int, observed double, predicted double, baseline double, penalty double")
    return out.join(place, [*by, "at_"]).select(*by, sample, ys[0], "fold", "observed", "predicted", "baseline", "penalty")


def path(gram: np.ndarray, product: np.ndarray, penalties: np.ndarray, rounds: int = 2000, tolerance: float = 1e-10) -> np.ndarray:
    """Lasso coefficients for each penalty (falling), of standardised features: gram Z'Z / n, product Z'y / n. Coordinate descent
    finds which are used and their signs; the rest is one linear system, accepted where it meets the conditions of the optimum."""
    b, out = np.zeros(len(product)), np.zeros((len(penalties), len(product)))
    diagonal = np.diag(gram).tolist()
    for i, penalty in enumerate(penalties):
        left = product - gram @ b
        for _ in range(rounds):
            moved = 0.0
            for j, g in enumerate(diagonal):
                old, r = b[j], left[j] + g * b[j]
                new = (r - penalty if r > penalty else r + penalty if r < -penalty else 0.0) / g
                if new != old:
                    left -= gram[j] * (new - old)
                    moved, b[j] = max(moved, abs(new - old)), new
            if moved < tolerance:
                break
            used = np.flatnonzero(b)
            try:
                exact = np.linalg.solve(gram[np.ix_(used, used)], product[used] - penalty * np.sign(b[used]))
            except np.linalg.LinAlgError:
                continue
            slope = product - gram[:, used] @ exact
            slope[used] = 0
            if (np.sign(exact) == np.sign(b[used])).all() and np.abs(slope).max(initial=0) <= penalty + tolerance:
                b[used] = exact
                break
        out[i] = b
    return out


class Moments:
    """Sums and products of features and an outcome by fold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray, k: int):
        own = [fold == f for f in range(k)]
        one = np.column_stack([np.ones(len(y)), x, y])
        self.parts = np.stack([one[o].T @ one[o] for o in own])

    def of(self, folds: list[int], columns: np.ndarray):
        """n, means and covariances (features, then the outcome) over the rows of some folds."""
        at = np.concatenate([[0], 1 + columns, [self.parts.shape[1] - 1]])
        m = self.parts[folds].sum(0)[np.ix_(at, at)]
        n = m[0, 0]
        mean = m[0, 1:] / n
        return n, mean, m[1:, 1:] / n - np.outer(mean, mean)


def fitted(m: Moments, train: list[int], columns: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intercepts and coefficients (of all features) along the path."""
    size = m.parts.shape[1] - 2
    n, mean, cov = m.of(train, columns)
    coefficient, sd = np.zeros((len(ratios), size)), np.sqrt(np.maximum(np.diag(cov), 0))
    keep = np.flatnonzero(sd[:-1] > 1e-9 * np.maximum(1, np.abs(mean[:-1])))
    if len(keep) and sd[-1] > 1e-12:
        product = cov[keep, -1] / sd[keep] / sd[-1]
        most = np.abs(product).max()
        if most > 1e-14:
            b = path(cov[np.ix_(keep, keep)] / np.outer(sd[keep], sd[keep]), product, most * ratios)
            b[ratios >= 1] = 0
            coefficient[:, columns[keep]] = b * sd[-1] / sd[keep]
    return mean[-1] - coefficient[:, columns] @ mean[:-1] if len(columns) else np.full(len(ratios), mean[-1]), coefficient


def _screened(x: DataFrame, y: DataFrame, place: DataFrame, groups: DataFrame, by: list[str], sample: str, fold: str, xs: tuple[str, str], ys: tuple[str, str], folds: int, fill: float, cut: float, min_n: int = 10) -> DataFrame:
    """by, f_, inner_, entity, target, rho, p: rank correlations of `cut` or more over the rows that fit each fold's two models; a
    vector is collected once and ranked again for each model, no row of it is copied for one."""
    left = B._packed(x, place, groups, by, sample, xs[0], [xs[1]], fill, (1, 0), "x", raw=True)
    right = B._packed(y, place, groups, by, sample, ys[0], [ys[1]], fill, (1, 0), "y", raw=True)
    assigned = groups.select(*by, F.transform("z_", lambda s: s[fold].cast("int")).alias("folds_"))
    met = left.select(*by, "xnames", "xplain").join(right.select(*by, "ynames", "yplain"), by).join(assigned, by).select(*by, "xnames", "xplain", "ynames", "yplain", "folds_")
    nb, fields = len(by), [*(f"`{f.name}` {f.dataType.simpleString()}" for f in x.select(*by).schema)]

    def products(batches):
        for b in batches:
            for i in range(b.num_rows):
                who, whom, f_of = b.column(nb)[i].values, b.column(nb + 2)[i].values, np.array(b.column(nb + 4)[i].as_py())
                m, other = (np.frombuffer(b.column(nb + c)[i].as_py(), float).reshape(len(f_of), len(names)) for c, names in ((1, who), (3, whom)))
                for f, inner in ((f, inner) for f in range(folds) for inner in (True, False)):
                    fit = np.flatnonzero((f_of != f) & (~np.bool_(inner) | (f_of != (f + 1) % folds)))
                    if len(fit) < min_n:
                        continue
                    one = np.full((len(fit), 1), len(fit) ** -0.5)
                    rho = np.clip(B.unit(B.ranks(m[fit]), one).T @ B.unit(B.ranks(other[fit]), one), -1, 1)
                    row, column = np.nonzero(np.abs(rho) >= cut)
                    some, size = rho[row, column], len(row)
                    group = [pa.array([b.column(j)[i].as_py()] * size, b.column(j).type) for j in range(nb)]
                    numbers = [pa.array(v, from_pandas=True) for v in (some, B.p_of(some, np.full(size, len(fit) - 2)))]
                    yield pa.RecordBatch.from_arrays([*group, pa.array([f] * size, pa.int32()), pa.array([inner] * size, pa.bool_()), who.take(pa.array(row)), whom.take(pa.array(column)), *numbers], [*by, "f_", "inner_", xs[0], ys[0], "rho", "p"])

    names = [f"`{pair[0]}` {df.schema[pair[0]].dataType.simpleString()}" for df, pair in ((x, xs), (y, ys))]
    return met.mapInArrow(products, ", ".join([*fields, "f_ int, inner_ boolean", *names, "rho double, p double"]))


def screened_lasso(x: DataFrame, y: DataFrame, samples: DataFrame, by: list[str], sample: str, fold: str, xs: tuple[str, str], ys: tuple[str, str], *, folds: int = 5, fill: float = 0.0, cut: float = 0.2, fdr: float = 0.05, ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """by, target, entity, fold, weight, ratio, validation_mse, screened: a row an entity with a weight in a fold's model, and one
    with a null entity for each fold: the intercept. Entities are screened within the rows that fit: |rho| of `cut` or more and
    an adjusted p (over all entities) of `fdr` or less. The penalty is a ratio of the least one that leaves nothing; ties take the larger."""
    place, groups = B._numbered(samples, by, sample, [fold], [])
    rho = _screened(x, y, place, groups, by, sample, fold, xs, ys, folds, fill, cut)
    own = [*by, "f_", "inner_"]
    total = x.select(*by, xs[0]).distinct().groupBy(*by).agg(F.count("*").alias("total_"))
    passed = B.adjusted_p(rho.join(total, by), "p", [*own, ys[0]], "total_").where(F.col("q") <= fdr)
    lists = passed.groupBy(*by, ys[0], xs[0]).agg(F.collect_set(F.struct("f_", "inner_")).alias("uses_"))

    cells = lambda df, pair: df.join(place, [*by, sample]).groupBy(*by, pair[0]).agg(F.collect_list(F.struct("at_", F.col(pair[1]).cast("double").alias("v_"))).alias("cells_"))
    entities = lists.join(cells(x, xs), [*by, xs[0]]).select(*by, ys[0], F.col(xs[0]).alias("e_"), "uses_", "cells_")
    targets = cells(y, ys).join(groups, by).select(*by, ys[0], "cells_", F.transform("z_", lambda s: s[fold].cast("int")).alias("folds_"))
    rows = targets.unionByName(entities, allowMissingColumns=True).withColumn("entity_", F.col("folds_").isNull())
    rows = rows.repartition(*by, ys[0]).sortWithinPartitions(*by, ys[0], "entity_", "e_").select(*by, ys[0], "e_", "cells_", "folds_", "uses_")
    nk, grid = len(by) + 1, np.array(ratios)
    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in x.select(*by).schema), f"`{ys[0]}` {y.schema[ys[0]].dataType.simpleString()}", f"`{xs[0]}` {x.schema[xs[0]].dataType.simpleString()}"]

    def model(key, kinds, y_, f_of, names, columns, uses):
        m, out = Moments(np.column_stack([np.zeros((len(y_), 0)), *columns]), y_, f_of, folds), []
        present = set(f_of.tolist())
        for f in sorted(present):
            use = lambda inner: np.array([j for j, u in enumerate(uses) if (f, inner) in u], np.int64)  # noqa: E731, B023
            after, rest = (f + 1) % folds, sorted(present - {f})
            train = [g for g in rest if g != after]
            if after not in present or not train:
                continue
            start, b = fitted(m, train, use(True), grid)
            n, mean, cov = m.of([after], np.arange(len(names)))
            gap = mean[-1] - start - b @ mean[:-1]
            error = gap**2 + cov[-1, -1] - 2 * b @ cov[:-1, -1] + np.einsum("ij,jk,ik->i", b, cov[:-1, :-1], b)
            pick = int(np.flatnonzero(error <= error.min() + 1e-12 * max(1, error.min()))[0])
            start, b = fitted(m, rest, use(False), grid[: pick + 1])
            some = (f, float(grid[pick]), float(error[pick]), len(use(False)))
            out.append((None, float(start[-1]), *some))
            out += [(names[j], float(b[-1, j]), *some) for j in np.flatnonzero(b[-1]).tolist()]
        if not out:
            return []
        who, weight, f, ratio, mse, screened = zip(*out)
        arrays = [*(pa.array([v] * len(who), t) for v, t in zip(key, kinds)), pa.array(who, kinds[-1]), pa.array(f, pa.int32()), pa.array(weight), pa.array(ratio), pa.array(mse), pa.array(screened, pa.int32())]
        return [pa.RecordBatch.from_arrays(arrays, [f"c{i}" for i in range(len(arrays))])]

    def models(batches):
        key, kinds, y_, f_of, names, columns, uses = None, None, None, None, [], [], []
        for b in batches:
            kinds = [b.column(i).type for i in range(nk + 1)]
            keys = list(zip(*(b.column(i).to_pylist() for i in range(nk))))
            for i, who in enumerate(b.column(nk).to_pylist()):
                cells_, f_new = b.column(nk + 1)[i].values, b.column(nk + 2)[i].as_py()
                if f_new is not None:
                    if key is not None:
                        yield from model(key, kinds, y_, f_of, names, columns, uses)
                    key, f_of, names, columns, uses = keys[i], np.array(f_new), [], [], []
                v = np.full(len(f_of), float(fill))
                v[cells_.field(0).to_numpy()] = cells_.field(1).to_numpy(zero_copy_only=False)
                if f_new is not None:
                    y_ = v
                else:
                    names.append(who), columns.append(v), uses.append({(u["f_"], u["inner_"]) for u in b.column(nk + 3)[i].as_py()})
        if key is not None:
            yield from model(key, kinds, y_, f_of, names, columns, uses)

    return rows.mapInArrow(models, ", ".join(fields) + ", fold int, weight double, ratio double, validation_mse double, screened int")


def selection(weights: DataFrame, by: list[str], target: str, entity: str) -> DataFrame:
    """by, target, entity, folds, frequency, weight (mean over all folds' models), same_sign, from screened_lasso."""
    models = weights.where(F.col(entity).isNull()).groupBy(*by, target).agg(F.count("*").alias("models_"))
    own = weights.where(F.col(entity).isNotNull()).groupBy(*by, target, entity).agg(F.count("*").alias("folds"), F.sum("weight").alias("sum_"), F.abs(F.sum(F.signum("weight"))).alias("net_"))
    out = own.join(models, [*by, target])
    return out.select(*by, target, entity, "folds", (F.col("folds") / F.col("models_")).alias("frequency"), (F.col("sum_") / F.col("models_")).alias("weight"), (F.col("net_") == F.col("folds")).alias("same_sign"))


def arms_compared(arms: dict[str, DataFrame], key: list[str], by: list[str]) -> DataFrame:
    """by, arm, n, rmse, r2, skill, spearman-free metrics of out-of-fold predictions on identical held-out rows; other rows raise."""
    names = list(arms)
    first = arms[names[0]].select(*key, "observed", "baseline")
    for name in names[1:]:
        other = arms[name].select(*key, F.col("observed").alias("o_"), F.col("baseline").alias("b_"))
        odd = first.join(other, key, "full_outer").where("observed is null or o_ is null or abs(observed - o_) > 1e-9 * (1 + abs(o_)) or abs(baseline - b_) > 1e-9 * (1 + abs(b_))")
        if not odd.isEmpty():
            raise ValueError(f"arm {name} doesn't hold the same held-out rows")
    return arm_metrics(reduce(lambda a, b: a.unionByName(b), [df.select(*by, "observed", "predicted", "baseline", F.lit(name).alias("arm")) for name, df in arms.items()]), by)


def arm_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, arm, n, rmse, r2, skill of rows with an arm, as ridge_arms gives them."""
    e, base = F.col("observed") - F.col("predicted"), F.col("observed") - F.col("baseline")
    sst = F.var_pop("observed") * F.count("*")
    found = rows.groupBy(*by, "arm").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(sst > 1e-12, 1 - F.sum(e * e) / sst).alias("r2"), F.when(F.sum(base * base) > 1e-12, 1 - F.sum(e * e) / F.sum(base * base)).alias("skill"))
    return found.select(*by, "n", "rmse", "r2", "skill", "arm")
