import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators import blocks as B


def ranks(v):
    return np.array([sum(w < x for w in v) + (sum(w == x for w in v) + 1) / 2 for x in v])


def residual(v, design):
    return v - design @ np.linalg.lstsq(design, v, rcond=None)[0]


def correlation(a, b):
    size = math.sqrt((a @ a) * (b @ b))
    return a @ b / size if size > 1e-9 else None


def cohorts(seed):
    rng = random.Random(seed)
    samples, x, y = [], [], []
    for c, n in (("big", 40), ("mid", 9), ("few", 4)):
        for s in range(n):
            samples.append((c, f"{c}{s}", rng.choice([None, rng.gauss(0, 1)]) if s % 7 == 3 else rng.gauss(0, 1), rng.choice(["u", "v", None, "w"])))
            x += [(c, f"{c}{s}", f"e{i}", float(rng.randrange(5)), rng.gauss(0, 1)) for i in range(7) if rng.random() < 0.8]
            y += [(c, f"{c}{s}", f"t{i}", rng.gauss(0, 1)) for i in range(5) if rng.random() < 0.9]
            x.append((c, f"{c}{s}", "flat", 2.0, 1.0))
    return samples, x, y


def brute(samples, x, y, fill, nuisance, min_n):
    out = {}
    for c in {s[0] for s in samples}:
        own = [s for s in samples if s[0] == c]
        number = np.array([np.nan if s[2] is None else s[2] for s in own])
        number = np.where(np.isfinite(number), number, np.nanmedian(number))
        known = sorted({str(s[3]) for s in own})
        z = np.column_stack([np.ones(len(own)), number, *[[float(str(s[3]) == k) for s in own] for k in known]])
        names = lambda rows: sorted({r[2] for r in rows if r[0] == c})
        vector = lambda rows, name, k: np.array([{r[1]: r[k] for r in rows if r[0] == c and r[2] == name}.get(s[1], np.nan if fill is None else fill) for s in own])
        for e in names(x):
            for t in names(y):
                a, b, u = vector(x, e, 3), vector(y, t, 3), vector(x, e, 4)
                ok = np.isfinite(a) & np.isfinite(b)
                n, rho, adjusted, df = int(ok.sum()), None, None, 0
                if n >= min_n:
                    one = np.ones((n, 1))
                    rho = correlation(residual(ranks(a[ok]), one), residual(ranks(b[ok]), one))
                    left = np.column_stack([z[ok], u[ok]]) if nuisance else z[ok]
                    df = n - np.linalg.matrix_rank(left) - 1
                    if df > 0:
                        adjusted = correlation(residual(ranks(a[ok]), left), residual(ranks(b[ok]), z[ok]))
                out[c, e, t] = n, rho, adjusted, df
    return out


@pytest.mark.parametrize("fill, nuisance, cells", [(0.0, False, 1 << 20), (0.0, False, 90), (None, False, 60), (None, True, 1 << 20)])
def test_associations_against_least_squares(spark, monkeypatch, fill, nuisance, cells):
    monkeypatch.setattr(B, "CELLS", cells)
    samples, x, y = cohorts(3)
    min_n = 5
    got = B.associate(
        spark.createDataFrame(x, "c string, s string, e string, v double, u double"), spark.createDataFrame(y, "c string, s string, t string, w double"),
        spark.createDataFrame(samples, "c string, s string, a double, g string"), ["c"], "s", ("e", "v"), ("t", "w"),
        numbers=["a"], categories=["g"], fill=fill, nuisance="u" if nuisance else None, min_n=min_n,
    ).collect()
    want = brute(samples, x, y, fill, nuisance, min_n)
    assert {(r.c, r.e, r.t) for r in got} == set(want) and len(got) == len(want)
    same = lambda a, b: (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)
    for r in got:
        n, rho, adjusted, df = want[r.c, r.e, r.t]
        assert same(r.rho, rho) and same(r.rho_adjusted, adjusted), (r, want[r.c, r.e, r.t])
        assert fill is not None or r.n == n
        assert adjusted is None or r.df == df
        assert (r.p is None) == (adjusted is None)


def test_t_tail_against_integration():
    for df in (1, 2, 3, 7, 30, 401):
        for t in (0.0, 0.3, 1.0, 2.5, 8.0):
            end = math.atan(t / math.sqrt(df))  # substitution t = sqrt(df) tan: the density becomes cos^(df-1)
            u = np.linspace(end, math.pi / 2, 200_001)
            f = np.cos(u) ** (df - 1)
            tail = np.sum((f[1:] + f[:-1]) / 2) * (u[1] - u[0])
            scale = 2 * math.exp(math.lgamma(df / 2 + 0.5) - math.lgamma(df / 2)) / math.sqrt(math.pi)
            assert float(B.t_tail(np.array(t), np.array(df))) == pytest.approx(scale * tail, rel=1e-5, abs=1e-300)
    assert float(B.t_tail(np.array(60.0), np.array(100.0))) < 1e-70


@pytest.mark.parametrize("bins", [1, 3, 255])
@pytest.mark.parametrize("total", [None, 500])
def test_adjusted_p_against_a_sort(spark, bins, total):
    rng = random.Random(bins)
    rows = [(g, i, rng.choice([rng.random(), 0.25, 0.5, rng.random() ** 6])) for g in ("a", "b") for i in range(90)] + [("c", 0, 0.04), ("d", 0, None)]
    df = spark.createDataFrame([(*r, total) for r in rows], "g string, i long, p double, m long")
    for by in (["g"], []):
        got = {(r.g, r.i): r.q for r in B.adjusted_p(df, "p", by, "m" if total else None, bins).collect()}
        for g in {"a", "b", "c"} if by else {None}:
            own = sorted((p, a, i) for a, i, p in rows if p is not None and (g is None or a == g))
            m, least = total or len(own), 1.0
            for k in range(len(own) - 1, -1, -1):
                least = min(least, own[k][0] * m / (k + 1))
                assert got[own[k][1], own[k][2]] == pytest.approx(least)
        assert got["d", 0] is None


def test_availability(spark):
    x = spark.createDataFrame([("a", f"s{i}", "flat", 1.0) for i in range(9)] + [("a", "s1", "e", 2.0)] + [("b", "q", "e", 2.0)], "c string, s string, e string, v double")
    y = spark.createDataFrame([("a", "s1", "t", 1.0), ("a", "s2", "zero", 0.0), ("b", "q", "t", 1.0)], "c string, s string, t string, w double")
    z = spark.createDataFrame([("a", f"s{i}", float(i), "g") for i in range(9)] + [("b", "q", 1.0, "g")], "c string, s string, a double, g string")
    got = {(r.c, r.e): (r.n, r.df, r.tests, r.status) for r in B.availability(x, y, z, ["c"], ("e", "v"), ("t", "w"), ["a"], ["g"], 0.0, 3).collect()}
    assert got == {("a", "flat"): (9, 6, 0, "constant_entity"), ("a", "e"): (9, 6, 1, "tested"), ("b", "e"): (1, -1, 0, "too_few_samples")}


def test_adjusted_p_works_its_rows_out_once(spark):
    """p that differ in their last bits from one run of a step to the next (here: drawn anew) still meet their q."""
    df = spark.range(300).select("id", (F.rand() * 0.9 + 0.05).alias("p")).repartition(3)
    draw = F.udf(lambda i: __import__("random").random(), "double").asNondeterministic()
    got = B.adjusted_p(df.withColumn("p", draw("id")), "p", []).collect()
    assert len(got) == 300 and all(r.q is not None and r.p <= r.q <= 1 for r in got)


def test_a_group_of_few_vectors_ships_its_design_once(spark, monkeypatch):
    samples = spark.range(40).select(F.lit("c").alias("c"), F.col("id").alias("s"), F.col("id").cast("double").alias("a"))
    values = samples.crossJoin(spark.range(6).select(F.col("id").alias("e"))).withColumn("v", F.rand(1))
    place, groups = B._numbered(samples, ["c"], "s", ["a"], [])
    monkeypatch.setattr(B, "SALTS", 1 << 30)  # a design for every salt would not end
    packed = B._packed(values, place, groups, ["c"], "s", "e", ["v"], 0.0, (1, 0), "x")
    assert [len(r.xnames) for r in packed.collect()] == [6]
    assert B._numbered(samples, ["c"], "s", [], [])[1].first().z_ is None
