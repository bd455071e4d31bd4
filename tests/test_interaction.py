import math

import numpy as np
import pytest

from assaylake.operators import interaction as I


def rows(seed, n=60, key="k"):
    rng = np.random.default_rng(seed)
    g = (np.arange(n) % 3 == 0).astype(int)
    x, a, b = rng.normal(50, 9, n), rng.normal(size=n), rng.exponential(size=n)
    y = 2 * x * g - x + 3 * a + rng.normal(size=n) * (1 + g)
    return [(key, float(y[i]), float(x[i]), int(g[i]), float(a[i]), float(b[i])) for i in range(n)]


SCHEMA = "k string, y double, x double, g int, a double, b double"


def brute(some):
    y, x, g, a, b = (np.array(c, float) for c in list(zip(*some))[1:])
    d = np.column_stack([np.ones(len(y)), x, g, x * g, a, b])
    inverse = np.linalg.inv(d.T @ d)
    beta = inverse @ d.T @ y
    e = (y - d @ beta) / (1 - np.einsum("ij,jk,ik->i", d, inverse, d))
    v = inverse @ (d.T * e**2) @ d @ inverse
    out = {}
    for name, c in (("slope_0", [0, 1, 0, 0, 0, 0]), ("slope_1", [0, 1, 0, 1, 0, 0]), ("difference", [0, 0, 0, 1, 0, 0])):
        c = np.array(c, float)
        out[name], out[f"{name}_se"] = c @ beta, math.sqrt(c @ v @ c)
    out["p"] = math.erfc(abs(out["difference"] / out["difference_se"]) / math.sqrt(2))
    return out


def test_against_matrices_with_unknown_rows_and_typed_reasons(spark):
    one, two = rows(1), rows(2, key="l")
    unknown = [("k", None, 1.0, 1, 0.0, 0.0), ("k", 1.0, 1.0, None, 0.0, 0.0), ("k", 1.0, 1.0, 2, 0.0, 0.0), ("k", 1.0, 1.0, 1, None, 0.0)]
    few = [("few", *r[1:]) for r in rows(3, 20)]
    flat = [("flat", r[1], 5.0 if r[3] else r[2], *r[3:]) for r in rows(4)]
    same = [("same", *r[1:5], 2 * r[4]) for r in rows(5)]
    lone = [("lone", *r[1:4], float(i == 0), r[5]) for i, r in enumerate(rows(6))]
    df = spark.createDataFrame(one + two + unknown + few + flat + same + lone, SCHEMA).repartition(3)
    got = {r.k: r for r in I.interaction(df, ["k"], "y", "x", "g", ["a", "b"]).collect()}
    assert {k: r.reason for k, r in got.items()} == {"k": None, "l": None, "few": "group_too_small", "flat": "constant_x", "same": "singular_design", "lone": "unit_leverage"}
    assert got["k"].unknown == 4 and got["k"].n == 60 and got["k"].n_1 == 20
    for key, some in (("k", one), ("l", two)):
        want = brute(some)
        for c, v in want.items():
            assert got[key][c] == pytest.approx(v, rel=1e-7, abs=1e-12), c
        assert got[key].difference_low == pytest.approx(want["difference"] - 1.959963984540054 * want["difference_se"])
    assert got["few"].difference is None and got["few"].p is None and got["few"].q is None
    p = sorted(got[k].p for k in "kl")  # six tests are declared, two are available
    assert sorted(got[k].q for k in "kl") == pytest.approx([min(p[0] * 6, p[1] * 3, 1), min(p[1] * 3, 1)])
