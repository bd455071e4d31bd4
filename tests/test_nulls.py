import math
import random

import pytest

from assaylake.operators import nulls as N


def run(spark, rows, dependence, draws=2000, seed=1, parts=2):
    p = spark.createDataFrame(rows, "relation long, readout string, g string, p double").repartition(parts)
    d = spark.createDataFrame(dependence, "a string, b string, rho double")
    found = N.empirical_fisher(p, d, "relation", "readout", "g", "p", draws, seed).collect()
    assert len({r.relation for r in found}) == len(found)
    return {r.relation: (r.p, r.method) for r in found}


def test_one_readout_is_exact_and_none_is_unavailable(spark):
    got = run(spark, [(1, "x", "x", 0.03), (1, "y", "y", None), (2, "x", "x", None), (2, "y", "y", float("nan"))], [("x", "y", 0.0)])
    assert got == {1: (0.03, "exact"), 2: (None, "unavailable")}


def test_duplicates_do_not_multiply_evidence(spark):
    got = run(spark, [(1, "x", "d", 0.01), (1, "y", "d", 0.01)], [("y", "x", 1.0)])
    assert got[1] == (pytest.approx(0.01, abs=1e-14), "duplicate")


def test_unknown_dependence_is_conservative(spark):
    got = run(spark, [(1, "x", "x", 0.01), (1, "y", "y", 0.02), (2, "x", "x", 0.7), (2, "y", "y", 0.9)], [("x", "z", 0.3)])
    assert got == {1: (0.02, "bonferroni"), 2: (1.0, "bonferroni")}


def test_same_p_for_any_partitioning_and_company(spark):
    rng = random.Random(3)
    pairs = [(i, r, r, rng.random() ** 2) for i in range(60) for r in ("x", "y")] + [(900, "x", "x", 0.001), (900, "y", "y", 0.001)]
    more = [(i, r, r, rng.random()) for i in range(100, 130) for r in ("x", "y", "z")]
    d = [("x", "y", 0.4), ("x", "z", 0.1), ("y", "z", -0.3)]
    one, other = run(spark, pairs, d, 4000, parts=1), run(spark, more + pairs[::-1], d, 4000, parts=7)
    assert all(other[i] == v for i, v in one.items()) and len(other) == len(one) + 30
    assert all(1 / 4001 <= p <= 1 for p, _ in other.values())
    assert one[900][0] < 0.01


@pytest.mark.parametrize("rho", [0.0, 0.6, -0.6])
def test_null_is_calibrated(spark, rho):
    """Independent readouts: Fisher's closed form. Dependent ones: p of correlated draws of another seed are uniform."""
    draws = 40_000
    x, y = N.normals(99, "a", 4000), N.normals(99, "b", 4000)
    y = rho * x + math.sqrt(1 - rho * rho) * y
    two = lambda z: [math.erfc(abs(v) / math.sqrt(2)) for v in z]
    px, py = two(x), two(y)
    got = run(spark, [(i, r, r, float(p)) for i, pair in enumerate(zip(px, py)) for r, p in zip(("x", "y"), pair)], [("x", "y", rho)], draws)
    ps = sorted(p for p, _ in got.values())
    assert max(abs(p - (i + 0.5) / len(ps)) for i, p in enumerate(ps)) < 1.7 / math.sqrt(len(ps))
    if not rho:
        for i in range(0, 4000, 97):
            q = px[i] * py[i]
            assert abs(got[i][0] - q * (1 - math.log(q))) < 5 * math.sqrt(0.25 / draws)


def test_shared_weights_and_repair(spark):
    """Two of three readouts are one group; correlations that no normals can have are repaired."""
    rows = [(1, "x", "d", 0.01), (1, "y", "d", 0.01), (1, "z", "z", 0.5), (2, "x", "x", 0.2), (2, "y", "y", 0.2), (2, "z", "z", 0.2)]
    got = run(spark, rows, [("x", "y", 1.0), ("x", "z", 0.0), ("y", "z", 0.0)], 20_000)
    q = 0.01 * 0.5
    assert got[1][0] == pytest.approx(q * (1 - math.log(q)), abs=0.01)
    got = run(spark, rows[3:], [("x", "y", 0.9), ("x", "z", 0.9), ("y", "z", -0.9)], 5000)
    assert 0.05 < got[2][0] < 0.6


def test_p_out_of_range_is_an_error(spark):
    with pytest.raises(Exception, match="out of range"):
        run(spark, [(1, "x", "x", 1.5)], [("x", "y", 0.0)])
