import hashlib
import random

import pytest
from pyspark.sql import functions as F

from assaylake.operators import graph as G
from assaylake.operators import links as L


def digest(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def drawn(edges, per):
    train = {(a, b) for a, b, s in edges if s == "train"}
    held = {(a, b) for a, b, s in edges if s != "train"}
    degree = {b: sum(1 for x in train if x[1] == b) for _, b, _ in edges}
    strata = {}
    for b, d in degree.items():
        strata.setdefault(d.bit_length(), []).append(b)
    for v in strata.values():
        v.sort(key=lambda b: (digest("negatives", b) % L.SLICES, digest("negatives", b), b))
    found = {(a, v[digest("negatives", a, s, i) % len(v)]) for a, _, _ in edges for s, v in strata.items() for i in range(1, per + 1)}
    return {p: p in held for p in (found | held) - train}


@pytest.mark.parametrize("partitions", [1, 7])
def test_candidates_equal_plain_draws(spark, partitions):
    rng = random.Random(4)
    pairs = {(rng.randrange(20), int(60 * rng.random() ** 3)) for _ in range(400)}
    edges = G.split_known(spark.createDataFrame(sorted(pairs) + [(None, 3), (3, None)], "a int, b int").repartition(partitions), "a", "b", 0.8)
    known = [tuple(r) for r in edges.where("a is not null and b is not null").select("a", "b", "split").collect()]
    got = {(r.a, r.b): r.held_out for r in L.candidates(edges, "a", "b", 3).collect()}
    assert got == drawn(known, 3)
    assert any(got.values()) and not all(got.values())


def test_columns_of_the_ends_travel_with_the_draws(spark):
    edges = spark.createDataFrame([(a, b, "train" if (a + b) % 3 else "test") for a in range(6) for b in range(8) if (a * b) % 4 < 2], "a int, b int, split string")
    of_a, of_b = spark.createDataFrame([(a, f"x{a}") for a in range(4)], "a int, x string"), spark.createDataFrame([(b, 10 * b) for b in range(1, 9)], "b int, y int")
    plain = L.candidates(edges, "a", "b", 3)
    want = sorted(map(str, plain.join(of_a, "a", "left").join(of_b, "b", "left").select("a", "b", "x", "y", "held_out").collect()))
    assert want == sorted(map(str, L.candidates(edges, "a", "b", 3, of_a=of_a, of_b=of_b).select("a", "b", "x", "y", "held_out").collect()))


def test_no_edges_no_candidates(spark):
    none = spark.createDataFrame([], "a int, b int, split string")
    assert L.candidates(none, "a", "b", 2).count() == 0
    assert L.budget_metrics(spark.createDataFrame([], "m string, s double, y boolean"), ["m"], "s", "y", [5]).count() == 0


def test_missing_features_add_nothing(spark):
    rows = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, None), (3, float("nan"), 7.0), (4, None, None)], "k int, f double, g double")
    scaling = L.moments(rows, ["f", "g"])
    assert scaling["f"][0] == 2.0 and scaling["g"][0] == 6.0
    got = {r.k: r for r in L.additive_score(rows, {"f": 1.0, "g": 2.0}, scaling).collect()}
    assert [got[k].missing for k in (1, 2, 3, 4)] == ["", "g", "f", "f,g"] and got[4].score == 0
    assert got[2].score == pytest.approx(1 / 2**0.5) and got[3].score == pytest.approx(2 / 2**0.5)
    assert L.moments(rows.where("k = 4"), ["f"]) == {"f": (0.0, 1.0)}


def metrics(rows, k):
    """By all orders of ties at once: expected hits, precision at the end of a block."""
    blocks = {}
    for s, y in rows:
        n, p = blocks.get(s, (0, 0))
        blocks[s] = (n + 1, p + y)
    n0 = p0 = hits = ap = 0
    for s in sorted(blocks, reverse=True):
        n, p = blocks[s]
        hits += p * max(0, min(n, k - n0)) / n
        n0, p0 = n0 + n, p0 + p
        ap += p * p0 / n0
    return hits / min(k, n0), hits / p0 if p0 else None, ap / p0 if p0 else None


@pytest.mark.parametrize("levels", [3, 40, 100000])
def test_metrics_equal_plain_loops(spark, levels):
    rng = random.Random(levels)
    rows = [(m, rng.randrange(levels) / 7, rng.random() < 0.2) for m in "ab" for _ in range(700)] + [("c", 1.0, False)] * 5 + [("a", None, True)]
    df = spark.createDataFrame(rows, "m string, s double, y boolean").repartition(5)
    for r in L.budget_metrics(df, ["m"], "s", "y", [1, 50, 10000]).collect():
        want = metrics([(s, y) for m, s, y in rows if m == r.m and s is not None], r.budget)
        assert (r.precision, r.recall, r.average_precision) == (pytest.approx(want[0]), want[1] if want[1] is None else pytest.approx(want[1]), want[2] if want[2] is None else pytest.approx(want[2]))
    assert L.budget_metrics(df.drop("m"), [], "s", "y", [50]).count() == 1
    assert df.agg(F.count("*")).first()[0] == len(rows)
