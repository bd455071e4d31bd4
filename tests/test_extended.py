"""Composed operators without SQL oracles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from assaylake.operators import extended as E
from assaylake.operators import filters as L
from assaylake.operators import ids as I
from assaylake.operators import models as M
from assaylake.operators import stats as S


def test_chi2_tail(spark):
    rows = [(x, df) for x in (0.0, 0.5, 3.0, 12.0, 80.0) for df in (1.0, 2.0, 3.7, 10.0)]

    def brute(x, df, steps=200_000):
        # P[X <= x] by the midpoint rule in sqrt(t), which is smooth at 0
        top, c = math.sqrt(x), 2 ** (1 - df / 2) / math.gamma(df / 2)
        h = top / steps
        return 1 - sum(c * ((i + 0.5) * h) ** (df - 1) * math.exp(-(((i + 0.5) * h) ** 2) / 2) for i in range(steps)) * h

    for r in spark.createDataFrame(rows, "x double, df double").withColumn("p", E.chi2_tail(F.col("x"), F.col("df"))).collect():
        assert r.p == pytest.approx(brute(r.x, r.df), abs=1e-6)


def test_subtypes_of_two_kinds_of_cohorts(spark):
    rows = [("p", f"c{c}", f"{'ab'[c % 2]}{m}", m + 1, 1.0 / (m + 1)) for c in range(6) for m in range(10)]
    rows += [("same", f"c{c}", f"m{m}", m + 1, 1.0) for c in range(4) for m in range(5)] + [("few", "c0", "m", 1, 1.0)]
    df = spark.createDataFrame(rows, "pathway string, cohort string, member string, rank int, weight double")
    got = {(r.pathway, r.cohort): (r.subtype, r.status) for r in E.context_subtypes(df, "pathway", "cohort", "member", "weight").collect()}
    assert {got["p", f"c{c}"] for c in (0, 2, 4)} == {(1, "HETEROGENEOUS")} and {got["p", f"c{c}"] for c in (1, 3, 5)} == {(2, "HETEROGENEOUS")}
    assert got["same", "c1"] == (1, "CONSERVED") and got["few", "c0"] == (0, "UNAVAILABLE")


def test_modules_of_apart_clusters(spark):
    rng = random.Random(1)
    rows = [(i, [10.0 * (i % 3) + rng.random(), -7.0 * (i % 3) + rng.random(), rng.random()]) for i in range(60)]
    got = dict((r.k, r.module) for r in M.modules(spark.createDataFrame(rows, "k long, v array<double>"), "v", "k", 2, 3).collect())
    assert len({got[i] for i in range(60)}) == 3 and all(got[i] == got[i % 3] for i in range(60))


def test_expert_frame_keeps_the_universe_and_nulls(spark):
    u = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "s string, p int")
    folds = spark.createDataFrame([("x", 1, 1.0), ("x", 1, 0.0)], "s string, p int, label double")
    one = spark.createDataFrame([("x", 2, 0.5)], "s string, p int, value double")
    got = {(r.s, r.p): r for r in E.expert_frame(u, folds, {"one": one}, ["s", "p"], ["p"], 5).collect()}
    assert len(got) == 3 and got["x", 1].soft_target == 0.5 and got["y", 1].soft_target is None
    assert got["x", 2].one_available and not got["y", 1].one_available and got["y", 1].one is None
    assert got["x", 1].fold == got["y", 1].fold


def test_unequal_arms_raise(spark):
    a = spark.createDataFrame([(1, "g", 1.0, 0.5)], "k int, g string, y double, s double")
    with pytest.raises(ValueError):
        E.paired_arms(a, a.withColumn("y", F.lit(0.0)), ["k"], ["g"], "y", "s")


def test_labels_keep_unlabelled_apart(spark):
    df = spark.createDataFrame([(0.01, 0.3), (0.07, -0.16), (0.2, 0.9), (0.01, 0.01)], "q double, r double")
    assert [r[0] for r in df.select(L.association_label(F.col("q"), F.col("r"))).collect()] == ["strong", "weak", "unlabeled", "unlabeled"]


def test_recovery_stops_at_an_ambiguous_step(spark):
    rows = spark.createDataFrame([("a", "n1"), ("z", "n1"), ("z", "n2"), ("z", "n9")], "ident string, name string")
    steps = [spark.createDataFrame([("a", "G1")], "lookup string, id string"), spark.createDataFrame([("n1", "G2"), ("n2", "G3"), ("n2", "G4")], "lookup string, id string")]
    got = sorted((r.ident, r.name, r.status, r.id_, r.candidates) for r in I.recover(rows, "ident", "name", steps).collect())
    assert got == [("a", "n1", "step_1", "G1", 1), ("z", "n1", "step_2", "G2", 1), ("z", "n2", "ambiguous", None, 2), ("z", "n9", "unresolved", None, 0)]


def test_one_class_has_no_auroc(spark):
    df = spark.createDataFrame([("g", 1, 0.5), ("g", 1, 0.7), ("h", 1, 0.9), ("h", 0, 0.9)], "g string, y int, s double")
    got = {r.g: r for r in S.binary_metrics(df, ["g"], "y", "s").collect()}
    assert got["g"].auroc is None and got["h"].auroc == 0.5 and got["h"].n == 2


def test_components_of_paths_stars_and_loops_with_fewer_edges_each_round(spark, monkeypatch):
    from assaylake.operators import graph

    rng, sizes = random.Random(8), []
    written = graph._written

    def counted(df, name):
        out = written(df, name)
        if name == "component-edges":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "_written", counted)
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(999, i) for i in range(200, 230)]
    bipartite = [(rng.randrange(300, 400), -rng.randrange(1, 40)) for _ in range(200)]
    pairs = path + star + bipartite + [(500, 500), (600, 601), (601, 600)]
    root = {n: n for p in pairs for n in p}
    changed = True
    while changed:
        changed = False
        for u, v in pairs:
            least = min(root[u], root[v])
            changed |= root[u] != least or root[v] != least
            root[u] = root[v] = least
    rows = graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {(r.node, r.component) for r in rows} == set(root.items()) and len(rows) == len(root)
    assert len(sizes) > 2 and all(b < a for a, b in zip(sizes, sizes[1:])) and sizes[-1] == 0
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0
