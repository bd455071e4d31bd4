"""Operators that SQL can't hold against an oracle, edge cases, and invariances."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from assaylake.functions import scalars as X
from assaylake.operators import graph as G
from assaylake.operators import joins as J
from assaylake.operators import models as M
from assaylake.operators import quality as Q
from assaylake.operators import stats as S
from assaylake.operators import survival as U
from assaylake.operators import windows as W


def tail_by_sum(t, df, steps=100_000):
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    h = abs(t) / steps
    inside = sum((1 if 0 < i < steps else 0.5) * c * (1 + (i * h) ** 2 / df) ** (-(df + 1) / 2) for i in range(steps + 1)) * h
    return 1 - 2 * inside


def test_t_tail(spark):
    rows = [(t, df) for t in (0.0, 0.7, 2.5, 6.0) for df in (1, 2, 3, 4, 7, 10, 31)]
    got = spark.createDataFrame(rows, "t double, df int").withColumn("p", X.t_two_sided(F.col("t"), F.col("df"))).collect()
    for r in got:
        assert r.p == pytest.approx(tail_by_sum(r.t, r.df), abs=1e-6), (r.t, r.df)


def test_normal_tail(spark):
    z = [0.0, 0.3, 1.0, 1.96, 3.0, 3.6, 5.0, 9.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").withColumn("p", X.normal_two_sided(F.col("z"))).collect()
    for r in got:
        assert r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)), rel=1e-6)


def test_benjamini_hochberg_with_nulls_and_a_declared_total(spark):
    p = [0.01, 0.04, None, 0.03, 0.5, 0.01]
    df = spark.createDataFrame([(i, x, "g") for i, x in enumerate(p)], "i int, p double, g string")

    def brute(m):
        known = sorted((x, i) for i, x in enumerate(p) if x is not None)
        out, least = {}, 1.0
        for r in range(len(known), 0, -1):
            least = min(least, known[r - 1][0] * m / r)
            out[known[r - 1][1]] = least
        return out

    for total, m in ((None, 5), (F.lit(20), 20)):
        got = {r.i: r.q for r in W.benjamini_hochberg(df, "p", ["g"], ["i"], total).collect()}
        assert got[2] is None and all(got[i] == pytest.approx(q) for i, q in brute(m).items())


def test_folds_ignore_row_order_and_leave_nobody_twice(spark):
    rows = [(f"c{i % 3}", i) for i in range(60)]
    one = sorted(map(tuple, W.folds(spark.createDataFrame(rows, "c string, p int"), "c", "p", 5).collect()))
    two = sorted(map(tuple, W.folds(spark.createDataFrame(rows[::-1], "c string, p int").repartition(7), "c", "p", 5).collect()))
    assert one == two
    splits = W.outer_splits(spark.createDataFrame(one, "c string, p int, fold int"), 5)
    assert Q.leaks(splits.where("split = 'test'"), "p", "outer_fold").count() == 0


def test_validated_join_refuses_repeated_keys(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (1, "y")], "k int, w string")
    with pytest.raises(ValueError):
        J.validated(left, right, ["k"])
    with pytest.raises(ValueError):
        J.validated(left, right.limit(1), ["k"], one_to_one=True)
    assert J.validated(left, right.limit(1), ["k"]).count() == 2


def test_binned_join_is_the_plain_one(spark):
    rng = random.Random(5)
    span = lambda: (lambda s: (s, s + rng.randrange(1, 90)))(rng.randrange(-200, 600))
    a, b = [(i, "x", *span()) for i in range(60)], [(i, "x", *span()) for i in range(60)]
    da, db = spark.createDataFrame(a, "i int, c string, s long, e long"), spark.createDataFrame(b, "j int, c string, bs long, be long")
    for within in (0, 17):
        got = sorted((r.i, r.j) for r in J.binned(da, db, ["c"], ("s", "e"), ("bs", "be"), 32, within).collect())
        assert got == sorted((x[0], y[0]) for x in a for y in b if x[2] - within < y[3] and y[2] < x[3] + within)


def test_binned_join_with_coarser_bins_is_the_plain_one_in_fewer_rows(spark):
    rng = random.Random(15)
    span = lambda: (lambda s: (s, s + rng.choice([0, 1, 7, 31, 32, 33, 200, 256, 257, 1500, 2048, 2049, 9000])))(rng.randrange(-4000, 6000))
    a, b = [(i, "x", *span()) for i in range(150)], [(i, "x", *span()) for i in range(150)]
    da, db = spark.createDataFrame([*a, (-1, "x", None, 5)], "i int, c string, s long, e long"), spark.createDataFrame([*b, (-1, None, 0, 5)], "j int, c string, bs long, be long")
    for within in (0, 17):
        for coarser in (0, 1, 2):
            got = sorted((r.i, r.j) for r in J.binned(da, db, ["c"], ("s", "e"), ("bs", "be"), 32, within, coarser).collect())
            assert got == sorted((x[0], y[0]) for x in a for y in b if x[2] - within < y[3] and y[2] < x[3] + within)


def test_lift_of_long_intervals_needs_one_whole_block(spark):
    rng = random.Random(16)
    points = [(i, "c", s, s + rng.choice([-1, 0, 5, 300, 900])) for i, s in enumerate(rng.randrange(-500, 2000) for _ in range(120))]
    blocks = [("c", s, s + rng.randrange(1, 1200), "T", 10 * k, 100_000, "+") for k, s in enumerate(rng.randrange(-600, 2000) for _ in range(25))]
    kinds = "chrom string, block_start long, block_end long, target_chrom string, target_start long, target_size long, strand string"
    lifted = J.lift(spark.createDataFrame(points, "i int, chrom string, start long, end long"), spark.createDataFrame(blocks, kinds), "i", "chrom", "start", "end", 64)
    assert lifted._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1  # of the blocks
    got = {r.i: (r.status, r.lifted_start) for r in lifted.collect()}
    for i, _, start, end in points:
        hit = [b for b in blocks if b[1] <= start - 1 < b[2] and b[1] < end <= b[2]]
        want = ("no_complete_aligned_block", None) if not hit else ("ambiguous_complete_block", None) if len(hit) > 1 else ("lifted", hit[0][4] + start - hit[0][1])
        assert got[i] == want


def test_as_of_against_a_loop(spark):
    rng = random.Random(6)
    points = [(i, "g", rng.randrange(100)) for i in range(50)]
    segments = [("g", s, s + rng.randrange(12), s * 1.5) for s in rng.sample(range(100), 15)]
    got = {r.i: r.v for r in J.as_of(spark.createDataFrame(points, "i int, g string, at long"), spark.createDataFrame(segments, "g string, s long, e long, v double"), ["g"], "at", "s", "e", ["v"]).collect()}
    for i, _, at in points:
        best = max((x for x in segments if x[1] <= at), default=None, key=lambda x: x[1])
        assert got[i] == (best[3] if best and at <= best[2] else None)


def test_logrank_and_km_against_loops(spark):
    rng = random.Random(7)
    rows = [("e", rng.randrange(1, 12), rng.randrange(2), bool(rng.randrange(2))) for _ in range(40)]
    df = spark.createDataFrame(rows, "g string, t int, d int, h boolean")
    o = e = v = 0.0
    for t in sorted({r[1] for r in rows if r[2]}):
        n, n1 = sum(r[1] >= t for r in rows), sum(r[1] >= t and r[3] for r in rows)
        d, d1 = sum(r[1] == t and r[2] for r in rows), sum(r[1] == t and r[2] and r[3] for r in rows)
        o, e = o + d1, e + d * n1 / n
        v += d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) if n > 1 else 0
    r = U.logrank(df, ["g"], "t", "d", "h").first()
    assert (r.observed, r.expected, r.variance) == (o, pytest.approx(e), pytest.approx(v))
    s = 1.0
    for t in range(1, 7):
        d, n = sum(x[1] == t and x[2] for x in rows), sum(x[1] >= t for x in rows)
        s *= 1 - d / n
    k = {x.horizon: x for x in U.kaplan_meier(df, ["g"], "t", "d", [0.0, 6.0]).collect()}
    assert k[6.0].survival == pytest.approx(s) and k[0.0].survival == 1.0 and k[6.0].at_risk == sum(x[1] >= 6 for x in rows)


def test_hc3_against_the_matrix_formula(spark):
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(1)
    x, g = rng.normal(size=60), rng.integers(0, 2, 60)
    y = 1 + 2 * x - 3 * x * g + rng.normal(size=60) * (1 + abs(x))
    df = spark.createDataFrame([("k", float(a), float(b), int(c)) for a, b, c in zip(y, x, g)], "k string, y double, x double, g int")
    r = S.interaction_hc3(df, ["k"], "y", "x", "g").first()
    z = np.column_stack([np.ones(60), x, g, x * g])
    inv = np.linalg.inv(z.T @ z)
    beta = inv @ z.T @ y
    res = (y - z @ beta) / (1 - np.einsum("ij,jk,ik->i", z, inv, z))
    cov = inv @ (z.T * res**2) @ z @ inv
    assert r.difference == pytest.approx(beta[3]) and r.se == pytest.approx(math.sqrt(cov[3, 3]))


def test_hypergeometric_tail(spark):
    lf = S.log_factorials(spark, 60)
    rows = [(k, 12, 9, 60) for k in range(0, 10)] + [(50, 12, 9, 60)]
    got = spark.createDataFrame(rows, "k int, d int, s int, n int").withColumn("p", S.hypergeometric_tail(lf, F.col("k"), F.col("d"), F.col("s"), F.col("n"))).collect()
    for r in got:
        want = sum(math.comb(9, i) * math.comb(51, 12 - i) for i in range(r.k, 10)) / math.comb(60, 12)
        assert r.p == pytest.approx(want, abs=1e-12)


def test_best_paths_against_search(spark):
    rng = random.Random(8)
    edges = [(f"n{a}", f"n{b}", round(rng.random(), 3)) for a in range(7) for b in range(7) if a != b and rng.random() < 0.5]
    got = {(tuple(r.path)): r.score for r in G.best_paths(spark.createDataFrame(edges, "a string, b string, weight double"), spark.createDataFrame([("n0",)], "node string"), 3, 10_000).collect()}
    want, w = {}, {(a, b): x for a, b, x in edges}

    def walk(path, score):
        for b in (b for a, b in w if a == path[-1] and b not in path):
            want[(*path, b)] = score * w[path[-1], b]
            if len(path) < 3:
                walk((*path, b), score * w[path[-1], b])

    walk(("n0",), 1.0)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_rewiring_keeps_counts(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(rng.randrange(9), rng.randrange(30), rng.choice("ab")) for _ in range(300)], "s int, d int, k string")
    out = G.rewired(df, "s", "d", "k", 3)
    count = lambda f, c: sorted(map(tuple, f.groupBy("k", c).count().collect()))
    assert out.count() == 300 and count(out, "s") == count(df, "s")
    assert count(out.select("k", F.col("new_dst").alias("d")), "d") == count(df, "d")


def test_communities_of_two_cliques(spark):
    edges = [(a + o, b + o, 1.0) for o in (0, 10) for a in range(5) for b in range(a)] + [(0, 10, 0.1)]
    got = dict(G.communities(spark.createDataFrame(edges, "u long, v long, weight double"), 6).collect())
    assert len({got[i] for i in range(5)}) == 1 and len({got[i + 10] for i in range(5)}) == 1 and got[1] != got[11]


def test_bootstrap_ignores_partitioning(spark):
    rng = random.Random(10)
    df = spark.createDataFrame([(i % 40, rng.random() + 0.3, rng.random()) for i in range(400)], "u int, a double, b double")
    one, two = (S.bootstrap_difference(d, "u", "a", "b", 100).first() for d in (df, df.repartition(9)))
    assert one.low == pytest.approx(two.low) and one.low < one.difference < one.high and one.low > 0.1


def test_logistic_and_ridge(spark):
    rng = random.Random(11)
    rows = [(i, "ab"[i % 2], rng.random(), float((i % 2) ^ (rng.random() < 0.1)), 2.0 * i + rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, s string, x double, y double, v double")
    scored, penalty = M.hashed_logistic(df, ["s", "x"], "y", F.col("i") % 3 > 0, F.col("i") % 3 == 0, 32, (0.001, 0.5), False)
    assert scored.where("(probability_ > 0.5) = (y = 1)").count() > 250 and penalty in (0.001, 0.5)
    p = M.ridge_out_of_fold(df.withColumn("i", F.col("i").cast("double")).withColumn("f", (F.col("i") % 3).cast("int")), ["i"], "v", "f", 3, 1e-6)
    assert p.count() == 300 and p.where(F.abs(F.col("prediction") - F.col("v")) < 2).count() == 300


def test_table_hash_ignores_order(spark):
    df = spark.createDataFrame([(i, i / 7) for i in range(100)], "a int, b double")
    assert Q.table_hash(df).first() == Q.table_hash(df.orderBy(F.desc("a")).repartition(5)).first()
    assert Q.table_hash(df).first() != Q.table_hash(df.where("a > 0")).first()


def test_forbidden_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, y int, z int")
    assert Q.forbidden_columns(df, {"a": "feature", "y": "outcome"}, {"outcome"}) == ["y", "z"]


def test_closed_form_of_enrichment(spark):
    rows = [(k, d, s, n) for n in (1, 9, 60, 20_000) for s in (0, n // 3, n) for d in (0, n // 20, n) for k in (0, d // 3, d)]
    choose = lambda a, b: math.comb(a, b) if 0 <= b <= a else 0
    got = spark.createDataFrame(rows, "k int, d int, s int, n int").withColumn("p", S.enrichment_p(F.col("k"), F.col("d"), F.col("s"), F.col("n"))).collect()
    for r in got:
        want = Fraction(sum(choose(r.s, i) * choose(r.n - r.s, r.d - i) for i in range(r.k, min(r.d, r.s) + 1)), choose(r.n, r.d)) if r.n < 100 or r.d <= 1000 and r.k == r.d else None
        assert want is None or abs(r.p - float(want)) < 1e-8
        assert -1e-12 <= r.p <= 1 + 1e-7


def test_all_weighted_paths_without_a_beam(spark):
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", 0.9 - 0.1 * b) for a in range(6) for b in range(6) if a != b], "a string, b string, weight double")
    start = spark.createDataFrame([("n0",)], "node string")
    assert G.best_paths(edges, start, 3).count() == 5 + 5 * 4 + 5 * 4 * 3
    assert G.best_paths(edges, start, 3, 2).count() == 6


def test_components_of_a_long_path(spark):
    rows = [(i, i + 1) for i in range(300)] + [(1000, 1001)]
    got = {r.node: r.component for r in G.components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
