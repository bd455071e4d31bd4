import random
import statistics

import pytest

from assaylake.operators import modules as M


def planted(seed, groups=4, size=10, targets=40):
    """Members of a group share signs over the group's own targets."""
    rng = random.Random(seed)
    return [(f"e{g}{i}", f"t{j}", (1 if (g + j) % 3 else -1) * (0.5 + 0.1 * rng.random())) for g in range(groups) for i in range(size) for j in range(g * targets // groups, (g + 1) * targets // groups)]


def test_planted_modules_numbers_and_summary(spark):
    rows = planted(1)
    df = spark.createDataFrame(rows + [(None, "t1", 1.0), ("e00", None, 1.0), ("e00", "t1", None)], "e string, t string, w double")
    members, summary = M.modules(df, "e", "t", "w", 8)
    got = {r.e: r for r in members.collect()}
    assert len(got) == 40 and len({(r.module, k[:2]) for k, r in got.items()}) == 4 == len({r.module for r in got.values()})
    strength = {k: sum(abs(w) for e, _, w in rows if e == k) for k in got}
    for k, r in got.items():
        peers = sorted((-strength[x], x) for x in got if got[x].module == r.module)
        assert r.strength == pytest.approx(strength[k]) and r.member_rank == peers.index((-strength[k], k)) + 1 and r.representative == (r.member_rank == 1)
        assert (r.n_edges, r.positive + r.negative) == (10, 10)
    heads = sorted(k for k, r in got.items() if r.representative)
    for s in summary.collect():
        inside = [(t, abs(w)) for e, t, w in rows if got[e].module == s.module]
        total = {}
        for t, w in inside:
            total[t] = total.get(t, 0) + w
        assert (s.members, s.targets, s.n_edges, s.representative) == (10, 10, 100, heads[s.module - 1])
        assert s.mean_abs == pytest.approx(statistics.mean(w for _, w in inside)) and s.median_abs == pytest.approx(statistics.median(w for _, w in inside))
        assert s.top_targets == sorted(total, key=lambda t: (-round(total[t], 9), t))


def test_same_for_any_order_of_rows(spark):
    rng = random.Random(5)
    rows = [(i, j, rng.gauss(0, 1)) for i in range(60) for j in range(30) if rng.random() < 0.4]
    seen = []
    for parts in (1, 6):
        rng.shuffle(rows)
        members, _ = M.modules(spark.createDataFrame(rows, "e int, t int, w double").repartition(parts), "e", "t", "w", 6)
        seen.append({(r.e, r.module, r.member_rank) for r in members.collect()})
    assert seen[0] == seen[1] and len(seen[0]) == 60


def test_few_rows(spark):
    none = spark.createDataFrame([], "e string, t string, w double")
    assert [x.count() for x in M.modules(none, "e", "t", "w")] == [0, 0]
    one = M.modules(spark.createDataFrame([("a", "x", -2.0), ("a", "y", 1.0)], none.schema), "e", "t", "w")
    assert [tuple(r) for r in one[0].collect()] == [("a", 1, 1, 3.0, 2, 1, 1, True)] and one[1].first().top_targets == ["x", "y"]
    flat = M.modules(spark.createDataFrame([("a", "x", 0.0), ("b", "x", 0.0), ("b", "y", 1.0)], none.schema), "e", "t", "w")[0]
    assert {(r.e, r.module) for r in flat.collect()} == {("a", 1), ("b", 2)}


@pytest.mark.parametrize("bins", [1, 3, 255])
def test_medians_equal_a_sort(spark, bins):
    rng = random.Random(bins)
    rows = [(g, rng.choice([rng.random(), 0.25, 0.5])) for g in "abcd" for _ in range(rng.randrange(1, 60))] + [("one", 2.0), ("two", 1.0), ("two", 4.0), ("one", None)]
    got = {r.g: r.median for r in M.medians(spark.createDataFrame(rows, "g string, v double"), "g", "v", bins).collect()}
    assert got == {g: pytest.approx(statistics.median(v for h, v in rows if h == g and v is not None)) for g in {g for g, _ in rows}}


def test_edges_are_worked_out_once(spark):
    """The rows of the edges come from a step that counts how often it runs."""
    seen = spark.sparkContext.accumulator(0)

    def row(r):
        seen.add(1)
        return r

    rows = planted(3)
    edges = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(row), "e string, t string, w double")
    members, summary = M.modules(edges, "e", "t", "w", 8)
    assert members.count() == 40 and summary.count() == 4 and seen.value == len(rows)
