import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators import subtypes as S
from assaylake.operators.genesets import rank_biased_overlap, weighted_jaccard


def profile(cohort, members, pathway="p", noise=None):
    return [(pathway, cohort, m, float(len(members) - i + (noise.random() if noise else 0))) for i, m in enumerate(members)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "pathway string, cohort string, member string, weight double")


def found(spark, rows, parts=2, **how):
    got, pairs = S.pathway_subtypes(frame(spark, rows).repartition(parts), "pathway", "cohort", "member", "weight", replicates=40, **how)
    return {(r.pathway, r.cohort): r for r in got.collect()}, {(r.pathway, r.a, r.b): r.similarity for r in pairs.collect()}


def two_groups():
    one, other = [f"x{i}" for i in range(12)], [f"y{i}" for i in range(12)]
    return [r for c in "abc" for r in profile(c, one)] + [r for c in "def" for r in profile(c, other)]


def test_clear_groups_are_stable_and_alike_cohorts_conserved(spark):
    alike = [r for c in "abcd" for r in profile(c, [f"x{i}" for i in range(10)], "q")]
    few = [r for c in "ab" for r in profile(c, ["x"], "few")]
    got, pairs = found(spark, two_groups() + alike + few)
    label = {c: got["p", c].subtype for c in "abcdef"}
    assert label == {"a": 1, "b": 1, "c": 1, "d": 2, "e": 2, "f": 2} and got["p", "a"].status == "HETEROGENEOUS" and got["p", "a"].ari == 1.0
    assert {(got["q", c].status, got["q", c].subtype, got["q", c].k) for c in "abcd"} == {("CONSERVED", 1, 1)}
    assert {(r.status, r.subtype, r.silhouette) for (p, _), r in got.items() if p == "few"} == {("UNAVAILABLE", 0, None)}
    assert pairs["q", "a", "b"] == pytest.approx(1.0) and pairs["p", "a", "d"] == pytest.approx(0.0)


def test_a_split_that_replicates_do_not_find_is_conserved(spark):
    """One shared member makes the split: replicates without it find others, so it doesn't stand, though its silhouette does."""
    rows = []
    for c, mark in zip("abcdef", "xxxyyy"):
        rows += [("p", c, f"{c}{i}", 1.0) for i in range(2)] + [("p", c, mark, 9.0)]
    got, _ = found(spark, rows)
    assert got["p", "a"].proposed == 2 and got["p", "a"].silhouette > 0.25 and got["p", "a"].ari < 0.75
    assert {r.status for r in got.values()} == {"CONSERVED"} and {r.subtype for r in got.values()} == {1}
    loose, _ = found(spark, rows, stable=0.0)
    assert {r.status for r in loose.values()} == {"HETEROGENEOUS"}


def test_same_result_for_any_order_company_and_share(spark, monkeypatch):
    rng = random.Random(4)
    rows = [r for p in "pq" for c in "abcdefg" for r in profile(c, rng.sample([f"m{i}" for i in range(14)], 9), p, rng)]
    one, pairs = found(spark, rows)
    monkeypatch.setattr(S, "SHARE", 7)
    rng.shuffle(rows)
    other, again = found(spark, [r for r in rows if r[0] == "p"], parts=5)
    assert all(one[k] == v for k, v in other.items()) and len(one) == 14 and all(pairs[k] == v for k, v in again.items())


def test_smallest_group_and_least_members(spark):
    rows = two_groups()[: 12 * 4]  # three alike and one other
    got, _ = found(spark, rows)
    assert {r.status for r in got.values()} == {"CONSERVED"} and {r.proposed for r in got.values()} == {1}
    got, _ = found(spark, rows, smallest=1)
    assert [got["p", c].subtype for c in "abcd"] == [1, 1, 1, 2]
    got, _ = found(spark, two_groups() + [("p", "g", "x1", 1.0)], members=2)
    assert got["p", "g"].status == "UNAVAILABLE" and got["p", "a"].status == "HETEROGENEOUS"


def test_similarity_against_the_joins(spark):
    rng = random.Random(6)
    rows = [r for c in "abcd" for r in profile(c, rng.sample([f"m{i}" for i in range(40)], rng.randrange(1, 30)), noise=rng)]
    _, pairs = found(spark, rows)
    ranked = frame(spark, rows).selectExpr("*", "row_number() over (partition by pathway, cohort order by weight desc, member) as rank")
    rbo = rank_biased_overlap(ranked, ["pathway"], "cohort", "member").collect()
    wj = {(r.a, r.b): r.similarity for r in weighted_jaccard(ranked, ["pathway"], "cohort", "member", "weight").collect()}
    assert len(rbo) == 6
    for r in rbo:
        assert pairs["p", r.a, r.b] == pytest.approx(0.5 * r.rbo + 0.5 * wj[r.a, r.b])


def test_repeats_are_expanded_lists():
    """Counts give what lists with repeated members, told apart by their turn, give."""
    rng = np.random.default_rng(2)
    ranks = np.array([[1, 2, 3, 0, 4], [2, 0, 1, 3, 0], [0, 0, 0, 1, 2]])
    weights = np.where(ranks > 0, rng.random(ranks.shape), 0)
    count = np.array([2, 0, 3, 1, 1])
    wide_ranks, wide_weights = np.zeros((3, 7), int), np.zeros((3, 7))
    slots = [(m, t) for m in range(5) for t in range(count[m])]
    for i in range(3):
        order = sorted((s for s in range(7) if ranks[i, slots[s][0]]), key=lambda s: (ranks[i, slots[s][0]], slots[s][1]))
        for k, s in enumerate(order):
            wide_ranks[i, s], wide_weights[i, s] = k + 1, weights[i, slots[s][0]]
    assert np.allclose(S.similarity(ranks, weights, count), S.similarity(wide_ranks, wide_weights, np.ones(7, int)))


def test_linkage_silhouette_and_rand_by_their_definitions():
    rng = np.random.default_rng(3)
    x = rng.random((9, 2))
    d = np.abs(x[:, None] - x[None]).sum(-1)
    cuts, groups = S.linkage_cuts(d, 9), [[i] for i in range(9)]
    while len(groups) > 1:
        a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda ij: d[np.ix_(groups[ij[0]], groups[ij[1]])].mean())
        groups = [g for k, g in enumerate(groups) if k not in (a, b)] + [groups[a] + groups[b]]
        label = cuts[len(groups)]
        assert {frozenset(np.flatnonzero(label == k).tolist()) for k in range(len(groups))} == {frozenset(g) for g in groups}
        if len(groups) > 1:
            widths = []
            for i in range(9):
                own = [j for j in range(9) if label[j] == label[i] and j != i]
                if not own:
                    widths.append(0)
                    continue
                inner, outer = d[i, own].mean(), min(d[i, label == k].mean() for k in set(label.tolist()) - {label[i]})
                widths.append((outer - inner) / max(inner, outer))
            assert S.silhouette(d, label) == pytest.approx(np.mean(widths))
    assert S.rand_index(np.array([0, 0, 1, 1]), np.array([1, 1, 0, 0])) == 1.0
    assert S.rand_index(np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])) == pytest.approx(-0.5)


def test_programs_blend_families_and_labels(spark):
    rows = [(p, *r[1:]) for p in ("p1", "p2", "p3") for r in two_groups()]
    rows += [r for c in "abcdef" for r in profile(c, [f"z{i}" for i in range(6)], "p4")]
    got, pairs = S.pathway_subtypes(frame(spark, rows), "pathway", "cohort", "member", "weight", replicates=20)
    families = spark.createDataFrame([("p1", "f"), ("p2", "f"), ("p3", "g"), ("p4", "g")], "pathway string, family string")
    programs, sims = S.program_subtypes(got, pairs, families, "pathway", "cohort", "family", replicates=30)
    label = {r.cohort: (r.subtype, r.status) for r in programs.collect()}
    assert label == {c: (1 + (c > "c"), "HETEROGENEOUS") for c in "abcdef"}
    s = {(r.a, r.b): (r.similarity, r.pathways) for r in sims.collect()}
    assert s["a", "b"] == (pytest.approx(1.0), 4)  # .7 * 1 + .3, and 1
    assert s["a", "d"] == (pytest.approx((0 + (0 + 1) / 2) / 2), 4)  # families f: 0; g: p3 0, p4 1
    lone, _ = S.program_subtypes(got.where(F.col("cohort") < "c"), pairs, families, "pathway", "cohort", "family", replicates=5)
    assert {r.status for r in lone.collect()} == {"UNAVAILABLE"}
