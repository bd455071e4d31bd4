"""Steps whose rows a task must hold: the same results, with fewer rows at once."""

import random

import pytest
from pyspark.sql import functions as F

from assaylake.operators import extended as X
from assaylake.operators import graph as G
from assaylake.operators import joins as J
from assaylake.plans import binding, registry

SF = "/root/testdata/sf0.001"
plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()


def test_layered_paths_of_repeated_rows_in_any_number_of_tasks(spark):
    rng = random.Random(1)
    first = [(f"s{rng.randrange(4)}", rng.randrange(12)) for _ in range(60)]
    middle = [(rng.randrange(12), rng.randrange(12)) for _ in range(60)]
    last = [(rng.randrange(12), f"t{rng.randrange(3)}") for _ in range(20)]
    paths = {(s, t, 2, m, -1) for s, m in first for n, t in last if m == n} | {(s, t, 3, m, b) for s, m in first for a, b in middle if a == m != b for n, t in last if n == b}
    want = set()
    for s, t in {p[:2] for p in paths}:
        want |= {(*p, i + 1) for i, p in enumerate(sorted(p for p in paths if p[:2] == (s, t))[:3])}
    tables = [spark.createDataFrame(r, k) for r, k in ((first, "source string, m1 int"), (middle, "m1 int, m2 int"), (last, "m2 int, target string"))]
    for parts in (None, 1, 7):
        got = [(r.source, r.target, r.length, r.m1, -1 if r.m2 is None else r.m2, r["rank"]) for r in G.layered_paths(*tables, 3, parts).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_paired_arms_join_once_and_refuse_other_rows(spark):
    assert plan(registry.QUERIES["sta22_paired_arms"](spark, SF)).count("Join") == 1
    rows = spark.createDataFrame([(1, "x", 1.0, 0.5), (2, "x", 0.0, 0.5)], "k int, g string, y double, s double")
    assert X.paired_arms(rows, rows, ["k"], ["g"], "y", "s").first().n == 2
    for other in (rows.limit(1), rows.unionAll(rows.limit(1)), rows.withColumn("y", F.col("y") + 1)):
        with pytest.raises(ValueError):
            X.paired_arms(rows, other, ["k"], ["g"], "y", "s")


def test_beam_search_keeps_ties_and_leaves_the_rest_out_early(spark):
    rng = random.Random(2)
    w = {(f"n{a:02}", f"n{b:02}"): rng.choice([0.1, 0.5, 0.5, 0.9, 1.0]) for a in range(15) for b in range(15) if a != b and rng.random() < 0.8}
    found = G.best_paths(spark.createDataFrame([(*k, x) for k, x in w.items()], "a string, b string, weight double"), spark.createDataFrame([("n00",), ("n07",)], "node string"), 4, 3)
    assert "Window" not in plan(found)  # fronts are tables, so a hop does not work the ones before it out again
    want = []
    for s in ("n00", "n07"):
        front = [((s,), 1.0)]
        for _ in range(4):
            steps = [((*p, b), x * w[p[-1], b]) for p, x in front for a, b in w if a == p[-1] and b not in p]
            front = sorted(steps, key=lambda r: (-round(r[1], 12), r[0]))[:3]
            want += front
    assert sorted((tuple(r.path), round(r.score, 12)) for r in found.collect()) == sorted((p, round(x, 12)) for p, x in want)


def test_components_are_summed_up_once(spark):
    one = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.7), (1, 2, 0.1)], "s int, p int, a double")
    two, coarse = spark.createDataFrame([(1, 1, 3.0), (2, 1, 4.0)], "s int, p int, b double"), spark.createDataFrame([(1, 9.0)], "s int, c double")
    got = J.merge_components([(one, ["s", "p"]), (two, ["s", "p"]), (coarse, ["s"])], ["s", "p"], {"a": 0, "b": 0, "c": 0}, 5)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0.7, 3.0, 9.0), (1, 2, 0.1, 0.0, 9.0), (2, 1, 0.0, 4.0, 0.0)]
    assert plan(registry.QUERIES["joi02_components"](spark, SF)).count("Aggregate") == 2


def test_typed_binding_puts_facts_of_an_accession_together(spark):
    rng = random.Random(3)
    facts = [(rng.randrange(3), rng.choice([0, 1, None]), rng.choice([5, 6, None]), "c", "a", rng.random() < 0.5) for _ in range(80)]
    gene, accession = [(0, "P", 0.5), (1, "Q", -0.5)], [(5, "P", -2.0), (5, "R", 0.1), (6, "R", None)]
    want = {}
    for e, g, x, _, _, exact in facts:
        for key, mapping, name in ((g, gene, "gene"), (x, accession, "accession")):
            for lookup, protein, weight in mapping:
                if key is not None and lookup == key:
                    weights, routes = want.setdefault((e, protein), ([], set()))
                    routes.add(name), weights.append(None if weight is None else (1.0 if exact else 0.4) * weight)
    k = "lookup int, protein string, weight double"
    found = X.typed_binding(spark.createDataFrame(facts, "entity int, gene int, accession int, cohort string, assay string, exact boolean"), spark.createDataFrame(gene, k), spark.createDataFrame(accession, k))
    got = {(r.entity, r.protein): (r.weight, r.routes) for r in found.collect()}
    assert got == {key: (max((x for x in weights if x is not None), default=None), ";".join(sorted(routes))) for key, (weights, routes) in want.items()}
    assert "collect_set" not in plan(found)


def test_line_items_move_for_orders_and_parts_only(spark, monkeypatch):
    t = binding.Tables(spark, SF)
    monkeypatch.setattr(binding, "ROWS", 100)
    n = t.lineitem.count()
    assert t.parts("lineitem") == -(-n // 100)
    shown = plan(t.sales())
    assert f"RepartitionByExpression [l_orderkey" in shown and t.sales().count() == n  # every line item has its order, customer and part
