import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators import grouping as G


def sequential(z, contexts, train, size, smallest, quantile, multiplier):
    """One seed after the other."""
    near, spread = {}, []
    for i in range(len(z)):
        own = [j for j in range(len(z)) if contexts[j] == contexts[i]]
        order = sorted(own, key=lambda j: (j != i, np.sqrt(((z[i] - z[j]) ** 2).sum()), j))[: size * multiplier]
        near[i] = [(j, np.sqrt(((z[i] - z[j]) ** 2).sum())) for j in order]
        if train[i] and len(order) >= size:
            spread.append(near[i][size - 1][1])
    radius = float(np.quantile(spread, quantile))
    wanted = {i: [j for j, d in v if d <= radius or j == i] for i, v in near.items()}
    used, seed = set(), {}
    for i in sorted(wanted, key=lambda i: (len(wanted[i]), i)):
        free = [j for j in wanted[i] if j not in used]
        if i in used or len(free) < smallest:
            continue
        for j in free[:size]:
            used.add(j)
            seed[j] = i
    return seed, radius


@pytest.mark.parametrize("block, seed, copies", [(2048, 1, 0), (7, 2, 12), (16, 3, 30)])
def test_rounds_give_the_sequential_result(spark, monkeypatch, block, seed, copies):
    monkeypatch.setattr(G, "BLOCK", block)
    rng = np.random.default_rng(seed)
    z = np.round(rng.normal(size=(110, 3)), 3)
    z[:copies] = z[copies]
    contexts = [("ab"[i % 2], "TB"[i // 2 % 2]) for i in range(110)] if copies < 30 else [("a", "T")] * 104 + [("b", "T")] * 4 + [("a", "B")] * 2
    train = [c[0] == "a" for c in contexts]
    df = spark.createDataFrame([(*c, i, v.tolist()) for i, (c, v) in enumerate(zip(contexts, z))], "donor string, type string, cell long, z array<double>").repartition(3)
    got, radius = G.disjoint_groups(df, ["donor", "type"], "cell", "z", F.col("donor") == "a")
    rows = got.collect()
    want, r = sequential(z, contexts, train, 5, 3, 0.9, 4)
    assert radius == pytest.approx(r) and len(rows) == 110
    assert {x.cell: x.seed for x in rows if x.seed is not None} == want and want
    members = {}
    for x in rows:
        if x.seed is not None:
            members.setdefault(x.seed, set()).add((x.donor, x.type))
    assert all(len(v) == 1 for v in members.values())


def test_no_training_context_is_an_error(spark):
    df = spark.createDataFrame([("a", 1, [0.0]), ("a", 2, [1.0])], "donor string, cell long, z array<double>")
    with pytest.raises(ValueError):
        G.disjoint_groups(df, ["donor"], "cell", "z", F.col("donor") == "a")


def test_space_is_fitted_on_training_rows_only(spark):
    rng = np.random.default_rng(5)
    rows = [("q" if i > 39 else "t", i, rng.normal(size=4).tolist()) for i in range(60)]
    z = lambda rows: {r.cell: r.z for r in G.local_space(spark.createDataFrame(rows, "d string, cell long, v array<double>"), "v", F.col("d") == "t", 2).where("d = 't'").collect()}
    assert z(rows) == z([(d, i, v if d == "t" else [x * 1e4 for x in v]) for d, i, v in rows])


def test_no_round_sends_a_table_to_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([("a", i, rng.normal(size=2).tolist()) for i in range(40)], "donor string, cell long, z array<double>")
    plans, written = [], G._written
    monkeypatch.setattr(G, "_written", lambda t, name: plans.append(t._jdf.queryExecution().executedPlan().toString()) or written(t, name))
    out, _ = G.disjoint_groups(df, ["donor"], "cell", "z", F.col("donor") == "a")
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)
