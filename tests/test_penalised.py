import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators import blocks as B
from assaylake.operators import penalised as P


def data(seed, n=60, entities=25, targets=4):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, entities)) < 0.7, rng.normal(size=(n, entities)), 0)
    x[:, 3] = 1.5
    y = rng.normal(size=(n, targets))
    y[:, 0] += 2 * x[:, 0] - x[:, 1]
    y[:, 1] += 0.7 * x[:, 2]
    y[:, 3:] = 5
    return x, y, np.arange(n) % 5


def frames(spark, x, y, fold, group="g"):
    long = lambda m, tag: [(group, f"s{i:03}", f"{tag}{j:02}", float(m[i, j])) for i in range(len(m)) for j in range(m.shape[1]) if m[i, j]]
    return (
        spark.createDataFrame(long(x, "e"), "c string, s string, e string, v double"), spark.createDataFrame(long(y, "t"), "c string, s string, t string, w double"),
        spark.createDataFrame([(group, f"s{i:03}", int(f)) for i, f in enumerate(fold)], "c string, s string, fold int"),
    )


def standardised(x, fit):
    keep = x[fit].std(0) > 1e-12
    return ((x - x[fit].mean(0)) / np.where(x[fit].std(0) > 0, x[fit].std(0), 1))[:, keep]


@pytest.mark.parametrize("cells", [200, 1 << 20])
def test_ridge_against_direct_solves(spark, monkeypatch, cells):
    monkeypatch.setattr(B, "CELLS", cells)
    x, y, fold = data(1)
    grid = (100.0, 1.0, 0.01)
    got = {(r.s, r.t): r for r in P.ridge(*frames(spark, x, y, fold), ["c"], "s", "fold", ("e", "v"), ("t", "w"), penalties=grid).collect()}
    assert len(got) == y.size
    for f in range(5):
        inner, after, rest, own = (np.flatnonzero(m) for m in ((fold != f) & (fold != (f + 1) % 5), fold == (f + 1) % 5, fold != f, fold == f))
        for j in range(y.shape[1]):

            def model(fit, ask, penalty):
                z, mean = standardised(x, fit), y[fit, j].mean()
                if penalty is None:
                    return np.full(len(ask), mean)
                b = np.linalg.solve(z[fit].T @ z[fit] + penalty * z.shape[1] * np.eye(z.shape[1]), z[fit].T @ (y[fit, j] - mean))
                return z[ask] @ b + mean

            errors = {p: ((model(inner, after, p) - y[after, j]) ** 2).mean() for p in (None, *grid)}
            best = min((None, *grid), key=lambda p: errors[p])
            guess = model(rest, own, best)
            for i, v in zip(own, guess):
                r = got[f"s{i:03}", f"t{j:02}"]
                assert (r.fold, r.penalty) == (f, best) and r.predicted == pytest.approx(v, abs=1e-8) and r.observed == pytest.approx(y[i, j]) and r.baseline == pytest.approx(y[rest, j].mean())


def test_own_outcomes_and_features_of_others_change_nothing(spark):
    x, y, fold = data(2, 40, 6, 2)
    run = lambda x, y: {(r.s, r.t): r.predicted for r in P.ridge(*frames(spark, x, y, fold), ["c"], "s", "fold", ("e", "v"), ("t", "w")).where("fold = 0").collect()}
    one = run(x, y)
    y2 = y.copy()
    y2[fold == 0] *= -3
    assert run(x, y2) == pytest.approx(one)


def test_path_meets_the_conditions_of_the_optimum():
    rng = np.random.default_rng(4)
    z = rng.normal(size=(50, 12))
    z[:, 5] = z[:, 4] + 0.01 * rng.normal(size=50)
    z = (z - z.mean(0)) / z.std(0)
    y = z[:, 0] - 0.5 * z[:, 4] + rng.normal(size=50)
    y -= y.mean()
    product, gram = z.T @ y / 50, z.T @ z / 50
    grid = np.abs(product).max() * np.array([1, 0.3, 0.1, 0.01])
    for penalty, b in zip(grid, P.path(gram, product, grid)):
        slope = product - gram @ b
        assert np.abs(slope).max() <= penalty + 1e-6 and np.allclose(slope[b != 0], penalty * np.sign(b[b != 0]), atol=1e-6)


def ranks(v):
    return np.array([sum(w < a for w in v) + (sum(w == a for w in v) + 1) / 2 for a in v])


def screen(x, y, cut, fdr):
    n, p, rho = len(y), [], []
    for j in range(x.shape[1]):
        a, b = ranks(x[:, j]), ranks(y)
        r = np.corrcoef(a, b)[0, 1] if a.std() > 0 and b.std() > 0 else np.nan
        rho.append(r)
        p.append(float(B.p_of(np.array(r), np.array(n - 2))) if np.isfinite(r) else 1.0)
    order, q, least = np.argsort(p, kind="stable"), np.ones(len(p)), 1.0
    strong = [j for j in order if np.isfinite(rho[j]) and abs(rho[j]) >= cut]
    for k in range(len(strong) - 1, -1, -1):
        least = min(least, p[strong[k]] * len(p) / (k + 1))
        q[strong[k]] = least
    return np.array([j for j in sorted(strong) if q[j] <= fdr], int)


def test_screened_lasso_against_rows(spark):
    """Screens, paths on standardised rows, validation errors, weights: all from the rows themselves."""
    x, y, fold = data(6, 80, 14, 3)
    ratios = np.array([1, 0.5, 0.2, 0.05])
    w = P.screened_lasso(*frames(spark, x, y[:, :3], fold), ["c"], "s", "fold", ("e", "v"), ("t", "w"), ratios=tuple(ratios)).cache()
    got = {}
    for r in w.collect():
        got.setdefault((r.t, r.fold), {})[r.e] = r
    for j, f in itertools.product(range(3), range(5)):
        after = (f + 1) % 5

        def path_of(rows, chosen, upto):
            z = x[rows][:, chosen]
            mean, sd = z.mean(0), z.std(0)
            mu, sy = y[rows, j].mean(), y[rows, j].std()
            zs, ys = (z - mean) / sd, (y[rows, j] - mu) / sy
            product = zs.T @ ys / len(rows)
            b = P.path(zs.T @ zs / len(rows), product, np.abs(product).max() * ratios[:upto])
            b[ratios[:upto] >= 1] = 0
            b = b * sy / sd
            return mu - b @ mean, b

        inner, rest = np.flatnonzero((fold != f) & (fold != after)), np.flatnonzero(fold != f)
        chosen = screen(x[inner], y[inner, j], 0.2, 0.05)
        errors = np.full(4, ((y[fold == after, j] - y[inner, j].mean()) ** 2).mean())
        if len(chosen):
            start, b = path_of(inner, chosen, 4)
            errors = ((start[:, None] + b @ x[fold == after][:, chosen].T - y[fold == after, j]) ** 2).mean(1)
        pick = int(np.flatnonzero(errors <= errors.min() + 1e-9)[0])
        final = screen(x[rest], y[rest, j], 0.2, 0.05)
        want = {None: y[rest, j].mean()}
        if len(final):
            start, b = path_of(rest, final, pick + 1)
            want = {None: start[-1]} | {f"e{k:02}": v for k, v in zip(final, b[-1]) if v}
        own = got[f"t{j:02}", f]
        assert {e: r.weight for e, r in own.items()} == {e: pytest.approx(v, abs=1e-6) for e, v in want.items()}
        assert own[None].ratio == ratios[pick] and own[None].validation_mse == pytest.approx(errors[pick]) and own[None].screened == len(final)
    kept = {(r.t, r.e): r for r in P.selection(w, ["c"], "t", "e").collect()}
    assert kept["t00", "e00"].frequency == 1.0 and kept["t00", "e00"].weight > 1 and kept["t00", "e00"].same_sign
    w.unpersist()


def test_arms_must_hold_the_same_rows(spark):
    rows = [(i, float(i), i + 0.5, 4.5) for i in range(10)]
    arm = lambda rows: spark.createDataFrame(rows, "i long, observed double, predicted double, baseline double").withColumn("g", F.lit("g"))
    got = {r.arm: r for r in P.arms_compared({"one": arm(rows), "two": arm([(i, o, 4.5, b) for i, o, _, b in rows])}, ["i"], ["g"]).collect()}
    assert got["one"].rmse == pytest.approx(0.5) and got["two"].r2 == pytest.approx(0) and got["two"].skill == pytest.approx(0) and got["one"].skill == pytest.approx(1 - 2.5 / 82.5)
    for bad in (rows[1:], [(i, o + (i == 3), p, b) for i, o, p, b in rows]):
        with pytest.raises(ValueError):
            P.arms_compared({"one": arm(rows), "two": arm(bad)}, ["i"], ["g"])


def test_ridge_of_few_entities_makes_no_matrix_of_samples_and_agrees_with_kernels(spark, monkeypatch):
    x, y, fold = data(9, 80, 12, 4)
    x[:, 5] = 0.1
    monkeypatch.setattr(B, "CELLS", 150)
    tables, names, how = frames(spark, x, y, fold), (["c"], "s", "fold", ("e", "v"), ("t", "w")), {"folds": 5, "fill": 0.0, "penalties": (10.0, 0.1), "least": 3}
    rows = lambda df: {(r.s, r.t): (r.fold, r.observed, r.predicted, r.baseline, r.penalty or -1) for r in df.collect()}
    slow = rows(P._by_kernel(*tables, *names, **how))

    def no_kernel(*_, **__):
        raise AssertionError("a kernel of samples for fewer entities than samples")

    monkeypatch.setattr(P, "_by_kernel", no_kernel)
    fast = rows(P.ridge(*tables, *names, **how))
    assert fast.keys() == slow.keys() and len(fast) == y.size
    assert all(fast[k] == pytest.approx(slow[k], abs=1e-9) for k in slow)


def test_arms_of_one_pass_equal_models_of_their_own(spark):
    x, y, fold = data(10, 60, 10, 3)
    tx, ty, ts = frames(spark, x, y, fold)
    names, rows = (["c"], "s", "fold", ("e", "v"), ("t", "w")), lambda df: {(r.s, r.t): (r.observed, r.predicted, r.baseline, r.penalty or -1) for r in df.collect()}
    kind = F.when(F.col("e") < "e04", "a").otherwise("b")
    got = P.ridge_arms(tx.withColumn("k", kind), ty, ts, *names[:3], *names[3:], "k", {"one": ["a"], "both": ["a", "b"]}).persist()
    for arm, some in (("one", tx.where("e < 'e04'")), ("both", tx)):
        one, other = rows(got.where(F.col("arm") == arm)), rows(P.ridge(some, ty, ts, *names))
        assert one.keys() == other.keys() and all(one[k] == pytest.approx(other[k], abs=1e-9) for k in other)


def test_ridge_takes_groups_of_few_and_of_many_entities_together(spark):
    few, many = data(11, 50, 8, 2), data(12, 30, 45, 2)
    tables = [a.unionByName(b) for a, b in zip(frames(spark, *few, "few"), frames(spark, *many, "many"))]
    rows = lambda df: {(r.c, r.s, r.t): (r.predicted, r.penalty or -1) for r in df.collect()}
    names = (["c"], "s", "fold", ("e", "v"), ("t", "w"))
    got, alone = rows(P.ridge(*tables, *names)), {}
    for d, name in ((few, "few"), (many, "many")):
        alone |= rows(P._by_kernel(*frames(spark, *d, name), *names, folds=5, fill=0.0, penalties=P.PENALTIES, least=3))
    assert got.keys() == alone.keys() and all(got[k] == pytest.approx(alone[k], abs=1e-7) for k in got)
