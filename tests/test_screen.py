import numpy as np
import pytest

from assaylake.operators import blocks as B
from assaylake.operators import screen as S


def cells(seed, sources=5, n=60, entities=12, targets=160, planted=6):
    """Each entity drives `planted` targets of its own."""
    rng = np.random.default_rng(seed)
    x, y = [], []
    for d in range(sources):
        for c in range(n):
            e = np.where(rng.random(entities) < 0.8, rng.random(entities) + 0.1, 0)
            t = rng.random(targets)
            for i in range(entities):
                t[i * planted : (i + 1) * planted] += (1.2 if i % 2 else -1.2) * e[i]
            x += [(f"d{d}", f"c{c}", f"e{i}", float(v)) for i, v in enumerate(e) if v]
            y += [(f"d{d}", f"c{c}", f"t{i}", float(v)) for i, v in enumerate(t)]
        x += [(f"d{d}", f"c{c}", "flat", 1.0) for c in range(n)]
    x += [("lone", "c", "e0", 1.0)]
    return x, y


@pytest.mark.parametrize("block", [7, 2048])
def test_screen_recall_and_exact_values(spark, monkeypatch, block):
    monkeypatch.setattr(S, "ROWS", block)
    x, y = (spark.createDataFrame(r, f"d string, c string, {n} string, v double") for r, n in zip(cells(1), "et"))
    args = (x, y, x.select("d", "c").distinct(), "d", "c", ("e", "v"), ("t", "v"))
    got = {(r.e, r.t): r for r in S.screened_pairs(*args, top=6, oversample=4).collect()}
    exact = B.associate(*args[:3], ["d"], *args[4:], min_n=3, tested=False)
    want = {(r.e, r.t): r for r in S.combined(exact, "e", "t", top=6).collect()}
    assert len(want) == 72 and len(set(got) & set(want)) >= 0.9 * len(want)
    for k in set(got) & set(want):
        a, b = got[k], want[k]
        assert a.sources == b.sources == 5 and a.agreement == b.agreement and a.meta_rho == pytest.approx(b.meta_rho) and a.mean_rho == pytest.approx(b.mean_rho) and a.p == pytest.approx(b.p, abs=1e-12)
    assert not any(e == "flat" for e, _ in got)


def test_all_pairs_proposed_is_the_exact_way(spark):
    x, y = (spark.createDataFrame(r, f"d string, c string, {n} string, v double") for r, n in zip(cells(2, 4, 15, 4, 20, 2), "et"))
    args = (x, y, x.select("d", "c").distinct(), "d", "c", ("e", "v"), ("t", "v"))
    got = {(r.e, r.t, r.rank): r.meta_rho for r in S.screened_pairs(*args, top=5, oversample=100).collect()}
    exact = B.associate(*args[:3], ["d"], *args[4:], min_n=3, tested=False)
    assert got == {(r.e, r.t, r.rank): pytest.approx(r.meta_rho) for r in S.combined(exact, "e", "t", top=5).collect()}


def test_combined_by_hand(spark):
    rows = [("e", "t", r) for r in (0.5, 0.6, -0.1)] + [("e", "u", 0.3), ("e", "u", None)] + [("e", "v", 0.4)] * 3
    got = {r.t: r for r in S.combined(spark.createDataFrame(rows, "e string, t string, rho double"), "e", "t").collect()}
    z = np.arctanh([0.5, 0.6, -0.1])
    assert set(got) == {"t", "v"} and got["t"].meta_rho == pytest.approx(np.tanh(z.mean())) and got["t"].agreement == pytest.approx(2 / 3)
    t = z.mean() / (z.std(ddof=1) / np.sqrt(3))
    assert got["t"].p == pytest.approx(float(B.t_tail(np.array(t), np.array(2)))) and got["v"].p == 0.0 and got["v"].rank == 1
