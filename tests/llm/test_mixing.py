import numpy as np

from assaylake.llm import mixing as M


def test_marginals_reach_their_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(a, b, c, int(rng.integers(10, 1000))) for a in "pqr" for b in "xy" for c in "uvw"]
    cells = spark.createDataFrame(rows, "source_ string, lang_ string, topic_ string, tokens long")
    want = {"source_": {"p": 0.5, "q": 0.3, "r": 0.2}, "lang_": {"x": 0.6, "y": 0.4}, "topic_": {"u": 0.2, "v": 0.2, "w": 0.6}}
    targets = {d: spark.createDataFrame(list(t.items()), f"{d} string, target double") for d, t in want.items()}
    got = M.fit(cells, targets, 30).toPandas()
    for d, t in want.items():
        assert np.allclose((got.groupby(d).w.sum() / got.tokens.sum()).loc[list(t)], list(t.values()), atol=1e-9)


def test_brute_force_fit(spark):
    rows = [("p", "x", "u", 5), ("p", "y", "u", 50), ("q", "x", "v", 500), ("q", "y", "u", 7)]
    cells = spark.createDataFrame(rows, "source_ string, lang_ string, topic_ string, tokens long")
    got = {r[:3]: r.w for r in map(lambda r: r, M.fit(cells, {d: M.tempered(cells, d, 0.5) for d in M.DIMENSIONS}, 3).select(*M.DIMENSIONS, "w").collect())}
    w = {r[:3]: float(r[3]) for r in rows}
    total = sum(w.values())
    targets = []
    for d in range(3):
        sums = {}
        for k, v in zip([r[d] for r in rows], [r[3] for r in rows]):
            sums[k] = sums.get(k, 0) + v
        z = sum(s**0.5 for s in sums.values())
        targets.append({k: s**0.5 / z for k, s in sums.items()})
    for _ in range(3):
        for d in range(3):
            sums = {}
            for k, v in w.items():
                sums[k[d]] = sums.get(k[d], 0) + v
            w = {k: v * targets[d][k[d]] * total / sums[k[d]] for k, v in w.items()}
    assert all(abs(got[k] - w[k]) < 1e-9 * w[k] for k in w)


def test_odd_rows_and_clashing_names(spark):
    docs = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, "x | y", None, None, 5), (3, None, "en", "s", None), (4, "", "de", "t", 0), (5, "word " * 100_000, "en", "s", 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    for names in (("mix", "tokens", "multiplier"), ("MIX_cell", "source_", "copies")):
        own = df.withColumns({name: df.n_chars + 1 for name in names})
        out = M.own_name(own)
        got = M.weighted(own, sweeps=2).collect()
        assert len(got) == 6 and all(r[out].copies >= 0 and r[out].expected >= 0 for r in got)
        assert {(r.doc_id, *(r[n] for n in names)) for r in got} == {(d[0], *[d[4] if d[4] is None else d[4] + 1] * 3) for d in docs}
        assert M.sample(own, sweeps=2).columns == own.columns
    assert M.sample(df.limit(0), sweeps=2).count() == 0


def test_the_mix_meets_its_targets(spark):
    rng = np.random.default_rng(4)
    docs = [(i, "w " * int(rng.integers(5, 60)), "en" if rng.random() < 0.8 else "de", "s" if rng.random() < 0.9 else "t", 0) for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    want = {"source_": {"s": 0.6, "t": 0.4}, "lang_": {"en": 0.5, "de": 0.5}}
    targets = {d: spark.createDataFrame(list(t.items()), f"{d} string, target double") for d, t in want.items()} | {"topic_": spark.createDataFrame([("prose", 1.0)], "topic_ string, target double")}
    got = M.sample(df, targets=targets).select("source", "lang", M.tokens().alias("n")).toPandas()
    total = sum(len(d[1].split()) + 1 for d in docs)
    assert abs(got.n.sum() / total - 1) < 0.02
    for d, t in want.items():
        assert np.allclose((got.groupby(d[:-1]).n.sum() / got.n.sum()).loc[list(t)], list(t.values()), atol=0.02)


def test_contradicting_targets_are_told(spark):
    import pytest

    cells = spark.createDataFrame([("p", "x", "u", 5), ("q", "y", "u", 5)], "source_ string, lang_ string, topic_ string, tokens long")
    frame = lambda d, t: spark.createDataFrame(list(t.items()), f"{d} string, target double")
    with pytest.warns(UserWarning, match="off its target"):
        M.fit(cells, {"source_": frame("source_", {"p": 0.9, "q": 0.1}), "lang_": frame("lang_", {"x": 0.1, "y": 0.9}), "topic_": frame("topic_", {"u": 1.0})}, 3)
