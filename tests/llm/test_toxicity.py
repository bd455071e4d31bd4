import random

import numpy as np

from assaylake.llm import toxicity as T


def make(n=400, seed=1):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in "ba ce di fo gu".split() for b in "lan mor tis vex pud".split()]
    rude = ["grumf", "zlotz", "snark"]
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 40))]
        for _ in range(3 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(rude) + rng.choice(["", "ish", "ling"]))
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(bad), "y"))
    return docs, labels


def test_nearest_is_exact():
    rng = random.Random(2)
    names = [f"t{i}" for i in range(60)]
    vocabulary = {t: 1 + rng.random() * 4 for t in names}
    examples = []
    for i in range(700):
        own = sorted(rng.sample(names, rng.randrange(1, 12)))
        examples.append((i, i % 2, i, own, [rng.randrange(1, 4) for _ in own]))
    index = T.Index(vocabulary, examples, 0.1)
    dense = np.zeros((700, 60))
    for r, (*_, own, counts) in enumerate(examples):
        ids, w = index.vector(dict(zip(own, counts)))
        dense[r, ids] = w
    for _ in range(200):
        ids, w = index.vector({t: rng.randrange(1, 4) for t in rng.sample(names, rng.randrange(1, 15))})
        q = np.zeros(60)
        q[ids] = w
        want = dense @ q
        order = np.lexsort((np.arange(700), -np.round(want, 12)))[: T.K]
        order = order[want[order] > 1e-12]
        rows, near = index.nearest(ids, w)
        assert np.allclose(near, want[order]) and set(rows[near > near[-1] + 1e-9]) == set(order[want[order] > near[-1] + 1e-9])


def test_held_out_accuracy_and_evidence(spark):
    docs, labels = make()
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    index = T.fit(d, lab.where("doc_id % 3 != 1"))
    got = {r.doc_id: r for r in T.score(d, index).collect()}
    assert np.mean([got[i].predicted == t for i, t, _ in labels if i % 3 == 1]) > 0.97
    assert all(e.label in (0, 1) and 0 < e.cosine < 1 + 1e-9 for r in got.values() for e in r.evidence)


def test_odd_rows(spark):
    docs, labels = make(100)
    d = spark.createDataFrame([*docs, (900, None, "x"), (901, "", "x"), (902, "12 %%", "x"), (903, "grumf " * 90_000, "x"), (0, docs[0][1], "x")], "doc_id long, text string, z string")
    lab = spark.createDataFrame([*[x[:2] for x in labels], (5, None), (5, 1), (5, 0)], "doc_id long, toxic int")
    index = T.fit(d, lab)
    got = [(r.doc_id, r.score) for r in T.score(d, index).collect()]
    assert len(got) == 105 and {s for i, s in got if i in (900, 901, 902)} == {index.base} and dict(got)[903] > 0.7
    empty = T.fit(d, lab.limit(0))
    assert {r.score for r in T.score(d, empty).collect()} == {0.0}
    assert T.score(d.limit(0), index).count() == 0


def test_scores_against_a_plain_search(spark):
    """Every text's neighbours and score from dense vectors over all terms, and the calibration's order."""
    docs, labels = make(300, 7)
    docs.append((999, docs[3][1] + " " + docs[4][1], "x"))
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    index = T.fit(d, lab.where("doc_id % 3 != 1"))
    known = {i: t for i, t, _ in labels if i % 3 != 1}
    rows = [(i, t) for i, t, _ in docs if i in known]
    different = {(t, known[i]) for i, t in rows}
    held, bad = T.Counter(), T.Counter()
    for t, y in different:
        held.update(set(T.terms(t)))
        bad.update(set(T.terms(t)) if y else ())
    base = np.mean(list(known.values()))

    def weight(t):
        n, q = held[t], bad[t] / held[t]
        low = (q + 1.96**2 / 2 / n - 1.96 * np.sqrt(q * (1 - q) / n + 1.96**2 / 4 / n / n)) / (1 + 1.96**2 / n)
        return np.log((1 + len(different)) / n) * (T.FLOOR + max(0.0, (low - base) / (1 - base)))

    names = sorted(held)
    weights = np.array([weight(t) for t in names])

    def unit(text):
        v = np.array([1 + np.log(c) if (c := T.terms(text)[t]) else 0.0 for t in names]) * weights
        return v / (np.linalg.norm(v) or 1)

    dense = np.stack([unit(t) for _, t in sorted(rows)])
    got = {r.doc_id: r for r in T.score(d, index).collect()}
    for i, text, _ in docs[::9]:
        cosines = dense @ unit(text)
        best = np.sort(cosines[cosines > 1e-12])[::-1][: T.K]
        assert np.allclose([e.cosine for e in got[i].evidence], best)
    assert index.knots[1] == sorted(index.knots[1]) and 0 <= index.knots[1][0] and index.knots[1][-1] <= 1
    shares = sorted((index.votes(t)[0], got[i].score) for i, t, _ in docs)
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(shares, shares[1:]))


def test_text_keys_and_one_label_only(spark):
    docs, labels = make(60)
    d = spark.createDataFrame([(f"d{i}", t) for i, t, _ in docs], "doc_id string, text string")
    lab = spark.createDataFrame([(f"d{i}", y) for i, y, _ in labels], "doc_id string, toxic int")
    assert T.score(d, T.fit(d, lab)).count() == 60
    assert {r.score for r in T.score(d, T.fit(d, lab.where("toxic = 0"))).collect()} == {0.0}
    assert T.score(d, T.fit(d.limit(0), lab)).count() == 60 and T.score(d.limit(0), T.fit(d, lab)).count() == 0


def test_driver_holds_no_object_a_term(spark):
    """The fitted index has its terms as one Arrow array; numbers of terms are made where a text is scored."""
    docs, labels = make(120, 3)
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic string")
    index = T.fit(d, spark.createDataFrame([x[:2] for x in labels], "doc_id long, toxic int"))
    n = len(index.term_weights)
    assert n > 30 and not any(isinstance(v, (dict, list)) and len(v) == n for v in vars(index).values())
    assert index.terms.to_pylist() == sorted({t for _, text, _ in docs for t in T.terms(text)})
    assert index.score(docs[0][1])[0] > 0.5 and len(index.ids) == n


def test_gathered_rows_come_compressed_and_in_order(spark):
    rows = spark.range(30_000).selectExpr("30000 - id AS id", "concat('a rather long text ', id % 7) AS t", "array(id, null) AS a").repartition(5).orderBy("id")
    got = T.gathered(rows)
    assert got.to_pylist() == [{"id": 30_000 - i, "t": f"a rather long text {i % 7}", "a": [i, None]} for i in range(29_999, -1, -1)]
    assert T.gathered(rows.limit(0)).num_rows == 0 and T.gathered(rows.limit(0)).column_names == ["id", "t", "a"]
