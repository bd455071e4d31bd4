import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.llm import ngram_join as J


def shingles(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """doc_id, n_shingles, component_id of every row, by comparing every pair."""
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least.setdefault(find(i), []).append(d)
    least = {r: min((d for d in v if d is not None), default=None) for r, v in least.items()}
    return sorted(((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(docs)), key=str)


def cases(seed):
    rng = random.Random(seed)
    w = [f"w{i}" for i in range(300)] + ["É", "Straße"]
    text = lambda n: [rng.choice(w) for _ in range(n)]
    line, docs = text(30), []
    for n in (1, 4, 5, 9, 13, 14, 40, 200, 600):
        base = text(n)
        for share in (0, 0.005, 0.01, 0.02, 0.025, 0.03, 0.05):
            docs.append([rng.choice(w) if rng.random() < share else x for x in base])
        docs += [base[k:] + text(k) for k in (1, 2)] + [base[: n - n // 5], base + base]
    docs += [[*text(20), *line] for _ in range(20)]
    big = text(120)
    docs += [[rng.choice(w) if rng.random() < 0.014 else x for x in big] for _ in range(50)]
    docs = [" ".join(d) for d in docs] + [None, "", " \n", "one", "One", " ".join(docs[30]).upper(), " ".join(docs[30]), " ".join(docs[30])]
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    return rows + [(None, docs[0]), (None, docs[5]), (3, docs[9]), (3, docs[3]), (3, docs[3]), (None, "alone and without an id, to be sure"), (None, None)]


@pytest.mark.parametrize("bound, clash", [(J.BOUND, False), (0, True), (2500, False)])
def test_op11_against_all_pairs(spark, monkeypatch, bound, clash):
    """Tries alone, pairs alone, and both: nulls, empty and long texts, ties, repeated rows and ids, clashing column names."""
    monkeypatch.setattr(J, "BOUND", bound)
    docs = cases(2)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    if clash:
        df = df.withColumns({c: F.lit("x") for c in ("key", "t", "th", "node", "root", "sig", "n", "least", "h", "s")})
    got = J.group(df, "doc_id").select("doc_id", "n", F.coalesce("least", "doc_id")).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs)


def test_empty_table(spark):
    assert J.group(spark.createDataFrame([], "doc_id long, text string"), "doc_id").collect() == []


@pytest.mark.parametrize("seed", range(12))
def test_trie_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 60, rng.integers(1, 40)) for _ in range(6)]
    sets = []
    for _ in range(int(rng.integers(2, 70))):
        own = base[rng.integers(6)]
        own = np.concatenate([own[rng.random(len(own)) > rng.random() * 0.15], rng.integers(0, 200, rng.integers(0, 4))])
        if len(own):
            sets.append(np.unique(own).astype(np.uint64))
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert J.tied(sets).tolist() == root


def test_equal_runs_of_sets_of_the_least_similarity():
    """Such sets share the runs that each must have in common, and a run that ties."""
    rng = np.random.default_rng(4)
    for turn in range(3):
        for n in [*range(1, 40), *rng.integers(40, 900, 160).tolist()]:
            m = int(rng.integers(-(-4 * n // 5), 5 * n // 4 + 1))
            shared = -(-4 * (n + m) // 9)
            if shared > min(n, m):
                continue
            drawn = rng.integers(0, 1 << 63, n + m, dtype=np.uint64)
            x, y = np.sort(drawn[:n]), np.sort(np.concatenate([drawn[:shared], drawn[n : n + m - shared]]))
            of_x, of_y = ({k: rest for k, *rest in J.equal_runs(s, turn)} for s in (x, y))
            k = max(n, m).bit_length() - 1
            (a, ties_a, least_a), (b, ties_b, least_b) = of_x[k], of_y[k]
            assert len(np.intersect1d(a, b)) >= max(least_a, least_b)
            assert min(least_a, least_b) < 1 or len(np.intersect1d(a[ties_a], b[ties_b]))
