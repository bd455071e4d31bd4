import random

import pytest

import corpus_pipeline
from assaylake.llm import near_copies as N
from assaylake.llm import ngram_join


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """The least row of each group, by comparing every pair."""
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(docs))]


def cases():
    rng = random.Random(8)
    w = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(w) for _ in range(n)]
    line, docs = text(30), []
    for n in (4, 5, 9, 40, 200, 600):
        base = text(n)
        for share in (0, 0.005, 0.01, 0.02, 0.025, 0.03, 0.05):
            docs.append([rng.choice(w) if rng.random() < share else x for x in base])
    docs += [[*text(20), *line] for _ in range(20)]
    big = text(150)
    docs += [[rng.choice(w) if rng.random() < 0.012 else x for x in big] for _ in range(60)]
    docs = [" ".join(d) for d in docs] + [None, "", " \n", "one", "One", docs[30] and " ".join(docs[30]).upper()]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("leaders, bound", [(ngram_join.LEADERS, ngram_join.BOUND), (ngram_join.LEADERS, 0), (0, 0), (1, 3000)])
def test_groups_against_all_pairs(spark, monkeypatch, leaders, bound):
    for name, value in (("LEADERS", leaders), ("BOUND", bound)):
        monkeypatch.setattr(ngram_join, name, value)
    docs = cases()
    want = brute(docs)
    got = {r.k: r.root for r in N.group(spark.createDataFrame(docs, "k long, text string").repartition(3), "k").collect()}
    assert len(got) == len(docs) and len(set(want)) < len(docs) - 60
    pairs = {}
    for i, root in enumerate(want):
        pairs.setdefault(root, set()).add(got[i])
    assert all(len(found) == 1 for found in pairs.values()) and len(set(got.values())) == len(pairs)


def test_stage_finds_copies_three_bits_miss(spark):
    docs = [(i + 1, t) for i, t in cases()]
    want = sorted(i + 1 for i, root in enumerate(brute(docs)) if i == root)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, df, "").collect()) == want
    assert corpus_pipeline.simhash_stage(spark, df.limit(0), "").count() == 0


def test_stage_keeps_one_row_a_group_where_ids_repeat(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(20))
    docs = [(1, text("a")), (2, text("a")), (2, text("b")), (3, text("c")), (3, text("c")), (None, text("a")), (None, text("a"))]
    got = corpus_pipeline.simhash_stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([docs[0], docs[2], docs[3], docs[5], docs[6]], key=str)


def test_stage_keeps_columns_named_as_its_own(spark):
    docs = [(1, "a b c", "mine"), (2, "a b c", "yours"), (3, "d", None)]
    names = ("row_", "Sig", "root", "least")
    df = spark.createDataFrame(docs, "doc_id long, text string, row_ string").selectExpr("*", *(f"row_ as {c}" for c in names[1:]))
    got = corpus_pipeline.simhash_stage(spark, df, "").collect()
    assert sorted((r.doc_id, *(r[c] for c in names)) for r in got) == [(1, *["mine"] * 4), (3, *[None] * 4)]
