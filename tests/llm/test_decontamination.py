import hashlib
import random
import re

from assaylake.llm import decontamination as D

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, names = low(t), set(), set()
        for k, text in items:
            v = low(text)
            n = min(13, len(v))
            for j in range(len(v) - n + 1) if v else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[j : j + n]:
                        hit |= set(range(p, p + n))
                        names.add(str(k))
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(4)
    sentence = lambda n: " ".join(rng.choice("Alpha beta, gam-ma délta e5 ZETA".split()) for _ in range(n))
    items = [(k, sentence(rng.choice([3, 12, 13, 20, 40]))) for k in range(12)] + [(12, None), (13, ""), (14, "..."), (15, "One"), (10, sentence(14))]
    docs = [(i, sentence(rng.randrange(0, 300))) for i in range(25)]
    docs += [(100 + k, f"lead {sentence(30)} {t} tail {sentence(9)}") for k, t in items if t] + [(200, None), (201, ""), (202, items[3][1].upper()), (202, items[3][1].upper()), (203, "one"), (204, "unrelated " * 50_000)]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_hit string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark, monkeypatch):
    docs, items = cases()
    d, b = frames(spark, docs, items)
    want = brute(docs, items)
    assert sorted(map(tuple, D.judge(d, b).drop("spans").collect()), key=str) == want
    assert sorted(map(tuple, D.judge(d, b, limit=60).drop("spans").collect()), key=str) == want


def test_longest_matches(spark):
    docs = [(1, "a b c d e f x"), (2, "q a b c d e f g h"), (3, None)]
    d, b = frames(spark, docs, [(7, "z a b c d e f g")])
    got = {r.item_start: (r.n_words, r.doc_id, r.doc_start) for r in D.longest_matches(d, b).collect()}
    assert got == {1: (7, 2, 1), 2: (6, 2, 2), 3: (5, 2, 3)}


def test_empty_tables(spark):
    d, b = frames(spark, [(1, "a b")], [(1, "a b")])
    assert D.judge(d.limit(0), b).count() == 0
    assert [tuple(r)[1:4] for r in D.judge(d, b.limit(0)).collect()] == [(2, 0, 0)]
    assert D.longest_matches(d.limit(0), b).count() == 0


def test_filtered_keeps_what_judge_clears(spark):
    docs, items = cases()
    d, b = frames(spark, docs, items)
    bad = {r.doc_id for r in D.judge(d, b).where("contaminated").collect()}
    for limit in (60, 10**6):
        got = D.filtered(d, b, limit=limit)
        assert got.columns == d.columns
        assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, _ in docs if i not in bad)


def test_filtered_searches_items_without_an_id(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    d, b = frames(spark, [(1, passage), (2, "other words")], [(None, passage), (None, passage + " more"), (5, "z " * 13)])
    for limit in (20, 10**6):
        assert [r.doc_id for r in D.filtered(d, b, limit=limit).collect()] == [2]


def test_items_without_an_id_are_searched_but_not_named(spark):
    d, b = frames(spark, [(1, "so one two three end"), (None, "x")], [(None, "one two three")])
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in D.judge(d, b).collect()}
    assert got == {1: (3, 0, True), None: (0, 0, False)}


def test_longest_matches_go_beyond_a_window(spark):
    rng = random.Random(8)
    say = lambda n: [rng.choice("a b c d".split()) for _ in range(n)]
    long = say(120)
    docs = [(1, " ".join([*say(40), *long[:50], "e", *say(9)])), (2, " ".join([*say(5), *long[20:], *say(30)])), (3, " ".join(long[20:])), (None, None), (4, " ".join(say(300)))]
    items = [(7, " ".join(long)), (8, " ".join(["q", *long[10:60], "r"]))]
    d, b = frames(spark, docs, items)
    split = {i: (t or "").split() for i, t in docs}

    def brute(v, j):
        best = (0, 0, 0)
        for i, w in split.items():
            for p in range(len(w)):
                n = 0
                while p + n < len(w) and j + n < len(v) and w[p + n] == v[j + n]:
                    n += 1
                if n >= 5:
                    best = min(best, (-n, i, p))
        return best

    want = {(str(k), j): f for k, t in items for v in (t.split(),) for j in range(len(v)) if (f := brute(v, j))[0]}
    got = {(r.item, r.item_start): (-r.n_words, r.doc_id, r.doc_start) for r in D.longest_matches(d, b).collect()}
    assert got == want and max(-f[0] for f in want.values()) >= 100
