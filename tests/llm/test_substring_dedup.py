import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from assaylake.llm import repeats as R
from assaylake.llm import substring_dedup as S


def brute(docs, length):
    seen = Counter()
    split = [(i, (t or "").encode().split()) for i, t in docs]
    for _, w in split:
        seen.update(tuple(w[j : j + length]) for j in range(len(w) - length + 1))
    out = []
    for i, w in split:
        gone = set()
        for j in range(len(w) - length + 1):
            if seen[tuple(w[j : j + length])] > 1:
                gone |= set(range(j, j + length))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cases(seed=1):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice("a bb ccc dé e1 F".split()) for _ in range(n))
    shared = [say(60) for _ in range(4)]
    docs = [(i, f"{say(rng.randrange(40))} {rng.choice(shared)[rng.randrange(20):]} {say(rng.randrange(80))}") for i in range(60)]
    docs += [(100 + i, docs[0][1]) for i in range(5)] + [(200, None), (201, ""), (202, "x " * 200), (203, say(34)), (204, " \n\t".join(say(500).split()))]
    return docs


@pytest.mark.parametrize("hot,bucket", [(512, 1 << 20), (1, 1 << 20), (512, 200)])
def test_against_brute_force(spark, hot, bucket):
    docs = cases()
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, spans string").repartition(3)
    got = S.strip(df, kind=R.Kind(12, 5, True), hot=hot, bucket=bucket)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, 12)


def test_repeated_and_null_ids_and_empty(spark):
    t = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, t), (1, t), (None, t + " z"), (2, "only")], "doc_id long, text string")
    assert sorted(r.n_removed for r in S.strip(df).collect()) == [0, 50, 50, 50]
    assert S.strip(df.limit(0)).count() == 0


def test_long_texts_in_steps(monkeypatch):
    s = np.random.default_rng(0).integers(0, 9, 5000).astype(np.uint64)
    kind = R.Kind(20, 7, True)
    want = R.find_runs(s, kind)
    monkeypatch.setattr(R, "STEP", 700)
    got = R.find_runs(s, kind)
    owner = lambda r: np.repeat(r[0], r[3])
    assert (owner(want) == owner(got)).all() and got[3].sum() == 5000 - 19


def test_broadcast_reference(spark):
    ref = spark.createDataFrame([("a b c d e f g",), (None,), ("p q r s",)], "text string")
    df = spark.createDataFrame([(1, "x b c d e y p q r z"), (2, None)], "doc_id long, text string")
    for size in (1, 1000):
        got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in S.broadcast_matches(df, ref, 3, shard_words=size).collect()}
        assert got == {1: [(1, 5), (6, 9)], 2: []}
