import hashlib
import random

import numpy as np
import pytest

from assaylake.llm import bwt_dedup as B
from assaylake.llm import repeats as R


def brute(docs, length):
    seen, out = set(), []
    for i, t in sorted(docs):
        raw, gone = (t or "").encode(), set()
        for j in range(len(raw) - length + 1):
            w = raw[j : j + length]
            if w in seen:
                gone |= set(range(j, j + length))
            seen.add(w)
        spans = sum(1 for j in gone if j - 1 not in gone)
        kept = bytes(b for j, b in enumerate(raw) if j not in gone)
        out.append((i, len(raw), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_merged_transform_is_the_sorted_order():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(9)]
    for shards in (1, 2, 3, 4):
        at, group = B.intervals(texts, 50, shards)
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])

        def rotation(p):
            k = int(np.searchsorted(starts, p, "right")) - 1
            marked = texts[k] + b"\0"
            return marked[p - starts[k] :] + marked[: p - starts[k]]

        turned = [(rotation(p) * 60)[:50] for p in at.tolist()]
        assert turned == sorted(turned)
        assert all((turned[i] == turned[i - 1]) == (group[i] == group[i - 1]) for i in range(1, len(at)))


def test_common_prefixes():
    whole, prefix = B.merge(B.build([b"banana"]), B.build([b"bandana"], 7), 5)
    text = "banana\0bandana\0"
    rot = lambda p: (text[:7] if p < 7 else text[7:])[p - 7 * (p >= 7) :] + (text[:7] if p < 7 else text[7:])
    for i in range(1, len(prefix)):
        a, b = rot(whole.at[i - 1])[:5], rot(whole.at[i])[:5]
        n = next((k for k in range(5) if a[k : k + 1] != b[k : k + 1]), 5)
        assert prefix[i] == n


def cases(seed=1):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("ab cdé\n") for _ in range(n))
    shared = [say(90) for _ in range(4)]
    docs = [(i, say(rng.randrange(60)) + rng.choice(shared)[rng.randrange(30) :] + say(rng.randrange(90))) for i in range(60)]
    return docs + [(100 + i, docs[7][1]) for i in range(5)] + [(200, None), (201, ""), (202, "x" * 300), (203, say(19)), (99, say(4000))]


@pytest.mark.parametrize("hot,bucket", [(512, 1 << 20), (1, 1 << 20), (512, 300)])
def test_against_brute_force(spark, hot, bucket):
    docs = cases()
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, id_ string").repartition(3)
    got = B.strip(df, kind=R.Kind(20, 7, False), hot=hot, bucket=bucket)
    assert sorted(map(tuple, got.collect())) == brute(docs, 20)


def test_default_length_and_kept_bytes(spark):
    t = "".join(chr(97 + i % 26) + str(i) for i in range(80))
    df = spark.createDataFrame([(2, "go " + t), (1, t), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in B.strip(df, texts=True).collect()}
    assert got[1].n_removed == 0 and bytes(got[2].kept) == b"go " and got[2].n_spans == 1 and got[3].n_bytes == 0


def test_repeated_and_null_ids_and_empty(spark):
    t = "".join(str(i) for i in range(100))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, "only")], "doc_id long, text string")
    assert sorted(r.n_removed for r in B.strip(df).collect()) == [0, 0, len(t), len(t)]
    assert B.strip(df.limit(0)).count() == 0
