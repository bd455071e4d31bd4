import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.llm import ranked_search as R


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=10):
    counts = [(d, Counter(words(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    asked, out = {}, []
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    for i, some in asked.items():
        scores = []
        for d, c in counts:
            m = 10 + (90 * c.total() * n) // total
            s = sum(floor(1000 * log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in some if c[w])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if gone else d, -s) for r, (s, gone, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, extra=()):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in dict(extra).items()})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({k: F.lit(v) for k, v in dict(extra).items()})
    return sorted(map(tuple, R.search(R.build(d, "doc_id", "text"), i, "item_id", "text").select("item_id", "rank", "doc", "score").collect()), key=str)


def corpus(seed, n=160):
    rng = random.Random(seed)
    some = [f"w{i}" for i in range(30)] + ["Été", "naïve", "X9", "日本"]
    text = lambda m: " ,\n".join(rng.choices(some, k=m, weights=[1 / (i + 1) for i in range(len(some))]))
    docs = [(i, text(rng.randrange(1, 40))) for i in range(n)]
    docs += [(1000 + i, "Copy copy, w1 w2") for i in range(40)] + [(2000, None), (2001, ""), (2002, "?! \x00"), (None, "w1 w2 w3"), (7, "w1 w2"), (7, "w1 w2"), (3000, text(5000))]
    items = [(i, text(8)) for i in range(12)] + [(50, "copy W1"), (51, None), (52, ""), (53, "unknownword"), (54, "w1"), (54, "w2"), (None, "w3 w4"), (None, "w5")]
    return docs, items


@pytest.mark.parametrize("postings, block, front", [(1, 60, 1), (60, 30, 3), (1 << 20, 1 << 20, 64)])
def test_op12_against_brute_force(spark, monkeypatch, postings, block, front):
    """Any size of shards, blocks and fronts gives the same ranks: ties at the last rank, copies, nulls, empty and long texts,
    repeated ids, clashing column names."""
    for name, value in (("POSTINGS", postings), ("BLOCK", block), ("FRONT", front)):
        monkeypatch.setattr(R, name, value)
    docs, items = corpus(3, 160 if postings > 1 else 20)
    clash = {} if postings == 60 else {"key": "x", "docs": "x", "terms": "x", "df": "x", "rank": "x", "score": "x", "place": "x"}
    assert found(spark, docs, items, clash) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(4, 5)
    assert found(spark, [], items) == []
    assert found(spark, docs, []) == []
    assert found(spark, [(1, None), (2, "--")], items) == []


def test_maxima_and_exact_cells():
    """Every inner node has the maximum of its children; paths reach every cell and no other."""
    rng = np.random.default_rng(1)
    cells = {(int(a), int(b)): int(c) for a, b, c in zip(rng.integers(0, 50, 300), rng.integers(0, 90, 300), rng.integers(1, 10**6, 300))}
    rows, columns = np.array([a for a, _ in cells]), np.array([b for _, b in cells])
    depth, masks, most = R.grown(rows, columns, np.array(list(cells.values())))
    first, parent = R._parents(masks)
    assert len(most) == len(parent) + 1
    for n in range(len(masks)):
        assert most[n] == max(most[first[n] : first[n] + int(masks[n]).bit_count()])
    tree = R.Tree(depth, masks, first, most)
    for row in range(50):
        got = R.best(tree, np.array([0]), np.array([row]), np.array([3]), np.array([1]), 1000)
        assert {(c, s) for _, s, c in got.T.tolist()} == {(b, 3 * v) for (a, b), v in cells.items() if a == row}
