import random

import xxhash

from assaylake.llm import simhash as S
from assaylake.llm.components import components


def low(t):
    import re

    return re.findall(rb"[^\x20\x09-\x0d]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))


def brute(t):
    w = low(t)
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def closure(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components(spark):
    rng = random.Random(1)
    w = [f"W{i}é" for i in range(50)]
    base = [" ".join(rng.choice(w) for _ in range(300)) for _ in range(6)]
    docs = []
    for b in base:
        for _ in range(12):
            x = b.split()
            for _ in range(rng.randrange(4)):
                x[rng.randrange(300)] = rng.choice(w)
            docs.append("\t ".join(x))
    docs += [None, "", " \n", "one", "One two", "one two three", "one two three four", "long words here " * 40_000, base[0], base[0]]
    df = spark.createDataFrame([(i + 5, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in S.group(df).collect()}
    fps = [brute(t) for t in docs]
    want = closure(fps)
    assert len(got) == len(docs)
    for i, f in enumerate(fps):
        assert got[i + 5].fp % (1 << 64) == f
        assert got[i + 5].component_id == want[i] + 5
    assert len(set(want)) < 40


def test_links_join_every_pair_within_the_radius(spark):
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(30):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(8):
            g = f
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    df = spark.createDataFrame([(S._signed(f),) for f in fps], "fp long")
    edges = [(r.u % (1 << 64), r.v % (1 << 64)) for r in S.links(df).collect()]
    assert all((u ^ v).bit_count() <= 3 for u, v in edges)
    at = {f: i for i, f in enumerate(fps)}
    root = list(range(len(fps)))
    find = lambda i: i if root[i] == i else find(root[i])
    for u, v in edges:
        a, b = sorted((find(at[u]), find(at[v])))
        root[b] = a
    assert [find(i) for i in range(len(fps))] == closure(fps)


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 120)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (3, "a b c")], "doc_id long, text string")
    assert {r.component_id for r in S.group(df).collect()} == {3}
    assert S.group(df.limit(0)).count() == 0
