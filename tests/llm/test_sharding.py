from collections import Counter

from assaylake.llm import sharding as S


def test_table_is_full_even_and_stable():
    names = [f"s{i}" for i in range(10)]
    full = S.fill(names, 1021)
    assert len(full) == 1021 and max(Counter(full).values()) - min(Counter(full).values()) <= 1
    fewer = S.fill(names[:-1], 1021)
    moved = sum(a != b for a, b in zip(full, fewer) if a != 9)
    assert moved < 0.15 * 1021
    assert S.fill([], 7) == []


def test_place(spark):
    df = spark.createDataFrame([(1, "a", "old"), (1, "b", "old"), (None, "c", "old")], "doc_id long, text string, shard string")
    got = S.place(df).collect()
    assert len(got) == 3 and len({r.shard for r in got if r.doc_id == 1}) == 1 and all(r.shard.startswith("shard-") for r in got)
    assert S.place(df.limit(0)).count() == 0
    assert [r.shard for r in S.place(df, shards=()).collect()] == [None] * 3
