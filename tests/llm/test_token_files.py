import zlib

import numpy as np
import pyarrow as pa
import pytest

from assaylake.llm import token_files as T

TEXTS = [None, "", "plain words here", "  two  spaces \n\n and\tlines \n", "a\x1cb \x1f c", "it's <|endoftext|> 12 34,é€  x", "word " * 3000, "plain words here", "   x　y", "\r\n tail ", "don't 's we'll x''d 5½², naïve—ok 日本 語\u00a0z\x85y", "a\n\n\nb \n c", "…", " "]


@pytest.mark.parametrize("bits", [True, False])
@pytest.mark.parametrize("width", [2, 4])
def test_planes_round_trip(bits, width):
    ids = np.random.default_rng(3).integers(0, 50_000, 1003).astype(f"<u{width}")
    assert (T.unshuffle(T.shuffle(ids, bits), len(ids), width, bits) == ids).all()


def test_remembered_stretches_give_the_tokenizer_s_ids():
    encoder = T.Encoder(T.tokenizer_path())
    for t in TEXTS:
        want = encoder.tokenizer.encode(t or "", add_special_tokens=False).ids
        assert encoder.encode(t or "").tolist() == want
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert [x.tolist() for x in encoder.batch(pa.array(TEXTS))] == want
    assert [x.tolist() for x in encoder.batch(pa.array(TEXTS)[3:])] == want[3:]
    assert encoder.batch(pa.array([], pa.string())) == []
    encoder.plain = False
    assert [x.tolist() for x in encoder.batch(pa.array(TEXTS))] == want


def test_random_texts_in_batches():
    encoder, rng = T.Encoder(T.tokenizer_path()), np.random.default_rng(5)
    signs = list("ab  eé'sSt1½\n\t.,-日\u00a0\u3000\x1c<|\u0120\u200b\U0001f600")
    texts = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(4000)]
    texts += [" ".join(rng.choice(signs[:12], rng.integers(1, 9))) for _ in range(2000)]
    assert [x.tolist() for x in encoder.batch(pa.array(texts))] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_concatenated():
    parts = [b"abc", b"", b"x" * 5000, b"\0\0"]
    assert T.concatenated([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


@pytest.mark.parametrize("size", [64, 1 << 16])
def test_digests_against_brute_force(spark, tmp_path, size):
    ids = [5, 3, 9, 0, 7, 1, 2, 8, 4, 6, 12, 11, 14, 13]
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, TEXTS)], "doc_id long, text string, block string").repartition(3)
    T.blocks(df, size=size).write.parquet(str(tmp_path / "b"))
    written = spark.read.parquet(str(tmp_path / "b"))
    tokenizer, start, want = T._tokenizer(T.tokenizer_path()), 0, []
    for i, t in sorted(zip(ids, TEXTS)):
        e = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(e), zlib.crc32(np.array(e, "<u4").tobytes())))
        start += len(e)
    assert sorted(map(tuple, T.digests(written).collect())) == want
    assert sum(len(r.ids) for r in T.read(written).collect()) == start


def test_empty_and_repeated_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    T.blocks(empty).write.parquet(str(tmp_path / "e"))
    assert T.digests(spark.read.schema(T.SCHEMA).parquet(str(tmp_path / "e"))).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    T.blocks(twice).write.parquet(str(tmp_path / "t"))
    assert T.digests(spark.read.parquet(str(tmp_path / "t"))).count() == 3


def test_repeated_ids_with_different_texts_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    rows = [(1, f"text {i} " * (i % 7)) for i in range(40)] + [(None, "x"), (2, "long " * 90_000)]
    got = []
    for n, some in ((1, rows), (3, rows[::-1])):
        T.blocks(spark.createDataFrame(some, "doc_id long, text string").repartition(n)).write.parquet(str(tmp_path / str(n)))
        got.append(sorted(map(tuple, T.digests(spark.read.parquet(str(tmp_path / str(n)))).collect()), key=str))
    assert got[0] == got[1]
