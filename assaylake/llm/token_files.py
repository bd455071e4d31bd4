"""Token ids of documents as bit-plane shuffled, zstandard-compressed blocks.

Documents go through the tokenizer in ascending doc_id order, the end id follows each. A shard is one
range of doc_ids; its ids are cut into blocks of BLOCK. A block's ids, as 2- or 4-byte numbers, are
transposed into bit (or byte) planes; each plane is compressed by itself. A row of the written table is
one block: shard, number, position in the shard, plane sizes (the block index), the planes, and which
documents have how many ids in it. read() gives the ids back; digests() one row a document from the
blocks alone.

A batch of texts is split at its spaces at once, the different words are encoded together (a word with the
space before it; the tokenizer's first step always splits there, so the ids are those of the whole text)
and every word's ids are gathered from that table. Texts with spaces next to other white space or at an end are cut
by the same rule one by one; texts with the separators 0x1C-0x1F, which engines class differently, or with a
special token's beginning are encoded whole.

Null texts are empty: the end id only. Rows that repeat a doc_id keep a row each, in the order of a hash of their
texts, then of the texts. A null doc_id sorts first. Other columns are left out.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import arrow, saved, table

BLOCK, LEVEL, END, REMEMBERED = 1 << 16, 3, 2, 1_000_000
STRETCH = re.compile(r" ?\S+|\s+(?!\S)|\s+")
WHOLE = re.compile(r"[\x1c-\x1f]|<\|")
#: White space of Unicode, for engines whose \s is ASCII.
_SPACE = r"\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ODD = rf"^ | $|[{_SPACE}] | [{_SPACE}]|[\x1c-\x1f]|<\|"
JOINED = 1 << 15  # words encoded in one call
GATHERED = 1 << 14  # words whose ids are gathered at once
SCHEMA = "shard int, block int, first long, n int, width int, bits boolean, sizes array<int>, planes binary, seqs array<long>, doc_ids array<bigint>, counts array<int>"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Memo(dict):
    """Computes what it doesn't have; forgets all beyond a number of entries."""

    def __init__(self, compute, most: int):
        self.compute, self.most = compute, most

    def __missing__(self, key: str) -> np.ndarray:
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class Encoder:
    """ids of whole texts. Batches share the work on equal words where the tokenizer is byte-level, splits before spaces and does
    nothing else to a text; for any other tokenizer whole texts are encoded."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        setup = json.loads(self.tokenizer.to_str())
        first = setup["pre_tokenizer"] or {}
        self.plain = setup["normalizer"] is None and first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and not setup["model"].get("dropout")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocabulary.values(), default=0) < 1 << 16 else 4
        self.type = np.dtype(f"<u{self.width}")
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids of tokens that begin with a space
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.parts = _Memo(self._ids, REMEMBERED // 8)
        self._forget()

    def _forget(self) -> None:
        """Words met so far, by number; the ids of word k are table[places[k] : places[k] + sizes[k]]."""
        self.known: dict[str, int] = {}
        self.table, self.places, self.sizes = np.zeros(0, self.type), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)

    def encode(self, text: str) -> np.ndarray:
        """One text by itself."""
        if not self.plain or WHOLE.search(text):
            return self._ids(text)
        return np.concatenate([np.zeros(0, self.type), *map(self.parts.__getitem__, STRETCH.findall(text))])

    def _words(self, words: list[str]) -> np.ndarray:
        """Numbers of different words, each meant with a space before it."""
        if len(self.known) > REMEMBERED:
            self._forget()
        codes = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = [words[i] for i in np.flatnonzero(codes < 0).tolist()]
        tables, sizes = [self.table], [self.sizes]
        for i in range(0, len(new), JOINED):
            some = new[i : i + JOINED]
            got = self._ids(" " + " ".join(some))
            starts = np.flatnonzero(self.spaced[got])
            if len(starts) != len(some) or starts[0]:
                each = [self._ids(" " + w) for w in some]
                got, starts = np.concatenate(each), np.cumsum([0, *map(len, each[:-1])])
            tables.append(got)
            sizes.append(np.diff(np.append(starts, len(got))))
        codes[codes < 0] = np.arange(len(self.known), len(self.known) + len(new))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.table, self.sizes = np.concatenate(tables), np.concatenate(sizes)
        self.places = np.cumsum(self.sizes) - self.sizes
        return codes

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """ids of each text of a batch."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False) if self.plain else np.ones(len(texts), bool)
        split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        offsets, flat = split.offsets.to_numpy() - (split.offsets[0].as_py() if len(split) else 0), split.flatten()
        first = np.zeros(len(flat), bool)
        first[offsets[:-1]] = True
        later = pc.dictionary_encode(flat.filter(pa.array(~first)))
        numbers = self._words(later.dictionary.to_pylist())
        begin = pc.dictionary_encode(flat.filter(pa.array(first)))
        heads = [self.parts[w] if w else np.zeros(0, self.type) for w in begin.dictionary.to_pylist()]
        code = np.empty(len(flat), np.int64)
        code[~first], code[first] = numbers[later.indices.to_numpy()], begin.indices.to_numpy() + len(self.sizes)
        own = np.array([len(h) for h in heads], np.int64)
        sizes = np.concatenate([self.sizes, own])
        places = np.concatenate([self.places, np.cumsum(own) - own + len(self.table)])
        table = np.concatenate([self.table, *heads])
        n = sizes[code]
        ends = np.cumsum(n)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, self.type)
        for i in range(0, len(code), GATHERED):  # in pieces that stay in the processor's cache
            size, end = n[i : i + GATHERED], ends[i : i + GATHERED]
            begin_at = int(end[0] - size[0])
            shift = places[code[i : i + GATHERED]] - (end - size) + begin_at
            ids[begin_at : int(end[-1])] = table[np.repeat(shift, size) + np.arange(int(end[-1]) - begin_at)]
        cuts = np.append(0, ends)[offsets]
        plain = iter(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        out = []
        for i, o in enumerate(odd.tolist()):
            if o:
                out.append(self.encode(texts[i].as_py()))
            else:
                a, z = next(plain)
                out.append(ids[a:z])
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One a Python worker, so that tasks share what it remembers."""
    return Encoder(path)


def shuffle(ids: np.ndarray, bits: bool = True) -> list[bytes]:
    """The planes of a block, most significant first, each compressed."""
    packer = zstandard.ZstdCompressor(level=LEVEL)
    raw = np.ascontiguousarray(ids.astype(ids.dtype.newbyteorder(">"))).view(np.uint8).reshape(len(ids), -1)
    if bits:
        raw = np.unpackbits(raw, axis=1)
        planes = np.packbits(np.ascontiguousarray(raw.T), axis=1)
    else:
        planes = np.ascontiguousarray(raw.T)
    return [packer.compress(p.tobytes()) for p in planes]


def unshuffle(planes: list[bytes], n: int, width: int, bits: bool = True) -> np.ndarray:
    opener = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(opener.decompress(p), np.uint8) for p in planes]
    if bits:
        raw = np.packbits(np.ascontiguousarray(np.stack([np.unpackbits(p, count=n) for p in raw]).T), axis=1)
    else:
        raw = np.ascontiguousarray(np.stack(raw).T)
    return raw.view(f">u{width}").reshape(n).astype(f"<u{width}")


def blocks(docs: DataFrame, path: str | None = None, end: int = END, size: int = BLOCK, bits: bool = True) -> DataFrame:
    """The blocks of all documents in ascending doc_id order: one shard a partition."""
    path = path or tokenizer_path()
    arrow(docs.sparkSession)
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def write(batches):
        own = encoder(path)
        width, shard = own.width, TaskContext.get().partitionId()
        tail = np.array([end], f"<u{width}").tobytes()
        held, owners, number, first, seq = bytearray(), deque(), 0, 0, 0

        def cut(n):
            nonlocal number, first
            ids = np.frombuffer(bytes(held[: n * width]), f"<u{width}")
            del held[: n * width]
            planes = shuffle(ids, bits)
            mine, left = [], n
            while left:
                s, d, c = owners[0]
                took = min(c, left)
                mine.append((s, d, took))
                left -= took
                owners[0] = (s, d, c - took)
                if took == c:
                    owners.popleft()
            row = [shard, number, first, n, width, bits, [len(p) for p in planes], b"".join(planes), *map(list, zip(*mine))]
            number, first = number + 1, first + n
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), own.batch(b.column(1))):
                held += ids.tobytes()
                held += tail
                owners.append((seq, doc, len(ids) + 1))
                seq += 1
                while len(held) >= size * width:
                    yield cut(size)
        if held:
            yield cut(len(held) // width)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("by_", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "by_").sortWithinPartitions("doc_id", "by_", "text")
    return ordered.select("doc_id", "text").mapInArrow(write, SCHEMA)


def _open(b, i: int) -> np.ndarray:
    sizes, planes, at, parts = b.column("sizes")[i].as_py(), b.column("planes")[i].as_py(), 0, []
    for s in sizes:
        parts.append(planes[at : at + s])
        at += s
    return unshuffle(parts, b.column("n")[i].as_py(), b.column("width")[i].as_py(), b.column("bits")[i].as_py())


def read(written: DataFrame) -> DataFrame:
    """(shard, seq, block, doc_id, ids): the ids of each document, a row for each block that holds some of them."""
    arrow(written.sparkSession)

    def pieces(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, at, rows = _open(b, i), 0, []
                for s, d, c in zip(*(b.column(x)[i].as_py() for x in ("seqs", "doc_ids", "counts"))):
                    rows.append((b.column("shard")[i].as_py(), s, b.column("block")[i].as_py(), d, ids[at : at + c].astype(np.int32)))
                    at += c
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())))], ["shard", "seq", "block", "doc_id", "ids"])

    return written.mapInArrow(pieces, "shard int, seq long, block int, doc_id long, ids array<int>")


def digests(written: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the written blocks."""
    spark = written.sparkSession
    arrow(spark)

    def pieces(batches):
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                raw, at = _open(b, i).astype("<u4").tobytes(), 0
                shard, block, first = (b.column(x)[i].as_py() for x in ("shard", "block", "first"))
                for s, d, c in zip(*(b.column(x)[i].as_py() for x in ("seqs", "doc_ids", "counts"))):
                    rows.append((shard, s, d, block, first + at // 4, c, zlib.crc32(raw[at : at + 4 * c])))
                    at += 4 * c
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["shard", "seq", "doc_id", "block", "at", "n", "crc"])

    found = written.mapInArrow(pieces, "shard int, seq long, doc_id long, block int, at long, n long, crc long")
    # One row a shard: as many as there are partitions.
    totals = sorted((r.shard, r.n) for r in written.groupBy("shard").agg(F.sum("n").alias("n")).collect())
    offsets, before = [], 0
    for shard, n in totals:
        offsets.append((shard, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(offsets, "shard int, before long"))
    whole = found.groupBy("shard", "seq").agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("block", "crc", "n"))).alias("p")
    )

    @F.udf("long", useArrow=True)
    def joined(p):
        return concatenated([(x["crc"], 4 * x["n"]) for x in p])

    one = F.col("p")[0]["crc"]
    single, several = whole.where(F.size("p") == 1).withColumn("ids_crc32", one), whole.where(F.size("p") > 1).withColumn("ids_crc32", joined("p"))
    rows = single.unionByName(several)
    return rows.join(starts, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def concatenated(pieces: list[tuple[int, int]]) -> int:
    """crc32 of joined byte strings, from each one's crc32 and length: zeros appended carry the sum so far along."""
    total = pieces[0][0]
    for crc, n in pieces[1:]:
        carried, plain = total, 0
        while n:
            zeros = bytes(min(n, 1 << 20))
            carried, plain = zlib.crc32(zeros, carried), zlib.crc32(zeros, plain)
            n -= len(zeros)
        total = carried ^ plain ^ crc
    return total


def op3_token_files(spark, sf_dir):
    return digests(saved(blocks(table(spark, sf_dir, "documents")), "token-blocks"))
