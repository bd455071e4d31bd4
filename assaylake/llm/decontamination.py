"""Benchmark decontamination with suffix arrays of the training text.

Each shard of documents (a stretch of an Arrow batch) becomes one array of word ids, where words that
no benchmark item has are separators. Suffixes that are long enough to hold a window are sorted by
their first WINDOW words: the shard's suffix array. Every different test suffix that holds a window is
binary-searched in it, and the range of equal prefixes gives every occurrence. longest_matches() also takes
the common prefixes with the two neighbours, for matches shorter than WINDOW, and follows longer ones from
window to window, so that every test suffix gets its longest verbatim match and its place.

Words: A-Z lower-cased, runs of bytes other than 0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F. A window is WINDOW
words in a row; an item with fewer words, but not none, is one window. A document is contaminated if
SHARE or more of its words lie in occurrences of windows, one at least.

The test side is a stated query set: it is taken in blocks of at most BLOCK_WORDS words. A block is broadcast,
all documents are searched for it, what was found goes with their rows to the next block, and the broadcast is
dropped; so what is broadcast at a time is bounded whatever the benchmark's size.

Null texts have no words. Rows that repeat an id are judged one by one. A repeated item id counts once. Items
without an id are searched like the others and their windows count as hits; as they can't be named, n_items and
items_sha256 leave them out. Keys may be numbers or texts, and null. Extra columns are left out by judge() and
kept by filtered().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import arrow, saved, table

WINDOW, SHARE = 13, 20
BLOCK_WORDS, SHARD_WORDS = 2_000_000, 1_000_000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Tests:
    """Test suffixes of one block of items: word ids, their windows and owners."""

    def __init__(self, items: list[tuple[str | None, bytes | None]]):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str | None] = []
        rows, sizes, owners, starts = [], [], [], []
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if not ids:
                continue
            n = min(WINDOW, len(ids))
            for i in range(len(ids)):
                cut = ids[i : i + WINDOW]
                rows.append(cut + [0] * (WINDOW - len(cut)))
                sizes.append(n if i + n <= len(ids) else 0)  # 0: a suffix too short to be a window
                owners.append(len(self.names))
                starts.append(i)
            self.names.append(name)
        self.rows = np.array(rows, ">u4").reshape(-1, WINDOW)
        self.lengths = (self.rows > 0).sum(1)
        self.sizes, self.owners, self.starts = (np.array(x, np.int64) for x in (sizes, owners, starts))
        self.shortest = int(self.sizes[self.sizes > 0].min()) if len(rows) else WINDOW
        # Equal windows are searched once; who owns them is looked up for documents that hold them.
        holds = np.flatnonzero(self.sizes)
        _, first, same = np.unique(self.keys(self.rows[holds]), return_index=True, return_inverse=True)
        self.windows = holds[first]
        pairs = np.unique(np.stack([same, self.owners[holds]], 1), axis=0)
        self.owned, self.owned_at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))

    def named(self, windows: np.ndarray) -> list[str]:
        """Ids of the items that have one of these (numbers of different windows)."""
        owners = {o for w in np.unique(windows).tolist() for o in self.owned[self.owned_at[w] : self.owned_at[w + 1]].tolist()}
        return sorted({n for o in owners if (n := self.names[o]) is not None})

    def keys(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows, ">u4").view(f"S{4 * WINDOW}").reshape(-1)


class SuffixArray:
    """Suffixes of a shard's word ids (0: separator) sorted by their first WINDOW words, those that begin `shortest` or more known words."""

    def __init__(self, ids: np.ndarray, tests: Tests):
        ends = np.flatnonzero(np.append(ids, 0) == 0)
        at = np.arange(len(ids))
        left = ends[np.searchsorted(ends, at)] - at
        self.at = np.flatnonzero(left >= tests.shortest)
        padded = np.concatenate([ids, np.zeros(WINDOW, ids.dtype)])
        rows = padded[self.at[:, None] + np.arange(WINDOW)]
        rows[np.arange(WINDOW) >= left[self.at][:, None]] = 0
        keys = tests.keys(rows)
        order = np.argsort(keys, kind="stable")
        self.at, self.rows, self.keys = self.at[order], rows[order], keys[order]

    def range(self, rows: np.ndarray, sizes: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last suffix with the given prefixes of `sizes` words."""
        inside = np.arange(WINDOW) < sizes[:, None]
        low, high = np.where(inside, rows, 0), np.where(inside, rows, 0xFFFFFFFF)
        return np.searchsorted(self.keys, tests.keys(low), "left"), np.searchsorted(self.keys, tests.keys(high), "right")

    def spread(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all suffixes in the ranges: number of the range, position."""
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        return which, self.at[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)] if n.sum() else np.zeros(0, int)

    def followed(self, tests: Tests, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of test suffixes that match here with WINDOW words: all matches, as suffix, position and full length in words."""
        lo, hi = self.range(tests.rows[suffixes], np.full(len(suffixes), WINDOW), tests)
        which, at = self.spread(lo, hi)
        suffix = suffixes[which]
        order = np.lexsort((suffix, at - suffix))  # a longer match is a row of windows with the same distance
        suffix, at = suffix[order], at[order]
        last = np.append((np.diff(suffix) != 1) | (np.diff(at - suffix) != 0), True) if len(at) else np.zeros(0, bool)
        ends = np.flatnonzero(last)
        return suffix, at, ends[np.searchsorted(ends, np.arange(len(at)))] - np.arange(len(at)) + WINDOW

    def longest(self, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
        """Of each test suffix: words of its longest match here, up to WINDOW, and its place (-1: none)."""
        n = np.zeros(len(tests.rows), np.int64)
        where = np.full(len(tests.rows), -1)
        if not len(self.at) or not len(tests.rows):
            return n, where
        i = np.searchsorted(self.keys, tests.keys(tests.rows), "left")
        for j in (i - 1, i):
            ok = (j >= 0) & (j < len(self.at))
            same = (self.rows[np.clip(j, 0, len(self.at) - 1)] == tests.rows) & (tests.rows > 0)
            size = np.where(ok, np.cumprod(same, 1).sum(1), 0)
            where = np.where(size > n, self.at[np.clip(j, 0, len(self.at) - 1)], where)
            n = np.maximum(n, size)
        return n, where


def _shards(texts: list[bytes | None], tests: Tests):
    """Stretches of documents of about SHARD_WORDS words: (first document, word counts, ids with a separator after each document)."""
    get, first, sizes, ids = tests.vocabulary.get, 0, [], []
    for i, text in enumerate(texts):
        found = words(text)
        sizes.append(len(found))
        ids += map(get, found, [0] * len(found))
        ids.append(0)
        if len(ids) >= SHARD_WORDS or i == len(texts) - 1:
            yield first, sizes, np.array(ids, np.uint32)
            first, sizes, ids = i + 1, [], []


def _occurrences(texts, tests: Tests):
    """(first document, word counts, offsets of documents, suffix array, per occurrence: position, number of the window)."""
    for first, sizes, ids in _shards(texts, tests):
        array = SuffixArray(ids, tests)
        lo, hi = array.range(tests.rows[tests.windows], tests.sizes[tests.windows], tests) if len(tests.windows) else (np.zeros(0, int), np.zeros(0, int))
        which, at = array.spread(lo, hi)
        yield first, sizes, np.concatenate([[0], np.cumsum(np.array(sizes) + 1)]), array, at, which


def _hits(texts, tests: Tests) -> tuple[list, list, list]:
    """Of each text: number of words, hit stretches (from, past the last), ids of items."""
    counts, spans, names = [0] * len(texts), [np.zeros((0, 2), np.int64)] * len(texts), [[] for _ in texts]
    for first, sizes, offsets, _, at, which in _occurrences(texts, tests):
        counts[first : first + len(sizes)] = sizes
        length = tests.sizes[tests.windows][which]
        doc = np.searchsorted(offsets, at, "right") - 1
        order = np.argsort(doc, kind="stable")
        for of in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else ():
            d = int(doc[of[0]])
            spans[first + d] = merged(np.stack([at[of], at[of] + length[of]], 1) - offsets[d])
            names[first + d] = tests.named(which[of])
    return counts, spans, names


def merged(spans: np.ndarray) -> np.ndarray:
    """Stretches of what the spans cover."""
    if len(spans) < 2:
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > ends[:-1]])
    return np.stack([spans[new, 0], ends[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], 1)


def _blocks(items: DataFrame, key: str, limit: int):
    """Items in key order as Tests of about `limit` words each; they come to the driver block by block."""
    held, size = [], 0
    rows = items.select(F.col(key).cast("string").alias("k"), F.col("text").cast("binary").alias("t")).dropDuplicates().orderBy("k", "t")
    for r in rows.toLocalIterator():
        held.append((r.k, bytes(r.t) if r.t is not None else None))
        size += len(r.t or b"") // 2 + 1
        if size >= limit:
            yield Tests(held)
            held, size = [], 0
    yield Tests(held)


SPANS = pa.list_(pa.list_(pa.int64()))


def _searched(docs: DataFrame, items: DataFrame, item_key: str, limit: int, finish, schema: str) -> DataFrame:
    """All rows of docs searched for all items, block by block. finish(batch, words, spans, items) makes the last block's batches."""
    spark = docs.sparkSession
    arrow(spark)
    at, wide = docs.columns.index("text"), len(docs.columns)
    names = [*(f"c{i}" for i in range(wide)), "spans", "items"]
    now = docs.toDF(*names[:wide])
    between = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields)) + ", spans array<array<long>>, items array<string>"
    blocks = _blocks(items, item_key, limit)
    tests, begun = next(blocks), False
    while True:
        following = next(blocks, None)
        shared = spark.sparkContext.broadcast(tests)

        def find(batches, shared=shared, begun=begun, last=following is None):
            tests = shared.value
            for b in batches:
                words_, spans, found = _hits(b.column(at).cast(pa.binary()).to_pylist(), tests)
                if begun:
                    before = [np.array(x, np.int64).reshape(-1, 2) for x in b.column(wide).to_pylist()]
                    spans = [merged(np.concatenate(x)) for x in zip(before, spans)]
                    found = [sorted({*x, *y}) for x, y in zip(b.column(wide + 1).to_pylist(), found)]
                own = b.select(names[:wide])
                if last:
                    yield finish(own, words_, spans, found)
                else:
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array([x.tolist() for x in spans], SPANS), pa.array(found, pa.list_(pa.string()))], names)

        now = now.mapInArrow(find, schema if following is None else between)
        if following is None:
            return now
        now, tests, begun = saved(now, "decontamination-block"), following, True
        shared.unpersist()


def longest_matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", least: int = 5, limit: int = BLOCK_WORDS) -> DataFrame:
    """item, item_start, n_words, key, doc_start: each test suffix with the longest match (`least` words or more) in all shards; ties go to the smallest key, then place."""
    spark = docs.sparkSession
    arrow(spark)
    kind = docs.schema[key].dataType.simpleString()
    out = None
    schema = f"item string, item_start long, n_words long, {key} {kind}, doc_start long"
    for tests in _blocks(items, item_key, limit):
        tests.shortest = 1
        shared = spark.sparkContext.broadcast(tests)

        def find(batches, shared=shared):
            tests = shared.value
            for b in batches:
                rank = pc.rank(b.column(0), sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()
                for first, _, offsets, array, *_ in _occurrences(b.column(1).to_pylist(), tests):
                    n, _ = array.longest(tests)
                    short = np.flatnonzero((n >= least) & (n < WINDOW))
                    suffix, where, size = array.followed(tests, np.flatnonzero(n == WINDOW))
                    which, at = array.spread(*array.range(tests.rows[short], n[short], tests))
                    suffix, where, size = np.append(suffix, short[which]), np.append(where, at), np.append(size, n[short][which])
                    doc = np.searchsorted(offsets, where, "right") - 1
                    order = np.lexsort((where, rank[first + doc], -size, suffix))
                    order = order[np.concatenate([[True], np.diff(suffix[order]) > 0])] if len(order) else order
                    order = order[size[order] >= least]
                    suffix, where, size, doc = suffix[order], where[order], size[order], doc[order]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([tests.names[o] for o in tests.owners[suffix]], pa.string()), pa.array(tests.starts[suffix]), pa.array(size), b.column(0).take(pa.array(first + doc)), pa.array(where - offsets[doc])],
                        ["item", "item_start", "n_words", key, "doc_start"],
                    )

        found = docs.select(key, F.col("text").cast("binary").alias("t")).mapInArrow(find, schema)
        out = found if out is None else out.unionAll(found)
    best = F.min_by(F.struct("n_words", key, "doc_start"), F.struct(-F.col("n_words"), key, "doc_start"))
    return out.groupBy("item", "item_start").agg(best.alias("b")).select("item", "item_start", "b.n_words", f"b.{key}", "b.doc_start")


def _contaminated(words_: int, spans: np.ndarray, share: int) -> tuple[int, bool]:
    hit = int((spans[:, 1] - spans[:, 0]).sum())
    return hit, hit > 0 and share * hit >= words_


def judge(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", share: int = SHARE, limit: int = BLOCK_WORDS) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated and the hit stretches (spans: from, past the last) for every row of docs."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]

    def finish(b, words_, spans, found):
        hits = [_contaminated(n, s, share) for n, s in zip(words_, spans)]
        cols = [pa.array(words_, pa.int64()), pa.array([h[0] for h in hits], pa.int64()), pa.array([len(f) for f in found], pa.int64())]
        cols += [pa.array([hashlib.sha256(",".join(f).encode()).hexdigest() for f in found], pa.string()), pa.array([h[1] for h in hits], pa.bool_()), pa.array([s.tolist() for s in spans], SPANS)]
        return pa.RecordBatch.from_arrays([b.column(0), *cols], names)

    schema = f"{key} {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<long>>"
    return _searched(docs.select(key, "text"), items, item_key, limit, finish, schema)


def filtered(docs: DataFrame, items: DataFrame, share: int = SHARE, limit: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that aren't contaminated, with all columns; decided where the row is."""
    columns = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def finish(b, words_, spans, _):
        good = [not _contaminated(n, s, share)[1] for n, s in zip(words_, spans)]
        return pa.RecordBatch.from_arrays(b.columns, columns).filter(pa.array(good, pa.bool_()))

    return _searched(docs, items, "item_id", limit, finish, schema)


def op7_decontamination(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")
