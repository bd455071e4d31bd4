"""Exact substring dedup by merging Burrows-Wheeler transforms of shards.

Every byte goes that a string of 100 bytes covers which also starts earlier: in a document of a smaller
id, or further left in the same one. repeats.py brings the contexts that can share such a string to one
bucket. There they are dealt to SHARDS shards; each shard gets its own multi-string transform; transforms
are merged two by two until one is left. A merge never sorts suffixes: rows stay in the order of their own
transform, and the interleave of the two is refined step by step. At first rows meet by their first symbol;
a step extends what is known of each row by what is known of the row that many symbols on, which the
transform's own successor map gives, and zips the two sorted sides together again. Known lengths double
from step to step up to the 100 symbols. The steps in which two neighbouring rows first part give their
common prefix; rows that haven't parted after 100 symbols are a repeated interval. Where the strings of an
interval, weighted by how often each occurs, are two or more, all of them but the earliest go.

Texts are UTF-8 bytes; a null text is empty. Rows that repeat an id come in the order of their text, by a
hash of it first; of equal rows it doesn't matter which is first. Null ids come before all others. Keys may
be texts: their order is that of the strings. Other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assaylake.llm.common import arrow, table
from assaylake.llm.repeats import Kind, covered, numbered, repeated, spans_of

KIND = Kind(length=100, gram=32, words=False)
SHARDS = 4


class Transform:
    """Multi-string transform: the symbol before each row's suffix (0: the string's end mark), and where the suffix is."""

    def __init__(self, bwt: np.ndarray, at: np.ndarray):
        self.bwt, self.at = bwt, at

    def firsts(self) -> np.ndarray:
        """First symbol of each row: the transform's symbols in order."""
        return np.repeat(np.arange(len(n := np.bincount(self.bwt))), n)

    def successors(self) -> np.ndarray:
        """The row of each row's suffix without its first symbol: the inverse of stepping back."""
        return np.argsort(self.bwt, kind="stable")  # a counting pass: the symbols are 16-bit


def build(texts: list[bytes], base: int = 0, codes: np.ndarray | None = None, depth: int | None = None) -> Transform:
    """Of one shard, by prefix doubling over the rotations of each text and its end mark, in the order of their first `depth` symbols
    (all by default). at: base + place in the texts with their marks. codes: rank of each byte among those of all shards, from 1."""
    codes = np.arange(1, 257) if codes is None else codes
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    if not n:
        return Transform(np.zeros(0, np.uint16), np.zeros(0, np.int64))
    s = np.zeros(n, np.int64)
    inside = np.ones(n, bool)
    inside[ends - 1] = False
    s[inside] = codes[np.frombuffer(b"".join(texts), np.uint8)]
    after = np.arange(1, n + 1)
    after[ends - 1] = ends - sizes
    depth = min(depth or int(sizes.max()), int(sizes.max()))
    key, jump, bits, done = s.astype(np.uint64), after, int(s.max()).bit_length(), 1
    while done * bits * 2 <= 64 and done < depth:
        key = key << np.uint64(bits * done) | key[jump]
        jump = jump[jump]
        done *= 2
    jumps = {done: jump}
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        ranks = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        if done >= depth or ranks[-1] == n - 1:
            break
        rank = np.empty(n, np.int64)
        rank[order] = ranks
        step = min(done, depth - done)
        key = rank * n + rank[_far(jumps, after, step)]
        if done * 2 <= depth:
            jumps[done * 2] = jumps[done][jumps[done]]
        done += step
    before = np.empty(n, np.int64)
    before[after] = s
    return Transform(before[order].astype(np.uint16), order + base)


def _far(jumps: dict[int, np.ndarray], one: np.ndarray, step: int) -> np.ndarray:
    """So many symbols on, composed of the jumps there are."""
    if step in jumps:
        return jumps[step]
    out = None
    for size in sorted(jumps, reverse=True):
        while size <= step:
            out, step = jumps[size] if out is None else jumps[size][out], step - size
    for _ in range(step):
        out = one if out is None else one[out]
    return out


def merge(a: Transform, b: Transform, depth: int, prefixes: bool = True) -> tuple[Transform, np.ndarray]:
    """The transform of both, and the common prefix of each row with the one above, up to `depth`; without prefixes: only 0 or
    `depth`, whether the two have parted within it. Both are in the order of `depth` symbols at least."""
    n = len(a.bwt) + len(b.bwt)
    if not n:
        return a, np.zeros(0, np.int64)
    one = np.concatenate([a.successors(), b.successors() + len(a.bwt)])
    block = np.concatenate([a.firsts(), b.firsts()])
    jumps, known, done = {1: one}, {1: block}, 1
    order = np.argsort(block, kind="stable")
    while done < depth:
        step = min(done, depth - done)
        key = block * n + block[_far(jumps, one, step)]
        order = np.argsort(key, kind="stable")  # zips two sorted sides: rows never move within their own
        sorted_ = key[order]
        ranks = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        block = np.empty(n, np.int64)
        block[order] = ranks
        done += step
        if ranks[-1] == n - 1:
            break
        if done < depth:
            jumps[done] = jumps[done // 2][jumps[done // 2]]
            known[done] = block
    if prefixes:
        p, q = order[:-1], order[1:]
        size = np.zeros(n - 1, np.int64)
        for length in sorted(known, reverse=True):
            same = known[length][p] == known[length][q]
            size += length * same
            p, q = np.where(same, jumps[length][p], p), np.where(same, jumps[length][q], q)
        prefix = np.concatenate([[0], np.minimum(size, depth)])
    else:
        prefix = np.concatenate([[0], np.where(np.diff(block[order]) == 0, depth, 0)])
    return Transform(np.concatenate([a.bwt, b.bwt])[order], np.concatenate([a.at, b.at])[order]), prefix


def intervals(texts: list[bytes], depth: int, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the texts joined with one mark after each) in the order of the merged transform, and the number of the repeated interval of each."""
    shards = max(1, min(shards, len(texts)))
    cuts = np.linspace(0, len(texts), shards + 1).astype(int)
    there = np.zeros(256, bool)
    there[np.frombuffer(b"".join(texts), np.uint8)] = True
    codes = np.where(there, np.cumsum(there), 0)
    parts, base = [], 0
    for i, j in zip(cuts[:-1], cuts[1:]):
        parts.append(build(texts[i:j], base, codes, depth))
        base += sum(len(t) + 1 for t in texts[i:j])
    if len(parts) == 1:
        parts.append(build([]))
    while len(parts) > 1:
        merged = []
        for i in range(0, len(parts) - 1, 2):
            whole, prefix = merge(parts[i], parts[i + 1], depth, prefixes=len(parts) == 2)
            merged.append(whole)
        parts = merged + parts[len(parts) - len(parts) % 2 :]
    return parts[0].at, np.cumsum(prefix < depth)


def compare(texts: list[bytes], sizes: np.ndarray, weights: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """Windows of repeated intervals: all but the earliest (where the heads stand), and all (at other members)."""
    long = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(long) - long
    # Places of windows, in the order of texts; texts are in the order of id and place, so places are too.
    place = np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    weight, number = np.zeros(long.sum(), np.int64), np.zeros(long.sum(), np.int64)
    weight[place], number[place] = weights, np.arange(len(place))
    at, group = intervals(texts, kind.length)
    whole = weight[at] > 0
    at, group = at[whole], group[whole]
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    count = np.diff(np.append(begins, len(at)))
    repeats = np.repeat(np.add.reduceat(weight[at], begins) > 1, count)
    earliest = np.repeat(np.minimum.reduceat(at, begins), count)
    own, rest = np.zeros(len(place), bool), np.zeros(len(place), bool)
    rest[number[at[repeats]]] = True
    own[number[at[repeats & (at != earliest)]]] = True
    return own, rest


def strip(docs: DataFrame, key: str = "doc_id", kind: Kind = KIND, texts: bool = False, **sizes) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every row; with texts: the kept bytes as well."""
    rows = numbered(docs, key)
    spans = repeated(rows, kind, compare, **sizes)
    arrow(docs.sparkSession)
    as_key = docs.schema[key].dataType.simpleString()

    def apply(batches):
        for b in batches:
            out = []
            for t, s in zip(b.column(1).to_pylist(), spans_of(b.column(2))):
                t = t or b""
                if s is None:
                    out.append((len(t), 0, 0, hashlib.sha256(t).hexdigest(), t if texts else None))
                    continue
                gone = covered(s, len(t), kind.length)
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                out.append((len(t), int(np.count_nonzero(gone)), runs, hashlib.sha256(kept).hexdigest(), kept if texts else None))
            cols = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = rows.join(spans, "id_", "left").select(key, "text_", "spans")
    done = joined.mapInArrow(apply, f"{key} {as_key}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if texts else done.drop("kept")


def op4_bwt_dedup(spark, sf_dir):
    return strip(table(spark, sf_dir, "documents"))
