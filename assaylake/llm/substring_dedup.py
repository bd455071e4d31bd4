"""Substring dedup by suffix automata of reference shards.

Every run of 35 words that also occurs elsewhere goes, all its occurrences. The reference is the corpus
itself, so a broadcast of every shard's automaton to every document would take work in the square of the
corpus; instead the shards are routed: repeats.py brings the contexts that can share a window to one
bucket, the bucket's contexts are a reference shard, its suffix automaton over words is built with
weighted occurrence counts, and the same contexts are streamed through it for matching statistics. Where
the statistics reach the window length, the state of that length tells how often the window occurs.

Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged. Null texts have no words.
Rows that repeat an id are judged one by one; null and empty texts have no words; keys may be null or text.
Other columns are left out. broadcast_matches() is the form with a given, bounded reference: automata of its
shards are broadcast and documents streamed through them.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import arrow, table
from assaylake.llm.repeats import Kind, covered, numbered, repeated, spans_of

KIND = Kind(length=35, gram=10, words=True)
SHARD_WORDS = 200_000


class Automaton:
    """Generalised suffix automaton; count[v]: weighted occurrences of the substrings of state v."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, arcs: dict) -> int:
        self.next.append(arcs)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.link) - 1

    def add(self, words: list, weights: list | None = None) -> None:
        """One more text; weights: how often what ends at each word occurs (once by default)."""
        last, nxt, link, length, count = 0, self.next, self.link, self.length, self.count
        for w, weight in zip(words, weights or [1] * len(words)):
            p = last
            if w in nxt[p]:
                q = nxt[p][w]
                last = q if length[q] == length[p] + 1 else self._split(p, q, w)
            else:
                last = self._state(length[p] + 1, 0, {})
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = last
                    p = link[p]
                if p >= 0:
                    q = nxt[p][w]
                    link[last] = q if length[q] == length[p] + 1 else self._split(p, q, w)
            count[last] += weight

    def _split(self, p: int, q: int, w) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def close(self) -> None:
        """Adds up counts along the links, longest states first."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.count[self.link[v]] += self.count[v]

    def statistics(self, words: list, longest: int):
        """For each word: the longest match that ends there, up to `longest`, and the state it is in."""
        nxt, link, length = self.next, self.link, self.length
        v = have = 0
        for w in words:
            while v and w not in nxt[v]:
                v = link[v]
                have = length[v]
            v = nxt[v].get(w, 0)
            have = have + 1 if v else 0
            if have > longest:
                have = longest
            while have <= length[link[v]] if v else False:
                v = link[v]
            yield have, v


def compare(texts: list[bytes], sizes: np.ndarray, weights: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """Windows that occur more than once among the contexts, by their weights: to go everywhere, at heads and other members."""
    shard, split, known = Automaton(), [], {}
    for t, n, past in zip(texts, sizes.tolist(), np.cumsum(sizes).tolist()):
        words = [known.setdefault(w, len(known)) for w in t.split()]
        split.append(words)
        shard.add(words, [0] * (kind.length - 1) + weights[past - n : past].tolist())
    shard.close()
    count, gone = shard.count, []
    for words in split:
        found = list(shard.statistics(words, kind.length))[kind.length - 1 :]
        gone += [have >= kind.length and count[state] > 1 for have, state in found]
    mask = np.array(gone, bool)
    return mask, mask


def strip(docs: DataFrame, key: str = "doc_id", kind: Kind = KIND, texts: bool = False, **sizes) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 of every row; with texts: the kept text as well."""
    rows = numbered(docs, key)
    spans = repeated(rows, kind, compare, **sizes)
    arrow(docs.sparkSession)
    as_key = docs.schema[key].dataType.simpleString()

    def apply(batches):
        for b in batches:
            out = []
            for t, s in zip(b.column(1).to_pylist(), spans_of(b.column(2))):
                words, removed = (t or b"").split(), 0
                kept = words
                if s is not None:
                    gone = covered(s, len(words), kind.length)
                    removed = int(np.count_nonzero(gone))
                    kept = list(compress(words, (~gone).tolist()))
                kept = b" ".join(kept)
                out.append((len(words), removed, hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            cols = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [key, "n_words", "n_removed", "kept_sha256", "kept"])

    joined = rows.join(spans, "id_", "left").select(key, "text_", "spans")
    done = joined.mapInArrow(apply, f"{key} {as_key}, n_words long, n_removed long, kept_sha256 string, kept string")
    return done if texts else done.drop("kept")


def broadcast_matches(docs: DataFrame, reference: DataFrame, least: int, key: str = "doc_id", shard_words: int = SHARD_WORDS) -> DataFrame:
    """key, spans (start, end) of the maximal stretches of `least` or more words that occur in the reference texts (column text)."""
    spark = docs.sparkSession
    arrow(spark)
    as_key = docs.schema[key].dataType.simpleString()
    shards, held, size = [], Automaton(), 0
    for r in reference.select(F.col("text").cast("binary").alias("t")).where("t is not null").toLocalIterator():
        words = bytes(r.t).split()
        held.add(words)
        size += len(words)
        if size >= shard_words:
            shards.append(spark.sparkContext.broadcast(held))
            held, size = Automaton(), 0
    shards.append(spark.sparkContext.broadcast(held))

    def find(batches):
        for b in batches:
            spans = []
            for t in b.column(1).to_pylist():
                words = (t or b"").split()
                edge = np.zeros(len(words) + 1, np.int64)
                for s in shards:
                    for end, (have, _) in enumerate(s.value.statistics(words, len(words) + 1)):
                        if have >= least:
                            edge[end + 1 - have] += 1
                            edge[end + 1] -= 1
                cut = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8)))
                spans.append([{"start": a, "end": z} for a, z in cut.reshape(-1, 2).tolist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], [key, "spans"])

    return docs.select(key, F.col("text").cast("binary").alias("t")).mapInArrow(find, f"{key} {as_key}, spans array<struct<start:long,end:long>>")


def op9_substring_dedup(spark, sf_dir):
    return strip(table(spark, sf_dir, "documents"))
