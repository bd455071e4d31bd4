"""Toxicity by nearest labelled examples.

Labelled rows (a bounded sample, EXAMPLES on average) give the statistics of terms: words, and the
beginnings of longer words. INDEXED of them, toxic and clean ones as they come, become unit vectors over
all of their terms in an inverted index that is cut into blocks, each with its largest weight. A document
searches it for the exact K nearest examples by cosine: common terms, whose postings are blocks of full
length, first, the others by the most they can add; and once what is left can't lift an example among the
best K, only blocks that hold candidates are read.

A term's weight is (1 + log tf) * idf * (FLOOR + gain). idf is log(examples / examples with the term). gain
is how far the toxic share of the examples with the term surely (at the lower end of its 95 % interval) lies
above the base rate; it is zero for most terms, which weigh FLOOR. With plain TF-IDF (gain and FLOOR
left out) neighbours share the common matter of a text and not what makes it toxic: on sf0.1 that finds
0.52 of the held-out toxic rows where 1 % of the clean ones are marked, the weights above 0.94.

The votes of the neighbours are weighted by 1 / (1 - cosine + SOFT) and drawn to the base rate (PRIOR votes).
Shares of votes are then calibrated: an increasing step function, fitted to the votes on the indexed examples
themselves, each without itself and its copies. The evidence is the neighbours' ids, cosines and labels.

Null and empty texts, and texts without a known term: the base rate, no evidence. Ties go to the example of
the smaller key. Rows with a null label teach nothing; labels repeated for an id count as toxic if one of them
is; where an id has several texts each is an example. No labelled row, or only one label: everything scores
the base rate. Keys may be numbers or texts; extra columns are left out (score) or kept (filtered).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import arrow, crc_of_id, discard, gathered, sampled, saved, table

EXAMPLES, INDEXED = 24_000, 3_000
K, BLOCK, SOFT, PRIOR, CUT, FLOOR = 16, 64, 0.05, 1.0, 0.7, 0.02
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (5,)
#: Terms that more than one in COMMON examples has are blocks of full length; TOGETHER texts meet them in one product.
COMMON, TOGETHER = 16, 64
#: ASCII characters that are no letters end words in any text.
ENDS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
#: Columns of the examples; a table's keys may have another type.
EXAMPLE = {"key": pa.int64(), "toxic": pa.int32(), "text_hash": pa.int64(), "terms": pa.list_(pa.string()), "counts": pa.list_(pa.int32())}


def terms_of(word: str) -> list[str]:
    """The word, and its beginnings as `term*` where it is longer."""
    if len(word) <= BEGINNINGS[0]:
        return [word]
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


def terms(text: str | None) -> Counter:
    """Terms of a text, with counts."""
    out: Counter = Counter()
    for w, n in Counter(WORD.findall((text or "").lower())).items():
        for t in terms_of(w):
            out[t] += n
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Index:
    """Block-max inverted index of the examples' unit vectors.

    vocabulary: weight of each term, or an Arrow table of term and weight. examples: rows or an Arrow table of key, toxic,
    text_hash, terms, counts in the order of keys; the terms of tables stay Arrow and numpy arrays, so the driver holds no
    Python object a term or posting."""

    def __init__(self, vocabulary: dict[str, float] | pa.Table, examples: pa.Table | list[tuple], base: float):
        self.base, self.knots = base, None
        if not isinstance(vocabulary, pa.Table):
            vocabulary = pa.table({"term": pa.array(list(vocabulary), pa.string()), "weight": pa.array(list(vocabulary.values()), pa.float64())})
        self.terms = vocabulary.column("term").combine_chunks()
        self.term_weights = vocabulary.column("weight").to_numpy()
        if not isinstance(examples, pa.Table):
            examples = pa.table({c: pa.array([e[i] for e in examples], t) for i, (c, t) in enumerate(EXAMPLE.items())})
        column = examples.column  # in chunks: to put them together would copy every string
        self.docs = column("key").to_pylist()
        self.labels, self.digests = (column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("toxic", "text_hash"))
        sizes = pc.list_value_length(column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
        found = pc.index_in(pc.list_flatten(column("terms")), value_set=self.terms)
        known = pc.is_valid(found).to_numpy(zero_copy_only=False)
        terms_ = pc.fill_null(found, 0).to_numpy(zero_copy_only=False)[known].astype(np.int32)
        rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[known]
        weights = pc.list_flatten(column("counts")).to_numpy(zero_copy_only=False)[known].astype(float)
        np.log(weights, out=weights)
        weights += 1
        weights *= self.term_weights[terms_]
        lengths = np.sqrt(np.bincount(rows, weights * weights, len(sizes)))
        weights /= np.where(lengths > 0, lengths, 1.0)[rows]
        order = np.argsort(terms_, kind="stable")
        del found, known, examples, column
        rows = rows[order]
        terms_ = terms_[order]
        weights = weights[order]
        del order
        count = np.bincount(terms_, minlength=len(self.terms))
        often = np.flatnonzero(count * COMMON > max(len(sizes), 1))
        self.place = np.full(len(self.terms), -1, np.int32)  # a common term's row of full
        self.place[often] = np.arange(len(often))
        seldom = self.place[terms_] < 0
        self.often = (self.place[terms_[~seldom]], rows[~seldom], weights[~seldom], len(often))
        self.rows, self.weights = rows[seldom], weights[seldom]
        del rows, terms_, weights, seldom
        pa.default_memory_pool().release_unused()
        count[often] = 0
        self.at = np.concatenate([[0], np.cumsum(count)])  # where each term's postings begin
        blocks = -(-count // BLOCK)
        self.block_at = np.concatenate([[0], np.cumsum(blocks)])
        inner = _ranges(np.zeros(len(blocks), np.int64), blocks)
        self.block_from = np.repeat(self.at[:-1], blocks) + inner * BLOCK
        self.block_to = np.minimum(self.block_from + BLOCK, np.repeat(self.at[1:], blocks))
        self.tops = np.maximum.reduceat(self.weights, self.block_from) if len(self.weights) else np.zeros(0)
        self.most = np.zeros(len(self.terms))
        np.maximum.at(self.most, np.repeat(np.arange(len(blocks)), blocks), self.tops)

    @property
    def ids(self) -> dict[str, int]:
        """The number of each term, made where it is first asked for: in the tasks, not on the driver."""
        made = self.__dict__.get("ids_")
        if made is None:
            made = self.ids_ = {t: i for i, t in enumerate(self.terms.to_pylist())}
        return made

    def vector(self, found: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights of a text with these terms."""
        known = [(i, n) for t, n in found.items() if (i := self.ids.get(t)) is not None]
        return self._weighed(np.array([k[0] for k in known], np.int64), np.array([k[1] for k in known], np.int64))

    def vector_of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The same of a whole text; remembers the term numbers of tokens that are terms, no more than the vocabulary."""
        memo, ids = self.__dict__.setdefault("memo", {}), self.ids
        found = Counter((text or "").lower().encode("utf-8", "replace").translate(ENDS).split())
        own = []
        for token in found:
            numbers = memo.get(token)
            if numbers is None:
                word = token.decode()
                parts = (word,) if token.isascii() else WORD.findall(word)
                numbers = [ids[t] for part in parts for t in terms_of(part) if t in ids]
                if word in ids:
                    memo[token] = numbers
            own.append(numbers)
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        return self._weighed(np.fromiter(chain.from_iterable(own), np.int64, int(sizes.sum())), np.repeat(np.fromiter(found.values(), np.int64, len(own)), sizes))

    def _weighed(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, of = np.unique(ids, return_inverse=True)
        weights = (1 + np.log(np.bincount(of, counts, len(ids)))) * self.term_weights[ids]
        return ids, weights / (math.sqrt(float(weights @ weights)) or 1.0)

    @property
    def full(self) -> np.ndarray:
        """Blocks of full length of the common terms, made where they are first asked for."""
        made = self.__dict__.get("full_")
        if made is None:
            at, rows, weights, n = self.often
            made = self.full_ = np.zeros((n, len(self.docs)))
            made[at, rows] = weights
        return made

    def common(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What common terms add to the cosine of each text with each example."""
        asked = np.zeros((len(vectors), self.often[-1]))
        for i, (ids, weights) in enumerate(vectors):
            at = self.place[ids]
            asked[i, at[at >= 0]] = weights[at >= 0]
        return asked @ self.full

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int = K, without: np.ndarray | None = None, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest examples with a positive cosine; without: rows that don't count; common: a row of common()."""
        n = len(self.docs)
        scores = self.common([(ids, weights)])[0] if common is None else common.copy()
        seldom = self.place[ids] < 0
        ids, weights = ids[seldom], weights[seldom]
        bound = weights * self.most[ids]
        order = np.argsort(-bound, kind="stable")
        ids, weights, bound = ids[order], weights[order], bound[order]
        rest = np.concatenate([np.cumsum(bound[::-1])[::-1], [0.0]])  # the most that terms from i on can add
        i, step, least = 0, 128, 0.0
        out = np.zeros(n) if without is None else np.where(without, -np.inf, 0.0)
        while i < len(ids) and not (least and rest[i] < least - 1e-9):
            some, w = ids[i : i + step], weights[i : i + step]
            sizes = self.at[some + 1] - self.at[some]
            at = _ranges(self.at[some], sizes)
            scores += np.bincount(self.rows[at], self.weights[at] * np.repeat(w, sizes), n)
            i, step = i + step, step * 4
            if n > k:
                least = max(least, float(np.partition(scores + out, n - k)[n - k]))
        if i < len(ids):
            # No other example can get in: only blocks with candidates are read.
            can = scores + out + rest[i] >= least - 1e-9
            before = np.concatenate([[0], np.cumsum(can)])
            some, w = ids[i:], weights[i:]
            blocks = self.block_at[some + 1] - self.block_at[some]
            of = _ranges(self.block_at[some], blocks)
            w = np.repeat(w, blocks)
            first, last = self.rows[self.block_from[of]], self.rows[self.block_to[of] - 1]
            useful = (before[last + 1] > before[first]) & (w * self.tops[of] > 0)
            of, w = of[useful], w[useful]
            sizes = self.block_to[of] - self.block_from[of]
            at = _ranges(self.block_from[of], sizes)
            scores += np.bincount(self.rows[at], self.weights[at] * np.repeat(w, sizes), n)
            scores[~can] = 0.0
        scores = scores + out
        found = np.flatnonzero(scores > 1e-12)
        if len(found) > 4 * k:
            found = found[scores[found] >= np.partition(scores[found], len(found) - k)[len(found) - k] - 1e-9]
        best = found[np.lexsort((found, -np.round(scores[found], 12)))[:k]]
        return best, scores[best]

    def votes(self, text: str | None, alone: bool = False, vector: tuple | None = None, common: np.ndarray | None = None) -> tuple[float, tuple]:
        """The share of toxic votes and the evidence: rows and cosines; alone: examples with the same text don't vote."""
        ids, weights = vector or self.vector_of(text)
        without = self.digests == digest(text) if alone else None
        rows, near = self.nearest(ids, weights, without=without, common=common) if len(ids) and len(self.docs) else (np.zeros(0, np.int64), np.zeros(0))
        if not len(rows):
            return self.base, (rows, near)
        votes = 1 / (np.maximum(0.0, 1 - near) + SOFT)
        own = PRIOR / (1 + SOFT)
        return (float(votes @ self.labels[rows]) + own * self.base) / (float(votes.sum()) + own), (rows, near)

    def calibrate(self, shares: np.ndarray, labels: np.ndarray) -> None:
        """Fits the increasing step function: shares of votes to shares of toxic examples, pooled where they would fall."""
        pools: list[list[float]] = []
        order = np.argsort(shares, kind="stable")
        for x, y in zip(shares[order].tolist(), labels[order].tolist()):
            pools.append([float(y), 1.0, x, x])
            while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]):
                total, n, _, high = pools.pop()
                pools[-1][0], pools[-1][1], pools[-1][3] = pools[-1][0] + total, pools[-1][1] + n, high
        rates = [(total + self.base) / (n + 1) for total, n, *_ in pools]  # one more vote at the base rate
        rates = np.maximum.accumulate(rates).tolist()
        self.knots = ([x for p in pools for x in p[2:]], [r for r in rates for _ in (0, 1)])

    def score(self, text: str | None) -> tuple[float, tuple]:
        return self.scores([text])[0]

    def scores(self, texts: list[str | None]) -> list[tuple[float, tuple]]:
        """The calibrated score and the evidence of each text."""
        out = []
        for at in range(0, len(texts), TOGETHER):
            some = texts[at : at + TOGETHER]
            vectors = [self.vector_of(t) for t in some]
            for text, vector, common in zip(some, vectors, self.common(vectors)):
                value, evidence = self.votes(text, vector=vector, common=common)
                out.append((float(np.interp(value, *self.knots)) if len(evidence[0]) and self.knots else value, evidence))
        return out


def digest(text: str | None) -> int:
    return xxhash.xxh64_intdigest((text or "").encode()) >> 1


def _term_rows(rows: DataFrame, kind: str) -> DataFrame:
    def count(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                texts = part.column(2).to_pylist()
                found = [terms(t) for t in texts]
                lists = [pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([digest(t) for t in texts], pa.int64()), *lists], ["key", "toxic", "text_hash", "terms", "counts"])

    return rows.select("key", F.col("toxic").cast("int"), "text").mapInArrow(count, f"key {kind}, toxic int, text_hash long, terms array<string>, counts array<int>")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", bound: int = EXAMPLES, indexed: int = INDEXED) -> Index:
    """docs: key, text. labels: key, toxic (0 or 1)."""
    spark = docs.sparkSession
    arrow(spark)
    known = labels.where("toxic is not null").groupBy(key).agg(F.max("toxic").alias("toxic"))
    chosen = sampled(known, key, bound).withColumnRenamed(key, "key")
    kind = docs.schema[key].dataType.simpleString()
    rows = saved(_term_rows(docs.select(F.col(key).alias("key"), "text").join(chosen, "key"), kind), "toxicity-examples")
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total, bad = sum(sizes.values()), sizes.get(1, 0)
    if not total or bad in (0, total):
        return Index({}, [], bad / total if total else 0.0)
    base = bad / total
    shown = sampled(rows, "key", indexed)
    # Copies of a text count once. The sample is bounded, and so is what comes to the driver.
    different = rows.dropDuplicates(["text_hash", "toxic"])
    texts = different.count()
    there = shown.select(F.explode("terms").alias("term")).distinct()
    n = different.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("a"))
    stats = n.join(there, "term", "left_semi")
    stats = gathered(stats.withColumns({c: F.col(c).cast("int") for c in ("n", "a")}).orderBy("term"))
    held, toxic = (stats.column(c).to_numpy().astype(float) for c in ("n", "a"))
    share, z2 = toxic / held, 1.96**2
    low = (share + z2 / 2 / held - 1.96 * np.sqrt(share * (1 - share) / held + z2 / 4 / held / held)) / (1 + z2 / held)
    weight = np.log((1 + texts) / held) * (FLOOR + np.maximum(0.0, (low - base) / (1 - base)))
    vocabulary = pa.table({"term": stats.column("term").combine_chunks(), "weight": weight})
    del stats
    del held, toxic, share, low, weight
    taken = gathered(shown.select("key", "toxic", "text_hash", "terms", "counts").orderBy("key", "text_hash"))
    index = Index(vocabulary, taken, base)
    del taken, vocabulary
    pa.default_memory_pool().release_unused()
    # Each indexed example is judged by the others.
    shared = spark.sparkContext.broadcast(index)

    def judge(batches):
        index = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([index.votes(t, alone=True)[0] for t in b.column(1).to_pylist()], pa.float64()), b.column(0)], ["share", "toxic"])

    own = docs.select(F.col(key).alias("key"), "text").join(shown.select("key", "toxic").distinct(), "key").select("toxic", "text").repartition(spark.sparkContext.defaultParallelism)
    got = own.mapInArrow(judge, "share double, toxic int").toArrow()
    shared.destroy()  # also the driver's blocks
    index.calibrate(got.column("share").to_numpy(), got.column("toxic").to_numpy())
    discard(rows)
    return index


def score(docs: DataFrame, index: Index, key: str = "doc_id", cut: float = CUT) -> DataFrame:
    """key, score, predicted, evidence (example, cosine, label) for every row of docs."""
    arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema[key].dataType.simpleString()

    def judge(batches):
        index = shared.value
        names = pa.array([str(d) for d in index.docs], pa.string())
        for b in batches:
            got = index.scores(b.column(1).to_pylist())
            found = np.array([s for s, _ in got])
            rows = np.concatenate([np.zeros(0, np.int64), *(e[0] for _, e in got)])
            parts = [names.take(pa.array(rows)), pa.array(np.concatenate([np.zeros(0), *(e[1] for _, e in got)])), pa.array(index.labels[rows].astype(np.int32))]
            ends = np.cumsum([0, *(len(e[0]) for _, e in got)]).astype(np.int32)
            evidence = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, ["example", "cosine", "label"]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64()), pa.array((found >= cut).astype(np.int32)), evidence], [key, "score", "predicted", "evidence"])

    return docs.select(key, "text").mapInArrow(judge, f"{key} {kind}, score double, predicted int, evidence array<struct<example:string,cosine:double,label:int>>")


def filtered(docs: DataFrame, index: Index, cut: float = CUT) -> DataFrame:
    """The rows of docs that score below the cut, with all columns; decided where the row is, without a join."""
    arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    at = docs.columns.index("text")

    def keep(batches):
        index = shared.value
        for b in batches:
            yield b.filter(pa.array([s < cut for s, _ in index.scores(b.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = fit(docs, table(spark, sf_dir, "labels").where(crc_of_id() % 3 != 1))
    return score(docs, index).withColumn("held_out", crc_of_id() % 3 == 1).select("doc_id", "held_out", "score", "predicted")
