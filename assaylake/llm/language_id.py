"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to the longest
character n-grams of it that are known (n = 5 down to 1, the word's ends marked), each step shorter at
a fixed log penalty that is the same for all languages. A document's score is the sum over its words.

The model is learned from a bounded sample of labelled rows (TRAIN_DOCS) and holds all of its words and
n-grams, each with the languages it occurs in, so its size is bounded by the sample whatever the number of
languages; every document is scored on its whole text.

Null or letterless texts: `und`, score 0. No labelled row at all: every text is `und`. Languages that tie: the
first by name. Rows that repeat an id, or have none, are learned from and scored one by one. Extra columns are
left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import arrow, crc_of_id, discard, sampled, saved, table

TRAIN_DOCS, LONGEST = 20_000, 5
STEP = math.log(0.4)
WORD = re.compile(r"[^\W\d_]+")


def count_words(rows: DataFrame) -> DataFrame:
    """(lang, word, n) over rows with text and lang; counted per batch before the shuffle."""

    def count(batches):
        for b in batches:
            by = defaultdict(Counter)
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                by[lang].update(WORD.findall((text or "").lower()))
            flat = [(lang, w, n) for lang, c in by.items() for w, n in c.items()]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*flat)], ["lang", "word", "n"])

    return rows.select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Scores:
    """Log frequencies of items by language: a value for each language that an item doesn't occur in, and what those it does gain.

    found: columns lang, item, n. group: items of one group share their totals."""

    def __init__(self, found: pa.Table, langs: list[str], group):
        at = {lang: i for i, lang in enumerate(langs)}
        items = found.column("item").to_pylist()
        self.ids: dict[str, int] = {}
        row = np.array([self.ids.setdefault(x, len(self.ids)) for x in items], np.int64)
        lang = np.array([at[x] for x in found.column("lang").to_pylist()], np.int64)
        n = found.column("n").to_numpy().astype(float)
        kinds = np.array([group(x) for x in self.ids], np.int64)
        sizes = int(kinds.max(initial=0)) + 1
        totals = np.zeros((sizes, len(langs)))
        np.add.at(totals, (kinds[row], lang), n)
        totals = np.log(totals + 0.5 * np.bincount(kinds, minlength=sizes)[:, None] + 1e-300)
        self.kinds, self.absent = kinds, np.log(0.5) - totals
        order = np.argsort(row, kind="stable")
        self.langs, self.gains = lang[order], (np.log(n + 0.5) - np.log(0.5))[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(self.ids)))])

    def sum(self, ids: np.ndarray) -> np.ndarray:
        """By language, over all the items given, repeats included."""
        size = self.at[ids + 1] - self.at[ids]
        ends = np.cumsum(size)
        of = np.repeat(self.at[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        kinds = np.bincount(self.kinds[ids], minlength=len(self.absent))
        return kinds @ self.absent + np.bincount(self.langs[of], self.gains[of], self.absent.shape[1])


class Model:
    """Words, and the n-grams of words, with their scores by language."""

    def __init__(self, words: pa.Table, grams: pa.Table):
        self.langs = sorted(set(words.column("lang").to_pylist()))
        self.words, self.grams = Scores(words, self.langs, lambda w: 0), Scores(grams, self.langs, len)

    def unseen(self, word: str) -> np.ndarray:
        marked, get = f"_{word}_", self.grams.ids.get
        for n in range(LONGEST, 0, -1):
            known = [g for i in range(len(marked) - n + 1) if (g := get(marked[i : i + n])) is not None]
            if known:
                return self.grams.sum(np.array(known)) / len(known) + STEP * (LONGEST - n)
        return np.zeros(len(self.langs))

    def predict(self, text: str | None, cache: dict) -> tuple[str, float]:
        found = WORD.findall((text or "").lower())
        if not self.langs or not any(c.isalpha() for w in found for c in w):
            return "und", 0.0
        ids = np.fromiter(map(self.words.ids.get, found, repeat(-1)), np.int64, len(found))
        total = self.words.sum(ids[ids >= 0])
        for i in np.flatnonzero(ids < 0).tolist():
            word = found[i]
            if (score := cache.get(word)) is None:
                if len(cache) > 200_000:
                    cache.clear()
                score = cache[word] = self.unseen(word)
            total = total + score
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def fit(labelled: DataFrame, key: str = "doc_id", bound: int = TRAIN_DOCS) -> Model:
    """labelled: key, text, lang. Rows with a null text or lang teach nothing."""
    arrow(labelled.sparkSession)
    rows = sampled(labelled.where("lang is not null and text is not null"), key, bound)
    words = saved(count_words(rows), "langid-words")
    marked = F.concat(F.lit("_"), "word", F.lit("_"))
    grams = words.select("lang", "n", F.explode(F.array(*[F.lit(i) for i in range(1, LONGEST + 1)])).alias("k"), marked.alias("m"))
    grams = grams.where("length(m) >= k").select("lang", "n", F.explode(F.expr("transform(sequence(1, length(m) - k + 1), i -> substr(m, i, k))")).alias("gram"))
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # All counts of the bounded sample come to the driver.
    take = lambda df, item: df.select("lang", F.col(item).alias("item"), "n").orderBy("lang", "item").toArrow()
    model = Model(take(words, "word"), take(grams, "gram"))
    discard(words)
    return model


def identify(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score for every row of docs."""
    arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def predict(batches):
        model, cache = shared.value, {}
        for b in batches:
            got = [model.predict(t, cache) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [key, "lang_pred", "score"])

    return docs.select(key, "text").mapInArrow(predict, f"{key} {kind}, lang_pred string, score double")


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(crc_of_id() % 4 != 2))
    return identify(docs, model).withColumn("held_out", crc_of_id() % 4 == 2).select("doc_id", "held_out", "lang_pred", "score")
