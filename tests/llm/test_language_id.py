import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from assaylake.llm import language_id as L

PARTS = {"aa": "lo mi na re so tu".split(), "bb": "krz szt pli dob vjr".split(), "cc": "ñan üll ôte ëss".split()}


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(PARTS))
        out.append((i, " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 40))), lang, "x"))
    return out


def test_held_out_accuracy_and_odd_texts(spark):
    df = spark.createDataFrame(rows(300, 1), "doc_id long, text string, lang string, score string")
    model = L.fit(df.where("doc_id % 3 != 0"))
    got = {r.doc_id: r for r in L.identify(df, model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in rows(300, 1) if i % 3 == 0) >= 97
    odd = [(1, None), (2, ""), (3, "12 ²_ 45!"), (4, "日本語"), (5, "krzszt " * 80_000), (5, "krzszt"), (None, "lomina")]
    found = L.identify(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    assert len(found) == 7 and all(0 <= r.score <= 1 for r in found)
    by = {r.doc_id: r.lang_pred for r in found}
    assert by[1] == by[2] == by[3] == "und" and by[4] in PARTS and by[5] == "bb" and by[None] == "aa"


def table(rows):
    return pa.table([pa.array(x) for x in zip(*rows)], ["lang", "item", "n"])


def brute(train, texts):
    """(lang_pred, score) by plain counting."""
    words, grams, langs = Counter(), Counter(), sorted({lang for _, lang in train})
    split = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    for t, lang in train:
        words.update((lang, w) for w in split(t))
    for (lang, w), n in words.items():
        m = f"_{w}_"
        for k in range(1, 6):
            for i in range(len(m) - k + 1):
                grams[lang, m[i : i + k]] += n
    known, pieces = {w for _, w in words}, {g for _, g in grams}
    total = {lang: sum(n for (x, _), n in words.items() if x == lang) for lang in langs}
    of = {(lang, k): sum(n for (x, g), n in grams.items() if x == lang and len(g) == k) for lang in langs for k in range(1, 6)}
    many = Counter(map(len, pieces))
    out = []
    for t in texts:
        sums = dict.fromkeys(langs, 0.0)
        for w in split(t):
            m = f"_{w}_"
            for lang in langs:
                if w in known:
                    sums[lang] += math.log((words[lang, w] + 0.5) / (total[lang] + 0.5 * len(known)))
                    continue
                for k in range(5, 0, -1):
                    found = [m[i : i + k] for i in range(len(m) - k + 1) if m[i : i + k] in pieces]
                    if found:
                        sums[lang] += sum(math.log((grams[lang, g] + 0.5) / (of[lang, k] + 0.5 * many[k])) for g in found) / len(found) + (5 - k) * math.log(0.4)
                        break
        if not langs or not any(c.isalpha() for c in t or ""):
            out.append(("und", 0.0))
        else:
            best = max(langs, key=lambda x: (round(sums[x], 9), -langs.index(x)))
            out.append((best, 1 / sum(math.exp(sums[x] - sums[best]) for x in langs)))
    return out


def test_against_plain_counting(spark):
    data = [*rows(120, 4), (500, "lo mi krz", "aa", "x"), (501, "lo mi krz", "bb", "x"), (502, "tie", "aa", ""), (502, "tie", "bb", ""), (503, None, "aa", ""), (504, "x", None, "")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, score string")
    model = L.fit(df.where("doc_id % 3 != 0"))
    texts = [*[r[1] for r in data], "lox zzz qqq", "tie", "ß"]
    want = brute([(t, lang) for i, t, lang, _ in data if i % 3 and lang and t is not None], texts)
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[i][0] for i in range(len(texts))] == [w[0] for w in want]
    assert np.allclose([got[i][1] for i in range(len(texts))], [w[1] for w in want])


def test_backoff_takes_the_longest_known_grams():
    model = L.Model(table([("a", "stone", 9), ("b", "pierre", 9)]), table([("a", "_st", 3), ("a", "s", 5), ("b", "r", 5)]))
    assert model.unseen("stx").tolist() == (model.grams.sum(np.array([model.grams.ids["_st"]])) + 2 * L.STEP).tolist()
    assert model.predict("stone stone", {})[0] == "a" and model.predict("rrr", {})[0] == "b"


def test_no_labelled_rows(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert L.identify(df, L.fit(df)).first().lang_pred == "und"
    assert L.identify(df.limit(0), L.fit(df)).count() == 0
