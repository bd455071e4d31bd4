"""Each registered query over a whole small table, against a brute-force version; and the pipeline, stage by stage."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from assaylake.llm import mixing, progressive_jpeg, registry, toxicity
from tests.llm import test_bwt_dedup, test_decontamination, test_simhash, test_substring_dedup

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def rows(spark, name, sf=SF):
    return registry.QUERIES[name](spark, sf).collect()


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_op1(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = rows(spark, "op1_language_id")
    assert len(got) == len(truth) and all(r.held_out == (fold(r.doc_id, 4) == 2) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) > 0.95


def test_op2(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op2_progressive_jpeg")}
    for i, t in docs:
        raw = (t or "").encode()
        p = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        media = progressive_jpeg.pack(raw)
        assert tuple(got[i])[1:7] == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest())


def tokens(pairs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, text in sorted(pairs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op3(spark, docs):
    assert sorted(map(tuple, rows(spark, "op3_token_files"))) == tokens(docs)


def test_op4(spark, docs):
    assert sorted(map(tuple, rows(spark, "op4_bwt_dedup"))) == test_bwt_dedup.brute(docs, 100)


def components(pairs):
    fps = [test_simhash.brute(t) for _, t in pairs]
    root = test_simhash.closure(fps)
    least = {}
    for k, (i, _) in zip(root, pairs):
        least[k] = min(i, least.get(k, i))
    return {i: (f"{f:016x}", least[k]) for (i, _), f, k in zip(pairs, fps, root)}


def test_op5(spark, docs):
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op5_simhash")} == components(docs)


def decontaminated(pairs, items):
    """Like test_decontamination.brute, with a look-up of windows."""
    windows = {}
    for k, text in items:
        v = test_decontamination.low(text)
        n = min(13, len(v))
        for j in range(len(v) - n + 1) if v else ():
            windows.setdefault(n, {}).setdefault(tuple(v[j : j + n]), set()).add(str(k))
    out = []
    for i, t in pairs:
        w, hit, names = test_decontamination.low(t), set(), set()
        for n, known in windows.items():
            for p in range(len(w) - n + 1):
                if (found := known.get(tuple(w[p : p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    names |= found
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def bench_items(spark, sf=SF):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]


def test_op7(spark, docs):
    got = sorted(map(tuple, rows(spark, "op7_decontamination")))
    assert got == decontaminated(docs, bench_items(spark)) and any(r[5] for r in got)


def test_op8(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    got = rows(spark, "op8_toxicity", LARGER)
    assert len(got) == 1000 and all(r.held_out == (fold(r.doc_id, 3) == 1) and r.predicted == (r.score >= 0.7) for r in got)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(p for p, t in held if t == 0) <= 2 and np.mean([p for p, t in held if t == 1]) > 0.5


def test_op9(spark, docs):
    assert sorted(map(tuple, rows(spark, "op9_substring_dedup")), key=str) == test_substring_dedup.brute(docs, 35)


def test_op10(spark, docs):
    got = rows(spark, "op10_sharding")
    assert len(got) == len(docs) and all(r.slot == int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) % 65_537 for r in got)


def mixed(pairs):
    """Fit and sampling in plain Python; pairs: (id, text, lang, source)."""
    def topic(t):
        if not t:
            return "none"
        n = len(t)
        if t.count("|") / n > 0.01:
            return "tabular"
        if t.count("<") / n + t.count("{") / n > 0.005:
            return "markup"
        if len(re.findall("[0-9]", t)) / n > 0.05:
            return "numeric"
        return "lines" if t.count("\n") / n > 0.01 else "prose"

    cell = {i: (s or "none", lang or "none", topic(t)) for i, t, lang, s in pairs}
    tok = {}
    for i, t, *_ in pairs:
        tok[cell[i]] = tok.get(cell[i], 0) + (t.count(" ") + 1 if t else 0)
    w, total, targets = {c: float(v) for c, v in tok.items()}, sum(tok.values()), []
    for d, power in enumerate((mixing.SOURCE_POWER, mixing.LANG_POWER, mixing.TOPIC_POWER)):
        sums = {}
        for c, v in tok.items():
            sums[c[d]] = sums.get(c[d], 0) + v
        z = sum(v**power for v in sums.values())
        targets.append({k: v**power / z for k, v in sums.items()})
    for _ in range(mixing.SWEEPS):
        for d in range(3):
            sums = {}
            for c, v in w.items():
                sums[c[d]] = sums.get(c[d], 0) + v
            w = {c: v * targets[d][c[d]] * total / sums[c[d]] if sums[c[d]] > 0 else v for c, v in w.items()}
    m = {c: w[c] / tok[c] if tok[c] else 1.0 for c in tok}
    drawn = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32
    return [r for r in pairs for _ in range(int(m[cell[r[0]]]) + (drawn(r[0]) < m[cell[r[0]]] % 1))]


def near(pairs):
    """The id of the smallest member of each one's group: five-word Jaccard similarity of 0.8 or more, all pairs compared."""
    sets = []
    for _, t in pairs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(pairs)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(pairs)):
        for b in range(a):
            x, y = len(sets[a]), len(sets[b])
            if x and 5 * x >= 4 * y and 5 * y >= 4 * x and 9 * len(sets[a] & sets[b]) >= 4 * (x + y):
                k, j = sorted((top(a), top(b)))
                root[j] = k
    return {pairs[k][0]: pairs[top(k)][0] for k in range(len(pairs))}


def test_pipeline(spark, tmp_path):
    table = spark.read.parquet(f"{LARGER}/documents.parquet")
    stages, now = {}, table
    for name, f in corpus_pipeline.STAGES:
        f(spark, now, LARGER).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        stages[name] = now
    cols = ("doc_id", "text", "lang", "source")
    take = lambda df: sorted(tuple(r[c] for c in cols) for r in df.collect())
    before = take(table)
    assert all(stages[n].columns == table.columns for n in list(stages)[:-1])

    labels = spark.read.parquet(f"{LARGER}/labels.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    index = toxicity.fit(table, labels)
    after = take(stages["toxicity"])
    assert after == [r for r in before if index.score(r[1])[0] < toxicity.CUT] and len(after) < len(before)

    kept = near([r[:2] for r in after])
    apart = take(stages["simhash_near_dedup"])
    assert apart == [r for r in after if kept[r[0]] == r[0]] and len(apart) < len(after)

    clean = {r[0] for r in decontaminated([r[:2] for r in apart], bench_items(spark, LARGER)) if not r[5]}
    decon = take(stages["decontamination"])
    assert decon == [r for r in apart if r[0] in clean] and len(decon) < len(apart)

    sampled = take(stages["mixing"])
    assert sampled == mixed(decon) and sampled != decon
    want = tokens([r[:2] for r in sampled])
    assert sorted(map(tuple, stages["token_output"].collect())) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, LARGER).collect())) == want
