import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from assaylake.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, extra string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            turns.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(int(c / 100) * 100, [])[:h] + v[h:]
    nodes = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, members in nodes.items():
        leaves = saved = 0
        todo = [p]
        while todo:
            q = todo.pop()
            leaves += not kids.get(q)
            saved += (len(nodes[q]) - 1) * len(q[-1][1]) if q else 0
            todo += kids.get(q, [])
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    known = prefix_trie.sequences(spark.createDataFrame(rows, SCHEMA), "conv_id", "turn", "role", "text")
    return sorted(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(known)).select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("cells", [1, 24, 1 << 20])
def test_op13_against_brute_force(spark, monkeypatch, cells):
    """Chunks of any size, down to one conversation a chunk, give the same nodes: copies over many chunks, long and turnless
    conversations, null and equal turns, null and empty roles and texts, repeated rows, code points beyond the BMP."""
    monkeypatch.setattr(prefix_trie, "CELLS", cells)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rng = random.Random(5)
    rows = []
    for c in rng.sample(range(400), 120):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([t, t, None, 3]), rng.choice(["user", "bot", None, ""]), rng.choice(["a", "b", "é𝄞", None, ""]), "x"))
    rows += [(c, t, "user", "copy", None) for c in range(1000, 1040) for t in range(7)]
    rows += [(2000, t, "user", f"long {t}", None) for t in range(60)] + [(2100 + k, t, "user", f"long {t}", None) for k in range(2) for t in range(60 - k)]
    rows += [(4001, 0, "user", "gone", None), (None, 1, "user", "nobody", None), (-3, 1, "user", "below", None)] + rows[:20]
    assert run(spark, rows) == brute(rows)


def test_no_conversations(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "nobody", None)]) == []


def test_extra_columns_with_clashing_names(spark):
    """Columns named as the operator's own ones don't disturb it."""
    rows = [(c, t, "user", f"t{min(c, t)}", "x") for c in range(6) for t in range(3)]
    turns = spark.createDataFrame(rows, SCHEMA)
    clashing = turns.withColumns({c: F.lit("no") for c in ("id", "size", "ids", "sizes", "base", "depth", "slot", "node", "kind")})
    known = prefix_trie.sequences(clashing, "conv_id", "turn", "role", "text")
    assert sorted(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(known)).select(*COLUMNS).collect()), key=str) == brute(rows)
