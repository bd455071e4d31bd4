"""Where windows of LENGTH symbols repeat: the frame that the two exact substring operators share.

A symbol is a byte or a word. Each window is put down to one anchor in it: the gram of GRAM symbols
whose hash is the least, leftmost of equals. Equal windows have equal anchors at equal places, so windows
need comparing within an anchor's group only: anchors route, the operator's own method decides. Windows
in a row with one anchor are a run; its context is the symbols they cover.

1. The runs of all documents, as hashes; those whose anchor occurs once in the whole table go, as no
   window of theirs can occur twice. Equal contexts are one class: its first occurrence (the head) stands
   for it, its members are its weight.
2. The heads' contexts are cut from their texts. Neighbouring runs of one text that share their anchors
   with no other class need no comparing with others: they stay one stretch, with a weight a window.
   A group of more than HOT classes is split into its single windows, one representative for equal ones,
   so that no task gets an unbounded group.
3. Contexts, stretches and single windows are dealt to buckets of bounded size, whole groups together. The
   operator's method says for each window whether it is to go, for the head and for the other members.
4. The verdicts reach every occurrence by its class, the spans of a document are brought together and its
   text is read once more.

Keys are 64-bit hashes of symbols; a class is told by two of them. Documents are told apart by a unique
id; rows with null, repeated or textual ids are numbered first, in the order of id and text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import arrow, discard, numbered_rows, saved

STEP = 1 << 20  # window starts handled at once
HOT = 2048  # classes of an anchor from which its windows are split up
BUCKET = 1 << 16  # bytes of contexts a bucket, few enough to stay in a cache
STRETCH = 1 << 16  # windows a stretch
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q = np.uint64(pow(int(_P), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASK = np.uint64((1 << 21) - 1)
_tables: dict[str, np.ndarray] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _tables or len(_tables["p"]) < n:
        size = max(n, 1 << 12)
        for name, base in (("p", _P), ("q", _Q)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _tables[name] = np.multiply.accumulate(a)
    return _tables["p"][:n], _tables["q"][:n]


@dataclass(frozen=True)
class Kind:
    """How texts become symbols. symbols(): hashes and the pieces; piece(): the bytes of some of them."""

    length: int
    gram: int
    words: bool

    def symbols(self, text: bytes) -> tuple[np.ndarray, object]:
        if self.words:
            pieces = text.split()
            return np.fromiter(map(xxhash.xxh64_intdigest, pieces), np.uint64, len(pieces)), pieces
        if "bytes" not in _tables:
            _tables["bytes"] = _mixed(np.arange(1, 257, dtype=np.uint64) * _P)
        return _tables["bytes"][np.frombuffer(text, np.uint8)], text

    def piece(self, pieces, start: int, end: int) -> bytes:
        return b" ".join(pieces[start:end]) if self.words else pieces[start:end]


def find_runs(symbols: np.ndarray, kind: Kind) -> tuple[np.ndarray, ...]:
    """Anchor key, class key, first window, number of windows and place of the anchor in the context, of each run."""
    length, gram = kind.length, kind.gram
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    old = np.seterr(over="ignore")
    for begin in range(0, len(symbols) - length + 1, STEP):
        s = symbols[begin : begin + STEP + length - 1]
        p, q = _powers(len(s) + 1)
        sums = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(s * p[: len(s)], out=sums[1:])
        grams = (sums[gram:] - sums[:-gram]) * q[: len(s) - gram + 1]
        m = (_mixed(grams) & ~_MASK) | np.arange(len(grams), dtype=np.uint64)
        wide, got = length - gram + 1, 1
        while got * 2 <= wide:
            m = np.minimum(m[:-got], m[got:])
            got *= 2
        if got < wide:
            m = np.minimum(m[: len(m) - (wide - got)], m[wide - got :])
        at = (m & _MASK).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        n = np.diff(np.append(first, len(at)))
        anchor = at[first]
        whole = (sums[first + n - 1 + length] - sums[first]) * q[first]
        key = _mixed(whole ^ _mixed((anchor - first).astype(np.uint64) << np.uint64(32) | n.astype(np.uint64)))
        for o, x in zip(out, (grams[anchor].view(np.int64), key.view(np.int64), first + begin, n, anchor - first)):
            o.append(x)
    np.seterr(**old)
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)


def numbered(docs: DataFrame, key: str) -> DataFrame:
    """id_, key, text_: id_ unique, in the order of key and text. The key itself where it is a number, unique and never null."""
    rows = docs.select(F.col(key), F.col("text").cast("binary").alias("text_"))
    if docs.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        if not docs.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).limit(1).count():
            return rows.select(F.col(key).cast("long").alias("id_"), key, "text_")
    return saved(numbered_rows(rows, key, "text_", "id_").select("id_", key, "text_"), "repeats-numbered")


def _runs(rows: DataFrame, kind: Kind) -> DataFrame:
    """akey, ckey, id_, at (first window, the anchor's place, the number of windows) of the runs whose anchor recurs in the table."""

    def find(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            found = [find_runs(kind.symbols(t or b"")[0], kind) for t in b.column(1).to_pylist()]
            if sizes := [len(f[0]) for f in found]:
                akey, ckey, first, n, place = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (akey, ckey, np.repeat(ids, sizes), first << 20 | place << 10 | n)], ["akey", "ckey", "id_", "at"])

    held = saved(rows.select("id_", "text_").mapInArrow(find, "akey long, ckey long, id_ long, at long"), "repeats-anchors")
    often = saved(held.groupBy("akey").agg(F.count("*").alias("n")).where("n > 1").select("akey"), "repeats-often")
    out = saved(held.join(often, "akey", "left_semi").select("akey", "ckey", "id_", "at"), "repeats-runs")
    discard(held, often)
    return out


def _contexts(rows: DataFrame, classes: DataFrame, kind: Kind, hot: int) -> DataFrame:
    """key, id_, first, hot, the runs in it (akeys, ckeys, ats, ns, members) and context, of the heads of the given classes."""
    length = kind.length
    names = ["key", "id_", "first", "hot", "akeys", "ckeys", "ats", "ns", "members", "context"]
    longs = pa.list_(pa.int64())
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), longs, longs, longs, longs, longs, pa.binary()]

    def cut(batches):
        for b in batches:
            out = []
            for i, text, wanted in zip(*(c.to_pylist() for c in b.columns)):
                _, pieces = kind.symbols(text)
                held: list = []

                def close(i=i, pieces=pieces, held=held):
                    akeys, ckeys, ats, ns, members, counts = (list(c) for c in zip(*held))
                    first = ats[0] >> 20
                    out.append((akeys[0], i, first, counts[0] > hot, akeys, ckeys, ats, ns, members, kind.piece(pieces, first, first + sum(ns) + length - 1)))
                    held.clear()

                past = size = 0
                for r in sorted(wanted, key=lambda r: r["at"]):
                    first, n = r["at"] >> 20, r["at"] & 1023
                    if held and (r["classes"] > 1 or held[0][5] > 1 or first != past or size > STRETCH):
                        close()
                    size = size + n if held else n
                    held.append((r["akey"], r["ckey"], r["at"], n, r["members"], r["classes"]))
                    past = first + n
                close()
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    wanted = classes.groupBy(F.col("head.id_").alias("id_")).agg(F.collect_list(F.struct("akey", "ckey", "members", F.col("head.at").alias("at"), "classes")).alias("wanted"))
    joined = rows.join(wanted, "id_").select("id_", "text_", "wanted")
    lists = ", ".join(f"{x} array<long>" for x in names[4:9])
    return joined.mapInArrow(cut, f"key long, id_ long, first long, hot boolean, {lists}, context binary")


def _intervals(mask: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    """Of each of n runs: (from, past the last) of its marked windows, in a row; owner: the run of each window, in order."""
    begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    place = np.arange(len(owner)) - np.repeat(begins, np.diff(np.append(begins, len(owner))))
    opened, closed = mask.copy(), mask.copy()
    opened[1:] &= ~(mask[:-1] & (owner[1:] == owner[:-1]))
    closed[:-1] &= ~(mask[1:] & (owner[1:] == owner[:-1]))
    starts, ends = np.flatnonzero(opened), np.flatnonzero(closed)
    flat = np.stack([place[starts], place[ends] + 1], 1).reshape(-1)
    sizes = 2 * np.bincount(owner[starts], minlength=n)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat.astype(np.int64)))


VERDICTS = "akey long, ckey long, id_ long, at long, own array<long>, rest array<long>"


def _verdicts(contexts: DataFrame, kind: Kind, compare: Callable, bucket: int) -> DataFrame:
    """akey, ckey, id_, at of the judged runs, and the windows (pairs from, past the last) to go: own for the head itself, rest for other members."""

    def judge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id_", "ascending"), ("first", "ascending")])
        col = lambda c: table.column(c).combine_chunks()
        flat = {c: col(c).flatten() for c in ("akeys", "ckeys", "ats", "ns", "members")}
        runs = col("ns").value_lengths().to_numpy()
        ns = flat["ns"].to_numpy()
        owner = np.repeat(np.arange(len(ns)), ns)
        sizes = np.add.reduceat(ns, np.cumsum(runs) - runs)
        own, rest = compare(col("context").to_pylist(), sizes, flat["members"].to_numpy()[owner], kind)
        ids = pa.array(np.repeat(col("id_").to_numpy(), runs))
        out = pa.table([flat["akeys"], flat["ckeys"], ids, flat["ats"], _intervals(own, owner, len(ns)), _intervals(rest, owner, len(ns))], ["akey", "ckey", "id_", "at", "own", "rest"])
        return out.filter(pa.array(np.bincount(owner, own | rest, len(ns)) > 0))

    total = contexts.agg(F.sum(F.length("context")).alias("b")).first().b or 0
    dealt = contexts.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(int(total // bucket) + 1)))
    return dealt.groupBy("bucket").applyInArrow(judge, VERDICTS)


def _split(contexts: DataFrame, kind: Kind) -> DataFrame:
    """h1, h2 and members of every window of the contexts, with its class (akey, ckey), its number there (w) and its text's id_ and pos."""

    def split(batches):
        for b in batches:
            for i, first, akeys, ckeys, members, context in zip(*(c.to_pylist() for c in b.columns)):
                symbols, parts = kind.symbols(context)
                n = len(symbols) - kind.length + 1
                whole = [kind.piece(parts, w, w + kind.length) for w in range(n)]
                h = np.array([(xxhash.xxh64_intdigest(x, 1) >> 1, xxhash.xxh64_intdigest(x, 2) >> 1) for x in whole], np.int64)
                same = lambda v, n=n: np.full(n, v, np.int64)
                cols = (h[:, 0], h[:, 1], same(members[0]), same(akeys[0]), same(ckeys[0]), np.arange(n), same(i), first + np.arange(n))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h1", "h2", "members", "akey", "ckey", "w", "id_", "pos"])

    return contexts.select("id_", "first", "akeys", "ckeys", "members", "context").mapInArrow(split, "h1 long, h2 long, members long, akey long, ckey long, w long, id_ long, pos long")


def _window_contexts(windows: DataFrame, contexts: DataFrame, kind: Kind) -> DataFrame:
    """One representative of each window that occurs twice, in the columns of contexts: the first, weighted by all."""

    def cut(batches):
        for b in batches:
            out = []
            for context, ws in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                _, parts = kind.symbols(context)
                for r in ws:
                    out.append((r["h1"], r["id_"], r["pos"], False, [r["h1"]], [r["h2"]], [r["pos"]], [1], [r["m"]], kind.piece(parts, r["w"], r["w"] + kind.length)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema)

    longs = pa.list_(pa.int64())
    schema = pa.schema([("key", pa.int64()), ("id_", pa.int64()), ("first", pa.int64()), ("hot", pa.bool_()), *((x, longs) for x in ("akeys", "ckeys", "ats", "ns", "members")), ("context", pa.binary())])
    heads = windows.groupBy("h1", "h2").agg(F.sum("members").alias("m"), F.min(F.struct("id_", "pos", "akey", "ckey", "w")).alias("head")).where("m > 1")
    wanted = heads.groupBy("head.akey", "head.ckey").agg(F.collect_list(F.struct("h1", "h2", "m", "head.id_", "head.pos", "head.w")).alias("ws"))
    of = contexts.select(F.col("akeys")[0].alias("akey"), F.col("ckeys")[0].alias("ckey"), "context")
    return of.join(wanted, ["akey", "ckey"]).select("context", "ws").mapInArrow(cut, contexts.schema)


def repeated(rows: DataFrame, kind: Kind, compare: Callable, hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """id_, spans (first window of a run, pairs from and past the last in it): the windows of each document to be removed.

    compare(contexts, sizes, weights, kind) judges one bucket: its contexts in the order of id and place, how many windows
    each has, and the weight of every window (all contexts' in a row). It gives two masks over these windows: those to go
    where the head stands, and those to go at the other members.
    """
    arrow(rows.sparkSession)
    runs = _runs(rows, kind)
    classes = saved(runs.groupBy("akey", "ckey").agg(F.count("*").alias("members"), F.min(F.struct("id_", "at")).alias("head")), "repeats-classes")
    counted = classes.join(classes.groupBy("akey").agg(F.count("*").alias("classes")), "akey")
    contexts = saved(_contexts(rows, counted, kind, hot), "repeats-contexts")
    judged, windows = contexts.where("not hot"), None
    if contexts.where("hot").limit(1).count():
        windows = saved(_split(contexts.where("hot"), kind), "repeats-windows")
        singles = saved(_window_contexts(windows, contexts.where("hot"), kind), "repeats-singles")
        judged = judged.unionByName(singles)
    verdicts = saved(_verdicts(judged, kind, compare, bucket), "repeats-verdicts")
    of = verdicts.withColumnsRenamed({"id_": "head_id", "at": "head_at"})
    if windows is not None:
        # Verdicts on single windows go back to the classes that hold them.
        met = windows.join(of.withColumnsRenamed({"akey": "h1", "ckey": "h2"}), ["h1", "h2"])
        head = (F.col("id_") == F.col("head_id")) & (F.col("pos") == F.col("head_at"))
        pair = F.array("w", F.col("w") + 1)
        met = met.select("akey", "ckey", F.when(F.size(F.when(head, F.col("own")).otherwise(F.col("rest"))) > 0, pair).alias("own"), F.when(F.size("rest") > 0, pair).alias("rest"))
        met = met.groupBy("akey", "ckey").agg(F.flatten(F.collect_list("own")).alias("own"), F.flatten(F.collect_list("rest")).alias("rest"))
        met = met.join(classes.select("akey", "ckey", F.col("head.id_").alias("head_id"), F.col("head.at").alias("head_at")), ["akey", "ckey"])
        of = of.unionByName(met)
    here = (F.col("id_") == F.col("head_id")) & (F.col("at") == F.col("head_at"))
    found = runs.join(of, ["akey", "ckey"]).select("id_", F.shiftright("at", 20).alias("first"), F.when(here, F.col("own")).otherwise(F.col("rest")).alias("gone")).where(F.size("gone") > 0)
    out = saved(found.groupBy("id_").agg(F.collect_list(F.struct("first", "gone")).alias("spans")), "repeats-spans")
    discard(runs, classes, contexts, verdicts, *([windows, singles] if windows is not None else []))
    return out


def spans_of(column: pa.ListArray) -> list[np.ndarray | None]:
    """Of each row: its spans as (from, past the last), two columns; None where there are none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    first, gone = flat.flatten()
    pairs = gone.flatten().to_numpy().reshape(-1, 2)
    pairs = pairs + np.repeat(first.to_numpy(), gone.value_lengths().to_numpy() // 2)[:, None] if len(pairs) else pairs
    sizes = np.add.reduceat(np.append(gone.value_lengths().to_numpy() // 2, 0), np.cumsum(n := column.value_lengths().fill_null(0).to_numpy()) - n) * (n > 0)
    ends = np.cumsum(sizes)
    return [pairs[e - s : e] if s else None for s, e in zip(sizes.tolist(), ends.tolist())]


def covered(spans: np.ndarray | None, n: int, length: int) -> np.ndarray:
    """Mask of the symbols covered by windows that start in the spans."""
    if spans is None:
        return np.zeros(n, bool)
    edge = np.bincount(spans[:, 0], minlength=n + 1) - np.bincount(spans[:, 1] + length - 1, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0
