"""Ranked lexical search by a K2-treap over the grid of terms and documents.

Documents are cut into shards of about POSTINGS grid cells. In a shard's grid a row is a term, a column a document, and a cell
the document's impact for the term but for the term's weight, which is known at search time only. Quadrants of a quadrant, down
to single cells, are nodes with the largest impact within; empty ones don't exist. Stored are, in level order, a child mask for
each inner node and each node's gap to its parent's maximum, compressed. Rows are ordered by frequency, so rare terms share empty quadrants;
columns by the document's own commonest term, so documents of one language share them.

A search takes one path a term: the quadrants of its row over a range of columns. An item's paths descend together: a column
range's bound is the sum of weight times maximum over the item's terms; ranges are opened best first, a front of them a round,
until none is left whose bound reaches the k-th best score so far, which is carried on through a task's shards. A range of one
column has the exact score. Ties at the k-th score are all followed, so the smallest ids can win.

The number of documents with terms, the number of terms, and the frequencies cover the whole corpus. The index is a written
table. Items go in blocks of about BLOCK words, which are broadcast; any number of blocks is searched against all shards.

A null or empty text has no terms and isn't counted. Rows that share an id are documents of their own; rows of items that share
an id (nulls too) are one item with the terms of all. Null ids come last among equal scores.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm.common import arrow, discard, saved, table

POSTINGS, BLOCK, FRONT = 1 << 20, 1 << 20, 64
K = 10
#: Impact of tf occurrences: SCALE * tf div (1000 * tf + LEN_WEIGHT * m), with m = BASE + SLOPE * length over its mean.
SCALE, LEN_WEIGHT, BASE, SLOPE = 1_000_000_000, 8, 10, 90
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_POP = np.array([i.bit_count() for i in range(16)], np.int64)


class Index(NamedTuple):
    shards: DataFrame
    n_docs: int
    n_terms: int
    kind: str


class Tree(NamedTuple):
    """Nodes in level order: child masks and numbers of the first child (inner nodes only), largest impacts."""

    depth: int
    masks: np.ndarray
    first: np.ndarray
    most: np.ndarray


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_SPLIT).split()


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = BASE + (SLOPE * length * n_docs) // n_terms
    return (SCALE * tf) // (1000 * tf + LEN_WEIGHT * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of x (32 at most) moved to even places."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << shift) & mask
    return x


def grown(rows: np.ndarray, columns: np.ndarray, cells: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Depth, masks of inner nodes and maxima of all nodes, in level order, of a grid with the given cells."""
    depth = max(1, int(max(rows.max(initial=0), columns.max(initial=0))).bit_length())
    code = _spread(rows.astype(np.int64)) << 1 | _spread(columns.astype(np.int64))
    order = np.argsort(code)
    code, cells = code[order], cells[order]
    masks, most = [], [cells]
    for _ in range(depth):
        at = np.flatnonzero(np.diff(code >> 2, prepend=-1))
        masks.append(np.bitwise_or.reduceat(np.uint8(1) << (code & 3).astype(np.uint8), at))
        most.append(np.maximum.reduceat(most[-1], at))
        code = code[at] >> 2
    return depth, np.concatenate(masks[::-1]), np.concatenate(most[::-1])


def _pack(values: np.ndarray) -> bytes:
    """Bytes of one place together, compressed."""
    return zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _parents(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each inner node's first child; number of each node's parent, from node 1 on."""
    kids = _POP[masks]
    return 1 + np.cumsum(kids) - kids, np.repeat(np.arange(len(masks)), kids)


def _shard(ids: list, counts: list[tuple], vocabulary: dict, lengths: list[int], n_docs: int, n_terms: int):
    """A shard's row: the documents by column, terms by row with their frequencies, the tree."""
    sizes = np.fromiter((len(r) for r, _ in counts), np.int64, len(counts))
    rows, tf = np.concatenate([r for r, _ in counts]), np.concatenate([t for _, t in counts])
    length = np.array(lengths, np.int64)
    df = np.bincount(rows, minlength=len(vocabulary))
    by_df = np.argsort(-df, kind="stable")
    place = np.empty(len(df), np.int64)
    place[by_df] = np.arange(len(df))
    rows, at = place[rows], np.concatenate([[0], np.cumsum(sizes)[:-1]])
    docs = np.repeat(np.arange(len(counts)), sizes)
    top = rows[np.lexsort((rows, -tf, docs))[at]]
    by_top = np.lexsort((length, top))
    column = np.empty(len(counts), np.int64)
    column[by_top] = np.arange(len(counts))
    depth, masks, most = grown(rows, column[docs], impacts(tf, length[docs], n_docs, n_terms))
    gaps = most.copy()
    gaps[1:] = most[_parents(masks)[1]] - most[1:]
    words = list(vocabulary)
    named = zstandard.ZstdCompressor(3).compress(b"\n".join(words[i] for i in by_df.tolist()))
    return [ids[i] for i in by_top.tolist()], named, _pack(df[by_df].astype(np.uint32)), depth, _pack(masks), _pack(gaps.astype(np.uint32))


def build(docs: DataFrame, key: str, text: str) -> Index:
    """The index of all documents as a written table, a row a shard."""
    spark = docs.sparkSession
    arrow(spark)
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    kind = texts.schema["key"].dataType.simpleString()
    arrow_kind = pa.array([None], spark.createDataFrame([], f"a {kind}").toArrow().schema.field("a").type).type

    def counted(batches):
        for b in batches:
            n = [len(terms(t.as_py())) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, n))], pa.int64()), pa.array([sum(n)], pa.int64())], ["docs", "terms"])

    n_docs, n_terms = texts.select("text").mapInArrow(counted, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()

    def shards(batches):
        def fresh():
            words: dict = defaultdict()
            words.default_factory = words.__len__
            return [], [], words, []

        def row():
            ids, *rest = _shard(ids_, counts, words, lengths, n_docs, n_terms)
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(arrow_kind)), *(pa.array([x]) for x in rest[:2]), pa.array([rest[2]], pa.int32()), *(pa.array([x]) for x in rest[3:])], ["docs", "terms", "df", "depth", "masks", "gaps"])

        ids_, counts, words, lengths = fresh()
        cells = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                found = Counter(terms(t.as_py()))
                if not found:
                    continue
                ids_.append(i)
                counts.append((np.fromiter(map(words.__getitem__, found), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))))
                lengths.append(found.total())
                cells += len(found)
                if cells >= POSTINGS:
                    yield row()
                    ids_, counts, words, lengths = fresh()
                    cells = 0
        if ids_:
            yield row()

    made = texts.mapInArrow(shards, f"docs array<{kind}>, terms binary, df binary, depth int, masks binary, gaps binary")
    return Index(saved(made, "treap-shards"), n_docs, n_terms, kind)


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of the given runs, one run after the other."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def best(tree: Tree, item: np.ndarray, row: np.ndarray, w: np.ndarray, floor: np.ndarray, k: int):
    """Exact scores of columns: item, score, column, all that reach the item's k-th best or floor. item: sorted, one entry a term."""
    floor = floor.copy()
    at = np.flatnonzero(np.diff(item, prepend=-1))
    size = np.diff(np.append(at, len(item)))
    ranges = np.stack([item[at], np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.add.reduceat(w, at) * tree.most[0] if len(at) else np.zeros(0, np.int64)])
    node, path = np.zeros(len(item), np.int64), np.arange(len(item))
    found = np.zeros((3, 0), np.int64)
    while ranges.shape[1]:
        order = np.lexsort((-ranges[3], ranges[0]))
        order = order[ranges[3, order] >= floor[ranges[0, order]]]
        if not len(order):
            break
        own = ranges[0, order]
        new = np.flatnonzero(np.diff(own, prepend=-1))
        turn = np.arange(len(own)) - np.repeat(new, np.diff(np.append(new, len(own))))
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        rest, now = order[turn >= FRONT], order[turn < FRONT]
        kept = _ragged(starts[rest], size[rest])
        opened = _ragged(starts[now], size[now])
        n_now = size[now]
        more = [(ranges[:, rest], size[rest], node[kept], path[kept])]
        entry, n, p = np.repeat(np.arange(len(now)), n_now), node[opened], path[opened]
        level = ranges[1, now]
        bit = row[p] >> (tree.depth - 1 - level[entry]) & 1
        mask, base = tree.masks[n].astype(np.int64), tree.first[n]
        for side in (0, 1):
            q = 2 * bit + side
            has = np.flatnonzero(mask >> q & 1)
            if not len(has):
                continue
            child = base[has] + _POP[mask[has] & ((1 << q[has]) - 1)]
            e = entry[has]
            first = np.flatnonzero(np.diff(e, prepend=-1))
            bound = np.add.reduceat(w[p[has]] * tree.most[child], first)
            e, n_of = e[first], np.diff(np.append(first, len(has)))
            made = np.stack([ranges[0, now[e]], level[e] + 1, 2 * ranges[2, now[e]] + side, bound])
            good = bound >= floor[made[0]]
            done = good & (made[1] == tree.depth)
            found = np.concatenate([found, made[[0, 3, 2]][:, done]], axis=1)
            going = np.flatnonzero(good & ~done)
            pairs = _ragged(first[going], n_of[going])
            more.append((made[:, going], n_of[going], child[pairs], p[has][pairs]))
        ranges, size = np.concatenate([x[0] for x in more], axis=1), np.concatenate([x[1] for x in more])
        node, path = np.concatenate([x[2] for x in more]), np.concatenate([x[3] for x in more])
        if found.shape[1]:
            found = found[:, np.lexsort((-found[1], found[0]))]
            new = np.flatnonzero(np.diff(found[0], prepend=-1))
            full = new[np.diff(np.append(new, found.shape[1])) >= k]
            floor[found[0, full]] = np.maximum(floor[found[0, full]], found[1, full + k - 1])
            found = found[:, found[1] >= floor[found[0]]]
    return found


def _blocks(items: DataFrame, key: str, text: str):
    """Lists of (id, distinct terms) of about BLOCK words together: each a block to broadcast."""

    def split(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(set(terms(t.as_py()))) for t in b.column(1)], pa.list_(pa.binary()))], ["item", "terms"])

    kind = items.schema[key].dataType.simpleString()
    rows = items.select(F.col(key).alias("item"), F.col(text).cast("binary").alias("text")).mapInArrow(split, f"item {kind}, terms array<binary>")
    rows = saved(rows, "treap-items")
    words = rows.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    n = -(-words // BLOCK)
    for i in range(n):
        mine: dict = {}
        for item, found in rows.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i).toLocalIterator():
            mine.setdefault(item, set()).update(map(bytes, found))
        yield [(item, sorted(found)) for item, found in mine.items() if found]
    discard(rows)


def search(index: Index, items: DataFrame, key: str, text: str, k: int = K) -> DataFrame:
    """key, rank, doc, score: the k best documents of each item."""
    spark = items.sparkSession
    arrow(spark)
    kind, out = items.schema[key].dataType.simpleString(), []
    for block in _blocks(items, key, text):
        asked = spark.sparkContext.broadcast({t for _, found in block for t in found})

        def often(batches, asked=asked):
            for b in batches:
                for named, df in zip(*(c.to_pylist() for c in b.columns)):
                    words, n = zstandard.ZstdDecompressor().decompress(named).split(b"\n"), _unpack(df, np.uint32)
                    here = [i for i, t in enumerate(words) if t in asked.value]
                    yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in here], pa.binary()), pa.array(n[here].astype(np.int64))], ["term", "df"])

        sums = index.shards.select("terms", "df").mapInArrow(often, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
        weights = {bytes(t): weight(df, index.n_docs) for t, df in sums.toLocalIterator()}
        shared = spark.sparkContext.broadcast(([[(t, weights[t]) for t in found if t in weights] for _, found in block]))

        def searched(batches, shared=shared):
            paths = [(i, t, w) for i, found in enumerate(shared.value) for t, w in found]
            item, w = np.array([i for i, _, _ in paths], np.int64), np.array([x for _, _, x in paths], np.int64)
            tops: list = [[] for _ in shared.value]
            for b in batches:
                for docs, named, depth, masks, gaps in zip(*(c.to_pylist() for c in b.columns)):
                    place = {t: i for i, t in enumerate(zstandard.ZstdDecompressor().decompress(named).split(b"\n"))}
                    row = np.fromiter((place.get(t, -1) for _, t, _ in paths), np.int64, len(paths))
                    masks, most = _unpack(masks, np.uint8), _unpack(gaps, np.uint32).astype(np.int64)
                    first, parent = _parents(masks)
                    start = 1
                    while start < len(most):  # a level at a time: a gap is to the parent's maximum
                        stop = int(np.searchsorted(parent, start)) + 1
                        most[start:stop] = most[parent[start - 1 : stop - 1]] - most[start:stop]
                        start = stop
                    floor = np.array([x[-1][0] if len(x) == k else 1 for x in tops], np.int64)
                    here = np.flatnonzero(row >= 0)
                    for i, score, column in best(Tree(depth, masks, first, most), item[here], row[here], w[here], floor, k).T.tolist():
                        tops[i].append((score, docs[column]))
                    tops = [sorted(x, key=lambda y: (-y[0], y[1] is None, 0 if y[1] is None else y[1]))[:k] if len(x) > 1 else x for x in tops]
            flat = [(i, score, doc) for i, x in enumerate(tops) for score, doc in x]
            columns = list(zip(*flat)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], doc_kind)], ["place", "score", "doc"])

        doc_kind = index.shards.select("docs").limit(0).toArrow().schema.field("docs").type.value_type
        got = index.shards.select("docs", "terms", "depth", "masks", "gaps").mapInArrow(searched, f"place int, score long, doc {index.kind}")
        turn = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), F.col("doc").asc_nulls_last()))
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"place int, {key} {kind}")
        out.append(saved(got.withColumn("rank", turn).where(F.col("rank") <= k).join(names, "place").select(key, "rank", "doc", "score"), "treap-found"))
    if not out:
        return spark.createDataFrame([], f"{key} {kind}, rank int, doc {index.kind}, score long")
    found = out[0]
    for more in out[1:]:
        found = found.unionAll(more)
    return found


def op12_ranked_search(spark, sf_dir):
    index = build(table(spark, sf_dir, "documents"), "doc_id", "text")
    return search(index, table(spark, sf_dir, "benchmark"), "item_id", "text").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


def op12_sql() -> str:
    words = r"unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
    return f"""WITH w AS (SELECT doc_id, {words} FROM documents), q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {words} FROM benchmark)),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1), c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n), tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, c GROUP BY term),
m AS (SELECT doc_id, 100 - 90 + (90 * n * docs) // terms AS m FROM n, c),
s AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10"""
