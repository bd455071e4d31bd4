"""Prefix trie of conversations from padded turn-id matrices.

Different turns get dense ids in the order of (role, text), exactly, by a written dictionary. A conversation is a row of ids;
Spark sorts the rows into range shards by ids and conversation, so equal conversations, however many, spread over shards. A
task cuts its shard into chunks of CELLS matrix cells: rows padded with -1, numpy lexsort, changes between neighbours
OR-accumulated along the columns, and where depth d's column has a change a node of depth d starts. Sums and minima of a depth
are reduceat over these starts; subtree sums come from the deepest column up.

Nodes that hold a chunk's first or last row may go on in the next chunk. They are emitted in parts, named by slot (2 * chunk,
and one more for the last row's path) and depth, and recombined in Spark: parts of one depth are one node as long as
neighbouring chunks share that many turns. All other nodes are whole. There are two parts a chunk and depth at most.

The digest of the conversations that end at a node is sequential by its nature: those of a node over several chunks are fed to
it in pieces, in order, by one streaming task that holds one piece at a time.

Rows with a null conversation id belong to no conversation and are left out; rows with the same turn are ordered by role and
text; repeated rows are turns of their own. Without conversations there is no node. A conversation's ids must fit one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm.common import arrow, crc_of_id, discard, saved, table

#: Cells of one padded matrix; ids in one piece of a digest's input.
CELLS, PIECE = 1 << 20, 1 << 15
HEAD, BASE = 6, 100
_SUMS = ["n_convs", "children", "leaves", "saved"]
_SCHEMA = (
    "kind string, slot long, depth int, conv_id long, parent_conv_id long, parent_slot long, n_convs long, children long, leaves long, saved long, "
    "size long, both boolean, sha string, piece int, ids string, head array<long>, tail array<long>"
)
_TYPES = {
    "kind": pa.string(), "slot": pa.int64(), "depth": pa.int32(), "conv_id": pa.int64(), "parent_conv_id": pa.int64(), "parent_slot": pa.int64(), "n_convs": pa.int64(), "children": pa.int64(), "leaves": pa.int64(), "saved": pa.int64(),
    "size": pa.int64(), "both": pa.bool_(), "sha": pa.string(), "piece": pa.int32(), "ids": pa.string(), "head": pa.list_(pa.int64()), "tail": pa.list_(pa.int64()),
}
EMPTY = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turns: the turns of each conversation in order, as structs of turn, id and code points."""
    clean = turns.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    words = clean.select("role", "text").distinct().repartitionByRange("role", "text").sortWithinPartitions("role", "text")
    words = saved(words.select("role", "text", F.monotonically_increasing_id().alias("id"), F.char_length("text").cast("long").alias("size")), "trie-words")
    known = clean.join(words, ["role", "text"]).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "size"))).alias("turns"))
    out = saved(known, "trie-conversations")
    discard(words)
    return out


def rebuilt(known: DataFrame) -> DataFrame:
    """Conversations that open with the first turns of their hundred's first one; how many, a checksum says."""
    heads = known.where(F.col("conv_id") % BASE == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEAD - 1).alias("head"))
    h = (crc_of_id("conv_id") % HEAD).cast("int")
    own = known.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % BASE).alias("base")).join(heads, "base", "left")
    opening = F.coalesce(F.expr("slice(head, 1, h)"), F.expr("slice(turns, 1, 0)"))
    return own.select("conv_id", F.concat(opening, F.expr("slice(turns, h + 1, size(turns))")).alias("turns"))


def _chunk(conv: np.ndarray, ids: list[np.ndarray], sizes: list[np.ndarray], chunk: int):
    """Record batches for one chunk: whole nodes, parts of nodes, pieces of what ends at them, the chunk's bounds."""
    length = np.fromiter(map(len, ids), np.int64, len(ids))
    n, deep = len(ids), int(length.max(initial=0))
    cells, texts = np.full((n, deep), -1, np.int64), np.zeros((n, deep), np.int64)
    filled = np.arange(deep) < length[:, None]
    cells[filled], texts[filled] = np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])
    order = np.lexsort((conv, *cells.T[::-1]))
    conv, length, cells, texts = conv[order], length[order], cells[order], texts[order]
    change = np.ones((n, deep + 1), bool)
    change[1:, 0] = False
    change[1:, 1:] = np.logical_or.accumulate(cells[1:] != cells[:-1], axis=1)
    leaves, saves, below, out = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), []
    for d in range(deep, -1, -1):
        at = np.flatnonzero(change[:, d])
        total = np.diff(np.append(at, n))
        least = np.minimum.reduceat(conv, at)
        children = np.add.reduceat(below, at)
        ends = np.add.reduceat(length == d, at, dtype=np.int64)
        size = texts[at, d - 1] if d else np.zeros(len(at), np.int64)
        first, last = at == 0, at + total == n
        whole = (length[at] >= d) & ~first & ~last
        below = np.zeros(n, np.int64)
        below[at[whole]] = 1
        leaves[at[whole]] += children[whole] == 0
        saves[at[whole]] += (total[whole] - 1) * size[whole]
        sums = np.add.reduceat(leaves, at), np.add.reduceat(saves, at)
        if d:
            above = np.flatnonzero(change[:, d - 1])
            up = np.searchsorted(above, at, "right") - 1
            over = np.minimum.reduceat(conv, above)[up]
            stop = np.append(above[1:], n)[up]
            to = np.where(above[up] == 0, 2 * chunk, np.where(stop == n, 2 * chunk + 1, -1))
        else:
            over, to = np.zeros(len(at), np.int64), np.full(len(at), -1)
        rows = {"depth": [d], "conv_id": least, "parent_conv_id": over, "parent_slot": to, "n_convs": total, "children": children, "leaves": sums[0], "saved": sums[1], "size": size}
        pick = np.flatnonzero(whole)
        if len(pick):
            lists = [conv[a : a + e] for a, e in zip(at[pick].tolist(), ends[pick].tolist())]
            sha = [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() if len(x) else EMPTY for x in lists]
            out.append({"kind": ["node"]} | {k: v if len(v) == 1 and k == "depth" else v[pick] for k, v in rows.items()} | {"sha": sha})
        for side, mine in ((0, first), (1, last)):
            for p in np.flatnonzero(mine & (length[at] >= d)).tolist():
                again = side == 1 and first[p]
                part = {k: [0 if again and k in _SUMS else v[0] if k == "depth" else int(v[p])] for k, v in rows.items()}
                out.append({"kind": ["part"], "slot": [2 * chunk + side], "both": [bool(first[p] and last[p])]} | part)
                for piece in [] if again else range(0, int(ends[p]), PIECE):
                    some = conv[at[p] + piece : at[p] + min(piece + PIECE, int(ends[p]))]
                    out.append({"kind": ["ends"], "slot": [2 * chunk + side], "depth": [d], "piece": [piece // PIECE], "ids": [",".join(map(str, some.tolist()))]})
    out.append({"kind": ["bounds"], "slot": [2 * chunk], "head": [cells[0, : length[0]]], "tail": [cells[-1, : length[-1]]]})
    made = []
    for rows in out:
        n = max(len(v) for v in rows.values())
        cols = [pa.array(v * n if isinstance(v, list) and len(v) == 1 else v, kind) if (v := rows.get(k)) is not None else pa.nulls(n, kind) for k, kind in _TYPES.items()]
        made.append(pa.RecordBatch.from_arrays(cols, list(_TYPES)))
    yield from pa.Table.from_batches(made).combine_chunks().to_batches()


def _chunks(batches):
    """The chunks of a shard whose rows come sorted; their numbers grow with the shard's and along it."""
    chunk, conv, ids, sizes, longest = TaskContext.get().partitionId() << 32, [], [], [], 0
    for b in batches:
        of = lambda c: (b.column(c).offsets.to_numpy(), b.column(c).values.to_numpy(zero_copy_only=False))  # noqa: E731, B023
        (at, all_ids), (_, all_sizes) = of(1), of(2)
        for k, c in enumerate(b.column(0).to_pylist()):
            own = slice(at[k], at[k + 1])
            longest = max(longest, int(at[k + 1] - at[k]))
            if conv and (len(conv) + 1) * (longest + 1) > CELLS:
                yield from _chunk(np.array(conv, np.int64), ids, sizes, chunk)
                chunk, conv, ids, sizes, longest = chunk + 1, [], [], [], int(at[k + 1] - at[k])
            conv.append(c), ids.append(np.array(all_ids[own])), sizes.append(np.array(all_sizes[own]))
    if conv:
        yield from _chunk(np.array(conv, np.int64), ids, sizes, chunk)


def _digests(batches):
    """One digest a node from pieces in order; a node's pieces come one after the other."""
    now, sha = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([sha.hexdigest()])], ["depth", "node", "sha"])

    for b in batches:
        for d, node, ids in zip(*(c.to_pylist() for c in b.columns)):
            if now == (d, node):
                sha.update(b",")
            else:
                if now:
                    yield row()
                now, sha = (d, node), hashlib.sha256()
            sha.update(ids.encode())
    if now:
        yield row()


def trie(conversations: DataFrame) -> DataFrame:
    """conversations: conv_id (long, not null, unique), turns (structs of turn, id, size). A row for every node: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    arrow(spark)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turns.id").alias("ids"), F.col("turns.size").alias("sizes"))
    rows = rows.repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    made = saved(rows.mapInArrow(_chunks, _SCHEMA), "trie-nodes")

    in_order = Window.orderBy("slot")
    equal = F.zip_with("head", F.lag("tail").over(in_order), lambda a, b: a.eqNullSafe(b))
    shared = F.when(F.lag("slot").over(in_order).isNull(), -1).otherwise(F.coalesce(F.nullif(F.array_position(equal, False), F.lit(0)) - 1, F.size(equal)))
    bounds = made.where("kind = 'bounds'").select("slot", "head", "tail").withColumn("shared", shared).select("slot", "shared")
    parts = made.where("kind = 'part'").join(bounds, "slot", "left")
    goes_on = F.when(F.col("slot") % 2 == 0, F.coalesce(F.col("shared") >= F.col("depth"), F.lit(False))).otherwise(F.col("both"))
    along = Window.partitionBy("depth").orderBy("slot")
    parts = parts.withColumn("node", F.max(F.when(~goes_on, F.col("slot"))).over(along))
    parts = saved(parts.select("slot", "depth", "node", "conv_id", "size", *_SUMS), "trie-parts")

    path, deeper = Window.partitionBy("slot").orderBy("depth"), Window.partitionBy("slot").orderBy(F.desc("depth"))
    begins = (F.col("node") == F.col("slot")).cast("long")
    counted = parts.withColumn("below", F.coalesce(F.lead(begins).over(path), F.lit(0)))
    sums = counted.groupBy("depth", "node").agg(F.min("conv_id").alias("conv_id"), F.max("size").alias("size"), F.sum("n_convs").alias("n_convs"), F.sum(F.col("children") + F.col("below")).alias("n_children"))
    placed = parts.select("slot", "depth", "node", "leaves", "saved").join(sums, ["depth", "node"])
    leaf, saves = begins * (F.col("n_children") == 0).cast("long"), begins * (F.col("n_convs") - 1) * F.col("size")
    placed = placed.withColumns({
        "parent": F.lag("conv_id").over(path),
        "leaves": F.col("leaves") + F.sum(leaf).over(deeper),
        "saved": F.col("saved") + F.sum(saves).over(deeper),
    })
    placed = saved(placed, "trie-placed")
    joined = placed.groupBy("depth", "node").agg(
        *(F.first(c).alias(c) for c in ("conv_id", "n_convs", "n_children")), F.max(F.when(F.col("slot") == F.col("node"), F.col("parent"))).alias("parent_conv_id"),
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )

    pieces = made.where("kind = 'ends'").select("slot", "depth", "piece", "ids").join(parts.select("slot", "depth", "node"), ["slot", "depth"])
    pieces = pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "slot", "piece")
    sha = pieces.select("depth", "node", "ids").mapInArrow(_digests, "depth int, node long, sha string")
    joined = joined.join(sha, ["depth", "node"], "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY)))

    over = placed.select(F.col("slot").alias("parent_slot"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("over"))
    whole = made.where("kind = 'node'").join(over, ["parent_slot", "depth"], "left").withColumn("parent_conv_id", F.coalesce("over", "parent_conv_id"))
    whole = whole.withColumnsRenamed({"children": "n_children", "leaves": "n_leaves", "saved": "saved_tokens", "sha": "ends_sha256"})
    columns = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return whole.select(*columns).unionAll(joined.select(*columns))


def op13_prefix_trie(spark, sf_dir):
    known = sequences(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return trie(rebuilt(known))


def op13_sql() -> str:
    """Every prefix as a list, grouped; checksums byte by byte from a table made of their polynomial."""
    return """WITH RECURSIVE bits AS (SELECT i AS byte, CAST(i AS BIGINT) AS v, 0 AS k FROM range(256) t(i) UNION ALL SELECT byte, xor(v >> 1, 3988292384 * (v & 1)), k + 1 FROM bits WHERE k < 8),
own AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS rest, CAST(4294967295 AS BIGINT) AS v FROM own UNION ALL SELECT conv_id, rest[2:], xor(crc.v >> 8, bits.v) FROM crc JOIN bits ON k = 8 AND byte = xor(crc.v, CAST(ascii(rest) AS BIGINT)) & 255 WHERE rest <> ''),
h AS (SELECT own.*, xor(v, 4294967295) % 6 AS h FROM own JOIN crc USING (conv_id) WHERE rest = ''),
seq AS (SELECT h.conv_id, list_concat(coalesce(s.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN own s ON s.conv_id = h.conv_id - h.conv_id % 100),
pre AS (SELECT conv_id, d, turns[1:d] AS path, len(turns) = d AS ends FROM seq, unnest(range(0, len(turns) + 1)) u(d)),
node AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM pre GROUP BY path, d),
kids AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(path[d].t) ELSE 0 END AS saves FROM node LEFT JOIN kids USING (path)),
sub AS (SELECT path[1:a] AS path, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum(saves) AS saved_tokens FROM full_, unnest(range(0, d + 1)) u(a) GROUP BY ALL)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_ f JOIN sub USING (path) LEFT JOIN node p ON f.d > 0 AND p.path = f.path[1:f.d - 1]"""
