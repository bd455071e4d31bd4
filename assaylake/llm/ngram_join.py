"""Jaccard join of five-word shingle sets by prefix trees: documents whose sets have a similarity of 0.8 or more.

Documents of equal sets are one node. Shingles are ordered by hash. The first n - ceil(0.8 n) + 1 of a node's set, its prefix,
meet the prefix of any set it can link with. All its shingles below a fixed hash, about CLASS of them, are sampled as well: of
those, no more than a fifth of the set may be in no other set, else it can't link with any; this leaves out documents that share
passages and no more. It is applied twice, the second time among what the first has left. Nodes that then share a shingle of
their prefixes are in one cluster, found by star contraction over one edge a node and shingle; so a pair that can link is in one.

A cluster of up to BOUND shingles is joined by one task, and its sets are fetched once. There shingles are ordered by how many
of the cluster's sets have them, commonest first; those of a single set count for its size only. The sets are stored in a trie
whose edges are runs of shingles. Each set in turn descends, a level at a time: the overlap of a path is counted once for all
sets below it, and a subtree is left where the overlap so far and what remains of either side can't reach the least similarity
for its smallest set, or where its sizes don't fit. A set that ends on a reached node has its exact overlap.

Larger clusters are first cut by runs: the range of hashes is cut in as many runs as a set of the class of sizes has shingles for
two to four a run. Sets that link differ in a ninth of both sizes at most, and so in no more runs. A set that has fewer of its runs
in common with any others is left out. A set's runs of two or more shingles, taken until they are one more than can differ,
hold one that is equal in the other set: members of an equal run are tied, as members of a shingle are above. A run must be equal as
a whole, so a passage that many sets share ties few of them. Sets of few runs are tied by their shingles as well. What is still larger is cut again by runs of another order.

Those that are still larger: in each of LEADERS rounds every shared shingle has one of its members as leader, and a set is compared with the
leader that it shares most with, which connects copies with a row a member. Only shingles whose members aren't connected then stay, and clusters are formed by these alone. Those still
over BOUND compare the members of a shingle pair by pair, but for pairs that two bounds exclude: what is left after the first
common shingle, and the parities of shingles by residue. So no pair is missed at any size, and none is cut off.

Shingles are 64-bit numbers; two of a pair of documents of 20,000 words meet by chance once in 4e10 pairs of documents. A null or
wordless text has an empty set, which links with nothing. Ids may repeat or be null: rows are told apart by their texts, and a
component is named by the smallest id that isn't null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm import simhash
from assaylake.llm.common import arrow, discard, saved, table
from assaylake.llm.components import components

SHINGLE = 5
#: The least similarity is ABOVE / BELOW.
ABOVE, BELOW = 4, 5
LEADERS = 4
#: Shingles of a cluster that one task joins.
BOUND = 1 << 21
#: Shingles a run of the least set of a class of sizes; each class is twice the one before.
RUN = 1.8
#: How often a cluster over the bound is cut by equal runs.
CUTS = 3
#: Longs of a set's parities; the share of hashes that is sampled.
WORDS, CLASS = 16, 0.36


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Odd factors of a shingle's words by place.
_PLACES = _mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)


def hashes(text: bytes | None) -> np.ndarray:
    """A 64-bit number for each shingle in text order, from the XXH64 of its words and their places; a text of fewer words is one
    shingle, one without words has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    h = np.full(n, min(len(words), SHINGLE), np.uint64)
    for k in range(min(len(words), SHINGLE)):
        h += own[k : k + n] * _PLACES[k]
    return _mixed(h)


def fingerprint(found: np.ndarray) -> int:
    """Unsigned SimHash of hashes()."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(found), 1 << 15):
        ones += np.unpackbits(found[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(found)).tobytes(), "big")


def prefix_size(n: int) -> int:
    """How many of the first shingles of a set any set of the least similarity shares one of."""
    return n - -(-n * ABOVE // BELOW) + 1 if n else 0


def parities(members: np.ndarray) -> np.ndarray:
    """Bit r of WORDS longs: whether the number of members with residue r by their bits is odd."""
    odd = np.bincount((members & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def equal_runs(members: np.ndarray, turn: int = 0) -> list[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each class that a set of sorted members can meet another of the least similarity in: the class, numbers of its runs, which
    of them tie, and how many of the runs it has in common with any such set at least. Of two such sets, those runs that tie have one
    in common, unless the last figure is below 1 for one of them. Other turns order the members otherwise."""
    n, out = len(members), []
    if turn:
        members = np.sort(_mixed(members + np.uint64(turn)) >> np.uint64(1))
    most = n * BELOW // ABOVE
    for k in range(n.bit_length() - 1, most.bit_length()) if n else ():  # a pair meets in the class of its larger set
        cuts = -int(-(1 << k) // RUN)
        at = ((members >> np.uint64(31)) * np.uint64(cuts)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        run = np.add.reduceat(_mixed(members), first) + _mixed(at[first] * np.uint64(64) + np.uint64(k))
        differ = (n + min(most, (2 << k) - 1)) * (BELOW - ABOVE) // (ABOVE + BELOW)
        ties, strong = np.ones(len(run), bool), np.flatnonzero(np.diff(np.append(first, n)) > 1)
        if len(strong) > differ:
            ties[:] = False
            ties[strong[: differ + 1]] = True
        out.append((k, run.view(np.int64), ties, len(run) - differ))
    return out


class Trie:
    """Sorted token runs of a cluster's sets: nodes with the run of the edge that leads to each, the sets that end there, and
    the least size, largest size and longest run below."""

    def __init__(self, runs: list[np.ndarray], sizes: np.ndarray):
        self.parent, self.start, self.stop, self.row = [-1], [0], [0], [0]
        self.node = np.zeros(len(runs), np.int64)
        stack = [0]
        for i, run in enumerate(runs):
            k = min(len(run), len(runs[i - 1])) if i else 0
            differ = np.flatnonzero(run[:k] != runs[i - 1][:k])
            shared, last = int(differ[0]) if len(differ) else k, None
            while self.stop[stack[-1]] > shared:
                last = stack.pop()
            if self.stop[stack[-1]] < shared:
                self._add(stack[-1], self.start[last], shared, self.row[last])
                self.parent[last], self.start[last] = len(self.parent) - 1, shared
                stack.append(len(self.parent) - 1)
            if len(run) > shared:
                self._add(stack[-1], shared, len(run), i)
                stack.append(len(self.parent) - 1)
            self.node[i] = stack[-1]
        self.parent, self.start, self.stop, self.row = (np.array(x, np.int64) for x in (self.parent, self.start, self.stop, self.row))
        length = np.fromiter(map(len, runs), np.int64, len(runs))
        n = len(self.parent)
        self.least, self.largest, self.longest = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.minimum.at(self.least, self.node, sizes)
        np.maximum.at(self.largest, self.node, sizes)
        np.maximum.at(self.longest, self.node, length)
        for v in np.argsort(-self.stop, kind="stable").tolist():
            if (up := self.parent[v]) >= 0:
                self.least[up] = min(self.least[up], self.least[v])
                self.largest[up] = max(self.largest[up], self.largest[v])
                self.longest[up] = max(self.longest[up], self.longest[v])
        self.children = np.argsort(self.parent, kind="stable")[1:]
        self.first_child = np.searchsorted(self.parent[self.children], np.arange(n + 1))
        self.ending = np.argsort(self.node, kind="stable")
        self.first_ending = np.searchsorted(self.node[self.ending], np.arange(n + 1))

    def _add(self, parent: int, start: int, stop: int, row: int) -> None:
        for own, value in ((self.parent, parent), (self.start, start), (self.stop, stop), (self.row, row)):
            own.append(value)


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def tied(sets: list[np.ndarray]) -> np.ndarray:
    """For each of the sets (sorted, without repeats, not empty) the first one it is connected with by links."""
    m, sizes = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    turn = np.empty(len(values), np.int64)
    turn[np.argsort(-count, kind="stable")] = np.arange(len(values))
    token, owner, often = turn[place], np.repeat(np.arange(m), sizes), count[place] > 1
    token, owner = token[often], owner[often]
    token = token[np.lexsort((token, owner))]
    runs = np.split(token, np.cumsum(np.bincount(owner, minlength=m))[:-1])
    order = sorted(range(m), key=lambda i: runs[i].astype(">u4").tobytes())
    runs, size, root = [runs[i] for i in order], sizes[order], np.array(order)
    trie, flat = Trie(runs, size), np.concatenate(runs)
    at = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    marked = np.zeros(len(values), bool)
    for x in np.argsort(-size, kind="stable").tolist():
        if root.min() == root.max():
            break
        own, n = runs[x], size[x]
        marked[own] = True
        nodes = trie.children[trie.first_child[0] : trie.first_child[1]]
        overlap = np.zeros(len(nodes), np.int64)
        while len(nodes):
            fits = (trie.least[nodes] <= n) & (BELOW * trie.largest[nodes] >= ABOVE * n)
            nodes, overlap = nodes[fits], overlap[fits]
            if not len(nodes):
                break
            length = trie.stop[nodes] - trie.start[nodes]
            run = _runs(at[trie.row[nodes]] + trie.start[nodes], length)
            overlap = overlap + np.add.reduceat(marked[flat[run]], np.concatenate([[0], np.cumsum(length)[:-1]]), dtype=np.int64)
            ahead = len(own) - np.searchsorted(own, flat[at[trie.row[nodes]] + trie.stop[nodes] - 1], "right")
            most = overlap + np.minimum(ahead, trie.longest[nodes] - trie.stop[nodes])
            hopeful = (ABOVE + BELOW) * most >= ABOVE * (n + np.maximum(trie.least[nodes], -(-ABOVE * n // BELOW)))
            nodes, overlap = nodes[hopeful], overlap[hopeful]
            n_end = trie.first_ending[nodes + 1] - trie.first_ending[nodes]
            y = trie.ending[_runs(trie.first_ending[nodes], n_end)]
            y = y[(ABOVE + BELOW) * np.repeat(overlap, n_end) >= ABOVE * (n + size[y])]
            both = np.unique(root[y])
            if len(both) and (len(both) > 1 or both[0] != root[x]):
                both = np.append(both, root[x])
                root[np.isin(root, both)] = both.min()
            n_child = trie.first_child[nodes + 1] - trie.first_child[nodes]
            nodes, overlap = trie.children[_runs(trie.first_child[nodes], n_child)], np.repeat(overlap, n_child)
        marked[own] = False
    out = np.empty(m, np.int64)
    out[order] = root
    return out


def _fits(x: str, y: str):
    """Whether two members of a prefix group (structs of n, i) that first meet here can be similar enough."""
    at = lambda name: (F.col(f"{x}.{name}"), F.col(f"{y}.{name}"))
    (n, m), (i, j) = at("n"), at("i")
    return (ABOVE + BELOW) * F.least(n - i, m - j) >= ABOVE * (n + m)


def _first(i, n):
    """Whether a place of a prefix is one where a set can meet a larger one."""
    return (ABOVE + BELOW) * i <= (BELOW - ABOVE) * n


def _alike(w: str, v: str, total):
    """Whether parities allow the least similarity: where they differ, the sets do, in (1 - ABOVE / BELOW) of their union at most."""
    differ = F.aggregate(F.zip_with(w, v, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, c: s + c)
    return (ABOVE + BELOW) * differ <= (BELOW - ABOVE) * total


def _verified(pairs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs a, b of nodes that are similar enough, as a written table of u, v. Parities go first."""
    at = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("w").alias(f"w_{c}"))
    near = pairs.distinct().join(at("a"), "a").join(at("b"), "b").where(_alike("w_a", "w_b", F.col("n_a") + F.col("n_b"))).select("a", "b")
    met = near.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return saved(met.where((ABOVE + BELOW) * shared >= ABOVE * (F.size("sa") + F.size("sb"))).select(F.col("a").alias("u"), F.col("b").alias("v")), "near-links")


def _clusters(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root, large: the clusters of the edges (written), and whether a cluster has more shingles than one task should join."""
    named = saved(components(edges), "near-clusters")
    sizes = named.join(nodes.select("node", "n"), "node").groupBy("root").agg((F.sum("n") > BOUND).alias("large"))
    out = saved(named.join(sizes, "root").select("node", "root", "large"), "near-sized")
    discard(named)
    return out


def _joined(sets: DataFrame) -> DataFrame:
    """sets: node, root, s. Links within each root by a trie, as u, v: each node and the least one it is connected with."""

    def batches_of(batches):
        root, nodes, sets = None, [], []
        for b in batches:
            values, at = b.column(2).values.to_numpy().view(np.uint64), b.column(2).offsets.to_numpy()
            for k, (node, r) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if r != root:
                    yield from links(nodes, sets)
                    root, nodes, sets = r, [], []
                nodes.append(node), sets.append(np.array(values[at[k] : at[k + 1]]))
        yield from links(nodes, sets)

    def links(nodes, sets):
        if len(nodes) > 1:
            first = tied(sets)
            own = np.array(nodes, np.int64)
            least = np.full(len(own), np.iinfo(np.int64).max)
            np.minimum.at(least, first, own)
            u, v = own, least[first]
            yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])

    return sets.select("node", "root", "s").repartition("root").sortWithinPartitions("root", "node").mapInArrow(batches_of, "u long, v long")


def _ties(rows: DataFrame, by: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows u, v: members (node) of a value of `by` and the least of them, and the written table that they are read from."""
    shared = saved(rows.groupBy(by).agg(F.min("node").alias("lead"), F.max("node").alias("high")).where("lead < high").select(by, "lead"), name)
    return rows.join(shared, by).where("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v")), shared


def _cut(opened: DataFrame, sets: DataFrame, nodes: DataFrame, turn: int) -> DataFrame:
    """node, root, large: clusters (written) of the nodes of sets that have an equal run, of members of one root; opened as of _large."""

    def runs_of(batches):
        for b in batches:
            values, at = b.column(2).values.to_numpy().view(np.uint64), b.column(2).offsets.to_numpy()
            roots = _mixed(b.column(1).to_numpy().view(np.uint64)).view(np.int64)
            found = [(node, *f, roots[i]) for i, node in enumerate(b.column(0).to_pylist()) for f in equal_runs(values[at[i] : at[i + 1]], turn)]
            if found:
                nodes, k, run, ties, least, root = zip(*found)
                size = list(map(len, run))
                own = [pa.array(np.repeat(np.array(c), size), t) for c, t in ((nodes, pa.int64()), (k, pa.int32()), (least, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate(run) + np.repeat(np.array(root), size)), pa.array(np.concatenate(ties))], ["node", "k", "least", "run", "ties"])

    runs = saved(sets.select("node", "root", "s").mapInArrow(runs_of, "node long, k int, least int, run long, ties boolean"), "near-runs")
    unsure = saved(runs.where("least < 1").select("node").distinct(), "near-unsure")
    often = runs.withColumn("with", F.count("*").over(Window.partitionBy("run"))).where("with > 1")
    fit = saved(often.groupBy("node", "k").agg(F.count("*").alias("c"), F.max("least").alias("least")).where("c >= least").select("node", "k"), "near-fit")
    edges, shared = _ties(runs.where("ties").join(fit, ["node", "k"], "left_semi"), "run", "near-equal")
    weak = opened.join(unsure, "node", "left_semi").select("h").distinct()
    tied_, met = _ties(opened.join(weak, "h", "left_semi"), "h", "near-weak")
    out = _clusters(edges.unionAll(tied_), nodes)
    discard(runs, unsure, fit, shared, met)
    return out


def _large(opened: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links that connect what is similar in clusters over the bound; opened: h, node, n, i of their nodes, written. They are cut
    by equal runs, those over the bound then again by others; what is over the bound at last is left to rounds of leaders."""
    links, old = None, []
    for turn in range(CUTS):
        again = _cut(opened, sets, nodes, turn)
        found = saved(_joined(sets.drop("root", "large").join(again.where("not large"), "node")), "near-links")
        links = found if links is None else links.unionAll(found)
        large = again.where("large")
        if large.isEmpty():
            discard(again, *old)
            return links
        opened, sets = saved(opened.join(large, "node", "left_semi"), "near-rest"), saved(sets.drop("root", "large").join(large, "node"), "near-sets")
        discard(again, *old)
        old = [opened, sets]
    links = links.unionAll(_led(opened, sets, nodes))
    discard(*old)
    return links


def _led(opened: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links that connect what is similar in clusters that equal runs don't cut; opened as of _large. A shingle whose members are
    connected stays so: a round writes the rows of open ones with their leaders, and the next reads no others."""
    cores, before_met = None, None
    for round_ in range(LEADERS + 1):
        tied_ = opened.withColumn("core", F.col("node")) if cores is None else opened.join(cores, "node", "left").withColumn("core", F.coalesce("root", "node"))
        now = tied_.select("h", F.struct("node", "n", "i", "core").alias("x"))
        turn = F.struct(~_first(F.col("x.i"), F.col("x.n")), F.xxhash64(F.lit(round_), "x.node"), "x.node")
        open_ = now.groupBy("h").agg(F.min("x.core").alias("low"), F.max("x.core").alias("high"), F.min_by("x", turn).alias("y")).where("low < high")
        if round_ == LEADERS:
            break
        met = saved(now.join(open_.select("h", "y"), "h"), "near-met")
        opened = met.select("h", "x.node", "x.n", "x.i")
        discard(*([before_met] if before_met else []))
        before_met = met
        pairs = met.where("x.core <> y.core").where(_fits("x", "y")).groupBy("x.node", F.col("y.node").alias("lead")).agg(F.count("*").alias("c"))
        likely = pairs.groupBy("node").agg(F.max_by("lead", F.struct("c", F.xxhash64("lead"))).alias("lead"))
        more = _verified(likely.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")), sets, nodes)
        if more.isEmpty():
            discard(more)
            continue
        stars = more if cores is None else more.unionAll(cores.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
        before, cores = cores, saved(components(stars), "near-cores")
        discard(more, *([before] if before else []))
    left = saved(now.join(open_.select("h", F.col("y.node").alias("lead")), "h"), "near-open")
    again = _clusters(left.select(F.col("x.node").alias("u"), F.col("lead").alias("v")).where("u <> v"), nodes)
    found = _joined(sets.drop("root", "large").join(again.where("not large"), "node"))
    still = left.join(again.where("large").select(F.col("node").alias("in_")), F.col("x.node") == F.col("in_"), "left_semi")
    still = still.join(nodes.select(F.col("node").alias("w_of"), "w"), F.col("x.node") == F.col("w_of")).select("h", "x", "w")
    y = still.where(_first(F.col("x.i"), F.col("x.n"))).select("h", F.col("x").alias("y"), F.col("w").alias("v"))
    pairs = still.join(y, "h").where("x.core <> y.core and (y.n < x.n or (y.n = x.n and y.node < x.node))").where(_fits("x", "y")).where(_alike("w", "v", F.col("x.n") + F.col("y.n")))
    rest = _verified(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")), sets, nodes)
    out = found.unionAll(rest)
    if cores is not None:
        out = out.unionAll(cores.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = saved(out, "near-links")
    discard(left, *([before_met] if before_met else []), again, rest, *([cores] if cores is not None else []))
    return links


def group(docs: DataFrame, key: str, balls: bool = False) -> DataFrame:
    """key, sig, n, least for every row of docs: sig names the set of shingles, n is its size, least the smallest key of the group
    it is in (null where no row of the group has one). With balls, SimHash fingerprints within three bits are candidates too."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    arrow(spark)
    limit = int(CLASS * 2**63)

    def described(batches):
        for b in batches:
            sigs, sizes, fps, words, firsts = [], [], [], [], []
            for t in b.column(2):
                found = hashes(t.as_py())
                members = np.unique(found >> np.uint64(1))
                sigs.append(xxhash.xxh3_128_digest(members.tobytes()))
                sizes.append(len(members))
                fps.append(simhash._signed(fingerprint(found)) if balls else 0)
                words.append(parities(members))
                firsts.append(members[: max(prefix_size(len(members)), int(np.searchsorted(members, limit)))].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int64()))], ["key", "th", "sig", "n", "fp", "w", "p"])

    texts = docs.select(F.col(key).alias("key"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("t"))
    rows = saved(texts.mapInArrow(described, f"key {kind}, th long, sig binary, n long, fp long, w array<long>, p array<long>"), "near-rows")
    one = rows.where("n > 0").groupBy("sig").agg(F.min("key").alias("least"), F.min(F.struct("key", "th")).alias("pick"), *(F.first(c).alias(c) for c in ("n", "fp", "w", "p")))
    nodes = saved(one.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    named = saved(rows.select("key", "sig", "n"), "near-named")
    discard(rows)

    opened = nodes.select("node", "n", F.posexplode("p").alias("i", "h"))
    for turn in range(2):
        often = opened.groupBy("h").agg(F.count("*").alias("with")).where("with > 1").select("h")
        known = opened.where(F.col("h") < limit).join(often, "h", "left_semi").groupBy("node").agg(F.count("*").alias("shared"))
        sampled = nodes.select("node", "n", F.size(F.filter("p", lambda h: h < limit)).alias("all")).join(known, "node", "left")
        fit = saved(sampled.where(BELOW * (F.col("all") - F.coalesce("shared", F.lit(0))) <= (BELOW - ABOVE) * F.col("n")).select("node"), "near-fit")
        before = opened if turn else None
        kept = opened = saved(opened.join(fit, "node", "left_semi"), "near-opened")
        discard(fit, *([before] if turn else []))
    opened = opened.where(F.col("i") < F.col("n") - F.ceil(F.col("n") * ABOVE / BELOW) + 1)
    often = saved(opened.groupBy("h").agg(F.count("*").alias("with"), F.bool_or(_first(F.col("i"), F.col("n"))).alias("first"), F.min("node").alias("lead")).where("with > 1 and first").select("h", "lead"), "near-often")
    edges = opened.join(often, "h").where("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v"))
    if balls:
        first = saved(nodes.groupBy("fp").agg(F.min("node").alias("first")), "near-fps")
        same = nodes.join(first, "fp").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
        at = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_"))
        near = simhash.links(first.select("fp")).join(at("u"), "u").join(at("v"), "v").select(F.col("u_").alias("u"), F.col("v_").alias("v"))
        edges = edges.unionAll(same).unionAll(near)
    clusters = _clusters(edges, nodes)

    def sets_of(batches):
        seen = set()
        for b in batches:
            out = []
            for node, sig, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if node not in seen and xxhash.xxh3_128_digest((members := np.unique(hashes(t.as_py()) >> np.uint64(1))).tobytes()) == sig:
                    seen.add(node)
                    out.append((node, members.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.list_(pa.int64()))], ["node", "s"])

    asked = nodes.join(clusters, "node").select("node", "sig", F.col("pick.key").alias("key_"), F.col("pick.th").alias("th_"))
    fetched = texts.join(asked, texts.key.eqNullSafe(F.col("key_")) & (texts.th == F.col("th_"))).select("node", "sig", "t").mapInArrow(sets_of, "node long, s array<long>")
    sets = saved(fetched.dropDuplicates(["node"]).join(clusters, "node"), "near-sets")
    links = _joined(sets.where("not large"))
    if not clusters.where("large").isEmpty():
        big = saved(opened.join(often, "h", "left_semi").join(clusters.where("large"), "node", "left_semi"), "near-large")
        links = links.unionAll(_large(big, sets.where("large"), nodes))
        discard(big)
    cores = saved(components(links), "near-cores")
    discard(often, clusters, sets, kept, *([first] if balls else []))
    members = nodes.join(cores, "node", "left").select("sig", "least", F.coalesce("root", "node").alias("root"))
    least = members.groupBy("root").agg(F.min("least").alias("least"))
    by_sig = saved(members.drop("least").join(least, "root").select("sig", "least"), "near-groups")
    discard(nodes, cores)
    return named.join(by_sig, "sig", "left").select(F.col("key").alias(key), "sig", "n", "least")


def op11_ngram_join(spark, sf_dir):
    found = group(table(spark, sf_dir, "documents"), "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
