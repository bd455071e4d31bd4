"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint has a bit set where over half the XXH64 values of its word shingles have it.
Two fingerprints link at RADIUS (3) or fewer differing bits. Of two that link, one reaches a common
variant with one flip and the other with two flips at most; the latter can be the one with two or more
ones among the differing bits, so two flips only ever clear ones. Hence every fingerprint emits itself
and its 64 variants at one flip, and its variants with two ones cleared; all are shuffled by variant.
All fingerprints that meet at a variant lie within the radius of those that got there with one flip or
none, so each is tied to the least of these: at most 2081 rows a variant and no pairs within a group.
Links are verified by counting bits.

Before that, fingerprints that can't link to any other are set aside: two that link agree on three of
six bit blocks, so only those that share one of twenty masked values with another emit variants. The
work is in distinct fingerprints: copies are joined back at the end.

Components are found by star contraction over written tables. A null text has no words (fingerprint 0).
A row with a null doc_id gets a fingerprint and the component's smallest id, and counts for no minimum.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm.common import arrow, saved, table
from assaylake.llm.components import components

RADIUS, SHINGLE, SEED = 3, 3, 42
_EDGES = [0, 11, 22, 33, 44, 54, 64]
MASKS = [sum(((1 << _EDGES[b + 1]) - (1 << _EDGES[b])) for b in three) for three in combinations(range(6), 3)]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned; bytes.lower() and bytes.split() touch and split at ASCII only."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist())), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """key, fp (signed long) of every row."""
    arrow(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_signed(fingerprint(t, shingle)) for t in b.column(1).to_pylist()], pa.int64())], [key, "fp"])

    return docs.select(key, F.col("text").cast("binary").alias("t")).mapInArrow(hashed, f"{key} {kind}, fp long")


def _sociable(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints that agree with another one under some mask."""
    masked = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(MASKS)]))
    rows = fps.select("fp", masked.alias("k")).select("fp", "k.*")
    shared = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(shared, ["mask", "key"], "left_semi").select("fp").distinct()


def links(fps: DataFrame) -> DataFrame:
    """fps: fp, distinct. Returns u, v: true links that connect all fingerprints within the radius of each other."""
    some = saved(_sociable(fps), "simhash-sociable")
    one = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    two = F.expr(
        "flatten(transform(filter(sequence(0, 63), i -> (fp & shiftleft(1L, i)) <> 0), "
        "i -> transform(filter(sequence(0, i), j -> j < i and (fp & shiftleft(1L, j)) <> 0), j -> fp ^ shiftleft(1L, i) ^ shiftleft(1L, j))))"
    )
    near, far = some.select("fp", F.explode(one).alias("z"), F.lit(0).alias("far")), some.select("fp", F.explode(two).alias("z"), F.lit(1).alias("far"))
    least = F.first(F.struct("far", "fp")).over(Window.partitionBy("z").orderBy("far", "fp"))
    met = near.unionAll(far).withColumn("least", least).where("least.far = 0 and least.fp <> fp").select(F.col("fp").alias("u"), F.col("least.fp").alias("v")).distinct()
    return met.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)


def group(docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """key, fp, component_id for every row of docs."""
    fps = saved(fingerprints(docs, key, shingle), "simhash")
    unique = saved(fps.groupBy("fp").agg(F.min(key).alias("least")), "simhash-unique")
    tied = components(links(unique.select("fp")))
    named = tied.join(unique, tied.node == unique.fp).select("root", "fp", "least")
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = saved(named.join(roots, "root").select("fp", "component_id"), "simhash-components")
    alone = unique.join(joined, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return fps.join(joined.unionAll(alone), "fp").select(key, "fp", "component_id")


def op5_simhash(spark, sf_dir):
    found = group(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
