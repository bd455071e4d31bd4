"""Placement by a permutation-filled lookup table.

Each shard has its own preference order of the slots of a prime-sized table: an offset and a stride
from hashes of its name. The shards take turns; each claims the first free slot of its order until the
table is full. A key goes to the shard in slot hash(key) mod size. Shards get equal shares of the slots
to within one; adding or removing a shard moves few keys beside its own share.

The table has a fixed prime size, whatever the data's, so its broadcast is bounded. Placement is
DataFrame functions only. A null key is placed as the empty string.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm.common import table

SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards, slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that claimed it. Without shards: no slots."""
    if not shards:
        return []
    at = [_hash(f"offset:{s}") % slots for s in shards]
    stride = [_hash(f"stride:{s}") % (slots - 1) + 1 for s in shards]
    owner, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + stride[i]) % slots
            owner[at[i]] = i
            left -= 1
            if not left:
                break
    return owner


def lookup(spark: SparkSession, shards=SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard): `slots` rows."""
    rows = [(slot, shards[i]) for slot, i in enumerate(fill(shards, slots))]
    return spark.createDataFrame(rows, "slot int, shard string")


def slot_of(key: str, slots: int = SLOTS):
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, key: str = "doc_id", shards=SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with the columns slot and shard; columns of df with these names are replaced. Without shards: null."""
    df = df.drop("slot", "shard").withColumn("slot", slot_of(key, slots))
    return df.join(F.broadcast(lookup(df.sparkSession, shards, slots)), "slot", "left")


def op10_sharding(spark, sf_dir):
    return place(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")).select("doc_id", "source", "n_chars", "slot", "shard")


def op10_sql() -> str:
    owners = ",".join(map(str, fill(SHARDS)))
    return f"""WITH t AS (SELECT [{owners}] AS owner),
d AS (SELECT doc_id, source, n_chars, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {SLOTS} AS INTEGER) AS slot FROM documents)
SELECT doc_id, source, n_chars, slot, 'shard-' || lpad(CAST(owner[slot + 1] AS VARCHAR), 3, '0') AS shard FROM d, t"""
