"""Sharding by a permutation-filled lookup table: shards take turns claiming slots of a prime-sized table.

Each shard prefers the slots offset, offset + skip, offset + 2 * skip, ... (modulo the table's prime size; offset and
skip from the hash of the shard's name). In turn every shard claims its next preferred slot that is free, until the
table is full. Shares then differ by one slot at most, and adding or removing a shard moves few other slots. A row's slot is the
hash of its key modulo the size; the table is broadcast, so placement is one lookup and no shuffle.

The table has as many rows as its size says, whatever the data; it is filled once from the shard list, which is
configuration. Rows are placed by DataFrame functions only.

Cases: a null key is placed like the empty text; equal keys share a shard, so repeated rows do; keys spread evenly
whatever source or size rows have; no shards, or a size that is no prime above their number, is an error; rows keep all
their columns in ``assign``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.session import small_frame

#: Slots of the table: a prime of over a hundred times the shards keeps shares within one per cent.
SIZE = 65_537
#: Shards of the registered query.
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def fill(shards: tuple[str, ...], size: int = SIZE) -> list[int]:
    """The table: the number of the shard that claimed each slot."""
    if not shards or len(set(shards)) != len(shards) or size < len(shards) or size < 2 or any(size % k == 0 for k in range(2, int(size ** 0.5) + 1)):
        raise ValueError("shards must be distinct, and the size a prime of at least their number")
    order = sorted(range(len(shards)), key=lambda k: shards[k])  # turns do not depend on the list's order
    wish = {}
    for k in order:
        digest = hashlib.sha256(shards[k].encode()).digest()
        wish[k] = int.from_bytes(digest[:8]) % size, int.from_bytes(digest[8:16]) % (size - 1) + 1 if size > 2 else 1
    table, left, tried = [-1] * size, size, dict.fromkeys(order, 0)
    while left:
        for k in order:
            offset, skip = wish[k]
            while table[slot := (offset + tried[k] * skip) % size] >= 0:
                tried[k] += 1
            table[slot] = k
            tried[k] += 1
            left -= 1
            if not left:
                break
    return table


def lookup(spark: SparkSession, shards: tuple[str, ...], size: int = SIZE) -> DataFrame:
    """(slot, shard): one row per slot."""
    return small_frame(spark, [(slot, shards[k]) for slot, k in enumerate(fill(shards, size))], "slot int, shard string")


def slot_of(key: Column, size: int = SIZE) -> Column:
    """The first 60 bits of the key's MD5, modulo the size."""
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return (F.conv(digest, 16, 10).cast("bigint") % size).cast("int")


def assign(rows: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, size: int = SIZE, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``rows`` with ``slot`` and ``shard`` (columns of these names are replaced)."""
    table = lookup(rows.sparkSession, shards, size).select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    placed = rows.withColumn(slot, slot_of(F.col(key), size))
    out = placed.join(F.broadcast(table), placed[slot] == table["__slot"]).drop("__slot")  # size rows of a slot and a name
    return out.withColumn(shard, F.col("__shard")).drop("__shard")


def report(docs: DataFrame, shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    """One row per document: doc_id, slot, shard."""
    return assign(docs.select("doc_id"), "doc_id", shards, size)
