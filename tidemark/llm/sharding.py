"""Sharding by a permutation-filled lookup table.

Every shard prefers the slots of a table of prime size in an order of its own, (offset + k * skip) mod size. Shards
take turns claiming their next free slot until the table is full. A key belongs to the shard in slot hash(key) mod size.
The table has `table_size` rows whatever the data's size, so it is broadcast; placing a key is one lookup. Few keys move
when a shard is added or removed.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import portable_hash

SHARDS = 32
TABLE_SIZE = 8191


def lookup_table(shards: list[str], table_size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index into shards. table_size must be prime and no smaller than the number of shards."""
    if table_size < max(2, len(shards)) or any(table_size % d == 0 for d in range(2, int(table_size**0.5) + 1)):
        raise ValueError("table_size must be a prime, at least the number of shards")
    if not shards:
        raise ValueError("at least one shard is needed")
    digests = [hashlib.md5(s.encode()).hexdigest() for s in shards]
    offset = [int(d[:8], 16) % table_size for d in digests]
    skip = [int(d[8:16], 16) % (table_size - 1) + 1 for d in digests]
    turn, table, filled = [0] * len(shards), [-1] * table_size, 0
    while filled < table_size:
        for s in range(len(shards)):
            while table[slot := (offset[s] + turn[s] * skip[s]) % table_size] >= 0:
                turn[s] += 1
            table[slot] = s
            filled += 1
            if filled == table_size:
                break
    return table


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def table_frame(spark: SparkSession, shards: list[str], table_size: int) -> DataFrame:
    """The lookup table as rows (slot, shard)."""
    text = ",".join(map(str, lookup_table(shards, table_size)))
    return spark.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int"))


def assign(df: DataFrame, key: str, shards: list[str], table_size: int = TABLE_SIZE) -> DataFrame:
    """Add slot and shard (index into shards) to df; columns of df with these names are replaced.

    A null key counts as the empty text. Equal keys share a shard, repeated rows all stay. An empty df gives no rows.
    """
    df = df.drop("slot", "shard")
    keyed = df.withColumn("slot", (portable_hash(F.coalesce(F.col(key).cast("string"), F.lit(""))) % table_size).cast("int"))
    return keyed.join(F.broadcast(table_frame(df.sparkSession, shards, table_size)), "slot")
