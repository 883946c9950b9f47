"""Shard placement by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: A prime table; 128 slots a shard keep shares within 1 % of each other.
SLOTS, SHARDS = 8191, 64
#: The table is broadcast, so its size is checked; it never depends on the data.
MAX_SLOTS = 1 << 22


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard's index for each slot.

    Each shard has an own order of preference over all slots, the multiples of its skip from its
    offset; as slots is prime, that order is a permutation. The shards take turns, in the order
    given, and each claims the first free slot in its order until none is free. So shares
    differ by one slot at most, and taking a shard away moves few keys of other shards.
    """
    if not shards or slots < len(shards) or slots > MAX_SLOTS or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"needs shards, and a prime number of slots from their number to {MAX_SLOTS}")
    table = [-1] * slots
    at = [_number(f"{s}:offset") % slots for s in shards]
    skip = [_number(f"{s}:skip") % (slots - 1) + 1 for s in shards]
    filled = 0
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            filled += 1
            if filled == slots:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of the MD5 of its text, modulo slots; a null key counts as an empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The lookup table as rows (slot, shard), made inside the JVM from one constant."""
    text = ",".join(map(str, lookup_table(shards, slots)))
    return spark.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "x")).select("slot", F.col("x").cast("int").alias("shard"))


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, prefix: str = "") -> DataFrame:
    """df with the columns slot and shard (index in shards) of each row's key.

    One hash and one lookup a row in a broadcast table of a checked size, no shuffle of df.
    Equal keys go to one shard; a null key counts as an empty text. Repeated rows stay. Where df
    has columns of these names already, the new ones get underscores at their ends; prefix stands before them. An empty table stays empty.
    """
    slot, shard = fresh(f"{prefix}slot", df), fresh(f"{prefix}shard", df)
    table = table_frame(df.sparkSession, shards, slots).select(F.col("slot").alias(slot), F.col("shard").alias(shard))
    return df.withColumn(slot, slot_of(F.col(key), slots)).join(F.broadcast(table), slot).select(*df.columns, slot, shard)


def sql(shards: list[str], slots: int = SLOTS) -> str:
    """The placement of documents by doc_id in DuckDB's SQL, the table filled turn by turn in a recursive query."""
    names = ", ".join(f"'{s}'" for s in shards)
    number = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)".format
    n = len(shards)
    return f"""
WITH RECURSIVE s AS (SELECT [{number("x || ':offset'")} % {slots} FOR x IN [{names}]] AS o, [{number("x || ':skip'")} % {slots - 1} + 1 FOR x IN [{names}]] AS k),
r AS (SELECT CAST(0 AS BIGINT) AS t, CAST(-1 AS BIGINT) AS slot, list_transform(range({slots}), lambda x: false) AS taken
  UNION ALL
  SELECT t + 1, free, list_transform(taken, lambda x, i: x OR i = free + 1)
  FROM (SELECT t, taken, list_filter(list_transform(range({slots}), lambda j: (o[t % {n} + 1] + j * k[t % {n} + 1]) % {slots}), lambda p: NOT taken[p + 1])[1] AS free FROM r, s WHERE t < {slots})),
w AS (SELECT slot, CAST((t - 1) % {n} AS INTEGER) AS shard FROM r WHERE t > 0)
SELECT d.doc_id, CAST(w.slot AS INTEGER) AS slot, w.shard FROM documents d JOIN w ON {number("coalesce(CAST(doc_id AS VARCHAR), '')")} % {slots} = w.slot
"""
