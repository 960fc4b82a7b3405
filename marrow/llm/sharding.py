"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A row's key decides its shard: the key is hashed to 64 bits and walks the jump
sequence, so no ring table is kept anywhere, and appending a shard moves only
the rows that the new shard takes.

Slots number the rows of each shard without gaps.  They need no task that sees
a whole shard: rows are spread over ``SPREAD`` sub-groups by a hash of the row,
numbered inside their sub-group, and shifted by the rows in the sub-groups
before (a table of at most shards x ``SPREAD`` counts).  Identical rows are
counted before the shuffle and dealt out again afterwards, so a hot group of
copies is one row while it is numbered.

Defined results: a null key is a key of its own; a null text has no bytes
(size 1, CRC of no bytes); repeated rows get slots of their own in the same
shard; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Sub-groups of a shard that are numbered apart (three hex digits).
SPREAD = 4096
#: Copies of one identical row that are dealt out by one generated row.
COPIES = 10_000


def jump(keys: np.ndarray, n: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key among ``n``, all keys at a time."""
    key = keys.astype(np.uint64)
    shard = np.zeros(len(key), np.int64)
    nxt = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = nxt[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (2147483648.0 / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))
        # beyond n the exact value no longer matters; capped so that it fits an integer
        nxt[live] = np.minimum((shard[live] + 1) * step, float(n)).astype(np.int64)
        live = live[nxt[live] < n]
    return shard


def key_hash(key: Column) -> Column:
    """60 bits of the key's MD5 as a long; a null key hashes a marker of its own."""
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def shard_column(key: Column, n_shards: int) -> Column:
    """Shard (0 to n_shards - 1) of a key column."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")

    @pandas_udf("int")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for h in batches:
            yield pd.Series(jump(h.to_numpy(), n_shards).astype("int32"))

    return place(key_hash(key))


def assign(docs: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text",
           grow_to: int | None = None) -> DataFrame:
    """One row per document: key, size, text_crc32, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 1; ``grown_shard`` is the shard
    under ``grow_to`` shards (by default one more)."""
    grow_to = n_shards + 1 if grow_to is None else grow_to
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    rows = rows.groupBy("key", "size", "text_crc32").agg(F.count("*").alias("copies"))
    spread = F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("null")), "size", "text_crc32")
    rows = rows.select(
        "*", shard_column(F.col("key"), n_shards).alias("shard"),
        shard_column(F.col("key"), grow_to).alias("grown_shard"),
        F.conv(F.substring(F.md5(spread), 1, 3), 16, 10).cast("int").alias("part"))
    within = Window.partitionBy("shard", "part").orderBy("key", "size", "text_crc32")
    rows = rows.withColumn(
        "at", F.sum("copies").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "part").agg(F.sum("copies").alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # at most n_shards x SPREAD rows, whatever the input
    if n_shards * SPREAD <= 1_000_000:
        offsets = F.broadcast(offsets)
    rows = rows.join(offsets, ["shard", "part"])
    # identical rows again, in steps that keep every generated array small
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES))))
    rows = rows.withColumn("copy", F.explode(F.sequence(
        F.col("step"), F.least(F.col("step") + COPIES, F.col("copies")) - 1)))
    return rows.select(
        F.col("key").alias(key), "size", "text_crc32", "shard",
        (F.col("before") + F.col("at") + F.col("copy")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, key: str = "doc_id",
                 files_per_shard: int = 1) -> None:
    """Write the rows of ``docs`` as Parquet under ``path/shard=N``; each shard is dealt
    over ``files_per_shard`` tasks, so a large shard is not one task's work."""
    placed = docs.withColumn("shard", shard_column(F.col(key), n_shards))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in docs.columns]), F.lit(files_per_shard))
    (placed.repartition(n_shards * files_per_shard, "shard", salt)
     .write.mode("error").partitionBy("shard").parquet(path))
