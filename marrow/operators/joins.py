"""Keyed lookups of the source (J1, J3, J4, J8) as Spark joins.

The source's dict lookups keep the last value of a repeated key; here the
lookup side is first reduced to one row per key with ``max_by`` (partial
aggregation, so a hot key collapses map-side) and then joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNMATCHED = "None"


def last_per_key(source: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """One row per key: the fields of the row with the greatest ``order``."""
    packed = F.struct(*[F.col(f) for f in fields])
    return (source.groupBy(key).agg(F.max_by(packed, F.col(order)).alias("_v"))
                  .select(key, *[F.col(f"_v.{f}").alias(f) for f in fields]))


def enrich_left_default(target: DataFrame, source: DataFrame, key: str, fields: list[str],
                        order: str, default: str = UNMATCHED) -> DataFrame:
    """Copy ``fields`` from ``source`` by ``key``; unmatched rows get ``default``.

    A matched row whose field is null keeps the null (the two kinds of missing
    stay apart).  Fields are cast to string because the default is a string.
    """
    src = last_per_key(source, key, fields, order).withColumn("_matched", F.lit(True))
    j = target.drop(*[f for f in fields if f in target.columns]).join(src, key, "left")
    out = j
    for f in fields:
        out = out.withColumn(f, F.when(F.col("_matched"), F.col(f).cast("string"))
                                 .otherwise(F.lit(default)))
    return out.drop("_matched")


def overwrite_by_key(target: DataFrame, updates: DataFrame, key: str, value_col: str,
                     target_col: str, order: str | None = None) -> DataFrame:
    """Where ``key`` is in ``updates``, replace ``target_col`` by the update value.

    Of several updates for a key the one with the greatest ``order`` wins (by
    default the greatest value); null keys match nothing."""
    last = last_per_key(updates, key, [value_col], order or value_col)
    u = last.select(F.col(key), F.col(value_col).alias("_new"), F.lit(True).alias("_hit"))
    j = target.join(u, key, "left")
    return (j.withColumn(target_col, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(target_col)))
             .drop("_new", "_hit"))


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``work`` whose key has no output yet (resume)."""
    return work.join(done.select(key).distinct(), key, "left_anti")
