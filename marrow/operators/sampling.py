"""Reproducible sampling and per-group caps.

The source samples with an unseeded RNG; here every sample is "the n rows
with the smallest md5(seed|id)" per group, which is exact, deterministic and
checkable.  Top-n per group is ``row_number() <= n``: Spark cuts every input
partition to n rows per group before the shuffle (WindowGroupLimit) and again
after it, so a hot group is never sorted whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marrow.operators.clean import rank_table


def sample_key(seed, key: str) -> F.Column:
    """md5 of ``seed|key``: the ordering that defines a seeded sample."""
    return F.md5(F.concat(F.lit(str(seed)) if not isinstance(seed, F.Column) else seed.cast("string"),
                          F.lit("|"), F.col(key).cast("string")))


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int,
                    key: str, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..n per ``group`` by ``order`` (ties broken by the unique ``key``)."""
    order = list(order) + ([key] if key not in order else [])
    w = Window.partitionBy(*group).orderBy(*order)
    # the filter sits on the bare row number, from which Spark derives the group limit
    return (df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)
              .withColumn(rank_col, F.col(rank_col).cast("long")))


def stratified_sample(df: DataFrame, group: str, key: str, n: int, seed=1) -> DataFrame:
    """O3: ``min(n, group size)`` rows per group, the same rows for the same seed."""
    keyed = df.withColumn("_sk", sample_key(seed, key))
    return top_n_per_group(keyed, [group], ["_sk"], n, key, "_rank").drop("_sk", "_rank")


def repeated_samples(df: DataFrame, group: str, key: str, n: int, k: int) -> DataFrame:
    """O3 repeated: ``k`` independent samples (seed = sample number 1..k).

    All seeds are ranked on the narrow (group, key) projection; the rows are
    joined to the winners once, by their unique key."""
    rep = df.select(F.col(group).alias("_g"), F.col(key).alias("_k"),
                    F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))).alias("sample_no"))
    rep = rep.withColumn("_sk", sample_key(F.col("sample_no"), "_k"))
    won = top_n_per_group(rep, ["sample_no", "_g"], ["_sk"], n, "_k", "_rank").select("sample_no", "_k")
    return df.join(won, F.col(key) == F.col("_k")).drop("_k")


def sample_per_file(df: DataFrame, key: str, n: int, seed=1, file_col: str = "file") -> DataFrame:
    """O2: ``min(n, rows in file)`` rows of every input file."""
    return stratified_sample(df, file_col, key, n, seed)


def fixed_size_sample(df: DataFrame, key: str, n: int, seed=1) -> DataFrame:
    """``n`` rows overall (global top-n: per-partition top-n, then one merge)."""
    return (df.withColumn("_sk", sample_key(seed, key))
              .orderBy("_sk", key).limit(n).drop("_sk"))


def limit_per_source(df: DataFrame, source: str, order: Sequence[str], limit: int, key: str,
                     rank_col: str = "rank") -> DataFrame:
    """The first ``limit`` items of every source in (page, position) order."""
    return top_n_per_group(df, [source], order, limit, key, rank_col)


def shuffle_rows(df: DataFrame, seed: int = 0) -> DataFrame:
    """A seeded random order of all rows by one full sort; its order follows the partitioning
    (:func:`shuffled` gives places that do not)."""
    return df.orderBy(F.rand(seed))


#: steps of cycle walking; the chance that one more is needed is below N ** -(CYCLE_STEPS / 2)
CYCLE_STEPS = 64
FEISTEL_ROUNDS = 4


def permuted(rank: F.Column, n: F.Column, seed: int, epoch: int = 0) -> F.Column:
    """The place of rank 0..n-1 in a keyed permutation of them, without looking at other rows.

    A Feistel network on the two digits of a rank in a mixed base a x b, the smallest near-square
    that holds n: rounds add a hash of one digit to the other, which is a bijection of a x b.
    Places beyond n are sent on by the same bijection until they fall below it."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.floor((n + a - 1) / a).cast("long")

    def mixed(i, digit):
        text = F.concat_ws("|", F.lit(f"{seed}|{epoch}"), i.cast("string"), digit.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")

    def once(x):
        def turn(s, i):
            left = F.struct(((s["l"] + mixed(i, s["r"])) % a).alias("l"), s["r"].alias("r"))
            right = F.struct(s["l"].alias("l"), ((s["r"] + mixed(i, s["l"])) % b).alias("r"))
            return F.when(i % 2 == 1, left).otherwise(right)

        start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(FEISTEL_ROUNDS)), start, turn, lambda s: s["l"] * b + s["r"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(CYCLE_STEPS)), once(rank), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def shuffled(df: DataFrame, key: str, seed: int = 0, epoch: int = 0, place: str = "place") -> DataFrame:
    """``df`` with every row's place (from 0) in a shuffle of all rows.

    The unique ``key`` gives ranks (one ranking of the keys alone, the same for
    every seed and epoch), and a keyed permutation gives places: no sort by
    random numbers, the same places for any partitioning and after any lost
    task, and any epoch or stretch of places by itself (``where(place between
    ...)`` resumes a loader in the middle)."""
    ranks = rank_table(df.select(key), None, key, "_rank")
    n = F.lit(ranks.count()).cast("long")
    places = ranks.select(F.col(key).alias("_key"), permuted(F.col("_rank"), n, seed, epoch).alias(place))
    return df.join(places, F.col(key) == F.col("_key")).drop("_key")
