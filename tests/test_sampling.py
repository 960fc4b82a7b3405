"""Sampling: exact per-group sizes, determinism, and a hot group against brute force."""
import hashlib

from pyspark.sql import functions as F

from marrow.operators import sampling
from tests.conftest import rows


def _md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def test_stratified_sample_matches_brute_force_with_hot_group(spark):
    n_rows = 3000
    df = spark.range(n_rows).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot")
                                    .otherwise(F.concat(F.lit("g"), (F.col("id") % 5).cast("string"))).alias("g"))
    df = df.repartition(7)
    got = rows(sampling.stratified_sample(df, "g", "id", 4, seed=9), "g", "id")
    groups = {}
    for i in range(n_rows):
        groups.setdefault("hot" if i % 3 == 0 else f"g{i % 5}", []).append(i)
    want = sorted((g, i) for g, ids in groups.items()
                  for i in sorted(ids, key=lambda i: (_md5(f"9|{i}"), i))[:4])
    assert got == want


def test_small_groups_keep_all_rows_and_seeds_differ(spark):
    df = spark.createDataFrame([(i, "a" if i < 2 else "b") for i in range(10)], "id INT, g STRING")
    s = sampling.stratified_sample(df, "g", "id", 3, seed=1)
    assert rows(s.groupBy("g").count()) == [("a", 2), ("b", 3)]   # min(n, group size)
    assert rows(s) == rows(sampling.stratified_sample(df, "g", "id", 3, seed=1))
    reps = sampling.repeated_samples(df, "g", "id", 3, 4)
    assert rows(reps.groupBy("sample_no").count()) == [(k, 5) for k in range(1, 5)]


def test_fixed_size_and_limit_per_source(spark):
    df = spark.range(100).select("id", (F.col("id") % 4).alias("src"), (100 - F.col("id")).alias("ts"))
    assert sampling.fixed_size_sample(df, "id", 10).count() == 10
    capped = sampling.limit_per_source(df, "src", ["ts"], 2, "id")
    # per source, the two smallest ts are the two largest ids
    assert rows(capped, "src", "id", "rank") == sorted(
        [(s, i, r) for s in range(4) for r, i in enumerate(sorted((x for x in range(100) if x % 4 == s),
                                                                   reverse=True)[:2], start=1)])
