"""Platform repair, ids, dedup, batches, header drop (literal edge rows)."""
from pyspark.sql import functions as F

from marrow.operators import clean
from tests.conftest import rows


def test_funnel_cleans_and_scores_every_text_once(spark):
    from marrow.plans.q_clean import stage_funnel

    plan = stage_funnel(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "rlike" not in plan.lower() and plan.count("parquet") == 1


def test_mention_only_edges(spark):
    data = [
        (0, "@ab @cd", ["@ab", "@cd"]),          # |7 - 6| = 1 <= 2 -> dropped
        (1, "@ab @cd x", ["@ab", "@cd"]),        # |9 - 6| = 3 > 2 -> kept, '@' removed
        (2, "@abc", ["@ab"]),                    # |4 - 3| = 1 = m -> dropped (edge |d| = m)
        (3, "@abcd", ["@ab"]),                   # |5 - 3| = 2 = m + 1 -> kept
        (4, " no mentions @x ", []),             # untouched (no strip, '@' kept)
        (5, None, ["@a"]),                       # null text dropped
        (6, "@a b", [None, "@a"]),               # null mentions ignored: m = 1, |4-2| = 2 -> kept
    ]
    df = spark.createDataFrame(data, "pos INT, text STRING, mentions ARRAY<STRING>")
    out = rows(clean.mention_only_filter(df), "pos", "text")
    assert out == [(1, "ab cd x"), (3, "abcd"), (4, " no mentions @x "), (6, "a b")]


def test_youtube_and_reddit_repair(spark):
    yt = spark.createDataFrame([(0, "@bob hi @"), (1, None), (2, "nan"), (3, "x")], "pos INT, text STRING")
    assert rows(clean.repair_youtube(yt), "pos", "text") == [
        (0, "bob hi @"), (2, "nan"), (3, "x")]   # only the CSV reader takes "nan" for a missing text
    bodies = [(0, "[removed]"), (1, "[deleted]"), (2, ""), (3, None),
              (4, "ok *I am a bot, and this action was performed automatically. see *faq* here* tail"),
              (5, "a *I am a bot, and this action was performed automatically* x\nnext *star*"),
              (6, "look ![img](emote|t5_2qh|12345) here")]
    rd = spark.createDataFrame(bodies, "pos INT, body STRING")
    assert rows(clean.repair_reddit(rd), "pos", "text") == [
        (4, "ok  tail"), (5, "a  x\nnext *star*"), (6, "look  here")]


def test_platform_dispatch_rejects_unknown(spark):
    import pytest
    df = spark.createDataFrame([(0, "x")], "pos INT, text STRING")
    with pytest.raises(ValueError):
        clean.repair_platform(df, "myspace")


def test_assign_ids_before_dedup_and_keep_first(spark):
    data = [(0, "a", "x"), (1, "a", "y"), (2, "b", "x"), (3, "a", "x"), (4, "b", "z"), (5, "a", "w")]
    df = spark.createDataFrame(data, "pos INT, category STRING, text STRING")
    ids = clean.assign_ids(df)
    assert rows(ids, "pos", "id") == [(0, "a_0"), (1, "a_1"), (2, "b_0"), (3, "a_2"), (4, "b_1"), (5, "a_3")]
    kept = clean.dedup_keep_first(ids, within=["category"])
    # per category: the second 'x' of category a (pos 3) goes; ids keep their gaps
    assert rows(kept, "pos", "id") == [(0, "a_0"), (1, "a_1"), (2, "b_0"), (4, "b_1"), (5, "a_3")]
    assert rows(clean.dedup_keep_first(kept, within=["category"])) == rows(kept)  # idempotent
    # globally, the 'x' of category b (pos 2) goes as well
    assert rows(clean.dedup_keep_first(ids), "pos") == [(0,), (1,), (4,), (5,)]


def test_assign_ids_hot_category_many_partitions(spark):
    n = 5000
    df = spark.range(n).select(F.col("id").alias("pos"),
                               F.when(F.col("id") % 3 == 0, "hot").otherwise(
                                   F.concat(F.lit("c"), (F.col("id") % 7).cast("string"))).alias("category"))
    ids = clean.assign_ids(df, num_partitions=13)
    got = {r.pos: r.id for r in ids.collect()}
    want, seen = {}, {}
    for p in range(n):
        c = "hot" if p % 3 == 0 else f"c{p % 7}"
        want[p] = f"{c}_{seen.get(c, 0)}"
        seen[c] = seen.get(c, 0) + 1
    assert got == want


def test_batches_of_100(spark):
    df = spark.range(250).select((F.col("id") * 10).alias("pos"))
    b = clean.batch_assign(df, "pos", 100)
    counts = rows(b.groupBy("batch").count(), "batch", "count")
    assert counts == [(1, 100), (2, 100), (3, 50)]


def test_drop_repeated_header(spark):
    df = spark.createDataFrame([("author", "text"), ("a", "hello"), ("author", "text"), ("author", "x")],
                               "author STRING, text STRING")
    assert rows(clean.drop_repeated_header(df)) == [("a", "hello"), ("author", "x")]


def test_clean_chain_order(spark):
    data = [(0, "c", "Hello  #tag https://x.y/z WORLD"), (1, "c", "hello world"), (2, "c", "Hello  #tag https://x.y/z WORLD")]
    df = spark.createDataFrame(data, "pos INT, category STRING, text STRING")
    out = rows(clean.clean_chain(df), "id", "text")
    # raw dedup drops pos 2 only; pos 1 equals pos 0 only after cleaning, so it survives
    assert out == [("c_0", "hello world"), ("c_1", "hello world")]
    assert rows(clean.clean_chain(df, dedup_on_clean=True), "id") == [("c_0",)]


def test_rank_table_matches_window_beyond_sampling(spark):
    # enough rows that range partitioning sees only a sample of them
    from pyspark.sql import Window
    n = 200_000
    df = spark.range(n).select((F.col("id") * 7919 % 1_000_003).alias("pos"),
                               F.when(F.col("id") % 3 == 0, "hot")
                                .otherwise(F.concat(F.lit("c"), (F.col("id") % 11).cast("string"))).alias("category"))
    r = clean.rank_table(df, "category", "pos", "rank", num_partitions=24)
    w = df.withColumn("want", F.row_number().over(Window.partitionBy("category").orderBy("pos")) - 1)
    j = r.join(w, ["category", "pos"])
    assert j.count() == n and j.where(F.col("rank") != F.col("want")).count() == 0
