"""Streaming: running twice over a growing folder equals one batch run."""
import os

from pyspark.sql import functions as F

from marrow.operators import clean
from marrow.streaming import ingest
from tests.conftest import rows

SCHEMA = "doc_id BIGINT, text STRING"


def test_dedup_and_clean_resume(spark):
    base = ingest.scratch(spark, "test-stream")
    src = os.path.join(base, "in")
    a = spark.createDataFrame([(1, "Hello  World"), (2, "dup"), (3, "#only")], SCHEMA)
    b = spark.createDataFrame([(4, "dup"), (5, "new one")], SCHEMA)
    a.write.parquet(src)
    ingest.dedup_stream(spark, src, SCHEMA, os.path.join(base, "dd"), os.path.join(base, "dd_ck"))
    ingest.clean_stream(spark, src, SCHEMA, os.path.join(base, "cl"), os.path.join(base, "cl_ck"))
    b.write.mode("append").parquet(src)
    ingest.dedup_stream(spark, src, SCHEMA, os.path.join(base, "dd"), os.path.join(base, "dd_ck"))
    ingest.clean_stream(spark, src, SCHEMA, os.path.join(base, "cl"), os.path.join(base, "cl_ck"))

    both = a.unionByName(b)
    dd = spark.read.parquet(os.path.join(base, "dd"))
    assert rows(dd, "text", "text_sha") == rows(both.select("text", F.sha2("text", 256).alias("text_sha")).distinct())
    assert set(dd.columns) == {*both.columns, "text_sha"} and dd.count() == 4   # whole rows, one per text
    ok = ingest.read_lane(spark, os.path.join(base, "cl"), "ok", SCHEMA)
    err = ingest.read_lane(spark, os.path.join(base, "cl"), "error", SCHEMA)
    batch = both.select("doc_id", clean.clean_text("text").alias("text"))
    assert rows(ok) == rows(batch.where("text <> ''"))
    assert rows(err, "doc_id") == [(3,)]
    import pytest
    with pytest.raises(RuntimeError):
        ingest.fail_on_errors(err.withColumn("lane", F.lit("error")))


def test_dedup_within_watermark(spark):
    schema = "doc_id BIGINT, text STRING, ts TIMESTAMP"
    base = ingest.scratch(spark, "test-wm")
    src = os.path.join(base, "in")
    spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", None)], "doc_id BIGINT, text STRING, ts STRING") \
        .select("doc_id", "text", F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("ts")).write.parquet(src)
    ingest.dedup_stream(spark, src, schema, os.path.join(base, "out"), os.path.join(base, "ck"),
                        event_time="ts", watermark="1 hour")
    assert spark.read.parquet(os.path.join(base, "out")).count() == 2
