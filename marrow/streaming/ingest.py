"""Incremental ingestion with Structured Streaming.

* T1 resume: a file-source stream with ``trigger(availableNow=True)`` and a
  checkpoint processes only files it has not seen; re-running after new
  files arrive continues where it stopped.
* T2 dedup: ``dropDuplicates`` on a 32-byte text hash.  Without an event
  time the state is unbounded (one hash per distinct text, as the source's
  in-memory seen-set); only hashes are stored, never texts.
* T3 lanes: ``foreachBatch`` writes every micro-batch to ``ok`` / ``error``
  folders keyed by batch id with overwrite, so a replayed batch replaces its
  own output (exactly-once at the sink).
All folders live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.operators.clean import clean_text
from marrow.session import checkpoint_dir


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the shared checkpoint dir (never a machine-local temp dir)."""
    return os.path.join(checkpoint_dir(spark), f"{tag}-{uuid.uuid4().hex[:12]}")


def dedup_stream(spark: SparkSession, source_dir: str, schema: str, out_dir: str, ckpt: str,
                 text: str = "text", event_time: str | None = None,
                 watermark: str = "1 day") -> None:
    """Run the dedup stream over every file not yet processed, then stop.

    Without ``event_time`` the seen-set is unbounded (one hash per distinct
    text).  With an event-time column, duplicates are only removed within the
    watermark delay (``dropDuplicatesWithinWatermark``) and state is evicted.
    """
    src = spark.readStream.schema(schema).parquet(source_dir)
    hashed = src.withColumn("text_sha", F.sha2(F.col(text), 256))
    if event_time:
        deduped = hashed.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["text_sha"])
    else:
        deduped = hashed.dropDuplicates(["text_sha"])
    # the first row of every text with all its columns; the state holds the hashes only
    q = (deduped.writeStream.format("parquet").option("path", out_dir)
               .option("checkpointLocation", ckpt).outputMode("append")
               .trigger(availableNow=True).start())
    q.awaitTermination()


def clean_stream(spark: SparkSession, source_dir: str, schema: str, out_dir: str, ckpt: str,
                 key: str = "doc_id", text: str = "text") -> None:
    """T1 + T3: clean every new file; non-empty results to ``ok``, empty ones to ``error``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        cleaned = batch.select(key, clean_text(text).alias(text)).withColumn(
            "lane", F.when(F.col(text) != "", "ok").otherwise("error"))
        (cleaned.write.mode("overwrite").partitionBy("lane")
                .parquet(os.path.join(out_dir, f"batch={batch_id}")))

    src = spark.readStream.schema(schema).parquet(source_dir)
    q = (src.writeStream.foreachBatch(write).option("checkpointLocation", ckpt)
            .trigger(availableNow=True).start())
    q.awaitTermination()


def read_lane(spark: SparkSession, out_dir: str, lane: str, schema: str) -> DataFrame:
    """Rows of one lane over every batch written so far."""
    df = (spark.read.schema(schema).option("basePath", out_dir)
               .parquet(os.path.join(out_dir, "batch=*", f"lane={lane}")))
    return df.select(*[f.name for f in df.schema.fields if f.name not in ("batch", "lane")])


def fail_on_errors(df: DataFrame, lane_col: str = "lane") -> None:
    """T3 strict gate: stop before checking when any row is in the error lane.

    A scalar action (one count) - the only driver-side read in the pipeline.
    """
    n = df.where(F.col(lane_col) == "error").count()
    if n:
        raise RuntimeError(f"{n} rows in the error lane; retry them before continuing")
