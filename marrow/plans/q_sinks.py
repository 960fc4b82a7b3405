"""Round trips through the writers: each query writes a table below the shared checkpoint
folder, reads it back and returns what it read; the plain table is the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from marrow.operators import encode
from marrow.operators import evaluate as E
from marrow.plans.q_encode import VOCAB_SQL, _vocab
from marrow.plans.registry import register
from marrow.sources import sinks, tables
from marrow.sources.tables import table
from marrow.streaming.ingest import scratch

ROW = "doc_id BIGINT, text STRING, lang STRING, source STRING"
PLAIN = "SELECT doc_id, text, lang, source FROM documents"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


@register("json_round_trip", operators=("K1",), sql=PLAIN)
def json_round_trip(spark, sf_dir):
    path = scratch(spark, "json")
    sinks.write_json(_docs(spark, sf_dir), path)
    return spark.read.schema(ROW).json(path)


@register("csv_round_trip", operators=("K2", "K3"), sql=PLAIN)
def csv_round_trip(spark, sf_dir):
    path = scratch(spark, "csv")
    docs = _docs(spark, sf_dir)
    sinks.write_csv(docs.where("lang = 'en'"), path)
    sinks.write_csv(docs.where("lang <> 'en' OR lang IS NULL"), path, append=True)
    return spark.read.schema(ROW).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


@register("stage_round_trip", operators=("K4",), sql=f"""
SELECT *, 'raw' AS stage FROM ({PLAIN}) UNION ALL SELECT *, 'short' FROM ({PLAIN}) WHERE length(text) < 1000
""")
def stage_round_trip(spark, sf_dir):
    path = scratch(spark, "stages")
    docs = _docs(spark, sf_dir)
    for _ in range(2):  # a stage written again replaces itself only
        sinks.write_stage(docs.where(F.char_length("text") < 1000), path, "short")
    sinks.write_stage(docs, path, "raw")
    return spark.read.schema(ROW + ", stage STRING").parquet(path)


@register("category_append", operators=("K5",), sql=PLAIN)
def category_append(spark, sf_dir):
    path = scratch(spark, "categories")
    docs = _docs(spark, sf_dir)
    sinks.append_category(docs.where("doc_id % 2 = 0"), path, "source")
    sinks.append_category(docs.where("doc_id % 2 = 1"), path, "source")
    return spark.read.schema(ROW).parquet(path)


@register("results_document", operators=("K7",), sql="""
SELECT doc_id, CAST(toxic AS BIGINT) AS label, CAST(quality AS BIGINT) AS prediction,
       (SELECT count(*) FILTER (WHERE toxic = quality) / CAST(count(*) AS DOUBLE) FROM labels) AS accuracy FROM labels
""")
def results_document(spark, sf_dir):
    path = scratch(spark, "results")
    rows = table(spark, sf_dir, "labels").select(
        "doc_id", F.col("toxic").cast("long").alias("label"), F.col("quality").cast("long").alias("prediction"))
    sinks.write_results(rows, E.binary_metrics(rows), path)
    metrics = spark.read.parquet(f"{path}/metrics").select("accuracy").scalar()
    return spark.read.parquet(f"{path}/rows").withColumn("accuracy", metrics)


@register("vocab_inverse", operators=("C17",), sql=f"WITH {VOCAB_SQL} SELECT idx, word FROM vocab")
def vocab_inverse(spark, sf_dir):
    return encode.invert_vocab(_vocab(spark, sf_dir))


@register("word_vector_file", operators=("S12",), sql="""
SELECT 'w' || vec_id AS word, CAST(round(embedding[1] * 1000) AS BIGINT) AS first,
       CAST(list_sum(list_transform(embedding, lambda x: CAST(round(x * 1000) AS BIGINT))) AS BIGINT) AS total, 'ok' AS lane FROM embeddings
""")
def word_vector_file(spark, sf_dir):
    # the vectors as a text file of whole thousandths, read back by the word-vector reader
    path = scratch(spark, "vectors")
    e = table(spark, sf_dir, "embeddings")
    whole = F.transform("embedding", lambda x: F.round(x * 1000).cast("long").cast("string"))
    e.select(F.concat(F.lit("w"), F.col("vec_id"), F.lit(" "), F.array_join(whole, " ")).alias("value")).write.text(path)
    got = tables.read_word_vectors(spark, path, 64)
    return got.select("word", F.get("vector", 0).cast("long").alias("first"),
                      F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).alias("total"), "lane")
