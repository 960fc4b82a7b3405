"""Streaming, Python hooks and the Spark ML baseline.

The streaming queries equal a batch run, and the hooks run functions that SQL
can state as well; only the fitted baseline is checked on row counts.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marrow.operators import hooks, language, ml, votes
from marrow.operators import evaluate as E
from marrow.plans import sqltext as S
from marrow.plans.fixtures_sql import LABELLED, MARKED
from marrow.plans.q_language import BEST
from marrow.plans.registry import register
from marrow.sources import fixtures as fx
from marrow.sources.tables import table
from marrow.streaming import ingest

DOC_SCHEMA = "doc_id BIGINT, text STRING, split STRING"


def _feed_twice(spark, sf_dir, run):
    """Write documents into a folder in two steps and run the stream after each."""
    base = ingest.scratch(spark, "stream")
    src, out, ckpt = (os.path.join(base, p) for p in ("in", "out", "ckpt"))
    docs = fx.documents_split(spark, sf_dir).select("doc_id", "text", "split")
    docs.where(F.col("split") != "train").write.mode("append").parquet(src)
    run(src, out, ckpt)
    docs.where(F.col("split") == "train").write.mode("append").parquet(src)
    run(src, out, ckpt)
    return out


@register("stream_dedup", operators=("T2", "T1"), sql="""
SELECT text, sha256(text) AS text_sha FROM documents GROUP BY text
""")
def stream_dedup(spark, sf_dir):
    out = _feed_twice(spark, sf_dir,
                      lambda s, o, c: ingest.dedup_stream(spark, s, DOC_SCHEMA, o, c))
    # which of the rows with one text arrives first is up to the stream; the text is not
    return spark.read.schema("doc_id BIGINT, text STRING, split STRING, text_sha STRING").parquet(out).select("text", "text_sha")


@register("stream_resume_clean", operators=("T1", "T3"), sql=f"""
SELECT doc_id, {S.clean_text('text')} AS text FROM documents WHERE {S.clean_text('text')} <> ''
""")
def stream_resume_clean(spark, sf_dir):
    out = _feed_twice(spark, sf_dir,
                      lambda s, o, c: ingest.clean_stream(spark, s, DOC_SCHEMA, o, c))
    return ingest.read_lane(spark, out, "ok", "doc_id BIGINT, text STRING").select("doc_id", "text")


# --- hooks --------------------------------------------------------------------
def _kw_annotator(words, flaky=False):
    def fn(text):
        # a flaky service: fails on about one text in five (checksum of the whole text)
        if flaky and zlib.crc32(text.encode("utf-8")) % 5 == 0:
            raise TimeoutError("annotation service timed out")
        hit = any(w in text.lower() for w in words)
        return {"label": "TOXIC" if hit else "NON-TOXIC", "reason": f"keywords {words}"}
    return fn


ANNOTATORS_FIRST = {"deepseek": _kw_annotator(("hate", "kill")),
                    "mistral": _kw_annotator(("hate", "stupid")),
                    "qwen": _kw_annotator(("kill", "stupid"), flaky=True)}
ANNOTATORS_RETRY = dict(ANNOTATORS_FIRST, qwen=_kw_annotator(("kill", "stupid")))


@register("hook_annotate_lanes", operators=("X3", "X4", "T3", "G1", "G3", "U1"), sql=f"""
WITH {LABELLED},
kw AS (SELECT id, contains(lower(text), 'hate') AS h, contains(lower(text), 'kill') AS k,
              contains(lower(text), 'stupid') AS s FROM ldocs),
v AS (SELECT id, h OR k AS a, h OR s AS b, k OR s AS c FROM kw)
SELECT id, CASE WHEN a = b AND b = c AND a THEN 'TOXIC' ELSE 'NON-TOXIC' END AS label,
       CASE WHEN a = b AND b = c THEN 'similar' ELSE 'checked' END AS lane FROM v
""")
def hook_annotate_lanes(spark, sf_dir):
    info = fx.labelled_documents(spark, sf_dir).select("id", "text")
    first = hooks.annotate(info, ANNOTATORS_FIRST)
    v = hooks.retry_errors(first, ANNOTATORS_RETRY, info)
    ingest.fail_on_errors(v)  # as the source: no checking before every vote is in
    s = votes.vote_summary(v)
    disputed = s.where("lane = 'different'").select("id", *votes.DEFAULT_ANNOTATORS)
    payload = votes.adjudication_payload(disputed, info)
    adj = hooks.adjudicate_with(payload, lambda p: {"label": "NON-TOXIC", "reason": "adjudicated"})
    similar = s.where("unanimous").select("id", "label", F.lit("similar").alias("lane"))
    checked = adj.where(F.col("lane") == "ok").select("id", "label", F.lit("checked").alias("lane"))
    return similar.unionByName(checked)


def _linear_loader():
    # integer weights by rule, on whole thousandths of the entries, so that every sum is exact
    w = np.array([[(i * (c + 3) + 2 * c) % 7 - 3 for c in range(10)] for i in range(64)], np.float64)

    def predict(pdf: pd.DataFrame):
        x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        return np.trunc(x * 1000) @ w

    return predict


@register("hook_score", operators=("X7", "O7", "G19"), sql="""
WITH s AS (SELECT vec_id, label, list_transform(range(10), lambda c: list_sum(list_transform(embedding, lambda x, i:
             CAST(trunc(CAST(x AS DOUBLE) * 1000) AS BIGINT) * (((i - 1) * (c + 3) + 2 * c) % 7 - 3)))) AS logits
           FROM embeddings)
SELECT vec_id, CAST(list_position(logits, list_max(logits)) - 1 AS BIGINT) AS prediction,
       CAST(list_max(logits) AS BIGINT) AS top FROM s
""")
def hook_score(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    scored = hooks.score(emb, _linear_loader, ["embedding"], "vec_id", 10)
    return scored.select("vec_id", "prediction", F.array_max("logits").cast("long").alias("top"))


@register("ml_baseline", operators=("X8", "G18"))
def ml_baseline(spark, sf_dir):
    lab = fx.labelled_documents(spark, sf_dir).withColumn("split", fx.split_of("doc_id"))
    data = lab.select("doc_id", "text", "split", F.col("toxic").alias("label"))
    model = ml.train(data.where(F.col("split") == "train"), max_iter=20)
    pred = ml.predict(model, data.where(F.col("split") != "train"), "doc_id")
    return E.binary_metrics(pred)


@register("second_opinion_route", operators=("X2", "S11", "X1"), sql=f"""
WITH {BEST}
SELECT CASE WHEN b.detected IS NULL THEN 'undetectable' WHEN b.detected = 'en' THEN 'accepted'
            WHEN contains(lower(d.text), ' the ') THEN 'accepted_second' ELSE 'rejected' END AS lane,
       CAST(count(*) AS BIGINT) AS n
FROM documents d LEFT JOIN best b USING (doc_id) GROUP BY 1
""")
def second_opinion_route(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    routed = language.route_by_language(d, "doc_id", "en")

    def judge(texts: pd.Series) -> pd.Series:
        # empty reply = accept (mostly English by a looser rule), anything else = reject
        return texts.map(lambda t: "" if " the " in t.lower() else "None")

    lanes = language.second_opinion(routed.select("doc_id", "text", "detected", "lane"), judge)
    return lanes.groupBy("lane").agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("segment_words", operators=("X5", "C6", "C7"), sql=f"""
WITH {MARKED},
t AS (SELECT doc_id, {S.ws_tokens(S.remove_emoji('text'))} AS w FROM marked)
SELECT doc_id, array_to_string(list_transform(range(1, len(w) + 1, 2),
         lambda i: array_to_string(list_slice(w, i, i + 1), '_')), ' ') AS segmented,
       CAST((len(w) + 1) // 2 AS BIGINT) AS n_words FROM t
""")
def segment_words(spark, sf_dir):
    d = fx.marked_documents(spark, sf_dir).select("doc_id", "text")

    def pair_segmenter(s: pd.Series) -> pd.Series:
        # joins every two words with '_' (stands in for a word segmenter)
        def seg(t):
            w = t.split()
            return " ".join("_".join(w[i:i + 2]) for i in range(0, len(w), 2))
        return s.map(seg)

    out = hooks.segment(d, pair_segmenter)
    words = F.size(F.filter(F.split("segmented", " "), lambda w: w != "")).cast("long")
    return out.select("doc_id", "segmented", words.alias("n_words"))
