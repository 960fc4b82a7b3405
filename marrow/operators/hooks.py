"""User-supplied model hooks (X3-X7), run in Arrow batches.

The core never calls a network service: callers pass plain Python callables
(an annotator, an adjudicator, a segmenter, a scorer).  Each runs inside
``mapInPandas`` on a batch, so concurrency is set by the number of
partitions (``repartition(k)`` before the call caps concurrent requests).
An exception for a row sends that row to lane 'error' instead of failing the
job; the error lane can be retried and unioned later (T3).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.functions import text as tx
from marrow.functions.arrow import stretches
from marrow.session import checkpoint_dir

SEGMENT_BYTES = 1 << 20
VOTE_SCHEMA = "id STRING, annotator STRING, rnk INT, label STRING, reason STRING, lane STRING, error STRING"


def annotate(df: DataFrame, annotators: dict[str, Callable[[str], dict]], id_col: str = "id",
             text: str = "text") -> DataFrame:
    """One vote row per (row, annotator); ``fn(text) -> {'label', 'reason'}``.

    Output is the long ``votes`` table with a lane ('ok' / 'error').  Annotator
    rank follows the order of the dict (first wins majority ties).  The votes
    are written to the checkpoint folder before anything reads them, so every
    (row, annotator) pair is one call however often the table is used.
    """
    names = list(annotators)

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            out = []
            for rid, t in zip(pdf[id_col], pdf[text]):
                for rank, name in enumerate(names, start=1):
                    try:
                        r = annotators[name](t) or {}
                        out.append((rid, name, rank, r.get("label"), r.get("reason"), "ok", None))
                    except Exception as e:  # noqa: BLE001 - any failure goes to the error lane
                        out.append((rid, name, rank, None, None, "error", repr(e)))
            yield pd.DataFrame(out, columns=["id", "annotator", "rnk", "label", "reason", "lane", "error"])

    checkpoint_dir(df.sparkSession)
    return df.select(F.col(id_col).cast("string").alias(id_col), text).mapInPandas(run, VOTE_SCHEMA).checkpoint()


def adjudicate_with(disputed_payload: DataFrame, judge: Callable[[str], dict], id_col: str = "id",
                    payload: str = "payload") -> DataFrame:
    """``judge(payload_json) -> {'label', 'reason'}`` for every disputed row."""

    def run(batches):
        for pdf in batches:
            rows = []
            for rid, p in zip(pdf[id_col], pdf[payload]):
                try:
                    r = judge(p) or {}
                    rows.append((rid, r.get("label"), r.get("reason"), "ok"))
                except Exception:  # noqa: BLE001
                    rows.append((rid, None, None, "error"))
            yield pd.DataFrame(rows, columns=[id_col, "label", "reason", "lane"])

    return disputed_payload.select(id_col, payload).mapInPandas(
        run, f"{id_col} STRING, label STRING, reason STRING, lane STRING")


def retry_errors(votes: DataFrame, annotators: dict[str, Callable[[str], dict]], texts: DataFrame,
                 id_col: str = "id", text: str = "text") -> DataFrame:
    """Call the failed (id, annotator) pairs again, and only these, and union them with the rest.

    ``votes`` must be a written table (as :func:`annotate` returns it); the
    answers are written before they are used, so no vote is lost or doubled
    when an annotator answers differently the next time.  An id with several
    texts is asked with the smallest; a failed vote without a text row stays
    in lane 'error' as it is.
    """

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            out = []
            for rid, name, rank, t in zip(pdf[id_col], pdf["annotator"], pdf["rnk"], pdf["_text"]):
                try:
                    r = annotators[name](t) or {}
                    out.append((rid, name, rank, r.get("label"), r.get("reason"), "ok", None))
                except Exception as e:  # noqa: BLE001 - stays in the error lane
                    out.append((rid, name, rank, None, None, "error", repr(e)))
            yield pd.DataFrame(out, columns=["id", "annotator", "rnk", "label", "reason", "lane", "error"])

    checkpoint_dir(votes.sparkSession)
    is_error = F.col("lane").eqNullSafe("error")
    body = texts.groupBy(F.col(id_col).cast("string").alias("_id")).agg(
        F.min(text).alias("_text"), F.lit(True).alias("_found"))
    failed = votes.where(is_error)
    failed = failed.join(body, failed[id_col].eqNullSafe(body["_id"]), "left").checkpoint()
    again = failed.where("_found").select(id_col, "annotator", "rnk", "_text").mapInPandas(run, VOTE_SCHEMA).checkpoint()
    return votes.where(~is_error).unionByName(again).unionByName(failed.where("_found is null").select(*votes.columns))


def segment(df: DataFrame, segmenter: Callable[[pd.Series], pd.Series] | None = None,
            text: str = "text", out: str = "segmented") -> DataFrame:
    """X5 + C6 + C7: emoji removal, word segmentation, tightened '_' joiners.

    The default segmenter is the whitespace split (JVM-side); a pluggable
    segmenter gets series of at most ``SEGMENT_BYTES`` of text (or one longer
    text), so a task's Python needs little more than its Arrow batch; a failing
    series is retried row by row, and only a failing row falls back to the
    emoji-free text.
    """
    clean = tx.remove_emoji(text)
    if segmenter is None:
        seg = F.array_join(tx.ws_tokens(clean), " ")
    else:
        def _one(t):
            try:
                return segmenter(pd.Series([t])).iloc[0]
            except Exception:  # noqa: BLE001
                return t

        def _some(s: pd.Series) -> pd.Series:
            try:
                return segmenter(s)
            except Exception:  # noqa: BLE001
                return s.map(_one)

        @F.arrow_udf(T.StringType())
        def _seg(texts: pa.Array) -> pa.Array:
            parts = [pa.Array.from_pandas(_some(texts.slice(a, b - a).to_pandas()), type=pa.string())
                     for a, b in stretches(texts, SEGMENT_BYTES)]
            return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

        seg = _seg(clean)
    return df.withColumn(out, tx.join_underscores(seg))


def score(df: DataFrame, loader: Callable[[], Callable[[pd.DataFrame], np.ndarray]],
          feature_cols: list[str], key: str, n_classes: int) -> DataFrame:
    """Batch scoring; ``loader()`` runs once per task and returns ``predict(pdf) -> logits``.

    Output: ``key, logits ARRAY<FLOAT>, prediction BIGINT`` (argmax, first max).
    """

    def run(batches):
        predict = loader()
        for pdf in batches:
            logits = np.asarray(predict(pdf[feature_cols]), dtype=np.float32).reshape(len(pdf), n_classes)
            yield pd.DataFrame({key: pdf[key].values, "logits": list(logits),
                                "prediction": logits.argmax(axis=1).astype("int64")})

    key_type = df.schema[key].dataType.simpleString()
    return df.select(key, *feature_cols).mapInPandas(
        run, f"{key} {key_type}, logits ARRAY<FLOAT>, prediction BIGINT")


def encode_with(df: DataFrame, tokenizer: Callable[[list[str], int], dict], max_len: int = 128,
                text: str = "text") -> DataFrame:
    """A pluggable (subword) tokenizer with padding/truncation, in Arrow batches.

    ``tokenizer(texts, max_len) -> {'input_ids': [[...]], 'attention_mask': [[...]]}``
    (the shape returned by common tokenizer libraries with ``padding='max_length'``).
    """
    out_type = "struct<input_ids:array<bigint>,attention_mask:array<bigint>>"

    @F.pandas_udf(out_type)
    def _enc(s: pd.Series) -> pd.DataFrame:
        enc = tokenizer(s.tolist(), max_len)
        return pd.DataFrame({"input_ids": list(enc["input_ids"]),
                             "attention_mask": list(enc["attention_mask"])})

    return df.withColumn("encoding", _enc(F.col(text)))
