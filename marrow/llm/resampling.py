"""Importance resampling towards a target distribution.

A text's features are its runs of 1 to ``orders`` consecutive words, hashed
into ``buckets`` by the CRC-32 of their bytes.  The gain of a bucket is the log
ratio of its smoothed shares in the target table and in the corpus, in whole
thousandths; a document's weight is the sum of the gains of its features, and
its score is that weight plus Gumbel noise that follows from its key alone.
The highest scores are then a draw without replacement in proportion to
exp(weight), and the same rows are drawn by any partitioning and any run.

Texts are taken apart by Arrow kernels: ``ascii_lower``, ``split_pattern_regex``
and ``list_flatten`` give the words of a chunk, ``dictionary_encode`` its
distinct ones.  Indices shifted by one word against themselves form the
n-grams; only distinct (prefix, word) pairs are hashed, each from the CRC of its
prefix, ``take`` brings the gains to the features and a segmented sum to the
documents.  No n-gram is ever written out, and no text is shuffled: a task adds
its counts up in one array and gives at most ``buckets`` rows.

Bounded by parameters: the table of gains (``buckets`` whole numbers) is all
that passes through the driver.  The draw ranks narrow rows, range-partitioned
and checkpointed.

Defined results: null and empty texts, and texts without a word, have no
features and weight 0, and are never drawn; a null key counts as an empty
string in the noise and sorts before all others; rows that repeat a key are
drawn each for itself (those alike in all columns in any order); with an empty
corpus nothing is drawn; an empty target has equal shares; further columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.llm import core
from marrow.operators.clean import rank_table
from marrow.session import checkpoint_dir

#: everything but words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CHUNK_BYTES = 4 << 20


def _crcs(words: pa.LargeStringArray) -> np.ndarray:
    """CRC-32 of every string of an array without offset or nulls."""
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset: words.offset + len(words) + 1].tolist()
    data = memoryview(words.buffers()[2] or b"")
    return np.fromiter((zlib.crc32(data[a:b]) for a, b in zip(at, at[1:])), np.int64, len(words))


def _extended(crcs: np.ndarray, words: pa.LargeStringArray, pairs: np.ndarray, base: int) -> np.ndarray:
    """CRC-32 of 'prefix word' of every distinct pair: the CRC goes on from the prefix's."""
    used, place = np.unique(pairs % base, return_inverse=True)
    tails = [b" " + w.encode() for w in words.take(pa.array(used)).to_pylist()]
    heads = crcs[pairs // base].tolist()
    return np.fromiter((zlib.crc32(tails[p], c) for p, c in zip(place.tolist(), heads)), np.int64, len(pairs))


def features(texts: pa.LargeStringArray, orders: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of all features of a chunk, one pair of arrays for each order."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=SEPARATORS)
    words = pc.list_flatten(lists)
    real = pc.not_equal(words, "")  # what stands before the first and behind the last separator
    owner = pc.list_parent_indices(lists).filter(real).to_numpy()
    coded = pc.dictionary_encode(words.filter(real))
    index, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    base = max(len(distinct), 1)
    crcs, code = _crcs(distinct), index
    for n in range(1, orders + 1):
        if n > 1:
            last = index[n - 1:]
            whole = owner[: len(last)] == owner[n - 1:]  # both ends lie in one document
            pairs, code_of = np.unique(code[: len(last)][whole] * base + last[whole], return_inverse=True)
            crcs = _extended(crcs, distinct, pairs, base)
            code = np.full(len(last), -1, np.int64)
            code[whole] = code_of
        held = code >= 0
        yield owner[: len(code)][held], (crcs % buckets)[code[held]]


def _texts(column: pa.Array) -> Iterator[tuple[int, int, pa.LargeStringArray]]:
    """(first row, end row, texts) of chunks bounded by bytes."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    for lo, hi, _, _ in core.chunks(column, CHUNK_BYTES):
        yield lo, hi, column.slice(lo, hi - lo)


def bucket_counts(docs: DataFrame, orders: int = 1, buckets: int = 10000, text: str = "text") -> DataFrame:
    """(bucket, n): how many features of all texts lie in each bucket; empty buckets are left out."""

    def counted(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, texts in _texts(batch.column(0)):
                for _, bucket in features(texts, orders, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    parts = docs.select(F.col(text).alias("text")).mapInArrow(counted, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = 10000,
                 text: str = "text", target_text: str = "text") -> DataFrame:
    """(bucket, gain) of all buckets: 1000 times the log ratio of target and corpus shares, each
    bucket counted once more than found, rounded down."""
    spark = docs.sparkSession
    sides = [bucket_counts(docs, orders, buckets, text).withColumnRenamed("n", "s"),
             bucket_counts(target, orders, buckets, target_text).withColumnRenamed("n", "t")]
    found = spark.range(buckets).select(F.col("id").alias("bucket"))
    for side in sides:
        found = found.join(side, "bucket", "left")
    found = found.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    sums = found.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))

    def d(expr):
        return F.expr(expr).cast("double")

    ratio = d("t + 1") * d(f"all_s + {buckets}") / (d("s + 1") * d(f"all_t + {buckets}"))
    return found.crossJoin(F.broadcast(sums)).select(  # one row of two sums
        "bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def weigh(docs: DataFrame, gains: list[int], orders: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_features, weight) of every document; ``gains`` by bucket."""
    table, buckets = np.array(gains, np.int64), len(gains)
    kind = docs.schema[key].dataType.simpleString()

    def weighed(batch: pa.RecordBatch):
        for lo, hi, texts in _texts(batch.column(1)):
            rows = hi - lo
            words, n, weight = None, np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for owner, bucket in features(texts, orders, buckets):
                count = np.bincount(owner, minlength=rows)
                words = count if words is None else words
                n += count
                first = np.concatenate(([0], np.cumsum(count)))
                weight += core.segment_sums(table.take(bucket), first)  # owners ascend
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, rows), pa.array(words), pa.array(n), pa.array(weight)],
                names=["key", "n_words", "n_features", "weight"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        core.over_batches(weighed), f"key {kind}, n_words long, n_features long, weight long").withColumnRenamed("key", key)


def gumbel(key: str, seed: int) -> F.Column:
    """Noise of a row in whole thousandths, from the SHA-256 of its seed and key."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, orders: int = 1,
             buckets: int = 10000, seed: int = 2024, key: str = "doc_id", text: str = "text",
             target_text: str = "text") -> DataFrame:
    """Every document with its features, weight and score; ``rank`` (from 1) of those drawn.

    Drawn are the highest scores, ties to the smaller key, of the documents of at least
    ``min_words`` words: ``percent`` of these, rounded down."""
    checkpoint_dir(docs.sparkSession)
    # as many whole numbers as there are buckets
    gains = [r.gain for r in bucket_gains(docs, target, orders, buckets, text, target_text).orderBy("bucket").collect()]
    weighed = weigh(docs, gains, orders, key, text)
    # narrow rows, written once: the texts are not read again to rank them
    scored = weighed.withColumn("score", F.col("weight") + gumbel(key, seed)).checkpoint(eager=True)
    drawn = F.col("n_words") >= min_words
    quota = scored.where(drawn).count() * percent // 100
    shown = [key, "n_features", "weight", "score"]
    order = F.struct((-F.col("score")).alias("_down"), F.col(key), F.xxhash64("n_features", "weight").alias("_rows"),
                     F.monotonically_increasing_id().alias("_row"), "n_features", "weight", "score")
    ranked = rank_table(scored.where(drawn).select(order.alias("of")), None, "of", "_rank").select(
        *(F.col(f"of.{c}").alias(c) for c in shown),
        F.when(F.col("_rank") < quota, F.col("_rank") + 1).cast("long").alias("rank"))
    return ranked.unionByName(scored.where(~drawn).select(*shown, F.lit(None).cast("long").alias("rank")))
