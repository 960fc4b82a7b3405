"""Vocabulary, encodings and metrics."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marrow.operators import encode, evaluate as E
from tests.conftest import rows


def test_vocab_and_encoding(spark):
    train = spark.createDataFrame([("b a",), ("c a",), ("",)], "text STRING")
    vocab = encode.build_vocab(train)
    assert rows(vocab) == [("", 1), ("<pad>", 0), ("<unk>", 5), ("a", 2), ("b", 3), ("c", 4)]
    docs = spark.createDataFrame([(1, "a z b"), (2, "c")], "doc_id INT, text STRING")
    enc = encode.encode_tokens(docs, vocab, "doc_id")
    assert {r.doc_id: r.input_ids for r in enc.collect()} == {1: [2, 5, 3], 2: [4]}
    oov = rows(encode.oov_rate(docs.withColumn("g", F.lit("x")), vocab, "g"), "g", "n_tokens", "n_oov")
    assert oov == [("x", 4, 1)]


@pytest.mark.parametrize("ids,expect", [([1, 2, 3, 4], [1, 2, 3]), ([1, 2, 3], [1, 2, 3]), ([5], [5, 0, 0])])
def test_pad_and_mask(spark, ids, expect):
    df = spark.createDataFrame([(ids,)], "ids ARRAY<BIGINT>")
    padded, mask = encode.pad_and_mask("ids", 3)
    r = df.select(padded.alias("p"), mask.alias("m")).collect()[0]
    assert r.p == expect and r.m == [1 if x else 0 for x in expect]


def test_label_encode_unknown_goes_to_error_lane(spark):
    df = spark.createDataFrame([("REPORTED",), ("EXPLICIT",), ("???",)], "label STRING")
    out = rows(encode.label_encode(df, "expression_type"), "label", "label_id", "lane")
    assert out == [("???", None, "error"), ("EXPLICIT", 1, "ok"), ("REPORTED", 2, "ok")]
    with pytest.raises(ValueError):
        encode.label_encode(df, "sentiment")


def test_binary_metrics_zero_division(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "label INT, prediction INT")
    m = E.binary_metrics(df).collect()[0]
    assert (m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0) and m.accuracy == pytest.approx(1 / 3)


def test_macro_metrics_class_only_in_predictions(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1), (1, 0)], "label INT, prediction INT")
    m = E.macro_metrics(df).collect()[0]
    # classes 0, 1, 2; per class p/r: 0 -> 1/2, 1/2; 1 -> 1, 1/2; 2 -> 0, 0
    assert m.n_classes == 3
    assert m.macro_precision == pytest.approx((0.5 + 1 + 0) / 3)
    assert m.macro_recall == pytest.approx((0.5 + 0.5 + 0) / 3)
    assert m.macro_f1 == pytest.approx((0.5 + 2 / 3 + 0) / 3)
    assert m.accuracy == pytest.approx(0.5)


def test_argmax_and_cross_entropy(spark):
    logits = [[1.0, 3.0, 3.0], [0.5, -1.0, 2.0]]
    labels = [2, 0]
    df = spark.createDataFrame(list(zip(logits, labels)), "logits ARRAY<DOUBLE>, label INT")
    assert [r.p for r in df.select(E.argmax("logits").alias("p")).collect()] == [1, 2]
    want = np.mean([math.log(sum(math.exp(x) for x in l)) - l[y] for l, y in zip(logits, labels)])
    assert E.mean_cross_entropy(df).collect()[0].mean_ce == pytest.approx(want)


def test_reserved_words_and_hot_words(spark):
    from marrow.operators import encode
    df = spark.createDataFrame([(1, "a <pad> b <unk>"), (2, "a " * 50 + "zz")], "id INT, text STRING")
    vocab = encode.build_vocab(df.where("id = 1"))
    assert sorted((r.word, r.idx) for r in vocab.collect()) == [("<pad>", 0), ("<unk>", 3), ("a", 1), ("b", 2)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ids = {r.id: r.input_ids for r in encode.encode_tokens(df.withColumn("text", tx_strip("text")), vocab, "id").collect()}
        assert ids[1] == [1, 0, 2, 3] and ids[2] == [1] * 50 + [3]
        short = encode.encode_tokens(df.withColumn("text", tx_strip("text")), vocab, "id", max_len=2)
        assert {r.id: r.input_ids for r in short.collect()} == {1: [1, 0], 2: [1, 1]}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def tx_strip(c):
    from marrow.functions import text as tx
    return tx.strip_ws(c)


@pytest.mark.parametrize("seed", range(6))
def test_exact_mean_is_the_same_bits_in_any_order(spark, seed):
    import math
    import random

    from marrow.functions.exact import exact_mean

    rng = random.Random(3)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 12) for _ in range(4000)] + [1e15, -1e15, 1e-9, None]
    rng = random.Random(seed)
    rng.shuffle(values)
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "g int, v double").repartition(1 + seed * 3)
    row = exact_mean(df, "v", total="sum").first()
    real = [v for v in values if v is not None]
    assert row.n == len(values)
    assert row["sum"] == pytest.approx(math.fsum(real), rel=0, abs=1e-9)
    first = exact_mean(spark.createDataFrame([(v,) for v in sorted(real)], "v double").coalesce(1), "v").first()
    assert row["mean"] == first["mean"]  # bit by bit
    assert exact_mean(df.where("v is null"), "v").first()["mean"] is None
    odd = spark.createDataFrame([(1.0,), (float("inf"),)], "v double")
    assert exact_mean(odd, "v").first()["mean"] == float("inf")


def test_mean_cross_entropy_does_not_depend_on_partitions(spark):
    from pyspark.sql import functions as F

    from marrow.operators.evaluate import mean_cross_entropy

    df = spark.range(3000).select(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.sin(F.col("id") * (i + 1))).alias("logits"),
                                  (F.col("id") % 5).cast("int").alias("label"), F.xxhash64("id").alias("k"))
    found = {mean_cross_entropy(df.repartition(n, "k")).first().mean_ce.hex() for n in (1, 2, 5, 8, 13, 21)}
    assert len(found) == 1
