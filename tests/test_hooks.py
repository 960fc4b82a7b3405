"""User-model hooks: error lanes and retry, adjudication, scoring, segmentation, ML baseline."""
import numpy as np

from marrow.operators import evaluate as E
from marrow.operators import hooks, ml
from tests.conftest import rows


def test_annotate_error_lane_and_retry(spark):
    texts = spark.createDataFrame([("a_0", "you are stupid"), ("a_1", "hello"), ("a_2", "boom")],
                                  "id STRING, text STRING")

    def good(t):
        return {"label": "TOXIC" if "stupid" in t else "NON-TOXIC", "reason": "kw"}

    def flaky(t):
        if t == "boom":
            raise ConnectionError("down")
        return good(t)

    first = hooks.annotate(texts, {"a": good, "b": flaky})
    assert rows(first.where("lane = 'error'"), "id", "annotator") == [("a_2", "b")]
    fixed = hooks.retry_errors(first, {"a": good, "b": good}, texts)
    assert fixed.where("lane = 'error'").count() == 0
    assert rows(fixed, "id", "annotator", "label") == [
        ("a_0", "a", "TOXIC"), ("a_0", "b", "TOXIC"), ("a_1", "a", "NON-TOXIC"), ("a_1", "b", "NON-TOXIC"),
        ("a_2", "a", "NON-TOXIC"), ("a_2", "b", "NON-TOXIC")]


def test_random_failures_lose_and_double_nothing(spark):
    import random
    n = 2000
    texts = spark.range(n).selectExpr("cast(id as string) id", "concat('t', id) text")

    def flaky(t):
        if random.random() < 0.5:
            raise ConnectionError("down")
        return {"label": "A", "reason": t}

    votes = hooks.annotate(texts, {"a": flaky})
    failed = {r.id for r in votes.where("lane = 'error'").collect()}
    again = hooks.retry_errors(votes, {"a": lambda t: {"label": "B", "reason": t}}, texts)
    got = again.collect()
    assert len(got) == n == len({r.id for r in got})
    # exactly the failed pairs were called again
    assert {r.id for r in got if r.label == "B"} == failed and 0 < len(failed) < n


def test_retry_calls_only_the_failed_annotator(spark):
    texts = spark.createDataFrame([("1", "x")], "id STRING, text STRING")

    def down(t):
        raise ConnectionError("down")

    def never(t):
        raise AssertionError("called for a pair that had not failed")

    votes = hooks.annotate(texts, {"a": lambda t: {"label": "T"}, "b": down})
    fixed = hooks.retry_errors(votes, {"a": never, "b": lambda t: {"label": "N"}}, texts)
    assert rows(fixed, "annotator", "label", "lane") == [("a", "T", "ok"), ("b", "N", "ok")]


def test_retry_keeps_votes_without_a_text_and_doubles_none(spark):
    votes = spark.createDataFrame([("x", "a", 1, None, None, "error", "E1"), (None, "a", 1, None, None, "error", "E2"),
                                   ("gone", "a", 1, None, None, "error", "E3"), ("y", "a", 1, "T", None, "ok", None)],
                                  hooks.VOTE_SCHEMA)
    texts = spark.createDataFrame([("x", "t"), ("x", "t"), ("x", "u"), ("y", "v")], "id STRING, text STRING")
    ask = {"a": lambda t: {"label": t}}
    found = hooks.retry_errors(votes, ask, texts).collect()
    got = {(r.id, r.label, r.lane, r.error) for r in found}
    assert len(found) == 4 and got == {("x", "t", "ok", None), (None, None, "error", "E2"), ("gone", None, "error", "E3"), ("y", "T", "ok", None)}
    texts = texts.union(spark.createDataFrame([(None, "n")], "id STRING, text STRING"))
    assert (None, "n", "ok") in {(r.id, r.label, r.lane) for r in hooks.retry_errors(votes, ask, texts).collect()}


def test_segment_falls_back_for_the_failing_row_only(spark):
    df = spark.createDataFrame([("good one",), ("bad one",)], "text STRING").coalesce(1)

    def segmenter(s):
        if s.str.contains("bad").any():
            raise ValueError("cannot segment")
        return s.str.replace(" ", "_")

    assert rows(hooks.segment(df, segmenter), "text", "segmented") == [("bad one", "bad one"), ("good one", "good_one")]


def test_segment_hands_over_bounded_series(spark):
    from pyspark.sql import functions as F

    df = spark.range(300).select("id", F.concat(F.lit("a b "), F.repeat(F.lit("word "), F.when(F.col("id") == 7, 400000).otherwise(4000))).alias("text")).coalesce(1)

    def segmenter(s):
        size = int(s.str.len().sum())
        return s.map(lambda t: f"{len(s)} {size}")

    seen = [tuple(map(int, r.segmented.split())) for r in hooks.segment(df, segmenter).collect()]
    assert len(seen) == 300 and (1, 400000 * 5 + 4) in seen
    assert all(n == 1 or size <= hooks.SEGMENT_BYTES for n, size in seen) and max(n for n, _ in seen) > 10


def test_adjudicate_and_score(spark):
    payload = spark.createDataFrame([("x", '{"text": "t"}'), ("y", "bad")], "id STRING, payload STRING")

    def judge(p):
        if p == "bad":
            raise ValueError("unparseable")
        return {"label": "TOXIC", "reason": "r"}

    assert rows(hooks.adjudicate_with(payload, judge), "id", "label", "lane") == [
        ("x", "TOXIC", "ok"), ("y", None, "error")]

    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 3.0])], "k INT, f ARRAY<DOUBLE>")

    def loader():
        w = np.array([[1.0, 0.0, 0.0], [0.0, 0.0, 2.0]])
        return lambda pdf: np.stack(pdf["f"].to_numpy()) @ w

    out = hooks.score(df, loader, ["f"], "k", 3)
    assert rows(out, "k", "prediction") == [(1, 0), (2, 2)]


def test_segment_default_and_plugged(spark):
    df = spark.createDataFrame([("a  b \U0001F602 _ c",)], "text STRING")
    assert hooks.segment(df).collect()[0].segmented == "a b_c"
    plugged = hooks.segment(df, lambda s: s.str.upper())
    assert plugged.collect()[0].segmented == "A  B_C"


def test_ml_baseline_learns_keyword(spark):
    data = [(i, ("bad word here " if i % 2 else "nice text ") + str(i), i % 2) for i in range(200)]
    df = spark.createDataFrame(data, "id INT, text STRING, label INT")
    model = ml.train(df.where("id < 150"), max_iter=30)
    pred = ml.predict(model, df.where("id >= 150"), "id")
    assert E.binary_metrics(pred).collect()[0].accuracy > 0.9
