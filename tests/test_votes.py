"""Votes, lanes, Fleiss' kappa (golden value), consensus policies, domain checks."""
import pytest
from pyspark.sql import functions as F

from marrow.operators import joins, votes as V
from tests.conftest import rows

# Published 10-subject x 5-category example with 14 raters per subject (kappa ~ 0.210).
FLEISS_EXAMPLE = [
    [0, 0, 0, 0, 14], [0, 2, 6, 4, 2], [0, 0, 3, 5, 6], [0, 3, 9, 2, 0], [2, 2, 8, 1, 1],
    [7, 7, 0, 0, 0], [3, 2, 6, 3, 0], [2, 5, 3, 2, 2], [6, 5, 2, 1, 0], [0, 2, 2, 3, 7],
]


def _long_votes(spark, matrix):
    out = []
    for i, row in enumerate(matrix):
        r = 0
        for j, n in enumerate(row):
            for _ in range(n):
                out.append((f"s_{i}", f"r{r}", r + 1, f"L{j}"))
                r += 1
    return spark.createDataFrame(out, "id STRING, annotator STRING, rnk INT, label STRING")


def test_fleiss_golden(spark):
    k = V.fleiss_kappa(_long_votes(spark, FLEISS_EXAMPLE)).collect()[0]
    assert k.n_subjects == 10 and k.n_raters == 14
    assert abs(k.kappa - 0.2099307) < 1e-6


def test_fleiss_edges(spark):
    agree = _long_votes(spark, [[3, 0], [0, 3], [3, 0]])
    assert V.fleiss_kappa(agree).collect()[0].kappa == pytest.approx(1.0)
    one_label = _long_votes(spark, [[3], [3]])          # P_e = 1 -> undefined
    assert V.fleiss_kappa(one_label).collect()[0].kappa is None
    two_raters = _long_votes(spark, [[2, 0], [1, 1]])    # source computes it only for > 2 raters
    assert V.fleiss_kappa(two_raters).collect()[0].kappa is None


VOTES = [("a_1", "deepseek", 1, "TOXIC"), ("a_1", "mistral", 2, "TOXIC"), ("a_1", "qwen", 3, "TOXIC"),
         ("a_2", "deepseek", 1, "TOXIC"), ("a_2", "mistral", 2, "NON-TOXIC"), ("a_2", "qwen", 3, "NON-TOXIC"),
         ("b_3", "deepseek", 1, "IMPLICIT"), ("b_3", "mistral", 2, "EXPLICIT"), ("b_3", "qwen", 3, "REPORT"),
         ("b_4", "deepseek", 1, "NON-TOXIC"), ("b_4", "qwen", 3, "NON-TOXIC")]


@pytest.fixture()
def votes_df(spark):
    return spark.createDataFrame(VOTES, "id STRING, annotator STRING, rnk INT, label STRING")


def test_lanes_and_majority(spark, votes_df):
    assert rows(V.unanimous_votes(votes_df)) == [("a_1", "TOXIC")]
    # mistral never voted on b_4
    assert rows(V.incomplete_votes(votes_df)) == [("b_4", "NON-TOXIC", None, "NON-TOXIC")]
    assert rows(V.disputed_votes(votes_df), "id", "deepseek", "mistral", "qwen") == [
        ("a_2", "TOXIC", "NON-TOXIC", "NON-TOXIC"), ("b_3", "IMPLICIT", "EXPLICIT", "REPORT")]
    # 1-1-1 tie -> first annotator (deepseek)
    assert rows(V.majority_vote(votes_df)) == [
        ("a_1", "TOXIC"), ("a_2", "NON-TOXIC"), ("b_3", "IMPLICIT"), ("b_4", "NON-TOXIC")]


def test_completeness_and_domain(spark, votes_df):
    assert rows(V.vote_completeness(votes_df)) == [("b_4", 2, "mistral")]
    bad = spark.createDataFrame([("x", "h1", "REPORTED"), ("y", "h1", "UNSURE"), ("z", "h2", None)],
                                "id STRING, annotator STRING, label STRING")
    got = rows(V.label_domain_violations(bad, "label", ("IMPLICIT", "EXPLICIT", "REPORT")))
    assert got == [("h1", "y", "UNSURE"), ("h2", "z", None)]  # REPORTED is an alias, not a violation
    with pytest.raises(Exception):
        V.label_domain_violations(bad, "label", ("IMPLICIT",), strict=True).collect()


def test_disagreement_and_consensus(spark, votes_df):
    info = spark.createDataFrame([(i, f"text {i}", i.split("_")[0]) for i in ("a_1", "a_2", "b_3", "b_4")],
                                 "id STRING, text STRING, category STRING")
    rep = V.disagreement_report(votes_df, info)
    assert set(rep.columns) >= {"deepseek_label", "note", "final"}
    assert rows(V.disagreement_by_category(rep)) == [("a", 1), ("b", 1)]
    share = {r.scope: (r.n_total, r.n_different) for r in V.disagreement_share(rep, info).collect()}
    assert share == {"all": (4, 2), "a": (2, 1), "b": (2, 1)}
    cons = V.consensus_labels(votes_df, info, "toxicity")
    assert rows(cons, "id", "toxicity") == [("a_1", "TOXIC"), ("a_2", ""), ("b_3", ""), ("b_4", "")]
    human = spark.createDataFrame([("a_2", "TOXIC"), ("b_3", "")], "id STRING, final STRING")
    model = spark.createDataFrame([("a_2", "NON-TOXIC"), ("b_3", "EXPLICIT")], "id STRING, label STRING")
    hf = rows(V.consensus_resolve(cons, human, model, "toxicity"), "id", "toxicity")
    assert hf == [("a_1", "TOXIC"), ("a_2", "TOXIC"), ("b_3", "EXPLICIT"), ("b_4", None)]
    lit = rows(V.consensus_resolve(cons, human, model, "toxicity", policy="reference"), "id", "toxicity")
    assert lit == [("a_1", "TOXIC"), ("a_2", "NON-TOXIC"), ("b_3", ""), ("b_4", None)]


def test_enrich_left_default_keeps_missing_kinds_apart(spark):
    target = spark.createDataFrame([(1,), (2,), (3,)], "id INT")
    source = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (2, None, 0)], "id INT, f STRING, o INT")
    out = rows(joins.enrich_left_default(target, source, "id", ["f"], "o"), "id", "f")
    assert out == [(1, "y"), (2, None), (3, "None")]  # last wins; null kept; unmatched -> 'None'


def test_parse_reply_lanes(spark):
    df = spark.createDataFrame([("1", '{"label": "TOXIC", "reason": "r"}'), ("2", "TOXIC"),
                                ("3", '{"label": "TOXIC", "reason": ')], "id STRING, raw STRING")
    assert rows(V.parse_reply(df), "id", "label", "lane") == [
        ("1", "TOXIC", "ok"), ("2", None, "error"), ("3", None, "error")]


def test_lanes_partition_the_ids(spark):
    three = [("deepseek", 1), ("mistral", 2), ("qwen", 3)]
    labels = {"same": "TTT", "split": "TNT", "null": "TT-", "all_null": "---", "one": "T", "twice": "TTTT"}
    data = [(i, *three[k % 3], None if c == "-" else c) for i, cs in labels.items() for k, c in enumerate(cs)]
    v = spark.createDataFrame(data, "id STRING, annotator STRING, rnk INT, label STRING")
    lanes = dict(rows(V.vote_summary(v), "id", "lane"))
    assert lanes == {"same": "similar", "split": "different", "null": "incomplete", "all_null": "incomplete",
                     "one": "incomplete", "twice": "incomplete"}
    parts = [{r.id for r in f(v).collect()} for f in (V.unanimous_votes, V.disputed_votes, V.incomplete_votes)]
    assert sum(map(len, parts)) == len(set().union(*parts)) == len(labels)


def test_strict_domain_check_fails_under_count(spark):
    bad = spark.createDataFrame([("x", "h1", "WRONG")], "id STRING, annotator STRING, label STRING")
    with pytest.raises(Exception):
        V.label_domain_violations(bad, "label", ("RIGHT",), strict=True).count()


def test_overwrite_keeps_one_row_per_target(spark):
    target = spark.createDataFrame([("a", "x"), ("b", "y")], "id STRING, label STRING")
    updates = spark.createDataFrame([("a", "1", 1), ("a", "0", 2)], "id STRING, v STRING, at INT")
    assert rows(joins.overwrite_by_key(target, updates, "id", "v", "label", order="at")) == [("a", "0"), ("b", "y")]


def test_newline_inside_a_reason_is_kept(spark):
    df = spark.createDataFrame([(1, '{"label": "TOXIC", "reason": "first\nsecond"}'), (2, "no json")], "id INT, raw STRING")
    assert rows(V.parse_reply(df), "id", "label", "reason", "lane") == [
        (1, "TOXIC", "first\nsecond", "ok"), (2, None, None, "error")]
