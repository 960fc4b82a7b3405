"""Physical-plan properties that matter at scale (checked on the executed plan text)."""
import re

import __spark_entry__ as E
from tests.conftest import SF_SMALL

Q = E.queries()


def plan(spark, name):
    df = Q[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()  # run once so AQE shows the final plan
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text):
    return re.findall(r"ReadSchema: struct<([^>]*)>", text) or re.findall(r"struct<([^>]*)>", text)


def test_scan_prunes_columns(spark):
    df = Q["clean_chain"](spark, SF_SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    # documents has doc_id, text, lang, source, n_chars; only three are read
    assert "n_chars" not in text and "lang" not in text


def test_language_route_has_no_shuffle_of_tokens(spark):
    text = plan(spark, "language_route")
    assert "Generate" not in text            # no explode
    assert "hashpartitioning" not in text    # no keyed shuffle
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" not in text


def test_dedup_keys_are_narrow(spark):
    from marrow.operators import clean
    from marrow.sources import fixtures as fx
    docs = fx.documents(spark, SF_SMALL).select("pos", "category", "text")
    firsts = (docs.select("category", clean.text_key("text").alias("_h"), "pos")
                  .groupBy("category", "_h").count())
    agg = [line for line in firsts._jdf.queryExecution().optimizedPlan().toString().splitlines()
           if "Aggregate" in line]
    assert agg and all("text" not in line for line in agg)   # grouped on the hash, never the text
    out = clean.dedup_keep_first(docs, within=["category"])
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in text and "Aggregate" not in text     # the few rows to drop come from a written key table


def test_top_n_limits_groups_before_the_shuffle(spark):
    for name in ("stratified_sample", "limit_per_source", "repeated_samples", "user_items_normalise"):
        text = plan(spark, name)
        assert text.count("WindowGroupLimit") >= 2, name   # partial and final
        assert "MapIn" not in text


def test_fixed_size_sample_is_top_k(spark):
    text = plan(spark, "fixed_size_sample")
    assert "TakeOrderedAndProject" in text


def test_votes_reports_group_by_id_without_window(spark):
    for name in ("unanimous_votes", "disputed_votes", "majority_vote", "fleiss_kappa"):
        assert "Window" not in plan(spark, name)


def test_explodes_never_carry_text(spark):
    for name in ("corpus_stats_chars", "corpus_stats_tokens", "encode_tokens", "oov_rate",
                 "build_vocab", "pad_and_mask", "language_profile_score"):
        text = Q[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        for m in re.finditer(r"Generate \w+\(.*?\), \[([^\]]*)\]", text):
            assert not re.search(r"\b(text|html)#", m.group(1)), (name, m.group(1))
