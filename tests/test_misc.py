"""Small helpers: vote-column drop, undecided predicate, vocab inversion, per-file samples,
row shuffle, second opinion lanes."""
import pandas as pd

from pyspark.sql import functions as F

from marrow.operators import encode, language, sampling, votes as V
from tests.conftest import rows


def test_drop_vote_columns_and_undecided(spark):
    df = spark.createDataFrame([("1", "T", "N", "T", "r", "T", "")],
                               "id STRING, deepseek STRING, mistral STRING, qwen STRING, "
                               "deepseek_reason STRING, label STRING, toxicity STRING")
    assert V.drop_vote_columns(df).columns == ["id", "label", "toxicity"]
    assert df.where(V.undecided("toxicity")).count() == 1


def test_invert_vocab(spark):
    vocab = spark.createDataFrame([("<pad>", 0), ("a", 1)], "word STRING, idx BIGINT")
    assert rows(encode.invert_vocab(vocab)) == [(0, "<pad>"), (1, "a")]


def test_sample_per_file_and_shuffle(spark):
    df = spark.createDataFrame([(i, f"f{i % 3}") for i in range(30)], "id INT, file STRING")
    s = sampling.sample_per_file(df, "id", 4)
    assert rows(s.groupBy("file").count()) == [("f0", 4), ("f1", 4), ("f2", 4)]
    shuffled = [r.id for r in sampling.shuffle_rows(df, 3).collect()]
    assert sorted(shuffled) == list(range(30)) and shuffled != list(range(30))


def test_second_opinion_lanes(spark):
    df = spark.createDataFrame([(1, "the cat", "accepted"), (2, "der hund", "second_opinion"),
                                (3, "xin chao", "second_opinion"), (4, "???", "undetectable")],
                               "doc_id INT, text STRING, lane STRING")

    def judge(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "" if "xin" in t else "None")

    out = language.second_opinion(df, judge)
    assert rows(out, "doc_id", "lane") == [(1, "accepted"), (2, "rejected"), (3, "accepted_second"),
                                          (4, "undetectable")]
    assert rows(language.accepted(out), "doc_id") == [(1,), (3,)]


def test_second_opinion_asks_only_the_rows_in_doubt_and_reads_once(spark):
    df = spark.range(40).select("id", F.when(F.col("id") % 4 == 0, "second_opinion").when(F.col("id") % 4 == 1, "accepted").alias("lane"),
                                F.when(F.col("id") != 8, F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))

    def judge(texts: pd.Series) -> pd.Series:
        assert len(texts) and all(t is None or int(t[1:]) % 4 == 0 for t in texts)
        return texts.map(lambda t: None if t is None else "" if int(t[1:]) % 8 == 0 else "None")

    out = language.second_opinion(df, judge)
    assert out.columns == df.columns
    assert {r.id: r.lane for r in out.collect()} == {
        i: "accepted" if i % 4 == 1 else None if i % 4 else "accepted_second" if i % 8 == 0 and i != 8 else "rejected" for i in range(40)}
    plan = out.groupBy("lane").count()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1 and "Union" not in plan


def test_profile_as_table_equals_profile_as_dict(spark):
    from marrow.operators import language as L
    profile = {"fr": ("le", "la"), "it": ("la", "il"), "en": ("the",)}
    table = spark.createDataFrame([(k, w) for k, ws in profile.items() for w in ws] * 2, "lang STRING, word STRING")
    df = spark.createDataFrame([(1, "le la le LA x"), (1, "il il la"), (2, None), (3, ""), (3, "the the"), (4, "la"), (4, "la")],
                               "id INT, text STRING")
    got = [sorted(str((r.id, r.detected, r.score)) for r in L.profile_scores(df, "id", profile=p).collect()) for p in (profile, table)]
    a = [(r.id, r.detected, r.score) for r in L.profile_scores(df, "id", profile=profile).collect()]
    assert got[0] == got[1]
    assert (1, "fr", 4) in a and (1, "it", 3) in a


def test_global_dedup_needs_unique_positions(spark):
    import pytest
    from marrow.operators import clean
    from tests.conftest import rows
    df = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x"), (None, 0, "x"), (None, 1, "x")],
                               "category STRING, pos INT, text STRING")
    with pytest.raises(ValueError):
        clean.dedup_keep_first(df)
    assert clean.dedup_keep_first(df, within=["category"]).count() == 4  # the null category is one too
    chain = clean.clean_chain(df)
    assert sorted(r.id for r in chain.collect()) == ["_0", "a_0", "a_1", "b_0"]


def test_shuffled_is_a_permutation_whatever_the_partitions(spark):
    from marrow.operators.sampling import shuffled

    for n in (1, 2, 3, 7, 10, 99, 1000):
        df = spark.range(n).select((F.col("id") * 3).alias("k"), F.lit(n).alias("n"))
        one = {r.k: r.place for r in shuffled(df, "k", seed=5).collect()}
        assert sorted(one.values()) == list(range(n))
        other = {r.k: r.place for r in shuffled(df.repartition(5, F.xxhash64("k")), "k", seed=5).collect()}
        assert one == other
    next_epoch = {r.k: r.place for r in shuffled(df, "k", seed=5, epoch=1).collect()}
    assert sorted(next_epoch.values()) == list(range(n)) and next_epoch != one
    moved = sum(abs(p - k // 3) for k, p in one.items()) / n
    assert n / 4 < moved < n / 2  # a random permutation moves a row by a third of n
    assert shuffled(df.limit(0), "k").count() == 0


def test_heavy_words_do_not_make_a_hot_task(spark):
    from marrow.operators import encode

    docs = spark.range(3000).select("id", F.concat(F.lit("the of the "), F.concat_ws(" ", F.transform(
        F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("w"), ((F.col("id") * 10 + i) % 20000).cast("string"))))).alias("text"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    vocab = encode.build_vocab(docs.where("id % 2 = 0")).checkpoint()
    ids = {r.word: r.idx for r in vocab.collect()}
    try:
        for threshold in ("-1", "10485760"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            got = {r.id: r.input_ids for r in encode.encode_tokens(docs, vocab, "id").collect()}
            assert got == {r.id: [ids.get(w, ids["<unk>"]) for w in r.text.split(" ")] for r in docs.collect()}
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        words = docs.select(F.explode(F.split("text", " ")).alias("word"))
        heavy = {r.word for r in encode.heavy_words(words, limit=8, counters=64).collect()}
        assert {"the", "of"} <= heavy and len(heavy) <= 8
        rare = words.where(~F.col("word").isin(*heavy)).groupBy("word").count().agg(F.max("count")).first()[0]
        assert rare < 10  # no other word is frequent, so no key of the shuffle is
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert encode.encode_tokens(docs.limit(0), vocab, "id").count() == 0


def test_trained_language_detector(spark):
    from marrow.operators import language as L

    rows = [("en", "the cat sat on the mat and the dog"), ("de", "der hund und die katze auf der matte"),
            ("fr", "le chat est sur le tapis et le chien")] * 5
    train = spark.createDataFrame(rows, "lang STRING, text STRING")
    profile, langs = L.train_profile(train, grams=200)
    assert langs == ["de", "en", "fr"] and profile.count() <= 200
    df = spark.createDataFrame([(1, "the mat and the cat"), (2, "die matte und der hund"), (3, ""), (4, None), (5, "12 99"), (6, "LE CHIEN")],
                               "k INT, text STRING")
    got = {r.k: r.detected for r in L.detect_language(df, profile, langs, "k").collect()}
    assert got == {1: "en", 2: "de", 3: None, 4: None, 5: None, 6: "fr"}


def test_trained_detector_equals_a_plain_count(spark, monkeypatch):
    import math
    import random
    from collections import Counter

    from marrow.operators import language as L

    rng = random.Random(3)
    words = ["the", "Der", "\U0001F600x", "\u00c9t\u00e9", "a", "und", "x" * 90, "z\u0130"]
    gaps = [" ", "\n", "\u00a0\u2003", "  ", "\x1c", "\x85", "\u3000"]
    texts = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", "   ", None]
    data = [(i % 55 if i % 9 else None, rng.choice(["de", "en", None]), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "k INT, lang STRING, text STRING").coalesce(2)
    monkeypatch.setattr(L, "CHUNK_BYTES", 300)  # many stretches in one batch

    def grams(t):
        return [g[i:i + 3] for w in (t or "").lower().split() for g in [f" {w} "] for i in range(len(w))]

    counts = Counter((lang, g) for _, lang, t in data if lang for g in grams(t))
    total = Counter()
    for (_, g), n in counts.items():
        total[g] += n
    top = sorted(total, key=lambda g: (-total[g], g.encode()))[:50]
    sums = {x: sum(counts[x, g] for g in top) for x in ("de", "en")}
    weight = {g: {x: math.floor(1000 * math.log((counts[x, g] + 1) / (sums[x] + len(top)))) for x in sums} for g in top}
    profile, langs = L.train_profile(df, grams=50)
    assert langs == ["de", "en"] and {r.gram: {"de": r.w0, "en": r.w1} for r in profile.collect()} == weight

    by_key = {}
    for k, _, t in data:
        by_key.setdefault(k, []).extend(g for g in grams(t) if g in weight)
    got = L.detect_language(df, profile, langs, "k").collect()
    assert len(got) == len(data)
    for r in got:
        found = by_key[r.k] if r.k is not None else []
        s = {x: sum(weight[g][x] for g in found) for x in langs}
        margin = abs(s["de"] - s["en"]) if found else None
        best = min(langs, key=lambda x: (-s[x], x))
        assert (r.n_grams, r.margin) == (len(found), margin)
        assert r.detected == (best if found and margin >= L.REJECT_BELOW * len(found) else None)


def test_subwords_equal_a_plain_search(spark):
    import random

    from marrow.operators import subword

    rng = random.Random(6)
    pieces = {"a", "b", "ab", "abc", "##a", "##b", "##bc", "##cab", "c", "##c", "é", "##é", "##", "##中"}
    vocab = {w: i for i, w in enumerate(["<pad>", "<unk>", "<s>", "</s>", *sorted(pieces)])}

    def plain(word):
        out, at = [], 0
        while at < len(word):
            best = max((n for n in range(1, len(word) - at + 1) if ("##" if at else "") + word[at:at + n] in vocab), default=0)
            if not best:
                return [1]
            out.append(vocab[("##" if at else "") + word[at:at + best]])
            at += best
        return out

    texts = ["".join(rng.choice("aabbcc é\n中x") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "x" * 500, "ab" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "k INT, text STRING").repartition(3)
    vf = spark.createDataFrame(list(vocab.items()), "word STRING, idx LONG")
    for frame in ({}, {"first": "<s>", "last": "</s>"}):
        got = {r.k: (r.input_ids, r.attention_mask) for r in subword.encode_subwords(df, vf, 12, **frame).collect()}
        for k, text in enumerate(texts):
            ids = [i for w in (text or "").split() for i in plain(w)][: 10 if frame else 12]
            ids = [2, *ids, 3] if frame else ids
            assert got[k] == (ids + [0] * (12 - len(ids)), [1] * len(ids) + [0] * (12 - len(ids))), text
    assert subword.encode_subwords(df.limit(0), vf, 12).count() == 0
