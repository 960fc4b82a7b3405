"""Scalar text functions: Spark regexes must behave like the source's Python ``re``."""
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from marrow.functions import text as tx
from marrow.operators import clean

# Python-side definitions of the source behaviour, used as the brute-force oracle.
PY_HASHTAG = re.compile(r"#\S*")
PY_URL = re.compile(r"https?://\S+|www\.\S+|!\[img\]\([^)]+\)|\[photo\]")
PY_MENTION = re.compile(r"@(\S+)")

EDGE = [
    "lone # and lone @ here", "#tag#tag2 x", "@alice said hi @", "a\u00a0b\u2003c\u3000d",
    "tab\there\nnew\x1cline\x85end", "see https://a.b/c?d=e [photo] and www.x.y", "![img](emote|t5|123) ok",
    "http://x.y/[photo]z", "中文 한국어 ｆｕｌｌ", "", "   ", "Ünïcödé ÀÉÎ", " para graph",
]

text_chars = st.sampled_from(list("ab #@/:.[]()!_ \t\n\u00a0\u2003\u3000\x0b\x1c\x85\u2028xyz") + ["http://", "www.", "[photo]"])
texts = st.lists(text_chars, max_size=30).map("".join)


def _apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, t STRING")
    out = df.select("i", fn(F.col("t")).alias("o")).collect()
    return [r.o for r in sorted(out, key=lambda r: r.i)]


def test_edge_rows_match_python(spark):
    assert _apply(spark, EDGE, tx.remove_hashtags) == [PY_HASHTAG.sub("", s) for s in EDGE]
    assert _apply(spark, EDGE, tx.remove_urls) == [PY_URL.sub("", s) for s in EDGE]
    assert _apply(spark, EDGE, tx.clean_whitespace) == [re.sub(r"\s+", " ", s).strip() for s in EDGE]
    assert _apply(spark, EDGE, tx.unmark_mentions) == [PY_MENTION.sub(r"\1", s) for s in EDGE]
    assert _apply(spark, EDGE, tx.to_lowercase) == [s.lower() for s in EDGE]
    assert _apply(spark, EDGE, tx.strip_ws) == [s.strip() for s in EDGE]


@settings(max_examples=25, deadline=None)
@given(st.lists(texts, min_size=1, max_size=20))
def test_random_strings_match_python(spark, values):
    assert _apply(spark, values, tx.remove_hashtags) == [PY_HASHTAG.sub("", s) for s in values]
    assert _apply(spark, values, tx.remove_urls) == [PY_URL.sub("", s) for s in values]
    assert _apply(spark, values, tx.clean_whitespace) == [re.sub(r"\s+", " ", s).strip() for s in values]
    assert _apply(spark, values, lambda c: F.size(tx.ws_tokens(c))) == [len(s.split()) for s in values]


def test_emoji_class_equals_source_ranges(spark):
    # The 17 emoji code-point ranges of the source, in their order; the
    # reduced class must remove the same code points.
    ranges = [(0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F1E0, 0x1F1FF),
              (0x2500, 0x2BEF), (0x2702, 0x27B0), (0x24C2, 0x1F251), (0x1F926, 0x1F937),
              (0x10000, 0x10FFFF), (0x2640, 0x2642), (0x2600, 0x2B55), (0x200D, 0x200D),
              (0x23CF, 0x23CF), (0x23E9, 0x23E9), (0x231A, 0x231A), (0xFE0F, 0xFE0F), (0x3030, 0x3030)]
    py = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]+")
    probe = ["ok \U0001F602❤️ done", "中文 한국어", "a‍b", "⌚⏏⏩ x", "plain"]
    assert _apply(spark, probe, tx.remove_emoji) == [py.sub("", s) for s in probe]


def test_idempotent_cleaners(spark):
    once = _apply(spark, EDGE, clean.clean_text)
    assert _apply(spark, once, clean.clean_text) == once


def test_url_key_and_path(spark):
    links = ["https://www.youtube.com/watch?v=abc&t=1", "https://youtube.com/shorts/XYZ",
             "https://www.reddit.com/r/x/comments/1/t/", "no-equals"]
    assert _apply(spark, links, tx.url_key) == ["abc&t", "XYZ", None, None]
    assert _apply(spark, links[:3], tx.url_path) == ["/watch?v=abc&t=1", "/shorts/XYZ", "/r/x/comments/1/t/"]
    assert _apply(spark, ["x_1", "a_b_2", "nounderscore"], tx.id_prefix) == ["x", "a", "nounderscore"]


def test_json_extract(spark):
    replies = ['```json\n{"label": "TOXIC", "reason": "a } b"}\n```', 'no json', 'pre {"label": "X"} post']
    out = _apply(spark, replies, lambda c: F.from_json(tx.extract_json_object(c), "label STRING").label)
    assert out == ["TOXIC", None, "X"]
