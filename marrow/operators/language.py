"""Language routing.

The default detector is a stop-word profile scored in SQL: a profile given as
a dict is scored by array expressions in every row (no shuffle); a profile
table is joined with the words of the distinct texts.
The best language wins (ties by language name).  Rows without a single hit are
"undetectable" and get their own lane instead of vanishing.  Any
``pandas_udf`` can replace the detector, and a second-opinion function can
be plugged in for rows detected as another language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.functions import text as tx
from marrow.functions.arrow import stretches
from marrow.session import checkpoint_dir

# Stop-word profile (language -> words).
DEFAULT_PROFILE = {
    "de": ("der", "die", "und", "den"),
    "en": ("the", "of", "and", "to"),
    "es": ("el", "y", "los", "del"),
    "fr": ("le", "les", "et", "des"),
}


def profile_table(spark: SparkSession, profile: dict[str, tuple[str, ...]] = DEFAULT_PROFILE) -> DataFrame:
    rows = [(lang, w) for lang, words in sorted(profile.items()) for w in words]
    return spark.createDataFrame(rows, "lang STRING, word STRING")


def profile_scores(df: DataFrame, key: str, text: str = "text",
                   profile: dict[str, tuple[str, ...]] | DataFrame | None = None) -> DataFrame:
    """Per row: best language by profile hits, and its score; null when no hit.

    The score of a language is the number of tokens in its set of words; the
    best is the minimum of (-score, language), so ties go to the language
    name.  A profile given as a dict (the default) is scored per row by array
    expressions, without explode, join or shuffle.  A profile given as a table
    is reduced to distinct (language, word) and joined with the words of every
    distinct text; a score depends on the text alone, so rows that share a key
    or a text are scored each, with the same result as by a dict.
    """
    prof = DEFAULT_PROFILE if profile is None else profile
    toks = tx.ws_tokens(F.lower(F.col(text)))
    if isinstance(prof, dict):
        def in_words(ws):
            return lambda t: t.isin(*ws)

        per_lang = [F.struct((-F.size(F.filter(F.col("_toks"), in_words(tuple(ws))))).alias("ns"),
                             F.lit(lang).alias("lang"))
                    for lang, ws in sorted(prof.items())]
        # the few tokens of the profile and the best (score, language) are projected once each, then reused
        words = sorted({w for ws in prof.values() for w in ws})
        best = (df.withColumn("_toks", F.filter(toks, in_words(tuple(words))))
                  .withColumn("_best", F.array_min(F.array(*per_lang)))
                  .drop("_toks"))
        hit = F.col("_best.ns") < 0
        return (best.withColumn("detected", F.when(hit, F.col("_best.lang")))
                    .withColumn("score", F.when(hit, -F.col("_best.ns")).cast("long")).drop("_best"))
    words = df.select(F.sha2(F.col(text), 256).alias("_h"), toks.alias("_toks")).dropDuplicates(["_h"])
    # words of a text are counted before they meet the profile, so a frequent word is one row per text
    words = words.select("_h", F.explode("_toks").alias("word")).groupBy("_h", "word").agg(F.count(F.lit(1)).alias("_n"))
    hits = words.join(prof.select("lang", "word").distinct(), "word").groupBy("_h", "lang").agg(F.sum("_n").alias("_s"))
    best = hits.groupBy("_h").agg(
        F.min_by(F.col("lang"), F.struct(-F.col("_s"), F.col("lang"))).alias("detected"),
        F.max("_s").cast("long").alias("score"))
    return df.withColumn("_h", F.sha2(F.col(text), 256)).join(best, "_h", "left").drop("_h")


def route_by_language(df: DataFrame, key: str, target: str, text: str = "text",
                      detector: Callable | None = None) -> DataFrame:
    """Lane 'accepted' (target), 'second_opinion' (other) or 'undetectable'.

    ``detector`` may be a ``pandas_udf`` returning a language code (or null
    when it cannot tell); by default the SQL profile detector is used.
    """
    if detector is None:
        scored = profile_scores(df, key, text)
    else:
        scored = df.withColumn("detected", detector(F.col(text))).withColumn("score", F.lit(None).cast("long"))
    lane = (F.when(F.col("detected").isNull(), "undetectable")
             .when(F.col("detected") == target, "accepted")
             .otherwise("second_opinion"))
    return scored.withColumn("lane", lane)


def second_opinion(df: DataFrame, judge: Callable[[pd.Series], pd.Series], text: str = "text",
                   lane_col: str = "lane") -> DataFrame:
    """Rows in lane 'second_opinion' are judged in Arrow batches.

    ``judge(texts) -> replies``; an empty reply accepts the row (lane
    'accepted_second'), anything else rejects it ('rejected').  Only the rows
    that need a second opinion send their text through Python; both outcomes
    are kept, so accepted and rejected rows stay auditable.  The table is read
    once: the other rows pass beside the judge, and no filter on the lane is
    pushed below what computed it.
    """

    @F.pandas_udf(T.StringType())
    def judged(asked: pd.Series, texts: pd.Series) -> pd.Series:
        lanes = pd.Series([None] * len(asked), dtype=object)
        todo = asked.to_numpy(dtype=bool)
        if todo.any():
            replies = pd.Series(judge(texts[todo].reset_index(drop=True))).astype("string")
            lanes[todo] = replies.fillna("x").eq("").map({True: "accepted_second", False: "rejected"}).to_numpy(dtype=object)
        return lanes

    asked = F.coalesce(F.col(lane_col) == "second_opinion", F.lit(False))
    out = df.withColumn("_asked", asked)
    out = out.withColumn("_judged", judged("_asked", F.when(F.col("_asked"), F.col(text))))
    return out.withColumn(lane_col, F.when(F.col("_asked"), F.col("_judged")).otherwise(F.col(lane_col))).drop("_asked", "_judged")


def accepted(df: DataFrame, lane_col: str = "lane") -> DataFrame:
    """The union of accepted rows (first pass and second opinion)."""
    return df.where(F.col(lane_col).isin("accepted", "accepted_second"))


# ---------------------------------------------------------------------------
# A detector learned from labelled rows: naive Bayes over character n-grams.
# ---------------------------------------------------------------------------
#: size of a profile, and how many thousandths per n-gram the best language must lead by
PROFILE_GRAMS, REJECT_BELOW = 2000, 40
MAX_LANGUAGES = 500


#: what separates words (``tx.WS``), and the bytes of text that are counted at once in a task
_IS_SPACE = np.zeros(0x3002, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
CHUNK_BYTES = 1 << 19
_BITS = 21  # of a code point


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, grams, row) of bounded stretches of the non-null texts of a batch: the trigrams of all
    words, each word between two spaces, as numbers, and the row of each, ascending.

    Every character of a word is the middle of one trigram, whose neighbours are characters or spaces."""
    for at, to in stretches(texts, CHUNK_BYTES):
        rows = [t or "" for t in texts.slice(at, to - at).to_pylist()]
        c = np.frombuffer((" " + " ".join(rows) + " ").encode("utf-32-le"), np.uint32).astype(np.int64)
        c[_IS_SPACE[np.minimum(c, 0x3001)]] = 32
        word = c[1:-1] != 32
        row = np.repeat(np.arange(to - at), [len(t) + 1 for t in rows])  # with the space after each row
        grams = (c[:-2] << 2 * _BITS) | (c[1:-1] << _BITS) | c[2:]
        yield at, to, grams[word], row[:-1][word]


def _gram(code: int) -> str:
    return "".join(chr(code >> k * _BITS & (1 << _BITS) - 1) for k in (2, 1, 0))


def _gram_counts(df: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, gram, n): the trigrams of all words of a language's rows, counted in the tasks by bounded
    stretches of text and then added up by Spark."""

    def counted(batches):
        for batch in batches:
            langs, texts = batch.column(0).dictionary_encode(), batch.column(1)
            code = langs.indices.to_numpy(zero_copy_only=False)
            for at, _, grams, row in _chunks(texts):
                of = code[at:][row]
                for x in np.unique(of):
                    found, n = np.unique(grams[of == x], return_counts=True)
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([langs.dictionary[int(x)].as_py()] * len(found), pa.string()),
                        "gram": pa.array([_gram(g) for g in found.tolist()], pa.string()), "n": pa.array(n.astype(np.int64))})

    rows = df.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string"), F.lower(F.col(text)))
    return rows.mapInArrow(counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train_profile(df: DataFrame, lang: str = "lang", text: str = "text", grams: int = PROFILE_GRAMS) -> tuple[DataFrame, list[str]]:
    """(profile, languages): per n-gram one weight for each language, 1000 times the logarithm of its
    smoothed share there, rounded down.

    All labelled rows count; the profile keeps the ``grams`` most frequent n-grams, which bounds it
    whatever the corpus.  It is checkpointed."""
    checkpoint_dir(df.sparkSession)
    counts = _gram_counts(df, lang, text).checkpoint()
    langs = sorted(r.lang for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in {lang!r}")
    top = counts.groupBy("gram").agg(F.sum("n").alias("_n"), *[
        F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"c{i}") for i, x in enumerate(langs)])
    top = top.orderBy(F.desc("_n"), "gram").limit(grams).checkpoint()
    # one row: the grams of the profile and, per language, their occurrences
    sums = top.agg(F.count(F.lit(1)).alias("m"), *[F.sum(f"c{i}").alias(f"t{i}") for i in range(len(langs))])
    weights = [F.floor(F.lit(1000.0) * F.log((F.col(f"c{i}") + 1).cast("double") / (F.col(f"t{i}") + F.col("m")).cast("double")))
               .cast("long").alias(f"w{i}") for i in range(len(langs))]
    return top.crossJoin(F.broadcast(sums)).select("gram", *weights).checkpoint(), langs


def detect_language(df: DataFrame, profile: DataFrame, langs: list[str], key: str, text: str = "text",
                    reject: int = REJECT_BELOW) -> DataFrame:
    """``df`` + (detected, margin, n_grams): the language of the highest weight over a row's n-grams.

    ``key`` is unique.  The profile goes to every task (its size is a parameter) and weights are whole
    numbers, added up per row in Arrow batches before the one shuffle.  Rows without an n-gram of the profile, and
    those whose best language leads by less than ``reject`` thousandths per n-gram, have null."""
    known = sorted((sum(ord(c) << k * _BITS for c, k in zip(r.gram, (2, 1, 0))), *r[1:]) for r in profile.select(
        "gram", *[f"w{i}" for i in range(len(langs))]).collect())
    codes = np.array([r[0] for r in known], np.int64)
    weights = np.array([r[1:] for r in known], np.int64).reshape(len(known), len(langs))
    names = ["n_grams", *[f"s{i}" for i in range(len(langs))]]

    def scored(batches):
        for batch in batches:
            sums = np.zeros((len(names), batch.num_rows), np.int64)
            for at, to, grams, row in _chunks(batch.column(1)) if len(codes) else ():
                place = np.minimum(np.searchsorted(codes, grams), len(codes) - 1)
                hit = codes[place] == grams
                place, bounds = place[hit], np.searchsorted(row[hit], np.arange(to - at + 1))
                sums[0, at:to] = np.diff(bounds)
                for i in range(len(langs)):
                    sums[i + 1, at:to] = np.diff(np.concatenate(([0], np.cumsum(weights[place, i])))[bounds])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in sums]], names=["_key", *names])

    rows = df.select(F.col(key).alias("_key"), F.lower(F.col(text)))
    hits = rows.mapInArrow(scored, T.StructType([rows.schema["_key"], *[T.StructField(x, T.LongType()) for x in names]])).where(
        "n_grams > 0").groupBy("_key").agg(*[F.sum(x).alias(x) for x in names])
    order = F.array_sort(F.array(*[F.struct((-F.col(f"s{i}")).alias("s"), F.lit(x).alias("lang")) for i, x in enumerate(langs)]))
    lead = F.coalesce(F.get("_o", 1)["s"] - F.get("_o", 0)["s"], F.lit(1 << 60).cast("long"))
    best = hits.withColumn("_o", order).select(
        "_key", "n_grams", lead.cast("long").alias("margin"),
        F.when(lead >= reject * F.col("n_grams"), F.get("_o", 0)["lang"]).alias("detected"))
    return df.join(best, F.col(key) == F.col("_key"), "left").drop("_key").withColumn("n_grams", F.coalesce("n_grams", F.lit(0)))
