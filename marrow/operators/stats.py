"""Corpus reports (G10-G16, W4): grouped aggregates, never collected.

Every report is a grouped aggregate with map-side partial aggregation; the
only global sort-free structures are exact percentiles, whose state is one
counter per distinct length (bounded by the longest text, not by row count).
Averages are returned unrounded (C19): Python, Spark and DuckDB round halves
differently, so rounding belongs to presentation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.functions import text as tx

SPLITS = ("train", "dev", "test")


def _token_profile(df: DataFrame, split: str, text: str, letters_only: bool) -> DataFrame:
    """One scan, one explode: per split, rows, summed lengths and distinct tokens.

    Rows are exploded into (position, token) with ``posexplode_outer`` (a row
    without tokens yields one null token); the row's character length and
    token count ride on its first element only (the token count is the sum of
    token occurrences).  The first aggregate (by
    split, token) removes repeated tokens map-side; the second (by split)
    counts distinct tokens and sums the row values.  No second pass over the
    text and no join.
    """
    # The length is projected before the explode, so the generator does not have
    # to carry the text along with every token row.
    rows = df.select(split, F.length(text).cast("long").alias("_len"), tx.ws_tokens(text).alias("_toks"))
    e = (rows.select(split, "_len", F.posexplode_outer("_toks").alias("_p", "tok"))
             .withColumn("_first", F.coalesce(F.col("_p"), F.lit(0)) == 0))
    per_tok = e.groupBy(split, "tok").agg(
        F.count_if("_first").alias("_rows"),
        F.sum(F.when(F.col("_first"), F.col("_len"))).alias("_chars"),
        F.count("tok").alias("_occ"))
    counted = (F.col("tok").isNotNull() & tx.has_letter("tok")) if letters_only else F.col("tok").isNotNull()
    return per_tok.groupBy(split).agg(
        F.sum("_rows").cast("long").alias("n_comments"),
        F.count_if(counted).cast("long").alias("vocab_size"),
        F.sum("_chars").alias("_chars"), F.sum("_occ").alias("_ntok"))


def corpus_stats_chars(df: DataFrame, split: str = "split", text: str = "text") -> DataFrame:
    """Rows, distinct tokens having a letter, mean character length per split."""
    p = _token_profile(df, split, text, True)
    return p.select(split, "n_comments", "vocab_size",
                    (F.col("_chars").cast("double") / F.col("n_comments").cast("double")).alias("avg_length"))


def corpus_stats_tokens(df: DataFrame, split: str = "split", text: str = "text") -> DataFrame:
    """Rows, distinct tokens, mean token count per split."""
    p = _token_profile(df, split, text, False)
    return p.select(split, "n_comments", "vocab_size",
                    (F.col("_ntok").cast("double") / F.col("n_comments").cast("double")).alias("avg_tokens"))


def token_lengths(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("n_tokens", F.size(tx.ws_tokens(text)).cast("long"))


def length_histogram(df: DataFrame, split: str = "split", text: str = "text") -> DataFrame:
    """(split, n_tokens, freq): one scan; its size is bounded by the distinct lengths."""
    return token_lengths(df, text).groupBy(split, "n_tokens").agg(F.count(F.lit(1)).alias("freq"))


def length_distribution(df: DataFrame, split: str = "split", text: str = "text") -> DataFrame:
    """Min, quartiles (linear interpolation) and max of token counts, truncated to int.

    Exact percentiles are taken over the length histogram with frequencies.
    """
    h = length_histogram(df, split, text)
    n = F.col("n_tokens")
    q = F.percentile(n, [0.25, 0.5, 0.75], F.col("freq"))
    agg = h.groupBy(split).agg(F.min(n).alias("mn"), q.alias("q"), F.max(n).alias("mx"))
    return agg.select(split, F.col("mn").cast("long").alias("min_len"),
                      F.get("q", 0).cast("long").alias("p25_len"),
                      F.get("q", 1).cast("long").alias("median_len"),
                      F.get("q", 2).cast("long").alias("p75_len"),
                      F.col("mx").cast("long").alias("max_len"))


def length_whiskers(df: DataFrame, split: str = "split", text: str = "text", k: float = 1.5) -> DataFrame:
    """Boxplot numbers: quartiles, whiskers at k*IQR (most extreme data inside), outliers.

    Everything after the single scan runs on the length histogram.
    """
    h = length_histogram(df, split, text)
    quart = h.groupBy(split).agg(F.percentile("n_tokens", [0.25, 0.5, 0.75], F.col("freq")).alias("q"))
    quart = quart.select(split, F.get("q", 0).alias("q1"), F.get("q", 1).alias("median"),
                         F.get("q", 2).alias("q3"))
    lo = F.col("q1") - F.lit(k) * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + F.lit(k) * (F.col("q3") - F.col("q1"))
    # one row per split meets the histogram; how is left to measured sizes
    j = h.join(quart, split)
    inside = (F.col("n_tokens") >= lo) & (F.col("n_tokens") <= hi)
    return j.groupBy(split, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("n_tokens"))).cast("long").alias("lo_whisker"),
        F.max(F.when(inside, F.col("n_tokens"))).cast("long").alias("hi_whisker"),
        F.coalesce(F.sum(F.when(~inside, F.col("freq"))), F.lit(0)).cast("long").alias("n_outliers"))


def longest_comment(df: DataFrame, split: str = "split", text: str = "text",
                    pos: str = "pos") -> DataFrame:
    """Per split, the first (lowest pos) comment with the most tokens."""
    lens = token_lengths(df, text)
    best = F.max_by(F.col(pos), F.struct(F.col("n_tokens"), -F.col(pos)))
    return lens.groupBy(split).agg(best.alias(pos), F.max("n_tokens").alias("n_tokens"))


def category_split_cube(df: DataFrame, category: str = "category", split: str = "split") -> DataFrame:
    """G14 (grouping sets): counts for every (category, split), each margin and the total."""
    return df.cube(category, split).agg(F.count(F.lit(1)).cast("long").alias("n"))


def category_split_crosstab(df: DataFrame, category: str = "category", split: str = "split",
                            splits=SPLITS) -> DataFrame:
    """G14 (table form): one row per category plus 'Total'; one column per split plus 'total'."""
    # Conditional counts under ROLLUP: one aggregate gives rows and the total row.
    cols = [F.count_if(F.col(split) == s).cast("long").alias(s) for s in splits]
    piv = df.rollup(category).agg(*cols)
    total = sum((F.col(s) for s in splits), F.lit(0)).cast("long").alias("total")
    return piv.select(F.coalesce(F.col(category), F.lit("Total")).alias(category),
                      *[F.col(s) for s in splits], total)


def category_share(df: DataFrame, category: str = "category") -> DataFrame:
    """Each category's share of all rows, in percent (unrounded)."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).cast("long").alias("n"))
    # The total is a scalar subquery (one value), so no task has to hold all categories.
    total = counts.select(F.sum("n")).scalar()
    share = F.col("n") * F.lit(100.0) / total
    return counts.select(category, "n", share.cast("double").alias("share_pct"))


def stage_funnel(stages: dict[str, DataFrame], key: str = "category") -> DataFrame:
    """Rows per key at every stage, one column ``n_<stage>`` each (0 when absent).

    All stages are unioned and pivoted, so there is one aggregate for all of them.
    """
    names = list(stages)
    parts = [d.select(F.col(key), F.lit(name).alias("_stage")) for name, d in stages.items()]
    allrows = parts[0]
    for p in parts[1:]:
        allrows = allrows.unionByName(p)
    piv = allrows.groupBy(key).pivot("_stage", names).agg(F.count(F.lit(1)))
    return piv.select(key, *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(f"n_{n}") for n in names])
