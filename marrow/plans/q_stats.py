"""Corpus reports on ``documents`` split by the md5 rule (FIXTURES A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marrow.operators import joins, stats
from marrow.plans import sqltext as S
from marrow.plans.fixtures_sql import SPLIT_DOCS
from marrow.plans.registry import register
from marrow.sources import fixtures as fx
from marrow.sources.tables import table

TOKS = S.ws_tokens("text")


def _split_docs(spark, sf_dir):
    return fx.documents_split(spark, sf_dir).select(
        F.col("doc_id").alias("pos"), F.col("source").alias("category"), "text", "split")


@register("corpus_stats_chars", operators=("G10", "F17", "U5"), sql=f"""
WITH {SPLIT_DOCS},
v AS (SELECT split, count(DISTINCT tok) AS vocab_size
      FROM (SELECT split, unnest({TOKS}) AS tok FROM sdocs) WHERE regexp_matches(tok, '\\p{{L}}')
      GROUP BY split)
SELECT s.split, CAST(count(*) AS BIGINT) AS n_comments,
       CAST(coalesce(any_value(v.vocab_size), 0) AS BIGINT) AS vocab_size,
       avg(CAST(length(s.text) AS DOUBLE)) AS avg_length
FROM sdocs s LEFT JOIN v USING (split) GROUP BY s.split
""")
def corpus_stats_chars(spark, sf_dir):
    return stats.corpus_stats_chars(_split_docs(spark, sf_dir))


@register("corpus_stats_tokens", operators=("G11", "U5", "C8"), sql=f"""
WITH {SPLIT_DOCS},
v AS (SELECT split, count(DISTINCT tok) AS vocab_size
      FROM (SELECT split, unnest({TOKS}) AS tok FROM sdocs) GROUP BY split)
SELECT s.split, CAST(count(*) AS BIGINT) AS n_comments,
       CAST(coalesce(any_value(v.vocab_size), 0) AS BIGINT) AS vocab_size,
       avg(CAST(len({S.ws_tokens('s.text')}) AS DOUBLE)) AS avg_tokens
FROM sdocs s LEFT JOIN v USING (split) GROUP BY s.split
""")
def corpus_stats_tokens(spark, sf_dir):
    return stats.corpus_stats_tokens(_split_docs(spark, sf_dir))


LENS = f"lens AS (SELECT split, doc_id, CAST(len({TOKS}) AS BIGINT) AS n FROM sdocs)"


@register("length_distribution", operators=("G12",), sql=f"""
WITH {SPLIT_DOCS}, {LENS}
SELECT split, CAST(min(n) AS BIGINT) AS min_len,
       CAST(trunc(quantile_cont(n, 0.25)) AS BIGINT) AS p25_len,
       CAST(trunc(quantile_cont(n, 0.5)) AS BIGINT) AS median_len,
       CAST(trunc(quantile_cont(n, 0.75)) AS BIGINT) AS p75_len,
       CAST(max(n) AS BIGINT) AS max_len
FROM lens GROUP BY split
""")
def length_distribution(spark, sf_dir):
    return stats.length_distribution(_split_docs(spark, sf_dir))


@register("length_whiskers", operators=("G13",), sql=f"""
WITH {SPLIT_DOCS}, {LENS},
q AS (SELECT split, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS median,
             quantile_cont(n, 0.75) AS q3 FROM lens GROUP BY split)
SELECT l.split, q.q1, q.median, q.q3,
  CAST(min(n) FILTER (WHERE n >= q1 - 1.5e0 * (q3 - q1) AND n <= q3 + 1.5e0 * (q3 - q1)) AS BIGINT) AS lo_whisker,
  CAST(max(n) FILTER (WHERE n >= q1 - 1.5e0 * (q3 - q1) AND n <= q3 + 1.5e0 * (q3 - q1)) AS BIGINT) AS hi_whisker,
  CAST(count(*) FILTER (WHERE NOT (n >= q1 - 1.5e0 * (q3 - q1) AND n <= q3 + 1.5e0 * (q3 - q1))) AS BIGINT) AS n_outliers
FROM lens l JOIN q USING (split) GROUP BY l.split, q.q1, q.median, q.q3
""")
def length_whiskers(spark, sf_dir):
    return stats.length_whiskers(_split_docs(spark, sf_dir))


@register("longest_comment", operators=("W4",), sql=f"""
WITH {SPLIT_DOCS}, {LENS}
SELECT split, doc_id AS pos, n AS n_tokens FROM lens
QUALIFY row_number() OVER (PARTITION BY split ORDER BY n DESC, doc_id) = 1
""")
def longest_comment(spark, sf_dir):
    return stats.longest_comment(_split_docs(spark, sf_dir))


@register("category_split_cube", operators=("G14",), sql=f"""
WITH {SPLIT_DOCS}
SELECT source AS category, split, CAST(count(*) AS BIGINT) AS n FROM sdocs GROUP BY CUBE (source, split)
""")
def category_split_cube(spark, sf_dir):
    return stats.category_split_cube(_split_docs(spark, sf_dir))


@register("category_split_crosstab", operators=("G14", "J9", "U4"), sql=f"""
WITH {SPLIT_DOCS},
c AS (SELECT coalesce(source, 'Total') AS category,
             CAST(count(*) FILTER (WHERE split = 'train') AS BIGINT) AS train,
             CAST(count(*) FILTER (WHERE split = 'dev') AS BIGINT) AS dev,
             CAST(count(*) FILTER (WHERE split = 'test') AS BIGINT) AS test
      FROM sdocs GROUP BY ROLLUP (source))
SELECT category, train, dev, test, CAST(train + dev + test AS BIGINT) AS total FROM c
""")
def category_split_crosstab(spark, sf_dir):
    return stats.category_split_crosstab(_split_docs(spark, sf_dir))


@register("category_share", operators=("G15",), sql="""
SELECT source AS category, CAST(count(*) AS BIGINT) AS n,
       CAST(count(*) AS DOUBLE) * 100.0 / sum(count(*)) OVER () AS share_pct
FROM documents GROUP BY source
""")
def category_share(spark, sf_dir):
    return stats.category_share(_split_docs(spark, sf_dir))


@register("enrich_left_default", operators=("J1",), sql="""
WITH src AS (SELECT doc_id, CAST(toxic AS VARCHAR) AS toxic, CAST(quality AS VARCHAR) AS quality FROM labels
             QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY doc_id DESC) = 1)
SELECT d.doc_id,
       CASE WHEN s.doc_id IS NULL THEN 'None' ELSE s.toxic END AS toxic,
       CASE WHEN s.doc_id IS NULL THEN 'None' ELSE s.quality END AS quality
FROM documents d LEFT JOIN src s ON d.doc_id = s.doc_id
""")
def enrich_left_default(spark, sf_dir):
    target = table(spark, sf_dir, "documents").select("doc_id")
    source = table(spark, sf_dir, "labels").select(
        "doc_id", F.col("toxic").cast("string").alias("toxic"),
        F.col("quality").cast("string").alias("quality"), F.col("doc_id").alias("_order"))
    return joins.enrich_left_default(target, source, "doc_id", ["toxic", "quality"], "_order")
