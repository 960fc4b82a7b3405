"""Cleaning, ids, dedup, batches and the scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from marrow.functions import text as tx
from marrow.operators import clean
from marrow.plans import sqltext as S
from marrow.plans.fixtures_sql import MARKED
from marrow.plans.registry import register
from marrow.sources import fixtures as fx
from marrow.sources.tables import table

IDS_SQL = """ided AS (
  SELECT doc_id AS pos, source AS category, text,
         source || '_' || CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS VARCHAR) AS id
  FROM documents)"""


def _comments(spark, sf_dir):
    return fx.documents(spark, sf_dir).select("pos", "category", "text")


@register("clean_chain", operators=("C5", "W1", "U2", "C1", "C2", "C3", "C4"), sql=f"""
WITH {IDS_SQL},
kept AS (SELECT * FROM ided QUALIFY row_number() OVER (PARTITION BY category, text ORDER BY pos) = 1)
SELECT id, pos, category, {S.clean_text('text')} AS text FROM kept
""")
def clean_chain(spark, sf_dir):
    out = clean.clean_chain(_comments(spark, sf_dir))
    return out.select("id", "pos", "category", "text")


@register("assign_ids", operators=("W1",), sql=f"""
WITH {IDS_SQL} SELECT id, pos, category FROM ided
""")
def assign_ids(spark, sf_dir):
    return clean.assign_ids(_comments(spark, sf_dir)).select("id", "pos", "category")


@register("dedup_keep_first", operators=("U2", "W2"), sql="""
SELECT doc_id AS pos, source AS category FROM documents
QUALIFY row_number() OVER (PARTITION BY source, text ORDER BY doc_id) = 1
""")
def dedup_keep_first(spark, sf_dir):
    return clean.dedup_keep_first(_comments(spark, sf_dir), within=["category"]).select("pos", "category")


@register("dedup_global", operators=("U2", "T2"), sql="""
SELECT doc_id AS pos, source AS category FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1
""")
def dedup_global(spark, sf_dir):
    return clean.dedup_keep_first(_comments(spark, sf_dir)).select("pos", "category")


@register("dedup_after_clean", operators=("U2", "C5"), sql=f"""
WITH c AS (SELECT doc_id AS pos, source AS category, {S.clean_text('text')} AS text FROM documents)
SELECT pos, text FROM c QUALIFY row_number() OVER (PARTITION BY category, text ORDER BY pos) = 1
""")
def dedup_after_clean(spark, sf_dir):
    c = _comments(spark, sf_dir).select("pos", "category", clean.clean_text("text").alias("text"))
    return clean.dedup_keep_first(c, within=["category"]).select("pos", "text")


@register("batch_assign", operators=("K6", "W3"), sql="""
SELECT doc_id AS pos, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row,
       CAST((row_number() OVER (ORDER BY doc_id) - 1) // 100 + 1 AS BIGINT) AS batch
FROM documents
""")
def batch_assign(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"))
    return clean.batch_assign(d, "pos", 100).select("pos", "row", "batch")


def _funnel_sql():
    from marrow.plans.q_language import _VALUES
    return f"""
WITH {IDS_SQL},
kept AS (SELECT * FROM ided QUALIFY row_number() OVER (PARTITION BY category, text ORDER BY pos) = 1),
cleaned AS (SELECT category, pos, {S.clean_text('text')} AS text FROM kept),
ne AS (SELECT * FROM cleaned WHERE text <> ''),
prof AS (SELECT * FROM (VALUES {_VALUES}) t(lang, word)),
ctoks AS (SELECT pos, unnest({S.ws_tokens('lower(text)')}) AS word FROM ne),
chits AS (SELECT pos, lang, count(*) AS s FROM ctoks JOIN prof USING (word) GROUP BY pos, lang),
cbest AS (SELECT pos, lang AS detected FROM chits
          QUALIFY row_number() OVER (PARTITION BY pos ORDER BY s DESC, lang) = 1),
routed AS (SELECT ne.category, b.detected FROM ne LEFT JOIN cbest b USING (pos))
SELECT r.category, CAST(r.n AS BIGINT) AS n_raw, CAST(k.n AS BIGINT) AS n_dedup,
       CAST(c.n AS BIGINT) AS n_nonempty, CAST(l.a AS BIGINT) AS n_accepted,
       CAST(l.u AS BIGINT) AS n_undetectable
FROM (SELECT category, count(*) AS n FROM ided GROUP BY category) r
JOIN (SELECT category, count(*) AS n FROM kept GROUP BY category) k USING (category)
JOIN (SELECT category, count(*) FILTER (WHERE text <> '') AS n FROM cleaned GROUP BY category) c USING (category)
JOIN (SELECT category, count(*) FILTER (WHERE detected = 'en') AS a,
             count(*) FILTER (WHERE detected IS NULL) AS u FROM routed GROUP BY category) l USING (category)
"""


@register("stage_funnel", operators=("G16", "K4", "D23", "X1"), sql=_funnel_sql())
def stage_funnel(spark, sf_dir):
    from marrow.operators.language import route_by_language
    from marrow.operators.stats import stage_funnel as funnel
    raw = _comments(spark, sf_dir)
    kept = clean.dedup_keep_first(raw, within=["category"])
    routed = route_by_language(kept.withColumn("text", clean.clean_text("text")), "pos", "en")
    # every text is cleaned and scored once: filters on a lane would be pushed below the scoring and repeat it
    kept = clean.written(routed.select("category", (F.col("text") != "").alias("full"), "lane"))
    routed = nonempty = kept.where("full")
    return funnel({"raw": raw, "dedup": kept, "nonempty": nonempty,
                   "accepted": routed.where(F.col("lane") == "accepted"),
                   "undetectable": routed.where(F.col("lane") == "undetectable")}, "category")


# --- scalar text functions ---------------------------------------------------
@register("remove_hashtags", operators=("C1",), sql=f"""
SELECT doc_id, {S.remove_hashtags('text')} AS text FROM documents
""")
def remove_hashtags(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.remove_hashtags("text").alias("text"))


@register("mention_unmark", operators=("F4",), sql=f"""
WITH {MARKED} SELECT doc_id, {S.unmark_mentions('text')} AS text FROM marked
""")
def mention_unmark(spark, sf_dir):
    d = fx.marked_documents(spark, sf_dir)
    return d.select("doc_id", tx.unmark_mentions("text").alias("text"))


@register("clean_whitespace", operators=("C4",), sql=f"""
WITH {MARKED} SELECT doc_id, {S.clean_whitespace('text')} AS text FROM marked
""")
def clean_whitespace(spark, sf_dir):
    d = fx.marked_documents(spark, sf_dir)
    return d.select("doc_id", tx.clean_whitespace("text").alias("text"))


@register("to_lowercase", operators=("C3",), sql="""
SELECT doc_id, lower(text) AS text FROM documents
""")
def to_lowercase(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.to_lowercase("text").alias("text"))


@register("token_counts", operators=("C8", "C9", "C18"), sql=f"""
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars,
       CAST(len({S.ws_tokens('text')}) AS BIGINT) AS n_tokens,
       CAST(len(string_split(text, ' ')) AS BIGINT) AS n_space_pieces
FROM documents
""")
def token_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length("text").cast("long").alias("n_chars"),
                    F.size(tx.ws_tokens("text")).cast("long").alias("n_tokens"),
                    F.size(tx.space_tokens("text")).cast("long").alias("n_space_pieces"))


@register("join_underscores", operators=("C7", "C6"), sql=f"""
SELECT conv_id, turn, {S.join_underscores(S.remove_emoji("replace(text, ' ', ' _ ')"))} AS text
FROM conversations
""")
def join_underscores(spark, sf_dir):
    # Word-segmenter output joins compound syllables with '_'; emulate that shape
    # by turning single spaces into ' _ ' before the C6 + C7 steps.
    c = table(spark, sf_dir, "conversations")
    seg = F.replace(F.col("text"), F.lit(" "), F.lit(" _ "))
    return c.select("conv_id", "turn", tx.join_underscores(tx.remove_emoji(seg)).alias("text"))


@register("remove_urls", operators=("C2",), sql=f"""
SELECT page_id, {S.remove_urls('html')} AS html FROM pages
""")
def remove_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", tx.remove_urls("html").alias("html"))


@register("url_key", operators=("C10",), sql="""
SELECT page_id,
  CASE WHEN list_contains(string_split(url, '/'), 'shorts') THEN string_split(url, '/')[-1]
       ELSE string_split(url, '=')[2] END AS url_key
FROM pages
""")
def url_key(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", tx.url_key("url").alias("url_key"))


@register("url_path", operators=("C11",), sql=f"""
SELECT page_id, {S.url_path('url')} AS url_path FROM pages
""")
def url_path(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", tx.url_path("url").alias("url_path"))


@register("remove_emoji", operators=("C6",), sql=f"""
WITH {MARKED} SELECT doc_id, {S.remove_emoji('text')} AS text FROM marked
""")
def remove_emoji(spark, sf_dir):
    d = fx.marked_documents(spark, sf_dir)
    return d.select("doc_id", tx.remove_emoji("text").alias("text"))


@register("removed_body_filter", operators=("F6",), sql=f"""
WITH {MARKED}
SELECT doc_id, text FROM marked
WHERE text IS NOT NULL AND text NOT IN ('[removed]', '[deleted]', '')
""")
def removed_body_filter(spark, sf_dir):
    d = fx.marked_documents(spark, sf_dir).withColumnRenamed("text", "body")
    out = clean.repair_reddit(d)
    return out.select("doc_id", "text")


@register("mention_only_filter", operators=("F2", "F3"), sql=f"""
WITH {MARKED},
m AS (SELECT doc_id, text, regexp_extract_all(text, {S.q('(@' + tx.NWS + '+)')}, 1) AS mentions FROM marked)
SELECT doc_id,
  CASE WHEN len(mentions) > 0 THEN {S.strip_ws("replace(text, '@', '')")} ELSE text END AS text
FROM m
WHERE NOT (len(mentions) > 0 AND
           abs(length(text) - coalesce(list_sum(list_transform(mentions, lambda s: length(s))), 0)) <= len(mentions))
""")
def mention_only_filter(spark, sf_dir):
    d = fx.marked_documents(spark, sf_dir)
    d = d.withColumn("mentions", F.regexp_extract_all("text", F.lit("(@" + tx.NWS + "+)"), 1))
    return clean.mention_only_filter(d).select("doc_id", "text")


@register("drop_repeated_header", operators=("K2",), sql=f"""
WITH {MARKED}
SELECT doc_id AS pos, source FROM marked WHERE doc_id % 97 <> 5
""")
def drop_repeated_header(spark, sf_dir):
    d = fx.csv_like_documents(spark, sf_dir)
    out = clean.drop_repeated_header(d.select("doc_id", "text", "lang", "source", F.col("pos").alias("_pos")))
    return out.select(F.col("_pos").alias("pos"), "source")


@register("id_prefix", operators=("C12",), sql=f"""
WITH {IDS_SQL}
SELECT id, split_part(id, '_', 1) AS category FROM ided
""")
def id_prefix(spark, sf_dir):
    ids = clean.assign_ids(_comments(spark, sf_dir))
    return ids.select("id", tx.id_prefix("id").alias("category"))
