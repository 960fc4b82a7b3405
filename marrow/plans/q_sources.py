"""Raw dumps written from the driver tables and read back: CSV trees, JSON folders, listings, repair.

Every file read here is written by the query itself below the shared checkpoint
folder, in the forms of the source's dumps, from the rows of the tables."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.functions import text as tx
from marrow.operators import clean, joins, sampling, tree
from marrow.operators import votes as V
from marrow.plans.fixtures_sql import ADJUDICATIONS, HUMAN_FINAL, HUMAN_REVIEW, VOTES
from marrow.plans.q_votes import LANES, SUMMARY, TV, _tv
from marrow.plans.registry import register
from marrow.plans.sqltext import q, rr
from marrow.sources import fixtures as fx
from marrow.sources import sinks, tables
from marrow.sources.tables import table
from marrow.streaming.ingest import scratch


@contextmanager
def small_splits(spark, total: int, least: int = 1 << 16, most: int = 1 << 24):
    """Blocks of a 256th of ``total`` bytes, 64 KB to 16 MB each, so that small files too are read by
    several tasks and large ones not by a task for every 64 KB.  The size depends on nothing else, so
    all reads cut alike; short files share a task."""
    wanted = {"spark.sql.files.maxPartitionBytes": min(max(total >> 8, least), most),
              "spark.sql.files.openCostInBytes": least, "spark.sql.files.minPartitionNum": 1}
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


# Two categories, three headers (columns in another order, a column missing), quoted line ends and a folder of links.
@register("csv_tree_scan", operators=("S1", "F1", "F11"), sql=f"""
SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, doc_id,
       CASE WHEN text IN ({", ".join(q(v) for v in tx.CSV_NA_VALUES)}) THEN NULL ELSE text END AS text,
       CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang
FROM documents
""")
def csv_tree_scan(spark, sf_dir):
    root = scratch(spark, "csv-tree")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    for k, category in enumerate(("even", "odd")):
        for third, cols in enumerate((("text", "doc_id"), ("doc_id", "lang", "text"), ("lang", "text", "doc_id"))):
            part = docs.where((F.col("doc_id") % 2 == k) & (F.col("doc_id") % 3 == third)).select(*cols)
            sinks.write_csv(part, f"{root}/{category}/facebook", append=True)
    sinks.write_csv(docs.where("doc_id < 10"), f"{root}/link_list/facebook")
    with small_splits(spark, _text_bytes(docs)):
        found = tables.read_platform_csv(spark, root, "facebook", "doc_id LONG, text STRING, lang STRING").select(
            "category", "doc_id", "text", "lang").checkpoint()
    return found


# Arrays of objects in folders of tasks, and arrays that end in the middle of an object.
@register("json_folder_scan", operators=("S2", "S3", "K1"), sql="""
SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS task, doc_id, text, lang, 'ok' AS lane, NULL AS raw_chars FROM documents
UNION ALL
SELECT 'cut', NULL, NULL, NULL, 'error', CAST(length('{"doc_id":' || CAST(doc_id AS VARCHAR) || ',"lang":"' || lang) AS BIGINT)
FROM documents WHERE doc_id % 50 = 0
""")
def json_folder_scan(spark, sf_dir):
    root = scratch(spark, "json-tree")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    for k, task in enumerate(("even", "odd")):
        sinks.write_json_arrays(docs.where(F.col("doc_id") % 2 == k), f"{root}/{task}")
    some = docs.where(F.col("doc_id") % 50 == 0)
    # a file of its own for each, as a dump that broke off
    (some.select(F.concat(F.lit('[{"doc_id":'), F.col("doc_id").cast("string"), F.lit(',"lang":"'), F.col("lang")).alias("value"))
         .write.option("maxRecordsPerFile", 1).text(f"{root}/cut"))
    with small_splits(spark, _text_bytes(docs)):
        found = tables.read_json_folder(spark, root, "doc_id LONG, text STRING, lang STRING", lanes=True, glob="*.txt")
        found = found.select("task", "doc_id", "text", "lang", "lane", F.char_length(F.rtrim("raw", F.lit("\n"))).cast("long").alias("raw_chars")).checkpoint()
    return found


def _pages(rows: DataFrame, page: F.Column, order: list[str], item: F.Column) -> DataFrame:
    """Listing documents of the rows of a page (which holds a bounded number), in order."""
    return rows.groupBy(page.alias("page")).agg(F.array_sort(F.collect_list(F.struct(*order, item.alias("item")))).alias("l")).select(
        "page", F.to_json(F.struct(F.struct(F.transform("l", lambda x: x["item"]).alias("children")).alias("data"))).alias("json"))


# Search results in listings of twenty; every seventh listing broke off, every eleventh has another form.
@register("search_listing_flatten", operators=("S6", "C20"), sql=f"""
WITH d AS (SELECT doc_id // 20 AS page, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) - 1 AS pos, * FROM documents)
SELECT page, CAST(pos AS BIGINT) AS pos, lang AS title, '{tree.REDDIT_HOST}/d/' || CAST(doc_id AS VARCHAR) AS link,
       CASE WHEN doc_id % 5 = 0 THEN '' ELSE coalesce(substr(text, 1, {tree.DESCRIPTION_CHARS}), '') END AS description, 'ok' AS lane
FROM d WHERE page % 7 <> 3 AND page % 11 <> 4
UNION ALL
SELECT DISTINCT page, NULL, NULL, NULL, NULL, 'error' FROM d WHERE page % 7 = 3 OR page % 11 = 4
""")
def search_listing_flatten(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    data = F.struct(F.col("lang").alias("title"), F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("permalink"),
                    F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("selftext"), F.col("source").alias("flair"))
    pages = _pages(docs, F.expr("doc_id div 20"), ["doc_id"], F.struct(F.lit("t3").alias("kind"), data.alias("data")))
    broken = F.expr("substring(json, 1, length(json) - 3)")
    pages = pages.withColumn("json", F.when(F.col("page") % 7 == 3, broken).when(F.col("page") % 11 == 4, F.lit('{"data": {"children": {}}}'))
                             .otherwise(F.col("json")))
    found = tree.search_rows(tree.listing_items(pages, ["page"]), ["page"])
    return found.select("page", F.col("pos").cast("long").alias("pos"), "title", "link", "description", "lane")


# A document per post; some have one part only, are no list, or broke off.
@register("post_detail_lanes", operators=("S7", "C20"), sql="""
SELECT doc_id, CASE WHEN doc_id % 9 > 2 THEN lang END AS title,
       CASE WHEN doc_id % 9 > 2 THEN CASE WHEN doc_id % 4 = 0 THEN '' ELSE coalesce(text, '') END END AS body,
       CASE WHEN doc_id % 9 > 2 THEN 'ok' ELSE 'error' END AS lane
FROM documents
""")
def post_detail_lanes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    post = F.struct(F.col("lang").alias("title"), F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("selftext"))
    part = F.struct(F.struct(F.array(F.struct(F.lit("t3").alias("kind"), post.alias("data"))).alias("children")).alias("data"))
    one, two = F.to_json(F.array(part)), F.to_json(F.array(part, part))
    doc = (F.when(F.col("doc_id") % 9 == 0, one).when(F.col("doc_id") % 9 == 1, F.to_json(part))
           .when(F.col("doc_id") % 9 == 2, F.expr("substring(two, 1, length(two) - 4)")).otherwise(F.col("two")))
    raw = docs.withColumn("two", two).select("doc_id", doc.alias("json"))
    return tree.post_detail(raw, lanes=True).select("doc_id", "title", "body", "lane")


# S9, all columns: a user's activity in pages; views are posts, clicks comments, other kinds count toward the cap.
@register("user_pages_normalise", operators=("S9", "W5", "C20"), sql=f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6, event_id) AS rk FROM events)
SELECT user_id, CAST(rk AS BIGINT) AS rank, CASE WHEN event_type = 'view' THEN 'post' ELSE 'comment' END AS type,
       CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 6 = 0 THEN '' ELSE props END END AS title,
       'r' || CAST(user_id AS VARCHAR) AS subreddit,
       CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 6 = 0 THEN '' ELSE props END END AS body,
       epoch_us(ts) / 1e6 AS created_utc,
       '{tree.REDDIT_HOST}' || CASE WHEN event_id % 8 = 0 THEN '' ELSE '/e/' || CAST(event_id AS VARCHAR) END AS url
FROM r WHERE rk <= 10 AND event_type IN ('view', 'click')
""")
def user_pages_normalise(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 6 != 0, F.col("props"))
    data = F.struct(text.alias("title"), F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("subreddit"),
                    F.when(F.col("event_id") % 8 != 0, F.concat(F.lit("/e/"), F.col("event_id").cast("string"))).alias("permalink"),
                    text.alias("body"),
                    F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1e6").alias("created_utc"), F.col("event_id").alias("id"))
    kind = (F.when(F.col("event_type") == "view", "t3").when(F.col("event_type") == "click", "t1").otherwise(F.col("event_type")))
    # a page holds at most a thousand events of its user
    pages = _pages(ev, F.struct("user_id", F.expr("event_id div 1000").alias("part")), ["event_id"],
                   F.struct(kind.alias("kind"), data.alias("data")))
    items = tree.user_item_columns(tree.listing_items(pages, ["page"]), ["page"])
    items = items.select(F.col("page.user_id").alias("user_id"), "kind", "data", F.col("data.created_utc").alias("at"),
                         F.try_variant_get("item", "$.data.id", "long").alias("event_id"))
    out = tree.normalise_user_items(items, "user_id", ["at", "event_id"], 10, key="event_id")
    return out.withColumn("rank", F.col("rank").cast("long"))


# S10, all columns: pages as listings of a hundred posts.
@register("post_pages_normalise", operators=("S10", "C20"), sql=f"""
SELECT coalesce(url, '') AS title, 'a' || CAST(page_id % 17 AS VARCHAR) AS author, '/p/' || CAST(page_id AS VARCHAR) AS permalink,
       page_id AS score, CAST(length(html) AS BIGINT) AS num_comments, CAST(page_id AS DOUBLE) / 2 AS created_utc,
       CASE WHEN page_id % 3 = 0 AND url IS NOT NULL THEN url
            WHEN page_id % 4 < 2 THEN 'https://preview.example/' || CAST(page_id AS VARCHAR) || '.jpg' END AS image_url,
       CASE WHEN page_id % 5 > 1 THEN 'https://thumbs.example/' || CAST(page_id AS VARCHAR) END AS thumbnail_url
FROM pages
""")
def post_pages_normalise(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    pid = F.col("page_id").cast("string")

    def image(n):
        return F.struct(F.struct(F.concat(F.lit("https://preview.example/"), pid, F.lit(n)).alias("url")).alias("source"))

    images = F.when(F.col("page_id") % 4 == 0, F.array(image(".jpg"))).when(F.col("page_id") % 4 == 1, F.array(image(".jpg"), image(".png")))
    data = F.struct(
        F.coalesce("url", F.lit("")).alias("title"), F.concat(F.lit("a"), (F.col("page_id") % 17).cast("string")).alias("author"),
        F.concat(F.lit("/p/"), pid).alias("permalink"), F.col("page_id").alias("score"), F.length("html").alias("num_comments"),
        (F.col("page_id") / 2).cast("double").alias("created_utc"), F.when(F.col("page_id") % 3 == 0, "image").alias("post_hint"), "url",
        F.when(F.col("page_id") % 5 == 0, "self").when(F.col("page_id") % 5 > 1, F.concat(F.lit("https://thumbs.example/"), pid)).alias("thumbnail"),
        F.when(images.isNotNull(), F.struct(images.alias("images"))).alias("preview"))
    pages = _pages(p, F.expr("page_id div 100"), ["page_id"], F.struct(F.lit("t3").alias("kind"), data.alias("data")))
    return tree.normalise_posts(tree.post_columns(tree.listing_items(pages, ["page"]), ["page"]))


# items of other kinds, replies given as '' or an object, and missing fields.
@register("reply_kinds_flatten", operators=("F18", "S8", "C20"), sql="""
WITH d AS (SELECT doc_id // 20 AS page, doc_id, lang, text FROM documents WHERE doc_id % 4 <> 0),
i AS (SELECT page, doc_id, 0 AS k, 0 AS depth, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS author, coalesce(text, '') AS body FROM d
      UNION ALL SELECT page, doc_id, 1, 1, 're', 'first ' || CAST(doc_id AS VARCHAR) FROM d WHERE doc_id % 3 = 0
      UNION ALL SELECT page, doc_id, 2, 1, 're', '' FROM d WHERE doc_id % 3 = 0)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY doc_id, k) - 1 AS BIGINT) AS seq, CAST(depth AS BIGINT) AS depth, author, body
FROM i
""")
def reply_kinds_flatten(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")

    def reply(kind, body):
        return F.struct(F.lit(kind).alias("kind"), F.struct(F.lit("re").alias("author"), body.alias("body")).alias("data"))

    first = F.concat(F.lit("first "), F.col("doc_id").cast("string"))
    replies = F.to_json(F.struct(F.struct(F.array(
        reply("t1", first), reply("more", first), reply("t1", F.lit(None).cast("string")))
        .alias("children")).alias("data")))
    item = F.concat(F.lit('{"kind":"'), F.when(F.col("doc_id") % 4 == 0, "more").otherwise("t1"), F.lit('","data":'),
                    F.regexp_replace(F.to_json(F.struct(F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("author"), F.col("text").alias("body"),
                                                        F.col("doc_id").alias("score"))), r"\}\z", ""),
                    F.lit(',"replies":'), F.when(F.col("doc_id") % 3 == 0, replies).otherwise('""'), F.lit("}}"))
    pages = docs.select("doc_id", F.expr("doc_id div 20").alias("page"), item.alias("item")).groupBy("page").agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "item"))).alias("l"))
    pages = pages.select("page", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["item"]), ","), F.lit("]")).alias("json"))
    return tree.flatten_reply_trees(pages, "json", ["page"]).select("page", "seq", "depth", "author", "body")


BOT = "\n\n*I am a bot, and this action was performed automatically. Please* write to the *mods*."
EMOTE = "![img](emote|t5_2th|8020)"


# One chain per platform over rows with missing texts, handles, bot notices and emotes.
@register("platform_repair", operators=("F1", "F4", "F5", "F6", "F7", "F8", "F9", "F10", "F11"), sql=f"""
WITH b AS (SELECT doc_id, doc_id % 4 AS p, CASE WHEN doc_id % 7 <> 0 THEN text END AS t FROM documents),
m AS (SELECT doc_id, p, CASE WHEN p = 0 THEN '@user' || CAST(doc_id AS VARCHAR) || ' ' || t WHEN p = 1 THEN t
        WHEN p = 2 THEN CASE WHEN doc_id % 3 = 0 THEN '@a @bc ' || t ELSE t END
        WHEN doc_id % 9 = 0 THEN '[removed]' WHEN doc_id % 9 = 1 THEN '[deleted]'
        ELSE CASE WHEN doc_id % 5 = 0 THEN {q(EMOTE)} ELSE '' END || t || CASE WHEN doc_id % 3 <> 2 THEN {q(BOT)} ELSE '' END END AS t FROM b)
SELECT CASE p WHEN 0 THEN 'youtube' WHEN 1 THEN 'facebook' WHEN 2 THEN 'tiktok' ELSE 'reddit' END AS platform, doc_id,
  CASE p WHEN 0 THEN {rr("t", tx.MENTION_RE, chr(92) + "1")} WHEN 1 THEN t
    WHEN 2 THEN CASE WHEN doc_id % 3 = 0 THEN {rr(rr("replace(t, '@', '')", "^" + tx.WS + "+"), tx.WS + "+$")} ELSE t END
    ELSE {rr(rr("t", tx.BOT_NOTICE_RE), tx.EMOTE_RE)} END AS text
FROM m WHERE t IS NOT NULL AND NOT (p = 3 AND t IN ('[removed]', '[deleted]', ''))
  AND NOT (p = 2 AND doc_id % 3 = 0 AND abs(length(t) - 5) <= 2)
""")
def platform_repair(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("text"))
    third = F.col("doc_id") % 3
    named = F.concat(F.lit("@user"), F.col("doc_id").cast("string"), F.lit(" "), "text")
    body = F.concat(F.when(F.col("doc_id") % 5 == 0, EMOTE).otherwise(""), F.col("text"), F.when(third != 2, BOT).otherwise(""))
    raw = {
        "youtube": docs.withColumn("text", named),
        "facebook": docs,
        "tiktok": docs.select("doc_id", F.when(third == 0, F.concat(F.lit("@a @bc "), "text")).otherwise(F.col("text")).alias("text"),
                              F.when(third == 0, F.array(F.lit("@a"), F.lit(None), F.lit("@bc"))).otherwise(F.array()).alias("mentions")),
        "reddit": docs.select("doc_id", F.when(F.col("doc_id") % 9 == 0, "[removed]").when(F.col("doc_id") % 9 == 1, "[deleted]")
                              .otherwise(body).alias("body")),
    }
    out = None
    for k, platform in enumerate(("youtube", "facebook", "tiktok", "reddit")):
        part = clean.repair_platform(raw[platform].where(F.col("doc_id") % 4 == k), platform)
        part = part.select(F.lit(platform).alias("platform"), "doc_id", "text")
        out = part if out is None else out.unionByName(part)
    return out


# Pages as a list of links, written and read as CSV.
@register("link_list_scan", operators=("S4",), sql="""
SELECT page_id AS no, url AS link FROM pages WHERE page_id % 3 = 0 AND page_id % 5 <> 0
""")
def link_list_scan(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    platform = F.when(F.col("page_id") % 3 == 0, "youtube").when(F.col("page_id") % 3 == 1, "reddit").otherwise("facebook")
    path = scratch(spark, "links")
    sinks.write_csv(p.select(F.col("page_id").alias("No."), platform.alias("Platform"), F.col("url").alias("Link"),
                             F.when(F.col("page_id") % 5 == 0, "dead, see\nbelow").alias("note")), path)
    sheet = spark.read.schema("`No.` LONG, Platform STRING, Link STRING, note STRING").options(
        header=True, multiLine=True, escape='"').csv(path)
    return tables.read_link_list(sheet, "youtube")


# O2: a sample of every file.
@register("sample_per_file", operators=("O2",), sql="""
SELECT lang || '_' || source || '.json' AS file, doc_id FROM documents
QUALIFY row_number() OVER (PARTITION BY lang || '_' || source || '.json' ORDER BY md5('4|' || CAST(doc_id AS VARCHAR)), doc_id) <= 3
""")
def sample_per_file(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat_ws("", "lang", F.lit("_"), "source", F.lit(".json")).alias("file"), "doc_id")
    return sampling.sample_per_file(d, "doc_id", 3, seed=4).select("file", "doc_id")


# what stays of a disputed row once it is adjudicated.
@register("adjudicated_rows", operators=("F13", "G3"), sql=f"""
WITH {VOTES}, {TV}, {SUMMARY}, {ADJUDICATIONS}
SELECT s.id, a.label, a.reason AS adjudication_reason FROM summ s JOIN adjud a ON s.id = a.id WHERE s.lo <> s.hi
""")
def adjudicated_rows(spark, sf_dir):
    return V.drop_vote_columns(V.adjudicate(V.disputed_votes(_tv(spark, sf_dir)), fx.adjudications(spark, sf_dir)))


# F16: the sheets of people are overwritten, the file of the models stays out.
@register("exclude_model_sheet", operators=("F16", "J4"), sql=f"""
WITH {VOTES}, {TV}, {SUMMARY}, {ADJUDICATIONS}, {LANES}, {HUMAN_FINAL}, {HUMAN_REVIEW},
sheets AS (SELECT id, annotator, label_fixed FROM hreview UNION ALL SELECT id, 'llms', label FROM lanes),
diff AS (SELECT s.id, h.final FROM summ s JOIN hfinal h ON s.id = h.id WHERE s.lo <> s.hi)
SELECT r.id, r.annotator, CASE WHEN d.id IS NOT NULL THEN d.final ELSE r.label_fixed END AS label_fixed
FROM sheets r LEFT JOIN diff d ON r.id = d.id WHERE r.annotator <> 'llms'
""")
def exclude_model_sheet(spark, sf_dir):
    v = _tv(spark, sf_dir)
    models = V.label_lanes_union(v, fx.adjudications(spark, sf_dir)).select(
        "id", F.lit("llms").alias("annotator"), F.col("label").alias("label_fixed"))
    sheets = fx.human_review(spark, sf_dir).select("id", "annotator", "label_fixed").unionByName(models)
    diff = V.disputed_votes(v).select("id").join(fx.human_final(spark, sf_dir), "id")
    return joins.overwrite_by_key(V.without_annotator(sheets, "llms"), diff, "id", "final", "label_fixed").select(
        "id", "annotator", "label_fixed")


# Literal replies are compared as they are; by default they are trimmed first.
@register("raw_reply_compare", operators=("C21", "G1"), sql=f"""
WITH {VOTES}, {TV},
r AS (SELECT id, CASE WHEN doc_id % 3 = 0 AND annotator = 'qwen' THEN ' ' || label || chr(10) ELSE label END AS label FROM tv)
SELECT id, CASE WHEN count(DISTINCT label) = 1 THEN 'similar' ELSE 'different' END AS raw_lane,
       CASE WHEN count(DISTINCT trim(label, ' ' || chr(10))) = 1 THEN 'similar' ELSE 'different' END AS lane
FROM r GROUP BY id
""")
def raw_reply_compare(spark, sf_dir):
    v = _tv(spark, sf_dir)
    spaced = (F.col("doc_id") % 3 == 0) & (F.col("annotator") == "qwen")
    v = v.withColumn("label", F.when(spaced, F.concat(F.lit(" "), "label", F.lit("\n"))).otherwise(F.col("label")))
    raw = V.vote_summary(v, raw=True).select("id", F.col("lane").alias("raw_lane"))
    return raw.join(V.vote_summary(v).select("id", "lane"), "id")
