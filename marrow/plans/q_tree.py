"""Reply threads from ``conversations`` (turn n replies to turn n-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marrow.functions import text as tx
from marrow.operators import tree
from marrow.plans.registry import register
from marrow.sources.tables import table

CHAIN = """RECURSIVE t(conv_id, turn, depth, role, text) AS (
  SELECT conv_id, turn, 0, role, text FROM conversations WHERE turn = (
    SELECT min(turn) FROM conversations c2 WHERE c2.conv_id = conversations.conv_id)
  UNION ALL
  SELECT c.conv_id, c.turn, t.depth + 1, c.role, c.text
  FROM conversations c JOIN t ON c.conv_id = t.conv_id AND c.turn = t.turn + 1)"""


@register("reply_tree_flatten", operators=("S8", "X9"), sql=f"""
WITH {CHAIN}
SELECT conv_id, CAST(depth AS BIGINT) AS seq, CAST(depth AS BIGINT) AS depth, role AS author,
       text AS body, CAST(turn AS BIGINT) AS score
FROM t
""")
def reply_tree_flatten(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    trees = tree.chain_to_tree_json(conv, "conv_id", "turn", "role", "text")
    out = tree.flatten_reply_trees(trees, "tree_json", ["conv_id"])
    return out.select("conv_id", "seq", "depth", "author", "body", F.col("score").cast("long").alias("score"))


@register("reply_tree_paths", operators=("S8",), sql=f"""
WITH {CHAIN}
SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(depth AS BIGINT) AS depth, CAST(depth AS BIGINT) AS seq
FROM t
""")
def reply_tree_paths(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    first = conv.groupBy("conv_id").agg(F.min("turn").alias("_t0"))
    edges = conv.join(first, "conv_id").select(
        "conv_id", "turn", F.when(F.col("turn") > F.col("_t0"), F.col("turn") - 1).alias("parent"))
    out = tree.tree_order(edges, "conv_id", "turn", "parent", "turn")
    return out.select("conv_id", F.col("turn").cast("long").alias("turn"), "depth", "seq")


@register("thread_page_flatten", operators=("S5",), sql="""
WITH c AS (SELECT conv_id, turn, role, text, turn - min(turn) OVER (PARTITION BY conv_id) AS reply
           FROM conversations)
SELECT conv_id AS page, CAST(0 AS BIGINT) AS item, CAST(reply AS BIGINT) AS reply, role AS author, text,
       CAST(turn AS BIGINT) AS likeCount
FROM c
""")
def thread_page_flatten(spark, sf_dir):
    # Pages of a hundred turns, as the source's API gives them: the first one holds the top-level
    # comment and its first replies, later ones an item without a comment and further replies.
    conv = table(spark, sf_dir, "conversations")
    first = conv.groupBy("conv_id").agg(F.min("turn").alias("_t0"))
    turns = conv.join(first, "conv_id").withColumn("k", F.col("turn") - F.col("_t0"))

    def snippet(r):
        return F.struct(r["role"].alias("authorDisplayName"), r["text"].alias("textDisplay"),
                        r["turn"].alias("likeCount"), F.lit("").alias("publishedAt"))

    per = turns.groupBy("conv_id", F.expr("k div 100").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    opens = F.col("block") == 0
    top = F.when(opens, snippet(F.get("t", 0)))
    later = F.slice("t", F.when(opens, 2).otherwise(1), F.size("t"))
    replies = F.transform(later, lambda r: F.struct(snippet(r).alias("snippet")))
    item = F.struct(
        F.struct(F.size(later).cast("long").alias("totalReplyCount"),
                 F.struct(F.lit("").alias("id"), top.alias("snippet")).alias("topLevelComment")).alias("snippet"),
        F.struct(replies.alias("comments")).alias("replies"))
    pages = per.select(F.struct("conv_id", "block").alias("page"), F.array(item).alias("items"))
    out = tree.flatten_thread_pages(pages).where((F.col("page.block") == 0) | (F.col("reply") > 0))
    place = F.when(F.col("page.block") == 0, F.col("reply")).otherwise(F.col("page.block") * 100 + F.col("reply") - 1)
    return out.select(F.col("page.conv_id").alias("page"), F.col("item").cast("long").alias("item"), place.cast("long").alias("reply"),
                      "author", "text", F.col("likeCount").cast("long").alias("likeCount"))


@register("user_items_normalise", operators=("S9", "W5"), sql="""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rk FROM events)
SELECT user_id, CAST(rk AS BIGINT) AS rank,
       CASE WHEN event_type = 'view' THEN 'post' ELSE 'comment' END AS type,
       'https://www.reddit.com/e/' || CAST(event_id AS VARCHAR) AS url
FROM r WHERE rk <= 10 AND event_type IN ('view', 'click')
""")
def user_items_normalise(spark, sf_dir):
    # Each user's activity as a listing: views are posts (t3), clicks are comments
    # (t1), every other kind counts toward the cap and is then dropped.
    ev = table(spark, sf_dir, "events")
    kind = (F.when(F.col("event_type") == "view", "t3").when(F.col("event_type") == "click", "t1")
             .otherwise(F.col("event_type")))
    data = F.struct(F.col("props").alias("title"), F.col("user_id").cast("string").alias("subreddit"),
                    F.concat(F.lit("/e/"), F.col("event_id").cast("string")).alias("permalink"),
                    F.col("props").alias("body"), F.unix_timestamp("ts").cast("double").alias("created_utc"))
    items = ev.select("user_id", "ts", "event_id", kind.alias("kind"), data.alias("data"))
    out = tree.normalise_user_items(items, "user_id", ["ts", "event_id"], 10, key="event_id")
    return out.select("user_id", F.col("rank").cast("long").alias("rank"), "type", "url")


@register("post_listing_normalise", operators=("S10",), sql="""
SELECT page_id AS score,
       CASE WHEN url LIKE '%#%' AND url IS NOT NULL THEN url
            WHEN url LIKE '%?%' THEN 'https://preview.example/' || CAST(page_id AS VARCHAR) || '.jpg' END AS image_url,
       CASE WHEN url LIKE 'https%' THEN NULL ELSE 'https://thumbs.example/' || CAST(page_id AS VARCHAR) END
         AS thumbnail_url
FROM pages
""")
def post_listing_normalise(spark, sf_dir):
    # Pages as a subreddit listing: a '#' in the link marks an image post, a '?'
    # gives the post a preview image, and https pages carry the 'self' thumbnail.
    p = table(spark, sf_dir, "pages")
    pid = F.col("page_id").cast("string")
    preview = F.when(F.col("url").contains("?"), F.struct(F.array(F.struct(F.struct(
        F.concat(F.lit("https://preview.example/"), pid, F.lit(".jpg")).alias("url")).alias("source"))).alias("images")))
    posts = p.select(F.col("url").alias("title"), F.lit("author").alias("author"),
                     tx.url_path("url").alias("permalink"), F.col("page_id").alias("score"),
                     F.length("html").cast("long").alias("num_comments"),
                     F.col("page_id").cast("double").alias("created_utc"),
                     F.when(F.col("url").contains("#"), F.lit("image")).alias("post_hint"), "url",
                     F.when(F.col("url").startswith("https"), F.lit("self"))
                      .otherwise(F.concat(F.lit("https://thumbs.example/"), pid)).alias("thumbnail"),
                     preview.alias("preview"))
    return tree.normalise_posts(posts).select("score", "image_url", "thumbnail_url")


@register("post_detail_flatten", operators=("S7", "S8"), sql="""
WITH f AS (SELECT conv_id, arg_min(text, turn) AS title, arg_min(role, turn) AS body, count(*) AS n
           FROM conversations GROUP BY conv_id)
SELECT conv_id, title, body, CAST(n - 1 AS BIGINT) AS n_comments FROM f WHERE n >= 2
""")
def post_detail_flatten(spark, sf_dir):
    # Each conversation as a post-detail document: part 0 is the post (its first
    # turn), part 1 the comment tree of the later turns.  A conversation with a
    # single turn yields a one-part document, which the reader rejects.
    conv = table(spark, sf_dir, "conversations")
    first = conv.groupBy("conv_id").agg(
        F.min("turn").alias("_t0"),
        F.min_by(F.struct(F.col("text").alias("title"), F.col("role").alias("selftext")), F.col("turn")).alias("_p"))
    later = conv.join(first.select("conv_id", "_t0"), "conv_id").where(F.col("turn") > F.col("_t0"))
    trees = tree.chain_to_tree_json(later, "conv_id", "turn", "role", "text")
    post = F.concat(F.lit('{"data":{"children":[{"kind":"t3","data":'), F.to_json("_p"), F.lit("}]}}"))
    doc = F.when(F.col("tree_json").isNull(), F.concat(F.lit("["), post, F.lit("]"))).otherwise(
        F.concat(F.lit("["), post, F.lit(',{"data":{"children":'), F.col("tree_json"), F.lit("}}]")))
    raw = first.join(trees, "conv_id", "left").select("conv_id", doc.alias("json"))
    detail = tree.post_detail(raw, "json")
    comments = tree.flatten_reply_trees(detail, "comments_json", ["conv_id"])
    counts = comments.groupBy("conv_id").agg(F.count(F.lit(1)).cast("long").alias("n_comments"))
    return detail.select("conv_id", "title", "body").join(counts, "conv_id", "left") \
                 .select("conv_id", "title", "body", F.coalesce("n_comments", F.lit(0)).cast("long").alias("n_comments"))


# Branching threads: node k of a conversation (counted from 0) replies to node (k - 1) / 2; every
# fifth conversation has lost its third node, so what hangs below it is unreached.
BRANCHED = """k AS (SELECT conv_id, turn - min(turn) OVER (PARTITION BY conv_id) AS k FROM conversations),
e AS (SELECT conv_id, k, CASE WHEN k > 0 THEN (k - 1) // 2 END AS parent FROM k WHERE NOT (conv_id % 5 = 0 AND k = 2))"""


@register("reply_tree_branches", operators=("S8",), sql=f"""
WITH RECURSIVE {BRANCHED},
t AS (SELECT conv_id, k, 0 AS depth, [k] AS path FROM e WHERE parent IS NULL
      UNION ALL SELECT e.conv_id, e.k, depth + 1, list_append(path, e.k) FROM e JOIN t ON e.conv_id = t.conv_id AND e.parent = t.k)
SELECT conv_id, CAST(k AS BIGINT) AS k, CAST(depth AS BIGINT) AS depth, array_to_string(path, '/') AS path,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS BIGINT) AS seq, 'ok' AS lane FROM t
UNION ALL
SELECT e.conv_id, CAST(e.k AS BIGINT), NULL, NULL, NULL, 'unreached' FROM e LEFT JOIN t ON e.conv_id = t.conv_id AND e.k = t.k
WHERE t.k IS NULL
""")
def reply_tree_branches(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    first = conv.groupBy("conv_id").agg(F.min("turn").alias("_t0"))
    k = conv.join(first, "conv_id").select("conv_id", (F.col("turn") - F.col("_t0")).cast("long").alias("k"))
    edges = k.where(~((F.col("conv_id") % 5 == 0) & (F.col("k") == 2))).withColumn(
        "parent", F.when(F.col("k") > 0, F.floor((F.col("k") - 1) / 2)))
    out = tree.tree_paths(edges, "conv_id", "k", "parent", "k")
    return out.select("conv_id", "k", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "seq", "lane")


# Forests with several roots, siblings against the order of their ids, orphans and cycles: node k of a
# conversation replies to node (k - 1) / 3, in falling order of k among siblings; every fourth node of
# every third conversation starts a thread of its own, in every fifth conversation what replied to node 1
# lost it, and in every seventh nodes 1 and 2 reply to each other.
FOREST = """k AS (SELECT conv_id, turn - min(turn) OVER (PARTITION BY conv_id) AS k FROM conversations),
e AS (SELECT conv_id, k, CASE WHEN k = 0 OR (conv_id % 3 = 0 AND k % 4 = 0) THEN NULL WHEN conv_id % 7 = 0 AND k IN (1, 2) THEN 3 - k
        ELSE (k - 1) // 3 END AS parent
      FROM k WHERE NOT (conv_id % 5 = 0 AND k = 1))"""


@register("reply_forest_order", operators=("S8",), sql=f"""
WITH RECURSIVE {FOREST},
t AS (SELECT conv_id, k, 0 AS depth, [-k] AS path FROM e WHERE parent IS NULL
      UNION ALL SELECT e.conv_id, e.k, depth + 1, list_append(path, -e.k) FROM e JOIN t ON e.conv_id = t.conv_id AND e.parent = t.k)
SELECT conv_id, CAST(k AS BIGINT) AS k, CAST(depth AS BIGINT) AS depth,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS BIGINT) AS seq, 'ok' AS lane FROM t
UNION ALL
SELECT e.conv_id, CAST(e.k AS BIGINT), NULL, NULL, 'unreached' FROM e LEFT JOIN t ON e.conv_id = t.conv_id AND e.k = t.k
WHERE t.k IS NULL
""")
def reply_forest_order(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    first = conv.groupBy("conv_id").agg(F.min("turn").alias("_t0"))
    k = conv.join(first, "conv_id").select("conv_id", (F.col("turn") - F.col("_t0")).cast("long").alias("k"))
    root = (F.col("k") == 0) | ((F.col("conv_id") % 3 == 0) & (F.col("k") % 4 == 0))
    loop = (F.col("conv_id") % 7 == 0) & F.col("k").isin(1, 2)
    edges = k.where(~((F.col("conv_id") % 5 == 0) & (F.col("k") == 1))).select(
        "conv_id", "k", F.when(root, None).when(loop, 3 - F.col("k")).otherwise(F.floor((F.col("k") - 1) / 3)).alias("parent"),
        (-F.col("k")).alias("pos"))
    return tree.tree_order(edges, "conv_id", "k", "parent", "pos")
