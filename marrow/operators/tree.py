"""Comment dumps: thread pages, listings, user items and reply trees.

Spark has no recursive struct type, so a reply tree stays a JSON string and
one tree (one row) is flattened in Arrow batches with an explicit stack (no
recursion limit).  Forests stored as edge tables are put in order by their
Euler tours instead, so no tree has to fit in one row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.operators.clean import positional_rank, rank_table
from marrow.session import checkpoint_dir

# Missing fields default the way the source's dict.get(key, default) did (C20):
# ``coalesce(field, default)`` in every normaliser below.

# Fixed values
REDDIT_HOST = "https://www.reddit.com"
DESCRIPTION_CHARS = 269

# ---------------------------------------------------------------------------
# Thread pages (S5): one row per top comment, then its replies.
# ---------------------------------------------------------------------------
THREAD_PAGE_SCHEMA = """items ARRAY<STRUCT<
  snippet: STRUCT<totalReplyCount: BIGINT,
                  topLevelComment: STRUCT<id: STRING, snippet: STRUCT<authorDisplayName: STRING,
                      textDisplay: STRING, likeCount: BIGINT, publishedAt: STRING>>>,
  replies: STRUCT<comments: ARRAY<STRUCT<snippet: STRUCT<authorDisplayName: STRING,
                      textDisplay: STRING, likeCount: BIGINT, publishedAt: STRING>>>>>>"""


def flatten_thread_pages(pages: DataFrame, page_pos: str = "page") -> DataFrame:
    """``(page, item, reply, author, text, likeCount, publishedAt)``; reply 0 = top comment.

    Replies are read from the dump without the source's 100-reply cap.
    """
    items = pages.select(page_pos, F.posexplode("items").alias("item", "it"))

    def row(s):
        return F.struct(s["authorDisplayName"].alias("author"), s["textDisplay"].alias("text"),
                        s["likeCount"].alias("likeCount"), s["publishedAt"].alias("publishedAt"))

    top = F.array(row(F.col("it.snippet.topLevelComment.snippet")))
    reps = F.when(F.col("it.snippet.totalReplyCount") > 0,
                  F.transform(F.coalesce(F.col("it.replies.comments"), F.array()), lambda c: row(c["snippet"])))
    empty = F.array().cast("array<struct<author:string,text:string,likeCount:bigint,publishedAt:string>>")
    allc = F.concat(top, F.coalesce(reps, empty))
    return (items.select(page_pos, "item", F.posexplode(allc).alias("reply", "c"))
                 .select(page_pos, "item", "reply", "c.*"))


# ---------------------------------------------------------------------------
# Listings (S6, S7, S9, S10)
# ---------------------------------------------------------------------------
SEARCH_SCHEMA = "data STRUCT<children: ARRAY<STRUCT<data: STRUCT<title: STRING, permalink: STRING, selftext: STRING>>>>"


def flatten_search(listing: DataFrame) -> DataFrame:
    """Title, absolute link, description = first 269 chars of selftext ('' when absent)."""
    c = listing.select(F.posexplode("data.children").alias("pos", "c"))
    return c.select("pos", F.col("c.data.title").alias("title"),
                    F.concat(F.lit(REDDIT_HOST), F.col("c.data.permalink")).alias("link"),
                    F.substring(F.coalesce(F.col("c.data.selftext"), F.lit("")), 1, DESCRIPTION_CHARS)
                     .alias("description"))


def listing_items(raw: DataFrame, keys: list[str], json_col: str = "json", path: str = "$.data.children") -> DataFrame:
    """``keys`` + (pos, item, lane, raw): the items of listing documents, as VARIANT.

    No schema is fixed, so an item of another kind or with further fields stays whole.  A document
    that is no JSON, or has no array at ``path``, is one row of lane ``error`` with its text in ``raw``."""
    doc = F.try_parse_json(F.col(json_col))
    items = raw.select(*keys, F.col(json_col).alias("_json"), F.try_variant_get(doc, path, "array<variant>").alias("_items"))
    good = items.where(F.col("_items").isNotNull()).select(*keys, F.posexplode("_items").alias("pos", "item"))
    bad = items.where(F.col("_items").isNull()).select(*keys, F.lit(None).cast("int").alias("pos"), F.lit(None).cast("variant").alias("item"),
                                                       F.lit("error").alias("lane"), F.col("_json").alias("raw"))
    return good.select("*", F.lit("ok").alias("lane"), F.lit(None).cast("string").alias("raw")).unionByName(bad)


def _field(name: str, kind: str, item: str = "item") -> F.Column:
    return F.try_variant_get(F.col(item), f"$.data.{name}", kind)


def search_rows(items: DataFrame, keys: list[str]) -> DataFrame:
    """S6 on :func:`listing_items`: title, absolute link and description of every search result."""
    ok = F.col("lane") == "ok"
    link = F.concat(F.lit(REDDIT_HOST), _field("permalink", "string"))
    text = F.substring(F.coalesce(_field("selftext", "string"), F.lit("")), 1, DESCRIPTION_CHARS)
    return items.select(*keys, "pos", _field("title", "string").alias("title"), link.alias("link"),
                        F.when(ok, text).alias("description"), "lane", "raw")


def user_item_columns(items: DataFrame, keys: list[str]) -> DataFrame:
    """The input of :func:`normalise_user_items` from :func:`listing_items` of user pages."""
    data = F.struct(*[_field(c, k).alias(c) for c, k in (
        ("title", "string"), ("subreddit", "string"), ("permalink", "string"), ("body", "string"), ("created_utc", "double"))])
    return items.where("lane = 'ok'").select(
        *keys, "pos", F.try_variant_get("item", "$.kind", "string").alias("kind"), data.alias("data"), "item")


def post_columns(items: DataFrame, keys: list[str]) -> DataFrame:
    """The input of :func:`normalise_posts` from :func:`listing_items` of post listings."""
    plain = [_field(c, k).alias(c) for c, k in (
        ("title", "string"), ("author", "string"), ("permalink", "string"), ("score", "long"), ("num_comments", "long"),
        ("created_utc", "double"), ("post_hint", "string"), ("url", "string"), ("thumbnail", "string"))]
    images = _field("preview", "struct<images: array<struct<source: struct<url: string>>>>")
    return items.where("lane = 'ok'").select(*keys, "pos", *plain, images.alias("preview"))


def post_detail(raw: DataFrame, json_col: str = "json", lanes: bool = False) -> DataFrame:
    """Valid only when the JSON is a list of at least two parts.

    Returns ``title``, ``body`` (selftext or '') and ``comments_json`` (part 1's children, for
    :func:`flatten_reply_trees`).  With ``lanes`` documents that are no JSON, no list or of fewer
    parts stay, in lane ``error``; without, only valid ones are returned."""
    parts = F.try_variant_get(F.try_parse_json(F.col(json_col)), "$", "array<variant>")
    valid = F.coalesce(F.size("_p") >= 2, F.lit(False))
    post = F.get("_p", 0)

    def field(name):
        return F.try_variant_get(post, f"$.data.children[0].data.{name}", "string")

    out = raw.withColumn("_p", parts).select(
        *raw.columns, F.when(valid, field("title")).alias("title"),
        F.when(valid, F.coalesce(field("selftext"), F.lit(""))).alias("body"),
        F.when(valid, F.get_json_object(F.col(json_col), "$[1].data.children")).alias("comments_json"),
        F.when(valid, "ok").otherwise("error").alias("lane"))
    return out if lanes else out.where("lane = 'ok'").drop("lane")


USER_ITEMS_SCHEMA = """kind STRING, data STRUCT<title: STRING, subreddit: STRING, permalink: STRING,
  body: STRING, created_utc: DOUBLE>"""


def normalise_user_items(items: DataFrame, user: str, order: list[str], limit: int,
                         key: str | None = None) -> DataFrame:
    """S9 + W5: the first ``limit`` items per user (every kind counts), then
    t3 -> 'post' rows and t1 -> 'comment' rows; other kinds are dropped.

    ``key`` is a unique item key (default: the user with the order columns)."""
    from marrow.operators.sampling import limit_per_source
    kcols = [user, *order] if key is None else [key]
    keyed = items.withColumn("_k", F.to_json(F.struct(*[F.col(c) for c in kcols])))
    capped = limit_per_source(keyed, user, order, limit, "_k", "_rank")
    d = F.col("data")
    url = F.concat(F.lit(REDDIT_HOST), F.coalesce(d["permalink"], F.lit("")))
    return (capped.where(F.col("kind").isin("t3", "t1"))
                  .select(user, "_rank",
                          F.when(F.col("kind") == "t3", "post").otherwise("comment").alias("type"),
                          F.when(F.col("kind") == "t3", F.coalesce(d["title"], F.lit(""))).alias("title"),
                          F.coalesce(d["subreddit"], F.lit("")).alias("subreddit"),
                          F.when(F.col("kind") == "t1", F.coalesce(d["body"], F.lit(""))).alias("body"),
                          d["created_utc"].alias("created_utc"), url.alias("url"))
                  .withColumnRenamed("_rank", "rank"))


POST_LISTING_SCHEMA = """title STRING, author STRING, permalink STRING, score BIGINT, num_comments BIGINT,
  created_utc DOUBLE, post_hint STRING, url STRING, thumbnail STRING,
  preview STRUCT<images: ARRAY<STRUCT<source: STRUCT<url: STRING>>>>"""


def normalise_posts(posts: DataFrame) -> DataFrame:
    """Six fixed fields, image_url (url for image posts, else first preview image)
    and thumbnail_url unless the thumbnail is 'self'."""
    image = F.coalesce(F.when((F.col("post_hint") == "image") & F.col("url").isNotNull(), F.col("url")),
                       F.get(F.col("preview.images"), 0)["source"]["url"])
    thumb = F.when(F.col("thumbnail") != "self", F.col("thumbnail"))
    return posts.select("title", "author", "permalink", "score", "num_comments", "created_utc",
                        image.alias("image_url"), thumb.alias("thumbnail_url"))


# ---------------------------------------------------------------------------
# Reply trees as JSON (S8): one tree per row, walked in Arrow batches.
# ---------------------------------------------------------------------------
REPLY_COLUMNS = (T.StructType().add("seq", "long").add("depth", "long").add("author", "string").add("body", "string")
                 .add("score", "double").add("lane", "string"))
_REPLY_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
#: characters and rows of replies that a task holds before it passes them on
REPLY_CHARS, REPLY_ROWS = 1 << 20, 10000


def reply_rows(doc: str | None) -> Iterator[tuple]:
    """Pre-order rows of every ``kind == 't1'`` item; ``replies`` may be '' or an object.

    A document that is no JSON gives one row in lane ``error``, with the document as its body."""
    if doc is None:
        return
    try:
        items = json.loads(doc)
    except ValueError:
        yield (None, None, None, doc, None, "error")
        return
    if isinstance(items, dict):
        items = [items]
    stack = [(it, 0) for it in reversed(items or [])]
    seq = 0
    while stack:
        item, depth = stack.pop()
        if not isinstance(item, dict) or item.get("kind") != "t1":
            continue
        data = item.get("data") or {}
        score = data.get("score")
        author, body = (x if x is None or isinstance(x, str) else str(x) for x in (data.get("author", ""), data.get("body", "")))
        yield (seq, depth, author, body,
               float(score) if isinstance(score, (int, float)) and not isinstance(score, bool) else None, "ok")
        seq += 1
        replies = data.get("replies", "")
        if isinstance(replies, dict):
            children = (replies.get("data") or {}).get("children") or []
            stack.extend((c, depth + 1) for c in reversed(children))


def flatten_reply_trees(df: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """``keys + (seq, depth, author, body, score, lane)``, the rows of :func:`reply_rows`.

    A task holds one Arrow batch, one parsed tree and a bounded number of rows."""
    trees = df.select(*keys, F.col(json_col).alias("_doc"))

    def flat(batches):
        for batch in batches:
            at, rows, size = [], [], 0

            def part():
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), _REPLY_TYPES)]
                of = pa.array(at, pa.int64())
                return pa.RecordBatch.from_arrays([*[batch.column(k).take(of) for k in range(len(keys))], *cols],
                                                  names=[*keys, *REPLY_COLUMNS.names])

            docs = batch.column(len(keys))
            for i in range(len(docs)):
                for row in reply_rows(docs[i].as_py()):
                    at.append(i)
                    rows.append(row)
                    size += len(row[3] or "")
                    if size >= REPLY_CHARS or len(rows) >= REPLY_ROWS:
                        yield part()
                        at, rows, size = [], [], 0
            if rows:
                yield part()

    return trees.mapInArrow(flat, T.StructType([*[trees.schema[k] for k in keys], *REPLY_COLUMNS.fields]))


def chain_to_tree_json(turns: DataFrame, tree: str, pos: str, author: str, body: str) -> DataFrame:
    """Assemble a thread in which item n replies to item n-1 into the nested
    listing JSON that :func:`flatten_reply_trees` reads (one row per thread)."""
    node = F.struct(F.col(pos).alias("p"), F.col(author).alias("a"), F.col(body).alias("b"))
    # Deepest item first, so the fold wraps each item around its reply.
    per = turns.groupBy(tree).agg(F.sort_array(F.collect_list(node), asc=False).alias("_n"))
    tree_json = F.aggregate(
        "_n", F.lit(""),
        lambda acc, n: F.concat(
            F.lit('{"kind":"t1","data":'),
            F.regexp_replace(F.to_json(F.struct(n["a"].alias("author"), n["b"].alias("body"),
                                                n["p"].alias("score"))), r"\}$", ""),
            F.lit(',"replies":'),
            F.when(acc == "", F.lit('""')).otherwise(F.concat(F.lit('{"data":{"children":['), acc, F.lit("]}}"))),
            F.lit("}}")))
    return per.select(tree, F.concat(F.lit("["), tree_json, F.lit("]")).alias("tree_json"))


# ---------------------------------------------------------------------------
# Reply forests as edge tables: Euler tour and list ranking (no recursion limit,
# constant state per node).
# ---------------------------------------------------------------------------
def tree_order(edges: DataFrame, tree: str, node: str, parent: str, pos: str) -> DataFrame:
    """(tree, node, depth, seq, lane): depth and pre-order number of every node of a forest.

    ``edges`` has one row per node; roots have a null parent, siblings stand in
    order of ``pos``, then of their id.  Every node gives two events, entering
    and leaving it, and the tour of a tree links them into one list: before
    entering a node comes leaving its previous sibling, or entering its parent;
    before leaving it comes leaving its last child, or entering it.  The list is
    ranked by pointer jumping: an event knows the sums (nodes entered, levels
    gone down) of a stretch of the list that ends with it, and each round joins
    it with the stretch before, so stretches double.  A node entered as the n-th
    has pre-order number n - 1, and the levels are its depth.

    The state is five numbers per event however deep a thread is, and no two
    events wait for the same one, so no join has a hot key, not even below a
    node that holds all replies.  Sibling order is one range-partitioned ranking
    of the forest; the tour takes log2 of twice the largest tree rounds, each
    written once as a reliable checkpoint.

    Nodes that no root leads to (a missing parent, a cycle, or below either)
    have null depth and seq in lane ``unreached``.  Of rows that repeat a node
    the first in sibling order has its children; a null node has none; a null
    tree is a tree.
    """
    checkpoint_dir(edges.sparkSession)
    row = F.struct(F.col(tree).alias("t"), F.col(parent).alias("up"), F.col(pos).alias("pos"), F.col(node).alias("n"),
                   F.monotonically_increasing_id().alias("row"))
    nodes = rank_table(edges.select(row.alias("of")), None, "of", "r").select("of.t", "of.up", "of.n", "r").checkpoint(eager=True)

    # the children of a node are neighbours in that ranking: its first and last one say all
    families = nodes.groupBy("t", "up").agg(F.min("r").alias("first"), F.max("r").alias("last"))
    heads = nodes.where(F.col("n").isNotNull()).groupBy(F.col("t").alias("ht"), F.col("n").alias("hn")).agg(F.min("r").alias("head"))
    families = families.join(heads, F.col("t").eqNullSafe(F.col("ht")) & (F.col("up") == F.col("hn")), "left")
    enter, leave = 2 * F.col("r"), 2 * F.col("r") + 1  # the events of node r
    first = families.select((2 * F.col("first")).alias("at"), (2 * F.col("head")).alias("to"),
                            F.when(F.col("up").isNull(), True).when(F.col("head").isNull(), False).alias("rooted"))
    last = families.where(F.col("head").isNotNull()).select(
        (2 * F.col("head") + 1).alias("at"), (2 * F.col("last") + 1).alias("to"), F.lit(None).cast("boolean").alias("rooted"))
    special = first.unionByName(last)
    events = nodes.select(F.explode(F.array(
        F.struct(enter.alias("id"), (enter - 1).alias("back"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("d")),
        F.struct(leave.alias("id"), enter.alias("back"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("d"))
    )).alias("e")).select("e.*")
    state = events.join(special, F.col("id") == F.col("at"), "left").select(
        "id", F.when(F.col("at").isNull(), F.col("back")).otherwise(F.col("to")).alias("back"), "n", "d", "rooted").checkpoint(eager=True)

    # a list is no longer than twice its tree; what still waits after that goes round a cycle
    largest = nodes.groupBy("t").count().agg(F.max("count")).first()[0] or 0
    for _ in range((2 * largest).bit_length()):
        if state.where(F.col("back").isNotNull()).isEmpty():
            break
        before = state.select(F.col("id").alias("_id"), F.col("back").alias("_back"), F.col("n").alias("_n"),
                              F.col("d").alias("_d"), F.col("rooted").alias("_rooted"))
        zero = F.lit(0).cast("long")
        state = state.join(before, F.col("back") == F.col("_id"), "left").select(
            "id", F.col("_back").alias("back"), (F.col("n") + F.coalesce("_n", zero)).alias("n"),
            (F.col("d") + F.coalesce("_d", zero)).alias("d"), F.coalesce("rooted", "_rooted").alias("rooted")).checkpoint(eager=True)
    reached = F.coalesce(F.col("rooted") & F.col("back").isNull(), F.lit(False))
    ranked = state.where(F.col("id") % 2 == 0).select(
        F.expr("id div 2").alias("_r"), F.when(reached, F.col("d") - 1).alias("depth"), F.when(reached, F.col("n") - 1).alias("seq"),
        F.when(reached, "ok").otherwise("unreached").alias("lane"))
    return nodes.join(ranked, F.col("r") == F.col("_r")).select(
        F.col("t").alias(tree), F.col("n").alias(node), "depth", "seq", "lane")


# ---------------------------------------------------------------------------
# Root paths of a forest: pointer doubling, for callers that want the paths themselves
# (their size is the depth; ``tree_order`` gives depth and order without them).
# ---------------------------------------------------------------------------
def tree_paths(edges: DataFrame, tree: str, node: str, parent: str, pos: str) -> DataFrame:
    """Depth, root path and pre-order sequence of every node of a forest, with its lane.

    ``edges`` has one row per node; roots have a null parent.  Every node knows
    the path below some ancestor; a round joins it with that ancestor's own
    path, so the known stretch doubles and a thread of depth d takes log2(d)
    rounds, each written once as a reliable checkpoint.  The pre-order number
    is the rank of the position path within its tree (range-partitioned, no
    single-task sort).  Nodes that no root leads to (a missing parent, a cycle,
    or below either) keep null depth, path and seq in lane ``unreached``.
    """
    checkpoint_dir(edges.sparkSession)
    state = edges.select(
        F.col(tree).alias("_t"), F.col(node).alias("_n"), F.col(parent).alias("_up"),
        F.array(F.col(pos)).alias("path")).checkpoint(eager=True)
    # a path has no more nodes than its tree, so more rounds would only go round a cycle
    largest = state.groupBy("_t").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(largest - 1, 0).bit_length()):
        above = state.select(F.col("_t").alias("_at"), F.col("_n").alias("_an"), F.col("_up").alias("_next"),
                             F.col("path").alias("_pp"))
        joined = state.join(above, F.col("_t").eqNullSafe(F.col("_at")) & (F.col("_up") == F.col("_an")), "left")
        found = F.col("_an").isNotNull()
        state = joined.select("_t", "_n", F.when(found, F.col("_next")).otherwise(F.col("_up")).alias("_up"),
                              F.when(found, F.concat("_pp", "path")).otherwise(F.col("path")).alias("path")
                              ).checkpoint(eager=True)
        if state.where(F.col("_up").isNotNull()).isEmpty():
            break
    reached = state.where(F.col("_up").isNull()).select("_t", "_n", F.size("path").alias("_d"), "path")
    ranked = positional_rank(reached.select("_t", "_n", "_d", "path"), "_t", "path", "seq")
    good = ranked.select(F.col("_t").alias(tree), F.col("_n").alias(node), (F.col("_d") - 1).cast("long").alias("depth"),
                         "path", "seq", F.lit("ok").alias("lane"))
    lost = state.where(F.col("_up").isNotNull()).select(
        F.col("_t").alias(tree), F.col("_n").alias(node), F.lit(None).cast("long").alias("depth"),
        F.lit(None).cast(state.schema["path"].dataType).alias("path"), F.lit(None).cast("long").alias("seq"),
        F.lit("unreached").alias("lane"))
    return good.unionByName(lost)
