"""Raw-format readers and sinks on small files written to a scratch folder."""
import json
import os

from pyspark.sql import functions as F

from marrow.operators import clean, hooks, tree, votes as V
from marrow.sources import sinks, tables
from marrow.streaming.ingest import scratch
from tests.conftest import rows


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_platform_csv_tree(spark):
    root = scratch(spark, "csv")
    _write(f"{root}/religion/youtube/a.csv",
           'author,text,likeCount,publishedAt,video_id\nu1,"@bob hi, ""quoted""\nline two",3,2024,v1\nu2,,1,2024,v1\n')
    _write(f"{root}/religion/youtube/b.csv", "author,text,likeCount,publishedAt,video_id\nu3,NA,0,2024,v2\nu4,ok,0,2024,v2\n")
    _write(f"{root}/links/youtube/c.csv", "author,text,likeCount,publishedAt,video_id\nx,skip me,0,2024,v3\n")
    df = tables.read_platform_csv(spark, root, "youtube")
    out = clean.repair_youtube(df)
    assert rows(out, "category", "file", "text") == [
        ("religion", "a.csv", 'bob hi, "quoted"\nline two'), ("religion", "b.csv", "ok")]


def test_platform_csv_is_read_by_name_into_the_cleaning_chain(spark):
    root = scratch(spark, "csv")
    _write(f"{root}/a/facebook/1.csv", "author,date,text\nbob,2024,first\nann,2024,Second\nann,2024,first\n")
    _write(f"{root}/a/facebook/2.csv", "\ufefftext,author\nNA,x\n#tag third  word,y\n")
    df = tables.read_platform_csv(spark, root, "facebook")
    chain = clean.clean_chain(clean.repair_platform(df, "facebook"))
    assert rows(chain, "id", "text") == [("a_0", "first"), ("a_1", "second"), ("a_3", "third word")]
    _write(f"{root}/b/facebook/3.csv", "author\nx\n")
    try:
        tables.read_platform_csv(spark, root, "facebook")
        raise AssertionError("a file without text was accepted")
    except ValueError as e:
        assert "no column 'text'" in str(e)


def test_tiktok_headers_may_differ(spark):
    root = scratch(spark, "csv")
    _write(f"{root}/a/tiktok/1.csv", "mentions/0,text\n@x,@x hello\n@yy,@yy\n")
    _write(f"{root}/a/tiktok/2.csv", "text,mentions/0,mentions/1\n@x @y,@x,@y\nplain @z,,\n")
    out = clean.repair_platform(tables.read_platform_csv(spark, root, "tiktok"), "tiktok")
    assert rows(out, "file", "text") == [("1.csv", "x hello"), ("2.csv", "plain @z")]


def test_json_rows_folder_and_links(spark):
    root = scratch(spark, "json")
    _write(f"{root}/toxic_nontoxic/train.json", json.dumps([{"id": "a_0", "text": "xin chào"}], ensure_ascii=False))
    _write(f"{root}/toxic_nontoxic/dev.json", json.dumps([{"id": "a_1", "text": "b"}]))
    _write(f"{root}/hate_offensive/train.json", json.dumps([{"id": "a_0", "text": "c"}]))
    df = tables.read_json_folder(spark, root, "id STRING, text STRING")
    assert rows(df, "task", "split", "id") == [("hate_offensive", "train", "a_0"),
                                              ("toxic_nontoxic", "dev", "a_1"), ("toxic_nontoxic", "train", "a_0")]
    one = tables.read_json_rows(spark, f"{root}/toxic_nontoxic/train.json", "id STRING, text STRING")
    assert rows(one) == [("a_0", "xin chào")]
    links = spark.createDataFrame([(1, "youtube", "l1", None), (2, "youtube", "l2", "dead"), (3, "reddit", "l3", None)],
                                  "`No.` INT, Platform STRING, Link STRING, note STRING")
    assert rows(tables.read_link_list(links, "youtube")) == [(1, "l1")]


def test_word_vectors_last_wins(spark):
    root = scratch(spark, "vec")
    _write(f"{root}/v.txt", "a 1 2\nb 3 4\na 5 6\n")
    _write(f"{root}/w.txt", "2 2\nc 7 8\nshort 1\nword x y\n")
    got = {r.word: r.vector for r in tables.read_word_vectors(spark, f"{root}/v.txt", 2).collect()}
    assert got == {"a": [5.0, 6.0], "b": [3.0, 4.0]}
    both = rows(tables.read_word_vectors(spark, f"{root}/w.txt", 2, header=True), "word", "lane")
    assert both == [("c", "ok"), ("short", "error"), ("word", "error")]


def test_thread_pages_and_post_detail(spark):
    def c(a, t):
        return {"snippet": {"authorDisplayName": a, "textDisplay": t, "likeCount": 1, "publishedAt": "x"}}
    page = {"items": [
        {"snippet": {"totalReplyCount": 2, "topLevelComment": {"id": "t1", **c("a", "top")}},
         "replies": {"comments": [c("b", "r1"), c("c", "r2")]}},
        {"snippet": {"totalReplyCount": 0, "topLevelComment": {"id": "t2", **c("d", "solo")}}}]}
    root = scratch(spark, "yt")
    _write(f"{root}/p.json", json.dumps(page))
    pages = spark.read.schema(tree.THREAD_PAGE_SCHEMA).option("multiLine", True).json(f"{root}/p.json") \
        .withColumn("page", F.lit(0))
    out = rows(tree.flatten_thread_pages(pages), "item", "reply", "author")
    assert out == [(0, 0, "a"), (0, 1, "b"), (0, 2, "c"), (1, 0, "d")]
    good = json.dumps([{"data": {"children": [{"kind": "t3", "data": {"title": "T", "selftext": "S"}}]}},
                       {"data": {"children": [{"kind": "t1", "data": {"author": "x", "body": "y", "replies": ""}}]}}])
    raw = spark.createDataFrame([(1, good), (2, json.dumps([{"data": {}}])), (3, "{}")], "k INT, json STRING")
    det = tree.post_detail(raw)
    assert rows(det, "k", "title", "body") == [(1, "T", "S")]
    flat = tree.flatten_reply_trees(det, "comments_json", ["k"])
    assert rows(flat, "k", "author", "body") == [(1, "x", "y")]


def test_user_items_limit_counts_every_kind(spark):
    items = [("u", 0, "t3", {"title": "p", "subreddit": "s", "permalink": "/a", "body": None, "created_utc": 1.0}),
             ("u", 1, "t5", {"title": None, "subreddit": None, "permalink": None, "body": None, "created_utc": None}),
             ("u", 2, "t1", {"title": None, "subreddit": "s", "permalink": "/b", "body": "c", "created_utc": 2.0}),
             ("u", 3, "t1", {"title": None, "subreddit": "s", "permalink": "/c", "body": "d", "created_utc": 3.0})]
    df = spark.createDataFrame(items, f"user STRING, pos INT, {tree.USER_ITEMS_SCHEMA}")
    out = rows(tree.normalise_user_items(df, "user", ["pos"], 3), "type", "url")
    # limit 3 counts the ignored t5 item too, so only one comment survives
    assert out == [("comment", "https://www.reddit.com/b"), ("post", "https://www.reddit.com/a")]


def test_sinks_roundtrip(spark):
    root = scratch(spark, "sink")
    df = spark.createDataFrame([("a_0", "xin chào", "a")], "id STRING, text STRING, category STRING")
    sinks.write_json(df, f"{root}/j")
    assert rows(spark.read.json(f"{root}/j"), "id", "text") == [("a_0", "xin chào")]
    sinks.write_csv(df, f"{root}/c")
    sinks.write_csv(df, f"{root}/c", append=True)
    back = spark.read.option("header", True).csv(f"{root}/c")
    assert back.count() == 2
    sinks.write_stage(df, f"{root}/s", "dedup")
    sinks.write_stage(df.withColumn("text", F.upper("text")), f"{root}/s", "lower")
    assert rows(spark.read.parquet(f"{root}/s"), "stage") == [("dedup",), ("lower",)]
    sinks.append_category(df, f"{root}/k")
    sinks.append_category(df, f"{root}/k")
    assert spark.read.parquet(f"{root}/k").count() == 2


def test_raw_compare_and_subword_hook(spark):
    v = spark.createDataFrame([("1", "a", 1, "TOXIC"), ("1", "b", 2, " TOXIC\n"), ("1", "c", 3, "TOXIC")],
                              "id STRING, annotator STRING, rnk INT, label STRING")
    assert V.vote_summary(v, ("a", "b", "c")).collect()[0].unanimous is True
    assert V.vote_summary(v, ("a", "b", "c"), raw=True).collect()[0].unanimous is False

    def tok(texts, max_len):
        ids = [[len(w) for w in t.split()][:max_len] for t in texts]
        ids = [x + [0] * (max_len - len(x)) for x in ids]
        return {"input_ids": ids, "attention_mask": [[int(i != 0) for i in x] for x in ids]}

    df = spark.createDataFrame([("ab c",), ("a b c d e",)], "text STRING")
    out = [r.encoding.input_ids for r in hooks.encode_with(df, tok, 3).collect()]
    assert sorted(out) == [[1, 1, 1], [2, 1, 0]]


def test_tiktok_csv_mentions_folded(spark):
    root = scratch(spark, "tt")
    _write(f"{root}/sexism/tiktok/t.csv",
           "text,mentions1,mentions2\n@ab @cd,@ab,@cd\n@ab hello there,@ab,\nplain,,\n")
    df = tables.read_platform_csv(spark, root, "tiktok")
    out = rows(clean.repair_tiktok(df), "text")
    assert out == [("ab hello there",), ("plain",)]
