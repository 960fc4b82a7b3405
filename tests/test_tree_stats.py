"""Reply trees (1, 2 and 150 levels, replies given as ''), listings, and corpus statistics."""
import json

from pyspark.sql import functions as F

from marrow.operators import stats, tree
from tests.conftest import rows


def test_reply_rows_leave_a_task_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(tree, "REPLY_CHARS", 50)
    docs = [(k, json.dumps([{"kind": "t1", "data": {"author": "a", "body": "x" * i, "score": i}} for i in range(k)])) for k in range(30)]
    df = spark.createDataFrame([*docs, (None, docs[2][1]), (40, '[{"kind": "t1", "data": {"author": 7, "body": [1]}}]'), (41, None)], "k INT, j STRING")
    out = tree.flatten_reply_trees(df.coalesce(1), "j", ["k"])
    got = sorted([tuple(r) for r in out.collect()], key=str)
    want = [(k, i, 0, "a", "x" * i, float(i), "ok") for k, n in [*((k, k) for k in range(30)), (None, 2)] for i in range(n)]
    assert got == sorted([*want, (40, 0, 0, "7", "[1]", None, "ok")], key=str)
    assert "UDTF" not in out._jdf.queryExecution().optimizedPlan().toString()


def _node(name, children=None, kind="t1"):
    rep = {"data": {"children": children}} if children is not None else ""
    return {"kind": kind, "data": {"author": name, "body": f"b {name}", "score": 1, "replies": rep}}


def _chain(depth):
    node = _node(f"n{depth - 1}")
    for d in range(depth - 2, -1, -1):
        node = _node(f"n{d}", [node])
    return [node]


def test_flatten_reply_trees(spark):
    forest = [_node("a", [_node("a1", [_node("a11")]), _node("x", [_node("hidden")], kind="more"), _node("a2")]),
              _node("b")]
    docs = [(1, json.dumps(_chain(1))), (2, json.dumps(_chain(2))), (150, json.dumps(_chain(150))),
            (9, json.dumps(forest))]
    df = spark.createDataFrame(docs, "post INT, j STRING")
    out = tree.flatten_reply_trees(df, "j", ["post"])
    got = {p: [(r.seq, r.depth, r.author) for r in sorted(out.where(F.col("post") == p).collect(),
                                                         key=lambda r: r.seq)] for p in (1, 2, 150, 9)}
    assert got[1] == [(0, 0, "n0")]
    assert got[2] == [(0, 0, "n0"), (1, 1, "n1")]
    assert len(got[150]) == 150 and got[150][-1] == (149, 149, "n149")
    assert got[9] == [(0, 0, "a"), (1, 1, "a1"), (2, 2, "a11"), (3, 1, "a2"), (4, 0, "b")]


def test_tree_paths_preorder(spark):
    # forest: r1 -> (c1 -> g1, c2); r2
    edges = [(1, 10, None, 0), (1, 11, 10, 0), (1, 12, 10, 1), (1, 13, 11, 0), (2, 20, None, 0)]
    df = spark.createDataFrame(edges, "t INT, n INT, p INT, pos INT")
    out = rows(tree.tree_paths(df, "t", "n", "p", "pos"), "t", "n", "depth", "seq")
    assert out == [(1, 10, 0, 0), (1, 11, 1, 1), (1, 12, 1, 3), (1, 13, 2, 2), (2, 20, 0, 0)]


def test_chain_to_tree_json_roundtrip(spark):
    turns = spark.createDataFrame([(1, 0, "user", 'say "hi"'), (1, 1, "bot", "ok\nfine"), (2, 0, "u", "x")],
                                  "c INT, turn INT, role STRING, text STRING")
    trees = tree.chain_to_tree_json(turns, "c", "turn", "role", "text")
    out = rows(tree.flatten_reply_trees(trees, "tree_json", ["c"]), "c", "seq", "depth", "author", "body")
    assert out == [(1, 0, 0, "user", 'say "hi"'), (1, 1, 1, "bot", "ok\nfine"), (2, 0, 0, "u", "x")]


def test_listing_normalisers(spark):
    posts = spark.createDataFrame(
        [("t", "a", "/r/x/1", 5, 2, 1.0, "image", "http://i/1.png", "self", None),
         ("u", "b", "/r/x/2", 1, 0, 2.0, None, "http://l", "http://th", {"images": [{"source": {"url": "http://p/2"}}]})],
        tree.POST_LISTING_SCHEMA)
    got = rows(tree.normalise_posts(posts), "title", "image_url", "thumbnail_url")
    assert got == [("t", "http://i/1.png", None), ("u", "http://p/2", "http://th")]
    listing = spark.createDataFrame([({"children": [{"data": {"title": "T", "permalink": "/r/a", "selftext": "x" * 300}}]},)],
                                    tree.SEARCH_SCHEMA)
    s = tree.flatten_search(listing).collect()[0]
    assert s.link == "https://www.reddit.com/r/a" and len(s.description) == 269


def test_length_stats(spark):
    df = spark.createDataFrame([("s", "a"), ("s", "a b"), ("s", "a b c d"), ("s", " ".join("x" * 10))],
                               "split STRING, text STRING")
    r = stats.length_distribution(df).collect()[0]
    assert (r.min_len, r.p25_len, r.median_len, r.p75_len, r.max_len) == (1, 1, 3, 5, 10)  # 1.75, 3, 5.5
    w = stats.length_whiskers(df).collect()[0]
    assert (w.q1, w.median, w.q3) == (1.75, 3.0, 5.5)


def test_crosstab_totals(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "dev"), ("b", "train")], "category STRING, split STRING")
    got = rows(stats.category_split_crosstab(df), "category", "train", "dev", "test", "total")
    assert got == [("Total", 2, 1, 0, 3), ("a", 1, 1, 0, 2), ("b", 1, 0, 0, 1)]
    share = {r.category: r.share_pct for r in stats.category_share(df).collect()}
    assert abs(share["a"] - 200 / 3) < 1e-9


def test_deep_chains_orphans_and_cycles(spark):
    chain = [("deep", i, i - 1 if i else None) for i in range(300)]
    odd = [("odd", 0, None), ("odd", 1, 0), ("odd", 2, 99), ("odd", 3, 2), ("odd", 4, 5), ("odd", 5, 4), ("odd", 6, 5)]
    df = spark.createDataFrame(chain + odd, "t STRING, n INT, p INT")
    out = {(r.t, r.n): (r.depth, r.seq, r.lane) for r in tree.tree_paths(df, "t", "n", "p", "n").collect()}
    assert len(out) == 307
    assert all(out["deep", i] == (i, i, "ok") for i in range(300))
    assert out["odd", 1] == (1, 1, "ok") and all(out["odd", i] == (None, None, "unreached") for i in range(2, 7))


def test_malformed_documents_are_reported(spark):
    df = spark.createDataFrame([(1, "{not json"), (2, None), (3, "[]")], "k INT, j STRING")
    assert rows(tree.flatten_reply_trees(df, "j", ["k"]), "k", "body", "lane") == [(1, "{not json", "error")]


def brute_order(rows):
    """{row number: (depth, seq)} of (tree, node, parent, pos) rows by a walk with a stack."""
    kids = {}
    for i, (t, n, up, pos) in enumerate(rows):
        kids.setdefault((t, up), []).append((pos, n, i))
    out = {}
    for t in {r[0] for r in rows}:
        seq, stack = 0, [(i, 0) for _, _, i in sorted(kids.get((t, None), []), reverse=True)]
        while stack:
            i, depth = stack.pop()
            out[i] = (depth, seq)
            seq += 1
            stack += [(j, depth + 1) for _, _, j in sorted(kids.get((t, rows[i][1]), []), reverse=True)]
    return out


def test_tree_order_on_random_forests(spark):
    import random

    rng = random.Random(8)
    rows = []
    for t in range(30):
        n = rng.randint(1, 60)
        for k in range(n):
            up = None if rng.random() < 0.1 or k == 0 else rng.choice([rng.randrange(k), k - 1, rng.randrange(n), 1000])
            rows.append((t if t else None, k, up if up != k else None, rng.randrange(5)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "thread int, node int, up int, pos int").repartition(4)
    got = {(r.thread, r.node): (r.depth, r.seq, r.lane) for r in tree.tree_order(df, "thread", "node", "up", "pos").collect()}
    want = brute_order(rows)
    assert len(got) == len(rows)
    for i, (t, n, _, _) in enumerate(rows):
        assert got[t, n] == ((*want[i], "ok") if i in want else (None, None, "unreached"))
    assert len({lane for _, _, lane in got.values()}) == 2


def test_tree_order_of_deep_and_wide_threads(spark):
    n = 20000
    deep = spark.range(n).select(F.lit("deep").alias("t"), "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"))
    wide = spark.range(n).select(F.lit("wide").alias("t"), "id", F.when(F.col("id") > 0, F.lit(0)).cast("long").alias("up"))
    got = tree.tree_order(deep.unionByName(wide), "t", "id", "up", "id")
    assert not any("array" in f.dataType.simpleString() for f in got.schema)
    assert got.where("lane = 'ok' and seq = id and depth = if(t = 'deep', id, if(id = 0, 0, 1))").count() == 2 * n
    assert tree.tree_order(deep.limit(0), "t", "id", "up", "id").count() == 0


def test_tree_order_of_repeated_and_null_nodes(spark):
    rows = [("a", 1, None, 0), ("a", 1, None, 1), ("a", 2, 1, 0), ("a", None, 1, 1), ("a", 5, 6, 0), ("a", 6, 5, 0)]
    df = spark.createDataFrame(rows, "t string, n int, up int, pos int")
    got = sorted((str(r.n), r.depth, r.seq, r.lane) for r in tree.tree_order(df, "t", "n", "up", "pos").collect())
    assert got == [("1", 0, 0, "ok"), ("1", 0, 3, "ok"), ("2", 1, 1, "ok"), ("5", None, None, "unreached"),
                   ("6", None, None, "unreached"), ("None", 1, 2, "ok")]
