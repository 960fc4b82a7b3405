"""op11 (BPE by tree concatenation), op12 (conversation repair), op13 (importance resampling)."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marrow.llm import bpe, convrepair, queries, resampling

VOCABULARY = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"),
              public_tokenizers.PATTERN)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY[1])


# --- op11 -------------------------------------------------------------------------------------

PIECES = ["a", "b", "'s", "'ll", "'", "l", "e", " ", "  ", "\n", "\t", "1", "23", ".", "...", "é", "ß", "中", "文", "😀",
          " the", "ing", "<|endoftext|>", "<|endof", "text|>", "x" * 9, "-", "_", "́", " ", " "]


def test_tree_equals_the_library_on_random_texts(library):
    c, rng = bpe.TreeCodec(*VOCABULARY), random.Random(11)
    for _ in range(1500):
        some = rng.sample(PIECES, rng.randint(1, len(PIECES)))
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 200)))
        want = library.encode(text, add_special_tokens=False).ids
        assert c.encode(text.encode(), rng.choice([4, 16, 50])) == want
        blocks = c.blocks(text.encode(), rng.choice([15, 40, 100]))
        assert b"".join(blocks).decode() == text
        assert c.concatenate([c.encode(b, 16) for b in blocks]) == want
        assert c.decode(want).decode() == library.decode(want, skip_special_tokens=False)
    assert c.grown > 50  # windows did have to grow


@pytest.mark.parametrize("text", ["a" * 50000, "ab" * 30000, "abcdefg" * 9000, " " * 40000, "\n" * 20000 + "x", "中" * 20000,
                                  "😀" * 5000, "'" * 5000, "x'll" * 3000, "0123456789" * 5000])
def test_long_unsplit_texts(library, text):
    c = bpe.TreeCodec(*VOCABULARY)
    assert c.encode(text.encode()) == library.encode(text, add_special_tokens=False).ids
    assert c.joins


def test_every_class_of_character_is_cut_alike(library):
    c = bpe.TreeCodec(*VOCABULARY)
    for i in range(0, 0x20000, 97):
        if not 0xD800 <= i < 0xE000:
            text = f"a{chr(i)}1{chr(i)}.{chr(i)}  {chr(i)}{chr(i)} a"
            assert c.part(text.encode()) == library.encode(text, add_special_tokens=False).ids


def test_encode_and_decode_rows(spark, library):
    long = "".join(random.Random(3).choice(["word ", "x", "é", "\n", "7", "<|endoftext|>"]) for _ in range(30000))
    rows = [(1, "a b", "q"), (1, "a b", "q"), (None, None, "r"), (2, "", None), (3, long, "s"), (3, long, "s"), (4, "don't  go", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(df, *VOCABULARY, spread=5000), *VOCABULARY).collect()
    assert len(got) == len(rows)
    want = sorted((str(k), library.encode(t or "", add_special_tokens=False).ids, t or "") for k, t, _ in rows)
    assert sorted((str(r.doc_id), list(r.ids), r.text) for r in got) == want
    none = bpe.decode(bpe.encode(df.limit(0), *VOCABULARY), *VOCABULARY)
    assert none.columns == ["doc_id", "ids", "text"] and none.count() == 0


def test_odd_ids_and_bytes_decode_as_in_the_library(spark, library):
    ids = [[220, 50256, 99999], [160, 121, 255], [], None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "doc_id int, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode(df, *VOCABULARY).collect()}
    assert got == {i: library.decode(x or [], skip_special_tokens=False) for i, x in enumerate(ids)}
    broken = spark.createDataFrame([(1,)], "doc_id int").select("doc_id", F.expr("cast(x'61ff62' as string)").alias("text"))
    assert bpe.encode(broken, *VOCABULARY).first().ids == library.encode("a�b", add_special_tokens=False).ids


def test_op11_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_bpe_tree(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


# --- op12 -------------------------------------------------------------------------------------

PATTERN = re.compile("(s?(ua)+)?")


def all_repairs(rows):
    """(cost, audit, repaired) of every repair with at most three inserts at a place."""
    found = []

    def go(i, cost, audit, made):
        if i == len(rows):
            shape = "".join(r[:1] for r, _ in made)
            if PATTERN.fullmatch(shape):
                found.append((cost, audit, tuple(made)))
            return
        role, text, fault = rows[i]
        ways = [(2, "D", None)]
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            ways.append((more, "K", (role, text)))
            ways += [(1 + more, "R", (r, text)) for r in ("user", "assistant")]
        for c, op, out in ways:
            for extra in (0, 1, 2):
                for ins in itertools.product(("user", "assistant"), repeat=extra):
                    go(i + 1, cost + c + 5 * extra, audit + op + "I" * extra,
                       made + ([out] if out else []) + [(x, "") for x in ins])

    for extra in (0, 1, 2):
        for ins in itertools.product(("user", "assistant"), repeat=extra):
            go(0, 5 * extra, "I" * extra, [(x, "") for x in ins])
    return min(found)


def searched(rows):
    s, edits = convrepair.Search(), []
    for row in rows:
        edits += s.step(*row)
    cost, rest = s.end()
    edits += rest
    return cost, "".join(op for op, _ in edits), tuple(r for _, r in edits if r), s.peak


def test_search_equals_all_repairs():
    rng = random.Random(12)
    for _ in range(250):
        rows = [(rng.choice(["user", "assistant", "system", "tool", " "]), f"t{i}",
                 rng.choice(["", "", "", "truncated", "truncated", "blank", "duplicate"])) for i in range(rng.randint(0, 3))]
        assert searched(rows)[:3] == all_repairs(rows), rows


def by_strings(rows):
    """The same optimum with whole audits carried along."""
    start, out = {0: (0, "")}, None

    def closed(best):
        for q, t in ((0, 2), (1, 2), (3, 2), (2, 3)):
            if q in best:
                way = (best[q][0] + 5, best[q][1] + "I")
                best[t] = min(best.get(t, way), way)
        return best

    best = closed(start)
    for role, _, fault in rows:
        new = {}

        def offer(q, way):
            new[q] = min(new.get(q, way), way)

        for q, (c, a) in best.items():
            offer(q, (c + 2, a + "D"))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            t = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((q, role[:1]))
            if t is not None:
                offer(t, (c + more, a + "K"))
            offer(3 if q == 2 else 2, (c + more + 1, a + "R"))
        best = closed(new)
    out = min(best[q] for q in (0, 3) if q in best)
    return out


@pytest.mark.parametrize("weights", [(8, 8, 1, 1), (1, 1, 0, 0), (0, 0, 0, 1), (3, 1, 1, 1), (0, 0, 1, 0)])
def test_search_on_long_conversations(weights):
    rng = random.Random(sum(weights))
    for _ in range(25):
        rows = [(rng.choices(["user", "assistant", "system", "tool"], weights)[0], "x",
                 rng.choices(["", "truncated", "blank"], (8, 2, 1))[0]) for _ in range(rng.randint(50, 200))]
        assert searched(rows)[:2] == by_strings(rows)


def test_memory_is_the_unresolved_stretch():
    good = [("user" if i % 2 == 0 else "assistant", f"{i}", "") for i in range(20000)]
    cost, audit, _, peak = searched(good)
    assert cost == 0 and audit == "K" * 20000 and peak < 50
    noisy = [(r, t, "blank" if int(t) % 17 == 0 else "") for r, t, _ in good]
    assert searched(noisy)[3] < 200


def repaired_digest(made):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()


def test_audits_and_repaired_rows_of_odd_tables(spark):
    rows = [(1, 1, "user", "Hi.", 0), (1, 2, "assistant", "Ho.", 0), (1, 4, "assistant", "Ho.", 0), (1, 5, "user", " \n", 0),
            (None, None, None, None, 1), (None, 3, "user", "Cut", 1), (2, 7, "system", "S.", 2), (2, 7, "system", "S.", 2),
            (3, None, "user", "a.", 3), (3, None, "assistant", "b!", 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int")
    got = {r.conv_id: r for r in convrepair.audits(df).collect()}
    assert set(got) == {1, 2, 3, None}
    one = got[1]
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal, one.cost, one.audit) == (1, 1, 1, 0, 1, 4, "KKDD")
    assert one.repaired_sha256 == repaired_digest([("user", "Hi."), ("assistant", "Ho.")])
    assert (got[None].blank, got[None].truncated, got[None].illegal, got[None].audit) == (1, 1, 1, "DD")
    assert (got[2].gaps, got[2].duplicate, got[2].cost, got[2].audit) == (0, 1, 4, "DD")
    # null turns: the assistant row stands first by role, so two rows must go or be renamed
    assert (got[3].gaps, got[3].cost, got[3].audit) == (0, 2, "RR")
    shown = sorted((r.conv_id, r.place, r.role, r.text) for r in convrepair.repair(df).collect() if r.conv_id == 3)
    assert shown == [(3, 0, "user", "b!"), (3, 1, "assistant", "a.")]
    assert convrepair.audits(df.limit(0)).count() == 0 and convrepair.repair(df.limit(0)).count() == 0


def test_conversations_run_over_many_batches(spark):
    n = 25000
    df = spark.range(n).select(F.lit(5).alias("conv_id"), F.col("id").alias("turn"),
                               F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                               F.concat(F.lit("t"), "id", F.lit(".")).alias("text"))
    row = convrepair.audits(df.repartition(7)).first()
    assert (row.cost, len(row.audit), row.gaps) == (0, n, 0) and row.peak < 50
    assert convrepair.repair(df).count() == n


def test_a_conversation_without_rows_stays(spark):
    df = spark.createDataFrame([(9, 1, "user", "x.", False)], "conv_id long, turn long, role string, text string, present boolean")
    row = convrepair.audits(df, present="present").first()
    assert (row.conv_id, row.cost, row.audit, row.illegal, row.repaired_sha256) == (9, 0, "", 0, hashlib.sha256(b"").hexdigest())


# --- op13 -------------------------------------------------------------------------------------


def brute_features(text, orders, buckets):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return words, [zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets
                   for n in range(1, orders + 1) for i in range(len(words) - n + 1)]


def brute_resample(docs, target, percent, min_words, orders, buckets, seed):
    per = [(k, *brute_features(t, orders, buckets)) for k, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for _, _, f in per:
        for b in f:
            s[b] += 1
    for text in target:
        for b in brute_features(text, orders, buckets)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log(((y + 1) * (sum(s) + buckets)) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    rows = []
    for k, w, f in per:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("orders,buckets", [(1, 10000), (3, 50)])
def test_resample_equals_brute_force(spark, orders, buckets):
    rng = random.Random(orders)
    some = ["Alpha", "beta", "Ümlaut", "x1", "É", "中文", "--", "\n", "o'clock", "9"]
    docs = [(i, " ".join(rng.choice(some) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    docs += [(None, None), (None, "alpha beta alpha beta x1 x1"), (500, ""), (501, "alpha beta x1 9 " * 3000), (7, docs[7][1]), (8, "beta " * 40)]
    target = ["alpha beta x1", None, "", "Alpha alpha"]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "doc_id long, text string, rank int, weight int").repartition(5)
    tf = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((tuple(r) for r in resampling.resample(df, tf, 30, 5, orders, buckets, 77).collect()), key=str)
    want = brute_resample(docs, target, 30, 5, orders, buckets, 77)
    assert got == want
    assert sum(r[4] is not None for r in got) > 20


def test_resample_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    assert resampling.resample(none, some).count() == 0
    rows = {r.doc_id: r for r in resampling.resample(some, none, percent=100, min_words=1).collect()}
    assert sorted(r.rank for r in rows.values()) == [1, 2] and rows[1].n_features == 3


# --- the queries against their SQL, on odd rows ----------------------------------------------------


def test_op12_query_equals_its_sql_on_nulls_and_repeated_rows(spark, tmp_path):
    import duckdb

    rng = random.Random(31)
    rows = [(None, None, None, None), (None, 4, "user", None), (7, None, None, "x."), (8, 2, "", "a?"), (8, 2, "", "a?"), (9, 5, "user", "")]
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv + 100, rng.choice([turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "system", "tool", None]),
                         rng.choice(["Yes.", "No!", "cut", " ", "Why? ", None, "über…", "a\nb."])))
    for folder, data in ((tmp_path / "a", rows), (tmp_path / "b", [])):
        spark.createDataFrame(data, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
        got = queries.op12_conversation_repair(spark, str(folder))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet/*.parquet')")
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES['op12_conversation_repair']})").fetchall()
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
        assert len(want) == len({r[0] for r in data})
