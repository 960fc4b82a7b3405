"""The operators that look at one document at a time, against brute force."""
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marrow.llm import core, pii, repetition, secrets, tokencount, toxicity

#: Texts that every operator must take: null, empty, blank, one word, other scripts, long.
EDGE = [None, "", " \n\t ", "one", "日本語 テキスト 🎉🎉 é́", "a" * 70_000, "x y " * 20_000, "same line\nsame line\n\n", " " * 5000 + "x"]


def frame(spark, texts, **extra):
    """Documents with an id, a text and columns that clash with outputs."""
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    for c in ("n_words", "kept", "key", "spans", "score", "section", "start", "shard"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# --- core ------------------------------------------------------------------------
def test_words_hash_alike_in_any_place():
    texts = ["the cat sat", "cat THE", "", "x the\ncat sat the"]
    scan = core.Scanner(~core.SPACE_BYTE, lower=True)
    buf, offsets = core.buffers(pa.array(texts))
    starts, ends, h, first = scan(buf, offsets)
    words = [buf[s:e].tobytes().lower() for s, e in zip(starts, ends)]
    assert words == [w.encode().lower() for t in texts for w in t.split()]
    seen = {}
    for w, x in zip(words, h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen) and first.tolist() == [0, 3, 5, 5, 10]


def test_chunks_cover_every_row_and_bound_their_size():
    column = pa.array(["a" * 10, None, "b" * 50, "", "c" * 10])
    parts = list(core.chunks(column, limit=25))
    assert [p[:2] for p in parts] == [(0, 2), (2, 4), (4, 5)] or parts[0][0] == 0 and parts[-1][1] == 5
    assert b"".join(p[2].tobytes() for p in parts) == b"a" * 10 + b"b" * 50 + b"c" * 10


# --- 8 repetition ----------------------------------------------------------------
def brute_repetition(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(w)
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and w[i + k] == w[j + k]:
                k += 1
            longest[i] = max(longest[i], k)
    cover = lambda least, size: len({p for i, k in enumerate(longest) if k >= least for p in range(i, i + (size or k))})
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), cover(8, 8),
            cover(4, 0), max(longest, default=0))


def test_suffix_repeats_match_brute_force():
    rng = random.Random(1)
    texts = ["", "a a a a a a a a a a", "é é b\n\n \né é b\n", "# $x ## | x"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 50))) + rng.choice(["", "\n", "\n\na b"]) for _ in range(150)]
    m = repetition.measure(pa.array(texts), repetition.Rules(), spans=True)
    keys = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
    for i, t in enumerate(texts):
        assert tuple(int(m[k][i]) for k in keys) == brute_repetition(t), t
        spans = m["repeat_spans"][i]
        words = [x.span() for x in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        assert sum(any(s["start"] <= a and b <= s["end"] for s in spans) for a, b in words) == m["covered_words"][i]


def test_quality_verdict_and_edges(spark):
    good = " ".join(f"w{i}" for i in range(40))
    looped = " ".join(f"w{i}" for i in range(7)) + " "
    texts = [good, looped * 4, good + " tail", *EDGE]
    got = by_id(repetition.score(frame(spark, texts)))
    assert got[0].kept and not got[1].kept and not any(got[i + 3].kept for i in range(len(EDGE)))
    assert got[1].covered == 1.0 and got[1].base_failed
    kept = repetition.keep_good(frame(spark, texts))
    assert kept.columns == frame(spark, texts).columns and {r.doc_id for r in kept.collect()} == {0, 2}
    assert repetition.score(frame(spark, texts).limit(0)).count() == 0


# --- 5 personal data -------------------------------------------------------------
def brute_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return pii.sp.ordered(out, pii.KINDS)


def test_plain_identifiers_match_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice(rng.choice(["a@.", "0123456789.", "+0123456789 -()", "ab@.c @.1"])) for _ in range(rng.randint(0, 40)))
        assert pii.detect(t) == brute_pii(t), t


@pytest.mark.parametrize("text, kind, source", [
    ("mail john (at) example (dot) com now", "email", "john (at) example (dot) com"),
    ("write to john at example dot com ok", "email", "john at example dot com"),
    ("see jоhn.dоe@mаil.com x", "email", "jоhn.dоe@mаil.com"),
    ("john[at]mail.example[.]org", "email", "john[at]mail.example[.]org"),
    ("call plus one five five five one two three four five six seven", "phone",
     "plus one five five five one two three four five six seven"),
    ("ip one nine two dot one six eight dot one dot seven", "ip", "one nine two dot one six eight dot one dot seven"),
    ("card ４１１１ １１１１ １１１１ １１１１ x", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins", "card",
     "vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins"),
])
def test_disguises_map_back_to_the_source(text, kind, source):
    found = pii.disguised(text, pii.detect(text))
    assert [(k, text[s:e]) for k, s, e in found] == [(kind, source)]


def planted_disguises(rng):
    """(kind, disguise) by form, of random identifiers; every transducer has its forms."""
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(4, 9)))
    digits = dict(zip("0123456789", "zero one two three four five six seven eight nine".split()))
    user, host, top = word(), word(), rng.choice(["com", "org", "net"])
    ip = [str(rng.randint(1, 254)) for _ in range(4)]
    phone = "49" + "".join(rng.choice("0123456789") for _ in range(9))
    return {
        "brackets": ("email", f"{user}[at]{host}[dot]{top}"),
        "parens": ("email", f"{user} (at) {host} (dot) {top}"),
        "bare words": ("email", f"{user} at {host} dot {top}"),
        "Cyrillic": ("email", f"{user}\u0430\u0435\u043e@{host}.{top}"),
        "full width": ("email", "".join(chr(ord(c) + 0xFEE0) for c in f"{user}@{host}.{top}")),
        "spelled phone": ("phone", "+" + " ".join(digits[c] for c in phone)),
        "dotted ip": ("ip", " dot ".join(ip)),
        "bracketed ip": ("ip", "[.]".join(ip)),
    }


def test_disguises_planted_in_texts_of_every_language_are_found():
    import pyarrow.parquet as pq

    rng, tried, found = random.Random(4), {}, {}
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["lang", "text"]).to_pylist()
    for row in docs:
        text = row["text"] or ""
        clean = pii.disguised(text, pii.detect(text))
        assert clean == []  # these texts hold no disguise of their own
        for form, (kind, disguise) in planted_disguises(rng).items():
            words = text.split(" ")
            at = rng.randrange(len(words) + 1)
            before = " ".join(words[:at]) + " "
            whole = before + disguise + " " + " ".join(words[at:])
            got = pii.disguised(whole, pii.detect(whole))
            span = (kind, len(before), len(before) + len(disguise))
            assert all(s < span[2] and e > span[1] for _, s, e in got), (form, disguise)
            tried[form, row["lang"]] = tried.get((form, row["lang"]), 0) + 1
            found[form, row["lang"]] = found.get((form, row["lang"]), 0) + (span in got)
    assert len(tried) == 8 * 4 and all(found[k] >= 0.9 * n for k, n in tried.items()), found


@pytest.mark.parametrize("text", ["look at home.page two three", "a at the b dot of", "555 oh one", "one two three four", "don't, at. dot."])
def test_ordinary_prose_is_left_alone(text):
    assert pii.disguised(text, pii.detect(text)) == []


def test_pii_query_edges(spark):
    texts = ["x a@b.co y", *EDGE, "x a@b.co y"]
    got = by_id(pii.find(frame(spark, texts)))
    assert got[0].spans == "email:2:8" and got[0].n_email == 1 and got[len(texts) - 1].spans == got[0].spans
    assert all(got[i + 1].spans == "" for i in range(len(EDGE)))
    assert pii.mask("x a@b.co y", [("email", 2, 8)]) == "x ****** y"
    assert pii.find(frame(spark, texts).limit(0)).count() == 0


# --- 3 secrets -------------------------------------------------------------------
def brute_secrets(t):
    out = [("assign", *m.span()) for m in re.finditer(
        r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m.group(2)) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
    return secrets.sp.ordered(out, secrets.KINDS)


def test_base_secrets_match_the_patterns():
    rng = random.Random(5)
    parts = ["token", "SECRET", "api_key", "apikey", "passwd", " ", "=", ":", '"', "'", "abcdef12", "AKIA", "ABCDEFGH12345678", "f3ef4d6b2755", "ſecret", "é", "="]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert secrets.detect(t)[0] == brute_secrets(t), t


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 6))
        E, T = rng.normal(size=(n, 3)), rng.normal(size=(3, 3))
        best = max(np.ndindex(*(3,) * n), key=lambda p: T[0, p[0]] + sum(E[i, p[i]] for i in range(n)) + sum(
            T[p[i], p[i + 1]] for i in range(n - 1)) + T[p[-1], 0])
        assert secrets.viterbi(E, T).tolist() == list(best)


def test_pruned_decoding_equals_full_viterbi():
    rng = np.random.default_rng(1)
    model = secrets.Crf(rng.normal(size=(secrets.TABLE, 3)), rng.normal(size=(3, 3)))
    X = rng.integers(0, secrets.TABLE, (400, secrets.N_FEATURES))
    first = np.array([0, 150, 150, 400])
    tags = model.decode(X, first)
    E = model.scores(X)
    assert tags.tolist() == [*secrets.viterbi(E[:150], model.move), *secrets.viterbi(E[150:], model.move)]


def test_gradient_is_the_slope_of_the_likelihood():
    rng = np.random.default_rng(2)
    X, Y = rng.integers(0, 50, (4, 5, 3)), rng.integers(0, 3, (4, 5))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0], [1, 1, 1, 1, 0]], bool)
    model = secrets.Crf(rng.normal(size=(secrets.TABLE, 3)) * 0.1, rng.normal(size=(3, 3)) * 0.1)
    _, g_emit, g_move = secrets.log_likelihood(model, X, Y, mask)
    for table, grad, at in ((model.emit, g_emit, (int(X[0, 0, 0]), 1)), (model.move, g_move, (0, 2)), (model.move, g_move, (1, 0))):
        table[at] += 1e-5
        up = secrets.log_likelihood(model, X, Y, mask)[0]
        table[at] -= 2e-5
        down = secrets.log_likelihood(model, X, Y, mask)[0]
        table[at] += 1e-5
        assert abs((up - down) / 2e-5 - grad[at]) < 1e-5


def test_rare_secrets_are_learnt_wherever_they_are(spark, monkeypatch):
    monkeypatch.setattr(secrets, "SAMPLE_DOCS", 20)
    ids = spark.range(400).select("id", F.xxhash64(F.col("id").cast("string")).alias("at")).orderBy("at").collect()
    last = {r.id for r in ids[-5:]}  # none of them is among the lowest hashes
    texts = [f"some words {i} then token = {'0123456789abcdef' * 2} end" if i in last else f"plain words {i} only here" for i in range(400)]
    windows = secrets.training_windows(frame(spark, texts), "doc_id", "text")
    assert windows.filter(F.col("place") < (1 << 61)).count() >= 5
    assert windows.filter(F.col("place") >= (1 << 61)).count() >= 20


def test_crf_finds_secrets_that_no_pattern_has(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abdefghiou") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [prose(40) + f' token = "{rng.getrandbits(160):040x}" ' + prose(40) for _ in range(250)]
    texts += [prose(60) + f" {rng.getrandbits(50)} 10.1.2.3 " + prose(20) for _ in range(120)]
    model = secrets.train(frame(spark, texts))
    probe = [prose(20) + " token ghp_16C7e42F292c6912E7710c838347Ae178B4a " + prose(20), prose(60)]
    got = by_id(secrets.find(frame(spark, probe + EDGE), model=model))
    assert "crf:" in got[0].spans and got[1].spans == "" and got[0].n_hex == 0
    assert [got[i + 2].spans for i in range(len(EDGE))] == [secrets.sp.written(brute_secrets(t or "")) for t in EDGE]
    # without labelled secrets nothing is added; an empty table gives no rows
    assert by_id(secrets.find(frame(spark, probe[:1])))[0].spans == ""
    assert secrets.find(frame(spark, texts).limit(0)).count() == 0


# --- 1 token counts --------------------------------------------------------------
RANKS, WHOLE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def test_token_spans_are_the_tokenizer_s_own():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WHOLE)
    whole.encode_special_tokens = True
    ours = tokencount.OffsetTokenizer(RANKS, WHOLE, public_tokenizers.PATTERN)
    for t in ["a\n\n\nb 日本🎉語\n x", "\n\n", "it's 12,5% — né", " " * 5000 + "x", "<|endoftext|> x"]:
        begin, end = ours.spans(t.encode())
        assert list(zip(begin.tolist(), end.tolist())) == whole.encode(t, add_special_tokens=False).offsets


def test_attribution_rules_match_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(300):
        cuts = np.sort(rng.choice(np.arange(1, 40), rng.integers(1, 12), replace=False))
        begin, end = np.append(0, cuts), np.append(cuts, 40)
        marks = np.sort(rng.choice(41, 2 * int(rng.integers(0, 5)), replace=False)).reshape(-1, 2)
        starts, ends = marks[:, 0], marks[:, 1]
        got = tokencount.attribute(begin, end, starts, ends)
        s = len(starts)
        first, most, share = [0] * (s + 1), [0] * (s + 1), [0.0] * (s + 1)
        for a, b in zip(begin, end):
            over = [max(0, min(b, y) - max(a, x)) for x, y in zip(starts, ends)]
            first[next((i for i, (x, y) in enumerate(zip(starts, ends)) if x <= a < y), s)] += 1
            most[over.index(max(over)) if over and max(over) else s] += 1
            for i, v in enumerate(over):
                share[i] += v / (b - a)
            share[s] += 1 - sum(over) / (b - a)
        assert got["first"].tolist() == first and got["most"].tolist() == most
        assert np.allclose(got["share"], share) and np.isclose(got["share"].sum(), len(begin))


def test_counts_by_lines_and_by_given_sections(spark):
    args = (RANKS, WHOLE, public_tokenizers.PATTERN)
    texts = ["first line\nsecond\n\n\nlast", *EDGE]
    rows = tokencount.count(frame(spark, texts), *args).collect()
    assert {r.doc_id for r in rows} == set(range(len(texts)))
    for d in range(len(texts)):
        mine = [r for r in rows if r.doc_id == d]
        assert sum(r.n_first for r in mine) == sum(r.n_most for r in mine) == mine[0].n_doc
        assert len(mine) == (texts[d] or "").count("\n") + 1
    sections = spark.createDataFrame([(0, 7, 0, 5), (0, 8, 6, 10), (99, 1, 0, 5)], "doc_id BIGINT, section BIGINT, start BIGINT, end BIGINT")
    got = {r.section: r.n_most for r in tokencount.count(frame(spark, texts[:1]), *args, sections=sections).collect()}
    assert got[7] == 1 and got[8] == 1 and got[-1] == sum(r.n_most for r in rows if r.doc_id == 0) - 2
    assert {r.tokens for r in tokencount.totals(tokencount.count(frame(spark, texts[:1]), *args), "doc_id").collect()} == {rows[0].n_doc if rows[0].doc_id == 0 else next(r.n_doc for r in rows if r.doc_id == 0)}
    assert tokencount.count(frame(spark, texts).limit(0), *args).count() == 0


# --- 4 toxicity ------------------------------------------------------------------
def brute_patterns(classes):
    """The patterns of a clause, straight from their definitions."""
    T = toxicity
    hit = [i for i, c in enumerate(classes) if c in (T.INSULT, T.THREAT)]
    out = T.INSULTED if T.INSULT in classes else 0
    for i in hit:
        # the window counts words since the last opener, which a newer one restarts
        if any(classes[j] == T.NEGATION and i - j <= 3 for j in range(i)):
            out |= T.NEGATED
        if any(classes[j] == T.REPORT for j in range(i)):
            out |= T.REPORTED
        if classes[i] == T.THREAT and any(classes[j] == T.INTENT and i - j <= 4 for j in range(i)):
            out |= T.THREATENED
    if hit and T.TARGET in classes:
        out |= T.TARGETED
    return out


def test_the_composed_machine_finds_every_pattern():
    rng = random.Random(11)
    for _ in range(5000):
        classes = [rng.choice((0, 0, 0, 1, 2, 3, 4, 5, 6)) for _ in range(rng.randint(0, 12))]
        assert toxicity.GRAMMAR(classes) == brute_patterns(classes), classes


def test_toxicity_learns_new_insults_and_ignores_other_columns(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("bdfghklmnoprstu") for _ in range(rng.randint(2, 6)))
    texts, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = [word() for _ in range(30)]
        if bad:
            words[rng.randrange(30)] = rng.choice(["zorgblat", "quixnard"])
        texts.append(" ".join(words))
        labels.append((i, int(bad)))
    docs = frame(spark, texts)
    marks = spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id BIGINT, toxic INT")
    model = toxicity.train(docs, marks)
    assert {"zorgblat", "quixnard"} <= set(model.weights)
    got = by_id(toxicity.score(docs, model).join(docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held")), "doc_id"))
    held = [d for d, r in got.items() if r.held]
    assert held and all((got[d].score >= 0.3) == (d % 4 == 0) for d in held)
    edge = by_id(toxicity.score(frame(spark, EDGE), model))
    assert len({r.score for r in edge.values()}) == 1 and 0 <= edge[0].score < 0.3
    # a label of a held-out row changes nothing
    other = marks.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, other) == model
    # no labels: the fixed seeds
    plain = toxicity.train(docs, marks.limit(0))
    assert plain.score("you are an idiot") > 0.3 > plain.score("a fine day")
    assert plain.score("you idiot") > plain.score("he said not an idiot")
