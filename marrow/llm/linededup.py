"""Line dedup with a deletion-neighbourhood join, in DataFrame functions only.

A line is its lower-cased words ``[^\\x20\\x09-\\x0D]+``.  It is dropped if an
earlier line of the corpus equals it, or, from ``near_words`` words on, lies
within one edit of it (a word inserted, deleted or replaced).  Earlier means
the order by key, text hash and line number, nulls first.  Lines of fewer than
``min_words`` words are always kept.

The deletion neighbourhood of a line of n words is the line itself and its n
variants without one word, each as a 128-bit hash.  Two lines are within one
edit exactly if they share a variant without the same place (replaced word), or
if one line is a variant of the other (inserted word).  In the first case all
lines of a variant and place are within one edit of each other, in the second
all meet in one line; so each line is compared with the earliest of its group
only, and no group is ever expanded into pairs.  Hits are verified on the words.

What keeps it affordable: equal lines are one row from the start (aggregated
before the shuffle); variants are made only for lines that share the words of
their first or second half with another line, which no two lines within one
edit can fail to do; all hashes of a line's variants come from two running
XORs over its words, so long lines cost linear time; and ``dedup`` moves the
text of those documents only that may lose a line.

Defined results: a null text has no lines and stays null; an empty text has one
line without words; rows equal in key and text are one document (they keep the
same lines); an empty table gives no rows; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrow.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 4
NEAR_WORDS = 10


def normal_lines(text: Column) -> Column:
    """The lines of a text, each as its lower-cased words joined by single spaces."""
    low = F.lower(text)
    odd = F.startswith(low, F.lit(" ")) | F.endswith(low, F.lit(" "))
    for sign in ("  ", " \n", "\n ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains(low, F.lit(sign))
    lines = F.split(low, "\n")
    # most texts are in this form already; the pattern is only for the others
    return F.when(odd, F.transform(lines, lambda line: F.array_join(
        F.regexp_extract_all(line, F.lit(WORD), F.lit(0)), " "))).otherwise(lines)


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rid, line_no, line, h): every normal line with the first half of its identity."""
    body = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("rid"), normal_lines(F.col(text)).alias("body"))
    lines = body.select("key", "rid", F.posexplode("body").alias("line_no", "line"))
    return lines.select("*", F.xxhash64("line").alias("h"))


def _second_half() -> Column:
    return F.xxhash64(F.lit(1), "line")


def _n_words() -> Column:
    spaces = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    return F.when(F.col("line") == "", 0).otherwise(spaces + 1)


def _half_keys(near_words: int) -> list[Column]:
    """Hashes of a line's halves, for its own length and for one word less; lines within one
    edit share one of them."""
    n = F.col("n")
    out = []
    for v, least in ((n, near_words), (n - 1, near_words + 1)):
        h = F.floor(v / 2).cast("int")
        for side, words in ((0, h), (1, h - v)):
            part = F.call_function("substring_index", F.col("line"), F.lit(" "), words)
            out.append(F.when(n >= least, F.xxhash64(F.lit(side), v, part)))
    return out


def _within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays are at most one word edit apart: the longest common prefix and
    the longest common suffix together leave at most one word of the longer one."""
    na, nb = F.size(a), F.size(b)
    least, most = F.least(na, nb), F.greatest(na, nb)

    def common(x: Column, y: Column) -> Column:
        differs = F.zip_with(F.slice(x, F.lit(1), least), F.slice(y, F.lit(1), least), lambda p, q: p != q)
        at = F.array_position(differs, True)
        return F.when(at == 0, least).otherwise((at - 1).cast("int"))

    both = common(a, b) + common(F.reverse(a), F.reverse(b))
    return (most - least <= 1) & (both >= most - 1)


#: Bits of a map that tells which hashes are wanted (2 MB, whatever the input).
MAP_BITS = 1 << 24


def _place_in_map(hashed: Column) -> tuple[Column, Column]:
    """The word of a bit map that a hash belongs to, and its bit there."""
    low = hashed.bitwiseAND(F.lit(MAP_BITS - 1).cast("long"))
    bit = F.lit(1).cast("long")
    for k in range(6):  # 1 << (low & 63), step by step: shiftleft takes fixed steps only
        bit = F.when(low.bitwiseAND(F.lit(1 << k).cast("long")) != 0, F.shiftleft(bit, 1 << k)).otherwise(bit)
    return F.shiftright(low, 6), bit


def _wanted_map(wanted: DataFrame, name: str) -> Column:
    """A bit map of the low bits of all wanted hashes, as a scalar of fixed size."""
    word, bit = _place_in_map(F.col(name))
    bits = wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    dense = wanted.sparkSession.range(MAP_BITS // 64).join(bits, F.col("id") == F.col("word"), "left")
    row = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return dense.agg(F.transform(row, lambda s: s["bits"])).scalar()


def _in_map(bit_map: Column, hashed: Column) -> Column:
    word, bit = _place_in_map(hashed)
    return F.get(bit_map, word.cast("int")).bitwiseAND(bit) != 0


def _candidates(distinct: DataFrame, near_words: int) -> DataFrame:
    """(h, g): distinct lines that share a half with another one."""
    # dealt once, for the groups and for the join with them
    halves = distinct.filter(F.col("n") >= near_words).select(
        "h", "g", F.explode(F.array(*(f"half{k}" for k in range(4)))).alias("half")
    ).filter("half is not null").repartition("half")
    ends = [end(name).alias(f"{end.__name__}_{name}") for name in ("h", "g") for end in (F.min, F.max)]
    shared = halves.groupBy("half").agg(*ends).filter("min_h <> max_h or min_g <> max_g").select("half")
    return halves.join(shared, "half").select("h", "g").distinct()


def _whole_hash(words: Column, seed: int) -> Column:
    """The hash of all words of a line at their places, and of their number."""
    each = F.transform(words, lambda word, k: F.xxhash64(F.lit(seed), word, k))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b)).bitwiseXOR(
        F.xxhash64(F.size(words).cast("long")))


def _near_drops(docs: DataFrame, firsts: DataFrame, key: str, text: str) -> DataFrame:
    """(h, g): lines of ``firsts`` (h, g, place) that have an earlier one within one edit."""
    # the text of the candidates, once each: from the line's first place; bit maps spare most
    # other documents the work, and most other lines the shuffle
    held = docs.filter(_in_map(_wanted_map(firsts.select("place.rid"), "rid"), F.xxhash64(text)))
    found = _lines(held, key, text).filter(_in_map(_wanted_map(firsts, "h"), F.col("h"))).select(
        "h", _second_half().alias("g"), "line", F.struct("key", "rid", "line_no").alias("at"))
    found = found.join(firsts, ["h", "g"]).filter(F.col("at").eqNullSafe(F.col("place"))).dropDuplicates(["h", "g"])
    # sorted by place, so that smaller ids stand for earlier lines
    found = found.select("h", "g", "line", "place").orderBy("place").select(
        F.monotonically_increasing_id().alias("id"), "h", "g", "line").checkpoint()

    each = found.repartition("id").select("id", F.posexplode(F.split("line", " ")).alias("k", "word"))
    each = each.select("id", "k", *(F.xxhash64(F.lit(seed), "word", F.col("k") - back).alias(f"x{seed}{back}")
                                    for seed in (2, 3) for back in (0, 1)))
    whole_line = Window.partitionBy("id")
    upto = whole_line.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(whole_line)
    # without place k: words before it where they are, words after it one place earlier; and the length
    each = each.select("id", "k", *(
        F.bit_xor(f"x{s}0").over(upto).bitwiseXOR(F.col(f"x{s}0")).bitwiseXOR(F.bit_xor(f"x{s}1").over(upto))
        .bitwiseXOR(F.bit_xor(f"x{s}1").over(whole_line)).bitwiseXOR(F.xxhash64(n - 1)).alias(f"v{s}") for s in (2, 3)))
    # dealt once, for the groups and for the join with them and with the whole lines
    variants = each.select("v2", "v3", "k", "id").repartition("v2", "v3")
    groups = variants.groupBy("v2", "v3", "k").agg(F.min("id").alias("leader"), F.count("*").alias("lines"))
    groups = groups.filter("lines > 1").select("v2", "v3", F.col("k").alias("at"), F.col("leader").alias("other"))
    whole = found.select(*(_whole_hash(F.split("line", " "), s).alias(f"v{s}") for s in (2, 3)),
                         F.lit(None).cast("int").alias("at"), F.col("id").alias("other"))
    met = variants.join(groups.union(whole), ["v2", "v3"])
    # a replaced word (same place, the group's first line) or an inserted one (a whole line)
    met = met.filter("at is null or (k - at = 0 and id <> other)")
    pairs = met.select(F.greatest("id", "other").alias("later"), F.least("id", "other").alias("earlier")).distinct()
    mine = found.select(F.col("id").alias("later"), "h", "g", F.col("line").alias("mine"))
    theirs = found.select(F.col("id").alias("earlier"), F.col("line").alias("theirs"))
    return (pairs.join(mine, "later").join(theirs, "earlier")
            .filter(_within_one_edit(F.split("mine", " "), F.split("theirs", " "))).select("h", "g").distinct())


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                  near_words: int = NEAR_WORDS, edit_bound: int = 1) -> DataFrame:
    """(key, rid, dropped): per document the ascending numbers of its dropped lines; documents
    that lose nothing are missing.  ``rid`` is xxhash64 of the text."""
    if edit_bound not in (0, 1):
        raise ValueError("edit_bound is 0 or 1")
    if near_words < 2:
        raise ValueError("near_words is at least 2")
    checkpoint_dir(docs.sparkSession)
    halves = [half.alias(f"half{k}") for k, half in enumerate(_half_keys(near_words))]
    # without texts: read several times
    lines = _lines(docs, key, text).withColumn("n", _n_words()).filter(F.col("n") >= min_words).select(
        "key", "rid", "line_no", "n", "h", _second_half().alias("g"), *halves).checkpoint()
    distinct = lines.groupBy("h", "g").agg(
        F.min(F.struct("key", "rid", "line_no")).alias("first"), F.count("*").alias("lines"), F.max("n").alias("n"),
        *(F.max(f"half{k}").alias(f"half{k}") for k in range(4)))
    if edit_bound:
        # lines that come once and share no half lose nothing
        may = _candidates(distinct, near_words).withColumn("may", F.lit(True))
        firsts = distinct.select("h", "g", "first", "lines").join(may, ["h", "g"], "left").filter("may or lines > 1")
        firsts = firsts.checkpoint()
        near = _near_drops(docs, firsts.filter("may").select("h", "g", F.col("first").alias("place")), key, text)
        verdict = firsts.drop("may").join(near.withColumn("near", F.lit(True)), ["h", "g"], "left")
    else:
        verdict = distinct.select("h", "g", "first", "lines", F.lit(None).cast("boolean").alias("near"))
    # only lines that somewhere lose a copy matter from here on
    verdict = verdict.filter("near or lines > 1").select("h", "g", "first", F.coalesce("near", F.lit(False)).alias("near"))
    lost = lines.select("key", "rid", "line_no", "h", "g").join(verdict, ["h", "g"]).filter(
        F.col("near") | ~F.struct("key", "rid", "line_no").eqNullSafe(F.col("first")))
    return lost.groupBy("key", "rid").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """One row per document: key, n_lines, n_dropped, dropped (line numbers from 0)."""
    lost = dropped_lines(docs, key, text, **limits)
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("rid"),
                       F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).alias("lines"), F.col(text).isNull().alias("none"))
    rows = rows.join(lost.withColumnRenamed("key", "lost_key").withColumnRenamed("rid", "lost_rid"),
                     F.col("key").eqNullSafe(F.col("lost_key")) & (F.col("rid") == F.col("lost_rid")), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return rows.select(
        F.col("key").alias(key), F.when(F.col("none"), 0).otherwise(F.col("lines")).cast("long").alias("n_lines"),
        F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """The documents without their dropped lines; those left without any word go, unless they had none before."""
    lost = dropped_lines(docs, key, text, **limits)
    names = {c.lower() for c in docs.columns}
    mine = {c: c if c not in names else f"_{c}_{len(names)}" for c in ("lost_key", "lost_rid", "dropped")}
    lost = lost.select(F.col("key").alias(mine["lost_key"]), F.col("rid").alias(mine["lost_rid"]),
                       F.col("dropped").alias(mine["dropped"])).checkpoint()
    # most documents that lose nothing stay where they are; a bit map tells
    may_lose = _in_map(_wanted_map(lost, mine["lost_rid"]), F.xxhash64(docs[text]))
    rows = docs.filter(may_lose).join(lost, docs[key].eqNullSafe(F.col(mine["lost_key"]))
                                      & (F.xxhash64(docs[text]) == F.col(mine["lost_rid"])), "left")
    dropped = F.col(mine["dropped"])
    kept = F.filter(F.split(docs[text], "\n"), lambda line, i: ~F.array_contains(dropped, i))
    rows = rows.withColumn(text, F.when(dropped.isNull(), docs[text]).otherwise(F.array_join(kept, "\n")))
    rows = rows.filter(dropped.isNull() | F.col(text).rlike(WORD)).select(*docs.columns)
    return docs.filter(~may_lose).union(rows)
