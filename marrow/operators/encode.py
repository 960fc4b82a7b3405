"""Vocabulary, token and label encoding.

Vocabulary ids follow binary word order (the source used set order, which
changes per run).  The vocabulary is ranked with the same range-partition +
prefix-sum scheme as positional ids, so no single task sorts it.  Lookups take
frequent words from a small broadcast table and shuffle only the rare ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.functions import text as tx
from marrow.operators.clean import rank_table

PAD, UNK = "<pad>", "<unk>"
# Fixed label maps of the three tasks (unknown labels are an error lane).
LABEL_MAPS = {
    "toxicity": {"NON-TOXIC": 0, "TOXIC": 1},
    "toxic_type": {"OFFENSIVE": 0, "HATE": 1},
    "expression_type": {"IMPLICIT": 0, "EXPLICIT": 1, "REPORT": 2},
}


def build_vocab(texts: DataFrame, text: str = "text") -> DataFrame:
    """``(word, idx)``: <pad>=0, distinct space-split words 1..n in binary order, <unk>=n+1.

    One row per word: a text that holds ``<pad>`` or ``<unk>`` as a word adds
    nothing, as these have their entries already.  The distinct words are
    ranked once; the ranking's checkpoint is what the vocabulary reads.
    """
    # a text's distinct words only: most tokens repeat one
    words = texts.select(F.explode(F.array_distinct(tx.space_tokens(text))).alias("word")).where(
        ~F.col("word").isin(PAD, UNK)).distinct()
    ranked = rank_table(words, None, "word", "_r")
    body = ranked.select("word", (F.col("_r") + 1).cast("long").alias("idx"))
    spark = texts.sparkSession
    pad = spark.createDataFrame([(PAD, 0)], "word STRING, idx BIGINT")
    unk = body.agg(F.lit(UNK).alias("word"), (F.count(F.lit(1)) + 1).cast("long").alias("idx"))
    return pad.unionByName(body).unionByName(unk)


def invert_vocab(vocab: DataFrame) -> DataFrame:
    """C17: idx -> word."""
    return vocab.select("idx", "word")


#: How many words are looked up without a shuffle, and how many counters find them: a word in more
#: than one of ``HEAVY_COUNTERS`` tokens is among the counted ones.
HEAVY_WORDS, HEAVY_COUNTERS = 1024, 8192


def heavy_words(tokens: DataFrame, word: str = "word", limit: int = HEAVY_WORDS, counters: int = HEAVY_COUNTERS) -> DataFrame:
    """The most frequent words of a column, at most ``limit``, from a mergeable sketch of bounded size
    (one per task, merged once): no word is shuffled or counted exactly."""
    top = tokens.agg(F.expr(f"approx_top_k(`{word}`, {limit}, {counters})").alias("_top"))
    return top.select(F.explode("_top.item").alias("word"))


def encode_tokens(df: DataFrame, vocab: DataFrame, key: str, text: str = "text",
                  out: str = "input_ids", max_len: int | None = None) -> DataFrame:
    """Space-split tokens -> vocabulary ids (unknown -> <unk>), order kept.

    ``key`` must be unique (rows that share one would be merged).  Words follow a
    heavy tail: a few make up most tokens and would each be one join key of
    most rows.  These are found by a sketch and looked up map-side in a table
    of at most ``HEAVY_WORDS`` rows; only the tokens of all other words, none
    of which is frequent, are shuffled to the vocabulary (or meet it
    broadcast, where AQE measures it small).  Ids return to their rows in one
    shuffle; a row's group is bounded by its own tokens.  With ``max_len`` the
    tokens are cropped before the lookup, which leaves the first ``max_len``
    ids as they are.
    """
    unk = vocab.where(F.col("word") == UNK).select(F.max("idx")).scalar()
    known = vocab.where(F.col("word") != UNK)
    toks = tx.space_tokens(text)
    toks = df.select(F.col(key), F.posexplode(F.slice(toks, 1, max_len) if max_len else toks).alias("_p", "word"))
    heavy = heavy_words(toks)
    # at most HEAVY_WORDS rows, whatever the vocabulary
    heavy_ids = F.broadcast(known.join(F.broadcast(heavy), "word", "left_semi"))
    frequent = toks.join(heavy_ids, "word").select(key, "_p", F.col("idx").alias("_id"))
    rare = toks.join(heavy_ids.select("word"), "word", "left_anti").join(known, "word", "left").select(
        key, "_p", F.coalesce("idx", unk).alias("_id"))
    packed = frequent.unionByName(rare).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_p", "_id"))).alias("_l"))
    return packed.select(key, F.transform("_l", lambda s: s["_id"]).alias(out))


def pad_and_mask(ids, max_len: int = 128):
    """C15 + C16: pad with 0 / crop to ``max_len``; mask is 1 where id != 0."""
    col = F.col(ids) if isinstance(ids, str) else ids
    padded = F.slice(F.concat(col, F.array_repeat(F.lit(0).cast("long"), max_len)), 1, max_len)
    return padded, F.transform(padded, lambda x: F.when(x != 0, 1).otherwise(0).cast("long"))


def label_encode(df: DataFrame, task: str, label_col: str = "label", out: str = "label_id") -> DataFrame:
    """C14: label name -> int for the task; unknown names get null and lane 'error'."""
    try:
        mapping = LABEL_MAPS[task]
    except KeyError:
        raise ValueError(f"unsupported task {task!r}; expected one of {sorted(LABEL_MAPS)}")
    from marrow.operators.votes import canonical_label
    lab = canonical_label(label_col)
    expr = F.lit(None).cast("long")
    for name, i in mapping.items():
        expr = F.when(lab == name, F.lit(i).cast("long")).otherwise(expr)
    return (df.withColumn(out, expr)
              .withColumn("lane", F.when(F.col(out).isNull(), "error").otherwise("ok")))


def vocab_vectors(vocab: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Every vocabulary word with its vector; missing words get a zero vector."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    j = vocab.join(vectors.select("word", "vector"), "word", "left")
    return j.select("word", "idx", F.coalesce(F.col("vector"), zero).alias("vector"))


def oov_rate(df: DataFrame, vocab: DataFrame, group: str, text: str = "text") -> DataFrame:
    """U5 extension: tokens (and share) not in the training vocabulary, per group."""
    # counted per (group, word) before the join: a frequent word is one row per group
    toks = df.select(group, F.explode(tx.space_tokens(text)).alias("word")).groupBy(group, "word").agg(
        F.count(F.lit(1)).alias("_n"))
    known = vocab.where(~F.col("word").isin(PAD, UNK)).select("word", F.lit(1).alias("_k"))
    j = toks.join(known, "word", "left")
    return j.groupBy(group).agg(
        F.sum("_n").cast("long").alias("n_tokens"),
        F.sum(F.when(F.col("_k").isNull(), F.col("_n")).otherwise(0)).cast("long").alias("n_oov")) \
        .withColumn("oov_rate", F.col("n_oov") / F.col("n_tokens").cast("double"))
