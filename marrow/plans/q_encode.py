"""Vocabulary and encodings; the vocabulary comes from the cleaned training split."""

from __future__ import annotations

from pyspark.sql import functions as F

from marrow.functions import text as tx
from marrow.operators import clean, encode, subword
from marrow.plans import sqltext as S
from marrow.plans.fixtures_sql import HUMAN_REVIEW, SPLIT_DOCS, VOTES
from marrow.plans.registry import register
from marrow.sources import fixtures as fx
from marrow.sources.tables import table

CLEAN_SPLITS = f"""{SPLIT_DOCS},
cd AS (SELECT doc_id, split, {S.clean_text('text')} AS text FROM sdocs)"""

VOCAB_SQL = f"""{CLEAN_SPLITS},
w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM cd WHERE split = 'train'),
vocab AS (SELECT word, CAST(row_number() OVER (ORDER BY word) AS BIGINT) AS idx FROM w
          UNION ALL SELECT '<pad>', 0
          UNION ALL SELECT '<unk>', CAST(count(*) + 1 AS BIGINT) FROM w)"""

ENCODED_SQL = f"""{VOCAB_SQL},
unk AS (SELECT idx FROM vocab WHERE word = '<unk>'),
toks AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word,
                unnest(generate_series(1, len(string_split(text, ' ')))) AS p
         FROM cd WHERE split = 'test'),
enc AS (SELECT t.doc_id, list(coalesce(v.idx, (SELECT idx FROM unk)) ORDER BY t.p) AS ids,
               count(*) FILTER (WHERE v.idx IS NULL) AS n_unk
        FROM toks t LEFT JOIN (SELECT * FROM vocab WHERE word <> '<unk>') v ON t.word = v.word
        GROUP BY t.doc_id)"""


def _clean_splits(spark, sf_dir):
    d = fx.documents_split(spark, sf_dir)
    return d.select("doc_id", "split", clean.clean_text("text").alias("text"))


def _vocab(spark, sf_dir):
    cd = _clean_splits(spark, sf_dir)
    # build_vocab materializes its ranked words once; no second checkpoint is needed.
    return encode.build_vocab(cd.where(F.col("split") == "train"))


def _encoded(spark, sf_dir, max_len):
    cd = _clean_splits(spark, sf_dir)
    return encode.encode_tokens(cd.where(F.col("split") == "test"), _vocab(spark, sf_dir), "doc_id", max_len=max_len)


@register("build_vocab", operators=("G17", "U5", "C9"), sql=f"""
WITH {VOCAB_SQL} SELECT word, idx FROM vocab
""")
def build_vocab(spark, sf_dir):
    return _vocab(spark, sf_dir)


@register("encode_tokens", operators=("J5",), sql=f"""
WITH {ENCODED_SQL}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, CAST(n_unk AS BIGINT) AS n_unk,
       array_to_string(ids, ',') AS input_ids
FROM enc
""")
def encode_tokens(spark, sf_dir):
    vocab = _vocab(spark, sf_dir)
    cd = _clean_splits(spark, sf_dir).where(F.col("split") == "test")
    enc = encode.encode_tokens(cd, vocab, "doc_id")
    unk = vocab.where(F.col("word") == encode.UNK).select(F.max("idx")).scalar()
    enc = enc.withColumn("_unk", unk)
    return enc.select("doc_id", F.size("input_ids").cast("long").alias("n_tokens"),
                      F.size(F.filter("input_ids", lambda x: x == F.col("_unk"))).cast("long").alias("n_unk"),
                      F.array_join("input_ids", ",").alias("input_ids"))


@register("pad_and_mask", operators=("C15", "C16"), sql=f"""
WITH {ENCODED_SQL},
pm AS (SELECT doc_id, list_resize(ids, 128, 0) AS padded FROM enc)
SELECT doc_id, array_to_string(padded, ',') AS input_ids,
       array_to_string(list_transform(padded, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END), ',') AS attention_mask,
       CAST(list_sum(list_transform(padded, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)) AS BIGINT) AS n_attended
FROM pm
""")
def pad_and_mask(spark, sf_dir):
    enc = _encoded(spark, sf_dir, 128)
    padded, mask = encode.pad_and_mask("input_ids", 128)
    out = enc.select("doc_id", padded.alias("ids"), mask.alias("mask"))
    return out.select("doc_id", F.array_join("ids", ",").alias("input_ids"),
                      F.array_join("mask", ",").alias("attention_mask"),
                      F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_attended"))


@register("label_encode", operators=("C14",), sql=f"""
WITH {VOTES}, {HUMAN_REVIEW}
SELECT id, annotator,
       CASE label_fixed WHEN 'NON-TOXIC' THEN 0 WHEN 'TOXIC' THEN 1 END::BIGINT AS label_id,
       CASE WHEN label_fixed IN ('NON-TOXIC', 'TOXIC') THEN 'ok' ELSE 'error' END AS lane
FROM hreview
""")
def label_encode(spark, sf_dir):
    hr = fx.human_review(spark, sf_dir)
    return encode.label_encode(hr, "toxicity", "label_fixed").select("id", "annotator", "label_id", "lane")


@register("vocab_vectors", operators=("J6",), sql=f"""
WITH {VOCAB_SQL},
vec AS (SELECT v.word, e.embedding FROM vocab v JOIN embeddings e ON e.vec_id = v.idx)
SELECT v.word, v.idx,
       CAST(coalesce(vec.embedding[1], 0) AS DOUBLE) AS v0,
       coalesce(list_reduce(list_transform(vec.embedding, lambda x: CAST(x AS DOUBLE)), lambda a, b: a + b), 0e0) AS v_sum,
       CAST(coalesce(len(vec.embedding), 64) AS BIGINT) AS dim
FROM vocab v LEFT JOIN vec ON v.word = vec.word
""")
def vocab_vectors(spark, sf_dir):
    vocab = _vocab(spark, sf_dir)
    emb = table(spark, sf_dir, "embeddings")
    vectors = vocab.join(emb, emb.vec_id == vocab.idx).select("word", F.col("embedding").alias("vector"))
    vv = encode.vocab_vectors(vocab, vectors, 64)
    dbl = F.transform("vector", lambda x: x.cast("double"))
    return vv.select("word", "idx", F.get("vector", 0).cast("double").alias("v0"),
                     F.aggregate(dbl, F.lit(0.0), lambda a, x: a + x).alias("v_sum"),
                     F.size("vector").cast("long").alias("dim"))


@register("oov_rate", operators=("U5",), sql=f"""
WITH {VOCAB_SQL},
toks AS (SELECT split, unnest(string_split(text, ' ')) AS word FROM cd WHERE split <> 'train'),
j AS (SELECT t.split, v.word AS known FROM toks t
      LEFT JOIN (SELECT word FROM vocab WHERE word NOT IN ('<pad>', '<unk>')) v ON t.word = v.word)
SELECT split, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(*) - count(known) AS BIGINT) AS n_oov,
       (count(*) - count(known)) / CAST(count(*) AS DOUBLE) AS oov_rate
FROM j GROUP BY split
""")
def oov_rate(spark, sf_dir):
    cd = _clean_splits(spark, sf_dir)
    return encode.oov_rate(cd.where(F.col("split") != "train"), _vocab(spark, sf_dir), "split")


# Pieces: frequent words of the training texts, and beginnings and endings of up to three letters.
PIECES = f"""{SPLIT_DOCS},
tw AS (SELECT unnest({S.ws_tokens('lower(text)')}) AS word FROM sdocs WHERE split = 'train'),
k AS (SELECT unnest([1, 2, 3]) AS k),
pieces AS (
  (SELECT word AS piece FROM tw GROUP BY word ORDER BY count(*) DESC, word LIMIT 300)
  UNION (SELECT left(word, k) FROM tw, k GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 600)
  UNION (SELECT '##' || right(word, k) FROM tw, k WHERE length(word) > k GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 900)),
subvocab AS (SELECT piece, row_number() OVER (ORDER BY piece) + 3 AS idx FROM pieces)"""


def _pieces(spark, sf_dir):
    docs = fx.documents_split(spark, sf_dir).where("split = 'train'")
    words = docs.select(F.explode(tx.ws_tokens(F.lower(F.col("text")))).alias("word"))

    def top(df, n):
        return df.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "piece").limit(n).select("piece")

    ks = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")
    cut = words.select("word", ks)
    pieces = top(words.select(F.col("word").alias("piece")), 300)
    pieces = pieces.union(top(cut.select(F.expr("left(word, k)").alias("piece")), 600))
    pieces = pieces.union(top(cut.where("char_length(word) > k").select(F.expr("'##' || right(word, k)").alias("piece")), 900)).distinct()
    body = encode.rank_table(pieces, None, "piece", "r").select(F.col("piece").alias("word"), (F.col("r") + 4).alias("idx"))
    marks = spark.createDataFrame([("<pad>", 0), ("<unk>", 1), ("<s>", 2), ("</s>", 3)], "word STRING, idx LONG")
    return marks.unionByName(body)


@register("subword_encode", operators=("X6", "C15", "C16"), sql=f"""
WITH RECURSIVE {PIECES},
t AS (SELECT doc_id, word, p FROM (SELECT doc_id, unnest({S.ws_tokens('lower(text)')}) AS word,
        unnest(range(1, len({S.ws_tokens('lower(text)')}) + 1)) AS p FROM sdocs WHERE split = 'test')
      WHERE p <= 62),
d AS (SELECT DISTINCT word FROM t),
spots AS (SELECT word, a, unnest(range(1, least(length(word) - a + 1, (SELECT max(length(piece)) FROM pieces)) + 1)) AS n
       FROM (SELECT word, unnest(range(1, length(word) + 1)) AS a FROM d)),
m AS (SELECT word, a, max(n) AS n, arg_max(v.idx, n) AS idx FROM spots
      JOIN subvocab v ON v.piece = (CASE WHEN a > 1 THEN '##' ELSE '' END) || substr(word, a, n) GROUP BY word, a),
w AS (SELECT word, CAST(1 AS BIGINT) AS a, CAST([] AS BIGINT[]) AS ids FROM d
      UNION ALL SELECT w.word, w.a + m.n, list_append(w.ids, m.idx) FROM w JOIN m ON m.word = w.word AND m.a = w.a),
c AS (SELECT d.word, coalesce(max(ids) FILTER (WHERE w.a = length(d.word) + 1), [1]) AS ids FROM d JOIN w ON w.word = d.word GROUP BY d.word),
e AS (SELECT doc_id, list_prepend(2, list_append(list_slice(flatten(list(ids ORDER BY p)), 1, 62), 3)) AS ids FROM t JOIN c USING (word) GROUP BY doc_id)
SELECT s.doc_id, array_to_string(list_concat(coalesce(ids, [2, 3]), list_transform(range(64 - len(coalesce(ids, [2, 3]))), lambda x: 0)), ',') AS input_ids,
       CAST(len(coalesce(ids, [2, 3])) AS BIGINT) AS n_used
FROM sdocs s LEFT JOIN e USING (doc_id) WHERE split = 'test'
""")
def subword_encode(spark, sf_dir):
    docs = fx.documents_split(spark, sf_dir).where("split = 'test'").select("doc_id", F.lower("text").alias("text"))
    found = subword.encode_subwords(docs, _pieces(spark, sf_dir), 64, first="<s>", last="</s>")
    return found.select("doc_id", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"),
                        F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_used"))
