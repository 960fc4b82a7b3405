"""Inputs the operators need, derived from the driver tables by fixed rules.

Every rule is written so that DuckDB can build the identical rows (see
``marrow.plans.oracle``); all of them grow with the driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.sources.tables import table

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
# Annotators and their tie-break rank (first annotator wins a tie).
ANNOTATORS = (("deepseek", 1), ("mistral", 2), ("qwen", 3))
# Label domains per task.
TOXICITY = ("TOXIC", "NON-TOXIC")
TOXIC_TYPE = ("HATE", "OFFENSIVE")
EXPRESSION_TYPE = ("IMPLICIT", "EXPLICIT", "REPORT")
# Markers appended to documents to exercise operators the driver text lacks.
EMOJI_MARKER = " \U0001F602\u2764\ufe0f"  # space, face with tears of joy, red heart + VS16
URL_MARKER = " https://x.example/a?b=c [photo]"
NBSP_MARKER = "lorem\u00a0\u2003ipsum "  # no-break space and em space between two words


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments view of ``documents``: category = source, pos = doc_id."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string")).alias("cid"),
        F.col("doc_id").alias("pos"), F.col("source").alias("category"), "text", "lang")


def split_of(doc_id) -> F.Column:
    """First hex digit of md5(doc_id): 0-1 test, 2-3 dev, else train."""
    d = F.substring(F.md5(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), 1, 1)
    return F.when(d.isin("0", "1"), "test").when(d.isin("2", "3"), "dev").otherwise("train")


def documents_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("split", split_of("doc_id"))


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with injected markers (all rows kept, text rewritten by rule)."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    t1 = (F.when(i % 41 == 1, F.lit("[removed]")).when(i % 41 == 2, F.lit("[deleted]"))
           .when(i % 41 == 3, F.lit("")).otherwise(F.col("text")))
    handle = F.concat(F.lit("@user"), i.cast("string"))
    t2 = (F.when(i % 43 == 1, handle).when(i % 43 == 2, F.concat(handle, F.lit(" "), t1))
           .otherwise(t1))
    t3 = F.concat(t2, F.when(i % 7 == 0, F.lit(EMOJI_MARKER)).otherwise(F.lit("")))
    t4 = F.concat(t3, F.when(i % 11 == 0, F.lit(URL_MARKER)).otherwise(F.lit("")))
    t5 = F.when(i % 13 == 0, F.concat(F.lit(NBSP_MARKER), t4)).otherwise(t4)
    return d.select("doc_id", t5.alias("text"), "lang", "source")


def csv_like_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string view of marked documents where some rows are header copies."""
    d = marked_documents(spark, sf_dir)
    hdr = (F.col("doc_id") % 97) == 5
    return d.select(
        F.col("doc_id").alias("pos"),
        F.when(hdr, "doc_id").otherwise(F.col("doc_id").cast("string")).alias("doc_id"),
        F.when(hdr, "text").otherwise(F.col("text")).alias("text"),
        F.when(hdr, "lang").otherwise(F.col("lang")).alias("lang"),
        F.when(hdr, "source").otherwise(F.col("source")).alias("source"))


def vote_hash(doc_id: str, annotator) -> F.Column:
    """ascii of the first md5 hex digit of ``doc_id|annotator``."""
    return F.ascii(F.substring(F.md5(F.concat(F.col(doc_id).cast("string"), F.lit("|"), annotator)), 1, 1))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels joined to their documents: id, text, category, truth labels."""
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return lab.join(docs, "doc_id").select(
        "doc_id",
        F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string")).alias("id"),
        "text", F.col("source").alias("category"), "toxic", "quality")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long votes ``(id, doc_id, task, annotator, rnk, label, reason)`` for two tasks.

    toxicity: the true ``toxic`` flag, flipped when the annotator hash % 5 == 0.
    expression_type: ``(toxic + hash % 5) % 3`` -> IMPLICIT / EXPLICIT / REPORT.
    """
    base = labelled_documents(spark, sf_dir)
    ann = F.explode(F.array(*[F.struct(F.lit(a).alias("annotator"), F.lit(r).alias("rnk"))
                              for a, r in ANNOTATORS])).alias("a")
    rows = base.select("id", "doc_id", "toxic", ann).select("id", "doc_id", "toxic", "a.*")
    h = vote_hash("doc_id", F.col("annotator"))
    flipped = F.when(h % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    tox = F.when(flipped == 1, "TOXIC").otherwise("NON-TOXIC")
    e = (F.col("toxic") + h % 5) % 3
    expr = F.when(e == 0, "IMPLICIT").when(e == 1, "EXPLICIT").otherwise("REPORT")
    reason = F.concat(F.col("annotator"), F.lit(" on "), F.col("id"))
    one = rows.select("id", "doc_id", "annotator", F.col("rnk").cast("int").alias("rnk"),
                      F.array(F.struct(F.lit("toxicity").alias("task"), tox.alias("label")),
                              F.struct(F.lit("expression_type").alias("task"), expr.alias("label"))).alias("t"),
                      reason.alias("reason"))
    return (one.select("id", "doc_id", "annotator", "rnk", "reason", F.explode("t").alias("t"))
               .select("id", "doc_id", F.col("t.task").alias("task"), "annotator", "rnk",
                       F.col("t.label").alias("label"), "reason"))


def adjudications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjudicator verdicts: the true toxicity label, for every labelled id."""
    base = labelled_documents(spark, sf_dir)
    return base.select("id", F.lit("toxicity").alias("task"),
                       F.when(F.col("toxic") == 1, "TOXIC").otherwise("NON-TOXIC").alias("label"),
                       F.lit("adjudicated").alias("reason"))


def human_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human ``final`` decisions: '' (undecided) when md5(doc_id|final) starts with 0-4."""
    base = labelled_documents(spark, sf_dir)
    undecided = F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|final"))), 1, 1) \
        .isin("0", "1", "2", "3", "4")
    truth = F.when(F.col("toxic") == 1, "TOXIC").otherwise("NON-TOXIC")
    return base.select("id", F.when(undecided, F.lit("")).otherwise(truth).alias("final"))


def replies_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model replies in six shapes, chosen by md5(doc_id|annotator|raw)."""
    v = votes(spark, sf_dir).where(F.col("task") == "toxicity")
    k = F.ascii(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|"),
                                           F.col("annotator"), F.lit("|raw"))), 1, 1)) % 6
    obj = F.concat(F.lit('{"label": "'), F.col("label"), F.lit('", "reason": "'), F.col("reason"), F.lit('"}'))
    obj_brace = F.concat(F.lit('{"label": "'), F.col("label"), F.lit('", "reason": "has } inside"}'))
    raw = (F.when(k == 0, obj)
            .when(k == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
            .when(k == 2, F.concat(F.lit("Here is my answer:\n"), obj, F.lit("\nThanks.")))
            .when(k == 3, obj_brace)
            .when(k == 4, F.concat(F.lit('{"label": "'), F.col("label"), F.lit('", "reason": ')))
            .otherwise(F.col("label")))
    return v.select("id", "annotator", raw.alias("raw"))


def _rule(doc_id: str, annotator: str, tag: str) -> F.Column:
    return F.ascii(F.substring(F.md5(F.concat(F.col(doc_id).cast("string"), F.lit("|"),
                                              F.col(annotator), F.lit("|" + tag))), 1, 1)) % 16


def human_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer sheets: one row per (id, annotator) with ``label_fixed``; some typos ('UNSURE')."""
    v = votes(spark, sf_dir).where(F.col("task") == "toxicity")
    fixed = F.when(_rule("doc_id", "annotator", "fix") == 1, F.lit("UNSURE")).otherwise(F.col("label"))
    return v.select("id", "doc_id", "annotator", "label", fixed.alias("label_fixed"),
                    F.lit("").alias("fixed_reason"))


def votes_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity votes where about one in sixteen (id, annotator) votes is missing."""
    v = votes(spark, sf_dir).where(F.col("task") == "toxicity")
    return v.where(_rule("doc_id", "annotator", "gap") != 0)
