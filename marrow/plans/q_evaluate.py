"""Metrics: ``labels`` (toxic vs quality as a prediction) and ``embeddings`` as 10-class logits."""

from __future__ import annotations

from pyspark.sql import functions as F

from marrow.operators import evaluate as E
from marrow.plans.registry import register
from marrow.sources.tables import table

BIN = "b AS (SELECT doc_id, toxic AS label, quality AS prediction FROM labels)"


def exact_sum_sql(x: str) -> str:
    """The sum of doubles by whole numbers at fixed scales, as in ``marrow.functions.exact``."""
    rest, parts = x, []
    for unit in (20, -10, -40, -70):
        whole = f"round_even({rest} * pow(2e0, {-unit}), 0)"
        parts.append(f"CAST(sum(CAST({whole} AS HUGEINT)) AS DOUBLE) * pow(2e0, {unit})")
        rest = f"({rest} - {whole} * pow(2e0, {unit}))"
    return "(" + " + ".join(parts) + ")"


LOGITS = """lg AS (SELECT vec_id, label, list_transform(range(10), lambda c: list_sum(list_transform(
  list_filter(embedding, lambda x, i: (i - 1) % 10 = c), lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT))) / 1e6) AS logits FROM embeddings),
pr AS (SELECT vec_id, label, CAST(list_position(logits, list_max(logits)) - 1 AS BIGINT) AS prediction, logits FROM lg)"""


def _binary(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"),
                                                 F.col("quality").alias("prediction"))


def _logits(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    # ten sums over all entries, in whole millionths so that they are exact in any order
    lg = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.aggregate(
        F.filter("embedding", lambda x, i: i % 10 == c), F.lit(0).cast("long"),
        lambda total, x: total + F.round(x.cast("double") * 1000000).cast("long")) / F.lit(1e6))
    return e.select("vec_id", "label", lg.alias("logits"), E.argmax(lg).alias("prediction"))


@register("confusion_matrix", operators=("G20",), sql=f"""
WITH {BIN} SELECT label, prediction, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY label, prediction
""")
def confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(_binary(spark, sf_dir))


@register("binary_metrics", operators=("G18",), sql=f"""
WITH {BIN},
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = prediction) AS correct,
             count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
             count(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn FROM b)
SELECT CAST(n AS BIGINT) AS n,
       CASE WHEN n = 0 THEN 0e0 ELSE correct / CAST(n AS DOUBLE) END AS accuracy,
       CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS precision,
       CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS recall,
       CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1
FROM c
""")
def binary_metrics(spark, sf_dir):
    return E.binary_metrics(_binary(spark, sf_dir))


@register("macro_metrics", operators=("G19",), sql=f"""
WITH {LOGITS},
pc AS (SELECT c, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
         SELECT label AS c, count(*) FILTER (WHERE label = prediction) AS tp, 0 AS fp,
                count(*) FILTER (WHERE label <> prediction) AS fn FROM pr GROUP BY label
         UNION ALL
         SELECT prediction, 0, count(*) FILTER (WHERE label <> prediction), 0 FROM pr GROUP BY prediction)
       GROUP BY c),
m AS (SELECT c, tp, fp, fn,
        CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS p,
        CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS r,
        CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END AS f
      FROM pc)
SELECT CAST(count(*) AS BIGINT) AS n_classes, sum(tp) / CAST(sum(tp) + sum(fn) AS DOUBLE) AS accuracy,
       list_reduce(list_prepend(0e0, list(p ORDER BY c)), lambda a, b: a + b) / CAST(count(*) AS DOUBLE) AS macro_precision,
       list_reduce(list_prepend(0e0, list(r ORDER BY c)), lambda a, b: a + b) / CAST(count(*) AS DOUBLE) AS macro_recall,
       list_reduce(list_prepend(0e0, list(f ORDER BY c)), lambda a, b: a + b) / CAST(count(*) AS DOUBLE) AS macro_f1
FROM m
""")
def macro_metrics(spark, sf_dir):
    return E.macro_metrics(_logits(spark, sf_dir))


@register("argmax_prediction", operators=("O7",), sql=f"""
WITH {LOGITS} SELECT vec_id, CAST(label AS BIGINT) AS label, prediction FROM pr
""")
def argmax_prediction(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", F.col("label").cast("long").alias("label"), "prediction")


@register("mean_cross_entropy", operators=("G21",), sql=f"""
WITH {LOGITS},
d AS (SELECT label, list_transform(logits, lambda x: CAST(x AS DOUBLE)) AS l FROM lg),
ce AS (SELECT list_max(l) + ln(list_reduce(list_transform(l, lambda x: exp(x - list_max(l))), lambda a, b: a + b))
              - l[label + 1] AS loss FROM d)
SELECT CAST(count(*) AS BIGINT) AS n, {exact_sum_sql("loss")} / count(loss) AS mean_ce FROM ce
""")
def mean_cross_entropy(spark, sf_dir):
    return E.mean_cross_entropy(_logits(spark, sf_dir), "logits", "label")
