"""Predictions and classification metrics.

Metrics are aggregates over (label, prediction) pairs: one partial
aggregate per partition, so the confusion counts never leave the executors
row by row.  Ratios use try_divide with 0 for an empty denominator, as the
source's ``zero_division=0``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.functions.exact import exact_mean


def argmax(arr) -> F.Column:
    """0-based index of the first maximum of an array."""
    col = F.col(arr) if isinstance(arr, str) else arr
    return (F.array_position(col, F.array_max(col)) - 1).cast("long")


def _ratio(num, den) -> F.Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Count per (label, prediction)."""
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).cast("long").alias("n"))


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                   positive: int = 1) -> DataFrame:
    """Accuracy, precision, recall, F1 of the positive class (0 on zero division)."""
    y, p = F.col(label) == positive, F.col(prediction) == positive
    c = df.agg(F.count(F.lit(1)).alias("n"),
               F.count_if(F.col(label) == F.col(prediction)).alias("correct"),
               F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
               F.count_if(y & ~p).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(F.col("n").cast("long").alias("n"),
                    _ratio(F.col("correct"), F.col("n")).alias("accuracy"),
                    _ratio(tp, tp + fp).alias("precision"),
                    _ratio(tp, tp + fn).alias("recall"),
                    _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def per_class_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, tp, fp, fn) for every class seen in the labels or the predictions."""
    cm = confusion_matrix(df, label, prediction)
    as_label = cm.select(F.col(label).alias("cls"),
                         F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0).alias("tp"),
                         F.lit(0).cast("long").alias("fp"),
                         F.when(F.col(label) != F.col(prediction), F.col("n")).otherwise(0).alias("fn"))
    as_pred = cm.select(F.col(prediction).alias("cls"), F.lit(0).cast("long").alias("tp"),
                        F.when(F.col(label) != F.col(prediction), F.col("n")).otherwise(0).alias("fp"),
                        F.lit(0).cast("long").alias("fn"))
    return as_label.unionByName(as_pred).groupBy("cls").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def macro_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and unweighted means of per-class precision, recall and F1."""
    pc = per_class_counts(df, label, prediction)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    per = pc.select("cls", _ratio(tp, tp + fp).alias("p"), _ratio(tp, tp + fn).alias("r"),
                    _ratio(2 * tp, 2 * tp + fp + fn).alias("f"), tp, fp, fn)
    # One row per class (bounded by the label domain): the means are summed in
    # class order, so the result does not depend on partition order.
    agg = per.agg(F.count(F.lit(1)).cast("long").alias("n_classes"),
                  _ratio(F.sum("tp"), F.sum("tp") + F.sum("fn")).alias("accuracy"),
                  F.array_sort(F.collect_list(F.struct("cls", "p", "r", "f"))).alias("_c"))

    def mean_of(field):
        total = F.aggregate("_c", F.lit(0.0), lambda acc, c: acc + c[field])
        return total / F.col("n_classes").cast("double")

    return agg.select("n_classes", "accuracy", mean_of("p").alias("macro_precision"),
                      mean_of("r").alias("macro_recall"), mean_of("f").alias("macro_f1"))


def cross_entropy(logits, label) -> F.Column:
    """Per-row ``logsumexp(logits) - logits[label]`` in double, max-shifted for stability."""
    lg = F.transform(F.col(logits) if isinstance(logits, str) else logits, lambda x: x.cast("double"))
    m = F.array_max(lg)
    s = F.aggregate(lg, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))
    lab = F.col(label) if isinstance(label, str) else label
    return m + F.log(s) - F.get(lg, lab)


def mean_cross_entropy(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """Mean per-row cross-entropy (the source evaluates one row per batch), the same bits
    for any partitioning of the rows."""
    return exact_mean(df.select(cross_entropy(logits, label).alias("_ce")), "_ce", out="mean_ce")
