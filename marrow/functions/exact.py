"""Sums and means of doubles that are the same bits in any order.

Adding doubles rounds after every step, so a sum depends on how the rows are
partitioned and on the order of the partial sums.  Here every value is first
split into whole numbers at fixed scales (units of 2**20, 2**-10, 2**-40 and
2**-70, each what the one before left over); whole numbers add up exactly, as
decimals, in any order, with one partial aggregate per task.  Only the four
totals are turned into doubles again, in one fixed order.

What lies below 2**-71 of a single value is rounded off (the same for every
order).  Nulls are left out; infinities and NaN decide the result as in any
sum; finite values of 2**82 and more are an error rather than a wrong sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: powers of two of the units of the bins
UNITS = (20, -10, -40, -70)


def exact_mean(df: DataFrame, value: str, by: list[str] | tuple[str, ...] = (), out: str = "mean",
               total: str | None = None, rows: str = "n") -> DataFrame:
    """``by`` + (rows, out): all rows and the mean of the values that are not null, per group;
    ``total`` adds their sum."""
    finite = F.abs("_x") < F.lit(float("inf"))  # false for NaN, null for null
    d = df.select(*by, F.col(value).cast("double").alias("_x"))
    d = d.withColumn("_r", F.when(finite, F.col("_x")))
    sums = []
    for k, unit in enumerate(UNITS):  # one projection each, so nothing is computed twice
        d = d.withColumn(f"_q{k}", F.rint(F.col("_r") * F.lit(2.0 ** -unit)))
        d = d.withColumn("_r", F.col("_r") - F.col(f"_q{k}") * F.lit(2.0 ** unit))
        sums.append(F.sum(F.col(f"_q{k}").cast("decimal(20,0)")).alias(f"_s{k}"))
    odd = F.sum(F.when(~finite, F.col("_x"))).alias("_odd")
    agg = d.groupBy(*by).agg(F.count(F.lit(1)).cast("long").alias(rows), F.count("_x").alias("_n"), odd, *sums)
    exact = F.lit(0.0)
    for k, unit in enumerate(UNITS):
        exact = exact + F.coalesce(F.col(f"_s{k}").cast("double"), F.lit(0.0)) * F.lit(2.0 ** unit)
    whole = F.when(F.col("_n") > 0, F.coalesce(F.col("_odd"), exact))
    cols = [whole.alias(total)] if total else []
    return agg.select(*by, rows, *cols, F.try_divide(whole, F.col("_n").cast("double")).alias(out))
