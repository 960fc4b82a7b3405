"""Writers (K1-K5, K7).  All are distributed writes; nothing is gathered on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """K1/K3: overwrite as JSON lines, non-ASCII kept as is (indentation is not kept)."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """K2/K3: CSV with a header.  Appending writes new part files, each with its
    own header, so readers must skip header copies (:func:`marrow.operators.clean.drop_repeated_header`)
    or read with ``header=True`` per file, as Spark does."""
    (df.write.mode("append" if append else "overwrite").option("header", True)
       .option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))


def write_stage(df: DataFrame, path: str, stage: str, partition_cols: tuple[str, ...] = ()) -> None:
    """K4: snapshot one cleaning stage under ``stage=<name>`` (only that partition is replaced)."""
    (df.withColumn("stage", F.lit(stage)).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy("stage", *partition_cols).parquet(path))


def append_category(df: DataFrame, path: str, category: str = "category") -> None:
    """K5: extend the accumulated per-category set (no read-modify-rewrite)."""
    df.write.mode("append").partitionBy(category).parquet(path)


def write_results(per_row: DataFrame, metrics: DataFrame, path: str) -> None:
    """K7: the results document as two tables: per-row results and one metrics row."""
    per_row.write.mode("overwrite").parquet(f"{path}/rows")
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")


def write_json_arrays(df: DataFrame, path: str) -> None:
    """K1: one JSON array of objects per partition, a line each (the source's form of a JSON file);
    rows stream through the tasks, and an empty partition gives an empty array."""

    def array(batches):
        held = None  # the last line, which may need a comma
        yield pa.RecordBatch.from_pydict({"value": ["["]})
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if not lines:
                continue
            out = ([held + ","] if held is not None else []) + [x + "," for x in lines[:-1]]
            held = lines[-1]
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": ([held] if held is not None else []) + ["]"]})

    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")).mapInArrow(
        array, "value string").write.mode("append").text(path)
