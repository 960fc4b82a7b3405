"""Driver tables (parquet) and the readers for the reference's raw formats."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.functions import text as tx
from marrow.sources import blocks

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, partitions: int | None = None) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it.

    ``partitions`` spreads the rows over that many tasks (for files of one row
    group that feed heavy per-row work); by default the scan's splits stay."""
    if name not in DRIVER_TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.repartition(partitions) if partitions else df


# ---------------------------------------------------------------------------
# Raw platform dumps (S1): CSV files under <root>/<category>/<platform>/*.csv
# ---------------------------------------------------------------------------
PLATFORM_SCHEMAS = {
    "youtube": "author STRING, text STRING, likeCount BIGINT, publishedAt STRING, video_id STRING",
    "reddit": "author STRING, body STRING, score BIGINT, link STRING",
    "facebook": "text STRING",
    "tiktok": "text STRING",
}
#: The column a platform's repairer cannot do without.
PLATFORM_TEXT = {"youtube": "text", "reddit": "body", "facebook": "text", "tiktok": "text"}


def read_platform_csv(spark: SparkSession, root: str, platform: str,
                      schema: str | None = None) -> DataFrame:
    """Scan every CSV of one platform below ``root/<category>/<platform>/``, by column names.

    Files are read in blocks by many tasks, however long they are and wherever quoted line ends lie
    (:mod:`marrow.sources.blocks`); quotes follow RFC 4180 (doubled inside quoted fields).  A file's
    header is its first line.  Columns may stand in any order and headers may differ (TikTok's ragged
    ``mentions*`` columns become one array).  A file without the platform's text column is an error;
    other columns of the schema are null where a file lacks them.  NA spellings of the text become
    null, as the source's CSV reader has them; blank lines are no rows.

    Adds ``category`` (from the path), ``file``, and ``pos``, the struct (file, row) that orders rows
    within a category (``row`` is the record's place in the file, about its byte).  Category folders
    whose name contains ``link`` are skipped (link lists live there).
    """
    if platform not in PLATFORM_TEXT:
        raise ValueError(f"unsupported platform {platform!r}; expected one of {sorted(PLATFORM_TEXT)}")
    wanted = spark.createDataFrame([], schema or PLATFORM_SCHEMAS[platform]).schema
    text = PLATFORM_TEXT[platform]
    try:
        recs, table = blocks.records(spark, os.path.join(root, "*", platform, "*.csv"), blocks.LINE)
    except AnalysisException as e:
        raise ValueError(f"no CSV files of {platform!r} below {root}") from e
    category = F.regexp_extract("file", r"([^/]+)/[^/]+/[^/]+$", 1)
    # one row per file; the widest header has at most as many columns as commas and one more
    heads = table.where((F.col("block") == 0) & ~category.contains("link"))
    width = heads.agg(F.max(F.size(F.split("first", ",")))).first()[0]
    if width is None:
        raise ValueError(f"no CSV files of {platform!r} below {root}")
    layout = ", ".join(f"_{i} STRING" for i in range(width))

    def fields(line):
        cells = F.from_csv(line, layout, {"escape": '"'})
        return F.array(*[cells[f"_{i}"] for i in range(width)])

    def line(c):
        return F.regexp_replace(c, r"\r?\n?\z", "")

    lacking = heads.select("file", fields(line("first")).alias("names")).where(~F.coalesce(F.array_contains("names", text), F.lit(False))).first()
    if lacking:
        raise ValueError(f"{lacking.file}: no column {text!r} in {[n for n in lacking.names if n is not None]}")
    rows = recs.where((F.col("place") > 0) & (line("record") != "") & ~category.contains("link")).select(
        category.alias("category"), F.substring_index("file", "/", -1).alias("file"), F.col("place").alias("_row"),
        fields(line("record")).alias("_f"), fields(line("first")).alias("_n"))
    cols = [F.get("_f", (F.array_position("_n", f.name) - 1).cast("int")).cast(f.dataType).alias(f.name) for f in wanted.fields]
    if platform == "tiktok":
        named = F.filter("_f", lambda x, i: x.isNotNull() & F.get("_n", i).startswith("mentions"))
        cols.append(named.alias("mentions"))
    return rows.select(*cols, "category", "file", F.struct("file", F.col("_row").alias("row")).alias("pos")).withColumn(text, tx.csv_null(text))


def read_json_rows(spark: SparkSession, path: str, schema: T.StructType | str, lanes: bool = False, **options) -> DataFrame:
    """JSON arrays of objects (or JSON lines), UTF-8, explicit schema.

    Files are read in blocks by many tasks, also where an array is one line.  With ``lanes`` what
    is no valid object, or cut off by the end of its file, is a row of lane ``error`` with null
    columns and its text in ``raw``; without, only a row of nulls.  ``lanes`` also adds ``file`` and ``place``."""
    recs, _ = blocks.records(spark, path, blocks.BRACE, **options)
    wanted = spark.createDataFrame([], schema).schema
    body = F.regexp_replace("record", r"\A[\x{feff}\s\[,]+", "")
    found = recs.select("file", "place", "ended", body.alias("_body")).where(~F.col("_body").rlike(r"\A[\s\],]*\z"))
    marked = T.StructType([*wanted.fields, T.StructField("_bad", T.StringType())])
    found = found.withColumn("_v", F.from_json("_body", marked, {"columnNameOfCorruptRecord": "_bad"}))
    ok = F.col("ended") & F.col("_v._bad").isNull()
    cols = [F.when(ok, F.col("_v")[f.name]).alias(f.name) for f in wanted.fields]
    if not lanes:
        return found.select(*cols)
    return found.select(*cols, F.when(ok, "ok").otherwise("error").alias("lane"), F.when(~ok, F.col("_body")).alias("raw"), "file", "place")


def read_json_folder(spark: SparkSession, root: str, schema: T.StructType | str, lanes: bool = False, glob: str = "*.json") -> DataFrame:
    """S3: every JSON file below ``root``; parent folder -> ``task``, stem -> ``split``; lanes as in
    :func:`read_json_rows`."""
    df = read_json_rows(spark, root, schema, True, recursiveFileLookup=True, pathGlobFilter=glob)
    df = (df.withColumn("task", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1))
            .withColumn("split", F.regexp_extract("file", r"([^/]+)\.[^/.]+$", 1)))
    return df if lanes else df.drop("lane", "raw", "file", "place")


def read_link_list(df: DataFrame, platform: str) -> DataFrame:
    """Rows of one platform whose note is empty; keep number and link."""
    return (df.where((F.col("Platform") == platform) & F.col("note").isNull())
              .select(F.col("`No.`").alias("no"), F.col("Link").alias("link")))


def read_word_vectors(spark: SparkSession, path: str, dim: int, header: bool = False) -> DataFrame:
    """``(word, vector, lane)`` from text lines ``word f1 f2 ...``.

    The last line of a repeated word wins, in order of file name and line.
    Lines of another width, or with an entry that is no number, are kept in
    lane ``error`` with a null vector; ``header`` skips ``count dim`` lines.
    """
    lines = spark.read.text(path).select("value", F.struct(
        F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line")).alias("at"))
    if header:
        lines = lines.where(~F.col("value").rlike(r"^\s*[0-9]+ [0-9]+\s*$"))
    parts = F.split(F.regexp_replace(F.col("value"), r"[\r\n ]+$", ""), " ", -1)
    numbers = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda x: x.try_cast("float"))
    vecs = lines.select(F.get(parts, 0).alias("word"), numbers.alias("vector"), "at")
    good = (F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull())
    ok = vecs.where(good).groupBy("word").agg(F.max_by("vector", "at").alias("vector")).withColumn("lane", F.lit("ok"))
    bad = vecs.where(~good).select("word", F.lit(None).cast("array<float>").alias("vector"), F.lit("error").alias("lane"))
    return ok.unionByName(bad)
