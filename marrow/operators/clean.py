"""Per-platform repair, positional ids, keep-first dedup, batching and the cleaning chain.

Order is data: every operator that depends on "file order" takes an explicit
``pos`` column instead of trusting partition order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marrow.functions import text as tx
from marrow.session import checkpoint_dir

def written(keys: DataFrame) -> DataFrame:
    """A narrow key table written once to the checkpoint folder, so that what is joined and what
    was computed from are the same rows; the join strategy is left to measured sizes (AQE)."""
    checkpoint_dir(keys.sparkSession)
    return keys.checkpoint(eager=True)


# ---------------------------------------------------------------------------
# Platform repairers (F1-F8).  Each keeps ``pos`` (and any extra columns) so
# that ids and keep-first stay defined; the source returned text only (F10),
# which callers get with ``select("text")``.
# ---------------------------------------------------------------------------
def drop_null_text(df: DataFrame, col: str = "text") -> DataFrame:
    """rows without a text are dropped (the CSV reader turns NA spellings into null)."""
    return df.where(F.col(col).isNotNull())


def mention_only_filter(df: DataFrame, text: str = "text", mentions: str = "mentions") -> DataFrame:
    """F2 + F3 (TikTok): drop rows that are only mentions; strip '@' from the rest.

    With ``m`` non-null mentions, a row goes when ``|len(text) - sum(len(mention))| <= m``.
    Rows with mentions that survive lose every '@' and are stripped; rows with
    no mentions are left untouched.
    """
    ms = F.filter(F.col(mentions), lambda m: m.isNotNull())
    m = F.size(ms)
    total = F.aggregate(ms, F.lit(0), lambda acc, s: acc + F.length(s))
    mention_only = (m > 0) & (F.abs(F.length(F.col(text)) - total) <= m)
    return (df.where(F.col(text).isNotNull() & ~mention_only)
              .withColumn(text, F.when(m > 0, tx.strip_ws(F.replace(F.col(text), F.lit("@"), F.lit(""))))
                                 .otherwise(F.col(text))))


def repair_tiktok(df: DataFrame) -> DataFrame:
    return mention_only_filter(drop_null_text(df))


def repair_youtube(df: DataFrame) -> DataFrame:
    """F1 + F4: drop missing text, unmark ``@handle``."""
    return drop_null_text(df).withColumn("text", tx.unmark_mentions("text"))


def repair_facebook(df: DataFrame) -> DataFrame:
    """drop missing text."""
    return drop_null_text(df)


def removed_body_filter(df: DataFrame, body: str = "body") -> DataFrame:
    """Reddit bodies that are removed, deleted, blank or missing are dropped."""
    b = F.col(body)
    return df.where(b.isNotNull() & ~b.isin(*tx.REMOVED_BODIES))


def repair_reddit(df: DataFrame) -> DataFrame:
    """F6-F8, output column renamed to ``text``."""
    out = removed_body_filter(df)
    out = out.withColumn("body", tx.strip_emotes(tx.strip_bot_notice("body")))
    return out.withColumnRenamed("body", "text")


REPAIRERS = {
    "tiktok": repair_tiktok,
    "youtube": repair_youtube,
    "facebook": repair_facebook,
    "reddit": repair_reddit,
}


def repair_platform(df: DataFrame, platform: str) -> DataFrame:
    """dispatch by platform; unknown platforms fail at planning time."""
    try:
        fn = REPAIRERS[platform]
    except KeyError:
        raise ValueError(f"unsupported platform {platform!r}; expected one of {sorted(REPAIRERS)}")
    return fn(df)


def drop_repeated_header(df: DataFrame) -> DataFrame:
    """K2 read side: drop the header copies that appended CSV writes leave behind."""
    cols = [c for c in df.columns if not c.startswith("_")]
    is_header = F.lit(True)
    for c in cols:
        is_header = is_header & (F.col(c).cast("string") == F.lit(c))
    return df.where(~F.coalesce(is_header, F.lit(False)))


# ---------------------------------------------------------------------------
# Positional ids (W1), keep-first dedup (U2), batches (K6)
# ---------------------------------------------------------------------------
def rank_table(df: DataFrame, category: str | None, pos: str, rank_col: str = "rank",
               num_partitions: int | None = None) -> DataFrame:
    """``(category, pos, rank)``: 0-based rank of ``pos`` within ``category`` (or overall).

    A window partitioned by category would put a hot category (a third of the
    rows) into one task, and a global window puts everything there.  Instead
    the narrow ``(category, pos)`` projection is range-partitioned and sorted;
    the rank is the row offset inside its partition plus the rows of the same
    category in earlier partitions: a prefix sum over a table of at most
    (partitions + categories) rows.

    The ranged projection is checkpointed once, so the offsets and the rows
    they are added to come from the same materialized partitioning (a second
    evaluation could draw different range bounds).  ``pos`` must be non-null
    and unique within a category.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cat = category or "_cat"
    narrow = df.select((F.col(category) if category else F.lit(0)).alias(cat), F.col(pos))
    ranged = (narrow.repartitionByRange(n, cat, pos)
                    .sortWithinPartitions(cat, pos)
                    .withColumn("_pid", F.spark_partition_id())
                    .withColumn("_mid", F.monotonically_increasing_id())
                    .checkpoint(eager=True))
    stats = ranged.groupBy(cat, "_pid").agg(F.min("_mid").alias("_first"),
                                              F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(cat).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.select(cat, "_pid", "_first",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = (F.col("_before") + F.col("_mid") - F.col("_first")).cast("long")
    offsets = offsets.withColumnRenamed(cat, "_ocat").withColumnRenamed("_pid", "_opid")
    out = ranged.join(offsets, F.col(cat).eqNullSafe(F.col("_ocat")) & (F.col("_pid") == F.col("_opid"))) \
                .select(cat, pos, rank.alias(rank_col))
    return out if category else out.drop(cat)


def positional_rank(df: DataFrame, category: str | None, pos: str, rank_col: str = "rank",
                    num_partitions: int | None = None) -> DataFrame:
    """``df`` with the rank of :func:`rank_table`, joined back on the unique (category, pos)."""
    t = rank_table(df, category, pos, rank_col, num_partitions)
    keys = [category, pos] if category else [pos]
    if sorted(df.columns) == sorted(keys):
        return t
    t = t.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], rank_col)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(f"_k{i}").eqNullSafe(F.col(k))
    return df.join(t, same).drop(*[f"_k{i}" for i in range(len(keys))])


def id_expr(category: str, rank: str) -> F.Column:
    # a null category is the unnamed one, so its rows keep an id
    return F.concat(F.coalesce(F.col(category).cast("string"), F.lit("")), F.lit("_"), F.col(rank).cast("string"))


def assign_ids(df: DataFrame, category: str = "category", pos: str = "pos",
               id_col: str = "id", num_partitions: int | None = None) -> DataFrame:
    """``id = category || '_' || (rank of pos within category, from 0)``."""
    ranked = positional_rank(df, category, pos, "_rank", num_partitions)
    return ranked.withColumn(id_col, id_expr(category, "_rank")).drop("_rank")


def text_key(col: str = "text"):
    """Fixed-width dedup key: the shuffle carries 32 bytes, not the text."""
    return F.unhex(F.sha2(F.col(col), 256))


def dedup_keep_first(df: DataFrame, key: str = "text", pos: str = "pos",
                     within: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Keep the first row (smallest ``pos``) of every distinct ``key`` within ``within``.

    The source dedups each category file on its own, so the cleaning chain
    passes ``within=[category]``; an empty ``within`` dedups globally.  The
    grouping runs on (scope, 32-byte hash, pos) only, with map-side partial
    aggregation, so a key that repeats on a third of all rows collapses before
    the shuffle.  Only the groups with copies meet the rows again: a row goes
    if its group's first position is smaller.  Null keys are one group, null
    scopes are a scope, and ``pos`` must be unique in its scope, or overall
    when ``within`` is empty (else a ValueError).
    """
    within = list(within)
    keyed = df.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)],
                      text_key(key).alias("_h"), F.col(pos).alias("_p"))
    scope = [f"_w{i}" for i in range(len(within))]
    losers = written(_losers(keyed, scope))
    if not within and not df.select(pos).groupBy(pos).count().filter("count > 1").isEmpty():
        raise ValueError(f"{pos!r} must be unique over all rows; pass its scope in within=")
    same = F.col("_p") == F.col(pos)
    for i, c in enumerate(within):
        same = same & F.col(f"_w{i}").eqNullSafe(F.col(c))
    return df.join(losers, same, "left_anti")


def _losers(keyed: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, _p) of the rows after the first one of their (scope, _h) group: a small table."""
    firsts = keyed.groupBy(*scope, "_h").agg(F.min("_p").alias("_first"), F.count(F.lit(1)).alias("_n"))
    firsts = firsts.filter("_n > 1").select(*[F.col(c).alias(f"{c}_f") for c in scope], F.col("_h").alias("_hf"), "_first")
    same = F.col("_h").eqNullSafe(F.col("_hf"))
    for c in scope:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_f"))
    return keyed.join(firsts, same).filter("_p > _first").select(*scope, "_p")


def batch_assign(df: DataFrame, pos: str = "pos", size: int = 100,
                 batch_col: str = "batch", row_col: str = "row") -> DataFrame:
    """K6: consecutive batches of ``size`` rows in ``pos`` order, numbered from 1."""
    ranked = positional_rank(df, None, pos, row_col)
    return ranked.withColumn(batch_col, (F.floor(F.col(row_col) / F.lit(size)) + 1).cast("long"))


# ---------------------------------------------------------------------------
# Cleaning chain
# ---------------------------------------------------------------------------
def clean_text(col: str = "text"):
    """C2 -> C1 -> C4 -> C3 as one expression (one projection, one pass)."""
    return tx.to_lowercase(tx.clean_whitespace(tx.remove_hashtags(tx.remove_urls(col))))


def clean_chain(df: DataFrame, category: str = "category", pos: str = "pos",
                text: str = "text", dedup_on_clean: bool = False) -> DataFrame:
    """Ids -> keep-first dedup -> URLs -> hashtags -> whitespace -> lowercase.

    Runs per category (the source cleans one category file at a time): ids
    count positions within the category, and dedup keeps the first copy of a
    text within the category.  Ids are assigned before dedup (so later ids
    have gaps), as in the source.
    With ``dedup_on_clean`` the dedup key is the cleaned text instead.  Ranks
    and first positions are computed on narrow projections; the full rows are
    shuffled once, to meet their surviving (position, id) pairs.
    """
    ranks = rank_table(df, category, pos, "_rank")
    keyed = df.withColumn(text, clean_text(text)) if dedup_on_clean else df
    losers = _losers(keyed.select(F.col(category).alias("_w0"), text_key(text).alias("_h"), F.col(pos).alias("_p")), ["_w0"])
    lost = F.col("_w0").eqNullSafe(F.col(category)) & (F.col("_p") == F.col(pos))
    keep = ranks.join(losers, lost, "left_anti").select(
        F.col(category).alias("_c"), F.col(pos).alias("_p"), "_rank")
    out = df.join(keep, F.col("_c").eqNullSafe(F.col(category)) & (F.col("_p") == F.col(pos))).drop("_c", "_p")
    return out.withColumn("id", id_expr(category, "_rank")).withColumn(text, clean_text(text)).drop("_rank")
