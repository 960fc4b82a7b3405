"""Connected components of an undirected edge table by alternating star contraction.

(Kiveris et al., 2014.)  Every round is two aggregations with joins back; no
node's neighbours are ever gathered in one place.  Rounds go on until the
edges no longer change, each round's edges being written to the checkpoint
folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.session import checkpoint_dir


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge: ``label`` is the smallest node it is connected with.
    ``edges`` has two columns of one orderable type."""
    checkpoint_dir(edges.sparkSession)
    edges = edges.toDF("a", "b").filter("a <> b").distinct().checkpoint()
    state = None
    while True:
        edges = _small_star(_large_star(edges)).filter("a <> b").distinct().checkpoint()
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
