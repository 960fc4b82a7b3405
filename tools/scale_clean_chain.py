"""Scale check of the flagship cleaning chain on replicated documents.

Every document is replicated R times (positions doc_id * R + copy) and a third
of all rows are put in one hot category, so the run exercises a text repeated
R times (dedup) and a category holding a third of the rows (ids).  The rows are
generated by Spark from the given table; nothing is written except the
narrow rank checkpoint.  Prints one JSON line with rows/s.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from marrow.operators import clean  # noqa: E402
from marrow.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    reps = int(sys.argv[2]) if len(sys.argv) > 2 else 100
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=4 * cpus)
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet")).repartition(4 * cpus)
    rep = docs.select("doc_id", "text", "source", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("r"))
    pos = F.col("doc_id") * reps + F.col("r")
    rows = rep.select(pos.alias("pos"),
                      F.when(pos % 3 == 0, F.lit("hot")).otherwise(F.col("source")).alias("category"),
                      "text")
    n_in = docs.count() * reps
    t0 = time.perf_counter()
    out = clean.clean_chain(rows)
    stats = out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"),
                    F.sum(F.length("text")).alias("chars")).collect()[0]
    dt = time.perf_counter() - t0
    print(json.dumps({"rows_in": n_in, "rows_out": stats.n, "distinct_ids": stats.ids,
                      "sec": round(dt, 2), "rows_per_sec": round(n_in / dt)}))
    spark.stop()


if __name__ == "__main__":
    main()
