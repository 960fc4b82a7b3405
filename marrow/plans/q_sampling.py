"""Seeded samples and per-source caps."""

from __future__ import annotations

from pyspark.sql import functions as F

from marrow.operators import sampling
from marrow.plans.registry import register
from marrow.sources.tables import table


@register("stratified_sample", operators=("O3",), sql="""
SELECT doc_id, source FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('1|' || CAST(doc_id AS VARCHAR)), doc_id) <= 10
""")
def stratified_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.stratified_sample(d, "source", "doc_id", 10, seed=1).select("doc_id", "source")


@register("repeated_samples", operators=("O3",), sql="""
WITH r AS (SELECT CAST(unnest(range(1, 4)) AS BIGINT) AS sample_no, doc_id, source FROM documents)
SELECT sample_no, doc_id, source FROM r
QUALIFY row_number() OVER (PARTITION BY sample_no, source
                           ORDER BY md5(CAST(sample_no AS VARCHAR) || '|' || CAST(doc_id AS VARCHAR)), doc_id) <= 5
""")
def repeated_samples(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.repeated_samples(d, "source", "doc_id", 5, 3).select("sample_no", "doc_id", "source")


@register("fixed_size_sample", operators=("O4",), sql="""
SELECT doc_id, toxic FROM labels ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100
""")
def fixed_size_sample(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return sampling.fixed_size_sample(lab, "doc_id", 100, seed=7)


@register("limit_per_source", operators=("W5",), sql="""
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS rank
FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 10
""")
def limit_per_source(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    out = sampling.limit_per_source(ev, "user_id", ["ts"], 10, "event_id")
    return out.select("user_id", "event_id", "rank")


def _turn(i: int, digit: str, other: str, base: str) -> str:
    return (f"({digit} + CAST('0x' || substr(md5('7|2|{i}|' || CAST({other} AS VARCHAR)), 1, 8) AS BIGINT)) % {base}")


@register("shuffle_places", operators=("O6",), sql=f"""
WITH RECURSIVE r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank, count(*) OVER () AS n FROM documents),
s AS (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a, CAST((n + ceil(sqrt(n)) - 1) // CAST(ceil(sqrt(n)) AS BIGINT) AS BIGINT) AS b FROM (SELECT DISTINCT n FROM r)),
d0 AS (SELECT x, n, a, b, x // b AS l, x % b AS r FROM (SELECT n, a, b, unnest(range(a * b)) AS x FROM s)),
d1 AS (SELECT * REPLACE ({_turn(1, 'l', 'r', 'a')} AS l) FROM d0),
d2 AS (SELECT * REPLACE ({_turn(2, 'r', 'l', 'b')} AS r) FROM d1),
d3 AS (SELECT * REPLACE ({_turn(3, 'l', 'r', 'a')} AS l) FROM d2),
d4 AS (SELECT * REPLACE ({_turn(4, 'r', 'l', 'b')} AS r) FROM d3),
p AS (SELECT x, l * b + r AS y FROM d4),
w AS (SELECT doc_id, n, y FROM r JOIN p ON p.x = r.rank UNION ALL SELECT doc_id, n, p.y FROM w JOIN p ON p.x = w.y WHERE w.y >= n)
SELECT doc_id, CAST(y AS BIGINT) AS place FROM w WHERE y < n
""")
def shuffle_places(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return sampling.shuffled(d, "doc_id", seed=7, epoch=2)
