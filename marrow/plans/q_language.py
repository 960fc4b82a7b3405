"""Language detection by stop-word profile and the three-way route."""

from __future__ import annotations

from pyspark.sql import functions as F

from marrow.operators import language as L
from marrow.plans import sqltext as S
from marrow.plans.fixtures_sql import SPLIT_DOCS
from marrow.plans.registry import register
from marrow.sources import fixtures as fx
from marrow.sources.tables import table

_VALUES = ", ".join(f"('{lang}', '{w}')" for lang, ws in sorted(L.DEFAULT_PROFILE.items()) for w in ws)
BEST = f"""prof AS (SELECT * FROM (VALUES {_VALUES}) t(lang, word)),
toks AS (SELECT doc_id, unnest({S.ws_tokens('lower(text)')}) AS word FROM documents),
hits AS (SELECT doc_id, lang, count(*) AS s FROM toks JOIN prof USING (word) GROUP BY doc_id, lang),
best AS (SELECT doc_id, lang AS detected, s AS score FROM hits
         QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) = 1)"""


@register("language_profile_score", operators=("X1",), sql=f"""
WITH {BEST}
SELECT d.doc_id, b.detected, CAST(b.score AS BIGINT) AS score FROM documents d LEFT JOIN best b USING (doc_id)
""")
def language_profile_score(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return L.profile_scores(d, "doc_id").select("doc_id", "detected", "score")


@register("language_route", operators=("X1", "D23"), sql=f"""
WITH {BEST}
SELECT d.doc_id, b.detected,
       CASE WHEN b.detected IS NULL THEN 'undetectable' WHEN b.detected = 'en' THEN 'accepted'
            ELSE 'second_opinion' END AS lane
FROM documents d LEFT JOIN best b USING (doc_id)
""")
def language_route(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return L.route_by_language(d, "doc_id", "en").select("doc_id", "detected", "lane")


TRAINED = f"""{SPLIT_DOCS},
w AS (SELECT doc_id, lang, split, unnest({S.ws_tokens('lower(text)')}) AS word FROM sdocs),
g AS (SELECT doc_id, lang, split, substr(' ' || word || ' ', i, 3) AS gram
      FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
c AS (SELECT lang, gram, count(*) AS n FROM g WHERE split = 'train' AND lang IS NOT NULL GROUP BY lang, gram),
top AS (SELECT gram FROM c GROUP BY gram ORDER BY sum(n) DESC, gram LIMIT {L.PROFILE_GRAMS}),
t AS (SELECT lang, sum(n) AS total FROM c JOIN top USING (gram) GROUP BY lang),
p AS (SELECT t.lang, top.gram, CAST(floor(1000 * ln((coalesce(n, 0) + 1)::DOUBLE / (total + (SELECT count(*) FROM top))::DOUBLE)) AS BIGINT) AS wt
      FROM t CROSS JOIN top LEFT JOIN c ON c.lang = t.lang AND c.gram = top.gram),
s AS (SELECT doc_id, p.lang, sum(wt) AS s, count(*) AS n FROM g JOIN p USING (gram) GROUP BY doc_id, p.lang),
o AS (SELECT doc_id, n, list(lang ORDER BY s DESC, lang) AS langs, list(s ORDER BY s DESC, lang) AS ss FROM s GROUP BY doc_id, n),
found AS (SELECT doc_id, n AS n_grams, CAST(ss[1] - ss[2] AS BIGINT) AS margin,
                 CASE WHEN ss[1] - ss[2] >= {L.REJECT_BELOW} * n THEN langs[1] END AS detected FROM o)"""


def _detected(spark, sf_dir):
    docs = fx.documents_split(spark, sf_dir).select("doc_id", "lang", "split", "text")
    profile, langs = L.train_profile(docs.where("split = 'train'"))
    return L.detect_language(docs, profile, langs, "doc_id")


@register("language_trained", operators=("X1",), sql=f"""
WITH {TRAINED}
SELECT d.doc_id, detected, margin, coalesce(n_grams, 0) AS n_grams FROM sdocs d LEFT JOIN found USING (doc_id)
""")
def language_trained(spark, sf_dir):
    return _detected(spark, sf_dir).select("doc_id", "detected", "margin", "n_grams")


@register("language_accuracy", operators=("X1",), sql=f"""
WITH {TRAINED}
SELECT split, count(*) AS n, count(*) FILTER (WHERE detected = d.lang) AS n_right, count(*) FILTER (WHERE detected IS NULL) AS n_rejected
FROM sdocs d LEFT JOIN found USING (doc_id) GROUP BY split
""")
def language_accuracy(spark, sf_dir):
    right = F.count_if(F.col("detected") == F.col("lang"))
    return _detected(spark, sf_dir).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), right.alias("n_right"), F.count_if(F.col("detected").isNull()).alias("n_rejected"))
