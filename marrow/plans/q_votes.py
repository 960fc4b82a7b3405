"""Votes, agreement and consensus on the synthetic votes built from ``labels`` (FIXTURES C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marrow.operators import clean, joins
from marrow.operators import votes as V
from marrow.plans.fixtures_sql import (ADJUDICATIONS, GAPPY, HUMAN_FINAL, HUMAN_REVIEW, REPLIES,
                                       VOTES)
from marrow.plans.registry import register
from marrow.sources import fixtures as fx
from marrow.sources.tables import table

TV = "tv AS (SELECT * FROM votes WHERE task = 'toxicity')"
SUMMARY = """summ AS (
  SELECT id, min(label) AS lo, max(label) AS hi,
         max(label) FILTER (WHERE annotator = 'deepseek') AS deepseek,
         max(label) FILTER (WHERE annotator = 'mistral') AS mistral,
         max(label) FILTER (WHERE annotator = 'qwen') AS qwen
  FROM tv GROUP BY id)"""
LANES = """lanes AS (
  SELECT id, lo AS label, 'similar' AS lane FROM summ WHERE lo = hi
  UNION ALL
  SELECT s.id, a.label, 'checked' FROM summ s JOIN adjud a ON s.id = a.id WHERE s.lo <> s.hi)"""


def _tv(spark, sf_dir):
    return fx.votes(spark, sf_dir).where(F.col("task") == "toxicity")


def _info(spark, sf_dir):
    return fx.labelled_documents(spark, sf_dir).select("id", "text", "category")


@register("unanimous_votes", operators=("G1",), sql=f"""
WITH {VOTES}, {TV} SELECT id, min(label) AS label FROM tv GROUP BY id HAVING min(label) = max(label)
""")
def unanimous_votes(spark, sf_dir):
    return V.unanimous_votes(_tv(spark, sf_dir))


@register("disputed_votes", operators=("G1", "J7"), sql=f"""
WITH {VOTES}, {TV}, {SUMMARY} SELECT id, deepseek, mistral, qwen FROM summ WHERE lo <> hi
""")
def disputed_votes(spark, sf_dir):
    return V.disputed_votes(_tv(spark, sf_dir))


@register("majority_vote", operators=("G2", "O5"), sql=f"""
WITH {VOTES},
c AS (SELECT id, label, count(*) AS n, min(rnk) AS r FROM votes WHERE task = 'expression_type' GROUP BY id, label)
SELECT id, label FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, r ASC) = 1
""")
def majority_vote(spark, sf_dir):
    v = fx.votes(spark, sf_dir).where(F.col("task") == "expression_type")
    return V.majority_vote(v)


@register("agreement_matrix", operators=("G4",), sql=f"""
WITH {VOTES}, {TV}
SELECT id, CAST(count(*) FILTER (WHERE label = 'TOXIC') AS BIGINT) AS n_toxic,
       CAST(count(*) FILTER (WHERE label = 'NON-TOXIC') AS BIGINT) AS n_non_toxic
FROM tv GROUP BY id
""")
def agreement_matrix(spark, sf_dir):
    return V.agreement_matrix(_tv(spark, sf_dir), fx.TOXICITY)


@register("fleiss_kappa", operators=("G5",), sql=f"""
WITH {VOTES}, {TV},
sv AS (SELECT 'all' AS scope, id, label FROM tv
       UNION ALL SELECT split_part(id, '_', 1), id, label FROM tv),
nij AS (SELECT scope, id, label, count(*) AS nij FROM sv GROUP BY scope, id, label),
subj AS (SELECT scope, id, sum(nij * nij) AS s2, sum(nij) AS n FROM nij GROUP BY scope, id),
ps AS (SELECT scope, count(*) AS n_subjects, min(n) AS n_min, max(n) AS n_raters,
              CAST(sum(s2) - sum(n) AS DOUBLE) / CAST(sum(n * (n - 1)) AS DOUBLE) AS p_exact,
              avg(CASE WHEN n > 1 THEN (CAST(s2 AS DOUBLE) - CAST(n AS DOUBLE))
                                       / (CAST(n AS DOUBLE) * (CAST(n AS DOUBLE) - 1e0)) END) AS p_avg
       FROM subj GROUP BY scope),
pe AS (SELECT scope, CAST(sum(nj * nj) AS DOUBLE) / (CAST(sum(nj) AS DOUBLE) * CAST(sum(nj) AS DOUBLE)) AS p_e
       FROM (SELECT scope, label, sum(nij) AS nj FROM nij GROUP BY scope, label) GROUP BY scope),
k AS (SELECT scope, n_subjects, n_raters, CASE WHEN n_min = n_raters THEN p_exact ELSE p_avg END AS p_bar, p_e
      FROM ps JOIN pe USING (scope))
SELECT scope, CAST(n_subjects AS BIGINT) AS n_subjects, CAST(n_raters AS BIGINT) AS n_raters,
       CASE WHEN n_raters >= 3 AND p_e <> 1 THEN (p_bar - p_e) / (1e0 - p_e) END AS kappa
FROM k
""")
def fleiss_kappa(spark, sf_dir):
    v = _tv(spark, sf_dir)
    return V.fleiss_kappa(v, [F.lit("all"), F.split("id", "_", 2).getItem(0)])


@register("disagreement_report", operators=("G6", "J2"), sql=f"""
WITH {VOTES}, {TV}, {SUMMARY}
SELECT i.id, i.text, i.category, s.deepseek AS deepseek_label, s.mistral AS mistral_label,
       s.qwen AS qwen_label, '' AS note, '' AS final
FROM ldocs i JOIN summ s ON i.id = s.id WHERE s.lo <> s.hi
""")
def disagreement_report(spark, sf_dir):
    return V.disagreement_report(_tv(spark, sf_dir), _info(spark, sf_dir))


@register("consensus_labels", operators=("G6", "F15"), sql=f"""
WITH {VOTES}, {TV}, {SUMMARY}
SELECT i.id, i.text, i.category, CASE WHEN s.lo = s.hi THEN s.lo ELSE '' END AS toxicity
FROM ldocs i JOIN summ s ON i.id = s.id
""")
def consensus_labels(spark, sf_dir):
    return V.consensus_labels(_tv(spark, sf_dir), _info(spark, sf_dir), "toxicity")


@register("disagreement_by_category", operators=("G8", "C12"), sql=f"""
WITH {VOTES}, {TV}, {SUMMARY}
SELECT split_part(id, '_', 1) AS category, CAST(count(*) AS BIGINT) AS n_different
FROM summ WHERE lo <> hi GROUP BY 1
""")
def disagreement_by_category(spark, sf_dir):
    rep = V.disagreement_report(_tv(spark, sf_dir), _info(spark, sf_dir))
    return V.disagreement_by_category(rep)


@register("disagreement_share", operators=("G9",), sql=f"""
WITH {VOTES}, {TV}, {SUMMARY},
j AS (SELECT split_part(i.id, '_', 1) AS category, CASE WHEN s.lo <> s.hi THEN 1 END AS d
      FROM ldocs i LEFT JOIN summ s ON i.id = s.id)
SELECT coalesce(category, 'all') AS scope, CAST(count(*) AS BIGINT) AS n_total,
       CAST(count(d) AS BIGINT) AS n_different, CAST(count(*) - count(d) AS BIGINT) AS n_similar,
       count(d) / CAST(count(*) AS DOUBLE) AS share_different
FROM j GROUP BY ROLLUP (category)
""")
def disagreement_share(spark, sf_dir):
    rep = V.disagreement_report(_tv(spark, sf_dir), _info(spark, sf_dir))
    return V.disagreement_share(rep, _info(spark, sf_dir).select("id"))


@register("consensus_resolve", operators=("G7", "J3"), sql=f"""
WITH {VOTES}, {TV}, {SUMMARY}, {ADJUDICATIONS}, {LANES}, {HUMAN_FINAL},
cons AS (SELECT i.id, i.text, i.category, CASE WHEN s.lo = s.hi THEN s.lo ELSE '' END AS toxicity
         FROM ldocs i JOIN summ s ON i.id = s.id)
SELECT c.id, c.text, c.category,
       CASE WHEN c.toxicity = '' THEN coalesce(nullif(h.final, ''), l.label) ELSE c.toxicity END AS toxicity
FROM cons c LEFT JOIN hfinal h ON c.id = h.id LEFT JOIN lanes l ON c.id = l.id
""")
def consensus_resolve(spark, sf_dir):
    v = _tv(spark, sf_dir)
    cons = V.consensus_labels(v, _info(spark, sf_dir), "toxicity")
    model = V.label_lanes_union(v, fx.adjudications(spark, sf_dir))
    return V.consensus_resolve(cons, fx.human_final(spark, sf_dir), model, "toxicity")


@register("label_overwrite", operators=("J4",), sql=f"""
WITH {VOTES}, {TV}, {SUMMARY}, {HUMAN_FINAL}, {HUMAN_REVIEW},
diff AS (SELECT s.id, h.final FROM summ s JOIN hfinal h ON s.id = h.id WHERE s.lo <> s.hi)
SELECT r.id, r.annotator, CASE WHEN d.id IS NOT NULL THEN d.final ELSE r.label_fixed END AS label_fixed
FROM hreview r LEFT JOIN diff d ON r.id = d.id
""")
def label_overwrite(spark, sf_dir):
    v = _tv(spark, sf_dir)
    diff = V.disputed_votes(v).select("id").join(fx.human_final(spark, sf_dir), "id")
    sheets = fx.human_review(spark, sf_dir).where(F.col("annotator") != "llms")
    out = joins.overwrite_by_key(sheets, diff, "id", "final", "label_fixed")
    return out.select("id", "annotator", "label_fixed")


@register("vote_completeness", operators=("J2",), sql=f"""
WITH {VOTES}, {GAPPY}
SELECT id, CAST(count(DISTINCT annotator) AS BIGINT) AS n_annotators,
       array_to_string(list_filter(['deepseek', 'mistral', 'qwen'],
                                   lambda a: NOT list_contains(list(annotator), a)), ',') AS missing
FROM gvotes GROUP BY id HAVING count(DISTINCT annotator) < 3
""")
def vote_completeness(spark, sf_dir):
    return V.vote_completeness(fx.votes_with_gaps(spark, sf_dir))


@register("label_domain_violations", operators=("F14", "U3"), sql=f"""
WITH {VOTES}, {HUMAN_REVIEW}
SELECT annotator, id, label_fixed AS label FROM hreview
WHERE label_fixed IS NULL OR label_fixed NOT IN ('TOXIC', 'NON-TOXIC')
""")
def label_domain_violations(spark, sf_dir):
    return V.label_domain_violations(fx.human_review(spark, sf_dir), "label_fixed", fx.TOXICITY)


@register("label_lanes_union", operators=("U1", "G3", "J7"), sql=f"""
WITH {VOTES}, {TV}, {SUMMARY}, {ADJUDICATIONS}, {LANES} SELECT id, label, lane FROM lanes
""")
def label_lanes_union(spark, sf_dir):
    return V.label_lanes_union(_tv(spark, sf_dir), fx.adjudications(spark, sf_dir))


@register("adjudication_payload", operators=("F12",), sql=f"""
WITH {VOTES}, {TV}, {SUMMARY}
SELECT i.id, i.text, s.deepseek, s.mistral, s.qwen
FROM ldocs i JOIN summ s ON i.id = s.id WHERE s.lo <> s.hi
""")
def adjudication_payload(spark, sf_dir):
    # The payload is JSON; compare its parsed fields, not its formatting.
    p = V.adjudication_payload(V.disputed_votes(_tv(spark, sf_dir)), _info(spark, sf_dir))
    back = F.from_json("payload", V.PAYLOAD_SCHEMA)
    return p.select("id", back.alias("p")).select("id", "p.text", "p.deepseek", "p.mistral", "p.qwen")


@register("review_sheet", operators=("X10",), sql=f"""
WITH {VOTES}, {TV}, {SUMMARY}, {ADJUDICATIONS}, {LANES}
SELECT id, label, lane, label AS toxicity_fixed, '' AS toxicity_fixed_reason FROM lanes
""")
def review_sheet(spark, sf_dir):
    lanes = V.label_lanes_union(_tv(spark, sf_dir), fx.adjudications(spark, sf_dir))
    return V.review_sheet(lanes, "toxicity")


@register("parse_reply", operators=("C13", "T3"), sql=f"""
WITH {VOTES}, {REPLIES},
p AS (SELECT id, annotator,
             json_extract_string(nullif(regexp_extract(raw, '(?s)\\{{.*\\}}', 0), ''), '$.label') AS label,
             json_extract_string(nullif(regexp_extract(raw, '(?s)\\{{.*\\}}', 0), ''), '$.reason') AS reason
      FROM replies)
SELECT id, annotator, label, reason, CASE WHEN label IS NULL THEN 'error' ELSE 'ok' END AS lane FROM p
""")
def parse_reply(spark, sf_dir):
    return V.parse_reply(fx.replies_raw(spark, sf_dir)).select("id", "annotator", "label", "reason", "lane")


@register("resume_pending", operators=("J8", "T1"), sql="""
WITH b AS (SELECT doc_id AS pos, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 100 + 1 AS BIGINT) AS batch
           FROM documents),
done AS (SELECT DISTINCT batch FROM b WHERE substr(md5(CAST(batch AS VARCHAR)), 1, 1) < '8')
SELECT pos, batch FROM b WHERE batch NOT IN (SELECT batch FROM done)
""")
def resume_pending(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"))
    work = clean.batch_assign(d, "pos", 100)
    done = work.where(F.substring(F.md5(F.col("batch").cast("string")), 1, 1) < "8").select("batch")
    return joins.pending(work, done, "batch").select("pos", "batch")


@register("vote_lanes", operators=("G1", "J2"), sql=f"""
WITH {VOTES}, {GAPPY}
SELECT id, CASE WHEN count(label) <> 3 THEN 'incomplete' WHEN min(label) = max(label) THEN 'similar' ELSE 'different' END AS lane,
       CAST(count(*) AS BIGINT) AS n_votes FROM gvotes GROUP BY id
""")
def vote_lanes(spark, sf_dir):
    return V.vote_summary(fx.votes_with_gaps(spark, sf_dir)).select("id", "lane", "n_votes")
