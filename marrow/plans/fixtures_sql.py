"""DuckDB CTEs that rebuild :mod:`marrow.sources.fixtures` row for row."""

from __future__ import annotations

from marrow.plans.sqltext import q, split_of
from marrow.sources import fixtures as fx

MARKED = f"""marked AS (
  SELECT doc_id, lang, source,
    CASE WHEN doc_id % 13 = 0 THEN {q(fx.NBSP_MARKER)} ELSE '' END ||
    (CASE WHEN doc_id % 43 = 1 THEN '@user' || CAST(doc_id AS VARCHAR)
          WHEN doc_id % 43 = 2 THEN '@user' || CAST(doc_id AS VARCHAR) || ' ' ||
               (CASE WHEN doc_id % 41 = 1 THEN '[removed]' WHEN doc_id % 41 = 2 THEN '[deleted]'
                     WHEN doc_id % 41 = 3 THEN '' ELSE text END)
          WHEN doc_id % 41 = 1 THEN '[removed]' WHEN doc_id % 41 = 2 THEN '[deleted]'
          WHEN doc_id % 41 = 3 THEN '' ELSE text END)
    || CASE WHEN doc_id % 7 = 0 THEN {q(fx.EMOJI_MARKER)} ELSE '' END
    || CASE WHEN doc_id % 11 = 0 THEN {q(fx.URL_MARKER)} ELSE '' END AS text
  FROM documents)"""

SPLIT_DOCS = f"""sdocs AS (SELECT *, {split_of('doc_id')} AS split FROM documents)"""

LABELLED = """ldocs AS (
  SELECT l.doc_id, d.source || '_' || CAST(l.doc_id AS VARCHAR) AS id, d.text,
         d.source AS category, l.toxic, l.quality
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

VOTES = LABELLED + """,
va AS (
  SELECT ld.id, ld.doc_id, ld.toxic,
         unnest([{'annotator': 'deepseek', 'rnk': 1}, {'annotator': 'mistral', 'rnk': 2},
                 {'annotator': 'qwen', 'rnk': 3}]) AS a
  FROM ldocs ld),
vh AS (
  SELECT id, doc_id, toxic, a.annotator AS annotator, a.rnk AS rnk,
         ascii(substr(md5(CAST(doc_id AS VARCHAR) || '|' || a.annotator), 1, 1)) AS h
  FROM va),
votes AS (
  SELECT id, doc_id, 'toxicity' AS task, annotator, CAST(rnk AS INTEGER) AS rnk,
         CASE WHEN (CASE WHEN h % 5 = 0 THEN 1 - toxic ELSE toxic END) = 1 THEN 'TOXIC' ELSE 'NON-TOXIC' END AS label,
         annotator || ' on ' || id AS reason
  FROM vh
  UNION ALL
  SELECT id, doc_id, 'expression_type', annotator, CAST(rnk AS INTEGER),
         CASE (toxic + h % 5) % 3 WHEN 0 THEN 'IMPLICIT' WHEN 1 THEN 'EXPLICIT' ELSE 'REPORT' END,
         annotator || ' on ' || id
  FROM vh)"""

ADJUDICATIONS = """adjud AS (
  SELECT id, 'toxicity' AS task, CASE WHEN toxic = 1 THEN 'TOXIC' ELSE 'NON-TOXIC' END AS label,
         'adjudicated' AS reason FROM ldocs)"""

HUMAN_FINAL = """hfinal AS (
  SELECT id, CASE WHEN substr(md5(CAST(doc_id AS VARCHAR) || '|final'), 1, 1) IN ('0','1','2','3','4')
                  THEN '' WHEN toxic = 1 THEN 'TOXIC' ELSE 'NON-TOXIC' END AS final
  FROM ldocs)"""

REPLIES = """replies AS (
  SELECT id, annotator,
    CASE ascii(substr(md5(CAST(doc_id AS VARCHAR) || '|' || annotator || '|raw'), 1, 1)) % 6
      WHEN 0 THEN '{"label": "' || label || '", "reason": "' || reason || '"}'
      WHEN 1 THEN '```json' || chr(10) || '{"label": "' || label || '", "reason": "' || reason || '"}' || chr(10) || '```'
      WHEN 2 THEN 'Here is my answer:' || chr(10) || '{"label": "' || label || '", "reason": "' || reason || '"}' || chr(10) || 'Thanks.'
      WHEN 3 THEN '{"label": "' || label || '", "reason": "has } inside"}'
      WHEN 4 THEN '{"label": "' || label || '", "reason": '
      ELSE label END AS raw
  FROM votes WHERE task = 'toxicity')"""

HUMAN_REVIEW = """hreview AS (
  SELECT id, doc_id, annotator, label,
         CASE WHEN ascii(substr(md5(CAST(doc_id AS VARCHAR) || '|' || annotator || '|fix'), 1, 1)) % 16 = 1
              THEN 'UNSURE' ELSE label END AS label_fixed, '' AS fixed_reason
  FROM votes WHERE task = 'toxicity')"""

GAPPY = """gvotes AS (
  SELECT * FROM votes WHERE task = 'toxicity'
    AND ascii(substr(md5(CAST(doc_id AS VARCHAR) || '|' || annotator || '|gap'), 1, 1)) % 16 <> 0)"""
