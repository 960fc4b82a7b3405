"""DuckDB SQL for the queries that SQL can express, written independently of the operators."""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: words ``[^\x20\x09-\x0D]+``
_WORD = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP2 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_WORD}) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, hash(CASE WHEN len(w) >= 4 THEN list_slice(w, i, i + 3) ELSE w END) AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n m ON m.doc_id = x JOIN n o ON o.doc_id = y WHERE 100 * c >= 85 * (m.n + o.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT DISTINCT x AS node, x AS seen FROM e UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(d.doc_id, q.least), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(seen) AS least FROM r GROUP BY node) q USING (doc_id)
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, list_slice(w, i, i + least(len(w), 10) - 1) AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, m, i, list_slice(w, i, i + m - 1) AS win FROM (
  SELECT doc_id, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) AS i FROM d, (SELECT DISTINCT m FROM bw) s)),
h AS (SELECT doc_id, dw.m, i, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (
        SELECT doc_id, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT doc_id, m, i FROM h)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_JUMP = """j{n} AS (
  SELECT doc_id, CAST(key AS HUGEINT) AS key, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM k
  UNION ALL
  SELECT doc_id, nk, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / ((nk // 8589934592) + 1)::DOUBLE)) AS BIGINT) FROM (
    SELECT doc_id, j, (key * 2862933555777941757 + 1) % 18446744073709551616 AS nk FROM j{n} WHERE j < {n})),
s{n} AS (SELECT doc_id, max(b) AS shard FROM j{n} WHERE j >= {n} GROUP BY doc_id)"""

OP7 = f"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tbl FROM range(256) t(i)),
t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, octet_length(encode(text)) + 1 AS size,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
    regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda c, v: xor(c >> 8, tbl[CAST(xor(c, v) & 255 AS INTEGER) + 1]))) AS text_crc32 FROM t, bits),
k AS (SELECT doc_id, CAST('0x' || substr(md5('k' || doc_id), 1, 15) AS BIGINT) AS key FROM t),
{_JUMP.format(n=16)}, {_JUMP.format(n=17)}
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law,
  CAST(s16.shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY s16.shard ORDER BY substr(md5(doc_id || ':' || size || ':' || text_crc32), 1, 3), doc_id) - 1 AS slot,
  CAST(s17.shard AS INTEGER) AS grown_shard
FROM c JOIN s16 USING (doc_id) JOIN s17 USING (doc_id)
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
l AS (SELECT doc_id, line, count(*) - 1 AS more
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {_WORD}) GROUP BY 1, 2),
wh AS (SELECT doc_id, m, i, hash(list_slice(w, i, i + m - 1)) AS h FROM (
  SELECT doc_id, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) AS i FROM d, (VALUES (4), (8)) s(m))),
win AS (SELECT doc_id, m, i, count(*) OVER (PARTITION BY doc_id, m, h) AS n FROM wh),
cov AS (SELECT doc_id, count(DISTINCT k) FILTER (m = 8) AS n8, count(DISTINCT k) FILTER (m = 4) AS n4
        FROM (SELECT doc_id, m, unnest(range(i, i + m)) AS k FROM win WHERE n > 1) GROUP BY doc_id),
long AS (SELECT DISTINCT doc_id FROM (
  SELECT doc_id FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 199, 1))) AS i
                      FROM d JOIN cov USING (doc_id) WHERE n8 > 200)
  GROUP BY doc_id, hash(list_slice(w, i, i + 200)) HAVING count(*) > 1)),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce((SELECT sum(more) FROM l WHERE l.doc_id = d.doc_id), 0) AS BIGINT) AS n_dup_lines,
        coalesce(n8, 0) AS n_repeat_words, coalesce(n4, 0) AS n4,
        doc_id IN (SELECT doc_id FROM long) AS too_long
      FROM d LEFT JOIN cov USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n4 <= 0.5 * n_words AND NOT too_long AS kept, n4 / greatest(n_words, 1) AS covered
FROM v
"""

OP10 = rf"""
WITH o AS (SELECT doc_id, line_no, regexp_extract_all(lower(line), {_WORD}) AS w FROM (
  SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
x AS (SELECT w, len(w) AS n, min((doc_id, line_no)) AS first FROM o WHERE len(w) >= 4 GROUP BY w),
z AS (SELECT w, first, k, hash(list_concat(list_slice(w, 1, k - 1), list_slice(w, k + 1, n))) AS v, n - 1 AS m
      FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM x WHERE n >= 10)),
whole AS (SELECT w, first, hash(w) AS v, n FROM x WHERE n >= 10),
near AS (
  SELECT a.w FROM (SELECT w, first, min(first) OVER (PARTITION BY v, k) AS least FROM z) a WHERE a.first > a.least
  UNION SELECT z.w FROM z JOIN whole s ON z.v = s.v AND z.m = s.n WHERE z.first > s.first
  UNION SELECT s.w FROM z JOIN whole s ON z.v = s.v AND z.m = s.n WHERE s.first > z.first),
lost AS (SELECT doc_id, line_no FROM o JOIN x USING (w) WHERE (doc_id, line_no) > x.first OR w IN (SELECT w FROM near)),
per AS (SELECT doc_id, count(*) AS n_dropped, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS dropped_lines
        FROM lost GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
  coalesce(dropped_lines, '') AS dropped_lines
FROM documents d LEFT JOIN per USING (doc_id)
"""

#: CRC-32 of an expression's UTF-8 bytes by the table ``tbl`` of ``_BITS``
_BITS = """bits AS (
  SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tbl FROM range(256) t(i))"""


def _crc32(x: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
    regexp_extract_all(hex(encode({x})), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda c, v: xor(c >> 8, tbl[CAST(xor(c, v) & 255 AS INTEGER) + 1])))"""


def _edit(state: str, op: str, cost: str, line: str) -> str:
    return (f"CASE WHEN {state} IS NOT NULL THEN "
            f"{{'c': {state}.c + {cost}, 'p': {state}.p || '{op}', 't': {state}.t || {line}}} END")


def _row(target: str, froms: str, initial: str | None) -> str:
    """The best way into a state by one row: from itself by a delete, from ``froms`` by keep or rerole."""
    ways = [_edit(f"v.{target}", "D", "2", "''")]
    for q in froms:
        ways.append(f"CASE WHEN ok AND ini = '{initial}' THEN " + _edit(f"v.{q}", "K", "more", "chr(10) || role || ':' || text") + " END")
        if initial != "s":
            made = {"u": "user", "a": "assistant"}[initial]
            ways.append("CASE WHEN ok THEN " + _edit(f"v.{q}", "R", "more + 1", f"chr(10) || '{made}:' || text") + " END")
    return f"list_min([{', '.join(ways)}])"


OP12 = rf"""
WITH RECURSIVE {_BITS},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS d
      FROM conversations, bits),
r AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
        CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE d <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
        regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM r),
f AS (SELECT *, substr(role, 1, 1) AS ini, CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
        WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
g AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS ok, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more,
        lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM f),
c AS (SELECT DISTINCT conv_id FROM conversations),
v AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0::BIGINT, 'p': '', 't': ''}} AS z,
    CAST(NULL AS STRUCT(c BIGINT, p VARCHAR, t VARCHAR)) AS s,
    {{'c': 5::BIGINT, 'p': 'I', 't': chr(10) || 'user:'}} AS u,
    {{'c': 10::BIGINT, 'p': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS a FROM c
  UNION ALL
  SELECT conv_id, i, z, s, u, list_min([a, {_edit("u", "I", "5", "chr(10) || 'assistant:'")}]) FROM (
    SELECT conv_id, i, z, s, a, list_min([u, {", ".join(_edit(q, "I", "5", "chr(10) || 'user:'") for q in "zsa")}]) AS u FROM (
      SELECT v.conv_id, g.i, {_row("z", "", None)} AS z, {_row("s", "z", "s")} AS s, {_row("u", "zsa", "u")} AS u,
        {_row("a", "u", "a")} AS a
      FROM v JOIN g ON v.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = v.i + 1) x) y),
best AS (SELECT conv_id, list_min([z, a]) AS b FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
        count(*) FILTER (WHERE fault = 'truncated') AS truncated,
        count(*) FILTER (WHERE prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT best.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(b.c AS BIGINT) AS cost, b.p AS audit,
  sha256(substr(b.t, 2)) AS repaired_sha256
FROM best LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM best.conv_id
"""

OP13 = rf"""
WITH {_BITS},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM documents),
f AS (SELECT r, unnest(w) AS word FROM d),
q AS (SELECT unnest(regexp_extract_all({_LOW}, {_ALNUM})) AS word FROM benchmark),
m AS (SELECT word, {_crc32("word")} % 10000 AS bucket FROM (SELECT word FROM f UNION SELECT word FROM q), bits),
s AS (SELECT bucket, count(*) AS n FROM f JOIN m USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM q JOIN m USING (word) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE)
    / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM q) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN m USING (word) JOIN gain USING (bucket) GROUP BY r),
x AS (SELECT r, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN w USING (r)),
y AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM x LEFT JOIN y USING (r)
"""

ORACLES = {
    "op2_partenum_jaccard": OP2,
    "op6_benchmark_decontamination": OP6,
    "op7_jump_hash_sharding": OP7,
    "op8_suffix_repetition": OP8,
    "op10_line_dedup": OP10,
    "op12_conversation_repair": OP12,
    "op13_importance_resampling": OP13,
}
