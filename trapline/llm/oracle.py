"""DuckDB SQL of the queries that SQL can express (older ones stand beside their queries)."""

from __future__ import annotations


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


#: bit by bit over the id's decimal text, lowest bit first
_CRC32 = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, len({text}) + 1),
           lambda i: list_transform(range(8), lambda k: (ascii(substr({text}, i, 1)) >> k) & 1)))),
           lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)))"""


OP13_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS s, text,
         concat_ws('', {doc_id}, {source}, {lang}, {n_chars}) AS head, {text} AS body, {bare} AS bare, {crc} AS crc
  FROM documents
), leaves AS (
  SELECT rid, doc_id, s, sha256(head || body) AS leaf,
         CASE WHEN crc & 1 = 1  -- before the last complement
              THEN sha256(head || bare) ELSE sha256(head || body) END AS seen
  FROM d
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, count(*) OVER (PARTITION BY s) AS n FROM leaves
), tree AS (
  SELECT 0 AS lvl, s, pos, leaf AS h, n FROM placed
  UNION ALL
  SELECT lvl + 1, s, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY lvl, s, pos // 3, n
), subroots AS (
  SELECT s, h AS subroot FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS lvl, row_number() OVER (ORDER BY s) - 1 AS pos, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, pos // 3, n
), tree_runs AS (
  SELECT lvl, s, pos, n, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM tree WHERE n > 1 WINDOW run AS (PARTITION BY lvl, s, pos // 3 ORDER BY pos)
), top_runs AS (
  SELECT lvl, pos, n, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM top WHERE n > 1 WINDOW run AS (PARTITION BY lvl, pos // 3 ORDER BY pos)
), climbed AS (
  SELECT rid, s, 0 AS lvl, pos, n, seen AS acc, '' AS proof FROM placed
  UNION ALL
  SELECT c.rid, c.s, c.lvl + 1, c.pos // 3, (c.n + 2) // 3, sha256(t.l || c.acc || t.r), c.proof || t.l || t.r
  FROM climbed c JOIN tree_runs t ON c.lvl = t.lvl AND c.s = t.s AND c.pos = t.pos
), crossed AS (
  SELECT c.rid, 0 AS lvl, t.pos, c.acc, c.proof
  FROM climbed c JOIN (SELECT s, row_number() OVER (ORDER BY s) - 1 AS pos FROM subroots) t ON c.s = t.s WHERE c.n = 1
  UNION ALL
  SELECT c.rid, c.lvl + 1, c.pos // 3, sha256(t.l || c.acc || t.r), c.proof || t.l || t.r
  FROM crossed c JOIN top_runs t ON c.lvl = t.lvl AND c.pos = t.pos
)
SELECT p.doc_id, p.leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM placed p JOIN subroots USING (s) CROSS JOIN (SELECT h AS root FROM top WHERE n = 1)
JOIN crossed c ON p.rid = c.rid AND c.lvl = (SELECT max(lvl) FROM top)
""".format(
    **{c: _field(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}, bare=_field("replace(text, chr(10), '')"), crc=_CRC32.format(text="doc_id::VARCHAR")
)


def _least(rows: str) -> str:
    """The least way of each conversation and state."""
    return f"SELECT conv, k, {{s: x.s, w: min(x.w)}} AS x FROM ({rows}) GROUP BY conv, k, x.s"


def _grown(rows: str) -> str:
    """The ways, and each with an inserted row behind it."""
    more = """{s: CASE WHEN x.s = 2 THEN 3 ELSE 2 END, w: {cost: x.w.cost + 5, audit: x.w.audit || 'I',
        said: list_append(x.w.said, CASE WHEN x.s = 2 THEN 'assistant:' ELSE 'user:' END)}}"""
    return f"SELECT conv, k, unnest([x, {more}]) AS x FROM ({rows})"


_EDITED = """
  SELECT p.conv, j.k, unnest(
    [{s: p.x.s, w: {cost: p.x.w.cost + 2, audit: p.x.w.audit || 'D', said: p.x.w.said}}]
    || CASE WHEN j.fault IN ('blank', 'duplicate') THEN [] ELSE
      [{s: CASE WHEN p.x.s = 2 THEN 3 ELSE 2 END, w: {cost: p.x.w.cost + 1 + j.late, audit: p.x.w.audit || 'R',
        said: list_append(p.x.w.said, CASE WHEN p.x.s = 2 THEN 'assistant:' ELSE 'user:' END || j.text)}}] END
    || CASE WHEN j.fault IN ('blank', 'duplicate') THEN [] WHEN j.c = 'u' AND p.x.s <> 2 OR j.c = 'a' AND p.x.s = 2 OR j.c = 's' AND p.x.s = 0 THEN
      [{s: CASE j.c WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 1 END, w: {cost: p.x.w.cost + j.late, audit: p.x.w.audit || 'K',
        said: list_append(p.x.w.said, j.role || ':' || j.text)}}] ELSE [] END) AS x
  FROM ways p JOIN judged j ON p.conv = j.conv AND j.k = p.k + 1
"""

#: states of a way: 0 nothing yet, 1 after s, 2 after u, 3 after a
OP11_SQL = rf"""
WITH RECURSIVE raw AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations
), kinds AS (
  SELECT *, xor({_CRC32.format(text="key")}, 4294967295) % 20 AS kind FROM raw
), changed AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS k,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM changed
), faults AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY k) AS c0
  FROM (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY k) > 1 AS again FROM placed)
), judged AS (
  SELECT *, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS late FROM faults
), counted AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (c0 || c NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n
  FROM judged GROUP BY conv
), ways AS (
  SELECT conv, 0::BIGINT AS k, unnest([
    {{s: 0, w: {{cost: 0, audit: '', said: []::VARCHAR[]}}}}, {{s: 2, w: {{cost: 5, audit: 'I', said: ['user:']}}}},
    {{s: 3, w: {{cost: 10, audit: 'II', said: ['user:', 'assistant:']}}}}]) AS x
  FROM counted
  UNION ALL
  {_least(_grown(_least(_grown(_least(_EDITED)))))}
), ended AS (
  SELECT w.conv, min(x.w) AS w FROM ways w JOIN counted c ON w.conv = c.conv AND w.k = c.n WHERE x.s IN (0, 3) GROUP BY w.conv
), every AS (
  SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv FROM conversations
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(w.cost, 0)::BIGINT AS cost, coalesce(w.audit, '') AS audit,
       sha256(coalesce(array_to_string(w.said, chr(10)), '')) AS repaired_sha256
FROM every LEFT JOIN counted USING (conv) LEFT JOIN ended USING (conv)
"""

OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), places AS (
  SELECT rid, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM d
), grams AS (
  SELECT DISTINCT rid, t FROM (
    SELECT rid, i, concat_ws(' ', w, lead(w, 1) OVER run, lead(w, 2) OVER run, lead(w, 3) OVER run, lead(w, 4) OVER run) AS t, lead(w, 4) OVER run AS fifth
    FROM places WINDOW run AS (PARTITION BY rid ORDER BY i)
  ) WHERE fifth IS NOT NULL OR i = 1
), sets AS (
  SELECT rid, doc_id, coalesce(s, []) AS s FROM d LEFT JOIN (SELECT rid, list(t ORDER BY t) AS s FROM grams GROUP BY rid) USING (rid)
), classes AS (
  SELECT s, len(s) AS n, min(doc_id) AS least, row_number() OVER () AS c FROM sets WHERE len(s) > 0 GROUP BY s
), words AS (
  SELECT c, n, unnest(s) AS t FROM classes
), links AS (
  SELECT a.c AS a, b.c AS b FROM words a JOIN words b ON a.t = b.t AND a.c <> b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached AS (
  SELECT c AS a, c AS b FROM classes
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), components AS (
  SELECT a AS c, min(least) AS component_id FROM reached JOIN classes ON b = c GROUP BY a
)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END AS component_id
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN components USING (c)
"""
