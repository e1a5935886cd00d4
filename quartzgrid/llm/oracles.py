"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: The same rules as mixing.py: sizes, targets by water level, the 60-bit hash, and the cut at the budget.
MIX = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 AS w, (source_size * 3)::DOUBLE AS cap FROM per_source),
running AS (
  SELECT *, coalesce(sum(cap) OVER below, 0) AS caps, coalesce(sum(w) OVER below, 0) AS ws,
         sum(w) OVER () AS all_w, sum(source_size) OVER ()::DOUBLE AS all_size
  FROM weighed
  WINDOW below AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
leveled AS (
  SELECT *, CASE WHEN (all_size - caps) / (all_w - ws) * w <= cap THEN (all_size - caps) / (all_w - ws) END AS level FROM running),
targets AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM leveled),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
lefts AS (SELECT *, floor(target - whole * source_size)::BIGINT AS left_words FROM budgets),
placed AS (
  SELECT s.doc_id, s.size, l.source_size, l.target, l.whole, l.left_words,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run,
         sum(s.size) OVER (PARTITION BY s.source, s.h) AS tied
  FROM sized s JOIN lefts l ON s.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, size, source_size, target,
       (whole * size + CASE WHEN run <= left_words THEN size
                            WHEN run - tied < left_words THEN floor(size * (left_words - (run - tied)) / tied)
                            ELSE 0 END)::BIGINT AS taken
FROM placed
"""

CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
spelled AS (
  SELECT *, length(replace(replace(replace(role, '\', '\b'), '<', '\l'), ':', '\c')) + length(replace(replace(text, '\', '\b'), '<', '\l')) + 16 AS n FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM spelled GROUP BY conv_id
"""


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Sets of five-word shingles, links by intersection over union, components by transitive closure.
JACCARD = rf"""
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingled AS (
  SELECT DISTINCT r, md5(array_to_string(w[i + 1:i + 5], ' ')) AS s
  FROM (SELECT r, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM worded WHERE len(w) > 0)),
sized AS (SELECT r, count(*) AS n FROM shingled GROUP BY r),
shared AS (
  SELECT a.r AS x, b.r AS y, count(*) AS both_have FROM shingled a JOIN shingled b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sized p ON p.r = x JOIN sized q ON q.r = y WHERE 100 * both_have >= 80 * (p.n + q.n - both_have)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(r, other) AS (
  SELECT r, r FROM worded
  UNION
  SELECT reached.r, edges.y FROM reached JOIN edges ON edges.x = reached.other),
least AS (SELECT reached.r, min(doc_id) AS component_id FROM reached JOIN worded ON worded.r = reached.other GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM worded JOIN least USING (r) LEFT JOIN sized USING (r)
"""

#: Every window of an item at every place of a document.
DECONTAMINATION = rf"""
WITH worded AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'), []) AS w FROM documents),
asked AS (
  SELECT item_id::VARCHAR AS item, coalesce(regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'), []) AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i + 1:i + least(len(w), 13)], ' ') AS words
  FROM (SELECT item, w, unnest(range(greatest(len(w) - 12, 1))) AS i FROM asked WHERE len(w) > 0)),
places AS (
  SELECT r, n, i, array_to_string(w[i + 1:i + n], ' ') AS words
  FROM (SELECT r, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM worded, (SELECT DISTINCT n FROM windows))),
found AS (SELECT r, i, windows.n, item FROM places JOIN windows USING (words)),
hit AS (SELECT r, count(DISTINCT i + j)::BIGINT AS n_hit FROM (SELECT r, i, unnest(range(n)) AS j FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY 1),
named AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM worded LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

#: Every 400-byte window of every text; what is kept is put together in hexadecimal digits. And every run of 51 words.
REPEATS = r"""
WITH raw AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, encode(coalesce(text, '')) AS raw_bytes, hex(encode(coalesce(text, ''))) AS h FROM documents),
texts AS (SELECT *, length(h) // 2 AS n FROM raw),
places AS (
  SELECT r, i, md5(raw_bytes[i + 1:i + 400]) AS k FROM (SELECT r, raw_bytes, unnest(range(n - 399)) AS i FROM texts WHERE n >= 400)),
again AS (SELECT k FROM places GROUP BY k HAVING count(*) > 1),
starts AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM places SEMI JOIN again USING (k)),
numbered AS (SELECT r, i, sum(CASE WHEN gap <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS span FROM starts),
spans AS (SELECT r, span, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY 1, 2),
kept AS (
  SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS done,
         string_agg(substr(h, 2 * past + 1, 2 * (a - past)), '' ORDER BY a) AS kept
  FROM (SELECT r, a, b, h, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS past FROM spans JOIN texts USING (r)) GROUP BY 1),
worded AS (SELECT r, regexp_extract_all(t, '[^ 	-
]+') AS w FROM texts),
runs AS (
  SELECT DISTINCT r, md5(array_to_string(w[i + 1:i + 51], ' ')) AS k FROM (SELECT r, w, unnest(range(len(w) - 50)) AS i FROM worded WHERE len(w) > 50)),
passages AS (SELECT DISTINCT r FROM runs WHERE k IN (SELECT k FROM runs GROUP BY k HAVING count(*) > 1))
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE kept || substr(h, 2 * done + 1) END)) AS kept_sha256,
       passages.r IS NOT NULL AS shares_passage
FROM texts LEFT JOIN kept USING (r) LEFT JOIN passages ON passages.r = texts.r
"""

#: The fixed patterns of secrets. Positions come from the lengths of matches and of the gaps that splitting leaves.
SECRETS = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
patterns(kind, name, pattern, part, least) AS (VALUES
  (0, 'assign', '(?i:(password|passwd|secret|token|api_?key))["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', '[0-9a-f]+', 0, 24)),
assigned AS (
  SELECT r, 0 AS kind, string_split_regex(t, '(?i:(password|passwd|secret|token|api_?key))["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)') AS gaps,
         regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)') AS found,
         regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 2) AS parts FROM texts
  UNION ALL SELECT r, 1, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM texts
  UNION ALL SELECT r, 2, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+') FROM texts),
each_one AS (SELECT r, kind, i, length(gaps[i]) AS gap, length(found[i]) AS size, length(parts[i]) AS part FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM assigned)),
placed AS (SELECT r, kind, size, part, sum(gap + size) OVER (PARTITION BY r, kind ORDER BY i) AS stop FROM each_one),
spans AS (
  SELECT r, kind, name, stop - size AS start, stop FROM placed JOIN patterns USING (kind) WHERE placed.part >= least)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(name || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind), '')) AS base_sha256
FROM texts LEFT JOIN spans USING (r) GROUP BY r, doc_id
"""

#: What the media operator stores, and reads back: the bytes of the text and zeros.
PAYLOADS = r"""
SELECT doc_id, strlen(t)::BIGINT AS n_bytes, (greatest(strlen(t) + 63, 64) // 64 * 64)::BIGINT AS payload_bytes,
       sha256(encode(t) || unhex(repeat('00', CASE WHEN strlen(t) = 0 THEN 64 ELSE ((64 - strlen(t) % 64) % 64)::INTEGER END))) AS payload_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard": JACCARD,
        "op4_mixing": MIX,
        "op8_decontamination": DECONTAMINATION,
        "op9_chat": CHAT,
        "op10_repeats": REPEATS,
        "secrets_base": SECRETS,
        "media_payloads": PAYLOADS,
    }
