"""DuckDB statements that give the same rows as the queries, where SQL can express them."""

from __future__ import annotations

# Windows of at least 50 words, shortest from either end; a line goes if a window that covers it
# occurs before, in the order of (document, line).
_LINES = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line, len(regexp_extract_all(ls[i], '\S+')) AS w
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
c AS (SELECT doc_id, pos, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) - w AS before, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM l),
ahead AS (SELECT a.doc_id, a.pos AS f, min(b.pos) AS t FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.before >= 50 GROUP BY ALL),
back AS (SELECT b.doc_id, max(a.pos) AS f, b.pos AS t FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.before >= 50 GROUP BY ALL),
win AS (SELECT * FROM ahead UNION SELECT * FROM back),
txt AS (SELECT w.doc_id, w.f, w.t, list_slice(d.ls, w.f + 1, w.t + 1) AS run FROM win w JOIN d USING (doc_id)),
ord AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, f) AS n FROM txt),
gone AS (SELECT DISTINCT doc_id, unnest(range(f, t + 1)) AS pos FROM ord WHERE n > 1)
SELECT d.doc_id, coalesce(len(d.ls), 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed,
       CASE WHEN g.n IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g USING (doc_id)
LEFT JOIN (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM l ANTI JOIN gone USING (doc_id, pos) GROUP BY 1) k USING (doc_id)
"""

_CHAT = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, u.turn, u.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) u(turn, role)),
e AS (SELECT *, length(replace(replace(replace(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '</s>', '<\/s>'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'))
              + length(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '</s>', '<\/s>'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'))
              + length('<|role|><|text|><|end|>') AS chars FROM t),
o AS (SELECT *, row_number() OVER w AS n, sum(chars) OVER w AS upto, count(*) OVER (PARTITION BY conv_id) AS many
      FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       coalesce(sum(upto) FILTER (role = 'assistant' OR n = many), 0)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, sha1(html) AS payload_digest, strlen(html)::BIGINT AS payload_bytes FROM p),
b AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC) AS n FROM g)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND n > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND n > 1 THEN best END AS refers_to
FROM b
"""

# Every pair of vectors, and labels that sink along links until they rest.
_NEAR = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.r AS x, b.r AS y, b.vec_id FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
c(r, low) AS (SELECT r, vec_id FROM u UNION SELECT p.y, c.low FROM c JOIN p ON p.x = c.r),
n AS (SELECT x, count(*) AS n FROM p GROUP BY 1), m AS (SELECT r, min(low) AS low FROM c GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(m.low, v.vec_id) AS component_id, v.vec_id IS NOT DISTINCT FROM coalesce(m.low, v.vec_id) AS kept
FROM v LEFT JOIN n ON n.x = v.r LEFT JOIN m ON m.r = v.r
"""

ORACLES: dict[str, str] = {"op2_embedding_near_dedup": _NEAR, "op6_chat_formatting": _CHAT, "op7_warc": _WARC, "op9_line_dedup": _LINES}
