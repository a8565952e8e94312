"""Every query by name, and the DuckDB statement that gives the same rows."""

from __future__ import annotations

from . import history as h
from .history import HOLDS, POLICIES

# The record set in closed form: pieces of the valid axis, and which write each one dies by.
_WRITES = """
w AS (SELECT event_type AS kind, user_id::VARCHAR AS entity_id, event_id AS k, ts AS tx, ts - to_hours(event_id % 97) AS vf,
      CASE WHEN event_id % 5 = 0 THEN 'infinity'::TIMESTAMP ELSE ts + to_hours(1 + event_id % 41) END AS vt,
      CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS intent, 'a' || (event_id % 7) AS actor, props AS data FROM events WHERE {cond})"""
_W = _WRITES.format(cond="true")

_RECORDS = """,
pt AS (SELECT kind, entity_id, vf AS p FROM w UNION SELECT kind, entity_id, vt FROM w),
sg AS (SELECT *, row_number() OVER (PARTITION BY kind, entity_id ORDER BY p) AS i FROM pt),
cv AS (SELECT w.kind, w.entity_id, w.k, s.i, coalesce(lead(w.k) OVER o, 4611686018427387904) AS d, lead(w.tx) OVER o AS dtx
       FROM w JOIN sg s ON w.kind = s.kind AND w.entity_id = s.entity_id AND s.p >= w.vf AND s.p < w.vt
       WINDOW o AS (PARTITION BY w.kind, w.entity_id, s.i ORDER BY w.k)),
nb AS (SELECT a.kind, a.entity_id, a.k, a.i, a.dtx, max(CASE WHEN b.i < a.i THEN b.i END) AS l, min(CASE WHEN b.i > a.i THEN b.i END) AS r
       FROM cv a LEFT JOIN cv b ON a.kind = b.kind AND a.entity_id = b.entity_id AND a.k = b.k AND b.d < a.d GROUP BY ALL),
rc AS (SELECT DISTINCT n.kind, n.entity_id, n.k, CASE WHEN n.l IS NULL THEN w.vf ELSE sl.p END AS valid_from,
       CASE WHEN n.r IS NULL THEN w.vt ELSE sr.p END AS vt, greatest(w.tx, cl.dtx, cr.dtx) AS tx_from, n.dtx AS tx_to, w.tx, w.intent AS wi, w.actor, w.data
       FROM nb n JOIN w USING (kind, entity_id, k)
       LEFT JOIN cv cl ON cl.kind = n.kind AND cl.entity_id = n.entity_id AND cl.k = n.k AND cl.i = n.l
       LEFT JOIN cv cr ON cr.kind = n.kind AND cr.entity_id = n.entity_id AND cr.k = n.k AND cr.i = n.r
       LEFT JOIN sg sl ON sl.kind = n.kind AND sl.entity_id = n.entity_id AND sl.i = n.l + 1
       LEFT JOIN sg sr ON sr.kind = n.kind AND sr.entity_id = n.entity_id AND sr.i = n.r),
r AS (SELECT kind, entity_id, k, valid_from, CASE WHEN vt < 'infinity' THEN vt END AS valid_to, tx_from, tx_to,
      CASE WHEN tx_from = tx THEN wi ELSE 2 END AS intent, actor, data,
      lpad(k::VARCHAR, 12, '0') || '-' || epoch_us(tx_from) || '-' || coalesce(epoch_us(valid_from)::VARCHAR, 'min') || '-' || substr(sha256(kind || chr(31) || entity_id), 1, 10) AS id FROM rc)
"""


def _log(cond: str = "true") -> str:
    """The records of the writes that meet a condition."""
    return f"WITH {_WRITES.format(cond=cond)}{_RECORDS}"


_L = _log()
_S = "kind, entity_id, k, valid_from, valid_to, tx_from, tx_to, intent"
_V, _E, _T = "TIMESTAMP '2024-01-12'", "TIMESTAMP '2024-01-15'", "TIMESTAMP '2024-01-25'"


def _in(a: str, b: str, t: str) -> str:
    return f"({a} IS NULL OR {a} <= {t}) AND ({b} IS NULL OR {b} > {t})"


def _at(t: str, tx: str) -> str:
    return _in("valid_from", "valid_to", t) + " AND " + _in("tx_from", "tx_to", tx)


def _where(cond: str) -> str:
    return f"{_L} SELECT {_S}, id FROM r WHERE {cond}"


def _paged(order: str) -> str:
    return f"{_L} SELECT n - 200 AS position, {_S}, id FROM (SELECT *, row_number() OVER (ORDER BY tx_from {order}, valid_from {order}, id {order}) AS n FROM r WHERE kind = 'view') WHERE n BETWEEN 201 AND 300"


_FIELD = f"""{_L}, f AS (SELECT *, json_extract(data, '$.k')::VARCHAR AS v FROM r WHERE {_in("valid_from", "valid_to", _V)}),
g AS (SELECT *, lag(v) OVER o AS pv, row_number() OVER o AS n FROM f WINDOW o AS (PARTITION BY kind, entity_id ORDER BY tx_from, valid_from, id)),
c AS (SELECT * FROM g WHERE n = 1 OR pv <> v)
SELECT kind, entity_id, row_number() OVER (PARTITION BY kind, entity_id ORDER BY tx_from {{o}}, valid_from {{o}}, id {{o}}) AS position, tx_from, actor, intent, n > 1 AS from_present, pv AS from_value, true AS to_present, v AS to_value FROM c"""

_null = lambda x: "NULL" if x is None else f"'{x}'"
_RETAIN = f"""{_L}, po(kind, days) AS (VALUES {", ".join(f"('{k}', {d.days})" for k, d in POLICIES)}),
ho(hold_id, kind, entity_id, f, placed, rel) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}', TIMESTAMP '{d}', {e}, {_null(g)}::TIMESTAMP)" for a, b, c, d, e, g in HOLDS)}),
s AS (SELECT r.*, TIMESTAMP '2024-01-30' - to_days(days) AS cutoff FROM r JOIN po USING (kind)),
x AS (SELECT s.*, (SELECT arg_min(hold_id, placed) FROM ho WHERE f <= TIMESTAMP '2024-01-30' AND (rel IS NULL OR rel > TIMESTAMP '2024-01-30') AND (ho.kind = '' OR ho.kind = s.kind) AND (ho.entity_id = '' OR ho.entity_id = s.entity_id)) AS hold_id,
      tx_to IS NOT NULL AND tx_to <= cutoff AS eligible FROM s WHERE tx_from < cutoff)
"""
_TIME = "coalesce(strftime({0}, '%Y-%m-%dT%H:%M:%S.%fZ'), '')"
_SIZE = "from_hex(CASE WHEN {0} < 128 THEN printf('%02X', {0}) ELSE printf('%02X%02X', ({0} & 127) | 128, {0} >> 7) END)"
_FIELDS = ["id", "kind", "entity_id", "data", *(_TIME.format(c) for c in ("valid_from", "valid_to", "tx_from")), "actor", "''", "''", "''"]
_CANON = "'\\x01'::BLOB || " + " || ".join(f"{_SIZE.format(f'octet_length(encode({x}))')} || encode({x})" for x in _FIELDS) + " || from_hex(printf('%02X', intent)) || '\\x00'::BLOB"


def _chain(cond: str = "true") -> str:
    """q: records in chain order, h: their hashes; the records that meet a condition are chained."""
    return f"""WITH RECURSIVE {_L.removeprefix("WITH ")}, q AS (SELECT *, {_CANON} AS canon, row_number() OVER (PARTITION BY kind, entity_id ORDER BY tx_from, valid_from, id) AS n FROM r WHERE {cond}),
h AS (SELECT kind, entity_id, 0::BIGINT AS n, NULL::VARCHAR AS id, sha256('palimpsest/chain/v1' || chr(31) || kind || chr(31) || entity_id) AS hash FROM q WHERE n = 1
      UNION ALL SELECT q.kind, q.entity_id, q.n, q.id, sha256(unhex(h.hash) || q.canon) FROM h JOIN q ON q.kind = h.kind AND q.entity_id = h.entity_id AND q.n = h.n + 1)
"""


_CHAIN = _chain()
_GONE = "(eligible AND hold_id IS NULL)"
_SWEPT = f"{_CHAIN.replace('WITH RECURSIVE', 'WITH RECURSIVE', 1)}, {_RETAIN.removeprefix(_L).removeprefix(', ')}"
# Rules broken by number, in the order in which they are checked.
_ERROR = """CASE event_id % 101 WHEN 1 THEN 'unknown_kind' WHEN 2 THEN 'missing_entity_id' WHEN 3 THEN 'missing_actor' WHEN 4 THEN 'invalid_field' WHEN 10 THEN 'invalid_field'
WHEN 5 THEN 'invalid_interval' WHEN 6 THEN 'invalid_field' WHEN 7 THEN 'reserved_meta' WHEN 8 THEN 'invalid_meta' WHEN 9 THEN 'invalid_meta' END"""
_TICKET = "CASE WHEN k % 3 <> 0 THEN 't' || (k % 11) END AS ticket"
_PLACED = ", ".join(f"('{a}', '{b}', '{c}', TIMESTAMP '{d}', 'legal', TIMESTAMP '2024-01-01' + to_hours({n + 1}), {"TIMESTAMP '2024-01-01 10:00'" if a == 'h4' else 'NULL::TIMESTAMP'}, {"'judge'" if a == 'h4' else 'NULL'}, {"'settled'" if a == 'h4' else 'NULL'})" for n, (a, b, c, d, *_) in enumerate(HOLDS))

ORACLES = {
    "put_split_log": f"{_L} SELECT {_S}, actor, data FROM r",
    "put_split_log_set": f"{_L} SELECT {_S}, actor, data FROM r",
    "current_tiling": f"{_L} SELECT {_S} FROM r WHERE tx_to IS NULL",
    "asof_get": f"{_L}, p AS (SELECT kind, entity_id, min(tx) AS valid_at FROM w GROUP BY ALL) SELECT kind, entity_id, valid_at, k, tx_from, intent, data FROM r JOIN p USING (kind, entity_id) WHERE {_at('valid_at', _T)}",
    "belief_shift": f"""{_L}, b AS (SELECT kind, entity_id, max(k) FILTER ({_in("tx_from", "tx_to", _E)}) AS k_then, max(k) FILTER (tx_to IS NULL) AS k_now FROM r WHERE {_in("valid_from", "valid_to", _V)} GROUP BY ALL)
SELECT * FROM b WHERE k_then IS DISTINCT FROM k_now""",
    "timeline_at": f"{_L} SELECT kind, entity_id, row_number() OVER (PARTITION BY kind, entity_id ORDER BY valid_from, tx_from) AS position, k, valid_from, valid_to, intent FROM r WHERE {_in('tx_from', 'tx_to', _E)}",
    "history_filtered": _where(f"kind = 'click' AND entity_id = '8' AND valid_from < TIMESTAMP '2024-01-20' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-05') AND tx_from < {_T}"),
    "query_by_actor": _where("actor = 'a3'"),
    "query_valid_overlap": _where("kind = 'view' AND valid_from < TIMESTAMP '2024-01-11' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-10')"),
    "query_tx_overlap": _where("tx_from < TIMESTAMP '2024-01-12' AND (tx_to IS NULL OR tx_to > TIMESTAMP '2024-01-10')"),
    "query_intent": _where("intent = 1"),
    "query_current_only": _where("kind = 'error' AND tx_to IS NULL"),
    "query_point": _where(_at(_V, _E)),
    "keyset_page_asc": _paged("ASC"),
    "keyset_page_desc": _paged("DESC"),
    "last_page_empty": f"""{_L}, v AS (SELECT id, ceil(count(*) OVER () / 7)::BIGINT AS size, row_number() OVER (ORDER BY tx_from, valid_from, id) - 1 AS up, row_number() OVER (ORDER BY tx_from DESC, valid_from DESC, id DESC) - 1 AS down FROM r WHERE kind = 'view')
SELECT false AS descending, (up // size)::INTEGER AS page, up::INTEGER AS place, id FROM v UNION ALL SELECT true, (down // size)::INTEGER, down::INTEGER, id FROM v""",
    "diff_flat": f"""{_L}, a AS (SELECT kind, entity_id, json_extract(data, '$.k')::VARCHAR AS x FROM r WHERE {_at(_V, _E)}), b AS (SELECT kind, entity_id, json_extract(data, '$.k')::VARCHAR AS y FROM r WHERE {_at(_V, _T)})
SELECT kind, entity_id, 0 AS position, '/k' AS path, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' ELSE 'modified' END AS op, x AS old, y AS new FROM a FULL JOIN b USING (kind, entity_id) WHERE x IS DISTINCT FROM y""",
    "field_history_asc": _FIELD.format(o="ASC"),
    "field_history_desc": _FIELD.format(o="DESC"),
    "changed_field": f"""{_L} SELECT n.kind, count(*) AS changed FROM r n JOIN r o ON n.kind = o.kind AND n.entity_id = o.entity_id AND o.tx_to = n.tx_from AND o.valid_from <= n.valid_from AND (o.valid_to IS NULL OR o.valid_to > n.valid_from)
WHERE n.intent = 1 AND json_extract(n.data, '$.k')::VARCHAR <> json_extract(o.data, '$.k')::VARCHAR GROUP BY 1""",
    "remainder_attribution": f"{_L} SELECT actor, CASE intent WHEN 0 THEN 'assert' WHEN 1 THEN 'correction' ELSE 'remainder' END AS intent_name, count(*) AS n, count(*) FILTER (tx_to IS NULL) AS open FROM r GROUP BY ALL",
    "non_overlap_violations": f"""{_L}, o AS (SELECT valid_from, lag(valid_to) OVER w1 AS b, row_number() OVER w1 AS n FROM r WHERE tx_to IS NULL WINDOW w1 AS (PARTITION BY kind, entity_id ORDER BY valid_from))
SELECT count(*) AS neighbours, count(*) FILTER (b IS NULL OR b > valid_from) AS violations FROM o WHERE n > 1""",
    "coverage_gaps": f"""{_L}, o AS (SELECT kind, entity_id, valid_from, lag(valid_to) OVER (PARTITION BY kind, entity_id ORDER BY valid_from) AS b FROM r WHERE tx_to IS NULL)
SELECT kind, entity_id, b AS gap_from, valid_from AS gap_to, date_diff('microsecond', b, valid_from) AS gap_us FROM o WHERE b < valid_from""",
    "coverage_monotone": f"""{_L}, o AS (SELECT *, greatest(valid_from, TIMESTAMP '2023-07-01') AS a, least(coalesce(valid_to, TIMESTAMP '2024-07-01'), TIMESTAMP '2024-07-01') AS b FROM r),
s AS (SELECT *, date_diff('microsecond', a, b) AS us FROM o WHERE a < b)
SELECT kind, entity_id, coalesce(sum(us) FILTER ({_in("tx_from", "tx_to", _E)}), 0)::BIGINT AS early_us, coalesce(sum(us) FILTER ({_in("tx_from", "tx_to", _T)}), 0)::BIGINT AS late_us, 0::BIGINT AS lost_us FROM s GROUP BY ALL""",
    "ratchet": f"""WITH {_W}, c AS (SELECT kind, entity_id, k, (floor(date_diff('second', TIMESTAMP '2024-01-01', tx) / 86400) * 86400000000)::BIGINT AS clock, row_number() OVER o AS n FROM w WINDOW o AS (PARTITION BY kind, entity_id ORDER BY k))
SELECT kind, entity_id, k, (max(clock - n) OVER (PARTITION BY kind, entity_id ORDER BY k) + n)::BIGINT AS tx_us FROM c""",
    "entities_touched": f"WITH {_W} SELECT DISTINCT kind, entity_id FROM w",
    "interval_algebra": f"""WITH {_W}, v AS (SELECT *, CASE WHEN vt < 'infinity' THEN vt END AS e FROM w), a AS (SELECT *, lag(vf) OVER o AS pf, lag(e) OVER o AS pt, row_number() OVER o AS n FROM v WINDOW o AS (PARTITION BY kind, entity_id ORDER BY k))
SELECT k, (e IS NULL OR pf < e) AND (pt IS NULL OR vf < pt) AS overlap, pf < vf AS before, (pt IS NULL AND e IS NOT NULL) OR coalesce(pt > e, false) AS beyond, vf <= pf AND (e IS NULL OR e > pf) AS holds,
e IS NULL OR vf < e AS valid, date_diff('microsecond', vf, e) AS us, '[' || strftime(vf, '%Y-%m-%dT%H:%M:%S.%fZ') || ', ' || coalesce(strftime(e, '%Y-%m-%dT%H:%M:%S.%fZ'), '∞') || ')' AS shown FROM a WHERE n > 1""",
    "pointer_escape": "SELECT event_id, replace(replace(event_type || '~/' || props, '~', '~0'), '/', '~1') AS token FROM events",
    "retention_plan": f"{_RETAIN} SELECT id, kind, entity_id, tx_to FROM x WHERE eligible AND hold_id IS NULL",
    "retention_withheld": f"{_RETAIN} SELECT id, kind, entity_id, hold_id FROM x WHERE eligible AND hold_id IS NOT NULL",
    "retention_report": f"{_RETAIN} SELECT kind, count(*) AS examined, count(*) FILTER (eligible AND hold_id IS NULL) AS deleted, count(*) FILTER (eligible AND hold_id IS NOT NULL) AS withheld FROM x GROUP BY 1",
    "chain_stamp": f"{_CHAIN} SELECT id, kind, entity_id, 'v1:' || hash AS token FROM h WHERE n > 0",
    "chain_incremental": f"{_CHAIN} SELECT id, kind, entity_id, 'v1:' || hash AS token FROM h WHERE n > 0",
    "chain_verify_intact": f"{_CHAIN} SELECT kind, entity_id, max(n) AS entries, max(n) AS chained, 0::BIGINT AS tombstones, 0::BIGINT AS unchained, 'intact' AS status, NULL::INTEGER AS position, 'v1:' || arg_max(hash, n) AS head FROM h GROUP BY ALL",
    "chain_verify_tampered": f"""{_CHAIN}, f AS (SELECT *, min(n) FILTER (k % 50 = 7) OVER (PARTITION BY kind, entity_id) AS bad FROM q)
SELECT kind, entity_id, count(*) FILTER (bad IS NULL OR n < bad) AS chained, CASE WHEN min(bad) IS NULL THEN 'intact' ELSE 'broken' END AS status, min(bad)::INTEGER AS position, arg_min(id, n) FILTER (k % 50 = 7) AS bad_id FROM f GROUP BY ALL""",
    "chain_verify_moved_end": f"""{_CHAIN} SELECT kind, entity_id, CASE WHEN count(*) FILTER (k % 50 = 7 AND tx_to IS NOT NULL) > 0 THEN 'broken' ELSE 'intact' END AS status,
CASE WHEN count(*) FILTER (k % 50 = 7 AND tx_to IS NOT NULL) > 0 THEN 0 END AS position, arg_min(id, n) FILTER (k % 50 = 7 AND tx_to IS NOT NULL) AS bad_id FROM q GROUP BY ALL""",
    "chain_unchained_prefix": f"""{_L} SELECT kind, entity_id, count(*) AS entries, count(*) FILTER (tx_from >= TIMESTAMP '2024-01-05') AS chained, count(*) FILTER (tx_from < TIMESTAMP '2024-01-05') AS unchained,
CASE WHEN count(*) FILTER (tx_from >= TIMESTAMP '2024-01-05') = 0 THEN 'no_chain' ELSE 'intact' END AS status FROM r GROUP BY ALL""",
    "chain_heads": f"{_CHAIN}, f AS (SELECT h.*, q.k FROM h JOIN q USING (kind, entity_id, n)) SELECT kind, entity_id, 'v1:' || arg_max(hash, n) FILTER (k % 50 <> 7) AS head FROM f GROUP BY ALL",
    "tombstone_gap": f"""{_CHAIN}, e AS (SELECT *, k % 60 = 31 AS dead, row_number() OVER o AS p, lag(n) OVER o AS before FROM q WHERE k % 60 <> 7 WINDOW o AS (PARTITION BY kind, entity_id ORDER BY n)),
t AS (SELECT DISTINCT kind, entity_id, tx_from FROM e),
v AS (SELECT e.kind, e.entity_id, min(p) FILTER (NOT dead AND n <> coalesce(before, 0) + 1) AS bad, count(*) FILTER (NOT dead AND e.tx_to IS NOT NULL AND t.tx_from IS NULL) AS moved
      FROM e LEFT JOIN t ON t.kind = e.kind AND t.entity_id = e.entity_id AND t.tx_from = e.tx_to GROUP BY ALL)
SELECT kind, entity_id, CASE WHEN bad IS NULL THEN 'intact' ELSE 'broken' END AS status, bad::INTEGER AS position FROM v WHERE bad IS NOT NULL OR moved = 0""",
    "sweep_executed": f"""{_RETAIN}, c AS (SELECT kind, count(*) AS n FROM r GROUP BY 1)
SELECT kind, count(*) AS examined, count(*) FILTER {_GONE.replace("(", "(WHERE ", 1)} AS deleted, count(*) FILTER (eligible AND hold_id IS NOT NULL) AS withheld, count(*) FILTER {_GONE.replace("(", "(WHERE ", 1)} AS tombstones,
any_value(c.n) - count(*) FILTER {_GONE.replace("(", "(WHERE ", 1)} AS left FROM x JOIN c USING (kind) GROUP BY 1""",
    "chain_after_sweep": f"""{_RETAIN}, d AS (SELECT id, true AS gone FROM x WHERE {_GONE})
SELECT kind, entity_id, count(*) AS entries, count(*) FILTER (gone IS NULL) AS chained, count(gone) AS tombstones, 'intact' AS status FROM r LEFT JOIN d USING (id) GROUP BY ALL""",
    "tombstones_left": f"{_SWEPT} SELECT h.id, h.kind, h.entity_id, x.valid_from, x.tx_from, 'v1:' || h.hash AS token FROM x JOIN h USING (id) WHERE {_GONE}",
    "hold_activity": f"""WITH {_W}, ho(hold_id, kind, entity_id, f, placed, rel) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}', TIMESTAMP '{d}', {e}, {_null(g)}::TIMESTAMP)" for a, b, c, d, e, g in HOLDS)}), e AS (SELECT DISTINCT kind, entity_id FROM w)
SELECT hold_id, f <= TIMESTAMP '2024-01-30' AND (rel IS NULL OR rel > TIMESTAMP '2024-01-30') AS active, count(*) AS entities FROM ho JOIN e ON (ho.kind = '' OR ho.kind = e.kind) AND (ho.entity_id = '' OR ho.entity_id = e.entity_id) GROUP BY ALL""",
    "holds_placed": f"""SELECT *, 'hold_exists missing_hold_id missing_actor invalid_field hold_released not_found missing_actor missing_hold_id' AS refused
FROM (VALUES {_PLACED}) t(hold_id, kind, entity_id, effective_from, placed_by, placed_at, released_at, released_by, release_reason)""",
    "put_errors": f"SELECT event_id AS k, {_ERROR} AS error_code FROM events WHERE event_id % 101 BETWEEN 1 AND 10",
    "put_validated": f"{_log('event_id % 101 NOT BETWEEN 1 AND 10')} SELECT {_S}, actor AS actor_id, 'r' || (k % 13) AS reason, {_TICKET} FROM r",
    "remainder_meta": f"{_L} SELECT k, valid_from, tx_from, upper(actor) AS actor_name, 'user' AS actor_type, 'r' || (k % 13) AS reason, {_TICKET} FROM r WHERE intent = 2",
    "key_destroyed": f"WITH {_W} SELECT actor, CASE actor WHEN 'a0' THEN 'plain' WHEN 'a2' THEN 'shredded' ELSE 'open' END AS status, count(*) AS n, count(*) FILTER (actor <> 'a2') AS same FROM w GROUP BY 1",
    "shred_status": f"""{_L} SELECT id, kind, entity_id, CASE actor WHEN 'a0' THEN 'plain' WHEN 'a2' THEN 'shredded' WHEN 'a3' THEN 'no_keyring' WHEN 'a4' THEN 'codec' WHEN 'a5' THEN 'unknown_cipher' ELSE 'open' END AS status,
CASE WHEN actor IN ('a0', 'a1', 'a6') THEN data END AS data FROM r""",
    "diff_nested": """WITH e AS (SELECT event_id AS k, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
c AS (SELECT k, 1 AS o, '/n/x' AS path, 'modified' AS op, (p % 3)::VARCHAR AS old, (k % 3)::VARCHAR AS new FROM e WHERE p % 3 <> k % 3
UNION ALL SELECT k, 2, '/n/y/0', 'modified', (p % 5)::VARCHAR, (k % 5)::VARCHAR FROM e WHERE p % 5 <> k % 5
UNION ALL SELECT k, 3, '/n/y/1', 'modified', (p % 2) || '.0', (k % 2) || '.0' FROM e WHERE p % 2 <> k % 2
UNION ALL SELECT k, 4, '/o', CASE WHEN k % 7 < 3 THEN 'added' ELSE 'removed' END, CASE WHEN p % 7 < 3 THEN 'null' END, CASE WHEN k % 7 < 3 THEN 'null' END FROM e WHERE (p % 7 < 3) <> (k % 7 < 3)
UNION ALL SELECT k, 5, '/s', 'modified', '"p' || (p % 4) || '"', '"p' || (k % 4) || '"' FROM e WHERE p % 4 <> k % 4)
SELECT k AS event_id, (row_number() OVER (PARTITION BY k ORDER BY o) - 1)::INTEGER AS position, path, op, old, new FROM c""",
    "current_overlapping": f"{_L} SELECT kind, entity_id, row_number() OVER (PARTITION BY kind, entity_id ORDER BY valid_from) AS position, id FROM r WHERE tx_to IS NULL AND valid_from < TIMESTAMP '2024-01-13' AND (valid_to IS NULL OR valid_to > {_V})",
    "closures_only": f"{_L} SELECT id, CASE WHEN tx_to IS NULL AND k % 2 = 0 THEN TIMESTAMP '2024-02-28' ELSE tx_to END AS tx_to FROM r WHERE kind = 'error'",
    "rfc3339_render": """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN '.12' WHEN event_id % 1000 = 0 THEN ''
ELSE '.' || rtrim(lpad((event_id % 1000)::VARCHAR, 6, '0'), '0') END || 'Z' AS text FROM events""",
    "rfc3339_parse": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) + INTERVAL 250 MILLISECONDS - INTERVAL 2 HOURS WHEN 4 THEN date_trunc('second', ts) + INTERVAL 90 MINUTES END AS at FROM events""",
    "uvarint_prefix": """WITH n AS (SELECT event_id, event_id * event_id AS n, octet_length(encode(props)) AS m, props FROM events)
SELECT event_id, CASE WHEN n < 128 THEN printf('%02X', n) WHEN n < 16384 THEN printf('%02X%02X', n & 127 | 128, n >> 7) WHEN n < 2097152 THEN printf('%02X%02X%02X', n & 127 | 128, (n >> 7) & 127 | 128, n >> 14)
WHEN n < 268435456 THEN printf('%02X%02X%02X%02X', n & 127 | 128, (n >> 7) & 127 | 128, (n >> 14) & 127 | 128, n >> 21)
ELSE printf('%02X%02X%02X%02X%02X', n & 127 | 128, (n >> 7) & 127 | 128, (n >> 14) & 127 | 128, (n >> 21) & 127 | 128, n >> 28) END AS bytes,
printf('%02X', m) || hex(encode(props)) AS prefixed FROM n""",
    "data_rendering": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props END AS json, CASE event_id % 3 WHEN 1 THEN base64(encode(props || '}')) WHEN 2 THEN '/wD+' END AS base64 FROM events",
    "meta_checks": "SELECT event_id AS k, event_id % 101 = 6 OR (event_id % 101 = 5 AND event_id % 2 = 0) AS nul, event_id % 101 = 7 AS reserved FROM events",
}

QUERIES = {name: getattr(h, name) for name in ORACLES}
