"""SQL that says the same as the registered queries, for an engine with plain windows.

It runs over the same whole tables.  Patterns are simpler than the library's where the made-up
logs allow it.
"""

from __future__ import annotations

from hushlog.plans.views import SEQ_STEP

_EVENTS = """
events_log AS (
  SELECT 'structured' AS kind, 'events' AS source, event_id AS seq, epoch_us(ts) // 1000 // 3600 AS event_ms,
    concat('svc.', user_id % 2) AS logger,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'view' THEN 'DEBUG'
      ELSE 'INFO' END AS level,
    CASE event_type
      WHEN 'click' THEN concat('Chunk [', event_id % 32, ', -', user_id % 16, '] loaded in ', event_id % 500, 'ms')
      WHEN 'view' THEN concat('Object@', substr(md5(CAST(event_id AS VARCHAR)), 1, 10), ' drawn at (',
        event_id % 100, '.5, 64.0, -', user_id % 50, '.25)')
      WHEN 'signup' THEN concat('Player ', substr(md5(CAST(user_id AS VARCHAR)), 1, 8), '-0000-4000-8000-',
        substr(md5(CAST(event_id AS VARCHAR)), 1, 12), ' joined')
      WHEN 'purchase' THEN concat('World save behind by ', event_id % 90, ' ticks')
      ELSE concat('Handler failed after ', event_id % 7000, 'ms') END AS message
  FROM events)"""

_MIXED = """
mixed AS (
  SELECT CASE WHEN seq % 13 = 0 THEN 'numeric' ELSE kind END AS kind, source, seq, event_ms,
    CASE WHEN seq % 11 = 0 THEN NULL WHEN seq % 17 = 0 THEN 'hushlog.notices' ELSE logger END AS logger,
    CASE WHEN seq % 7 = 0 THEN NULL WHEN seq % 19 = 0 THEN 'ALL' ELSE level END AS level,
    CASE WHEN seq % 26 = 0 THEN '' ELSE message END AS message
  FROM events_log),
routed AS (
  SELECT *, CASE WHEN kind = 'structured' AND logger = 'hushlog.notices' THEN 'pass'
      WHEN kind = 'numeric' AND coalesce(message, '') = '' THEN 'pass'
      WHEN level IS NULL OR level = 'ALL' THEN 'pass'
      WHEN logger = 'svc.1' THEN 'deny'
      WHEN logger IS NULL OR logger NOT IN ('svc.0', 'svc.1') THEN 'pass'
      ELSE 'check' END AS route
  FROM mixed)"""

_SHIFTS = """
shift_log AS (
  SELECT * REPLACE (concat('shift.', (event_ms // 60000) % 3) AS logger,
    event_ms - event_ms % 60000 + (event_ms % 60000) // 30 AS event_ms) FROM events_log)"""

_ON_TIME = """
early AS (SELECT min(event_ms) + (max(event_ms) - min(event_ms)) // 4 AS until_ms FROM events_log),
on_time AS (SELECT * FROM events_log WHERE NOT (seq % 9 = 0 AND event_ms < (SELECT until_ms FROM early)))"""

_HEX = "[0-9a-f]"


def _template(message: str) -> str:
    steps = [
        (f"{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}", "*UUID*"),
        (f"@{_HEX}{{6,16}}", "@*"),
        (r"\(-?[0-9.]+, -?[0-9.]+, -?[0-9.]+\)", "(*, *, *)"),
        (r"\[-?[0-9]+, *-?[0-9]+\]", "[*, *]"),
        (r"[0-9]+ms", "*ms"),
        (r"[0-9]+ tick", "* tick"),
    ]
    for pattern, wildcard in steps:
        message = f"regexp_replace({message}, '{pattern}', '{wildcard}', 'g')"
    return message


_WINDOW = """CASE
    WHEN contains(lower(message), 'chunk') OR contains(lower(message), 'loading') THEN 500
    WHEN contains(lower(message), 'entity') OR contains(lower(message), 'tick')
      OR contains(lower(message), 'particle') THEN 100
    WHEN contains(lower(message), 'save') OR contains(lower(message), 'world') THEN 4000
    ELSE 2000 END"""

_THRESHOLD = (
    "CASE WHEN level IN ('FATAL', 'ERROR') THEN 5 WHEN level = 'WARN' THEN 10"
    " WHEN level = 'INFO' THEN 20 ELSE 3 END"
)


def _bursts(rows: str) -> str:
    """CTEs up to ``decided`` over checked log rows."""
    return f"""
keyed AS (
  SELECT *, {_template('message')} AS template, {_WINDOW} AS window_ms, {_THRESHOLD} AS threshold
  FROM {rows}),
gaps AS (
  SELECT *, event_ms - lag(event_ms) OVER key_order AS gap FROM keyed
  WINDOW key_order AS (PARTITION BY logger, level, template ORDER BY event_ms, source, seq)),
breaks AS (
  SELECT *, CAST(gap IS NULL OR gap > 20000 AS BIGINT) AS new_life,
    CAST(gap IS NULL OR gap > 20000 OR gap > window_ms AS BIGINT) AS new_burst FROM gaps),
numbered AS (
  SELECT *, CAST(sum(new_life) OVER key_order AS BIGINT) AS life_no,
    CAST(sum(new_burst) OVER key_order AS BIGINT) AS burst_no,
    row_number() OVER key_order AS pos FROM breaks
  WINDOW key_order AS (PARTITION BY logger, level, template ORDER BY event_ms, source, seq)),
decided AS (
  SELECT *, row_number() OVER burst AS n, first_value(event_ms) OVER burst AS first_ms,
    event_ms - first_value(event_ms) OVER burst AS duration_ms,
    first_value(event_ms) OVER life AS life_start_ms,
    (row_number() OVER burst) <= threshold AS allowed
  FROM numbered
  WINDOW burst AS (PARTITION BY logger, level, template, burst_no ORDER BY event_ms, source, seq),
    life AS (PARTITION BY logger, level, template, life_no ORDER BY event_ms, source, seq)),
counted AS (
  SELECT *, NOT allowed AND n >= greatest(threshold + 1, 100)
    AND (n - greatest(threshold + 1, 100)) % 100 = 0 AS report FROM decided)"""


_SUFFIX = (
    "concat(' [suppressed ', n - 1, ' times over ', ((duration_ms + 50) // 100) // 10, '.',"
    " ((duration_ms + 50) // 100) % 10, 's]')"
)

_LINES = f"""
all_lines AS (
  SELECT o_orderkey AS k, 0 AS ord, CASE o_orderstatus
      WHEN 'F' THEN concat('shop.OrderException: o', o_orderkey % 50)
      ELSE concat('order accepted in ', o_orderkey % 900, 'ms') END AS line
  FROM orders
  UNION ALL
  SELECT l_orderkey, l_linenumber,
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 4 THEN 'Caused by: shop.StepException: retry'
      WHEN l_linenumber = 7 THEN ''
      ELSE concat(chr(9), 'at shop.p', l_partkey % 3, '.Step.run(Step.java:', l_linenumber, ')') END
  FROM lineitem),
raw_lines AS (
  SELECT concat('host', k % 8) AS source,
    (k * 16 + ord) * {SEQ_STEP} + row_number() OVER (PARTITION BY k, ord ORDER BY line) - 1 AS seq,
    1000 + k * 10 + ord AS event_ms, line
  FROM all_lines),
line_kinds AS (
  SELECT *, regexp_replace(line, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS trimmed FROM raw_lines),
marks AS (
  SELECT *, contains(line, 'Exception') OR (contains(line, 'Error') AND (contains(line, '.') OR contains(line, ':'))) AS opens,
    line <> '' AND NOT (trimmed = '' OR starts_with(trimmed, 'at ') OR starts_with(trimmed, 'Caused by:')
      OR starts_with(trimmed, 'Suppressed:') OR starts_with(trimmed, '...')) AS resets
  FROM line_kinds),
blocks AS (
  SELECT *, sum(CAST(resets AS INT)) OVER (PARTITION BY source ORDER BY seq) AS blk FROM marks),
inside AS (
  SELECT *, bool_or(opens) OVER (PARTITION BY source, blk ORDER BY seq) AS ins FROM blocks),
messages AS (
  SELECT source, min(seq) AS seq, min(event_ms) AS event_ms, string_agg(line, chr(10) ORDER BY seq) AS message,
    count(*) AS n_lines
  FROM inside WHERE line <> '' OR ins
  GROUP BY source, ins, CASE WHEN ins THEN blk ELSE seq END),
console AS (
  SELECT 'console' AS kind, source, seq, event_ms, 'System.err' AS logger, 'ERROR' AS level, message, n_lines
  FROM messages)"""


def _frames(depth: int = 0) -> str:
    past = f"coalesce(depth >= {depth}, false)" if depth else "false"
    return f"""
traces AS (
  SELECT concat(source, '/', seq) AS trace_id, message AS text FROM messages WHERE n_lines > 1),
trace_parts AS (
  SELECT trace_id, string_split(regexp_replace(text, '\\n+\\z', ''), chr(10)) AS parts FROM traces),
trace_lines AS (
  SELECT trace_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS pos FROM trace_parts),
trace_trimmed AS (
  SELECT *, regexp_replace(line, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS trimmed FROM trace_lines),
trace_called AS (
  SELECT *, regexp_extract(trimmed, '^at (.*)\\([^(]*\\)$', 1) AS called FROM trace_trimmed),
trace_kinds AS (
  SELECT *, CASE WHEN starts_with(trimmed, 'Caused by:') OR starts_with(trimmed, 'Suppressed:') THEN 'cause'
      WHEN starts_with(trimmed, '... ') AND suffix(trimmed, ' more') THEN 'more'
      WHEN contains(called, '.') THEN 'frame' ELSE 'other' END AS kind
  FROM trace_called),
trace_methods AS (
  SELECT *, CASE WHEN kind = 'frame' THEN called END AS method,
    CASE WHEN kind = 'frame' THEN regexp_extract(called, '^(.*)\\.[^.]*\\.[^.]*$', 1) END AS package,
    CAST(sum(CAST(kind = 'cause' AS INT)) OVER (PARTITION BY trace_id ORDER BY pos) AS BIGINT) AS segment
  FROM trace_kinds),
trace_dups AS (
  SELECT *, kind = 'frame' AND row_number() OVER (PARTITION BY trace_id, segment, method ORDER BY pos) > 1 AS is_dup
  FROM trace_methods),
trace_depths AS (
  SELECT *, CASE WHEN kind = 'frame' AND NOT is_dup THEN CAST(sum(CAST(kind = 'frame' AND NOT is_dup AS INT))
      OVER (PARTITION BY trace_id, segment ORDER BY pos) - 1 AS BIGINT) END AS depth
  FROM trace_dups),
trace_past AS (SELECT *, {past} AS past FROM trace_depths),
trace_cut AS (
  SELECT *, bool_or(past) OVER (PARTITION BY trace_id ORDER BY pos) AS cut FROM trace_past),
trace_frames AS (SELECT *, NOT is_dup AND NOT cut AS kept FROM trace_cut),
trace_clean AS (
  SELECT trace_id, concat(string_agg(CASE WHEN kept THEN line END, chr(10) ORDER BY pos),
      CASE WHEN bool_or(cut) THEN concat(chr(10), regexp_extract(arg_min(CASE WHEN cut THEN line END,
          CASE WHEN cut THEN pos END), '^(.*?)at', 1),
        '... ', count(*) FILTER (NOT kept), ' more') ELSE '' END) AS text
  FROM trace_frames GROUP BY trace_id)"""


_TEXTS = """
text_parts AS (
  SELECT doc_id, source, lang,
    string_split(regexp_replace(replace(text, chr(13), ''), '\\n\\z', ''), chr(10)) AS parts
  FROM documents WHERE text <> ''),
text_lines AS (
  SELECT doc_id, source, lang, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS pos FROM text_parts),
text_log AS (
  SELECT source AS logger, lang AS level, concat('doc', doc_id) AS source, pos AS seq, doc_id AS event_ms,
    line AS message FROM text_lines)"""

_ASCII_TEXTS = _TEXTS.replace("line AS message", "regexp_replace(line, '[^\\x00-\\x7F]', '?', 'g') AS message")

_TEXT_STATS = """
text_stats AS (
  SELECT logger, level, message AS template, min(event_ms) AS first_ms, max(event_ms) AS last_ms, count(*) AS n_rows
  FROM text_log GROUP BY ALL)"""

_KEY_COLUMNS = "source, seq, logger, level"
_SHOWN = (
    "kind, source, seq, event_ms, logger, level, n - 1 AS suppressed,"
)
_SAME_KEY = (
    "c.logger IS NOT DISTINCT FROM d.logger AND c.level IS NOT DISTINCT FROM d.level"
    " AND c.template = d.template"
)
_CONSOLE_SHOWN = """
cleaned_console AS (
  SELECT c.*, coalesce(t.text, c.message) AS shown
  FROM counted c LEFT JOIN trace_clean t ON t.trace_id = concat(c.source, '/', c.seq))"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(parts)


_DECIDED = _with(_EVENTS, _bursts("events_log"))
_CONSOLE = _with(_LINES, _bursts("console"), _frames(), _CONSOLE_SHOWN)

SQL = {
    "suppression_by_template": f"""{_DECIDED}
SELECT level, template, count(*) AS processed, count(*) FILTER (NOT allowed) AS suppressed
FROM decided GROUP BY level, template""",
    "structured_events": """
SELECT 'events' AS source, event_id AS seq, concat('svc.', user_id % 2) AS logger, 'INFO' AS level,
  epoch_us(ts) // 1000 AS event_ms,
  CASE event_type
    WHEN 'view' THEN concat('user ', user_id, ' saw ',
      CASE WHEN event_id % 3 > 0 THEN concat('{}', props) ELSE 'null' END, ' at 100%')
    WHEN 'error' THEN concat('user ', user_id, ' failed')
    WHEN 'click' THEN concat('user ', user_id, ' clicked ',
      CASE WHEN event_id % 3 > 0 THEN concat('{}', props) ELSE 'null' END, ' {}')
    ELSE '' END AS message
FROM events""",
    "numeric_level_events": f"""{_with(_EVENTS)}
SELECT source, seq, logger, event_ms, message, CASE WHEN seq * 37 % 1300 >= 1000 THEN 'ERROR'
  WHEN seq * 37 % 1300 >= 900 THEN 'WARN' WHEN seq * 37 % 1300 >= 800 THEN 'INFO'
  WHEN seq * 37 % 1300 >= 500 THEN 'DEBUG' ELSE 'TRACE' END AS level
FROM events_log""",
    "text_lines": f"{_with(_TEXTS)} SELECT doc_id, pos, line FROM text_lines",
    "assembled_messages": f"{_with(_LINES)} SELECT source, seq, event_ms, message, n_lines FROM messages",
    "all_sources": f"""{_with(_EVENTS, _LINES)}
SELECT kind, logger, level, count(*) AS n_rows, min(event_ms) AS first_ms FROM (
  SELECT kind, logger, level, event_ms FROM events_log
  UNION ALL
  SELECT 'numeric', logger, CASE WHEN seq * 37 % 1300 >= 1000 THEN 'ERROR'
    WHEN seq * 37 % 1300 >= 900 THEN 'WARN' WHEN seq * 37 % 1300 >= 800 THEN 'INFO'
    WHEN seq * 37 % 1300 >= 500 THEN 'DEBUG' ELSE 'TRACE' END, event_ms FROM events_log
  UNION ALL
  SELECT kind, logger, level, event_ms FROM console) u
GROUP BY kind, logger, level""",
    "routed_events": f"{_with(_EVENTS, _MIXED)} SELECT {_KEY_COLUMNS}, kind, route FROM routed",
    "routed_totals": f"""{_with(_EVENTS, _MIXED)}
SELECT logger, count(*) AS n_rows, count(*) FILTER (route = 'check') AS processed,
  count(*) FILTER (route = 'deny') AS denied_by_list
FROM routed GROUP BY logger""",
    "list_routes": """
SELECT source, seq, logger, level, kind, CASE WHEN level IS NULL THEN 'pass'
    WHEN logger IN (SELECT concat('user.', c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'deny'
    WHEN logger IN (SELECT concat('user.', c_custkey) FROM customer WHERE c_acctbal > 0) THEN 'check'
    ELSE 'pass' END AS route
FROM (SELECT 'structured' AS kind, 'events' AS source, event_id AS seq,
  CASE WHEN event_id % 11 > 0 THEN concat('user.', user_id) END AS logger,
  CASE WHEN event_id % 7 > 0 THEN 'INFO' END AS level FROM events) u""",
    "event_templates": f"""{_with(_EVENTS)}
SELECT seq, {_template('message')} AS template,
  concat('[', level, '/', logger, '] ', {_template('message')}) AS label FROM events_log""",
    "event_template_stats": f"""{_with(_EVENTS)}
SELECT logger, level, {_template('message')} AS template, min(event_ms) AS first_ms,
  max(event_ms) AS last_ms, count(*) AS n_rows
FROM events_log GROUP BY ALL""",
    "text_template_stats": f"{_with(_TEXTS, _TEXT_STATS)} SELECT * FROM text_stats",
    "chat_top_templates": """
SELECT role AS logger, 'INFO' AS level, text AS template, min(conv_id * 1000 + turn) AS first_ms,
  max(conv_id * 1000 + turn) AS last_ms, count(*) AS n_rows
FROM conversations GROUP BY role, text ORDER BY n_rows DESC, first_ms, logger, level, template LIMIT 25""",
    "template_leaders": f"""{_with(_ASCII_TEXTS, _TEXT_STATS, '''
ranked AS (
  SELECT *, length(template) AS len,
    row_number() OVER (PARTITION BY logger, level ORDER BY first_ms, template) AS pos FROM text_stats),
pairs AS (
  SELECT a.logger, a.level, a.pos AS earlier, b.pos AS later,
    greatest(a.len, b.len) AS longer,
    CASE WHEN greatest(a.len, b.len) > 200 THEN abs(a.len - b.len)
      ELSE levenshtein(a.template, b.template) END AS distance
  FROM ranked a JOIN ranked b ON a.logger = b.logger AND a.level = b.level AND a.pos < b.pos
    AND abs(a.len - b.len) <= 0.15 * greatest(a.len, b.len)),
alike AS (
  SELECT logger, level, later, list(earlier ORDER BY earlier) AS before FROM pairs
  WHERE trunc((longer - distance) / CAST(longer AS DOUBLE) * 100) >= 85 GROUP BY ALL),
nodes AS (
  SELECT r.logger, r.level, r.pos, coalesce(a.before, []) AS before
  FROM ranked r LEFT JOIN alike a ON a.logger = r.logger AND a.level = r.level AND a.later = r.pos),
walk AS (
  SELECT logger, level, pos, pos AS leader, [pos] AS leaders FROM nodes WHERE pos = 1
  UNION ALL
  SELECT n.logger, n.level, n.pos, coalesce(list_min(list_intersect(n.before, w.leaders)), n.pos),
    CASE WHEN len(list_intersect(n.before, w.leaders)) = 0 THEN list_append(w.leaders, n.pos) ELSE w.leaders END
  FROM walk w JOIN nodes n ON n.logger = w.logger AND n.level = w.level AND n.pos = w.pos + 1)''', recursive=True)}
SELECT r.logger, r.level, r.template, l.template AS leader_template
FROM walk w JOIN ranked r ON r.logger = w.logger AND r.level = w.level AND r.pos = w.pos
JOIN ranked l ON l.logger = w.logger AND l.level = w.level AND l.pos = w.leader""",
    "window_classes": f"""{_with(_EVENTS, _TEXTS)}
SELECT source, seq, CAST({_WINDOW} AS BIGINT) AS window_ms FROM (
  SELECT source, seq, message FROM text_log UNION ALL SELECT source, seq, message FROM events_log) u""",
    "level_thresholds": f"""{_with(_EVENTS, _MIXED)}
SELECT seq, level, CAST({_THRESHOLD} AS BIGINT) AS threshold FROM mixed""",
    "event_bursts": f"""{_DECIDED}
SELECT {_KEY_COLUMNS}, template, life_no, burst_no, n, first_ms, duration_ms FROM decided""",
    "idle_bursts": f"""{_with(_EVENTS, _SHIFTS, _bursts("shift_log"))}
SELECT {_KEY_COLUMNS}, template, life_no, burst_no, n, first_ms, duration_ms FROM decided""",
    "event_burst_table": f"""{_DECIDED}
SELECT logger, level, template, life_no, burst_no, min(event_ms) AS first_ms, max(event_ms) AS last_ms,
  count(*) AS n_rows, count(*) FILTER (NOT allowed) AS suppressed
FROM decided GROUP BY ALL""",
    "event_decisions": f"""{_DECIDED}
SELECT seq, n, CAST(threshold AS BIGINT) AS threshold, allowed FROM decided""",
    "count_reports": f"""{_DECIDED}
SELECT {_KEY_COLUMNS}, n, duration_ms FROM counted WHERE report""",
    "full_reports": f"""{_with(_EVENTS, _bursts('events_log'), f'''
held AS (SELECT * FROM decided WHERE NOT allowed),
chain AS (
  SELECT DISTINCT logger, level, template, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS n,
    CAST(0 AS BIGINT) AS event_ms, CAST(0 AS BIGINT) AS burst_no, CAST(0 AS BIGINT) AS life_no
  FROM held
  UNION ALL
  SELECT d.logger, d.level, d.template, min(d.pos), arg_min(d.n, d.pos), arg_min(d.event_ms, d.pos),
    arg_min(d.burst_no, d.pos), arg_min(d.life_no, d.pos)
  FROM chain c JOIN held d ON {_SAME_KEY} AND d.pos > c.pos
    AND (d.n - CASE WHEN d.burst_no = c.burst_no THEN c.n ELSE 0 END >= 100
      OR d.event_ms - CASE WHEN d.life_no = c.life_no THEN c.event_ms ELSE d.life_start_ms END > 10000)
  GROUP BY d.logger, d.level, d.template)''', recursive=True)}
SELECT d.source, d.seq, d.logger, d.level, d.n, d.duration_ms
FROM chain c JOIN held d ON {_SAME_KEY} AND d.pos = c.pos""",
    "event_notices": f"""{_DECIDED}
SELECT {_SHOWN} concat('[', coalesce(logger, 'null'), '] ',
  CASE WHEN length(message) > 100 THEN concat(substr(message, 1, 100), '...') ELSE message END, {_SUFFIX}) AS text
FROM counted WHERE report""",
    "console_notices": f"""{_CONSOLE}
SELECT {_SHOWN} concat(shown, {_SUFFIX}) AS text FROM cleaned_console WHERE report""",
    "surviving_events": f"""{_with(_EVENTS, '''
checked AS (SELECT * FROM events_log WHERE logger <> 'svc.1')''', _bursts('checked'))}
SELECT kind, source, seq, event_ms, logger, level, message FROM counted WHERE allowed
UNION ALL
SELECT 'structured', source, seq, event_ms, 'hushlog.notices', 'INFO', concat('[', logger, '] ',
  CASE WHEN length(message) > 100 THEN concat(substr(message, 1, 100), '...') ELSE message END, {_SUFFIX})
FROM counted WHERE report""",
    "surviving_console": f"""{_CONSOLE}
SELECT kind, source, seq, event_ms, logger, level,
  CASE WHEN allowed THEN message ELSE concat(shown, {_SUFFIX}) END AS message
FROM cleaned_console WHERE allowed OR report""",
    "trace_frames": f"""{_with(_LINES, _frames())}
SELECT trace_id, pos, segment, kind, method, package, is_dup, depth, kept, line FROM trace_frames""",
    "cleaned_traces": f"{_with(_LINES, _frames())} SELECT trace_id, text FROM trace_clean",
    "shortened_traces": f"{_with(_LINES, _frames(1))} SELECT trace_id, text FROM trace_clean",
    "hot_methods": f"""{_with(_LINES, _frames())}
SELECT method, count(*) AS n_frames, count(*) FILTER (kept) AS n_kept
FROM trace_frames WHERE kind = 'frame' GROUP BY method""",
    "suppression_by_level": f"""{_DECIDED}
SELECT level, count(*) AS processed, count(*) FILTER (NOT allowed) AS suppressed,
  count(*) FILTER (NOT allowed) * CAST(100 AS DOUBLE) / count(*) AS rate_pct
FROM decided GROUP BY level""",
    "suppression_overall": f"""{_with(_EVENTS, _MIXED, '''
checked AS (SELECT * FROM routed WHERE route = 'check')''', _bursts('checked'))}
SELECT count(*) AS processed, count(*) FILTER (NOT allowed) AS suppressed,
  count(*) FILTER (NOT allowed) * CAST(100 AS DOUBLE) / count(*) AS rate_pct
FROM decided""",
    "stream_bursts": f"""{_DECIDED}
SELECT logger, level, template, min(event_ms) AS first_ms, max(event_ms) AS last_ms, count(*) AS n_rows,
  count(*) FILTER (NOT allowed) AS suppressed
FROM decided GROUP BY logger, level, template, burst_no""",
    "stream_late": f"""{_with(_EVENTS, _ON_TIME, _bursts("on_time"))}
SELECT seq, n, allowed, (SELECT count(*) FROM events_log) - (SELECT count(*) FROM on_time) AS n_late
FROM decided""",
    "stream_messages": f"{_with(_LINES)} SELECT source, seq, event_ms, message, n_lines FROM messages",
    "stream_totals": f"""{_DECIDED}
SELECT event_ms - event_ms % 60000 AS slice_ms, level, count(*) AS processed,
  count(*) FILTER (NOT allowed) AS suppressed
FROM decided GROUP BY ALL""",
}
SQL["stream_decisions"] = SQL["full_reports"].replace(
    "SELECT d.source, d.seq, d.logger, d.level, d.n, d.duration_ms\nFROM chain c JOIN held d ON "
    f"{_SAME_KEY} AND d.pos = c.pos",
    f"SELECT d.seq, d.n, d.allowed, c.pos IS NOT NULL AS report\nFROM decided d LEFT JOIN chain c ON "
    f"{_SAME_KEY} AND d.pos = c.pos",
)
SQL["stream_survivors"] = SQL["full_reports"].replace(
    "SELECT d.source, d.seq, d.logger, d.level, d.n, d.duration_ms\nFROM chain c JOIN held d ON "
    f"{_SAME_KEY} AND d.pos = c.pos",
    f"""SELECT kind, source, seq, event_ms, logger, level, message FROM decided WHERE allowed
UNION ALL
SELECT 'structured', source, seq, event_ms, 'hushlog.notices', 'INFO', concat('[', logger, '] ',
  CASE WHEN length(message) > 100 THEN concat(substr(message, 1, 100), '...') ELSE message END, {_SUFFIX})
FROM (SELECT d.* FROM chain c JOIN held d ON {_SAME_KEY} AND d.pos = c.pos)""",
)
SQL["stream_expiry"] = (
    SQL["stream_decisions"]
    .replace(_EVENTS, f"{_EVENTS},{_SHIFTS}")
    .replace("FROM events_log),\ngaps", "FROM shift_log),\ngaps")
    .replace("SELECT d.seq, d.n,", "SELECT d.seq, d.logger, d.first_ms, d.n,")
)
