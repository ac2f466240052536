"""SQL of the keyword filter's stages, written with plain global windows."""

from __future__ import annotations

ASCII_EDGE = "[^A-Za-z0-9_]"
UNICODE_EDGE = r"[^\p{L}\p{N}_]"


def keyword_sql(words: list[str], edge: str = ASCII_EDGE) -> str:
    return f"(?i)(^|{edge})({'|'.join(words)})($|{edge})"


TS_SQL = r"TRY_CAST(regexp_extract(line, '\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}') AS TIMESTAMP)"
CORE_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}', '', 'g'),
    '\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}[.,]\p{Nd}+', '', 'g'), '\[.*?\]', '', 'g'), '\p{Nd}+', '#', 'g'))"""
SEEN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def eff_sql(keys: str = "file") -> str:
    return f"""eff AS (SELECT *, last_value(ts IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY pos {SEEN}) AS eff_ts
    FROM (SELECT *, {TS_SQL} AS ts FROM src))"""


def kept_sql(start: str | None, end: str | None, keys: str = "file") -> str:
    low = f"eff_ts >= {start}" if start else "TRUE"
    high = f"eff_ts <= {end}" if end else "TRUE"
    return f"""{eff_sql(keys)},
  kept AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY pos) - 1 AS line_index
    FROM eff WHERE eff_ts IS NULL OR (({low}) AND ({high})))"""


def selected_sql(pattern: str, context: int, max_results: int | None = None) -> str:
    cap = f"AND n <= {max_results}" if max_results else ""
    return f"""hits AS (SELECT *, regexp_matches(line, '{pattern}') AS hit,
      count(*) FILTER (regexp_matches(line, '{pattern}')) OVER (PARTITION BY file ORDER BY line_index {SEEN}) AS n FROM kept),
  sel AS (SELECT * EXCLUDE (hit, n) FROM (SELECT *, hit {cap} AS is_match, bool_or(hit {cap}) OVER
      (PARTITION BY file ORDER BY line_index ROWS BETWEEN {context} PRECEDING AND {context} FOLLOWING) AS near FROM hits)
    WHERE near)"""


def ranked_sql(priority: str = "0") -> str:
    return f"ranked AS (SELECT *, CAST({priority} AS BIGINT) AS priority FROM sel)"


EFFECTIVE = "CASE WHEN is_match THEN 1000 ELSE 0 END"
INTENDED = """(CASE WHEN is_match THEN 1000 ELSE 0 END) + (CASE
    WHEN contains(upper(line), 'LOGLEVEL.E') OR contains(upper(line), 'EXCEPTION') THEN 200
    WHEN contains(upper(line), 'LOGLEVEL.D') OR contains(upper(line), 'LOGLEVEL.I') THEN 100
    WHEN contains(upper(line), 'LOGLEVEL.ANALYTICS') THEN 50 ELSE 0 END)"""


def dedup_sql(on: bool = True, keys: str = "file") -> str:
    if not on:
        return "uniq AS (SELECT * FROM ranked)"
    return f"""uniq AS (SELECT * EXCLUDE (copy) FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, {CORE_SQL}
      ORDER BY priority DESC, line_index) AS copy FROM ranked) WHERE copy <= 3)"""


RENDER = "'[Line ' || line_index || '] ' || CASE WHEN is_match THEN '>>>' ELSE '   ' END || ' ' || line"


def budget_sql(chars: int | str, matches_first: bool = True, keys: str = "file") -> str:
    rendered = f"r AS (SELECT *, {RENDER} AS rendered, length({RENDER}) + 1 AS cost FROM uniq)"
    order = "ORDER BY priority DESC, line_index ROWS UNBOUNDED PRECEDING"
    if not matches_first:
        return f"""{rendered},
  inc AS (SELECT * EXCLUDE (upto) FROM (SELECT *, sum(cost) OVER (PARTITION BY {keys} {order}) AS upto FROM r)
    WHERE upto <= {chars})"""
    return f"""{rendered},
  run AS (SELECT *, sum(cost) OVER (PARTITION BY {keys}, is_match {order}) AS upto FROM r),
  fits AS (SELECT *, coalesce(max(CASE WHEN is_match AND upto <= {chars} THEN upto END) OVER (PARTITION BY {keys}), 0) AS spent FROM run),
  inc AS (SELECT * EXCLUDE (upto, spent) FROM fits WHERE CASE WHEN is_match THEN upto <= {chars} ELSE upto + spent <= {chars} END)"""


def outcome_sql(matches_first: bool = True, keys: str = "file") -> str:
    split = "TRUE" if matches_first else "FALSE"
    return f"""tot AS (SELECT {keys}, count(*) AS total, count(*) FILTER (is_match) AS direct, count(*) FILTER (NOT is_match) AS context,
      count(*) FILTER (contains(upper(line), 'ERROR') OR contains(upper(line), 'EXCEPTION')) AS errors,
      count(*) FILTER (contains(upper(line), 'WARN')) AS warnings FROM uniq GROUP BY ALL),
  used AS (SELECT {keys}, count(*) FILTER (is_match) AS d, count(*) FILTER (NOT is_match) AS c FROM inc GROUP BY ALL),
  outc AS (SELECT {keys}, total, direct, context, errors, warnings,
      CASE WHEN {split} THEN direct - coalesce(d, 0) ELSE 0 END AS left_direct,
      CASE WHEN {split} THEN context - coalesce(c, 0) ELSE 0 END AS left_context,
      CASE WHEN {split} THEN 0 ELSE total - coalesce(d, 0) - coalesce(c, 0) END AS left_entries,
      coalesce(d, 0) + coalesce(c, 0) + CASE WHEN total > coalesce(d, 0) + coalesce(c, 0) THEN 1 ELSE 0 END AS included
    FROM tot LEFT JOIN used USING ({keys}))"""


def report_sql(matches_first: bool = True, keys: str = "file") -> str:
    order = "line_index" if matches_first else "priority DESC, line_index"
    return f"""body AS (SELECT {keys}, list(rendered || chr(10) ORDER BY {order}) AS texts FROM inc GROUP BY ALL),
  rep AS (SELECT {keys}, '=== LOG ANALYSIS SUMMARY ===' || chr(10) || 'Total filtered entries: ' || total || chr(10)
      || '  - Direct keyword matches: ' || direct || chr(10) || '  - Context lines: ' || context || chr(10)
      || 'Included in output: ' || included || chr(10) || 'Errors/Exceptions: ' || errors || chr(10)
      || 'Warnings: ' || warnings || chr(10) || 'Estimated tokens: ~' || included * 20 || ' (approximate)' || chr(10)
      || 'Legend: >>> = direct match, (indented) = context line' || chr(10) || chr(10) || repeat('=', 80) || chr(10) || chr(10)
      || array_to_string(list_concat(coalesce(texts, []), CASE WHEN left_direct + left_context + left_entries = 0 THEN [] ELSE [
        CASE WHEN left_direct > 0 THEN chr(10) || '... (truncated, ' || left_direct || ' more direct matches) ...' || chr(10) ELSE '' END ||
        CASE WHEN left_context > 0 THEN '... (truncated, ' || left_context || ' more context lines) ...' || chr(10) ELSE '' END ||
        CASE WHEN left_entries > 0 THEN chr(10) || '... (truncated, ' || left_entries || ' more entries) ...' || chr(10) ELSE '' END] END), chr(10)) AS report
    FROM outc LEFT JOIN body USING ({keys}))"""
