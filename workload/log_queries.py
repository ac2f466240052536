"""Queries over single logs: scanning, dates, keywords, duplicates, budget, report."""

from __future__ import annotations

from pyspark.sql import functions as F

from logtriage.config import KeywordFilterConfig
from logtriage.functions.text import core_message, line_timestamp, lines_of, render_line
from logtriage.operators import ordered_scan, selection
from logtriage.operators.keywords import any_keyword, keyword_counts
from logtriage.operators.log_view import date_literals, fetch_text, number_lines, with_context
from logtriage.operators.report import parse_report, report_size
from logtriage.plans.keyword_filter import keyword_filter, rank_lines, select_lines
from logtriage.session import new_table_path
from logtriage.sources.documents import load_documents
from logtriage.sources.logs import scan_logs, store_log
from workload import filter_sql as q
from workload.registry import query
from workload.tables import DOCUMENTS_SQL, EVENTS_SQL, document_lines, event_lines, read

START, END = "2024-01-05", "2024-01-12"
LOW, HIGH = "TIMESTAMP '2024-01-05 00:00:00'", "TIMESTAMP '2024-01-12 23:59:59'"
KEPT = q.kept_sql(LOW, HIGH)
ERROR = q.keyword_sql(["error"])
ERROR_U149 = q.keyword_sql(["error", "u149"])


def config(**settings) -> KeywordFilterConfig:
    given = {"log_file_path": "events", "keywords": ("error",), "start_date": START, "end_date": END, **settings}
    return KeywordFilterConfig(**given)


def dated(lines):
    low, high = date_literals("2024-01-05T00:00:00", "2024-01-12T23:59:59")
    return number_lines(lines, start=low, end=high)


# --- scans ----------------------------------------------------------------------------------------


@query(f"WITH {EVENTS_SQL} SELECT line FROM src")
def log_scan(spark, sf_dir):
    path = new_table_path(spark, "log")
    event_lines(spark, sf_dir).select("line").write.text(path)
    return scan_logs(spark, path).select("line")


@query("""SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars,
  CAST(len(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) AS BIGINT) AS n_lines FROM documents""")
def doc_load(spark, sf_dir):
    text = F.col("text")
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.length(text).cast("long").alias("n_chars"), F.size(lines_of(text)).cast("long").alias("n_lines")
    )


@query("SELECT lang, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM documents GROUP BY lang")
def dir_load(spark, sf_dir):
    path = new_table_path(spark, "documents")
    read(spark, sf_dir, "documents").select("lang", "text").write.partitionBy("lang").text(path)
    loaded = load_documents(spark, directory=path)
    return loaded.groupBy(F.regexp_extract("file", "lang=([^/]+)", 1).alias("lang")).agg(
        F.sum(F.length("text")).cast("long").alias("n_chars")
    )


# --- order and dates ------------------------------------------------------------------------------


@query(rf"WITH {EVENTS_SQL} SELECT pos, strftime({q.TS_SQL}, '%Y-%m-%d %H:%M:%S') AS ts FROM src")
def parse_ts(spark, sf_dir):
    stamp = F.date_format(line_timestamp(F.col("line")), "yyyy-MM-dd HH:mm:ss")
    return event_lines(spark, sf_dir).select("pos", stamp.alias("ts"))


@query(f"WITH {EVENTS_SQL} SELECT file, pos, row_number() OVER (PARTITION BY file ORDER BY pos) - 1 AS line_index FROM src")
def line_index(spark, sf_dir):
    return ordered_scan.index(event_lines(spark, sf_dir).select("file", "block", "pos")).select("file", "pos", "line_index")


@query(f"WITH {EVENTS_SQL}, {q.eff_sql()} SELECT pos, strftime(eff_ts, '%Y-%m-%d %H:%M:%S') AS eff_ts FROM eff")
def carry_forward(spark, sf_dir):
    lines = event_lines(spark, sf_dir).select("file", "block", "pos", line_timestamp(F.col("line")).alias("ts"))
    carried = ordered_scan.carry_last(lines, "ts", "eff")
    return carried.select("pos", F.date_format("eff", "yyyy-MM-dd HH:mm:ss").alias("eff_ts"))


@query(f"WITH {EVENTS_SQL}, {KEPT} SELECT line_index, pos, line FROM kept")
def date_filter(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    return fetch_text(dated(lines), lines).select("line_index", "pos", "line")


STORED_BLOCK = 2_000


@query(f"WITH {EVENTS_SQL}, {KEPT} SELECT line_index, pos, line FROM kept")
def date_filter_stored(spark, sf_dir):
    lines = event_lines(spark, sf_dir).withColumn("block", ordered_scan.block_of(F.col("pos"), STORED_BLOCK))
    log = store_log(lines, new_table_path(spark, "stored-log"))
    kept = log.of("events").between(*date_literals("2024-01-05T00:00:00", "2024-01-12T23:59:59"))
    return fetch_text(dated(kept), kept).select("line_index", "pos", "line")


@query(f"WITH {EVENTS_SQL}, {KEPT}, {q.selected_sql(ERROR, 2)} SELECT line_index, is_match, line FROM sel")
def context_lines_stored(spark, sf_dir):
    lines = event_lines(spark, sf_dir).withColumn("block", ordered_scan.block_of(F.col("pos"), STORED_BLOCK))
    return select_lines(store_log(lines, new_table_path(spark, "stored-log")), config()).select("line_index", "is_match", "line")


@query(f"""WITH {EVENTS_SQL}, {q.eff_sql()}, b AS (SELECT file, pos // {STORED_BLOCK} AS block, count(*) AS n,
    arg_min(ts, pos) FILTER (ts IS NOT NULL) AS first_ts, arg_max(ts, pos) FILTER (ts IS NOT NULL) AS last_ts, min(ts) AS least_ts, max(ts) AS most_ts, arg_min(ts IS NOT NULL, pos) AS begins_dated
    FROM eff GROUP BY file, block)
SELECT file, block, n, begins_dated, {', '.join(f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in ('first_ts', 'last_ts', 'least_ts', 'most_ts', 'carried'))}
FROM (SELECT *, last_value(last_ts IGNORE NULLS) OVER (PARTITION BY file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM b)""")
def log_block_summary(spark, sf_dir):
    lines = event_lines(spark, sf_dir).withColumn("block", ordered_scan.block_of(F.col("pos"), STORED_BLOCK))
    blocks = store_log(lines, new_table_path(spark, "stored-log")).blocks
    stamps = ("first_ts", "last_ts", "least_ts", "most_ts", "carried")
    return blocks.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in stamps})


# --- keywords -------------------------------------------------------------------------------------

DOC_WORDS = ["über", "là", "the"]


@query(f"WITH {DOCUMENTS_SQL} SELECT file, pos FROM src WHERE regexp_matches(line, '{q.keyword_sql(DOC_WORDS, q.UNICODE_EDGE)}')")
def keyword_match(spark, sf_dir):
    return document_lines(spark, sf_dir).where(any_keyword(DOC_WORDS)).select("file", "pos")


@query(f"WITH {DOCUMENTS_SQL} SELECT file, pos FROM src WHERE regexp_matches(line, '(?i)tion|éme')")
def keyword_substring(spark, sf_dir):
    return document_lines(spark, sf_dir).where(any_keyword(["tion", "éme"], word_boundary=False)).select("file", "pos")


@query(f"""WITH {EVENTS_SQL}, {KEPT}, k AS (SELECT unnest(['error', 'u149', 'props', 'nothing']) AS keyword)
SELECT keyword, count(*) AS n FROM kept, k
WHERE regexp_matches(line, '(?i)(^|[^A-Za-z0-9_])' || keyword || '($|[^A-Za-z0-9_])') GROUP BY keyword""")
def keyword_stats(spark, sf_dir):
    words = ("error", "u149", "props", "nothing")
    selected = select_lines(event_lines(spark, sf_dir), config(keywords=words, context_lines=0))
    return keyword_counts(selected.where("is_match"), words).select("keyword", "n")


SELECTED = q.selected_sql(ERROR, 2)


@query(f"WITH {EVENTS_SQL}, {KEPT}, {SELECTED} SELECT line_index, is_match, line FROM sel")
def context_lines(spark, sf_dir):
    return select_lines(event_lines(spark, sf_dir), config()).select("line_index", "is_match", "line")


@query(f"WITH {DOCUMENTS_SQL}, kept AS (SELECT file, pos, pos AS line_index, line FROM src), "
       f"{q.selected_sql(q.keyword_sql(DOC_WORDS, q.UNICODE_EDGE), 3)} SELECT file, line_index, is_match FROM sel")
def context_lines_documents(spark, sf_dir):
    lines = document_lines(spark, sf_dir)
    near = with_context(number_lines(lines, hit=any_keyword(DOC_WORDS)), F.lit(3))
    return near.select("file", "line_index", "is_match")


@query(f"WITH {EVENTS_SQL}, {KEPT}, {q.selected_sql(ERROR, 4, 25)} SELECT line_index, is_match, line FROM sel")
def max_results(spark, sf_dir):
    cfg = config(context_lines=4, max_results=25)
    return select_lines(event_lines(spark, sf_dir), cfg).select("line_index", "is_match", "line")


@query(f"""WITH {EVENTS_SQL}, {KEPT}, {SELECTED}, {q.ranked_sql()}, {q.dedup_sql()}
SELECT 'read' AS stage, count(*) AS n FROM src UNION ALL SELECT 'dated', count(*) FROM kept
UNION ALL SELECT 'matched', count(*) FROM sel WHERE is_match UNION ALL SELECT 'selected', count(*) FROM sel
UNION ALL SELECT 'unique', count(*) FROM uniq""")
def stage_counts(spark, sf_dir):
    cfg = config()
    lines = event_lines(spark, sf_dir)
    selected = select_lines(lines, cfg)
    count = lambda df, stage: df.agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("n"))
    return (
        count(lines, "read")
        .unionByName(count(dated(lines), "dated"))
        .unionByName(count(selected.where("is_match"), "matched"))
        .unionByName(count(selected, "selected"))
        .unionByName(count(rank_lines(selected, cfg), "unique"))
    )


# --- ranking and duplicates -----------------------------------------------------------------------

EVENT_CORE = f"WITH {EVENTS_SQL} SELECT 'events' AS log, pos, {q.CORE_SQL} AS core FROM src"
STRIPPED = r"regexp_replace(x, '^[\t-\r\x1c-\x20\x{85}\pZ]+|[\t-\r\x1c-\x20\x{85}\pZ]+$', '', 'g')"
DOC_CORE = f"WITH {DOCUMENTS_SQL} SELECT file AS log, pos, {STRIPPED.replace('x,', q.CORE_SQL + ',', 1)} AS core FROM src"


@query(f"SELECT * FROM ({EVENT_CORE}) UNION ALL SELECT * FROM ({DOC_CORE})")
def core_message_text(spark, sf_dir):
    lines = event_lines(spark, sf_dir).unionByName(document_lines(spark, sf_dir))
    return lines.select(F.col("file").alias("log"), "pos", core_message(F.col("line")).alias("core"))


TWO_WORDS = ("error", "u149")
SELECTED_TWO = q.selected_sql(ERROR_U149, 2)


@query(f"WITH {EVENTS_SQL}, {KEPT}, {SELECTED_TWO}, {q.ranked_sql()}, {q.dedup_sql()} SELECT line_index, is_match, line FROM uniq")
def dedup(spark, sf_dir):
    cfg = config(keywords=TWO_WORDS)
    return rank_lines(select_lines(event_lines(spark, sf_dir), cfg), cfg).select("line_index", "is_match", "line")


@query(f"WITH {EVENTS_SQL}, {KEPT}, {SELECTED_TWO}, {q.ranked_sql(q.EFFECTIVE)}, {q.dedup_sql()} SELECT line_index, is_match, line FROM uniq")
def dedup_prioritized(spark, sf_dir):
    cfg = config(keywords=TWO_WORDS, prioritize_by_severity=True)
    return rank_lines(select_lines(event_lines(spark, sf_dir), cfg), cfg).select("line_index", "is_match", "line")


@query(f"""WITH {DOCUMENTS_SQL}, kept AS (SELECT 'all' AS file, file AS doc, pos AS line_index, line, TRUE AS is_match FROM src),
  ranked AS (SELECT *, 0 AS priority, row_number() OVER (PARTITION BY doc, {q.CORE_SQL} ORDER BY line_index) AS copy FROM kept)
SELECT doc AS file, line_index, line FROM ranked WHERE copy <= 3""")
def dedup_documents(spark, sf_dir):
    lines = document_lines(spark, sf_dir).select(
        "file", F.col("pos").alias("line_index"), "line", F.lit(True).alias("is_match")
    )
    unique = selection.deduplicate(selection.prioritize(lines, False))
    return unique.select("file", "line_index", "line")


def _priority(spark, sf_dir, mode):
    selected = select_lines(event_lines(spark, sf_dir), config(keywords=TWO_WORDS))
    return selection.prioritize(selected, True, mode).select("line_index", "priority")


@query(f"WITH {EVENTS_SQL}, {KEPT}, {SELECTED_TWO}, {q.ranked_sql(q.EFFECTIVE)} SELECT line_index, priority FROM ranked")
def priority_effective(spark, sf_dir):
    return _priority(spark, sf_dir, "effective")


@query(f"WITH {EVENTS_SQL}, {KEPT}, {SELECTED_TWO}, {q.ranked_sql(q.INTENDED)} SELECT line_index, priority FROM ranked")
def priority_intended(spark, sf_dir):
    return _priority(spark, sf_dir, "intended")


@query(f"WITH {EVENTS_SQL}, kept AS (SELECT *, pos AS line_index, contains(line, 'error') AS is_match FROM src) SELECT pos, {q.RENDER} AS rendered FROM kept")
def render_lines(spark, sf_dir):
    line = F.col("line")
    return event_lines(spark, sf_dir).select(
        "pos", render_line(F.col("pos"), F.contains(line, F.lit("error")), line).alias("rendered")
    )


# --- budget, summary, report ----------------------------------------------------------------------

UNIQ = f"{EVENTS_SQL}, {KEPT}, {SELECTED}, {q.ranked_sql()}, {q.dedup_sql(False)}"
FULL = f"{UNIQ}, {q.budget_sql(13500)}, {q.outcome_sql()}"
IN_ORDER = f"{UNIQ}, {q.budget_sql(13500, False)}, {q.outcome_sql(False)}"
RANKED_FULL = (
    f"{EVENTS_SQL}, {KEPT}, {SELECTED_TWO}, {q.ranked_sql(q.EFFECTIVE)}, {q.dedup_sql()}, "
    f"{q.budget_sql(1500)}, {q.outcome_sql()}, {q.report_sql()}"
)
INCLUDED = ("line_index", "is_match", "rendered")


@query(f"WITH {FULL} SELECT line_index, rendered FROM inc WHERE is_match")
def budget_matches(spark, sf_dir):
    run = keyword_filter(event_lines(spark, sf_dir), config(deduplicate=False))
    return run.included.where("is_match").select("line_index", "rendered")


BIG = f"{UNIQ}, {q.budget_sql(79500)}, {q.outcome_sql()}"


@query(f"WITH {BIG} SELECT line_index, is_match, rendered FROM inc")
def budget_full(spark, sf_dir):
    run = keyword_filter(event_lines(spark, sf_dir), config(deduplicate=False, max_tokens=20000))
    return run.included.select(*INCLUDED)


@query(f"WITH {IN_ORDER} SELECT line_index, is_match, rendered FROM inc")
def budget_inorder(spark, sf_dir):
    run = keyword_filter(event_lines(spark, sf_dir), config(deduplicate=False, prioritize_matches=False))
    return run.included.select(*INCLUDED)


@query(f"WITH {BIG} SELECT total, direct, context, errors, warnings, included, included * 20 AS tokens FROM outc")
def summary(spark, sf_dir):
    run = keyword_filter(event_lines(spark, sf_dir), config(deduplicate=False, max_tokens=20000))
    return run.outcome.select("total", "direct", "context", "errors", "warnings", "included", "tokens")


@query(f"""SELECT * FROM (WITH {FULL} SELECT 'matches first' AS mode, left_direct, left_context, left_entries FROM outc)
UNION ALL SELECT * FROM (WITH {IN_ORDER} SELECT 'in order' AS mode, left_direct, left_context, left_entries FROM outc)""")
def truncation(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    left = ("left_direct", "left_context", "left_entries")
    parts = [
        keyword_filter(lines, config(deduplicate=False, prioritize_matches=first)).outcome.select(
            F.lit(name).alias("mode"), *left
        )
        for name, first in (("matches first", True), ("in order", False))
    ]
    return parts[0].unionByName(parts[1])


RANKED = {"keywords": TWO_WORDS, "prioritize_by_severity": True, "max_tokens": 500}


@query(f"WITH {RANKED_FULL} SELECT file, report FROM rep")
def keyword_filter_report(spark, sf_dir):
    return keyword_filter(event_lines(spark, sf_dir), config(**RANKED)).reports


@query(f"WITH {IN_ORDER}, {q.report_sql(False)} SELECT file, report FROM rep")
def keyword_filter_command_line(spark, sf_dir):
    cfg = KeywordFilterConfig.command_line(
        "error, ,", log_file_path="events", start_date=START, end_date=END, max_tokens=3500
    )
    return keyword_filter(event_lines(spark, sf_dir), cfg).reports


@query(f"WITH {RANKED_FULL} SELECT file, length(report) AS chars, length(report) // 4 AS tokens FROM rep")
def report_chars(spark, sf_dir):
    chars, tokens = report_size(F.col("report"))
    reports = keyword_filter(event_lines(spark, sf_dir), config(**RANKED)).reports
    return reports.select("file", chars.alias("chars"), tokens.alias("tokens"))


@query(f"""WITH {FULL}, {q.report_sql()},
  ln AS (SELECT unnest(range(len(p))) AS n, trim(unnest(p)) AS l FROM (SELECT string_split(report, chr(10)) AS p FROM rep))
SELECT n, CASE WHEN contains(l, 'truncated') THEN NULL ELSE CAST(regexp_extract(l, '\\[Line (\\d+)\\]', 1) AS BIGINT) END AS line_number,
  CASE WHEN contains(l, 'truncated') THEN NULL ELSE contains(l, '>>>') END AS is_direct_match,
  CASE WHEN contains(l, 'truncated') THEN 'truncation_notice' END AS entry_type,
  CASE WHEN contains(l, 'truncated') THEN l ELSE trim(regexp_replace(l, '\\[Line \\d+\\]\\s*(>>>)?\\s*', '')) END AS content
FROM ln WHERE contains(l, '[Line') OR contains(l, 'truncated')""")
def parse_report_rows(spark, sf_dir):
    run = keyword_filter(event_lines(spark, sf_dir), config(deduplicate=False))
    return parse_report(run.reports, "file").drop("file")


@query(f"""WITH {DOCUMENTS_SQL}, ln AS (SELECT file, pos, {STRIPPED.replace('x,', 'line,', 1)} AS content FROM src)
SELECT file, pos AS n, pos + 1 AS line_number, TRUE AS is_direct_match, CAST(NULL AS VARCHAR) AS entry_type, content FROM ln WHERE content <> ''""")
def parse_plain(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("report"))
    return parse_report(docs, "file")
