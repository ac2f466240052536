"""Report text: building it from selected lines and reading it back into rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtriage.config import NO_MATCH_TEXT
from logtriage.functions.text import strip

# The report layout, which readers of the report rely on.
SUMMARY_FORMAT = (
    "=== LOG ANALYSIS SUMMARY ===\n"
    "Total filtered entries: %d\n"
    "  - Direct keyword matches: %d\n"
    "  - Context lines: %d\n"
    "Included in output: %d\n"
    "Errors/Exceptions: %d\n"
    "Warnings: %d\n"
    "Estimated tokens: ~%d (approximate)\n"
    "Legend: >>> = direct match, (indented) = context line\n"
)
SEPARATOR = "=" * 80
LEFT_MATCHES = "\n... (truncated, %d more direct matches) ...\n"
LEFT_CONTEXT = "... (truncated, %d more context lines) ...\n"
LEFT_ENTRIES = "\n... (truncated, %d more entries) ...\n"
SUMMARY_SPAN = r"(?s)(=== LOG ANALYSIS SUMMARY ===.*?Legend:)"
LINE_NUMBER = r"\[Line (\p{Nd}+)\]"
PREVIEW_CHARS = 1000


def summary_text() -> Column:
    names = ("total", "direct", "context", "included", "errors", "warnings", "tokens")
    return F.format_string(SUMMARY_FORMAT, *[F.col(n) for n in names])


def truncation_text() -> Column:
    """Notice for what did not fit; NULL when everything did."""
    part = lambda name, text: F.when(F.col(name) > 0, F.format_string(text, F.col(name)))
    notice = F.concat_ws(
        "",
        part("left_direct", LEFT_MATCHES),
        part("left_context", LEFT_CONTEXT),
        part("left_entries", LEFT_ENTRIES),
    )
    return F.when(notice != "", notice)


def report_text(outcomes: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """One report per key; a fixed sentence where nothing was found.

    Lines keep their own line end, so joining them leaves a blank line in between.
    """
    notice = F.array_compact(F.array(truncation_text()))
    text = F.concat(
        summary_text(),
        F.lit("\n" + SEPARATOR + "\n\n"),
        F.array_join(F.concat("lines", notice), "\n"),
    )
    return outcomes.select(
        *keys, F.when(F.col("total") > 0, text).otherwise(F.lit(NO_MATCH_TEXT)).alias("report")
    )


def report_size(report: Column) -> tuple[Column, Column]:
    chars = F.length(report).cast("long")
    return chars, F.floor(chars / 4)


def preview(report: Column) -> Column:
    size = F.lit(PREVIEW_CHARS)
    cut = F.concat(F.left(report, size), F.lit("..."))
    return F.when(F.length(report) > size, cut).otherwise(report)


def report_summary(report: Column) -> Column:
    return strip(F.regexp_extract(report, SUMMARY_SPAN, 1))


def parse_report(reports: DataFrame, key: str, text: str = "report") -> DataFrame:
    """Entries of reports: (key, n, line_number, is_direct_match, entry_type, content).

    A marked report has [Line N] markers or a summary: notices, numbered entries, and continuation
    lines once the first marker was seen. A plain report is a list of matches numbered from 1.
    """
    body = F.col(text)
    marked = F.contains(body, F.lit("[Line")) | (F.regexp_extract(body, SUMMARY_SPAN, 1) != "")
    rows = reports.where(strip(body) != "").select(
        key, marked.alias("_marked"), F.posexplode(F.split(body, "\n")).alias("_n", "_raw")
    )
    line = F.col("content")
    rows = rows.withColumn("content", strip(F.col("_raw"))).where(line != "")
    notice = F.col("_marked") & F.contains(F.lower(line), F.lit("truncated"))
    banner = F.col("_marked") & F.startswith(line, F.lit("===")) & F.contains(line, F.lit("LOG ANALYSIS"))
    has_mark = F.contains(line, F.lit("[Line")) & ~notice & ~banner
    so_far = Window.partitionBy(key).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_notice": notice, "_banner": banner, "_has": has_mark})
    rows = rows.withColumn("_started", F.max("_has").over(so_far))
    direct = F.contains(line, F.lit(">>>"))
    return rows.where(
        ~F.col("_marked") | F.col("_notice") | (~F.col("_banner") & F.col("_started"))
    ).select(
        key,
        F.col("_n").cast("long").alias("n"),
        F.when(~F.col("_marked"), F.col("_n") + 1)
        .when(F.col("_has"), F.regexp_extract(line, LINE_NUMBER, 1).try_cast("long"))
        .cast("long")
        .alias("line_number"),
        F.when(~F.col("_marked"), True).when(F.col("_has"), direct).alias("is_direct_match"),
        F.when(F.col("_notice"), "truncation_notice")
        .when(F.col("_marked") & ~F.col("_has"), "continuation")
        .alias("entry_type"),
        F.when(F.col("_has") & F.col("_marked"), entry_content(line, direct))
        .otherwise(line)
        .alias("content"),
    )


def entry_content(line: Column, direct: Column) -> Column:
    with_mark = F.regexp_replace(line, r"\[Line \p{Nd}+\]\s*>>>\s*", "")
    without = F.regexp_replace(line, r"\[Line \p{Nd}+\]\s+", "")
    return strip(F.when(direct, with_mark).otherwise(without))


def parsed_reports(reports: DataFrame, key: str, text: str = "report") -> DataFrame:
    """One row per report: summary, entry count, and the entries in order as one array."""
    entries = parse_report(reports, key, text)
    entry = F.struct("n", "line_number", "is_direct_match", "entry_type", "content")
    grouped = entries.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    none = F.array().cast("array<struct<n:bigint,line_number:bigint,is_direct_match:boolean,entry_type:string,content:string>>")
    return reports.join(grouped, key, "left").select(
        key,
        report_summary(F.col(text)).alias("summary"),
        F.coalesce("entries", none).alias("entries"),
        F.coalesce(F.size("entries"), F.lit(0)).cast("long").alias("total_entries"),
    )
