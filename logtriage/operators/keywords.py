"""Keyword matching over log lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtriage.functions.patterns import FLAGS, any_keyword_regex, keyword_regex, keyword_regex_column, matches
from logtriage.functions.text import contains_any
from logtriage.session import join_small

ASCII_WORD = "[a-z0-9_]+"


def any_keyword(keywords: Sequence[str], word_boundary: bool = True) -> Column:
    """One literal alternation, compiled once per task.

    Plain ASCII lines are first searched for the bare keywords, which is far cheaper than the
    pattern; only lines with a hit, and lines with other characters, reach the pattern.
    """
    line = F.col("line")
    pattern = F.rlike(line, F.lit(any_keyword_regex(keywords, word_boundary)))
    if not all(k.isascii() and k for k in keywords):
        return pattern
    ascii_line = F.length(line) == F.octet_length(line)
    return (~ascii_line | contains_any(F.upper(line), tuple(k.upper() for k in keywords))) & pattern


def keyword_terms(asked: DataFrame) -> DataFrame:
    """(file, keyword, pattern, anchor) once per log and keyword, from rows (file, keywords).

    A keyword matches on word boundaries, so each run of word characters in it is a whole word of the line. The anchor
    is the longest run; it is NULL for keywords without one and for those with other than ASCII characters, whose
    letters may match in more than one spelling.
    """
    terms = asked.select("file", F.explode("keywords").alias("keyword")).distinct()
    runs = F.regexp_extract_all(F.lower("keyword"), F.lit(ASCII_WORD), F.lit(0))
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))["run"]
    is_ascii = F.length("keyword") == F.octet_length("keyword")
    pattern = F.concat(F.lit(FLAGS), keyword_regex_column(F.col("keyword")))
    return terms.select("file", "keyword", pattern.alias("pattern"), F.when(is_ascii, longest).alias("anchor"))


def keyword_hits(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """(file, block, pos, keyword): which terms of its log occur in each line; lines without a hit have no row.

    Each line is read once, whatever the number of terms: its distinct words are looked up among the anchors of its log, and
    only what is found there is tested with the pattern (a keyword that is one word needs no test). Lines with
    other than ASCII characters, and terms without an anchor, are tested directly.
    """
    place = ["file", "block", "pos"]
    line = F.col("line")
    ascii_line = F.length(line) == F.octet_length(line)
    size = F.octet_length("file") + F.octet_length("pattern") + F.octet_length("keyword") + 64
    words = F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(ASCII_WORD), F.lit(0)))
    posts = lines.where(ascii_line).select(*place, "line", F.explode(words).alias("anchor"))
    met = join_small(posts, terms.where("anchor IS NOT NULL"), ["file", "anchor"], size, F.col("pos"))
    looked_up = met.where((F.col("anchor") == F.lower("keyword")) | matches(line, F.col("pattern")))
    term = F.struct("keyword", "pattern", F.col("anchor").isNull().alias("direct"))
    by_log = terms.groupBy("file").agg(F.collect_list(term).alias("terms"), F.sum(size).alias("size"), F.bool_or(F.col("anchor").isNull()).alias("some"))
    rest = join_small(lines, by_log, ["file"], F.col("size"), F.col("pos")).where(~ascii_line | F.col("some"))
    tested = F.filter("terms", lambda t: (~ascii_line | t["direct"]) & matches(line, t["pattern"]))
    direct = rest.select(*place, F.explode(tested["keyword"]).alias("keyword"))
    return looked_up.select(*place, "keyword").unionByName(direct)


def keyword_counts(
    hits: DataFrame,
    keywords: Sequence[str],
    keys: Sequence[str] = ("file",),
    word_boundary: bool = True,
) -> DataFrame:
    """Hit lines per keyword (a keyword counts once per line; one without hits has no row).

    Runs over lines that already matched the alternation: one flag per keyword in a single row,
    then only the flags that are set become rows.
    """
    line = F.col("line")
    found = [
        F.when(F.rlike(line, F.lit(FLAGS + keyword_regex(k, word_boundary))), F.lit(k))
        for k in dict.fromkeys(keywords)
    ]
    return (
        hits.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("keyword"))
        .groupBy(*keys, "keyword")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def keyword_counts_by_column(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keyword_counts where each row carries its own `terms` array of (keyword, pattern)."""
    found = F.filter("terms", lambda t: matches(F.col("line"), t["pattern"]))
    return (
        hits.select(*keys, F.explode(found["keyword"]).alias("keyword"))
        .groupBy(*keys, "keyword")
        .agg(F.count(F.lit(1)).alias("n"))
    )
