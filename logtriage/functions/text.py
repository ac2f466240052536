"""Column expressions over log text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes as the log tools' regular expressions see them (Unicode).
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
TIMESTAMP = r"(\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}[T\t-\r\x1c-\x20\x85\p{Z}]\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2})"
# The white space that may stand between date and time.
GAPS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)

# What the duplicate detector removes or rewrites, in this order.
CORE_RULES = (
    (r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}", ""),
    (r"\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}[.,]\p{Nd}+", ""),
    (r"(?d)\[.*?\]", ""),
    (r"\p{Nd}+", "#"),
)

# Severity levels and the score each one adds.
MATCH_SCORE = 1000
SEVERITY_SCORES = (
    (("LOGLEVEL.E", "EXCEPTION"), 200),
    (("LOGLEVEL.D", "LOGLEVEL.I"), 100),
    (("LOGLEVEL.ANALYTICS",), 50),
)

# Line markers of a rendered report.
MATCH_MARK = ">>>"
CONTEXT_MARK = "   "


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def lines_of(text: Column) -> Column:
    """Split on any line ending; a final line ending opens no further line."""
    return F.split(F.regexp_replace(text, r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")


def drop_invalid_utf8(text: Column) -> Column:
    """Remove bytes that are no valid UTF-8, leaving valid lines untouched."""
    return F.when(F.is_valid_utf8(text), text).otherwise(
        F.regexp_replace(F.make_valid_utf8(text), "�", "")
    )


def line_timestamp(line: Column) -> Column:
    """Timestamp of the first ISO-looking stamp; impossible dates and times give NULL."""
    found = F.regexp_extract(line, TIMESTAMP, 1)
    return F.translate(found, GAPS, "T" * len(GAPS)).try_cast("timestamp_ntz")


def core_message(line: Column) -> Column:
    """The line without what varies between copies: dates, times, brackets, numbers."""
    return strip(reduce(lambda text, rule: F.regexp_replace(text, *rule), CORE_RULES, line))


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(n)) for n in needles])


def severity_score(line: Column, is_match: Column, mode: str) -> Column:
    """Ranking score: matches first; levels count only in the "intended" mode.

    "effective" is the behaviour users see today, where the level part never applies.
    """
    base = F.when(is_match, F.lit(MATCH_SCORE)).otherwise(F.lit(0))
    if mode == "effective":
        return base.cast("long")
    upper = F.upper(line)
    errors, normal, analytics = SEVERITY_SCORES
    level = (
        F.when(contains_any(upper, errors[0]), errors[1])
        .when(contains_any(upper, normal[0]), normal[1])
        .when(contains_any(upper, analytics[0]), analytics[1])
        .otherwise(0)
    )
    return (base + level).cast("long")


def is_problem(line: Column) -> Column:
    return contains_any(F.upper(line), ("ERROR", "EXCEPTION"))


def is_warning(line: Column) -> Column:
    return F.contains(F.upper(line), F.lit("WARN"))


def render_line(index: Column, is_match: Column, line: Column) -> Column:
    mark = F.when(is_match, F.lit(MATCH_MARK)).otherwise(F.lit(CONTEXT_MARK))
    return F.concat(F.lit("[Line "), index.cast("string"), F.lit("] "), mark, F.lit(" "), line)


def clip(text: Column, size: int = 500) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def keywords_from_csv(csv: Column) -> Column:
    parts = F.transform(F.split(csv, ","), strip)
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda k: k != "")


def keyword_union(*lists: Column) -> Column:
    """Distinct keywords of several lists (NULL lists count as empty), in sorted order."""
    empty = F.array().cast("array<string>")
    whole = F.concat(*[F.coalesce(one, empty) for one in lists])
    return F.array_sort(F.array_distinct(whole))


def date_label(start: Column, end: Column) -> Column:
    given = lambda c: F.when(c != "", c)  # noqa: E731 - a blank date counts as none
    both = F.concat(given(start), F.lit(" to "), given(end))
    return F.coalesce(both, given(start), given(end))


def tenths_text(value: Column) -> Column:
    """A non-negative double with one decimal, rounded on its exact binary value, ties to even.

    The value is split in two halves whose products with 20 are exact, so the comparison with the
    midpoint between two tenths carries no rounding error.
    """
    below = F.floor(value * 10)
    scaled = value * F.lit(134217729.0)
    high = scaled - (scaled - value)
    low = value - high
    past_middle = (high * 20 - (below * 2 + 1)) + low * 20
    up = (past_middle > 0) | ((past_middle == 0) & (below % 2 == 1))
    tenths = below + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def duration_text(seconds: Column) -> Column:
    """Human reading of a duration: ms, seconds, or minutes with seconds."""
    minutes = F.floor(seconds / 60)
    rest = seconds - minutes * 60
    unit = F.when(minutes == 1, " minute").otherwise(" minutes")
    head = F.concat(minutes.cast("string"), unit)
    return (
        F.when(seconds < 1, F.concat(F.floor(seconds * 1000).cast("string"), F.lit("ms")))
        .when(seconds < 60, F.concat(tenths_text(seconds), F.lit(" seconds")))
        .when(rest < 1, head)
        .otherwise(F.concat(head, F.lit(" "), tenths_text(rest), F.lit(" seconds")))
    )


def log_key(path: Column) -> Column:
    """One spelling of a log's name: file:/x, file:///x and /x are the same log."""
    return F.regexp_replace(path, "^file:/+", "/")


def named_log(path: str) -> Column:
    """Lines of the log that a config names."""
    return F.col("file") == log_key(F.lit(path))
