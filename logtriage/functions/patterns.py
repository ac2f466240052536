"""Keyword patterns: any-of, case-insensitive, literal, optionally on word boundaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtriage.functions.text import WORD

FLAGS = "(?iu)"
AFTER_WORD, NOT_AFTER_WORD = f"(?<={WORD})", f"(?<!{WORD})"
BEFORE_WORD, NOT_BEFORE_WORD = f"(?={WORD})", f"(?!{WORD})"
ASCII_SPECIAL = r"([\x00-\x7F&&[^A-Za-z0-9_]])"


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def _escape(keyword: str) -> str:
    return "".join(c if ord(c) > 127 or _is_word(c) else "\\" + c for c in keyword)


def keyword_regex(keyword: str, word_boundary: bool = True) -> str:
    """One keyword as a Java regex without flags.

    A boundary sits where a word character meets another one, so a keyword that starts or ends with
    a non-word character needs a word character next to that edge.
    """
    if not word_boundary:
        return _escape(keyword)
    if not keyword:
        return WORD
    left = NOT_AFTER_WORD if _is_word(keyword[0]) else AFTER_WORD
    right = NOT_BEFORE_WORD if _is_word(keyword[-1]) else BEFORE_WORD
    return left + _escape(keyword) + right


def any_keyword_regex(keywords, word_boundary: bool = True) -> str:
    """Alternation of keywords; those with the same kind of edges share one boundary test."""
    if not word_boundary or not all(keywords):
        return FLAGS + "|".join(keyword_regex(k, word_boundary) for k in keywords)
    groups: dict[tuple[bool, bool], list[str]] = {}
    for keyword in keywords:
        groups.setdefault((_is_word(keyword[0]), _is_word(keyword[-1])), []).append(_escape(keyword))
    return FLAGS + "|".join(
        f"{NOT_AFTER_WORD if left else AFTER_WORD}(?:{'|'.join(words)}){NOT_BEFORE_WORD if right else BEFORE_WORD}"
        for (left, right), words in groups.items()
    )


def keyword_regex_column(keyword: Column) -> Column:
    """Same as keyword_regex (with boundaries) for keywords held in a column."""
    escaped = F.regexp_replace(keyword, ASCII_SPECIAL, r"\\$1")
    left = F.when(F.rlike(keyword, F.lit(f"^{WORD}")), NOT_AFTER_WORD).otherwise(AFTER_WORD)
    right = F.when(F.rlike(keyword, F.lit(f"{WORD}\\z")), NOT_BEFORE_WORD).otherwise(BEFORE_WORD)
    return F.when(keyword == "", F.lit(WORD)).otherwise(F.concat(left, escaped, right))


def any_keyword_regex_column(keywords: Column) -> Column:
    """Any of the keywords; without keywords nothing matches."""
    either = F.concat(F.lit(FLAGS), F.array_join(F.transform(keywords, keyword_regex_column), "|"))
    return F.when(F.size(keywords) == 0, F.lit("(?!)")).otherwise(either)


def matches(line: Column, pattern: Column) -> Column:
    """Pattern from a column. regexp_instr keeps the last compiled pattern between rows."""
    return F.regexp_instr(line, pattern) > 0
