"""Validated settings for one filter run (driver side, immutable)."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime

# The character budget and its defaults.
CHARS_PER_TOKEN = 4
SUMMARY_RESERVE = 500
TOKENS_PER_LINE = 20
MAX_TOKENS = 3500
MAX_TOKENS_COMMAND_LINE = 3000
CONTEXT_LINES = 2
MAX_DUPLICATES = 3
CHUNK_SIZE = 800
CHUNK_OVERLAP = 200
SEARCH_K = 10
CONTEXT_PER_TYPE = 10
COMBINED_PER_TYPE = 5
FILTER_MODES = ("llm", "vector")
NO_MATCH_TEXT = "No matching log entries found for the given criteria."


@dataclass(frozen=True)
class AnalysisDefaults:
    """Values of options that an analysis request leaves open."""

    max_tokens: int = MAX_TOKENS
    context_lines: int = CONTEXT_LINES
    deduplicate: bool = True
    prioritize_by_severity: bool = False


@dataclass(frozen=True, kw_only=True)
class _LogScope:
    """Which log, which days, how much output."""

    log_file_path: str
    start_date: str | None = None
    end_date: str | None = None
    max_tokens: int = MAX_TOKENS

    def __post_init__(self):
        if not self.log_file_path:
            raise ValueError("log_file_path must not be empty")
        if self.max_tokens <= 0:
            raise ValueError("max_tokens must be greater than zero")

    @property
    def max_chars(self) -> int:
        return self.max_tokens * CHARS_PER_TOKEN

    @property
    def line_chars(self) -> int:
        """Characters left for log lines once the summary is set aside."""
        return self.max_chars - SUMMARY_RESERVE


@dataclass(frozen=True, kw_only=True)
class KeywordFilterConfig(_LogScope):
    keywords: tuple[str, ...]
    context_lines: int = CONTEXT_LINES
    deduplicate: bool = True
    prioritize_by_severity: bool = False
    prioritize_matches: bool = True
    max_results: int | None = None
    word_boundary: bool = True
    max_duplicates: int = MAX_DUPLICATES
    severity_mode: str = "effective"

    def __post_init__(self):
        super().__post_init__()
        object.__setattr__(self, "keywords", tuple(self.keywords))
        if not self.keywords:
            raise ValueError("at least one keyword is needed")
        if self.context_lines < 0:
            raise ValueError("context_lines must not be negative")
        if self.max_results is not None and self.max_results <= 0:
            raise ValueError("max_results must be greater than zero when given")
        if self.severity_mode not in ("effective", "intended"):
            raise ValueError(f"unknown severity_mode {self.severity_mode!r}")

    @classmethod
    def command_line(cls, keywords_csv: str, **settings) -> "KeywordFilterConfig":
        """Settings as the command line gives them: current order, dedup on request only."""
        given = {
            "max_tokens": MAX_TOKENS_COMMAND_LINE,
            "deduplicate": False,
            "prioritize_matches": False,
            **settings,
        }
        return cls(keywords=tuple(split_keywords(keywords_csv)), **given)


@dataclass(frozen=True, kw_only=True)
class VectorFilterConfig(_LogScope):
    issue_description: str
    chunk_size: int = CHUNK_SIZE
    chunk_overlap: int = CHUNK_OVERLAP

    def __post_init__(self):
        super().__post_init__()
        if not self.issue_description:
            raise ValueError("issue_description must not be empty")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be smaller than chunk_size")

    @property
    def k(self) -> int:
        """How many chunks fit the budget; zero means an empty answer."""
        return self.max_chars // self.chunk_size


def split_keywords(csv: str | None) -> list[str]:
    return [word.strip() for word in (csv or "").split(",") if word.strip()]


def date_bounds(start: str | None, end: str | None) -> tuple[str | None, str | None]:
    """Inclusive ISO second bounds; one malformed date switches date filtering off."""
    try:
        low = datetime.strptime(start, "%Y-%m-%d") if start else None
        high = datetime.strptime(end, "%Y-%m-%d") if end else None
    except ValueError:
        return None, None
    return (
        low and low.strftime("%Y-%m-%dT00:00:00"),
        high and high.strftime("%Y-%m-%dT23:59:59"),
    )


def field_names(config_class) -> list[str]:
    return [f.name for f in fields(config_class)]
