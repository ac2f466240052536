"""Stages after matching: ranking, duplicate removal, budget, summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtriage.config import MAX_DUPLICATES, TOKENS_PER_LINE
from logtriage.functions.text import (
    core_message,
    is_problem,
    is_warning,
    render_line,
    severity_score,
)
from logtriage.operators.ordered_scan import BEFORE, UP_TO_HERE, block_of
from logtriage.session import staged

# The budget's running sums: lines of a block, blocks of a group.
BUDGET_LINES = 1 << 12
BUDGET_BLOCKS = 1 << 10
# The current order of lines: by rank (0 for all unless prioritised), then by position.
CURRENT_ORDER = (F.desc, "priority"), (F.asc, "line_index")


def current_order() -> list[Column]:
    return [direction(name) for direction, name in CURRENT_ORDER]


def prioritize(filtered: DataFrame, on: bool | Column = True, mode: str = "effective") -> DataFrame:
    """Adds `priority`, the key of the current order. Never sorts by itself."""
    score = severity_score(F.col("line"), F.col("is_match"), mode)
    wanted = F.lit(on) if isinstance(on, bool) else on
    return filtered.withColumn("priority", F.when(wanted, score).otherwise(F.lit(0).cast("long")))


def deduplicate(
    ranked: DataFrame, keys: Sequence[str] = ("file",), keep: int = MAX_DUPLICATES
) -> DataFrame:
    """First `keep` lines per core message in current order."""
    copies = Window.partitionBy(*keys, "_core").orderBy(*current_order())
    return (
        ranked.withColumn("_core", core_message(F.col("line")))
        .withColumn("_copy", F.row_number().over(copies))
        .where(F.col("_copy") <= keep)
        .drop("_core", "_copy")
    )


def fit_budget(
    ranked: DataFrame,
    budget: Column,
    *,
    keys: Sequence[str] = ("file",),
    matches_first: bool = True,
) -> DataFrame:
    """The lines that fit the budget, with `rendered` text and its `cost` (one for the line end).

    Costs are positive, so "stop at the first line that does not fit" is a running-sum prefix: of all
    lines in current order, or of the matches and then of the context with what the matches left.
    The prefix is found in three steps, see `_prefix`; no task gets the whole selection of a key.
    """
    rows = ranked.withColumn(
        "rendered", render_line(F.col("line_index"), F.col("is_match"), F.col("line"))
    ).withColumn("cost", (F.length("rendered") + 1).cast("long"))
    rows = rows.withColumn("_budget", budget.cast("long"))
    if not matches_first:
        return _prefix(rows, keys)
    # Bounded by the budgets, and read twice: what they spent, and they themselves.
    matches = staged(_prefix(rows.where("is_match"), keys), "fitting-matches")
    spent = matches.groupBy(*keys).agg(F.sum("cost").alias("_spent"))
    return matches.unionByName(_prefix(rows.where("NOT is_match"), keys, spent))


def _prefix(rows: DataFrame, keys: Sequence[str], spent: DataFrame | None = None) -> DataFrame:
    """Rows whose running cost, in current order within their keys, stays within `_budget`.

    Costs are added up by block of lines, and those sums by group of blocks: partial aggregates of narrow rows.
    The running sum over groups (one row for millions of lines) tells the groups that begin within the
    budget, the one inside those groups the blocks, and only lines of such blocks are summed one by
    one, each block by itself. The budget bounds how many blocks can begin within it, whatever the log.
    """
    group, block = [*keys, "priority", "_group"], [*keys, "priority", "_block"]
    rows = rows.withColumn("_block", block_of(F.col("line_index"), BUDGET_LINES))
    blocks = rows.groupBy(*block).agg(F.sum("cost").alias("_cost"), F.first("_budget").alias("_budget"))
    if spent is not None:
        left = F.col("_budget") - F.coalesce("_spent", F.lit(0))
        blocks = blocks.join(spent, list(keys), "left").withColumn("_budget", left).drop("_spent")
    blocks = blocks.withColumn("_group", block_of(F.col("_block"), BUDGET_BLOCKS))
    groups = blocks.groupBy(*group).agg(F.sum("_cost").alias("_cost"), F.first("_budget").alias("_budget"))
    in_order = Window.partitionBy(*keys).orderBy(F.desc("priority"), "_group").rowsBetween(*BEFORE)
    before = lambda w: F.coalesce(F.sum("_cost").over(w), F.lit(0))
    groups = groups.withColumn("_offset", before(in_order)).where("_offset < _budget")
    within = Window.partitionBy(*group).orderBy("_block").rowsBetween(*BEFORE)
    begun = blocks.join(groups.select(*group, "_offset"), group)
    begun = begun.withColumn("_offset", F.col("_offset") + before(within)).where("_offset < _budget")
    lines = Window.partitionBy(*block).orderBy("line_index").rowsBetween(*UP_TO_HERE)
    found = rows.drop("_budget").join(begun.select(*block, "_offset", "_budget"), block)
    found = found.withColumn("_upto", F.col("_offset") + F.sum("cost").over(lines)).where("_upto <= _budget")
    return found.drop("_block", "_offset", "_upto", "_budget")


ENTRY = "struct<priority:bigint,line_index:bigint,text:string>"
COUNTS = ("total", "direct", "errors", "warnings", "used_direct", "used_context")


def count_lines(filtered: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Totals the summary reports, over the lines before the budget cut."""
    line = F.col("line")
    return filtered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_match").alias("direct"),
        F.count_if(is_problem(line)).alias("errors"),
        F.count_if(is_warning(line)).alias("warnings"),
    )


def outcome(
    kept: DataFrame,
    included: DataFrame,
    asked: DataFrame,
    keys: Sequence[str] = ("file",),
    matches_first: bool = True,
) -> DataFrame:
    """One row per asked key: totals, what was left out, included count, token estimate, lines.

    Totals, chosen lines and asked keys are stacked and grouped once, so no join is needed and a
    key without lines stays. The lines of a key are bounded by its budget. The included count takes
    a truncation notice as one more line.
    """
    is_match = F.col("is_match")
    # Chosen lines are read in log order after matches came first, else in current order.
    rank = F.lit(0).cast("long") if matches_first else -F.col("priority")
    entry = F.struct(
        rank.alias("priority"), F.col("line_index"), F.concat("rendered", F.lit("\n")).alias("text")
    )
    parts = (
        _stackable(count_lines(kept, keys), keys, *[F.col(c) for c in COUNTS[:4]]),
        _stackable(
            included, keys, used_direct=is_match.cast("long"), used_context=(~is_match).cast("long"), entry=entry
        ),
        _stackable(asked, keys),
    )
    grouped = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        F.array_sort(F.collect_list("entry"))["text"].alias("lines"),
    )
    left_direct = F.col("direct") - F.col("used_direct")
    left_context = F.col("total") - F.col("direct") - F.col("used_context")
    left = left_direct + left_context
    included_count = F.col("used_direct") + F.col("used_context") + F.when(left > 0, 1).otherwise(0)
    none = F.lit(0).cast("long")
    return grouped.select(
        *keys,
        "total",
        "direct",
        (F.col("total") - F.col("direct")).alias("context"),
        "errors",
        "warnings",
        (left_direct if matches_first else none).alias("left_direct"),
        (left_context if matches_first else none).alias("left_context"),
        (none if matches_first else left).alias("left_entries"),
        included_count.alias("included"),
        (included_count * TOKENS_PER_LINE).alias("tokens"),
        "lines",
    )


def _stackable(rows: DataFrame, keys: Sequence[str], *firsts: Column, entry: Column | None = None, **named: Column):
    values = dict(zip(COUNTS, firsts)) | named
    zero = F.lit(0).cast("long")
    nothing = F.lit(None).cast(ENTRY)
    return rows.select(
        *keys,
        *[values.get(c, zero).alias(c) for c in COUNTS],
        (nothing if entry is None else entry).alias("entry"),
    )
