"""The view one request has of one log: lines kept by date, renumbered, with keyword hits.

Everything a line needs from the rest of the log (the time it inherits, how many kept lines come
before it, the nearest hits to both sides) comes out of ONE shuffle of narrow rows by block - the
line text stays behind - and one summary row per block. The text is joined back for selected lines
only.

Within a block the lines before the first timestamp ("head") depend on what earlier blocks carry in;
all others ("tail") are decided inside the block. So a summary that counts both parts apart lets the
running pass over the block summaries settle every head at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtriage.functions.text import line_timestamp
from logtriage.operators.ordered_scan import BEFORE, UP_TO_HERE


def date_literals(start: str | None, end: str | None) -> tuple[Column, Column]:
    to_column = lambda v: F.lit(v).cast("timestamp_ntz")
    return to_column(start), to_column(end)


def in_range(ts: Column, start: Column, end: Column) -> Column:
    return (start.isNull() | (ts >= start)) & (end.isNull() | (ts <= end))


def number_lines(
    lines: DataFrame,
    *,
    keys: Sequence[str] = ("file",),
    start: Column | None = None,
    end: Column | None = None,
    hit: Column | None = None,
    carry: Sequence[str] = (),
    per_key: DataFrame | None = None,
) -> DataFrame:
    """Kept lines as narrow rows: keys, block, pos, `carry` columns, line_index.

    `per_key` holds further columns that are constant for a key. They travel with the block
    summaries, not with the lines.

    Lines of a stored log may have its columns `ts`, the line's timestamp, and `carried`, what its block inherits;
    then no text is parsed for dates, and blocks outside the bounds may be missing.

    With `hit`, also is_match, hit_rank (0-based among the hits) and the line_index of the nearest
    hit before (or at) and after (or at) the line: prev_hit, next_hit.
    """
    dated = start is not None or end is not None
    no_bound = F.lit(None).cast("timestamp_ntz")
    places = [*keys, "block"]
    stamp = F.col("ts") if "ts" in lines.columns else line_timestamp(F.col("line"))
    rows = lines.select(
        *places,
        "pos",
        *carry,
        (stamp if dated else no_bound).alias("_ts"),
        (F.col("carried") if dated and "carried" in lines.columns else no_bound).alias("_carried"),
        (no_bound if start is None else start).alias("_from"),
        (no_bound if end is None else end).alias("_to"),
        (F.lit(False) if hit is None else hit).alias("_hit"),
        # Places are never NULL. Said here, both uses of these rows below share one shuffle.
    ).where(reduce(Column.__and__, [F.col(c).isNotNull() for c in (*places, "pos")]))
    rows = _local_state(rows, places, want_hits=hit is not None)
    blocks = _settle_blocks(rows, keys, places)
    if per_key is not None:
        blocks = blocks.join(per_key, list(keys))
        carry = [*carry, *[c for c in per_key.columns if c not in keys]]
    return _combine(rows, blocks, places, carry, want_hits=hit is not None)


def _local_state(rows: DataFrame, places: list[str], want_hits: bool) -> DataFrame:
    ahead = Window.partitionBy(*places).orderBy("pos").rowsBetween(*UP_TO_HERE)
    back = Window.partitionBy(*places).orderBy(F.desc("pos")).rowsBetween(*UP_TO_HERE)
    local = F.coalesce(F.last("_ts", ignorenulls=True).over(ahead), "_carried")
    rows = rows.withColumn("_local", local)
    head = F.col("_local").isNull()
    live = head | in_range(F.col("_local"), F.col("_from"), F.col("_to"))
    rows = rows.withColumn("_head", head).withColumn("_live", live)
    rows = rows.withColumn("_r", F.sum(F.col("_live").cast("long")).over(ahead) - 1)
    if not want_hits:
        return rows
    rows = rows.withColumn("_hit", F.col("_hit") & F.col("_live"))
    hit_row = F.when(F.col("_hit"), F.col("_r"))
    return (
        rows.withColumn("_prev", F.max(hit_row).over(ahead))
        .withColumn("_hits", F.sum(F.col("_hit").cast("long")).over(ahead))
        .withColumn("_next", F.min(hit_row).over(back))
    )


def _settle_blocks(rows: DataFrame, keys: Sequence[str], places: list[str]) -> DataFrame:
    head, live, hit, r = (F.col(c) for c in ("_head", "_live", "_hit", "_r"))
    sums = rows.groupBy(*places).agg(
        F.max_by("_local", "pos").alias("last_ts"),
        F.first("_from").alias("_from"),
        F.first("_to").alias("_to"),
        F.count_if(head).alias("head_n"),
        F.count_if(live).alias("live_n"),
        F.count_if(head & hit).alias("head_hits"),
        F.count_if(hit).alias("hits"),
        F.min(F.when(head & hit, r)).alias("head_first"),
        F.max(F.when(head & hit, r)).alias("head_final"),
        F.min(F.when(~head & hit, r)).alias("tail_first"),
        F.max(F.when(~head & hit, r)).alias("tail_final"),
    )
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(*BEFORE)
    # The same blocks in reverse order: a frame that only grows, unlike "all following".
    later = Window.partitionBy(*keys).orderBy(F.desc("block")).rowsBetween(*BEFORE)
    carried = F.last("last_ts", ignorenulls=True).over(earlier)
    c = F.col
    sums = sums.withColumn("_carry", carried)
    sums = sums.withColumn(
        "head_ok", c("_carry").isNull() | in_range(c("_carry"), c("_from"), c("_to"))
    )
    skipped = F.when(c("head_ok"), F.lit(0)).otherwise(c("head_n"))
    skipped_hits = F.when(c("head_ok"), F.lit(0)).otherwise(c("head_hits"))
    first_hit = F.when(c("head_ok"), F.coalesce("head_first", "tail_first")).otherwise(c("tail_first"))
    final_hit = F.coalesce(c("tail_final"), F.when(c("head_ok"), c("head_final")))
    before = lambda v: F.coalesce(F.sum(v).over(earlier), F.lit(0))
    sums = sums.withColumn("shift", before(c("live_n") - skipped) - skipped)
    sums = sums.withColumn("hit_shift", before(c("hits") - skipped_hits) - skipped_hits)
    return sums.select(
        *places,
        "head_ok",
        "head_n",
        "shift",
        "hit_shift",
        F.max(c("shift") + final_hit).over(earlier).alias("hit_before"),
        F.min(c("shift") + first_hit).over(later).alias("hit_after"),
    )


def _combine(rows, blocks, places, carry, want_hits: bool) -> DataFrame:
    c = F.col
    kept = rows.join(blocks, places).where(c("_live") & (~c("_head") | c("head_ok")))
    columns = [*places, "pos", *carry, (c("shift") + c("_r")).alias("line_index")]
    if want_hits:
        prev_here = c("_prev").isNotNull() & (c("head_ok") | (c("_prev") >= c("head_n")))
        columns += [
            c("_hit").alias("is_match"),
            (c("hit_shift") + c("_hits") - 1).alias("hit_rank"),
            F.when(prev_here, c("shift") + c("_prev")).otherwise(c("hit_before")).alias("prev_hit"),
            F.coalesce(c("shift") + c("_next"), c("hit_after")).alias("next_hit"),
        ]
    return kept.select(*columns)


def with_context(
    numbered: DataFrame,
    context: Column,
    *,
    keys: Sequence[str] = ("file",),
    max_results: int | None = None,
) -> DataFrame:
    """Hits and the lines at most `context` lines away from one.

    With `max_results` only the first hits of each key count: later ones are ordinary lines, which
    may still be context of the last counted hit.
    """
    c = F.col
    if max_results is not None:
        final = numbered.where(c("is_match") & (c("hit_rank") == max_results - 1)).select(
            *keys, c("line_index").alias("_final")
        )
        numbered = numbered.join(final, list(keys), "left")
        numbered = (
            numbered.withColumn("is_match", c("is_match") & (c("hit_rank") < max_results))
            .withColumn("prev_hit", F.when(c("prev_hit").isNotNull(), F.least("prev_hit", "_final")))
            .withColumn(
                "next_hit",
                F.when(c("_final").isNull() | (c("next_hit") <= c("_final")), c("next_hit")),
            )
            .drop("_final")
        )
    near = F.coalesce(c("line_index") - c("prev_hit") <= context, F.lit(False)) | F.coalesce(
        c("next_hit") - c("line_index") <= context, F.lit(False)
    )
    return numbered.where(near)


def fetch_text(selected: DataFrame, lines: DataFrame) -> DataFrame:
    """Join the text of the selected lines back by their place (file, block, pos)."""
    return selected.join(lines.select("file", "block", "pos", "line"), ["file", "block", "pos"])
