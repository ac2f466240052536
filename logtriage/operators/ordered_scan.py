"""Order-dependent work over a log without ever sorting a whole log in one task.

A line has a stable place `(file, block, pos)`: `pos` orders the lines of a block, `block` orders the
blocks of a file. Each operator works in two levels: inside blocks (many tasks, bounded size), then
over one summary row per block, whose running result is joined back to the lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lines per block where a table has a plain position column instead of file splits.
BLOCK_LINES = 1 << 16
BEFORE = (Window.unboundedPreceding, -1)
UP_TO_HERE = (Window.unboundedPreceding, 0)


def block_of(pos: Column, lines: int = BLOCK_LINES) -> Column:
    return F.call_function("div", pos.cast("long"), F.lit(lines))


def _in_block(keys: Sequence[str], order) -> Window:
    return Window.partitionBy(*keys, "block").orderBy(*order).rowsBetween(*UP_TO_HERE)


def _over_blocks(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("block").rowsBetween(*BEFORE)


def index(
    lines: DataFrame, keys: Sequence[str] = ("file",), out: str = "line_index", order=("pos",)
) -> DataFrame:
    """0-based position of each line within its keys."""
    places = [*keys, "block"]
    sizes = lines.groupBy(*places).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        *places, F.coalesce(F.sum("_n").over(_over_blocks(keys)), F.lit(0)).alias("_offset")
    )
    local = lines.withColumn("_row", F.row_number().over(_in_block(keys, order)))
    return (
        local.join(offsets, places)
        .withColumn(out, (F.col("_offset") + F.col("_row") - 1).cast("long"))
        .drop("_row", "_offset")
    )


def running_sum(
    lines: DataFrame, value: str, out: str, keys: Sequence[str] = ("file",), order=("pos",)
) -> DataFrame:
    """Sum of `value` over all earlier lines of the keys (this line excluded)."""
    places = [*keys, "block"]
    totals = lines.groupBy(*places).agg(F.sum(value).alias("_n"))
    offsets = totals.select(
        *places, F.coalesce(F.sum("_n").over(_over_blocks(keys)), F.lit(0)).alias("_offset")
    )
    local = lines.withColumn("_upto", F.sum(value).over(_in_block(keys, order)))
    return (
        local.join(offsets, places)
        .withColumn(out, (F.col("_offset") + F.col("_upto") - F.col(value)).cast("long"))
        .drop("_upto", "_offset")
    )


def carry_last(
    lines: DataFrame, value: str, out: str, keys: Sequence[str] = ("file",)
) -> DataFrame:
    """Last non-NULL `value` of this or any earlier line of the keys."""
    places = [*keys, "block"]
    lasts = lines.groupBy(*places).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col("pos"))).alias("_last")
    )
    carried = lasts.select(
        *places, F.last("_last", ignorenulls=True).over(_over_blocks(keys)).alias("_carry")
    )
    here = F.last(value, ignorenulls=True).over(_in_block(keys, ("pos",)))
    return (
        lines.withColumn("_here", here)
        .join(carried, places)
        .withColumn(out, F.coalesce("_here", "_carry"))
        .drop("_here", "_carry")
    )
