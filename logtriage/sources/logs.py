"""Reading text logs as ordered lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from logtriage.functions.text import drop_invalid_utf8, line_timestamp, log_key, named_log
from logtriage.operators.log_view import number_lines
from logtriage.operators.ordered_scan import BEFORE, carry_last
from logtriage.session import BROADCAST_BYTES, measured_bytes


def scan_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, block, pos, line): one row per line, placed by file, file split and scan order.

    Line ends may be LF, CR or CRLF; invalid UTF-8 bytes are dropped. Split starts and scan order
    belong to one planning of the scan. `file` is the full path as a request would name it: without
    a file: scheme, and with its characters unescaped. To use the lines more than once, store them with
    `store_lines` (one pass, no shuffle) and read them back.
    """
    try:
        # Carriage returns are line ends here as in the reader's universal newline mode.
        text = spark.read.text(paths)
    except AnalysisException as error:
        raise ValueError(f"cannot read log {paths!r}: {error}") from error
    escaped = F.col("_metadata.file_path")
    name = F.coalesce(F.try_url_decode(F.replace(escaped, F.lit("+"), F.lit("%2B"))), escaped)
    return text.select(
        log_key(name).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        drop_invalid_utf8(F.col("value")).alias("line"),
    )


def store_lines(lines: DataFrame, path: str) -> DataFrame:
    """Write lines with their place and timestamp once, and return the stored table."""
    stamped = lines.withColumn("ts", line_timestamp(F.col("line")))
    stamped.write.mode("overwrite").parquet(path)
    return lines.sparkSession.read.parquet(path)


@dataclass(frozen=True)
class StoredLog:
    """Stored lines and one summary row per block of them.

    lines: file, block, pos, line, ts; a folder per file and block, so that a scan reads only the
    blocks it is joined with. blocks: file, block, n, first_ts, last_ts, least_ts, most_ts, begins_dated, carried.
    `carried` is the timestamp that the block's first lines inherit from earlier blocks, NULL before the
    first one; `begins_dated` says that the first line has a timestamp of its own.
    """

    lines: DataFrame
    blocks: DataFrame

    def of(self, file: str) -> "StoredLog":
        """Only the log that a config names."""
        return StoredLog(self.lines.where(named_log(file)), self.blocks.where(named_log(file)))

    def live_blocks(self, low: Column, high: Column) -> DataFrame:
        """(file, block, carried) of blocks that may hold a line within the bounds.

        That is decided by the summary alone: a line is kept if the last timestamp up to it lies within
        the bounds or there is none, so a block can matter only if it inherits, or states, a time not below the
        lower and one not above the upper bound, or begins before any time is known.
        """
        inherited = F.when(~F.col("begins_dated"), F.col("carried"))
        timeless = ~F.col("begins_dated") & F.col("carried").isNull()
        least, most = F.least(inherited, "least_ts"), F.greatest(inherited, "most_ts")
        outside = F.coalesce(most < low, F.lit(False)) | F.coalesce(least > high, F.lit(False))
        return self.blocks.where(timeless | ~outside).select("file", "block", "carried")

    def between(self, low: Column, high: Column) -> DataFrame:
        """Lines of the live blocks, each with its block's `carried`. Other blocks are not read."""
        live = self.live_blocks(low, high)
        size = F.octet_length("file") + 24
        if measured_bytes(live, size) <= BROADCAST_BYTES:
            live = F.broadcast(live)  # also prunes the folders that the scan opens
        return self.lines.join(live, ["file", "block"])


LINES = "pos bigint, line string, ts timestamp_ntz, file string, block bigint"


def store_log(lines: DataFrame, path: str) -> StoredLog:
    """Write lines by file and block in one pass without a shuffle, then the summary of their blocks.

    A block of `scan_logs` is a split of a file, which one task reads, so it becomes one file. The summary reads
    only places and timestamps. Lines keep the order that `pos` gives them within their block.
    """
    stamped = lines.select("file", "block", "pos", "line", line_timestamp(F.col("line")).alias("ts"))
    stamped.write.mode("overwrite").partitionBy("file", "block").parquet(f"{path}/lines")
    stored = lines.sparkSession.read.schema(LINES).parquet(f"{path}/lines")
    stated = F.when(F.col("ts").isNotNull(), F.col("pos"))
    facts = stored.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("ts", stated).alias("first_ts"),
        F.max_by("ts", stated).alias("last_ts"),
        F.min("ts").alias("least_ts"),
        F.max("ts").alias("most_ts"),
        F.min_by(F.col("ts").isNotNull(), "pos").alias("begins_dated"),
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(*BEFORE)
    facts = facts.withColumn("carried", F.last("last_ts", ignorenulls=True).over(earlier))
    facts.write.mode("overwrite").parquet(f"{path}/blocks")
    return load_log(lines.sparkSession, path)


def load_log(spark: SparkSession, path: str) -> StoredLog:
    """A log that `store_log` wrote."""
    return StoredLog(spark.read.schema(LINES).parquet(f"{path}/lines"), spark.read.parquet(f"{path}/blocks"))


def store_dated(stored: DataFrame, path: str) -> DataFrame:
    """Rewrite stored lines by the date they belong to, so that date ranges prune folders.

    A line without a timestamp belongs to the day of the last one before it; lines before the first
    timestamp get no date, and every date range must read them.
    """
    dated = carry_last(stored, "ts", "eff_ts").withColumn("eff_date", F.to_date("eff_ts"))
    dated.write.mode("overwrite").partitionBy("eff_date").parquet(path)
    return stored.sparkSession.read.parquet(path)


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Lines with their 0-based number in their file."""
    places = number_lines(lines).withColumnRenamed("line_index", "line_no")
    return places.join(lines.select("file", "block", "pos", "line"), ["file", "block", "pos"])
