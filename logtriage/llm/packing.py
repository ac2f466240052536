"""Best-fit packing by linear grouping.

Token pieces are packed into sequences of a fixed capacity. The plan works on the histogram of piece
lengths, which has at most `capacity` entries whatever the input, and describes whole runs of equal
sequences; the pieces themselves stay distributed and look their place up by (length, rank).
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from logtriage.llm.common import stage, with_fields
from logtriage.llm.encoding import text_encoder, text_groups

RANK_BUCKETS = 256
# Texts encoded together; their distinct words are encoded once.
GROUP_CHARS = 8_000_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """One row per piece: the ids of each whole text and `end_id`, cut only where they exceed the capacity.

    A null text counts as empty and gives one piece, the end id. Null and repeated doc_ids are kept
    row by row. `ids` (little-endian unsigned 32-bit) is null unless asked for.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        size = 4 * capacity
        encode = text_encoder(vocabulary).encode_many
        for batch in batches:
            numbers = batch.column("doc_id").to_pylist()
            for part, texts in text_groups(batch, GROUP_CHARS):
                rows = []
                for doc_id, ids in zip(numbers[part], encode(texts)):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), size)):
                        held = ids[at : at + size]
                        rows.append((doc_id, piece, at // 4, len(held) // 4, zlib.crc32(held), held if with_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    fields = to_arrow_schema(T.StructType.fromDDL(PIECES))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


@dataclass
class Bins:
    """Equal sequences first .. first + count - 1, each filled up to `used`."""

    first: int
    count: int
    used: int


@dataclass
class Run:
    """Pieces of a length with ranks begin .. end - 1: `each` of them per sequence from sequence `first` on."""

    length: int
    begin: int
    end: int
    first: int
    each: int
    offset: int


class _Plan:
    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = dict(histogram)
        self.taken = dict.fromkeys(histogram, 0)
        self.bins = 0
        self.runs: list[Run] = []
        self.open: dict[int, list[Bins]] = {}  # by free room
        self.rooms: list[int] = []

    def place(self, length: int, bins: Bins, each: int) -> None:
        """Put `each` pieces of this length into all these sequences."""
        begin = self.taken[length]
        self.runs.append(Run(length, begin, begin + each * bins.count, bins.first, each, bins.used))
        self.taken[length] += each * bins.count
        self.left[length] -= each * bins.count
        bins.used += each * length

    def keep(self, bins: Bins) -> None:
        room = self.capacity - bins.used
        if room:
            if not self.open.get(room):
                self.open[room] = []
                bisect.insort(self.rooms, room)
            self.open[room].append(bins)

    def new(self, count: int) -> Bins:
        bins = Bins(self.bins, count, 0)
        self.bins += count
        return bins

    def take_open(self, at_least: int) -> Bins | None:
        """The fullest open sequences that still have so much room."""
        k = bisect.bisect_left(self.rooms, at_least)
        if k == len(self.rooms):
            return None
        room = self.rooms[k]
        bins = self.open[room].pop()
        if not self.open[room]:
            del self.open[room]
            del self.rooms[k]
        return bins


def _split(bins: Bins, count: int) -> tuple[Bins, Bins]:
    return Bins(bins.first, count, bins.used), Bins(bins.first + count, bins.count - count, bins.used)


def _groups(plan: _Plan, small: int, groups: int) -> list[list[int]]:
    """Large lengths, longest first, in groups of about equal numbers of pieces."""
    large = sorted((length for length in plan.left if length > small), reverse=True)
    total = sum(plan.left[length] for length in large)
    out: list[list[int]] = []
    seen = 0
    for length in large:
        if not out or seen * groups >= len(out) * total:
            out.append([])
        out[-1].append(length)
        seen += plan.left[length]
    return out


def _best_pattern(sizes: list[int], counts: list[int], capacity: int) -> list[int]:
    """Groups (as indices) of the fullest sequence of rounded sizes that the pieces left allow.

    Starts from the largest size left and searches all fillings of what remains by reachable sums.
    """
    first = next(k for k, count in enumerate(counts) if count)
    room = capacity - sizes[first]
    reach: dict[int, tuple[int, ...]] = {0: ()}
    for k in range(first, len(sizes)):
        usable = counts[k] - (k == first)
        for _ in range(min(usable, room // sizes[k]) if sizes[k] else 0):
            more = {s + sizes[k]: p + (k,) for s, p in reach.items() if s + sizes[k] <= room and s + sizes[k] not in reach}
            if not more:
                break
            reach |= more
    return [first, *reach[max(reach)]]


def plan_sequences(histogram: dict[int, int], capacity: int, small: int | None = None, groups: int = 64) -> tuple[list[Run], int]:
    """Runs that place every piece, and the number of sequences.

    1. Lengths above `small` (an eighth of the capacity) are rounded up to the longest of their group; groups
       hold about equally many pieces, so there are few sizes.
    2. Sequences are configurations of few sizes: the fullest one for the largest size left is used as
       often as the counts allow, then the next, until no large piece is left.
    3. The actual pieces take the places of the rounded ones, longest first; what rounding left free
       stays usable.
    4. Remaining pieces go, longest first, where they fit best; a new sequence opens only if none has room.
    """
    plan = _Plan({length: n for length, n in histogram.items() if n}, capacity)
    small = capacity // 8 if small is None else small
    grouped = _groups(plan, small, groups)
    sizes = [members[0] for members in grouped]
    counts = [sum(plan.left[length] for length in members) for members in grouped]
    at = [0] * len(grouped)
    while any(counts):
        pattern = _best_pattern(sizes, counts, capacity)
        need = {k: pattern.count(k) for k in pattern}
        often = min(counts[k] // n for k, n in need.items())
        parts = [plan.new(often)]
        for k in pattern:
            counts[k] -= often
            todo, parts = parts, []
            while todo:
                bins = todo.pop()
                while not plan.left[grouped[k][at[k]]]:
                    at[k] += 1
                length = grouped[k][at[k]]
                if bins.count > plan.left[length]:
                    bins, rest = _split(bins, plan.left[length])
                    todo.append(rest)
                plan.place(length, bins, 1)
                parts.append(bins)
        for bins in parts:
            plan.keep(bins)
    for length in sorted((length for length in plan.left if length <= small), reverse=True):
        while plan.left[length]:
            left = plan.left[length]
            bins = plan.take_open(length)
            if bins is None:
                each = capacity // length
                bins = plan.new(max(1, left // each))
            each = min((capacity - bins.used) // length, left)
            count = min(bins.count, left // each)
            if count < bins.count:
                bins, rest = _split(bins, count)
                plan.keep(rest)
            plan.place(length, bins, each)
            plan.keep(bins)
    return plan.runs, plan.bins


def pack(pieces: DataFrame, capacity: int, groups: int = 64) -> DataFrame:
    """Add sequence_id and offset to pieces (any table with doc_id, piece and length up to the capacity).

    The result holds every row once. Ranks within a length are counts per hashed bucket plus a row number
    inside it, so a length that holds a third of all pieces is spread over many tasks. Ties (repeated rows)
    take consecutive places. The driver sees one number per length, and the plan's runs. Pieces that are
    empty, null or longer than the capacity raise an error.
    """
    bad = pieces.where(F.col("length").isNull() | (F.col("length") < 1) | (F.col("length") > capacity))
    if not bad.isEmpty():
        raise ValueError("pieces must hold between 1 token and the capacity")
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_BUCKETS)).cast("int")
    keyed = pieces.withColumn("_bucket", bucket)
    cells = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    cells = stage(cells, "pack-cells")
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs, _ = plan_sequences(histogram, capacity, groups=groups)
    runs.sort(key=lambda run: (run.length, run.begin))
    key = np.array([(run.length << 44) + run.begin for run in runs], np.int64)
    fields = np.array([(run.begin, run.first, run.each, run.offset, run.length) for run in runs], np.int64).reshape(-1, 5)

    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = keyed.withColumn("_rank", F.row_number().over(inside)).join(cells, ["length", "_bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_rank") - 1).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            length = batch.column("length").cast(pa.int64()).to_numpy()
            run = fields[np.searchsorted(key, (length << 44) + rank, "right") - 1]
            step = rank - run[:, 0]
            found = (run[:, 1] + step // run[:, 2], run[:, 3] + step % run[:, 2] * length)
            held = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*held, *map(pa.array, found)], names=[*names, "sequence_id", "offset"])

    names = pieces.columns
    return ranked.mapInArrow(place, with_fields(pieces.schema, "sequence_id bigint, offset bigint"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their places; see `token_pieces` and `pack` for nulls, ties and empty tables."""
    pieces = token_pieces(docs, vocabulary, capacity, end_id).drop("ids")
    return pack(stage(pieces, "pack-pieces"), capacity)
