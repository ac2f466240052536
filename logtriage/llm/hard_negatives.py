"""Hard negatives by exact integer scores, multiplied in a residue number system.

Integer vectors are reduced modulo a few small primes, to residues around zero. A float32 product of such residue matrices is
exact (its sums stay below 2^24), so one fast product per prime gives the score modulo that prime, and Chinese
remaindering gives the exact signed score: as many primes are taken as the largest possible score asks for.

The anchors are a stated query set that meets all rows in blocks. Stored vectors are dealt into groups of bounded
size; every group's task holds its vectors and lets all anchors stream past, and each keeps its best few there. A group
sends on that few per anchor, so nothing grows with the number of pairs. Groups grow with the anchors (up to a bound
of memory), which keeps the copies of anchors near the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtriage.llm.common import stage

LIMIT = 1 << 24  # components saturate here, so that five times a score fits a long
INNER = 64  # components that are multiplied at once
# Odd primes p for which INNER * ((p - 1) / 2)^2 stays below 2^24, so that float32 sums are exact.
PRIMES = [p for p in range(1021, 700, -2) if all(p % d for d in range(3, 33, 2))]
LEAST_GROUP, MOST_GROUP = 2_048, 32_768  # vectors a task holds
MOST_TASKS = 10_000  # beyond that, tasks take several groups, one after the other
CELLS = 1 << 20  # scores that are in memory at once
NONE = np.iinfo(np.int64).min


def centered(whole: np.ndarray, prime: int) -> np.ndarray:
    """Residues from -(p - 1) / 2 to (p - 1) / 2 as float32."""
    half = prime // 2
    return ((whole + half) % prime - half).astype(np.float32)


def primes_for(bound: int) -> list[int]:
    """Primes whose product exceeds the number of integers from -bound to bound."""
    chosen, product = [], 1
    for prime in PRIMES:
        if product > 2 * bound:
            return chosen
        chosen.append(prime)
        product *= prime
    if product > 2 * bound:
        return chosen
    raise ValueError("scores are too large for the residue system")


def remainders_joined(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed integers with these remainders, by mixed radix digits; results must fit a long.

    Digits are taken around zero, so the sum of digits times radices is the signed value itself, and int64
    arithmetic may wrap on the way.
    """
    digits: list[np.ndarray] = []
    for i, prime in enumerate(primes):
        rest = parts[i] % prime
        radix = 1
        for digit, q in zip(digits, primes):
            rest = (rest - digit * radix) % prime
            radix = radix * q % prime
        digit = rest * pow(radix, -1, prime) % prime
        digits.append(np.where(digit > prime // 2, digit - prime, digit))
    total, radix = np.zeros_like(parts[0]), 1
    for digit, prime in zip(digits, primes):
        total += digit * np.int64((radix + (1 << 63)) % (1 << 64) - (1 << 63))
        radix *= prime
    return total


def score_bound(a: np.ndarray, b: np.ndarray) -> int:
    """No product of a row of a with a row of b is larger (Cauchy and Schwarz, with room for rounding)."""
    longest = lambda m: float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)).max(initial=0.0))
    return int(longest(a) * longest(b) * 1.000001) + 1


class Residues:
    """One side of the product, with its residues by prime made when first needed."""

    def __init__(self, whole: np.ndarray):
        self.whole, self.made = whole, {}

    def at(self, prime: int) -> np.ndarray:
        if prime not in self.made:
            self.made[prime] = np.ascontiguousarray(centered(self.whole, prime).T)
        return self.made[prime]


def scores(anchors: np.ndarray, held: Residues) -> np.ndarray:
    """Exact inner products of all rows of anchors with all rows of held."""
    primes = primes_for(score_bound(anchors, held.whole))
    parts = []
    for prime in primes:
        left, right = centered(anchors, prime), held.at(prime)
        total = np.zeros((len(anchors), right.shape[1]), np.int64)
        for at in range(0, left.shape[1], INNER):
            total += (left[:, at : at + INNER] @ right[at : at + INNER]).astype(np.int64)
        parts.append(total)
    return remainders_joined(parts, primes)


def best_few(found: np.ndarray, few: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the `few` largest entries of each row other than NONE; of equal ones the first columns."""
    if found.shape[1] > few:
        mark = np.partition(found, found.shape[1] - few, axis=1)[:, -few]
    else:
        mark = np.full(len(found), NONE)
    row, column = np.nonzero((found >= mark[:, None]) & (found != NONE))
    order = np.lexsort((column, -found[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < few], column[rank < few]


def labelled_vectors(vectors: DataFrame, column: str = "embedding", label: Column | None = None, scale: int = 256) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; v holds floor(scale * x) as little-endian 32-bit integers."""
    name = F.col("label") if label is None else label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, packed = [], []
            values = batch.column(2)
            cuts, flat = values.offsets.to_numpy(), values.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            for at, known in enumerate(pc.is_valid(values).to_pylist()):
                part = flat[cuts[at] : cuts[at + 1]]
                if known and np.isfinite(part).all():
                    keep.append(at)
                    packed.append(np.clip(np.floor(part * scale), -LIMIT, LIMIT).astype("<i4").tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(packed, pa.binary())], names=["vec_id", "label", "v"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), name.cast("long").alias("label"), column)
    return rows.where("label is not null").mapInArrow(run, "vec_id bigint, label bigint, v binary")


def _matrix(packed: list[bytes], width: int) -> np.ndarray:
    """Rows of integers, cut or filled with zeros to one width."""
    parts = [np.frombuffer(p, "<i4") for p in packed]
    if width and all(len(p) == width for p in parts):
        return np.concatenate(parts).reshape(-1, width).astype(np.int64) if parts else np.zeros((0, width), np.int64)
    out = np.zeros((len(parts), width), np.int64)
    for row, p in zip(out, parts):
        row[: min(width, len(p))] = p[:width]
    return out


def _searcher(pick, schema_names: list[str]):
    """Groups of rows (group, kind, row_id, vec_id, label, v, marks): stored vectors (kind 0) first, then anchors (kind 1).

    `pick(scores, same_label, own, marks)` yields, for blocks of anchors, (anchor row, column, positive number).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, stored, held = None, [], None

        def ready():
            """Stored vectors of the group by vec_id, null ids last."""
            table = pa.Table.from_batches(stored)
            ids = table.column("vec_id")
            order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy()))
            table = table.take(pa.array(order))
            return table.combine_chunks()

        for batch in batches:
            groups = batch.column("group").to_numpy()
            kinds = batch.column("kind").to_numpy()
            turns = np.flatnonzero((np.diff(groups) != 0) | (np.diff(kinds) != 0)) + 1
            for low, high in zip(np.append(0, turns), np.append(turns, len(groups))):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                if groups[low] != group:
                    group, stored, held = groups[low], [], None
                if kinds[low] == 0:
                    stored.append(part)
                    continue
                if not stored:
                    continue
                if held is None:
                    table = ready()
                    packed = table.column("v").to_pylist()
                    width = max(len(p) for p in packed) // 4
                    held = (table, Residues(_matrix(packed, width)), table.column("label").to_numpy(), table.column("row_id").to_numpy())
                table, residues, labels, row_ids = held
                few = max(1, CELLS // len(labels))
                for at in range(0, part.num_rows, few):
                    block = part.slice(at, few)
                    found = scores(_matrix(block.column("v").to_pylist(), residues.whole.shape[1]), residues)
                    same = block.column("label").to_numpy()[:, None] == labels[None, :]
                    own = block.column("row_id").to_numpy()[:, None] == row_ids[None, :]
                    marks = block.column("marks").to_pylist()
                    for row, column, number in pick(found, same, own, marks):
                        at_row, at_column = pa.array(row), pa.array(column)
                        arrays = [
                            block.column("row_id").take(at_row), block.column("vec_id").take(at_row), pa.array(np.full(len(row), number, np.int32)),
                            table.column("vec_id").combine_chunks().take(at_column), table.column("row_id").combine_chunks().take(at_column), pa.array(found[row, column]),
                        ]
                        yield pa.RecordBatch.from_arrays(arrays, names=schema_names)

    return run


FOUND = "anchor_row bigint, anchor_id bigint, number int, vec_id bigint, row_id bigint, score bigint"
NAMES = [part.split()[0] for part in FOUND.split(", ")]


def _search(stored: DataFrame, anchors: DataFrame, groups: int, pick) -> DataFrame:
    """Each anchor's best few in each group, as `pick` chooses them."""
    group_of = F.pmod(F.xxhash64("row_id"), F.lit(groups))
    none = F.lit(None).cast("array<bigint>")
    rows = stored.select(group_of.alias("group"), F.lit(0).alias("kind"), "row_id", "vec_id", "label", "v", none.alias("marks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    asked = anchors.select(every.alias("group"), F.lit(1).alias("kind"), "row_id", "vec_id", "label", "v", "marks")
    tasks = min(groups, MOST_TASKS)
    dealt = rows.union(asked).repartitionById(tasks, F.pmod("group", F.lit(tasks)).cast("int")).sortWithinPartitions("group", "kind")
    return dealt.mapInArrow(_searcher(pick, NAMES), FOUND)


def _first(found: DataFrame, few: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= few)


def mine(vectors: DataFrame, *, anchor: Column, column: str = "embedding", label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (4, 5)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows with a null label or vector, or with any null or non-finite component take no part. Scores are inner products of
    floor(scale * x), components at most 2^24 either way; the shorter of two vectors is filled with zeros. `anchor`
    tells the anchors by vec_id; a null id is none. An anchor's positives are the first other rows of its label by
    score, then smaller vec_id (null last). For each positive the first rows of other labels follow whose score lies
    between low[0] / low[1] of the positive's and the positive's. Fewer are returned where there are fewer. Rows that repeat, ids
    included, are rows of their own: each anchor row is answered and each may be a positive or negative. Extra
    columns are not read. An empty table, or one without anchors, gives no rows.
    """
    kept = labelled_vectors(vectors, column, label, scale).withColumn("row_id", F.monotonically_increasing_id())
    stored = stage(kept, "labelled-vectors")
    anchors = stored.where(F.coalesce(anchor, F.lit(False)))
    n = anchors.count()
    groups = -(-max(stored.count(), 1) // min(max(n, LEAST_GROUP), MOST_GROUP))

    def pick_positives(found, same, own, marks):
        row, column = best_few(np.where(same & ~own, found, NONE), positives)
        yield row, column, 0

    def pick_negatives(found, same, own, marks):
        for number in range(max(map(len, marks), default=0)):
            mark = np.array([m[number] if number < len(m) else NONE for m in marks])[:, None]
            inside = ~same & (mark != NONE) & (found <= mark) & (found * low[1] >= np.where(mark == NONE, 0, mark) * low[0])
            row, column = best_few(np.where(inside, found, NONE), negatives)
            yield row, column, number

    near = _search(stored, anchors.withColumn("marks", F.lit(None).cast("array<bigint>")), groups, pick_positives)
    chosen = stage(_first(near, positives, "anchor_row").withColumn("number", F.col("rank") - 1), "hard-positives")
    marks = chosen.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("number", "score")))["score"].alias("marks"))  # a few a row
    asked = anchors.join(marks, F.col("row_id") == F.col("anchor_row")).select("row_id", "vec_id", "label", "v", "marks")
    far = _first(_search(stored, asked, groups, pick_negatives), negatives, "anchor_row", "number")
    far = far.select("anchor_row", "number", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    known = chosen.select("anchor_row", "number", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(known, ["anchor_row", "number"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
