"""Centroid clustering of integer vectors, with nearest centroids found by the threshold algorithm.

For every dimension the centroids are sorted by their value once. A vector walks each of these lists outward from its own
value, one centroid a step; a centroid seen for the first time gets its exact distance. The squared gaps at the
frontiers of all lists add up to a bound that no unseen centroid can be below, so the walk of a vector ends when that sum
strictly exceeds its best exact distance (an equal sum may hide a tie with a smaller number).

A round reads the stored vectors, adds up each centroid's members by a partial aggregation, and brings one row per
centroid and dimension to the driver: as many as the caller asked for, whatever the table holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtriage.llm.common import stage

LIMIT = 1 << 27  # components saturate here, so that a squared distance fits a long
ROWS = 2_048  # vectors that walk together


def component_rows(values: pa.Array, dims: int, scale: int, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a list array, and their components floor(scale * x) as int64.

    Usable: exactly `dims` components, none null or non-finite. Results beyond `limit` either way become that limit.
    """
    lengths = pc.fill_null(pc.list_value_length(values), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dims)
    flat = values.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), dims)
    usable = np.isfinite(flat).all(axis=1)  # a null component reads as NaN
    whole = np.clip(np.floor(flat[usable] * scale), -limit, limit)
    return at[usable], whole.astype(np.int64)


def usable_vectors(vectors: DataFrame, column: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): the usable vectors, components as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, whole = component_rows(batch.column(1), dims, scale)
            packed = [row.tobytes() for row in whole.astype("<i4")]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(packed, pa.binary())], names=["vec_id", "v"])

    return vectors.select(F.col("vec_id").cast("long"), column).mapInArrow(run, "vec_id bigint, v binary")


class Centroids:
    """Centroids with their per-dimension sorted lists."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.argsort(points, axis=0, kind="stable")  # [rank, dimension] -> centroid
        self.values = np.take_along_axis(points, self.order, axis=0)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of and squared distance to the nearest centroid of each vector; of equal ones the smaller number."""
        n, (k, dims) = len(vectors), self.points.shape
        far = np.iinfo(np.int64).max
        best, number = np.full(n, far), np.full(n, k)
        seen = np.zeros((n, k), bool)
        column = np.arange(dims)
        right = np.empty((n, dims), np.int64)
        for d in range(dims):
            right[:, d] = np.searchsorted(self.values[:, d], vectors[:, d])
        left = right - 1
        active = np.arange(n)
        while len(active):
            x, lo, hi = vectors[active], left[active], right[active]
            below = np.where(lo >= 0, x - self.values[np.maximum(lo, 0), column], far)
            above = np.where(hi < k, self.values[np.minimum(hi, k - 1), column] - x, far)
            down = below <= above
            gap = np.where(down, below, above)
            met = self.order[np.where(down, lo, hi), column]  # no list is at its end before all centroids are seen
            left[active], right[active] = lo - down, hi + ~down
            new = np.zeros((len(active), k), bool)
            new[np.arange(len(active))[:, None], met] = True
            new &= ~seen[active]
            seen[active] |= new
            for c in np.flatnonzero(new.any(axis=0)):
                rows = active[new[:, c]]
                distance = ((vectors[rows] - self.points[c]) ** 2).sum(axis=1)
                closer = (distance < best[rows]) | ((distance == best[rows]) & (c < number[rows]))
                best[rows[closer]], number[rows[closer]] = distance[closer], c
            open_ = ((gap**2).sum(axis=1) <= best[active]) & ~seen[active].all(axis=1)
            active = active[open_]
        return number, best


def _assigner(points: np.ndarray):
    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        centroids = Centroids(points)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                vectors = np.frombuffer(b"".join(part.column("v").to_pylist()), "<i4").reshape(-1, points.shape[1]).astype(np.int64)
                yield part.column("vec_id"), vectors, *centroids.nearest(vectors)

    return batches_of


def assigned(vectors: DataFrame, points: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every stored vector."""
    walk = _assigner(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, number, distance in walk(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def moved(vectors: DataFrame, points: np.ndarray) -> np.ndarray:
    """The centroids after one round: componentwise floor of the exact mean of their members; empty ones stay."""
    walk, dims = _assigner(points), points.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(points), np.zeros(len(points), np.int64)
        for _, members, number, _ in walk(batches):
            np.add.at(total, number, members)
            count += np.bincount(number, minlength=len(points))
        rows = np.flatnonzero(count)
        columns = [np.repeat(rows, dims).astype(np.int32), np.tile(np.arange(dims, dtype=np.int32), len(rows)), np.repeat(count[rows], dims), total[rows].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "dim", "n", "total"])

    sums = vectors.mapInArrow(run, "cluster int, dim int, n bigint, total bigint")
    exact = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    after = points.copy()
    for row in sums.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), exact).collect():
        after[row["cluster"], row["dim"]] = int(row["total"]) // row["n"]
    return after


def first_points(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k stored vectors with the smallest sha256 of `<seed>:<vec_id>`, in that order, as rows; fewer if there are fewer.

    Null ids come last; vectors with equal ids are ordered by their bytes.
    """
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(mark.alias("mark"), "v").orderBy(F.asc_nulls_last("mark"), "v").limit(k).collect()
    return np.array([np.frombuffer(r["v"], "<i4") for r in rows], np.int64)


def cluster_vectors(vectors: DataFrame, *, column: str = "embedding", dims: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, seed: str = "3") -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid.

    Usable vectors have exactly `dims` components, none null or non-finite; the others have no row. Components are
    floor(scale * x), at most 2^27 either way. Centroids start as `first_points`; each of `rounds` rounds assigns all
    vectors and replaces every centroid with members by the floor of their mean. Ties go to the smaller number. Repeated
    rows and ids each count and keep their own row; a null vec_id is kept. Sums of distances beyond a long are null.
    Extra columns are not read. No usable vector gives no rows.
    """
    stored = stage(usable_vectors(vectors, column, dims, scale), "integer-vectors")
    points = first_points(stored, k, seed)
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>"
    if not len(points):
        return vectors.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        after = moved(stored, points)
        settled = (after == points).all()
        points = after
        if settled:  # further rounds would give the same
            break
    found = stage(assigned(stored, points), "assigned-vectors")
    sums = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda v: int(v) if v < 1 << 63 else None
    whole = fits(sum(sums.values()))
    facts = [(c, fits(d), whole, points[c].tolist()) for c, d in sums.items()]
    named = T.StructType.fromDDL("cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return found.join(F.broadcast(vectors.sparkSession.createDataFrame(facts, named)), "cluster").select(*T.StructType.fromDDL(schema).names)


def centroid_digest(components: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, components)).encode()).hexdigest()
