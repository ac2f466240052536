"""Near duplicates by min-max hashing: candidates share a band of minima and maxima, whole shingle sets decide.

Every permutation of the shingles gives two signature values, its minimum and its maximum, so half the hash evaluations
make a signature of the same length; the share of equal values is an unbiased estimate of the Jaccard similarity with a
lower variance than that of minima alone. BANDS bands of ROWS values bring sets together: two sets of similarity 0.8 have no
band in common with a chance of 4e-8.

Sets that share bands, directly or over others, form a family. A family is cut into blocks of bounded size, and every
two blocks meet in one task, so that each set is shipped once per block of its family and all its members are
compared there: a pair whose signatures agree too little is left out (a pair at 0.8 falls below LEAST_SEEN with a chance of
9e-8), one that is connected already too, and the rest are checked on their whole sets. What leaves a task is a spanning set
of links, never more than its sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtriage.llm.common import stage
from logtriage.llm.components import components

BANDS, ROWS = 56, 6
SIGNATURE = BANDS * ROWS
SIMILAR = (4, 5)  # least similarity as a fraction
LEAST_SEEN = 0.68  # least share of equal signature values
SMALL_BLOCK, LARGE_BLOCK, FEW_BLOCKS = 1 << 20, 1 << 24, 16  # bytes of a family's block; blocks before they get larger
MARK_BITS = 1 << 26  # 8 MB
SLICE = 2_048  # shingles hashed at once, and sets compared at once
_RNG = np.random.default_rng(42)
_FACTORS = _RNG.integers(0, 2**64, SIGNATURE // 2, np.uint64, endpoint=False) | np.uint64(1)
_SHIFTS = _RNG.integers(0, 2**64, SIGNATURE // 2, np.uint64, endpoint=False)
_MIX = _RNG.integers(0, 2**64, (BANDS, ROWS), np.uint64, endpoint=False) | np.uint64(1)


def shingles_of(text: str | None, words: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; ASCII letters are lowered, words end at ASCII white space.

    Fewer words than a shingle give the whole sequence as one; no words (or null) give none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(found[k:] for k in range(words)))) if len(found) >= words else [b" ".join(found)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), "<u8", max(1, len(found) - words + 1)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, next to each other: SIGNATURE values of a set with members."""
    least, most = np.full(len(_FACTORS), 2**64 - 1, np.uint64), np.zeros(len(_FACTORS), np.uint64)
    for at in range(0, len(shingles), SLICE):
        hashed = (shingles[at : at + SLICE, None] ^ _SHIFTS) * _FACTORS
        np.minimum(least, hashed.min(axis=0), out=least)
        np.maximum(most, hashed.max(axis=0), out=most)
    return np.stack([least, most], axis=1).ravel()


def mixed(values: np.ndarray) -> np.ndarray:
    return values ^ (values >> np.uint64(31)) ^ (values >> np.uint64(17))


def bands_of(values: np.ndarray) -> np.ndarray:
    """One hash per band of a signature."""
    return mixed((mixed(values).reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64))


def lanes_of(values: np.ndarray) -> bytes:
    """One byte of each signature value."""
    return (mixed(values) * _MIX[0, 0] >> np.uint64(56)).astype(np.uint8).tobytes()


SKETCH = "print bigint, n bigint, bands array<bigint>"
MEMBERS = "members binary, lanes binary"


def sketches(words: int):
    @F.arrow_udf(SKETCH)
    def sketch(texts: pa.Array) -> pa.Array:
        prints, sizes, bands = [], [], []
        for text in texts:
            shingles = shingles_of(text.as_py(), words)
            prints.append(xxhash.xxh64_intdigest(shingles.tobytes()))
            sizes.append(len(shingles))
            bands.append(bands_of(signature(shingles)) if len(shingles) else shingles)
        arrays = [pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), _lists(bands)]
        return pa.StructArray.from_arrays(arrays, names=["print", "n", "bands"])

    return sketch


def _lists(parts: list[np.ndarray]) -> pa.Array:
    cuts = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat.view(np.int64)))


def whole_sets(words: int):
    @F.arrow_udf(MEMBERS)
    def packed(texts: pa.Array) -> pa.Array:
        sets = [shingles_of(t.as_py(), words) for t in texts]
        arrays = [pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([lanes_of(signature(s)) for s in sets], pa.binary())]
        return pa.StructArray.from_arrays(arrays, names=["members", "lanes"])

    return packed


class Marks:
    """A bitmap of fixed size over 64-bit hashes, to leave most rows out before a join that decides exactly.

    Marked hashes are never missed. The more there are, the more others pass, too; then the join has more to do.
    """

    def __init__(self, hashes: DataFrame):
        at = F.col(hashes.columns[0]).bitwiseAND(F.lit(MARK_BITS - 1))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
        found = hashes.select(F.shiftright(at, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        words = np.zeros(MARK_BITS // 64, np.int64)
        words[found["word"].to_numpy()] = found["bits"].to_numpy()
        self.words = hashes.sparkSession.sparkContext.broadcast(words)

    @staticmethod
    def _hit(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = hashes & (MARK_BITS - 1)
        return (words[at >> 6] >> (at & 63)) & 1 == 1

    def has(self):
        words = self.words

        @F.arrow_udf("boolean")
        def marked(hashes: pa.Array) -> pa.Array:
            return pa.array(Marks._hit(words.value, hashes.to_numpy(zero_copy_only=False)))

        return marked

    def only(self):
        words = self.words

        @F.arrow_udf("array<bigint>")
        def marked(lists: pa.Array) -> pa.Array:
            flat, cuts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            hit = Marks._hit(words.value, flat)
            return _lists([flat[a:b][hit[a:b]] for a, b in zip(cuts, cuts[1:])])

        return marked


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if SIMILAR[1] * min(len(a), len(b)) < SIMILAR[0] * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return SIMILAR[1] * shared >= SIMILAR[0] * (len(both) - shared)


def spanning_links(prints: np.ndarray, lanes: np.ndarray, sets: list[np.ndarray], block: np.ndarray, one_block: bool) -> list[tuple[int, int]]:
    """Links between similar sets that connect all of them; unless one_block, only pairs of different blocks are looked at."""
    root = np.arange(len(prints))
    size = np.array([len(s) for s in sets])
    links = []
    chunk = max(1, (1 << 21) // max(1, len(prints)))
    for at in range(0, len(prints), chunk):
        left = np.arange(at, min(at + chunk, len(prints)))
        equal = np.zeros((len(left), len(prints)), np.uint16)
        for lane in range(SIGNATURE):
            equal += lanes[left, lane][:, None] == lanes[None, :, lane]
        likely = (equal >= LEAST_SEEN * SIGNATURE) & (left[:, None] < np.arange(len(prints))[None, :])
        likely &= SIMILAR[1] * np.minimum(size[left][:, None], size[None, :]) >= SIMILAR[0] * np.maximum(size[left][:, None], size[None, :])
        if not one_block:
            likely &= block[left][:, None] != block[None, :]
        a, b = np.nonzero(likely)
        # the likeliest first: they connect the rest, which then need no check
        for k in np.argsort(-equal[a, b].astype(np.int32), kind="stable"):
            x, y = int(left[a[k]]), int(b[k])
            if root[x] != root[y] and similar(sets[x], sets[y]):
                low, high = sorted((root[x], root[y]))
                root[root == high] = low
                links.append((int(prints[x]), int(prints[y])))
    return links


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (family, low, high, block, print, lanes, members) sorted by family, low and high: links of each such cell."""

    def emit(cell, rows):
        prints = np.array([r["print"] for r in rows], np.int64)
        lanes = np.frombuffer(b"".join(r["lanes"] for r in rows), np.uint8).reshape(len(rows), SIGNATURE)
        lanes = np.asfortranarray(lanes)
        sets = [np.frombuffer(r["members"], "<u8") for r in rows]
        links = spanning_links(prints, lanes, sets, np.array([r["block"] for r in rows]), cell[1] == cell[2])
        if links:
            a, b = np.array(links, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    cell, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            here = r["family"], r["low"], r["high"]
            if here != cell:
                if len(rows) > 1:
                    yield from emit(cell, rows)
                cell, rows = here, []
            rows.append(r)
    if len(rows) > 1:
        yield from emit(cell, rows)


def families_of(distinct: DataFrame) -> DataFrame:
    """(print, family) of the sets that share a band with another; distinct (print, bands) once each."""
    sizes = distinct.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count("*").alias("size"))
    shared = stage(sizes.where("size > 1").select("band"), "shared-bands")
    likely = distinct.select("print", F.explode(Marks(shared).only()("bands")).alias("band"))
    posts = stage(likely.join(shared, "band"), "shared-posts")
    # every set of a band hangs on the smallest of it
    first = posts.groupBy("band").agg(F.min("print").alias("first"))
    stars = posts.join(first, "band").where("print <> first").select(F.col("print").alias("a"), F.col("first").alias("b"))
    return components(stars.distinct()).select(F.col("node").alias("print"), F.col("root").alias("family"))


def similar_links(distinct: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Links (a, b) that connect similar sets; distinct (print, key, bands) once each, key the hash of a text in docs."""
    families = stage(families_of(distinct).join(distinct.select("print", "key"), "print"), "families")
    marked = Marks(families.select("key"))
    texts = docs.select(F.xxhash64("text").alias("key"), "text").where(marked.has()("key")).groupBy("key").agg(F.first("text").alias("text"))
    found = texts.join(families, "key").select("print", "family", whole_sets(words)("text").alias("_s"))
    members = stage(found.select("print", "family", "_s.*"), "family-sets")
    weight = (F.octet_length("members") + SIGNATURE + 64).cast("long")
    weights = members.groupBy("family").agg(F.sum(weight).alias("bytes"))
    blocks = F.ceil(F.col("bytes") / SMALL_BLOCK)
    blocks = F.when(blocks <= FEW_BLOCKS, blocks).otherwise(F.greatest(F.lit(FEW_BLOCKS), F.ceil(F.col("bytes") / LARGE_BLOCK)))
    placed = members.join(weights.select("family", blocks.cast("long").alias("blocks")), "family")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("print"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    cells = placed.select("family", "block", other.alias("other"), "print", "lanes", "members")
    cells = cells.select("family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "print", "lanes", "members")
    met = cells.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high").mapInArrow(_meet, "a bigint, b bigint")
    return met.distinct()


def near_duplicates(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Texts are linked if their sets of distinct shingles have a Jaccard similarity of at least 0.8; component_id is the smallest
    doc_id reachable, the own one included. A text without words is linked with nothing: its component is its own
    doc_id. kept says that doc_id is the component's. Repeated rows stay, as do rows that share a doc_id with different
    texts. A row without doc_id is never the smallest; where no row of a component has a doc_id, component_id is null and
    its rows are kept. Extra columns are not read. An empty table gives no rows.
    """
    found = docs.select("doc_id", F.xxhash64("text").alias("key"), sketches(words)("text").alias("_s"))
    rows = stage(found.select("doc_id", "key", "_s.*"), "min-max-sketches")
    distinct = stage(rows.where("n > 0").groupBy("print").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), F.first("bands").alias("bands")), "distinct-sets")
    links = stage(similar_links(distinct, docs, words), "similar-sets")
    roots = stage(components(links), "set-roots")
    smallest = distinct.join(roots, F.col("print") == F.col("node")).groupBy("root").agg(F.min("least").alias("least"))
    linked = roots.join(smallest, "root").select(F.col("node").alias("print"), "least")
    alone = distinct.join(linked.select("print"), "print", "left_anti").select("print", "least")
    named = rows.where("n > 0").select("doc_id", "n", "print").join(linked.union(alone), "print").select("doc_id", "n", "least")
    wordless = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("least"))
    every = named.union(wordless).select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
