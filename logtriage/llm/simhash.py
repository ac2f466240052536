"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints within `radius` differing bits have a variant in common that lies within half the radius
of both. So every distinct fingerprint stands for all its variants within half the radius, and all
fingerprints that meet in a variant are linked (they differ in at most twice the half). To keep the
shuffle small, only the leading bits of the variants are shuffled on: a fingerprint is sent once to each
leading value that some of its variants begin with, and the task that receives it makes the variants with
that beginning. Every variant is made in exactly one task, and each one that meets there is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtriage.llm.common import free_name, stage
from logtriage.llm.components import components

BITS = 64
BLOCK = 65_536  # shingles whose bits are counted at once
VARIANTS = 2_000_000  # variants a task holds at once, but for one leading value with more


def fingerprint_of(text: str | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of a whole text: bit b is set if it is set in more than half of the shingles' hashes.

    ASCII letters are lowered; words end at ASCII white space; fewer words than a shingle give one shingle;
    no words (or null) give zero.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    total = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        upto = min(at + BLOCK, n)
        shingles = map(b" ".join, zip(*(found[at + k : upto + k] for k in range(words)))) if len(found) >= words else [b" ".join(found)]
        hashes = np.fromiter((digest(s, seed) for s in shingles), "<u8", upto - at)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(words: int = 4, seed: int = 42):
    """The fingerprint as a signed 64-bit column function of a text column."""

    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        values = np.fromiter((fingerprint_of(text, words, seed) for text in texts.to_pylist()), np.uint64, len(texts))
        return pa.array(values.view(np.int64))

    return fingerprint


def _masks(bits: int, most: int, lowest: int = 0) -> list[int]:
    """All integers of `bits` bits (shifted up by `lowest`) with at most `most` bits set."""
    return [sum(1 << (lowest + b) for b in chosen) for n in range(most + 1) for chosen in combinations(range(bits), n)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _stars(prints: np.ndarray, variants: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest fingerprint of its group here) of those that meet in a variant."""
    ordered = np.sort(variants)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(shared):
        return prints[:0], prints[:0]
    spot = np.minimum(np.searchsorted(shared, variants), len(shared) - 1)
    order = np.flatnonzero(shared[spot] == variants)
    order = order[np.argsort(variants[order], kind="stable")]
    starts = np.flatnonzero(np.append(True, variants[order][1:] != variants[order][:-1]))
    size = np.diff(np.append(starts, len(order)))
    who = owner[order]
    label = np.arange(len(prints))
    while True:  # the smallest label spreads over meeting variants
        least = np.minimum.reduceat(label[who], starts)
        new = label.copy()
        np.minimum.at(new, who, np.repeat(least, size))
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(prints)))
    return prints[rest], prints[label[rest]]


def _meet(half: int, lead: int):
    """For rows (head, print) grouped by head: links among fingerprints that share a variant with this head."""
    tails = {n: np.array(_masks(BITS - lead, n), np.uint64) for n in range(half + 1)}
    shift = np.uint64(BITS - lead)

    def links(heads: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints, group = np.unique(prints, return_inverse=True)  # a fingerprint may be here under several heads
        moved = (prints[group] & ~(np.uint64(2**64 - 1) << shift)) | (heads << shift)
        spent = np.bitwise_count((prints[group] >> shift) ^ heads)
        variants, owner = [], []
        for n, masks in ((half - k, tails[half - k]) for k in range(half + 1)):
            mine = np.flatnonzero(spent == half - n)
            variants.append((moved[mine][:, None] ^ masks[None, :]).ravel())
            owner.append(np.repeat(group[mine], len(masks)))
        return _stars(prints, np.concatenate(variants), np.concatenate(owner))

    per_row = np.array([len(tails[half - k]) for k in range(half + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def emit(heads: np.ndarray, prints: np.ndarray):
            a, b = links(heads, prints)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            heads = batch.column("head").to_numpy().astype(np.uint64)
            prints = batch.column("print").to_numpy().view(np.uint64)
            held.append((heads, prints))
            size += int(per_row[np.bitwise_count((prints >> shift) ^ heads)].sum())
            if size >= VARIANTS:
                heads, prints = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(heads, heads[-1]))  # the last head may go on
                if cut:
                    yield from emit(heads[:cut], prints[:cut])
                held = [(heads[cut:], prints[cut:])]
                size = int(per_row[np.bitwise_count((prints[cut:] >> shift) ^ heads[cut:])].sum())
        if held:
            yield from emit(*(np.concatenate(x) for x in zip(*held)))

    return run


def near_links(prints: DataFrame, radius: int = 4, lead: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column print, signed 64 bits) that connect all pairs within an even radius.

    Links are spanning: each task replaces what meets in its variants by stars, so copies of a passage in
    thousands of texts give as many links as fingerprints, not pairs. Every link joins fingerprints that
    are connected by steps of at most `radius` bits. `lead` bits choose the task; it grows with the
    logarithm of the table so that a task's share stays the same.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    half = radius // 2
    if lead is None:
        lead = min(32, max(12, prints.count().bit_length() - 4))
    masks = _masks(lead, half)
    heads = F.explode(F.array(*[F.lit(m) for m in masks])) if len(masks) < 50 else F.explode(F.from_json(F.lit(str(masks)), T.ArrayType(T.LongType())))
    sent = prints.select("print", F.shiftrightunsigned("print", BITS - lead).alias("_own"), heads.alias("_mask"))
    sent = sent.select((F.col("_own").bitwiseXOR(F.col("_mask"))).alias("head"), "print")
    met = sent.repartition("head").sortWithinPartitions("head").mapInArrow(_meet(half, lead), "a bigint, b bigint")
    return met.distinct()


def variant_count(radius: int = 4) -> int:
    """Variants that every fingerprint stands for."""
    return sum(comb(BITS, n) for n in range(radius // 2 + 1))


def groups(docs: DataFrame, words: int = 4, seed: int = 42, radius: int = 4, text_key: Column | None = None) -> DataFrame:
    """(doc_id, fingerprint as signed 64 bits, component_id, root) for every row; root is the smallest fingerprint of the component.

    component_id is the smallest doc_id reachable over links of at most `radius` bits, the own one
    included; null only if no row of the component has a doc_id. Texts without words (null, empty) share the
    fingerprint zero and link like others. Repeated rows stay. `text_key` may add a column `text_key` for joins
    with the table. An empty table gives no rows.
    """
    columns = [F.col("doc_id"), fingerprints(words, seed)(F.col("text")).alias("print")]
    if text_key is not None:
        columns.append(text_key.alias("text_key"))
    rows = stage(docs.select(*columns), "fingerprints")
    distinct = stage(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct-prints")
    return grouped(rows, distinct, near_links(distinct.select("print"), radius))


def grouped(rows: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (doc_id, print, ...) with the component of their print over links (a, b); distinct has (print, least) once each."""
    roots = stage(components(links), "print-roots")
    linked = distinct.join(roots, F.col("print") == F.col("node")).select("print", "root", "least")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(smallest, "root").select("print", "root", "component_id")
    # a lone fingerprint is its own component
    alone = distinct.join(roots.select(F.col("node").alias("print")), "print", "left_anti").select("print", F.col("print").alias("root"), F.col("least").alias("component_id"))
    return rows.join(linked.union(alone), "print").select("doc_id", F.col("print").alias("fingerprint"), "component_id", "root", *rows.columns[2:])


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that stay: of each component one row with the smallest doc_id.

    Ties (rows with that same doc_id) keep the row with the smallest hash of its text, and one of rows that are
    equal in both. A component without any doc_id keeps one row.
    """
    key = F.xxhash64("text")
    return keep_rows(docs, groups(docs, text_key=key, **options), key)


def keep_rows(docs: DataFrame, rows: DataFrame, key: Column) -> DataFrame:
    """keep_one for the rows of groups; key is the hash of the text."""
    # in a component, the rows with its id; of these the smallest text hash
    mine = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = mine.groupBy("root", "doc_id").agg(F.min(F.struct("fingerprint", "text_key")).alias("_m"))
    chosen = chosen.select(F.col("doc_id").alias("_doc"), F.col("_m.text_key").alias("_key")).distinct()
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    names = [free_name(docs, n) for n in ("_name", "_key", "_n")]
    chosen = chosen.select(F.coalesce(F.col("_doc").cast("string"), F.lit("")).alias(names[0]), F.col("_key").alias(names[1])).distinct()
    kept = docs.withColumns({names[0]: name, names[1]: key}).join(chosen, names[:2], "left_semi")
    one = Window.partitionBy(*names[:2]).orderBy(names[0])
    return kept.withColumn(names[2], F.row_number().over(one)).where(F.col(names[2]) == 1).select(*docs.columns)
