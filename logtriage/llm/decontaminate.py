"""Benchmark passages in training texts, found with a positional inverted index.

The index is split by documents, like a search service's: each task takes some documents, numbers their
words one after the other (with a gap between documents) and stores, for every distinct word, the sorted
positions at which it stands. A word that fills a third of all texts is thus spread over all shards. Each
shard answers all phrases: it takes the rarest word's positions less the word's offset in the phrase and
intersects them with those of the next rarest, until all words stand where the phrase wants them. With a
slop, words may stand that far from their place (proximity).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from logtriage.llm.common import free_name, scratch

WINDOW = 13
SHARD_WORDS = 400_000
QUERY_BYTES = 32 * 1024 * 1024
# Texts go to Python in batches of some megabytes: Spark's own limit lets each task hold several times 64 MB outside the heap.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 * 1024 * 1024
# A shard is one row of some megabytes. Parquet's writer looks at its buffers every 100 rows only, and a reader takes a row group as a
# whole: unless told otherwise, a task with many shards holds hundreds of megabytes, when it writes them and when it reads them.
GROUP_BYTES = 8 * 1024 * 1024
WRITTEN = {
    "parquet.block.size": GROUP_BYTES, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1,
    "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1,
}
# All bytes but ASCII letters, digits and those of other characters separate words.
_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_TABLE = bytes.maketrans(_SEPARATORS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_SEPARATORS) + b"abcdefghijklmnopqrstuvwxyz")
SHARD = "doc_ids array<bigint>, begins binary, lengths binary, terms array<binary>, ends binary, positions binary"
FOUND = "doc_id bigint, shard bigint, place int, n_words bigint, spans binary, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and digits and of all other characters outside ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _shard(ids: list, words: list[list[bytes]]) -> tuple:
    number = defaultdict(count().__next__)
    lengths = np.array([len(w) for w in words], np.int64)
    begins = np.append(0, np.cumsum(lengths + 1)[:-1])  # one empty position after each document
    get = number.__getitem__
    term = np.fromiter((get(word) for found in words for word in found), np.int32, int(lengths.sum()))
    position = np.arange(len(term)) + np.repeat(np.arange(len(words)), lengths)
    order = np.argsort(term, kind="stable")
    ends = np.cumsum(np.bincount(term, minlength=len(number)))
    names = sorted(range(len(number)), key=(listed := list(number)).__getitem__)  # terms are stored sorted
    first = np.append(0, ends[:-1])
    sizes = (ends - first)[names] if names else ends
    take = np.repeat(first[names] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(len(term)) if names else order
    return (ids, begins.astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), [listed[n] for n in names], np.cumsum(sizes).astype("<i8").tobytes(), position[order][take].astype("<i4").tobytes())


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """For jobs run inside: a smaller limit of the session, if there is one, stays."""
    before = spark.conf.get(BATCH_SETTING, None)
    number = (before or "").rstrip("bB")
    if not (number.isdigit() and 0 < int(number) <= BATCH_BYTES):
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SETTING) if before is None else spark.conf.set(BATCH_SETTING, before)


def build_index(docs: DataFrame, path: str, shard_words: int = SHARD_WORDS) -> None:
    """Write the index of all words of the whole texts below `path`; a null text has no words.

    Null and repeated doc_ids are kept row by row. Shards are cut at `shard_words` words and row groups at some shards, so
    memory stays bounded, however many shards a task makes; a longer single text makes a longer shard.
    """
    fields = to_arrow_schema(T.StructType.fromDDL(SHARD))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, size = [], [], 0

        def emit():
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(_shard(ids, words), fields)], schema=fields)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found = words_of(text.as_py())
                if ids and size + len(found) > shard_words:
                    yield emit()
                    ids, words, size = [], [], 0
                ids.append(doc_id)
                words.append(found)
                size += len(found) + 1
        if ids:
            yield emit()

    shards = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, SHARD)
    with _small_batches(docs.sparkSession):
        shards.write.options(**WRITTEN).parquet(path)


class Phrases:
    """Distinct windows of some items, each with the items that hold it."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = words_of(text)
            for at in range(max(1, len(words) - window + 1) if words else 0):
                owners[tuple(words[at : at + window])].add(item)
        self.windows = list(owners)
        self.owners = [sorted(held) for held in owners.values()]


def match(positions: dict[bytes, np.ndarray], phrase: tuple[bytes, ...], slop: int = 0) -> np.ndarray:
    """Begins of the phrase: offset-adjusted lists are intersected from the rarest word on.

    With a slop, all words must stand within that distance of their place as told by the rarest word.
    """
    lists = []
    for offset, word in enumerate(phrase):
        found = positions.get(word)
        if found is None:
            return np.zeros(0, np.int64)
        lists.append((len(found), offset, found))
    lists.sort(key=lambda entry: entry[:2])
    begins = lists[0][2].astype(np.int64) - lists[0][1]
    for _, offset, found in lists[1:]:
        at = np.searchsorted(found, begins + offset - slop)
        near = found[np.minimum(at, len(found) - 1)]
        begins = begins[(at < len(found)) & (np.abs(near - (begins + offset)) <= slop)]
        if not len(begins):
            break
    return begins


def _query_blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[str, str | None]]]:
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"] or "") + 64
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_passages(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """One row per indexed document: n_words, spans (begin, end of hit words; 8-byte pairs), items.

    Items (item_id, text) are asked in blocks of bounded size: each is a pass over the index, in which every
    shard answers by itself, and the passes' rows are merged by document. Items without words match nothing;
    null item_ids are left out of `items` but their windows count as hits. Repeated items count once.
    """
    fields = to_arrow_schema(T.StructType.fromDDL(FOUND))

    def asked(phrases: Phrases):
        needed = {word for phrase in phrases.windows for word in phrase}

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(batch.num_rows):
                    row = {name: batch.column(name)[n] for name in batch.schema.names}
                    ids = row["doc_ids"].as_py()
                    begins, lengths = (np.frombuffer(row[c].as_py(), "<i8") for c in ("begins", "lengths"))
                    ends, held = np.frombuffer(row["ends"].as_py(), "<i8"), np.frombuffer(row["positions"].as_py(), "<i4")
                    positions = {}
                    for k, term in enumerate(row["terms"].values.to_pylist()):
                        if term in needed:
                            positions[term] = held[ends[k - 1] if k else 0 : ends[k]]
                    hits = defaultdict(list)
                    for phrase, owners in zip(phrases.windows, phrases.owners):
                        for begin in match(positions, phrase, slop).tolist():
                            hits[int(np.searchsorted(begins, begin, "right")) - 1].append((begin, begin + len(phrase), owners))
                    spans, found = [b""] * len(ids), [[] for _ in ids]
                    for place, all_hits in hits.items():
                        pairs = np.array([(a, b) for a, b, _ in all_hits], np.int64) - begins[place]
                        spans[place] = np.clip(pairs, 0, lengths[place]).astype("<i8").tobytes()
                        found[place] = sorted({owner for _, _, owners in all_hits for owner in owners if owner is not None})
                    columns = [ids, [row["shard"].as_py()] * len(ids), range(len(ids)), lengths, spans, found]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

        return ask

    numbered = index.withColumn("shard", F.monotonically_increasing_id())
    parts = [numbered.mapInArrow(asked(Phrases(block, window)), FOUND) for block in _query_blocks(items, query_bytes)]
    if len(parts) < 2:
        return (parts or [numbered.mapInArrow(asked(Phrases([], window)), FOUND)])[0]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.union(part)
    return merged.groupBy("shard", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_join(F.collect_list(F.hex("spans")), "").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    ).select("doc_id", "shard", "place", "n_words", F.unhex("spans").alias("spans"), "items")


def judged(found: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit (words inside any span), n_items, items_sha256, contaminated.

    Contaminated: at least one word is hit, and at least a twentieth of all words.
    """

    def covered(spans: bytes) -> int:
        pairs = np.frombuffer(spans, "<i8").reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        reach = np.append(0, np.maximum.accumulate(pairs[:, 1])[:-1])
        return int(np.maximum(0, pairs[:, 1] - np.maximum(pairs[:, 0], reach)).sum())

    @F.arrow_udf("long")
    def hit(spans: pa.Array) -> pa.Array:
        return pa.array([covered(s) if s else 0 for s in spans.to_pylist()], pa.int64())

    @F.arrow_udf("string")
    def digest(items: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items.to_pylist()])

    rows = found.select("doc_id", "n_words", hit("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest("items").alias("items_sha256"))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Index all documents and judge each against all items; an empty table of either kind gives its plain result."""
    path = scratch(docs.sparkSession, "postings")
    build_index(docs, path)
    return judged(find_passages(docs.sparkSession.read.schema(SHARD).parquet(path), items, window))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, whose text is not contaminated.

    The decision belongs to the text: the bad ones are found by the index, and rows with such a (doc_id, text
    hash) go, repeated rows included.
    """
    key = F.xxhash64("text")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    path = scratch(docs.sparkSession, "postings")
    # the index numbers rows itself, so that rows that share a doc_id can be told apart afterwards
    keyed = docs.select(F.xxhash64(name, key).alias("doc_id"), "text")
    build_index(keyed, path)
    bad = judged(find_passages(docs.sparkSession.read.schema(SHARD).parquet(path), items, window)).where("contaminated")
    column = free_name(docs, "_key")
    bad = bad.select(F.col("doc_id").alias(column)).distinct()
    return docs.withColumn(column, F.xxhash64(name, key)).join(bad, column, "left_anti").select(*docs.columns)
