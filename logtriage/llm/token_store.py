"""Token-id shards with a minimal perfect hash index.

A store is a folder with one table, `shards`: each row is one shard of consecutive documents in ascending
key order, as raw blocks:

  payload   ids of its documents one after the other, little-endian, 2 bytes each if the vocabulary allows, else 4
  keys      its distinct keys, ascending, 8 bytes each (to list a shard; lookups do not read them)
  seeds     one displacement (4 bytes) per hash bucket
  slots     per slot: fingerprint of the key, its first row, and the number of its rows (4 bytes each)
  ends      per row: ids up to its end, counted from the shard's begin (8 bytes each)

A key's bucket and seed give its slot: no key of the shard shares it, and there are as many slots as keys.
A lookup reads one seed, one slot, two ends and the ids themselves. The stored fingerprint tells foreign
keys apart (a foreign key is taken for a stored one once in 2^32). A row without a key is kept in front and
is listed, but cannot be looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtriage.llm.encoding import text_encoder, text_groups

SHARD_IDS = 4_000_000
BUCKET_KEYS = 4
# Texts encoded together; their distinct parts are encoded once.
GROUP_CHARS = 12_000_000
_FIELDS = pa.schema(
    [
        ("part", pa.int32()), ("seq", pa.int32()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_rows", pa.int64()), ("n_keyless", pa.int64()),
        ("n_ids", pa.int64()), ("width", pa.int32()), ("payload", pa.binary()), ("keys", pa.binary()), ("seeds", pa.binary()), ("slots", pa.binary()), ("ends", pa.binary()),
    ]
)
SHARDS = "part int, seq int, first_key bigint, last_key bigint, n_rows bigint, n_keyless bigint, n_ids bigint, width int, payload binary, keys binary, seeds binary, slots binary, ends binary"


def _mix(keys: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys: multiply and shift rounds."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + (np.asarray(seed, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def _spots(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and fingerprint of each key."""
    return (_mix(keys, 0) % np.uint64(n_buckets)).astype(np.int64), (_mix(keys, 1) >> np.uint64(32)).astype(np.uint32)


def build_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds by bucket, and the slot and fingerprint of each of these distinct keys.

    Buckets place their keys from the largest on: the first seed that sends all keys of a bucket to
    different free slots is kept. Keys of one bucket differ in all seeds' hashes, so a seed exists.
    """
    n = len(keys)
    n_buckets = max(1, -(-n // BUCKET_KEYS))
    bucket, prints = _spots(keys, n_buckets)
    order = np.argsort(bucket, kind="stable")
    begin = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    size = np.diff(begin)
    seeds, slot, free = np.zeros(n_buckets, np.uint32), np.zeros(n, np.int64), np.ones(n, bool)
    for b in np.argsort(-size, kind="stable"):
        mine = order[begin[b] : begin[b + 1]]
        if not len(mine):
            break
        tried = np.arange(2, 34, dtype=np.uint64)
        while True:  # 32 seeds at a time
            spots = (_mix(keys[mine][None, :], tried[:, None]) % np.uint64(n)).astype(np.int64)
            good = free[spots].all(axis=1)
            if len(mine) > 1:
                ordered = np.sort(spots, axis=1)
                good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                break
            tried = np.arange(tried[-1] + 1, tried[-1] + 1 + min(8 * len(tried), 1 << 16), dtype=np.uint64)
        k = int(np.argmax(good))
        seeds[b], slot[mine] = tried[k], spots[k]
        free[spots[k]] = False
    return seeds, slot, prints


def find_slots(seeds: np.ndarray, prints: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The slot of each wanted key, -1 where the stored fingerprint is another one."""
    if not len(prints):
        return np.full(len(wanted), -1)
    bucket, own = _spots(wanted, len(seeds))
    slot = (_mix(wanted, seeds[bucket].astype(np.uint64)) % np.uint64(len(prints))).astype(np.int64)
    return np.where(prints[slot] == own, slot, -1)


def _shard(part: int, seq: int, keys: list, ids: list[bytes], width: int) -> pa.RecordBatch:
    keyless = sum(key is None for key in keys)  # nulls come first
    held = np.array(keys[keyless:], np.int64)
    distinct, first, count = np.unique(held, return_index=True, return_counts=True)
    seeds, slot, prints = build_hash(distinct)
    slots = np.zeros((len(distinct), 3), np.uint32)
    slots[slot] = np.column_stack([prints, (first + keyless).astype(np.uint32), count.astype(np.uint32)])
    ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)
    payload = b"".join(ids)
    if width == 2:
        payload = np.frombuffer(payload, "<u4").astype("<u2").tobytes()
    bounds = (int(held[0]), int(held[-1])) if len(held) else (None, None)
    row = (part, seq, *bounds, len(keys), keyless, int(ends[-1]), width, payload, *(x.tobytes() for x in (distinct, seeds, slots, ends)))
    return pa.RecordBatch.from_arrays([pa.array([value], f.type) for value, f in zip(row, _FIELDS)], schema=_FIELDS)


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Encode whole texts, append `end_id`, and write them in ascending doc_id order below `path`.

    A null text counts as empty. Null doc_ids come first. Rows that share a doc_id follow each other in
    order of their texts; they may be spread over tasks and shards. An empty table gives a store without shards.
    Shards are cut at `shard_ids` ids, so that memory is bounded whatever the size of a partition; only a
    single longer text makes a longer shard.
    """
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, keys, ids = TaskContext.get().partitionId(), 0, 0, [], []
        tool = text_encoder(vocabulary)
        width = 2 if max(tool.size - 1, end_id) < 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            numbers = batch.column("doc_id").to_pylist()
            for some, texts in text_groups(batch, GROUP_CHARS):
                for key, found in zip(numbers[some], tool.encode_many(texts)):
                    if held and held + len(found) // 4 >= shard_ids:
                        yield _shard(part, seq, keys, ids, width)
                        seq, held, keys, ids = seq + 1, 0, [], []
                    keys.append(key)
                    ids.append(found + end)
                    held += len(found) // 4 + 1
        if keys:
            yield _shard(part, seq, keys, ids, width)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_tie", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "_tie", "_row"]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    placed.mapInArrow(encode, SHARDS).write.option("compression", "lz4").parquet(f"{path}/shards")


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(f"{path}/shards")


def shard_bounds(spark: SparkSession, path: str) -> list:
    """One small row per shard (about one for 4 million ids), in key order, with the ids before it."""
    rows = _shards(spark, path).select("part", "seq", "first_key", "last_key", "n_ids").orderBy("part", "seq").collect()
    before, out = 0, []
    for row in rows:
        out.append((row["part"], row["seq"], row["first_key"], row["last_key"], before))
        before += row["n_ids"]
    return out


def _opened(batch: pa.RecordBatch, n: int) -> dict:
    row = {name: batch.column(name)[n].as_py() for name in batch.schema.names}
    row["slots"] = np.frombuffer(row["slots"], np.uint32).reshape(-1, 3)
    row["seeds"], row["ends"] = np.frombuffer(row["seeds"], np.uint32), np.frombuffer(row["ends"], np.int64)
    row["prints"] = np.ascontiguousarray(row["slots"][:, 0])
    return row


def _ids(shard: dict, n: int) -> tuple[int, bytes]:
    """Begin of a row within the shard, and its ids as 4-byte integers."""
    begin, end = int(shard["ends"][n - 1]) if n else 0, int(shard["ends"][n])
    width = shard["width"]
    held = shard["payload"][begin * width : end * width]
    return begin, held if width == 4 else np.frombuffer(held, "<u2").astype("<u4").tobytes()


ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _emitted(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ROWS)], schema=_ROWS)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Every stored row (doc_id, start, n_tokens, ids): each shard looks all of its keys up in its index.

    start counts the ids of all documents before it in the whole store. A key that its index does not
    find raises an error. Repeated keys give all their rows.
    """
    before = {(part, seq): ids for part, seq, _, _, ids in shard_bounds(spark, path)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                shard = _opened(batch, n)
                base = before[shard["part"], shard["seq"]]
                keys = np.frombuffer(shard["keys"], np.int64)
                slot = find_slots(shard["seeds"], shard["prints"], keys)
                if (slot < 0).any():
                    raise ValueError("an index does not know one of its keys")
                places = [(None, row) for row in range(shard["n_keyless"])]
                for key, (_, first, count) in zip(keys.tolist(), shard["slots"][slot].tolist()):
                    places += [(key, first + k) for k in range(count)]
                rows, size = [], 0
                for key, row in places:
                    begin, ids = _ids(shard, row)
                    rows.append((key, base + begin, len(ids) // 4, ids))
                    size += len(ids)
                    if size > 4_000_000:
                        yield _emitted(rows)
                        rows, size = [], 0
                if rows:
                    yield _emitted(rows)

    return _shards(spark, path).mapInArrow(read, ROWS)


def look_up(keys: DataFrame, path: str) -> DataFrame:
    """Rows stored under the given keys (column doc_id), each key once; keys that are not there give no row.

    Keys are sent to the shards whose bounds hold them; there the index gives the place at once.
    """
    spark = keys.sparkSession
    every = shard_bounds(spark, path)
    bounds = [b for b in every if b[2] is not None]
    first, last = np.array([b[2] for b in bounds], np.int64), np.array([b[3] for b in bounds], np.int64)
    before = {b[:2]: b[4] for b in every}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("doc_id").to_numpy()
            low, high = np.searchsorted(last, wanted, "left"), np.searchsorted(first, wanted, "right")
            rows = [(*bounds[k][:2], int(key)) for key, a, b in zip(wanted, low, high) for k in range(a, b)]
            names = ["part", "seq", "doc_id"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=names)

    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        wanted = left.column("doc_id").to_numpy()
        for batch in right.to_batches():
            for n in range(batch.num_rows):
                shard = _opened(batch, n)
                base = before[shard["part"], shard["seq"]]
                for key, slot in zip(wanted.tolist(), find_slots(shard["seeds"], shard["prints"], wanted)):
                    if slot >= 0:
                        for k in range(int(shard["slots"][slot, 2])):
                            begin, ids = _ids(shard, int(shard["slots"][slot, 1]) + k)
                            rows.append((key, base + begin, len(ids) // 4, ids))
        return pa.Table.from_batches([_emitted(rows)])

    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    routed = wanted.mapInArrow(route, "part bigint, seq bigint, doc_id bigint")
    return routed.groupBy("part", "seq").cogroup(_shards(spark, path).withColumns({c: F.col(c).cast("long") for c in ("part", "seq")}).groupBy("part", "seq")).applyInArrow(fetch, ROWS)
