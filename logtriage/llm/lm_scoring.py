"""Language-model scores of whole texts, beside a plain word model.

The word model is counted over all training texts. The attention model (see attention.py) reads subword ids of a
public vocabulary, reduced to the ids that are most frequent in the training words; a rarer id is spelled by the ids
of its bytes. All statistics it starts from (ids, pairs of ids) are counts over every training word, and its weights
are fitted in rounds by all tasks on windows that together hold every id of every training text; after a round the
weights are averaged.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtriage.llm import attention as A
from logtriage.llm.common import crc_of_id, stage
from logtriage.llm.encoding import encoder, word_ids

FOLD = 7
# Words whose counts every task holds; all others are joined by shuffle. No result depends on it.
COMMON_WORDS = 100_000
# Weight of the words' shares beside the attention model.
WORD_SHARE = 0.3
ROUNDS, AVERAGED_AT_ONCE = 3, 16
# Bytes of text whose words are taken together. No result depends on them.
COUNTED_AT_ONCE, READ_AT_ONCE = 16_000_000, 2_000_000


def held_out(doc_id: Column) -> Column:
    return (crc_of_id(doc_id) % FOLD) == 2


def words_of(text: str | None) -> list[bytes]:
    """The words of one text (the plain form)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _groups(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows whose texts have about `most` bytes together at most, at least one row each."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(upto):
        before = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has (null: none), and all words laid end to end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    every = pc.list_flatten(lists)
    real = pc.not_equal(pc.binary_length(every), 0)  # white space at either end of a text leaves an empty word
    upto = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
    return np.diff(upto[ends], prepend=0), every.filter(real).cast(pa.binary())


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) over all whole texts: counted inside tasks first, then summed by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _groups(batch, COUNTED_AT_ONCE):
                found = pc.value_counts(_words(some.column("text"))[1])
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

    return train.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def common_words(counts: DataFrame, most: int = COMMON_WORDS) -> dict[bytes, int]:
    """The words above the smallest count that at most `most` words exceed; the driver gets one row per distinct count, and them."""
    cutoff, held = 0, 0
    for row in sorted(counts.groupBy("n").agg(F.count("*").alias("words")).collect(), key=lambda r: -r["n"]):
        held += row["words"]
        if held > most:
            cutoff = row["n"]
            break
    return {bytes(r["word"]): r["n"] for r in counts.where(F.col("n") > cutoff).collect()}


@dataclass
class Subwords:
    """The reduced vocabulary: for ids of the public one, the reduced ids that spell them."""

    path: str
    spelled: list[bytes]  # little-endian 2-byte reduced ids
    end: int
    begin_classes: int
    end_share: float = 0.0

    def __post_init__(self):
        self.sizes = np.array([len(ids) // 2 for ids in self.spelled], np.int64)
        self.parts = np.frombuffer(b"".join(self.spelled), "<i2")

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Reduced ids of all words laid end to end, and how many each word has."""
        ids, sizes = word_ids(self.path).of(words)
        begins = np.cumsum(self.sizes) - self.sizes
        reduced = _runs(self.parts, begins[ids], self.sizes[ids])
        upto = np.append(0, np.cumsum(self.sizes[ids]))
        after = np.cumsum(sizes)
        return reduced, upto[after] - upto[after - sizes]


def _runs(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of an array, laid end to end."""
    shift = begins - (np.cumsum(sizes) - sizes)
    return flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]


class Lexicon:
    """Words met by a task: their reduced ids and their counts among the common words, kept up to a bound."""

    def __init__(self, subwords: Subwords, usual: dict[bytes, int], most: int = 300_000):
        self.subwords, self.usual, self.most = subwords, usual, most
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.ids = np.zeros(0, np.int16)
        self.sizes, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.begins = np.zeros(0, np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """A number for each of some different words; holds until the next call."""
        if len(self.words) > self.most:
            self.clear()
        found = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(found < 0)
        if len(fresh):
            new = [words[n] for n in fresh.tolist()]
            found[fresh] = np.arange(len(self.words), len(self.words) + len(new))
            self.number.update(zip(new, found[fresh].tolist()))
            ids, sizes = self.subwords.of(new)
            self.words += new
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
            self.counts = np.concatenate([self.counts, np.fromiter(map(self.usual.get, new, repeat(0)), np.int64, len(new))])
            self.begins = np.cumsum(self.sizes) - self.sizes
        return found

    def all_numbers(self, words: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
        """A number for each word, and the words coded by the different ones."""
        coded = words.dictionary_encode()
        return self.numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()], coded

    def sequence(self, numbers: np.ndarray) -> np.ndarray:
        return _runs(self.ids, self.begins[numbers], self.sizes[numbers])


def _summed(counts: DataFrame, size: int, cells) -> np.ndarray:
    """Sums of arrays of a fixed size that tasks fill by cells(words, numbers) -> (places, amounts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            places, amounts = cells(batch.column("word").to_pylist(), batch.column("n").to_numpy())
            np.add.at(total, places, amounts)
        spots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(spots), pa.array(total[spots])], names=["place", "n"])

    out = np.zeros(size, np.int64)
    rows = counts.mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    out[rows["place"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def reduced_vocabulary(counts: DataFrame, path: str) -> Subwords:
    """The bytes, an end, and the most frequent ids of all training words, by falling frequency."""

    def cells(words: list[bytes], numbers: np.ndarray):
        ids, sizes = word_ids(path).of(words)
        return ids, np.repeat(numbers, sizes)

    tool = encoder(path)
    vocabulary = tool.tokenizer.get_vocab()
    names = {number: name for name, number in vocabulary.items()}
    single = {number for name, number in vocabulary.items() if len(name) == 1}
    used = _summed(counts, tool.size, cells)
    # ids that begin a word fill whole classes, so that the share of "a word ends here" is a sum over classes
    order = sorted(vocabulary.values(), key=lambda k: (-used[k], k))
    begins = [k for k in order if names[k][0] == "Ġ" and (used[k] or k in single)]
    inside = [k for k in order if names[k][0] != "Ġ" and (used[k] or k in single)]
    top = set(sorted(begins + inside, key=lambda k: -used[k])[: A.IDS - len(single)])
    room = min(max(-(-sum(k in top for k in begins) // A.MEMBERS), 1), A.CLASSES - 1 - len(single) // A.MEMBERS) * A.MEMBERS

    def kept(some: list[int], most: int) -> list[int]:
        """The most frequent ones, and all single bytes."""
        needed = [k for k in some if k in single]
        others = [k for k in some if k not in single][: most - len(needed)]
        return sorted(needed + others, key=lambda k: (-used[k], k))

    begins, inside = kept(begins, room - 1), kept(inside, A.IDS - room)
    end = room - 1
    # an id of None is a place that no text uses
    chosen = begins + [None] * (end - len(begins)) + [None] + inside
    new = {k: n for n, k in enumerate(chosen) if k is not None}
    spelled = []
    for k in range(tool.size):
        parts = [new[k]] if k in new else [new.get(vocabulary.get(c, -1), 0) for c in names.get(k, "")]
        spelled.append(np.array(parts, "<i2").tobytes())
    return Subwords(path, spelled, end, room // A.MEMBERS)


def pair_statistics(counts: DataFrame, subwords: Subwords, texts: int) -> np.ndarray:
    """How often an id follows another: counted inside words, and by the usual begins of words (or the text's end) after their last ids."""
    size = A.IDS * A.IDS

    def cells(words: list[bytes], numbers: np.ndarray):
        ids, length = subwords.of(words)
        ids = ids.astype(np.int64)
        amount = np.repeat(numbers, length)
        last = np.cumsum(length) - 1
        inner = np.ones(len(ids), bool)
        inner[last] = False
        where = np.flatnonzero(inner)
        first = last - length + 1
        return np.concatenate([ids[where] * A.IDS + ids[where + 1], size + ids[first], size + A.IDS + ids[last]]), np.concatenate([amount[where], numbers, numbers])

    total = _summed(counts, size + 2 * A.IDS, cells)
    pairs = total[:size].reshape(A.IDS, A.IDS).astype(np.float64)
    begins, ends = total[size : size + A.IDS].astype(float), total[size + A.IDS :].astype(float)
    begins[subwords.end] += texts
    pairs += np.outer(ends, begins / max(1.0, begins.sum()))
    pairs[subwords.end] += begins
    return pairs


def training_ids(train: DataFrame, subwords: Subwords) -> DataFrame:
    """The ids of every whole training text, between two ends, and the number of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon(subwords, {})
        end = np.array([subwords.end], "<i2").tobytes()
        for batch in batches:
            for some in _groups(batch, READ_AT_ONCE):
                n_words, words = _words(some.column("text"))
                number, _ = known.all_numbers(words)
                ids = known.sequence(number).tobytes()
                upto = np.append(0, 2 * np.cumsum(known.sizes[number]))[np.append(0, np.cumsum(n_words))].tolist()
                rows = [end + ids[a:b] + end for a, b in zip(upto, upto[1:])]
                counts = [A.n_windows(len(row) // 2 - 1) for row in rows]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(counts, pa.int64())], names=["ids", "windows"])

    return train.select("text").mapInArrow(run, "ids binary, windows bigint")


def _windows(rows: Iterator[pa.RecordBatch], end: int, turn: int, rounds: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The windows whose turn it is, about `most` at once, with their numbers of targets. In all turns together each id is a target once."""
    held, n, seen = [], 0, 0
    for batch in rows:
        for found in batch.column("ids"):
            ids = np.frombuffer(found.as_buffer(), "<i2")
            begins = np.arange(A.n_windows(len(ids) - 1)) * A.WINDOW
            mine = begins[(turn - seen) % rounds :: rounds]
            seen += len(begins)
            if len(mine):
                places = mine[:, None] + np.arange(A.WINDOW + 1)
                held.append((np.where(places < len(ids), ids[np.minimum(places, len(ids) - 1)], end), np.minimum(len(ids) - 1 - mine, A.WINDOW)))
                n += len(mine)
            if n >= most:
                yield tuple(np.concatenate(part) for part in zip(*held))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(part) for part in zip(*held))


def fit(texts: DataFrame, bias: A.PairBias, end: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after rounds in which every task fits its own windows; between rounds the weights are averaged.

    All rounds together are one pass over all windows: a window has its turn in one of them. A task holds a bounded number of them.

    Averaging is done by tasks, a few at a time, until so few rows are left that the driver takes them.
    """
    context = texts.sparkSession.sparkContext
    flat = A.pack(A.initial())
    shared_bias = context.broadcast(bias)  # IDS squared numbers, whatever the input
    parts = texts.rdd.getNumPartitions()
    windows = texts.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    steps = max(1, windows // (max(1, parts) * rounds * A.FIT_BATCH))  # about as many in a task and round

    def local(start, turn):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fitter, n = A.Fitter(A.unpack(start.value), shared_bias.value, steps), 0
            for ids, sizes in _windows(batches, end, turn, rounds, A.FIT_BATCH * 32):
                fitter.take(ids, sizes, seed=zlib.crc32(ids[:8].tobytes()))
                n += len(ids)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([fitter.flat.astype("<f8").tobytes()], pa.binary()), pa.array([float(n)])], names=["sums", "n"])

        return run

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0.0
        for batch in batches:
            for values, weight in zip(batch.column("sums").to_pylist(), batch.column("n").to_pylist()):
                part = np.frombuffer(values, "<f8") * weight
                total, n = part if total is None else total + part, n + weight
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([(total / n).tobytes()], pa.binary()), pa.array([n])], names=["sums", "n"])

    for turn in range(rounds):
        rows = texts.select("ids").mapInArrow(local(context.broadcast(flat), turn), "sums binary, n double")
        left = parts
        while left > AVERAGED_AT_ONCE:
            left = -(-left // AVERAGED_AT_ONCE)
            rows = rows.repartition(left).mapInArrow(added, "sums binary, n double")
        found = [(np.frombuffer(r["sums"], "<f8"), r["n"]) for r in rows.collect()]
        if found:
            flat = (sum(values * n for values, n in found) / sum(n for _, n in found)).astype(np.float32)
    return flat


def _mixed(scorer: A.Scorer, spelling: Subwords, sequences: list, n_words: np.ndarray, sizes: np.ndarray, counts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each text: every word by the attention model, or by its share among training words, mixed.

    The attention model's share of a word is that of its ids, its first id given that a word begins, and of a word ending
    behind it. Both shares are distributions over words, so their mixture is one. `sizes` and `counts` belong to the words
    of all texts, laid end to end. A count of zero gives the attention model's part only; the second result is every word's
    natural log probability by that model, from which the rest follows once the count is known.
    """
    logs, begin = A.token_logs(scorer, sequences, spelling.end)
    behind = np.cumsum(n_words)
    length = np.insert(sizes, behind, 1)  # behind the words of each text its end
    first = np.cumsum(length) - length
    after = first + length
    own = np.add.reduceat(logs, first) - begin[first]
    ends = behind + np.arange(len(n_words))
    is_end = np.zeros(len(length), bool)
    is_end[ends] = True
    own[~is_end] += begin[after[~is_end]]
    share = np.insert(counts / max(1, total), behind, spelling.end_share)
    mixed = np.logaddexp(own + math.log(1 - WORD_SHARE), np.log(np.maximum(share, 1e-300)) + math.log(WORD_SHARE))
    # what comes first in a text begins a word for certain
    return np.add.reduceat(mixed, ends - n_words) / math.log(10), own[~is_end]


ROWS = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, log_sum double, n_known bigint, score double, rare array<binary>, rare_own array<double>"


def _scored(docs: DataFrame, subwords: Subwords, flat: np.ndarray, bias: A.PairBias, common: dict[bytes, int], end_count: int, total: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    model = context.broadcast((subwords, flat, bias))
    counted = context.broadcast(common)  # at most COMMON_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling, weights, pair_bias = model.value
        usual, known = counted.value, Lexicon(spelling, counted.value)
        scorer = A.Scorer(A.unpack(weights), pair_bias, spelling.begin_classes)
        spelling.end_share = end_count / max(1, total)
        for batch in batches:
            for some in _groups(batch, READ_AT_ONCE):
                n_words, words = _words(some.column("text"))
                number, coded = known.all_numbers(words)
                sizes, counts = known.sizes[number], known.counts[number]
                owner = np.repeat(np.arange(len(n_words)), n_words)
                per_text = np.bincount(owner, sizes, len(n_words)).astype(np.int64)
                sequences = np.split(known.sequence(number), np.cumsum(per_text)[:-1])
                scores, owns = _mixed(scorer, spelling, sequences, n_words, sizes, counts, total)
                is_common = counts > 0
                logged = np.bincount(owner, np.log10(counts + 1), len(n_words)) + math.log10(end_count + 1)  # a count of 0 adds nothing
                seen = np.bincount(owner, is_common, len(n_words)).astype(np.int64) + (end_count > 0)
                rare = np.flatnonzero(~is_common)
                cuts = pa.array(np.searchsorted(owner[rare], np.arange(len(n_words) + 1)), pa.int32())
                names = coded.dictionary.take(coded.indices.take(pa.array(rare)))
                columns = [
                    some.column("row"), some.column("doc_id"), some.column("held_out"), pa.array(n_words + 1), pa.array(logged), pa.array(seen), pa.array(scores),
                    pa.ListArray.from_arrays(cuts, names), pa.ListArray.from_arrays(cuts, pa.array(owns[rare])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in ROWS.split(", ")])

    rows = docs.select("doc_id", "text", "held_out").withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(run, ROWS)


def score_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the texts outside the held-out fold. A null text counts as empty (one token, the end); null and
    repeated doc_ids stay row by row. Without training texts the counts are zero and the model predicts without
    statistics. An empty table gives no rows. The sum over rare words is joined and aggregated by row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(F.col("doc_id")))
    train = rows.where(~F.col("held_out"))
    counts = stage(word_counts(train), "word-counts")
    texts = train.count()
    size, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    train_tokens, distinct = total + texts, size + (texts > 0)
    common = common_words(counts)

    subwords = reduced_vocabulary(counts, vocabulary)
    bias = A.PairBias(pair_statistics(counts, subwords, texts))
    flat = fit(stage(training_ids(train, subwords), "training-ids"), bias, subwords.end)
    scored = stage(_scored(rows, subwords, flat, bias, common, texts, train_tokens), "scored")

    rare = scored.select("row", F.explode(F.arrays_zip("rare", "rare_own")).alias("_r")).select("row", F.col("_r.rare").alias("word"), F.col("_r.rare_own").alias("own"))
    found = rare.join(counts, "word", "inner")  # words that are only in held-out texts add log 1 = 0, and have no share
    # what the word's share adds to the logarithm of the mixture, beyond the attention model's part
    more = F.log(F.col("n") * F.lit(WORD_SHARE / (1 - WORD_SHARE) / max(1, train_tokens))) - F.col("own")
    more = F.when(more > 0, more + F.log1p(F.exp(-more))).otherwise(F.log1p(F.exp(more))) / math.log(10)
    sums = found.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("_log"), F.count("*").alias("_known"), F.sum(more).alias("_more"))
    joined = scored.drop("rare", "rare_own").join(sums, "row", "left")
    norm = math.log10(train_tokens + distinct + 1)
    base = F.col("log_sum") + F.coalesce("_log", F.lit(0.0)) - F.col("n_tokens") * norm
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("_more", F.lit(0.0))).alias("score"),
    )
