"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier on hashed words is trained from confirmed toxic texts (positives) and plain corpus
texts (unlabelled). The risk of the negative class is what the unlabelled texts give less the part that
the class prior assigns to positives; where that difference falls below zero, the step goes the other way
(the non-negative correction). Several such classifiers, with different orders of their data, are averaged.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtriage.llm.common import bounded_sample, crc_of_id, stage

DIMENSIONS = 1 << 17
# Bounds of the training sample; scoring and the class prior use all rows.
MAX_POSITIVES = 6_000
MAX_UNLABELLED = 12_000
THRESHOLD = 0.3
BEGINNINGS = (4, 5, 6, 7)
# A feature is used if its shares in positives and unlabelled texts differ by so many standard errors.
LEAST_Z = 5.0
_WORD = re.compile(r"[^\W\d_]+")


def _slot(word: str) -> int:
    """The same in every process."""
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % DIMENSIONS


class _Slots(dict):
    """Slots of a word: of the word itself, and of its beginnings, which inflected words share."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 60_000:
            self.clear()
        parts = [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) >= n)]
        slots = self[word] = tuple(_slot(part) for part in parts)
        return slots


_SLOTS = _Slots()


def features(text: str | None) -> list[int]:
    """Slots of the distinct lower-cased words of a whole text."""
    words = set(_WORD.findall((text or "").lower()))
    return list({slot for word in words for slot in _SLOTS[word]})


@dataclass
class Model:
    weights: np.ndarray  # classifiers x dimensions
    bias: np.ndarray
    prior: float

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """Mean probability of the positive class; a text without words gets what the biases say."""
        out = []
        for text in texts:
            z = self.bias + self.weights[:, features(text)].sum(axis=1)
            out.append((1 / (1 + np.exp(-np.clip(z, -30, 30)))).mean())
        return np.array(out, np.float64)


def _rows(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(x) for x in found]
    return np.repeat(np.arange(len(found)), sizes), np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)


def useful_slots(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """Slots whose shares in positives and unlabelled texts differ by more than chance; from counts of texts by slot."""
    n_p, n_u = max(1, n_p), max(1, n_u)
    share = (in_p + in_u + 1) / (n_p + n_u + 2)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    return np.abs(z) >= LEAST_Z


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, members: int = 3, epochs: int = 30, rate: float = 0.02, decay: float = 2e-5, beta: float = 0.0) -> Model:
    """Fit `members` classifiers with the logistic loss and Adam on minibatches of useful slots.

    Without positives all scores are the prior.
    """
    weights, biases = [], []
    for member in range(members):
        rng = np.random.default_rng(member)
        w, b = np.zeros(DIMENSIONS), np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        m, v, mb, vb, step = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 0.0, 0
        batches = max(1, len(unlabelled) // 400) if positive and unlabelled else 0
        for _ in range(epochs):
            p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
            for ps, us in zip(np.array_split(p_order, batches) if batches else [], np.array_split(u_order, batches) if batches else []):
                if not len(ps):
                    ps = rng.choice(len(positive), 1)
                (pr, pf), (ur, uf) = _rows([positive[k] for k in ps]), _rows([unlabelled[k] for k in us])
                zp = b + np.bincount(pr, w[pf], len(ps))
                zu = b + np.bincount(ur, w[uf], len(us))
                sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
                negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
                # d log(1 + exp(z)) = s, d log(1 + exp(-z)) = s - 1
                gp, gu = -prior * sp / len(ps), su / len(us)
                if negative >= -beta:
                    gp = gp + prior * (sp - 1) / len(ps)
                else:
                    gp, gu = -gp, -gu
                g = np.bincount(pf, gp[pr], DIMENSIONS) + np.bincount(uf, gu[ur], DIMENSIONS)
                g = g + decay * w
                gb = gp.sum() + gu.sum()
                step += 1
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
                a = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                w -= a * m / (np.sqrt(v) + 1e-8)
                b -= a * mb / (np.sqrt(vb) + 1e-8)
        weights.append(w)
        biases.append(b)
    return Model(np.array(weights, np.float32), np.array(biases), prior)


def held_out(doc_id: Column) -> Column:
    return (crc_of_id(doc_id) % 4) == 2


def _feature_rows(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """(slots) of one text for each of these ids, staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(sorted(features(t)), "<i4").tobytes() for t in (text.as_py() for text in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "slots"])

    # about MAX_... ids of 8 bytes each, so the broadcast is bounded
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left_semi")
    rows = rows.mapInArrow(run, "doc_id bigint, slots binary")
    return stage(rows.groupBy("doc_id").agg(F.min("slots").alias("slots")), name)


def _slot_counts(rows: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS, np.int64)
        for batch in batches:
            for slots in batch.column("slots").to_pylist():
                total[np.frombuffer(slots, "<i4")] += 1
        spots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(spots), pa.array(total[spots])], names=["slot", "n"])

    out = np.zeros(DIMENSIONS, np.int64)
    for row in rows.mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["slot"]] = row["n"]
    return out


def _useful_rows(rows: DataFrame, useful: np.ndarray) -> list[np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(slots, "<i4") for slots in batch.column("slots").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[useful[x]].tobytes() for x in found], pa.binary())], names=["doc_id", "slots"])

    held = rows.mapInArrow(run, "doc_id bigint, slots binary").orderBy("doc_id").collect()
    return [np.frombuffer(row["slots"], "<i4").astype(np.int64) for row in held]


def learn(docs: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Train from the labels of ids outside the held-out fold.

    Positives: texts labelled toxic (a doc_id with several labels counts as its largest). Unlabelled: corpus texts
    outside the fold, whatever their label. The class prior is the share of toxic ones among all labelled ids outside
    the fold. Null ids and labels are left out. Without labels the prior is one half of a percent.
    """
    known = labels.where(~held_out(F.col("doc_id"))).where("doc_id is not null and toxic is not null")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    corpus = docs.where(~held_out(F.col("doc_id")))
    positive = _feature_rows(corpus, bounded_sample(known.where("toxic = 1").select("doc_id"), max_positives), "toxic-texts")
    ids = bounded_sample(corpus.select(F.col("doc_id").cast("long").alias("doc_id")), max_unlabelled)
    unlabelled = _feature_rows(corpus, ids, "corpus-texts")
    useful = useful_slots(_slot_counts(positive), _slot_counts(unlabelled), positive.count(), unlabelled.count())
    positive, unlabelled = _useful_rows(positive, useful), _useful_rows(unlabelled, useful)
    return train(positive, unlabelled, min(max(prior or 0.005, 1e-4), 0.9))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for every whole text; null and empty texts get the model's bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(text.as_py() for text in texts))

    return docs.withColumn(name, score(F.col("text")))
