"""Training of the attention weights: every id of every training text is a target once."""

from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from logtriage.llm import attention, lm_scoring


def targets(texts, rounds, most):
    found = Counter()
    for turn in range(rounds):
        rows = iter([pa.RecordBatch.from_arrays([pa.array([np.array(t, "<i2").tobytes() for t in texts], pa.binary())], names=["ids"])])
        for ids, sizes in lm_scoring._windows(rows, 0, turn, rounds, most):
            for row, size in zip(ids.tolist(), sizes.tolist()):
                found.update(zip(row[:size], row[1 : size + 1]))
    return found


@pytest.mark.parametrize("rounds,most", [(1, 1), (3, 2), (3, 1000)])
def test_all_rounds_together_are_one_pass_over_every_id(rounds, most):
    texts = [list(range(a, a + n)) for a, n in ((1, 2), (1000, 33), (2000, 34), (3000, 500), (5000, 3))]
    assert targets(texts, rounds, most) == Counter(pair for t in texts for pair in zip(t, t[1:]))


def test_training_ids_are_whole_texts(spark):
    texts = ["one two " * 400, "", None, "three"]
    train = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = lm_scoring.word_counts(train)
    subwords = lm_scoring.reduced_vocabulary(counts, public_tokenizers.path("byte_bpe_50k.json"))
    rows = lm_scoring.training_ids(train, subwords).collect()
    want = Counter()
    for text in texts:
        words = lm_scoring.words_of(text)
        ids = subwords.of(words)[0].tolist() if words else []
        want[tuple([subwords.end, *ids, subwords.end]), attention.n_windows(len(ids) + 1)] += 1
    assert Counter((tuple(np.frombuffer(r["ids"], "<i2").tolist()), r["windows"]) for r in rows) == want


def test_gradients_equal_differences_of_the_loss():
    rng = np.random.default_rng(1)
    params = {name: (rng.standard_normal(shape) * 0.3).astype(np.float64) for name, shape in attention.shapes().items()}
    bias = attention.PairBias(rng.random((attention.IDS, attention.IDS)))
    windows = rng.integers(0, attention.IDS, (3, attention.WINDOW + 1))
    real = np.arange(attention.WINDOW) < np.array([[32], [5], [17]])
    loss = lambda: attention.gradients(params, bias, windows[:, :-1], windows[:, 1:], real)[0]
    _, found = attention.gradients(params, bias, windows[:, :-1], windows[:, 1:], real)
    for name, grad in found.items():
        spot = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        at = params[name][spot]
        params[name][spot] = at + 1e-2
        more = loss()
        params[name][spot] = at - 1e-2
        less = loss()
        params[name][spot] = at
        assert abs((more - less) / 2e-2 - grad[spot]) < 0.05 * abs(grad[spot])
