"""Toxicity scores take texts one at a time."""

import numpy as np

from logtriage.llm import toxicity


def test_scores_hold_one_text_at_a_time():
    rng = np.random.default_rng(0)
    model = toxicity.Model(rng.standard_normal((3, toxicity.DIMENSIONS)).astype(np.float32), np.zeros(3), 0.1)
    texts = ["some words", None, "", "other words here"]
    assert model.scores(iter(texts)).tolist() == [model.scores([text])[0] for text in texts]
    assert model.scores(iter([])).tolist() == []
