"""Words of many texts taken together, and training steps that use their memory again."""

from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa

from logtriage.llm import attention, encoding, lm_scoring

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["two words", None, "", " \t\n", "\x0bA É\x1cz\x85q ab\r\nÀb ", "x" * 700, "a a A", "\x00 \x7f 中文 ß"]


def test_words_of_many_texts_equal_those_of_each():
    held = pa.array(["left out", *TEXTS, "left out"], pa.string())
    sizes, words = lm_scoring._words(held.slice(1, len(TEXTS)))
    want = [lm_scoring.words_of(text) for text in TEXTS]
    assert sizes.tolist() == [len(some) for some in want]
    assert words.to_pylist() == [word for some in want for word in some]
    sizes, words = lm_scoring._words(pa.array([None, " "], pa.string()))
    assert sizes.tolist() == [0, 0] and len(words) == 0


def test_groups_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS, pa.string()), pa.array(range(len(TEXTS)))], names=["text", "n"])
    for most in (1, 12, 10_000):
        groups = list(lm_scoring._groups(batch, most))
        assert [n for some in groups for n in some.column("n").to_pylist()] == list(range(len(TEXTS)))
        assert all(len(some) == 1 or sum(len((t or "").encode()) for t in some.column("text").to_pylist()) <= most for some in groups)
    assert not list(lm_scoring._groups(batch.slice(0, 0), 5))


def test_word_counts_of_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "COUNTED_AT_ONCE", 4)
    rows = lm_scoring.word_counts(spark.createDataFrame([(text,) for text in TEXTS * 3], "text string")).collect()
    want = Counter(word for text in TEXTS * 3 for word in lm_scoring.words_of(text))
    assert {bytes(r["word"]): r["n"] for r in rows} == want and len(rows) == len(want)


def test_word_ids_do_not_depend_on_the_words_beside():
    tool = encoding.WordIds(PATH)
    words = [b"plain", "é中".encode(), b"a" * 499, b"b" * 500, b"c" * 900, b"\xff\xc3", b"z"]
    for some in (words, words[:3], words[5:], []):
        ids, sizes = tool.of(some)
        alone = [tool.of([word])[0].tolist() for word in some]
        assert sizes.tolist() == [len(one) for one in alone] and ids.tolist() == [n for one in alone for n in one]


def test_numbers_stay_right_when_words_are_forgotten():
    size = encoding.encoder(PATH).size
    subwords = lm_scoring.Subwords(PATH, [np.array([n % 1000], "<i2").tobytes() for n in range(size)], 7, 4)
    known = lm_scoring.Lexicon(subwords, {b"two": 5}, most=2)
    for text in ("two words two", "three more words", "two", "words of two"):
        words = lm_scoring.words_of(text)
        number, coded = known.all_numbers(pa.array(words, pa.binary()))
        assert [known.words[n] for n in number] == words == coded.to_pylist()
        assert known.counts[number].tolist() == [5 * (word == b"two") for word in words]
        assert known.sequence(number).tolist() == subwords.of(words)[0].tolist()


def test_gradients_are_the_same_in_memory_used_before():
    rng = np.random.default_rng(3)
    params = {name: (rng.standard_normal(shape) * 0.3).astype(np.float32) for name, shape in attention.shapes().items()}
    bias, room = attention.PairBias(rng.random((attention.IDS, attention.IDS))), attention.Room()
    for n in (5, 9, 1, 9):
        windows = rng.integers(0, attention.IDS, (n, attention.WINDOW + 1))
        real = np.arange(attention.WINDOW) < rng.integers(1, attention.WINDOW + 1, n)[:, None]
        _, want = attention.gradients(params, bias, windows[:, :-1], windows[:, 1:], real)
        _, found = attention.gradients(params, bias, windows[:, :-1], windows[:, 1:], real, room)
        assert all((found[name] == want[name]).all() for name in params)


def test_a_fitter_moves_its_own_weights_only():
    rng = np.random.default_rng(4)
    bias, start = attention.PairBias(rng.random((attention.IDS, attention.IDS))), attention.initial()
    windows = rng.integers(0, attention.IDS, (300, attention.WINDOW + 1))
    fitter = attention.Fitter(start, bias, 3)
    fitter.take(windows, np.full(300, attention.WINDOW), seed=1)
    assert (attention.pack(fitter.params) == fitter.flat).all() and not (fitter.flat == attention.pack(start)).all()
    assert (attention.pack(attention.initial()) == attention.pack(start)).all()
