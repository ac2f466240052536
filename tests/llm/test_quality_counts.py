"""Counts of the quality rules against a plain evaluation."""

import random
import re

from pyspark.sql import functions as F

from logtriage.llm.quality import BUCKETS, REPEAT_WINDOW, judged


def plain(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    runs = [tuple(words[n : n + REPEAT_WINDOW]) for n in range(len(words) - REPEAT_WINDOW + 1)]
    inside = {n + k for n, run in enumerate(runs) if runs.count(run) > 1 for k in range(REPEAT_WINDOW)}
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_counts_equal_plain_evaluation_and_no_window_is_cut_from_words(spark):
    rng = random.Random(4)
    texts = ["", " \t\n", "a " * 40, "a b c d e f g h " * 3, "é b #*$%&|<>\n \n\x0b\nx\nx\n"]
    texts += ["".join(rng.choices(["a", "bé", "c ", " ", "\n", "\t", "x y z ", "one two three four five six seven eight ", "$"], k=rng.randint(1, 60))) for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    found = judged(rows, [0.0] * BUCKETS)
    assert "xxhash64(slice(" not in found._jdf.queryExecution().analyzed().toString()
    names = [F.col(f"_quality.{name}") for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    assert {r[0]: tuple(r[1:]) for r in found.select("n", *names).collect()} == {n: plain(text) for n, text in enumerate(texts)}
