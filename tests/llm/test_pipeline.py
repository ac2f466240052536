"""The document pipeline: what each stage keeps, and that it leaves the other columns alone."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash

import corpus_pipeline

SF_DIR = "/root/testdata/sf0.001"
CLASHING = ["_quality", "_toxicity", "_n", "_key", "_name", "_doc", "kept", "root", "print", "score"]


def plain_fingerprint(text):
    words = text.lower().split()
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    rng = np.random.default_rng(5)
    texts = ["", " ", None]
    for _ in range(30):
        words = [f"w{k}" for k in rng.integers(0, 10**6, 150)]
        texts.append(" ".join(words))
        for _ in range(3):
            at = int(rng.integers(0, 148))
            texts.append(" ".join(words[:at] + [f"x{at}"] + words[at + 1 :]))
    prints = [plain_fingerprint(t or "") for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert 10 < len(set(root)) < len(texts) - 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


@pytest.mark.parametrize("name, function", corpus_pipeline.STAGES[:-1])
def test_stages_leave_columns_with_clashing_names(spark, name, function):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = {r["doc_id"]: tuple(r) for r in docs.collect()}
    wide = docs.selectExpr("*", *(f"concat('{c}', doc_id) AS {c}" for c in CLASHING))
    kept = function(spark, wide, SF_DIR)
    assert kept.dtypes == wide.dtypes
    found = kept.collect()
    assert 0 < len(found) <= len(rows)
    for r in found:
        assert tuple(r) == (*rows[r["doc_id"]], *(f"{c}{r['doc_id']}" for c in CLASHING))


def test_stages_take_null_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string, _key string"
    rows = [(None, None, "a"), (1, "", None), (2, None, "b"), (3, "one two three " * 40, None), (3, "one two three " * 40, None)]
    for name, function in corpus_pipeline.STAGES[:-1]:
        for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
            kept = function(spark, docs, SF_DIR)
            assert kept.schema == docs.schema and kept.count() <= docs.count()


def test_pipeline_stages_work_on_what_is_left(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen = {r["doc_id"] for r in docs.collect()}
    for _, function in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(function(spark, docs, SF_DIR), "test-stage")
        left = {r["doc_id"] for r in docs.collect()}
        assert left <= seen
        seen = left
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert {r["doc_id"] for r in rows} == seen and seen
