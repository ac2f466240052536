"""Operators of the training-data package against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logtriage.llm import attention, chat, decontaminate, encoding, html_text, licenses, lm_scoring, packing, quality, simhash, token_store, toxicity
from logtriage.llm.common import scratch

SCHEMA = "doc_id long, text string, lang string, score string, _n string"
WORDS = "the quick brown fox jumps over one lazy dog while seven small birds sing in a very tall green tree by our old stone house near that river".split()


def prose(n, seed=0):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


# nulls, empty and long texts, repeated rows and ids, columns whose names clash with results
ROWS = [
    (1, prose(60, 1), "en", "x", "y"),
    (1, prose(60, 1), "en", "x", "y"),
    (2, None, None, None, None),
    (3, "", "en", "", ""),
    (None, prose(40, 2), "en", "x", "y"),
    (4, prose(60, 1), None, "x", "y"),
    (5, prose(30_000, 3), "en", "x", "y"),
    (5, "É ß ½ ²x <|endoftext|> don't\x1c á", "fr", "x", "y"),
    (6, prose(25, 4) + " idiot trash", "en", "x", "y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 0, 1), (6, None, 1), (None, 1, 1), (77, 1, None)], "doc_id long, quality int, toxic int")


def encoded(name, text, end):
    return np.array([*Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing_places_every_piece(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(docs, path).collect()
    want = Counter()
    for doc_id, text, *_ in ROWS:
        ids = encoded("word_bpe_49k.json", text, 1)
        for piece, at in enumerate(range(0, len(ids), 4096)):
            want[doc_id, piece, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(held) == math.ceil(sum(r["length"] for r in rows) / 4096)
    assert packing.pack_documents(empty, path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    histogram = Counter(np.clip(rng.lognormal(6, 1.2, 20_000).astype(int), 1, 4096).tolist())
    runs, bins = packing.plan_sequences(histogram, 4096)
    assert Counter({length: sum(r.end - r.begin for r in runs if r.length == length) for length in histogram}) == histogram
    assert bins <= 1.01 * sum(k * n for k, n in histogram.items()) / 4096 + 1


def test_token_store_round_trip(spark, docs, empty):
    path, tool = scratch(spark, "store"), public_tokenizers.path("byte_bpe_50k.json")
    token_store.write_store(docs, path, tool, shard_ids=50)
    rows = token_store.read_store(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted((r[0] for r in ROWS), key=lambda k: (k is not None, k))
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in rows) == Counter((i, encoded("byte_bpe_50k.json", t, 2).tobytes()) for i, t, *_ in ROWS)
    starts = np.cumsum([0] + [r["n_tokens"] for r in rows])
    assert [r["start"] for r in rows] == starts[:-1].tolist()
    keys = spark.createDataFrame([(1,), (5,), (99,), (None,), (1,)], "doc_id long")
    assert Counter(r["doc_id"] for r in token_store.look_up(keys, path).collect()) == {1: 2, 5: 2}
    other = scratch(spark, "store")
    token_store.write_store(empty, other, tool)
    assert token_store.read_store(spark, other).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_hash_is_perfect_and_minimal(n):
    keys = np.arange(n, dtype=np.int64) * 977 - 5
    seeds, slot, prints = token_store.build_hash(keys)
    assert sorted(slot.tolist()) == list(range(n))
    stored = np.zeros(n, np.uint32)
    stored[slot] = prints
    assert (token_store.find_slots(seeds, stored, keys) == slot).all()
    assert (token_store.find_slots(seeds, stored, keys + 1) == -1).all()


def plain_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), seed=42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(docs, empty):
    rows = simhash.groups(docs).collect()
    prints = {(r[0], r[1]): plain_print(r[1]) for r in ROWS}
    assert Counter((r["doc_id"], r["fingerprint"] % 2**64) for r in rows) == Counter((i, prints[i, t]) for i, t, *_ in ROWS)
    assert all(r["component_id"] == 1 for r in rows if r["doc_id"] in (1, 4))
    assert {r["component_id"] for r in rows if r["doc_id"] in (2, 3)} == {2}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.select("doc_id").collect()) == [0, 1, 2, 5, 5, 6]
    assert simhash.groups(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_links_join_all_pairs_within_four_bits(spark):
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 2**63, 60, dtype=np.uint64).tolist()
    for base in list(prints[:20]):
        for _ in range(6):
            prints.append(base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    prints = sorted(set(prints))
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    for lead in (12, 16):
        links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "print long"), lead=lead).collect()
        got = list(range(len(prints)))
        place = {p: k for k, p in enumerate(signed)}

        def seek(k, got=got):
            while got[k] != k:
                k = got[k]
            return k

        for a, b in links:
            x, y = seek(place[a]), seek(place[b])
            got[max(x, y)] = min(x, y)
        assert [seek(k) for k in range(len(prints))] == [find(k) for k in range(len(prints))]


def test_decontamination_edges(spark, docs, empty):
    items = spark.createDataFrame([("a", prose(60, 1)), ("b", "Idiot, TRASH!"), ("c", None), ("d", "..."), ("b", "Idiot, TRASH!")], "item_id string, text string")
    rows = decontaminate.find_contamination(docs, items).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        if r["doc_id"] in (1, 4):
            assert (r["n_hit"], r["n_items"], r["contaminated"]) == (60, 1, True)
        if r["doc_id"] == 6:
            assert (r["n_hit"], r["items_sha256"], r["contaminated"]) == (2, hashlib.sha256(b"b").hexdigest(), True)
        if r["doc_id"] in (2, 3):
            assert (r["n_words"], r["n_hit"], r["contaminated"]) == (0, 0, False)
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.select("doc_id").collect()) == [0, 2, 3, 5, 5]
    assert decontaminate.find_contamination(empty, items).count() == 0
    assert decontaminate.find_contamination(docs, items.limit(0)).where("contaminated").count() == 0
    blocks = decontaminate.find_passages(spark.read.schema(decontaminate.SHARD).parquet(_index(spark, docs)), items, query_bytes=10)
    assert sorted(map(tuple, decontaminate.judged(blocks).collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def _index(spark, docs):
    path = scratch(spark, "test-index")
    decontaminate.build_index(docs, path, shard_words=100)
    return path


def test_proximity():
    lists = {b"a": np.array([3, 50]), b"b": np.array([5, 51]), b"c": np.array([6, 52])}
    assert decontaminate.match(lists, (b"a", b"b", b"c")).tolist() == [50]
    assert decontaminate.match(lists, (b"a", b"b", b"c"), slop=1).tolist() == [3, 50]


def test_quality_counts(docs, empty, labels):
    for r in quality.quality_rules(docs, labels).collect():
        words, q = [w for w in re.split(r"[\x20\x09-\x0d]+", r["text"] or "") if w], r["_quality"]
        windows = defaultdict(list)
        for i in range(len(words) - 7):
            windows[tuple(words[i : i + 8])].append(i)
        repeat = len({p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)})
        assert (q["n_words"], q["word_chars"], q["n_repeat_words"]) == (len(words), sum(map(len, words)), repeat)
        assert q["base_failed"] == (len(words) < 20 or 100 * repeat > 30 * len(words))
    assert quality.quality_rules(empty, labels).count() == 0
    assert quality.quality_rules(docs, labels.limit(0)).where("_quality.kept").count() == 6


def test_quality_repeats(spark):
    text = prose(30, 7)
    rows = spark.createDataFrame([(1, text + " x y " + text)], "doc_id long, text string")
    assert quality.judged(rows, [0.0] * quality.BUCKETS).first()["_quality"]["n_repeat_words"] == 60


def test_toxicity_learns(spark, docs, empty, labels):
    texts = [(k, prose(40, k) + (" idiot" if k % 5 == 0 else "")) for k in range(400)]
    known = [(k, 1, int(k % 5 == 0)) for k in range(400)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    model = toxicity.learn(table, spark.createDataFrame(known, "doc_id long, quality int, toxic int"))
    rows = toxicity.scored(table, model).where(toxicity.held_out(F.col("doc_id"))).collect()
    assert all((r["score"] >= toxicity.THRESHOLD) == (r["doc_id"] % 5 == 0) for r in rows) and len(rows) > 50
    found = toxicity.scored(docs, toxicity.learn(docs, labels), "_s").collect()
    assert len(found) == len(ROWS) and all(0 <= r["_s"] <= 1 for r in found)
    assert toxicity.scored(empty, toxicity.learn(empty, labels.limit(0))).count() == 0


def test_attention_scores_each_id_once():
    rng = np.random.default_rng(0)
    params, bias = attention.initial(), attention.PairBias(rng.random((attention.IDS, attention.IDS)))
    sequences = [rng.integers(0, attention.IDS, n) for n in (0, 1, 31, 32, 33, 100, 500)]
    logs, begun = attention.token_logs(attention.Scorer(params, bias, 7), sequences, 5)
    assert len(logs) == sum(len(s) + 1 for s in sequences) and (logs < 0).all() and (begun < 0).all()
    owner, begin, first = attention.windows_of(np.array([len(s) + 1 for s in sequences]))
    assert len(owner) == len(begin) == len(first)


def test_attention_scores_equal_plain_windows():
    rng = np.random.default_rng(1)
    params = {name: (rng.standard_normal(shape) * 0.3).astype(np.float32) for name, shape in attention.shapes().items()}
    bias, end = attention.PairBias(rng.random((attention.IDS, attention.IDS))), 5
    sequences = [rng.integers(0, attention.IDS, n) for n in (0, 1, 31, 32, 33, 100)]
    logs, begun = attention.token_logs(attention.Scorer(params, bias, 7), sequences, end)
    want, want_begun, step = [], [], attention.WINDOW - attention.OVERLAP
    for sequence in sequences:
        target, given = np.append(sequence, end), np.append(end, sequence)
        for place in range(len(target)):
            begin = 0 if place < attention.WINDOW else step * (1 + (place - attention.WINDOW) // step)
            row = np.full(attention.WINDOW, end)
            part = given[begin : begin + attention.WINDOW]
            row[: len(part)] = part
            h = attention.attend(params, row[None])[-1][0, place - begin]
            cls, member, log_c, log_m, _, _ = attention.predict(params, bias, h[None], given[place : place + 1], target[place : place + 1])
            want.append(log_c[0, cls[0]] + log_m[0, member[0]])
            want_begun.append(np.log(np.exp(log_c[0, :7]).sum()))
    assert np.allclose(logs, want, atol=1e-4) and np.allclose(begun, want_begun, atol=1e-4)


def test_word_ids_equal_the_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    words = [b"the", b"unbelievable###", "straße".encode(), b"a" * 2000, b"x1,y2", "日本語".encode(), b"don't", b"\x00", b"\xff\xfe", b"q" * 700]
    for some in (words, words[:3], words[3:4], []):
        ids, sizes = encoding.word_ids(path).of(some)
        plain = [encoding.encoder(path).tokenizer.encode(" " + w.decode("utf-8", "replace"), add_special_tokens=False).ids for w in some]
        assert sizes.tolist() == [len(x) for x in plain] and ids.tolist() == [k for x in plain for k in x]


def test_lm_counts(docs, empty):
    rows = lm_scoring.score_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    counts, texts = Counter(), 0
    for doc_id, text, *_ in ROWS:
        if not held(doc_id):
            counts.update(lm_scoring.words_of(text))
            texts += 1
    total = sum(counts.values()) + texts
    want = Counter()
    for doc_id, text, *_ in ROWS:
        words = lm_scoring.words_of(text)
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 2)) for w in words) + math.log10((texts + 1) / (total + len(counts) + 2))
        want[doc_id, held(doc_id), len(words) + 1, sum(counts[w] > 0 for w in words) + 1, total, round(base, 6)] += 1
    assert Counter((r[0], r[1], r[2], r[3], r[4], round(r[5], 6)) for r in rows) == want
    assert all(r["score"] < 0 for r in rows)
    assert lm_scoring.score_documents(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_lm_score_gives_every_training_word_its_share(spark, docs, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    usual = lm_scoring.common_words
    scores = []
    for most in (100_000, 3, 0):
        monkeypatch.setattr(lm_scoring, "common_words", lambda counts, most=most: usual(counts, most))
        scores.append(sorted((r["n_tokens"], r["base_score"], r["score"]) for r in lm_scoring.score_documents(docs, path).collect()))
    assert np.allclose(scores[0], scores[1]) and np.allclose(scores[0], scores[2])


def test_html_cases():
    page = "<body class=has-sidebar><div class=page-header>Site</div><div id=content><h1>T &amp; t</h1><p>One,  two<br>three.<p>More <b>text <ul><li>a<li>b</ul><div class=comments><p>I, too, say, so</div></div><footer>f</footer>"
    assert html_text.extract(page) == "T & t\n\nOne, two three.\n\nMore text\n\na\n\nb"
    assert html_text.extract("<article><p>x</p><form>f</form><aside>s</aside><script>var a='</p>'</script></article>") == "x"
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<p> </p>") == ""
    assert html_text.extract("<div>" * 3000 + "deep") == "deep"


def test_chat_parts(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    rows = [
        (1, 0, "user", [("text", "look <|end|> \\", None, None, None, None, None), ("image", None, "s3://i", 56, 29, None, None)]),
        (1, 1, "assistant", [("text", "a\\|b", None, None, None, None, None), ("audio", None, "s", None, None, 2.0, None), (None, "c", None, None, None, None, None)]),
        (1, 1, "assistant", None),
        (None, None, None, [("document", None, "d", None, None, None, 3)]),
    ]
    found = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()}
    one = found[1]
    assert [a["kind"] for a in one["attachments"]] == ["image", "audio"] and one["attachment_tokens"] == 2 * 2 + 2 + 50
    assert one["loss"] == "a\\|bc" and one["n_turns"] == 3
    assert "".join(s["text"] for s in one["segments"]) == one["formatted"]
    assert one["turns"][0]["text"].startswith("look <|end|> \\<|image:1:6|>")
    assert found[None]["attachment_tokens"] == 1800


def test_licenses(spark, docs, empty):
    text = "Copyright (c) 2020 Someone\n\n" + licenses.KNOWN[0][1].replace("sublicense", "sub-licence").replace("\n", "\n * ").upper()
    rows = spark.createDataFrame([(1, text), (1, text), (2, "hi\nLicenced under the Apache Licence,  version 2.0\nx"), (3, None)], "doc_id long, text string")
    found = sorted(map(tuple, licenses.scan(rows, licenses.known_licenses(spark)).select("doc_id", "license_id", "notices").collect()), key=repr)
    assert found == [(1, "MIT", []), (1, "MIT", []), (2, None, ["Apache-2.0"]), (3, None, [])]
    assert licenses.scan(empty, licenses.known_licenses(spark)).count() == 0
    assert licenses.scan(docs, licenses.known_licenses(spark)).count() == len(ROWS)


def test_license_files_wrapped_as_published(spark):
    isc = """ISC License

Copyright (c) 2004-2010 by Internet Systems Consortium, Inc.

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
    plain = {name: text for name, text in reversed(licenses.KNOWN) if "\n" in text}  # the untitled ones come first

    def wrapped(name, title, notice, before):
        """The text with a line break before one of its words."""
        assert f" {before}" in plain[name]
        return f"{title}\n\n{notice}\n\n" + plain[name].replace(f" {before}", f"\n{before}")

    files = [
        (1, isc),
        (2, wrapped("MIT", "The MIT License (MIT)", "Copyright (c) 2020 A. Person", "COPYRIGHT HOLDERS BE LIABLE")),
        (3, wrapped("MIT", "MIT License", "Copyright [yyyy] [name]", "copyright notice and")),
        (4, wrapped("BSD-3-Clause", "BSD 3-Clause License", "Copyright 2020, A. Person\nAll rights reserved.", "copyright notice, this")),
        (5, wrapped("BSD-2-Clause", "BSD 2-Clause License", "© 2020 A. Person", "COPYRIGHT HOLDER OR")),
        (6, plain["ISC"] + "\nCopyright of all else is not touched."),
    ]
    found = licenses.scan(spark.createDataFrame(files, "doc_id long, text string"), licenses.known_licenses(spark)).collect()
    assert {r["doc_id"]: r["license_id"] for r in found} == {1: "ISC", 2: "MIT", 3: "MIT", 4: "BSD-3-Clause", 5: "BSD-2-Clause", 6: None}
