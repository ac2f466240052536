"""Texts encoded by their distinct parts, against the tokenizer on each whole text."""

import random

import numpy as np
import public_tokenizers

from logtriage.llm import encoding

PIECES = [" ", "  ", "\n", "\t", " \n", " ", "　", "a", "Ab", "é", "é", "'s", "don't", "12", "3.5", "...", "日本語", "\U0001f600", "\x00q", "\x85", "\x1c", "﻿", "​", "<|endoftext|>", "x" * 250, " ,", ". "]


def test_parts_give_the_ids_of_whole_texts():
    words = encoding.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    texts = ["", " ", "one", " one two", "two  three ", *("".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(3000))]
    plain = [np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() for text in texts]
    assert encoding.text_encoder(public_tokenizers.path("byte_bpe_50k.json")).encode_many(texts) == plain


def test_each_distinct_part_is_encoded_once(monkeypatch):
    parts = encoding.text_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    sent, encode = [], parts.encode
    monkeypatch.setattr(parts, "encode", lambda texts, **more: (sent.extend(texts), encode(texts, **more))[1])
    assert len(parts.encode_many(["start one, two. one, two."] * 500)) == 500
    assert sorted(sent) == sorted(["start"] * 500 + [" start one two", "", ",", "."])
