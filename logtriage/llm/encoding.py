"""Public tokenizers applied to many texts: equal results to encoding each text whole, but most words come from a cache."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# Patterns by which the two public vocabularies cut texts into words (fixed values); letters and digits stand for their classes.
_WORDS_ENDED = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_WORDS_BEGUN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# The same for texts of ASCII characters only, where the plain module is faster.
_ASCII_ENDED = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+")
_ASCII_BEGUN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
# The second vocabulary begins a word at every space before something visible, whatever stands around it: parts between such places
# are encoded by themselves. Texts with other spaces are cut by the second pattern.
_GLUED = re.compile(r" (?=\s|$)")
_PART = re.compile(r" (?=\S)")
# A part's letters before an ASCII character that is no letter are a word of their own (ranges whose characters are letters everywhere).
_WORD_AND_TAIL = r"(?s)^(?P<word>[A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ԯ]+)(?P<tail>[\x00-\x40\x5b-\x60\x7b-\x7f].*)$"
# Texts with these are encoded whole: strings of special tokens, characters that two libraries may class or lower differently.
_UNSURE = re.compile("<\\||[\x1c-\x1f\x85᠎​﻿Σ\U00010000-\U0010ffff]")
# Texts whose white space two libraries may tell apart differently.
_UNSURE_SPACES = re.compile("<\\||[\x1c-\x1f\x85᠎​﻿]")


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    A tokenizer treats the words of a text one by one, so their ids can be kept. Unknown words are
    encoded many at a time and cut apart at the tokens that begin or end a word; a batch that does
    not come apart as expected is encoded word by word. `limit` bounds the words kept.
    """

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.limit = limit
        self.words: dict[str, bytes] = {}
        self.marks = np.zeros(self.size, bool)
        vocabulary = self.tokenizer.get_vocab()
        self.by_end = any(token.endswith("</w>") for token in vocabulary)
        for token, number in vocabulary.items():
            self.marks[number] = token.endswith("</w>") if self.by_end else token.startswith("Ġ")
        self.find = (_WORDS_ENDED if self.by_end else _WORDS_BEGUN).findall
        self.find_ascii = (_ASCII_ENDED if self.by_end else _ASCII_BEGUN).findall

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        joined = (" " if self.by_end else "").join(words)
        raw = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.marks[raw])
        cuts = np.append(0, cuts + 1) if self.by_end else np.append(cuts, len(raw))
        if len(cuts) != len(words) + 1 or cuts[0] or cuts[-1] != len(raw):
            self._alone(words)
            return
        held, at = raw.tobytes(), (cuts * 4).tolist()
        self.words.update(zip(words, [held[a:b] for a, b in zip(at, at[1:])]))

    def _alone(self, words: list[str]) -> None:
        for word, found in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            self.words[word] = np.array(found.ids, "<u4").tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > self.limit:
            self.words.clear()
        out: list[bytes | None] = [None] * len(texts)
        cut = []
        fresh: set[str] = set()
        for n, text in enumerate(texts):
            if _UNSURE.search(text):
                out[n] = self._plain(text)
                continue
            plain = text.isascii()
            if self.by_end:  # this vocabulary composes characters and drops case
                text = text.lower() if plain else unicodedata.normalize("NFC", text).lower()
            words = self.find_ascii(text) if plain else self.find(text)
            cut.append((n, words))
            fresh.update(words)
        fresh.difference_update(self.words)
        regular, others = [], []
        for word in fresh:
            body = word if self.by_end else word[1:]
            (regular if body.isalpha() and len(body) < 200 and (self.by_end or word[0] == " ") else others).append(word)
        for at in range(0, len(regular), 256):
            self._learn(regular[at : at + 256])
        for at in range(0, len(others), 4096):
            self._alone(others[at : at + 4096])
        get = self.words.__getitem__
        for n, words in cut:
            out[n] = b"".join(map(get, words))
        return out


class PartEncoder:
    """Ids of many texts given at once, as little-endian unsigned 32-bit bytes.

    Texts are cut at spaces. The distinct words that begin the parts between spaces are encoded together, what follows in a
    part likewise, and the ids are laid out from there, so nothing is kept between calls. Parts that are not plain words, and
    the first part of a text where words begin with the space before them, are encoded one by one.
    """

    AT_ONCE = 256

    def __init__(self, words: WordEncoder):
        self.encode, self.plain, self.marks, self.size = words.tokenizer.encode_batch_fast, words._plain, words.marks, words.size
        self.by_end = words.by_end

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, np.uint32) for found in self.encode(texts, add_special_tokens=False)] if texts else []

    def _plain_words(self, words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of words in the middle of a text, laid end to end, and how many each has."""
        before = "" if self.by_end else " "
        ids, sizes = [], []
        for at in range(0, len(words), self.AT_ONCE):
            some = words[at : at + self.AT_ONCE]
            found = self._alone([before + " ".join(some)])[0]
            marked = np.flatnonzero(self.marks[found])
            cuts = np.append(0, marked + 1) if self.by_end else np.append(marked, len(found))
            if len(cuts) == len(some) + 1 and not cuts[0] and cuts[-1] == len(found):
                ids.append(found)
                sizes.append(np.diff(cuts))
            else:
                single = self._alone([before + word for word in some])
                ids += single
                sizes.append(np.array([len(x) for x in single]))
        return ids, np.concatenate([*sizes, np.zeros(0, np.int64)])

    def _cut(self, texts: list[str], out: list) -> tuple[list[int], np.ndarray, pa.Array]:
        """Which texts are cut into parts, how many each has, and all parts. Texts that cannot be cut are encoded here."""
        cut, glued, held = [], [], []
        for n, text in enumerate(texts):
            if (_UNSURE if self.by_end else _UNSURE_SPACES).search(text):
                out[n] = self.plain(text)
            elif self.by_end:  # this vocabulary composes characters and drops case
                cut.append(n)
                held.append(text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower())
            elif _GLUED.search(text):
                glued.append(n)
            else:
                cut.append(n)
                held.append(text)
        held = pa.array(held, pa.large_string())
        lists = [pc.utf8_split_whitespace(held) if self.by_end else pc.split_pattern(held, " "), pa.array([_PART.split(texts[n]) for n in glued], pa.large_list(pa.large_string()))]
        sizes = np.concatenate([pc.list_value_length(some).to_numpy() for some in lists]).astype(np.int64)
        return cut + glued, sizes, pa.concat_arrays([some.flatten() for some in lists])

    def encode_many(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        cut, sizes, every = self._cut(texts, out)
        if not cut:
            return out
        first = np.cumsum(sizes) - sizes
        begins = [] if self.by_end else self._alone(every.take(pa.array(first)).to_pylist())
        coded = every.dictionary_encode()
        found = pc.extract_regex(coded.dictionary, _WORD_AND_TAIL)
        tailed = found.is_valid()
        words = pc.if_else(tailed, found.field("word"), coded.dictionary).dictionary_encode()
        tails = pc.if_else(tailed, found.field("tail"), "").dictionary_encode()
        listed = words.dictionary.to_pylist()
        regular = np.array([len(w) < 200 and (w.isalpha() if self.by_end else " " not in w) for w in listed], bool)
        ids, length = self._plain_words(list(compress(listed, regular)))
        before = "" if self.by_end else " "
        others = [before + word for word in compress(listed, ~regular)]
        # ids of words, then of tails, then of what texts begin with; each occurrence of a part is a word and a tail
        others = [*self._alone(others), *self._alone(tails.dictionary.to_pylist()), *begins]
        length = np.concatenate([length, np.array([len(x) for x in others], np.int64)])
        place = np.cumsum(length) - length
        ids = np.concatenate([*ids, *others])
        n_words, n_tails = len(listed), len(tails.dictionary)
        numbers = np.empty(n_words, np.int64)
        numbers[np.append(np.flatnonzero(regular), np.flatnonzero(~regular))] = np.arange(n_words)
        pairs = np.column_stack([numbers[words.indices.to_numpy()], tails.indices.to_numpy() + n_words])[coded.indices.to_numpy()]
        if not self.by_end:
            pairs[first, 0] = n_words + n_tails + np.arange(len(first))
        pairs = pairs.ravel()
        place, length = place[pairs], length[pairs]
        if not self.by_end:
            length[2 * first + 1] = 0
        upto = np.cumsum(length)
        places = np.repeat(place - (upto - length), length)
        places += np.arange(len(places))
        held = ids[places].tobytes()
        ends = (4 * upto[2 * (first + sizes) - 1]).tolist()
        for n, a, b in zip(cut, [0, *ends], ends):
            out[n] = held[a:b]
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def text_encoder(path: str) -> PartEncoder:
    """The encoder for many whole texts."""
    return PartEncoder(encoder(path))


def text_groups(batch: pa.RecordBatch, size: int) -> Iterator[tuple[slice, list[str]]]:
    """Places of a batch's rows, and their texts (null: empty), that hold about so many characters together, at least one text each."""
    column = batch.column("text")
    begin, held, texts = 0, 0, []
    for n, text in enumerate(column):
        texts.append(text.as_py() or "")
        held += len(texts[-1])
        if held >= size or n + 1 == len(column):
            yield slice(begin, n + 1), texts
            begin, held, texts = n + 1, 0, []


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one letter: itself where it is printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {**{chr(b): b for b in printable}, **{chr(256 + n): b for n, b in enumerate(others)}}


class WordIds:
    """Ids of single words, each behind one space, by a byte-level vocabulary whose ids follow the order of its merges.

    Meant for many words that occur once: they are encoded together, and cut apart by the lengths of their bytes.
    """

    LONGEST = 500  # longer words go to the tokenizer itself, whose merging stays fast on them

    def __init__(self, path: str):
        import tiktoken

        letters = _bytes_of_letters()
        self.path = path
        tool = encoder(path)
        names = {token: number for token, number in tool.tokenizer.get_vocab().items() if all(c in letters for c in token)}
        ranks = {bytes(letters[c] for c in token): number for token, number in names.items()}
        self.width = np.zeros(tool.size, np.int64)
        for token, number in ranks.items():
            self.width[number] = len(token)
        self.encoding = tiktoken.Encoding("words", pat_str=r" ?[^ ]+| ", mergeable_ranks=ranks, special_tokens={})

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words laid end to end, and how many each word has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        if len(words) and sizes.max() <= self.LONGEST:
            try:
                return self._cut(b" ".join([b"", *words]).decode(), sizes)
            except UnicodeDecodeError:
                pass
        texts = [" " + word.decode("utf-8", "replace") for word in words]
        long = [n for n, text in enumerate(texts) if len(text) > self.LONGEST]
        if long:
            return self._with_long(words, texts, long)
        return self._cut("".join(texts), np.array([len(text.encode()) for text in texts], np.int64))

    def _cut(self, joined: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words laid end to end, each behind its space, and how many each has, from their sizes in bytes."""
        ids = np.array(self.encoding.encode_ordinary(joined), np.int64)
        upto = np.cumsum(sizes)
        ends = np.searchsorted(np.cumsum(self.width[ids]), upto) + 1 if len(ids) else np.zeros(0, np.int64)
        return ids, np.diff(ends, prepend=0)

    def _with_long(self, words: list[bytes], texts: list[str], long: list[int]) -> tuple[np.ndarray, np.ndarray]:
        chosen = set(long)
        ids, sizes = self.of([word for n, word in enumerate(words) if n not in chosen])
        short = iter(np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else [])
        alone = dict(zip(long, encoder(self.path).encode_many([texts[n] for n in long])))
        parts = [np.frombuffer(alone[n], "<u4").astype(np.int64) if n in chosen else next(short) for n in range(len(words))]
        return np.concatenate(parts), np.array([len(part) for part in parts], np.int64)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
