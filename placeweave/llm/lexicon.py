"""A worker's memory of words already encoded, so that each batch encodes only words not met before."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept in one worker; beyond it the memory starts anew, which changes cost but no result.
MOST_WORDS = 800_000
#: Characters of text handled at once.
CHUNK_CHARS = 1_000_000


class Lexicon:
    """Token ids of words, held flat: word number -> slice of ids."""

    def __init__(self, encode_words: Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]]) -> None:
        self.encode_words = encode_words  # words -> flat ids, length of each
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.start = np.empty(0, np.int64)
        self.length = np.empty(0, np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers, for start and length, until the next call."""
        known = self.number
        if new := list({w for w in words if w not in known}):
            if len(known) + len(new) > MOST_WORDS:
                self.clear()
                new = list(set(words))
            gc.disable()  # lists by the hundred thousand, none of them in a cycle
            try:
                ids, lengths = self.encode_words(new)
            finally:
                gc.enable()
            base, n = len(self.flat), len(self.number)
            self.number.update(zip(new, range(n, n + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
            self.start = np.concatenate([self.start, base + np.cumsum(lengths) - lengths])
            self.length = np.concatenate([self.length, lengths])
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of words and how many each word has."""
        at = self.numbers(words)
        lengths = self.length[at]
        return self.flat[spread(self.start[at], lengths)], lengths


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0], start[0]+1, ... (length[0] of them), start[1], ..."""
    end = np.cumsum(length)
    total = int(end[-1]) if len(end) else 0
    kind = np.int32 if total < 1 << 31 and (not len(start) or int(start.max()) < 1 << 30) else np.int64
    out = np.repeat((start - (end - length)).astype(kind), length)
    out += np.arange(total, dtype=kind)
    return out


def chunks(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about CHUNK_CHARS characters each."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK_CHARS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def encode_texts(texts: Sequence[str], split: Callable[[str], list[str]], lexicon: Lexicon) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Flat ids of the texts and how many each text has, some texts at a time."""
    for a, b in chunks(texts):
        split_texts = [split(t) for t in texts[a:b]]
        ids, lengths = lexicon.encode([w for ws in split_texts for w in ws])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        upto = np.concatenate([[0], np.cumsum([len(ws) for ws in split_texts])]).astype(np.int64)
        yield ids, np.diff(ends[upto])


#: Bytes of text split at once.
SPLIT_BYTES = 8_000_000
#: Letters that lower-casing and canonical composition treat one by one, and marks that end a word as one run.
LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(192, 215), *range(216, 247), *range(248, 256)]))
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+" + r"[!-&(-/:-@\[-`{-~]*$"


def encode_split(texts: pa.Array, letters: Lexicon, others: Lexicon, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Flat ids of texts split at ASCII white space, end_id after each text, and how many each has, some texts at a time.

    Arrow splits and numbers the words and parts letters from the marks behind them, so Python sees each distinct run of
    letters, run of marks and other word once for a stretch of texts.
    """
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // SPLIT_BYTES
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)] if len(texts) else []
    for a, b in pairwise(edges):
        lists = pc.ascii_split_whitespace(texts.slice(a, b - a))
        coded = lists.flatten().dictionary_encode()
        ids, lengths = _encode_distinct(coded.dictionary, letters, others)
        ids, lengths = np.append(ids, np.int32(end_id)), np.append(lengths, 1)
        start = np.cumsum(lengths) - lengths
        per_text = lists.value_lengths().to_numpy()
        at = np.insert(coded.indices.to_numpy(), np.cumsum(per_text), len(lengths) - 1)
        of_word = lengths[at]
        ends = np.cumsum(of_word)[np.cumsum(per_text + 1) - 1]
        yield ids[spread(start[at], of_word)], np.diff(ends, prepend=0)


def _encode_distinct(words: pa.Array, letters: Lexicon, others: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of distinct words and how many each has: letters, then marks, or the whole word by others."""
    plain = pc.match_substring_regex(words, _PLAIN)
    run = words.filter(plain)
    core = pc.utf8_lower(pc.utf8_rtrim(run, MARKS)).dictionary_encode()
    tail = pc.utf8_ltrim(run, LETTERS).dictionary_encode()
    rest = words.filter(pc.invert(plain)).to_pylist()
    first = letters.numbers(core.dictionary.to_pylist())[core.indices.to_numpy()]
    numbers = others.numbers(tail.dictionary.to_pylist() + rest)
    last = numbers[: len(tail.dictionary)][tail.indices.to_numpy()]
    # Two parts a word, the first of them empty for a word by others.
    is_plain = plain.to_numpy(zero_copy_only=False)
    start, length = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
    start[is_plain, 0], length[is_plain, 0] = letters.start[first], letters.length[first]
    second = np.empty(len(words), np.int64)
    second[is_plain], second[~is_plain] = last, numbers[len(tail.dictionary) :]
    start[:, 1], length[:, 1] = others.start[second] + len(letters.flat), others.length[second]
    both = np.concatenate([letters.flat, others.flat])
    return both[spread(start.ravel(), length.ravel())], length.sum(axis=1)
