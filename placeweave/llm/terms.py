"""Terms of texts, found in bytes: maximal runs of ASCII letters and digits and of all other characters beyond ASCII.

Only A-Z are lowered. In UTF-8 every byte of a character beyond ASCII is above 0x7F, so runs of bytes are runs of
characters, and whole batches of texts are split at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from placeweave.llm.ngram_join import _tables

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_TERM = np.array([48 <= c <= 57 or 97 <= c <= 122 or c > 127 for c in range(256)])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null text is empty."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def stretches(texts: list[bytes], most_texts: int, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most most_texts texts and about most_bytes bytes; one text is never divided."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and (i - first == most_texts or size + len(text) > most_bytes):
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def find_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' lowered bytes in one array, start and end of every term there, and how many terms each text has."""
    data = np.frombuffer(b" ".join(texts).translate(_LOWER), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _TERM[data], [False]])))
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.empty(0, np.int64)
    return data, start, end, np.diff(np.searchsorted(start, ends), prepend=0)


def as_strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The terms as one Arrow array, without a Python object for each."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] = 1
    inside[end] -= 1
    kept = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(kept))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each term: a polynomial of its bytes, from differences of running sums."""
    byte, power, inverse = _tables(1 << max(20, (len(data) + 1).bit_length()))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(byte[data] * power[: len(data)], dtype=np.uint64)])
    h = (sums[end] - sums[start]) * inverse[start]
    h ^= h >> np.uint64(32)
    return h * _MIX
