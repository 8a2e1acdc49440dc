"""SentencePiece BPE with byte fallback, by vectorised merge rounds.

A text becomes words (spaces turn into U+2581, which begins a word); no piece reaches over the start of a word. The
symbols of all new words of a batch lie in one flat array. Each round finds the pair of best rank in every word
(segmented minimum), merges its occurrences from the left at the same time, and compacts the array, until no pair of
the vocabulary is left. Where a merge makes a pair that is at least as good, the word stops after that merge in this
round, so the outcome is the same as merging one pair at a time. Characters outside the vocabulary become bytes.

Defined results: a null or empty text has no ids and decodes to the empty text; literal U+2581 is a space, as in the
library; rows are never merged, and other columns are left alone (the functions make column expressions).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from placeweave.llm.lexicon import Lexicon, encode_texts, spread

SPACE = "▁"
NO_RANK = np.int64(1) << 40
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class PieceModel:
    """The tables of a model: character and pair numbers, ranks, ids and bytes of pieces."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.vocab_size()
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        pieces = {lib.id_to_piece(i): i for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece of this model reaches over the start of a word")
        self.n = n
        self.byte_id = np.zeros(256, np.int32)
        raw = [b""] * n
        for i in range(n):
            if lib.is_byte(i):
                code = int(lib.id_to_piece(i)[3:5], 16)
                self.byte_id[code], raw[i] = i, bytes([code])
            elif not lib.is_control(i):
                raw[i] = lib.id_to_piece(i).replace(SPACE, " ").encode()
        self.raw_len = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        # Symbols: piece ids, then numbers for characters that only occur inside longer pieces.
        self.symbol = dict(pieces)
        for c in sorted({c for p in pieces for c in p} - pieces.keys()):
            self.symbol[c] = n + len(self.symbol)
        scores = sorted({lib.get_score(i) for i in plain}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        pairs = {}
        for p, i in pieces.items():
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (i, rank_of[lib.get_score(i)])
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair = keys[order]
        self.made = np.array([v[0] for v in pairs.values()], np.int64)[order]
        self.rank = np.array([v[1] for v in pairs.values()], np.int64)[order]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NO_RANK: none) and merged symbol of pairs."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], NO_RANK), self.made[at]

    def _next_pairs(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of the pairs that begin at the given places."""
        after = np.minimum(at + 1, len(sym) - 1)
        rank, made = self.look_up(sym[at], sym[after])
        rank[(after == at) | (word[at] != word[after])] = NO_RANK
        return rank, made

    def merge_words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat piece ids of words and how many each has."""
        text = "".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars, at = np.unique(code, return_inverse=True)
        # A character without a number gets a negative one: -1 - its place in chars.
        number = np.array([self.symbol.get(chr(c), -1 - k) for k, c in enumerate(chars)], np.int64)
        sym, word = (number[at] if len(chars) else np.empty(0, np.int64)), np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word = [], []
        rank, made = self._next_pairs(sym, word, np.arange(len(sym)))
        while len(sym):
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best_of = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(sym))))
            ended = best_of == NO_RANK
            if ended.any():
                done_sym.append(sym[ended])
                done_word.append(word[ended])
                keep = ~ended
                sym, word, rank, made, best_of = (x[keep] for x in (sym, word, rank, made, best_of))
                if not len(sym):
                    break
            take = _from_left(rank == best_of)
            take = self._stop_early(sym, word, made, take, best_of)
            sym = np.where(take, made, sym)
            keep = ~np.append(False, take[:-1])
            sym, word, rank, made, take = sym[keep], word[keep], rank[keep], made[keep], take[keep]
            changed = np.flatnonzero(take | np.append(take[1:], False))  # a merged symbol, and the one before it
            rank[changed], made[changed] = self._next_pairs(sym, word, changed)
        if not done_sym:
            return np.empty(0, np.int64), sizes
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        return self._to_ids(sym, word, chars, len(words))

    def _stop_early(self, sym, word, made, take, best_of) -> np.ndarray:
        """Keep, in each word, the merges up to the first that makes a pair at least as good as the one merged."""
        at = np.flatnonzero(take)
        prev_sym = np.where((at > 0) & (word[at - 1] == word[at]), sym[at - 1], -(1 << 20))
        # The symbol to the left may itself just have been merged.
        left_taken = (at > 1) & take[np.maximum(at - 2, 0)] & (word[np.maximum(at - 2, 0)] == word[at])
        prev_sym = np.where(left_taken, made[np.maximum(at - 2, 0)], prev_sym)
        after = at + 2
        inside = (after < len(sym)) & (word[np.minimum(after, len(sym) - 1)] == word[at])
        next_sym = np.where(inside, sym[np.minimum(after, len(sym) - 1)], -(1 << 20))
        better = (self.look_up(prev_sym, made[at])[0] <= best_of[at]) | (self.look_up(made[at], next_sym)[0] <= best_of[at])
        if better.any():
            group = word[at]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            seen = np.cumsum(better) - better  # better merges before this one
            base = np.repeat(seen[first], np.diff(np.append(first, len(group))))
            take[at[seen > base]] = False
        return take

    def _to_ids(self, sym, word, chars, n_words) -> tuple[np.ndarray, np.ndarray]:
        """Replace symbols that are no pieces by the ids of their bytes."""
        loose = (sym < 0) | (sym >= self.n)
        if not loose.any():
            return sym, np.bincount(word, minlength=n_words)
        back = {v: k for k, v in self.symbol.items() if v >= self.n}
        raw = {s: chr(chars[-1 - s]) if s < 0 else back[s] for s in np.unique(sym[loose]).tolist()}
        as_bytes = {s: self.byte_id[np.frombuffer(c.encode("utf-8", "surrogatepass"), np.uint8)] for s, c in raw.items()}
        width = np.ones(len(sym), np.int64)
        where = np.flatnonzero(loose)
        parts = [as_bytes[s] for s in sym[where].tolist()]
        width[where] = [len(p) for p in parts]
        ids = np.repeat(sym, width)
        starts = np.cumsum(width) - width
        ids[spread(starts[where], width[where])] = np.concatenate(parts)
        return ids, np.bincount(word, weights=width, minlength=n_words).astype(np.int64)

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The texts of id lists that lie one after another in ids."""
        size = self.raw_len[ids]
        data = self.raw[spread(self.raw_at[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(lengths)])]
        out = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return [t[1:] if t.startswith(" ") else t for t in out]


def split_words(text: str) -> list[str]:
    """The words of a text as the model sees it: with a space in front."""
    return _WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []


def _from_left(hit: np.ndarray) -> np.ndarray:
    """Of each run of overlapping pairs keep the first, third, ... (a pair takes two symbols)."""
    at = np.flatnonzero(hit)
    if len(at) > 1:
        new = np.append(True, np.diff(at) > 1)
        first = np.repeat(at[new], np.diff(np.append(np.flatnonzero(new), len(at))))
        hit = hit.copy()
        hit[at[(at - first) % 2 == 1]] = False
    return hit


@lru_cache(maxsize=2)
def _loaded(model: bytes) -> tuple[PieceModel, Lexicon]:
    held = PieceModel(model)
    return held, Lexicon(held.merge_words)


def _model_bytes(spark: SparkSession, path: str):
    """The model file as a broadcast; its size is that of the vocabulary, whatever the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _id_lists(ids: list[np.ndarray], counts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.concatenate([*counts, np.empty(0, np.int64)]))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, np.int32)]), pa.int32()))


def piece_functions(spark: SparkSession, model_path: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column], Callable[[Column], Column]]:
    """Functions on columns: encode (text -> array<int>), decode (array<int> -> text), and both at once.

    The third gives struct<ids, decoded>, where decoded comes from ids: chained functions would encode twice.
    """
    model = _model_bytes(spark, model_path)

    @F.arrow_udf("array<int>")
    def encode(text: pa.Array) -> pa.Array:
        _, lexicon = _loaded(model.value)
        made = list(encode_texts(text.fill_null("").to_pylist(), split_words, lexicon))
        return _id_lists([m[0] for m in made], [m[1] for m in made])

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        pieces, _ = _loaded(model.value)
        out: list[str] = []
        for at in range(0, len(ids), 200):
            some = ids.slice(at, 200)
            lengths = some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            out += pieces.decode(some.flatten().to_numpy(zero_copy_only=False), lengths)
        return pa.array(out, pa.string())

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def round_trip(text: pa.Array) -> pa.Array:
        pieces, lexicon = _loaded(model.value)
        ids, counts, decoded = [], [], []
        for some, n in encode_texts(text.fill_null("").to_pylist(), split_words, lexicon):
            ids.append(some)
            counts.append(n)
            decoded += pieces.decode(some, n)
        return pa.StructArray.from_arrays([_id_lists(ids, counts), pa.array(decoded, pa.string())], ["ids", "decoded"])

    return encode, decode, round_trip
