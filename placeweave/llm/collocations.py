"""Phrase collocations: position bitmaps of words, extended depth first by shift, AND and popcount, summed over shards.

A shard is some texts of one language. Its words stand at numbered positions, with one free position after each piece,
so that nothing shifts across the end of a piece. A word's bitmap is compressed: of its bytes (eight positions each) only
those with a bit set are held, in order of position for all words together. To extend a phrase, its bitmap (the positions of
its last word) is shifted by one and ANDed with the bitmaps of all words that have bits in the same bytes; what is
left is the longer phrase's bitmap, and its popcount the number of occurrences.

Counts are global sums over shards, so the search goes in three rounds: words; then pairs of words that are frequent
in the language; then, depth first, phrases of three and four words all of whose neighbouring pairs are frequent. What
is frequent is joined back to the shards that hold it and never gathered or broadcast: Spark knows words and phrases by
the size of their files, before they are decompressed and copied to parts, so these joins are told to shuffle ("merge").
Words have exact numbers, so phrases are never told apart by hashes.

A branch of the search (a run of first words with up to BRANCH bytes of bitmaps) is extended to the full depth before
the next one, which bounds the memory of a task; a very frequent word's bitmap is cut into several branches.

Defined results: a null or blank text has no words; a null language goes by ``und``, an empty one is a language of
its own; texts may be of any length, one text being in one shard; repeated rows count each; an empty table gives an
empty table. Columns other than text and lang are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.llm.lexicon import spread
from placeweave.llm.shared import discard, materialize
from placeweave.llm.terms import as_strings, stretches, text_bytes

#: A candidate occurs so often at least, and a longer one with so many percent of its occurrences makes it superfluous.
MIN_COUNT, INSIDE_PERCENT = 30, 80
#: Bytes of text in a shard (one longer text is a shard), bytes of bitmaps in a branch.
SHARD_BYTES, BRANCH = 32_000_000, 200_000
#: Parts that the phrases of one word are dealt to, when words are joined to pairs.
SALTS = 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PIECE_END = np.isin(np.arange(256), [ord(c) for c in ".,;:!?\n\x0b\x0c\r"])
_BETWEEN = _PIECE_END | np.isin(np.arange(256), [32, 9])


def place_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of texts, and for each position the number of its word plus one, or 0 where a piece has ended."""
    data = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ~_BETWEEN[data], [False]])))
    start, end = edge[::2], edge[1::2]
    coded = as_strings(data, start, end).dictionary_encode()
    piece = np.cumsum(_PIECE_END[data])[start]
    at = np.arange(len(start)) + np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
    codes = np.zeros(int(at[-1]) + 1 if len(at) else 0, np.int32)
    codes[at] = coded.indices.to_numpy() + 1
    return coded.dictionary, codes


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text -> a row for each distinct word of a shard with its number and count, and one with the shard's positions."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
        for lang in dict.fromkeys(langs):
            mine = [t for own, t in zip(langs, texts, strict=True) if own == lang]
            for a, b in stretches(mine, len(mine), SHARD_BYTES):
                words, codes = place_words(mine[a:b])
                n = len(words)
                count = np.bincount(codes, minlength=n + 1)[1:]
                place = pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([codes.tobytes()], pa.binary())])
                word = pa.concat_arrays([words.cast(pa.string()), pa.nulls(1, pa.string())])
                code = pa.array(np.append(np.arange(n), -1), pa.int32())
                columns = [pa.array(np.full(n + 1, number)), pa.array([lang] * (n + 1)), word, code, pa.array(np.append(count, 0), pa.int64()), place]
                whole = pa.RecordBatch.from_arrays(columns, ["shard", "lang", "word", "code", "n", "codes"])
                for at in range(0, n + 1, 50_000):
                    yield whole.slice(at, 50_000)
                number += 1


class Bitmaps:
    """Position bitmaps of the words with numbers 0 to size - 1; numbers[p] is the number at position p, or -1."""

    def __init__(self, numbers: np.ndarray, size: int) -> None:
        at = np.flatnonzero(numbers >= 0)
        self.size = size
        key = (at >> 3) * np.int64(max(size, 1)) + numbers[at]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        bits = np.left_shift(np.uint8(1), (at & 7).astype(np.uint8))[order]
        self.bits = np.bitwise_or.reduceat(bits, first) if len(first) else bits
        self.block, self.word = np.divmod(key[order][first], max(size, 1))
        held = np.bincount(self.block, minlength=(len(numbers) >> 3) + 2)
        self.count, self.start = held, np.cumsum(held) - held

    def branches(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """word, block and bits of all bitmaps, some words at a time."""
        order = np.argsort(self.word, kind="stable")
        for a in range(0, len(order), BRANCH):
            part = order[a : a + BRANCH]
            yield self.word[part], self.block[part], self.bits[part]

    def extend(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shift the phrases' bitmaps by one position and AND them with every word's: phrase, next word, block and bits."""
        on, over = np.flatnonzero(bits & 0x7F), np.flatnonzero(bits & 0x80)
        phrase, block, bits = np.concatenate([phrase[on], phrase[over]]), np.concatenate([block[on], block[over] + 1]), np.concatenate([bits[on] << 1, bits[over] >> 7])
        many = self.count[block]
        at = spread(self.start[block], many)
        both = np.repeat(bits, many) & self.bits[at]
        hit = np.flatnonzero(both)
        source = np.repeat(np.arange(len(phrase), dtype=np.int32), many)[hit]
        return phrase[source], self.word[at[hit]], block[source], both[hit]


def _supports(key: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the popcount of each, and for every entry the place of its key."""
    distinct, place = np.unique(key, return_inverse=True)
    return distinct, np.bincount(place, np.bitwise_count(bits), len(distinct)).astype(np.int64), place


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64())


def _pairs(shard: pa.Table, words: pa.Table) -> pa.Table:
    """A shard's positions, and number and id of its frequent words -> shard, x (numbers of both words), a, b (ids), n."""
    out: list[tuple[np.ndarray, ...]] = []
    if shard.num_rows and words.num_rows:
        codes = np.frombuffer(shard["codes"][0].as_py(), np.int32)
        code, ids = words["code"].to_numpy(), words["id"].to_numpy()
        number = np.full(int(codes.max()) + 1, -1, np.int32)
        number[code + 1] = np.arange(len(code))
        maps = Bitmaps(number[codes], len(code))
        for word, block, bits in maps.branches():
            phrase, following, _, both = maps.extend(word, block, bits)
            key, n, _ = _supports(phrase * len(code) + following, both)
            a, b = np.divmod(key, len(code))
            out.append((code[a].astype(np.int64) << 32 | code[b], ids[a], ids[b], n))
    x, a, b, n = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 4
    name = shard["shard"][0].as_py() if shard.num_rows else 0
    return pa.table({"shard": _longs(np.full(len(x), name)), "x": _longs(x), "a": _longs(a), "b": _longs(b), "n": _longs(n)})


def _longer(shard: pa.Table, pairs: pa.Table) -> pa.Table:
    """A shard's positions and its frequent pairs -> a, b, c, d (-1 for three words), n."""
    out: list[tuple[np.ndarray, ...]] = []
    if shard.num_rows and pairs.num_rows:
        codes = np.frombuffer(shard["codes"][0].as_py(), np.int32)
        x = pairs["x"].to_numpy()
        code, first = np.unique(np.concatenate([x >> 32, x & 0xFFFFFFFF]), return_index=True)
        ids = np.concatenate([pairs["a"].to_numpy(), pairs["b"].to_numpy()])[first]
        number = np.full(int(codes.max()) + 1, -1, np.int32)
        number[code + 1] = np.arange(len(code))
        size = len(code)
        frequent = np.unique(number[(x >> 32) + 1].astype(np.int64) * size + number[(x & 0xFFFFFFFF) + 1])
        maps = Bitmaps(number[codes], size)

        def known(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            key = left * size + right
            return np.flatnonzero(frequent[np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)] == key)

        for word, block, bits in maps.branches():
            phrase, following, block, bits = maps.extend(word, block, bits)
            keep = known(phrase, following)
            pair, _, place = _supports(phrase[keep] * size + following[keep], bits[keep])
            phrase, following, block, bits = maps.extend(place, block[keep], bits[keep])
            keep = known(pair[phrase] % size, following)
            three, n, place = _supports(phrase[keep] * size + following[keep], bits[keep])
            of, c = np.divmod(three, size)
            a, b = np.divmod(pair[of], size)
            out.append((ids[a], ids[b], ids[c], np.full(len(a), -1), n))
            phrase, following, block, bits = maps.extend(place, block[keep], bits[keep])
            keep = known(c[phrase], following)
            four, n, _ = _supports(phrase[keep] * size + following[keep], bits[keep])
            of, d = np.divmod(four, size)
            out.append((ids[a[of]], ids[b[of]], ids[c[of]], ids[d], n))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 5
    return pa.table({k: _longs(v) for k, v in zip("abcdn", columns, strict=True)})


def _rated(phrases: DataFrame, *cuts: tuple[str, str]) -> DataFrame:
    """Adds score, l and r of the lowest-scoring cut, the first of equal ones. Products are decimals, so exact."""
    each = []
    for k, (left, right) in enumerate(cuts):
        both = F.col(left) + F.col(right)
        value = F.call_function("div", F.col("f").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)"), both.cast("decimal(20,0)"))
        each.append(F.struct(value.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")))
    return phrases.withColumn("cut", F.array_min(F.array(*each)))


def _not_inside(phrases: DataFrame, keys: list[str], longer: DataFrame, parts: list[list[str]]) -> DataFrame:
    """phrases that no longer one (with one word more, which is enough) makes superfluous."""
    inside = longer.select(*[F.col(p).alias(k) for k, p in zip(keys, parts[0], strict=True)], "f")
    for part in parts[1:]:
        inside = inside.unionByName(longer.select(*[F.col(p).alias(k) for k, p in zip(keys, part, strict=True)], "f"))
    most = inside.groupBy(*keys).agg(F.max("f").alias("most"))
    exact = lambda c: c.cast("decimal(20,0)")
    kept = phrases.join(most.hint("merge"), keys, "left").where(F.col("most").isNull() | (100 * exact(F.col("most")) < INSIDE_PERCENT * exact(F.col("f"))))
    return kept.drop("most")


def _with_word(rows: DataFrame, words: DataFrame, key: str, spread_by: str, f: str, name: str) -> DataFrame:
    """rows with count and text of the word with id ``key``; the rows of one word are dealt to SALTS parts."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    listed = words.select(F.col("id").alias(key), F.col("f").alias(f), F.col("word").alias(name), "lang", salt.alias("salt"))
    listed = listed.drop("lang") if "lang" in rows.columns else listed
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")).join(listed.hint("merge"), [key, "salt"]).drop("salt")


def collocations(docs: DataFrame, top: int, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by score, count and text."""
    lang: Column = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    texts = docs.select(lang.alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    shards = materialize(texts.mapInArrow(_shards, "shard long, lang string, word string, code int, n long, codes binary"), "shards")
    counted = materialize(shards.where("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("f")), "word-counts")
    words = materialize(counted.where(F.col("f") >= min_count).select(F.monotonically_increasing_id().alias("id"), "lang", "word", "f"), "frequent-words")
    places = shards.where("word is null").select(F.col("shard").alias("shard"), "codes")  # a column of its own beside that of the words
    mine = shards.where("word is not null").select("shard", "lang", "word", "code").join(words.hint("merge"), ["lang", "word"]).select("shard", "code", "id")
    found = places.groupBy("shard").cogroup(mine.groupBy("shard")).applyInArrow(_pairs, "shard long, x long, a long, b long, n long")
    # A pair's rows, one for each shard that holds it, meet once: for its count, and to tell the shards.
    of_pair = Window.partitionBy("a", "b")
    marked = found.withColumns({"f": F.sum("n").over(of_pair), "turn": F.row_number().over(of_pair.orderBy("shard"))})
    pairs = materialize(marked.where(F.col("f") >= min_count).select("shard", "x", "a", "b", "f", (F.col("turn") == 1).alias("first")), "frequent-pairs")
    longer = places.groupBy("shard").cogroup(pairs.select("shard", "x", "a", "b").groupBy("shard")).applyInArrow(_longer, "a long, b long, c long, d long, n long")
    longer = materialize(longer.groupBy("a", "b", "c", "d").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count), "longer-phrases")
    two = _with_word(pairs.where("first").select("a", "b", "f"), words, "a", "b", "fa", "word_a")
    two = _with_word(two, words, "b", "a", "fz", "last").withColumn("phrase", F.concat_ws(" ", "word_a", "last")).drop("word_a")
    two = materialize(two, "two-words")
    three = longer.where("d = -1").drop("d")
    # A longer phrase has all its parts' counts, and its text, from its first and its last words but one.
    head = two.select("a", "b", "lang", "phrase", "fa", F.col("f").alias("fab"))
    tail = two.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("fyz"), "fz", "last")
    three = three.join(head.hint("merge"), ["a", "b"]).join(tail.hint("merge"), ["b", "c"]).withColumn("phrase", F.concat_ws(" ", "phrase", "last"))
    three = materialize(three, "three-words")
    four = longer.where("d <> -1")
    head = three.select("a", "b", "c", "lang", "phrase", "fa", "fab", F.col("f").alias("fabc"))
    tail = three.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("c").alias("d"), F.col("f").alias("fxyz"), "fyz", "fz", "last")
    four = four.join(head.hint("merge"), ["a", "b", "c"]).join(tail.hint("merge"), ["b", "c", "d"]).withColumn("phrase", F.concat_ws(" ", "phrase", "last"))
    rated = [
        _rated(_not_inside(two, ["a", "b"], three, [["a", "b"], ["b", "c"]]), ("fa", "fz")),
        _rated(_not_inside(three, ["a", "b", "c"], four, [["a", "b", "c"], ["b", "c", "d"]]), ("fa", "fyz"), ("fab", "fz")),
        _rated(four, ("fa", "fxyz"), ("fab", "fyz"), ("fabc", "fz")),
    ]
    columns = ["lang", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")]
    every = rated[0].select(*columns).unionByName(rated[1].select(*columns)).unionByName(rated[2].select(*columns))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = every.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    discard(shards)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
