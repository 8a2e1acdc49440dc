"""Token ids in wavelet-matrix shards: bit planes with rank and select, one image per shard.

Image of a shard (little-endian): magic ``PWM1``, then five 64-bit numbers (tokens n, bit planes b, documents d,
rank step, size of a packed plane), the zeros of each plane (b x int64), document ids (d x int64), document ends
(d x int64), the planes (packed bits, most significant bit first), and per plane the ones before each rank step
(int32). Plane 0 holds the top bit of every id in text order; each plane is a stable partition of the one before.

Images are written by Spark as the binary column ``image`` of a Parquet table, one row per shard, so any store that
Spark reaches will do, and a lost task writes its shards again. Rows carry a shard number, which rises in the order of
ids: the partition in its upper half, and the count of shards before in that partition in its lower half.

Defined results: a null text encodes like an empty one, to the end id alone; rows with equal ids lie next to one
another in the order of a hash of their text; a null id is written as the smallest 64-bit number and comes first; an
empty table writes no shard and reads back as an empty table; texts may be of any length, one text being in one shard;
an id beyond the bit planes is an error; other columns are not part of the format.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.llm.lexicon import Lexicon, chunks, encode_split
from placeweave.llm.shared import materialize, running_offsets

MAGIC, HEAD = b"PWM1", struct.Struct("<4s5q")
RANK_STEP = 512
NULL_ID = -(1 << 63)
#: A shard closes once it holds this many tokens, so its size is bounded by this and the texts encoded in one go.
SHARD_TOKENS = 1 << 18
_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)  # set bits of a byte


def build(ids: np.ndarray, doc_ids: np.ndarray, doc_ends: np.ndarray, bits: int) -> bytes:
    """The image of one shard. An id that does not fit the planes is refused."""
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << bits:
        raise ValueError(f"token ids from {ids.min()} to {ids.max()} do not fit {bits} bit planes")
    n, row = len(ids), ids.astype(np.uint32 if bits > 16 else np.uint16)
    step_bytes, width = RANK_STEP // 8, -(-n // 8)
    planes, zeros, ranks = [], [], []
    for level in range(bits - 1, -1, -1):
        ones = row & row.dtype.type(1 << level) != 0
        packed = np.packbits(ones)
        planes.append(packed.tobytes())
        per_step = np.add.reduceat(_ONES[packed], np.arange(0, width, step_bytes)) if width else np.empty(0, np.int64)
        ranks.append((np.cumsum(per_step) - per_step).astype("<i4").tobytes())
        low, high = np.flatnonzero(~ones), np.flatnonzero(ones)
        zeros.append(len(low))
        row = np.concatenate([row.take(low), row.take(high)])
    head = HEAD.pack(MAGIC, n, bits, len(doc_ids), RANK_STEP, width)
    numbers = [np.asarray(x, "<i8").tobytes() for x in (zeros, doc_ids, doc_ends)]
    return b"".join([head, *numbers, *planes, *ranks])


class Shard:
    """One image: any token, counts and places of a token, without unpacking the planes."""

    def __init__(self, image: bytes) -> None:
        magic, self.n, self.bits, d, self.step, width = HEAD.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(image, kind, count, at)
            at += out.nbytes
            return out

        self.zeros, self.doc_ids, self.doc_ends = take("<i8", self.bits).tolist(), take("<i8", d), take("<i8", d)
        self.planes = [take("u1", width) for _ in range(self.bits)]
        self.ranks = [take("<i4", -(-width // (self.step // 8))) for _ in range(self.bits)]

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = min(i // self.step, len(self.ranks[level]) - 1)
        if block < 0:
            return 0
        first, plane = block * self.step // 8, self.planes[level]
        full = int(_ONES[plane[first : i // 8]].sum())
        rest = int(plane[i // 8]) >> (8 - i % 8) if i % 8 else 0
        return int(self.ranks[level][block]) + full + rest.bit_count()

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8]) >> (7 - i % 8) & 1

    def access(self, i: int) -> int:
        """The token at place i."""
        value = 0
        for level in range(self.bits):
            bit = self._bit(level, i)
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        for level in range(self.bits):
            x, y = self._rank1(level, a), self._rank1(level, b)
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if token >> (self.bits - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """How often token stands at places a to b (exclusive)."""
        if not 0 <= token < 1 << self.bits:
            return 0
        x, y = self._range(token, a, self.n if b is None else b)
        return y - x

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of this value in a plane, by binary search over ranks."""
        lo, hi = 0, self.n
        while hi - lo > 1:
            mid = (lo + hi) // 2
            ones = self._rank1(level, mid)
            if (ones if bit else mid - ones) <= k:
                lo = mid
            else:
                hi = mid
        return lo

    def find(self, token: int, k: int) -> int | None:
        """Place of the k-th (from 0) occurrence of token; None beyond the last."""
        if not 0 <= k < self.count(token):
            return None
        i = self._range(token, 0, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens in text order: the partitions undone from the last plane to the first."""
        row = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        for level in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n).astype(bool)
            up = np.empty_like(row)
            up[np.flatnonzero(~ones)] = row[: self.zeros[level]]
            up[np.flatnonzero(ones)] = row[self.zeros[level] :] | row.dtype.type(1 << (self.bits - 1 - level))
            row = up
        return row


#: What a vocabulary must say for its words to be encoded apart: white space is dropped, words are lower-cased, runs of
#: letters and runs of other marks are words of the vocabulary's own.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_words(tokenizer: dict) -> bool:
    """Whether a tokenizer's file is of the kind that Lexicon-wise encoding is right for; others go to the library whole."""
    normal, pre, model = (tokenizer.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps = pre.get("pretokenizers") or [{}]
    return (
        normal.get("normalizers") == _NORMALIZER
        and len(steps) == 2
        and (steps[0].get("pattern"), steps[0].get("behavior"), steps[0].get("invert")) == ({"Regex": _SPLITTER}, "Removed", True)
        and (steps[1].get("type"), steps[1].get("add_prefix_space"), steps[1].get("use_regex")) == ("ByteLevel", False, False)
        and model.get("type") == "BPE" and not model.get("dropout")
        and all(re.search(r"[^\w\s]", t["content"]) and not re.search(r"\s", t["content"]) for t in tokenizer.get("added_tokens", []))
    )


@lru_cache(maxsize=2)
def _encoder(tokenizer: str, end_id: int) -> Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """texts -> flat ids with end_id after each text, and how many each text has, some texts at a time."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    held = Tokenizer.from_str(tokenizer)

    def by_library(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in held.encode_batch_fast(list(words), add_special_tokens=False)]
        return _flat(ids)

    if not splits_words(json.loads(tokenizer)):

        def whole(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for a, b in chunks(listed := texts.to_pylist()):
                ids, counts = by_library(listed[a:b])
                yield np.insert(ids, np.cumsum(counts), end_id), counts + 1

        return whole

    tokenize = held.model.tokenize

    def by_model(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat([[t.id for t in tokenize(w if w.isascii() else _as_bytes(w))] for w in words])

    letters, others = Lexicon(by_model), Lexicon(by_library)
    return lambda texts: encode_split(texts, letters, others, end_id)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum())), lengths


_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level vocabularies write a byte as itself where that is a visible character, the others from 256 on.
_BYTES = {b: chr(b) for b in _KEPT} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _KEPT)}


def _as_bytes(word: str) -> str:
    return word.encode().decode("latin-1").translate(_BYTES)


def plane_count(tokenizer: str, end_id: int) -> int:
    """Bits of the largest id that a tokenizer's file names."""
    from tokenizers import Tokenizer

    return max(end_id, *Tokenizer.from_str(tokenizer).get_vocab(with_added_tokens=True).values()).bit_length()


def write_token_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, bits: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append end_id, and write shards in ascending order of ids, with as many bit planes as the vocabulary needs."""
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    tokenizer = docs.sparkSession.sparkContext.broadcast(source)  # the size of the vocabulary, whatever the data
    planes = bits or plane_count(source, end_id)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer.value, end_id)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # ids, document ids, token counts
        size, shard = 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            ids, doc_ids, counts = (np.concatenate([h[k] for h in held]) for k in range(3))
            image = build(ids, doc_ids, np.cumsum(counts), planes)
            return pa.RecordBatch.from_pydict({"shard": [shard], "first_id": [int(doc_ids[0])], "n_tokens": [len(ids)], "image": [image]})

        for batch in batches:
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            at = 0
            for ids, counts in encode(batch.column(1)):
                upto = at + len(counts)
                held.append((ids, doc_ids[at:upto], counts))
                size += len(ids)
                at = upto
                if size >= SHARD_TOKENS:
                    yield flush()
                    held, size, shard = [], 0, shard + 1
        if held:
            yield flush()

    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text_col).alias("tie"), F.coalesce(text_col, F.lit("")).alias("text")
    )
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    images = ordered.mapInArrow(pack, "shard long, first_id long, n_tokens long, image binary")
    images.write.option("compression", "zstd").parquet(path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the images alone."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, image in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                shard = Shard(image)
                data = shard.tokens().astype("<u4").tobytes()
                ends = shard.doc_ends
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([number] * n, pa.int64()), "doc_id": shard.doc_ids, "local": starts, "n_tokens": ends - starts, "ids_crc32": pa.array(crc, pa.int64())})

    shards = spark.read.schema("shard long, n_tokens long, image binary").parquet(path)
    docs = shards.select("shard", "image").mapInArrow(unpack, "shard long, doc_id long, local long, n_tokens long, ids_crc32 long")
    # Tokens before a shard: sums by file (one file per range of ids), then by shard within its file.
    sizes = materialize(shards.select(F.input_file_name().alias("file"), "shard", "n_tokens"), "shard-sizes")
    files = sizes.groupBy("file").agg(F.min("shard").alias("at"), F.sum("n_tokens").alias("n"))
    files = running_offsets(files, [], ["at"], "n").select("file", F.col("before").alias("file_before"))
    within = running_offsets(sizes, ["file"], ["shard"], "n_tokens").join(files, "file")
    offsets = within.select("shard", (F.col("before") + F.col("file_before")).alias("before"))
    out = docs.join(offsets, "shard")
    return out.select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def read_shard(spark: SparkSession, path: str, doc_id: int) -> Shard:
    """The shard that holds doc_id: the last that begins at or before it. One image, of bounded size, comes here."""
    shards = spark.read.parquet(path).where(F.col("first_id") <= doc_id)
    return Shard(bytes(shards.orderBy(F.desc("first_id"), F.desc("shard")).first()["image"]))
