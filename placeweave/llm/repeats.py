"""Repeated byte strings: removal of every byte that a string of 200 bytes found elsewhere covers.

Equal strings of 200 bytes have the same minimizer: the smallest hash among their 24-byte grams. Windows of a text
that share their minimizer form a stretch; stretches are dealt by minimizer, so equal strings meet whatever texts they
come from, and a minimizer seen in one place only needs no further look. Where the stretches of a minimizer are all
equal nothing is left to compare. The others are shards of one collection whose suffix orders are merged by iterative
refinement: suffixes are interleaved by their first 8 bytes, and each round doubles the depth of the blocks by looking
up the block that lies as many bytes further on; suffixes alone in their block drop out, so later rounds touch only
common prefixes. The blocks at depth 200 with more than one suffix are the repeated intervals.

A minimizer with more than BATCH_BYTES of distinct stretches is not compared in one task. Equal windows hold the
minimizer's first gram at the same place, so windows are named by Spark in two rounds: first by the block that all
windows with that place in one stretch of STEPS[0] share, then one by one. A name that occurs once is dropped with the
windows it stands for; names are 128-bit hashes, counted by an aggregate, and meet in no single task.

Defined results: a null text is empty; texts of fewer than 200 bytes lose nothing; equal texts of 200 bytes or more
lose everything, repeated rows included; the strings are judged on the input; other columns are left to the caller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeweave.llm.shared import discard, join_hot, materialize

LENGTH, GRAM = 200, 24
GRAMS = LENGTH - GRAM + 1
#: Windows of one stretch at most, so that a stretch has a bounded size.
MOST_WINDOWS = 256
#: Bytes of stretches compared in one go; a minimizer's stretches stay together.
BATCH_BYTES = 1 << 20
#: Places of the minimizer that one name covers, by round. The last must be 1.
STEPS = (16, 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all 24-byte grams, from those of 8 bytes."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    h = np.ascontiguousarray(words).view("<u8").ravel() * _A
    h ^= h >> np.uint64(32)
    n = len(data) - GRAM + 1
    g = (h[:n] * _B + h[8 : n + 8]) * _A + h[16 : n + 16]
    g ^= g >> np.uint64(29)
    g *= _B
    g ^= g >> np.uint64(32)
    return g


def window_minima(g: np.ndarray) -> np.ndarray:
    """The smallest of each GRAMS neighbouring hashes, by doubling."""
    m, width = g, 1
    while 2 * width <= GRAMS:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = GRAMS - width
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def stretches(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first window, number of windows, minimizer, and whether the minimizer occurs twice in the stretch."""
    g = gram_hashes(data)
    m = window_minima(g)
    change = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
    length = np.diff(np.append(change, len(m)))
    if length.max() > MOST_WINDOWS:
        parts = -(-length // MOST_WINDOWS)
        offset = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        change = np.repeat(change, parts) + offset * MOST_WINDOWS
        length = np.diff(np.append(change, len(m)))
    key = m[change]
    # The places of minimizers, counted in each stretch's grams.
    order = np.argsort(g, kind="stable")
    ranked = g[order]
    lo, hi = np.searchsorted(ranked, key, "left"), np.searchsorted(ranked, key, "right")
    several = np.flatnonzero(hi - lo > 1)
    twice = np.zeros(len(change), bool)
    for i in several.tolist():
        at = order[lo[i] : hi[i]]
        a, b = np.searchsorted(at, [change[i], change[i] + length[i] + GRAMS - 1])
        twice[i] = b - a > 1
    return change, length, key, twice


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        ids, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        for at in range(0, len(texts), 500):
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            for doc, tie, text in zip(ids[at : at + 500], ties[at : at + 500], texts[at : at + 500], strict=True):
                if len(text) < LENGTH:
                    continue
                first, length, key, twice = stretches(np.frombuffer(text, np.uint8))
                digest = [xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(first.tolist(), (first + length + LENGTH - 1).tolist(), strict=True)]
                for k, v in enumerate((np.full(len(first), doc), np.full(len(first), tie), first, length, key.view(np.int64), np.array(digest, np.uint64).view(np.int64), twice)):
                    cols[k].append(v)
            if cols[0]:
                made = [np.concatenate(c) for c in cols]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, types, strict=True)], ["id", "tie", "first", "windows", "key", "digest", "twice"])


def repeated_starts(parts: list[bytes], weights: list[int]) -> list[np.ndarray]:
    """For each part, which of its 200-byte windows occurs twice or more among all parts (a part counts weight times)."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    end = np.repeat(np.cumsum(sizes), sizes)
    weight = np.repeat(np.array(weights, np.int64), sizes)
    place = np.arange(len(data))
    live = place[place + LENGTH <= end]  # starts still in a block with others
    reach = place[place + 8 <= end]  # all places that a start can look up
    block = np.full(len(data), -1, np.int64)
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<u8").ravel()
    block[reach] = np.unique(words[reach], return_inverse=True)[1]
    depth = 8
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        reach = reach[reach + depth + step <= end[reach]]
        pair = block[reach] * len(data) + block[reach + step]
        ids = np.unique(pair, return_inverse=True)[1]
        count = np.bincount(ids, weights=weight[reach])
        block = np.full(len(data), -1, np.int64)
        alone = count[ids] < 2
        # A place alone in its block stays alone at any depth: it gets a block of its own and is not looked at again.
        block[reach] = np.where(alone, -1, ids)
        reach = reach[~alone]
        depth += step
        if depth < LENGTH:
            nxt = min(depth, LENGTH - depth)
            ok = reach + nxt < len(data)
            reach = reach[ok]
            reach = reach[block[reach + nxt] >= 0]
    hit = np.zeros(len(data), bool)
    hit[np.intersect1d(reach, live, assume_unique=True)] = True
    starts = np.cumsum(sizes) - sizes
    return [hit[a : a + n - LENGTH + 1] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; whole keys are compared together, BATCH_BYTES or one key at a time."""
    keys: list[int] = []
    digests: list[int] = []
    parts: list[bytes] = []
    weights: list[int] = []
    size = 0

    def flush(n: int) -> pa.RecordBatch:
        out: dict[str, list] = {"key": [], "digest": [], "from": [], "to": []}
        for key, digest, hit in zip(keys[:n], digests[:n], repeated_starts(parts[:n], weights[:n]), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            for a, b in edge.reshape(-1, 2).tolist():
                for name, v in zip(out, (key, digest, a, b), strict=True):
                    out[name].append(v)
        types = dict(zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(v, types[k]) for k, v in out.items()], list(out))

    for batch in batches:
        for key, digest, weight, part in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if size >= BATCH_BYTES and keys and key != keys[-1]:
                yield flush(len(keys))
                keys, digests, parts, weights, size = [], [], [], [], 0
            keys.append(key)
            digests.append(digest)
            parts.append(part)
            weights.append(weight)
            size += len(part)
    if keys:
        yield flush(len(keys))


def _names(step: int):
    """key, digest, weight, part, single (pairs of windows known to occur once) -> a row per block of the other windows.

    A row stands for windows lo to hi of its stretch, whose place of the minimizer, over step, is the same.
    """
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"key": pa.int64(), "digest": pa.int64(), "weight": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "h1": pa.int64(), "h2": pa.int64()}
        for batch in batches:
            rows: list[tuple] = []
            for key, digest, weight, part, single in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                g = gram_hashes(np.frombuffer(part, np.uint8))
                at = np.flatnonzero(g == np.uint64(key & 0xFFFFFFFFFFFFFFFF))
                window = np.arange(len(part) - LENGTH + 1)
                place = at[np.searchsorted(at, window)]  # of the first minimizer in each window
                last = place - (place - window) // step * step  # the last window of its block, if the stretch reaches so far
                open_ = np.ones(len(window), bool)
                for s in single or ():
                    open_[s["lo"] : s["hi"] + 1] = False
                edge = np.flatnonzero(np.append(True, (last[1:] != last[:-1]) | (place[1:] != place[:-1])))
                for lo, hi in zip(edge.tolist(), [*(edge[1:] - 1).tolist(), len(window) - 1], strict=True):
                    if open_[lo]:
                        block = int(last[lo])
                        h = xxhash.xxh3_128_digest(part[block : block + LENGTH + 1 - step])
                        rows.append((key, digest, weight, lo, hi, int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)))
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    return run


def _compare_dealt(parts: DataFrame) -> DataFrame:
    """key, digest, from, to of the repeated windows of distinct stretches, whatever their number by key."""
    left = parts.withColumn("single", F.expr("cast(array() as array<struct<lo: int, hi: int>>)"))
    for step in STEPS:
        named = left.select("key", "digest", "weight", "part", "single").mapInArrow(_names(step), "key long, digest long, weight long, lo int, hi int, h1 long, h2 long")
        # Of a name that occurs once, the smallest of each column are those of its only row. The key is part of the bytes.
        once = named.groupBy("h1", "h2").agg(F.sum("weight").alias("weight"), *(F.min(c).alias(c) for c in ("key", "digest", "lo", "hi"))).where("weight = 1")
        single = once.groupBy("key", "digest").agg(F.collect_list(F.struct("lo", "hi")).alias("new"))  # windows of one stretch at most
        left = left.join(single, ["key", "digest"], "left").withColumn("single", F.when(F.col("new").isNull(), F.col("single")).otherwise(F.concat("single", "new"))).drop("new")
    ends = F.array(F.struct(F.lit(-1).alias("lo"), F.lit(-1).alias("hi")))
    bars = F.sort_array(F.concat(ends, F.col("single"), F.transform(F.array((F.length("part") - (LENGTH - 1)).cast("int")), lambda n: F.struct(n.alias("lo"), n.alias("hi")))))
    gaps = left.select("key", "digest", bars.alias("bars")).select(
        "key", "digest", F.inline(F.zip_with(F.slice("bars", F.lit(1), F.size("bars") - 1), F.slice("bars", F.lit(2), F.size("bars") - 1), lambda a, b: F.struct((a["hi"] + 1).alias("from"), b["lo"].alias("to"))))
    )
    return gaps.where(F.col("from") < F.col("to"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, array of (key, digest, weight, first, windows, large) -> one row per stretch with its bytes."""
    for batch in batches:
        texts, wanted = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()
        rows = [(w["key"], w["digest"], w["weight"], w["large"], t[w["first"] : w["first"] + w["windows"] + LENGTH - 1]) for t, ws in zip(texts, wanted, strict=True) for w in ws]
        cols = list(zip(*rows, strict=True)) or [(), (), (), (), ()]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["key", "digest", "weight", "large", "part"])


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, counts = [], []
        for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            out, at, removed, runs = [], 0, 0, 0
            for s in sorted((s["from"], s["to"]) for s in spans or ()):
                if s[0] > at or not runs:
                    runs += 1
                    out.append(text[at : s[0]])
                    removed += s[1] - s[0]
                    at = s[1]
                elif s[1] > at:
                    removed += s[1] - at
                    at = s[1]
            out.append(text[at:])
            kept.append(b"".join(out))
            counts.append((len(text), removed, runs))
        numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def repeated_spans(slim: DataFrame) -> DataFrame:
    """id, tie, from, to: byte spans covered by repeated strings; spans of one text may overlap. slim: id, tie, text."""
    found = materialize(slim.mapInArrow(_find, "id long, tie long, first int, windows int, key long, digest long, twice boolean"), "repeat-found")
    counts = found.groupBy("key").agg(F.count("*").alias("n"), (F.min("digest") == F.max("digest")).alias("one"), F.max("twice").alias("self"))
    counts = materialize(counts.where("n > 1 or self"), "repeat-keys")
    met = materialize(join_hot(found.drop("twice"), counts, "key", size="n").drop("n"), "repeat-stretches")
    discard(found)
    same = met.where("one and not self")  # the stretch occurs twice or more, and nothing else has its minimizer
    mixed = met.where("not one or self")
    chosen = mixed.groupBy("key", "digest").agg(F.min(F.struct("id", "tie", "first", "windows")).alias("c"), F.count("*").alias("weight"))
    chosen = materialize(chosen.select("key", "digest", "weight", "c.*"), "repeat-chosen")
    sizes = chosen.groupBy("key").agg(F.count("*").alias("n"), (F.sum(F.col("windows") + (LENGTH - 1)) > BATCH_BYTES).alias("large"))
    chosen = join_hot(chosen, materialize(sizes, "repeat-sizes"), "key", size="n")
    wanted = chosen.groupBy("id", "tie").agg(F.collect_list(F.struct("key", "digest", "weight", "first", "windows", "large")).alias("wanted"))
    parts = slim.join(wanted, ["id", "tie"]).select("text", "wanted").mapInArrow(_cut, "key long, digest long, weight long, large boolean, part binary")
    dealt = materialize(parts.groupBy("key", "digest").agg(F.first("weight").alias("weight"), F.first("large").alias("large"), F.first("part").alias("part")), "repeat-parts")
    own = dealt.where(~F.col("large")).drop("large")
    runs = own.repartition("key").sortWithinPartitions("key").mapInArrow(_compare, "key long, digest long, `from` int, `to` int")
    runs = runs.unionByName(_compare_dealt(dealt.where("large").drop("large")))
    runs = materialize(runs.groupBy("key", "digest").agg(F.collect_list(F.struct("from", "to")).alias("runs")), "repeat-runs")  # of one stretch
    discard(dealt)
    hit = join_hot(mixed.select("id", "tie", "first", "key", "digest"), runs, ["key", "digest"]).select("id", "tie", "first", F.inline("runs"))
    hit = hit.select("id", "tie", (F.col("first") + F.col("from")).alias("from"), (F.col("first") + F.col("to") + (LENGTH - 1)).alias("to"))
    return hit.unionByName(same.select("id", "tie", F.col("first").alias("from"), (F.col("first") + F.col("windows") + (LENGTH - 1)).alias("to")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row of docs."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    slim = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    spans = repeated_spans(slim).groupBy("id", "tie").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    out = slim.join(spans, ["id", "tie"], "left").select("id", "text", "spans").mapInArrow(_strip, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("id", F.when(F.col("id") != -(1 << 63), F.col("id")))
