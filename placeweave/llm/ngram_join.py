"""Jaccard self-join of word shingles: size-aware heavy-light join, reduced to connected components.

A document's set is its distinct five-word shingles. Documents with equal sets form one class. Classes are linked when
their sets have a Jaccard similarity of 0.75 or more:

- small against small sets: every set lists its subsets of each size that an overlap may have to reach. All sets that
  share such a subset are linked to the smallest of them, which is as good as linking them to each other.
- otherwise inverted lists are scanned, over the prefix of each set (the first third of it) in a fixed order. A set may
  lack a quarter of its shingles in a partner, so similar sets share at least a twelfth of the smaller one within
  their prefixes; sets and pairs that share less are dropped. Lists of up to LIGHT classes give their pairs. Classes
  met in longer lists form a problem of their own in which shingles are ordered by how few sets hold them, so common
  passages come last; of lists with the same members one is enough. Members of a list are first compared with one of
  them, round by round. A list that is then still long and open is a problem of its own once more: its members' shingles
  are ordered by how few members of that list hold them. Only pairs left in those lists are compared in the end.
- the boundary between small and large is the size at which subsets and lists together cost the least.

Every pair of candidates is compared on the whole sets before it becomes a link, unless a shared subset proves it.
Shingles that very many sets hold are spread over tasks wherever lists are counted, joined or compared.

Defined results: a null or blank text has an empty set and is alone in its component; fewer than five words are one
shingle; texts may be of any length; ids must be whole numbers; rows with one id and different texts are documents of
their own; a component has the smallest id of its rows, null if all are null; an empty table gives an empty table.
Columns other than id and text are left to the caller.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.llm.components import connected
from placeweave.llm.shared import HOT_KEYS, HOT_ROWS, discard, join_hot, materialize, maybe_in, only_result, packed, row_hash, unpacked

K = 5
#: Lists of shingles up to this length give all their pairs.
LIGHT = 24
#: A set of so many elements has more subsets of the sizes needed than any table has rows, so it is never small.
NEVER_SMALL = 64
#: Open lists with more members outside their largest component are split once more, up to MOST_SPLITS times. A split
#: shuffles every shingle of every member, so a member should save some ten times as many pairs as it has shingles.
LONG, MOST_SPLITS = 65_536, 2
#: Members of an open list that are compared with as many others in one go.
BLOCK = 1024
#: Bits of a set's parity sketch.
SKETCH = 1024
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Bytes of text hashed at once.
CHUNK = 1 << 20


def needed(a: Column, b: Column) -> Column:
    """The smallest overlap of sets of a and b elements with Jaccard similarity 3/4: ceil(3 (a + b) / 7)."""
    return F.floor((3 * (a + b) + 6) / 7).cast("int")


def least_common(n: Column) -> Column:
    """How many shingles similar sets, the smaller of n elements, share at least within their prefixes.

    The m-th shared shingle is at most number m + n / 4 of either set, and the prefix holds n / 3 + 1.
    """
    return (F.floor(n / 12) + 1).cast("int")


@lru_cache(maxsize=1)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte value, and the first n powers of an odd number and of its inverse."""
    power = np.full(n, _STEP)
    power[0] = 1
    inverse = np.full(n, np.uint64(pow(int(_STEP), -1, 1 << 64)))
    inverse[0] = 1
    return np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64), np.multiply.accumulate(power), np.multiply.accumulate(inverse)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of data: differences of running sums of a polynomial, made equal in place."""
    byte, power, inverse = _tables(1 << max(20, (len(data) + 1).bit_length()))
    word = ~_BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]])))
    start, end = edge[::2], edge[1::2]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(byte[data] * power[: len(data)], dtype=np.uint64)])
    h = (sums[end] - sums[start]) * inverse[start]
    h ^= h >> np.uint64(32)
    return start, h * _MIX


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each UTF-8 text."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) < CHUNK):
            size += len(texts[upto])
            upto += 1
        start, hashes = _word_hashes(np.frombuffer(b"\n".join(texts[at:upto]).translate(_LOWER), np.uint8))
        first = np.searchsorted(start, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[at:upto]])]))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield _shingles(hashes[a:b])
        at = upto


def _shingles(w: np.ndarray) -> np.ndarray:
    if not len(w):
        return np.empty(0, np.uint64)
    k = min(K, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(29))) * _MIX + w[j : j + len(h)] * _STEP
    h ^= h >> np.uint64(32)
    h *= _MIX
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


def _signed(x: np.ndarray) -> np.ndarray:
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_signed(np.concatenate([*arrays, np.empty(0, np.uint64)])), pa.int64()))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, tie, n and digest of the set."""
    for batch in batches:
        sets = list(shingle_sets(batch.column(2).cast(pa.binary()).to_pylist()))
        digest = pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int32()), digest], ["id", "tie", "n", "digest"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest and the first third of each set."""
    for batch in batches:
        sets = list(shingle_sets(batch.column(0).cast(pa.binary()).to_pylist()))
        digest = pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([digest, _lists([s[: len(s) // 3 + 1] for s in sets])], ["digest", "prefix"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token, those whose token occurs twice, and the first and last token of the partition."""
    last: tuple[int, int] | None = None  # token and doc of a row that is not sent yet
    first = True

    def send(token: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(doc, pa.int64())], ["token", "doc"])

    same_before = False  # whether the row before the one held back has its token
    for batch in batches:
        token, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if last is not None:
            token, doc = np.append(last[0], token), np.append(last[1], doc)
        if not len(token):
            continue
        equal = token[1:] == token[:-1]
        held = np.concatenate([[same_before or first], equal]) | np.append(equal, False)
        keep = np.flatnonzero(held[:-1])
        if len(keep):
            yield send(token[keep], doc[keep])
        same_before = bool(equal[-1]) if len(equal) else same_before
        first = first and len(token) == 1
        last = (int(token[-1]), int(doc[-1]))
    if last is not None:
        yield send(np.array([last[0]]), np.array([last[1]]))


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, long, text -> doc, long, n, the whole set, and the parities of its shingles over SKETCH classes of hashes, as bits."""
    for batch in batches:
        sets = list(shingle_sets(batch.column(2).cast(pa.binary()).to_pylist()))
        odd = np.array([np.bincount((s % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1 for s in sets], np.uint8).reshape(-1, SKETCH)
        bits = np.packbits(odd, axis=1).view(np.int64)
        sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * (SKETCH // 64), pa.int32()), pa.array(bits.ravel(), pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int32()), _lists(sets), sketch], ["doc", "long", "n", "tokens", "sketch"])


def _boundary(classes: DataFrame, lists: DataFrame) -> int:
    """The size up to which sets list subsets, so that subsets and scans of lists cost the least. Reads NEVER_SMALL sums."""
    by_size = {r["n"]: r["c"] for r in classes.where(F.col("n") < NEVER_SMALL).groupBy("n").agg(F.count("*").alias("c")).collect()}
    mean = lists.agg(F.avg(F.least("c", F.lit(LIGHT)))).first()[0] or 1.0  # entries met by one element; longer lists meet pivots

    def cost(x: int) -> float:
        subsets = sum(c * sum(comb(n, k) for k in _overlaps(n, x)) for n, c in by_size.items() if n <= x)
        return subsets + sum(c * (n // 3 + 1) * mean for n, c in by_size.items() if n > x)

    return min(range(NEVER_SMALL), key=cost)


def _overlaps(n: int, boundary: int) -> list[int]:
    """The overlaps that a set of n elements may need with one of at most boundary elements, both being small."""
    return sorted({(3 * (n + m) + 6) // 7 for m in range(1, boundary + 1) if 4 * min(n, m) >= 3 * max(n, m)}) if n <= boundary else []


def _small_links(sets: DataFrame, boundary: int) -> DataFrame:
    """Links a, b among sets of up to boundary elements, from shared subsets of the size of the overlap needed."""

    def subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = [
                (doc, n, k, xxhash.xxh3_64_intdigest(np.array(chosen, np.int64).tobytes()) - (1 << 63))
                for doc, n, whole in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
                for k in _overlaps(n, boundary)
                for chosen in combinations(whole, k)
            ]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["a", "n", "k", "subset"])

    listed = sets.select("doc", "n", "tokens").mapInArrow(subsets, "a long, n int, k int, subset long")
    least = listed.groupBy("k", "subset").agg(F.min(F.struct("n", "a")).alias("m"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = listed.join(least, ["k", "subset"]).where(needed(F.col("n"), F.col("m.n")) <= F.col("k"))
    return met.select("a", F.col("m.a").alias("b")).where("a <> b").distinct()


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. Only sets of pairs whose sketches are near are shuffled, and few others."""
    pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
    met = _with_sets(pairs, sets, sets, "sketch")
    pairs = materialize(met.where(_near("xa", "xb", "na", "nb")).select("a", "b"), "near-pairs")
    one, two = (maybe_in(sets, "doc", pairs.select(end)).where("maybe") for end in ("a", "b"))
    met = _with_sets(pairs, one, two, "tokens")
    return met.where(F.size(F.array_intersect("xa", "xb")) >= needed(F.col("na"), F.col("nb"))).select("a", "b")


def _with_sets(pairs: DataFrame, one: DataFrame, two: DataFrame, column: str) -> DataFrame:
    """pairs, which are materialized, with n and the column of a's row in one (na, xa) and of b's row in two (nb, xb)."""
    one = one.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col(column).alias("xa"))
    two = two.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col(column).alias("xb"))
    sizes = pairs.groupBy("b").agg(F.count("*").alias("pairs"))
    both = join_hot(pairs, one, "a")
    # The second join's rows hold sets, so the pairs of each b are counted without them.
    return both.join(two, "b") if sizes.where(F.col("pairs") >= HOT_ROWS).isEmpty() else join_hot(materialize(both, "half-pairs"), two, "b")


def _near(x: str, y: str, n: str, m: str) -> Column:
    """Whether sets of n and m elements may be similar by their sketches x and y.

    Sets with similarity 3/4 differ in (n + m) / 7 shingles at most, and in no fewer than their parity sketches do.
    """
    differ = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(SKETCH // 64)), F.lit(0))
    return 7 * differ <= F.col(n) + F.col(m)


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not yet in one component."""
    a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    known = join_hot(materialize(join_hot(materialize(pairs, "pairs"), a, "a", "left"), "half-known"), b, "b", "left")
    return known.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).drop("ra", "rb")


def _sizes_fit(x: Column, y: Column) -> Column:
    return 4 * F.least(x, y) >= 3 * F.greatest(x, y)


def _counted(rows: DataFrame) -> DataFrame:
    """The rows of tokens that two or more of them have, with c, their number. rows are read twice."""
    sizes = materialize(rows.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "list-sizes")
    return join_hot(rows, sizes, "token", size="c")


def _plausible_lists(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """token, doc, n, c (length of the list) of the sets that share enough of their prefix to be linked at all."""
    dealt = rows.select("token", "doc").repartitionByRange("token", "doc").sortWithinPartitions("token")
    shared = materialize(dealt.mapInArrow(_neighbours, "token long, doc long"), "prefix-postings")
    lists = _counted(shared)
    for _ in range(2):  # each round shortens the lists for the next
        enough = lists.groupBy("doc").agg(F.count("*").alias("held")).join(sizes, "doc")
        enough = enough.where(F.col("held") >= least_common(F.ceil(F.col("n") * 3 / 4))).select("doc", "n")
        kept = materialize(lists.select("token", "doc").join(enough, "doc"), "prefix-kept")
        discard(shared)
        shared, lists = kept, _counted(kept)
    return lists


def _light_pairs(lists: DataFrame, boundary: int) -> DataFrame:
    """Candidate pairs a, b, common from the short lists, less those that share too little of their prefixes."""
    short = lists.where(F.col("c") <= LIGHT)
    x, y = short.select("token", F.col("doc").alias("a"), F.col("n").alias("na")), short.select("token", F.col("doc").alias("b"), F.col("n").alias("nb"))
    met = x.join(y, "token").where((F.col("a") < F.col("b")) & _sizes_fit(F.col("na"), F.col("nb")) & (F.greatest("na", "nb") > boundary))
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("common"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    long = lists.where(F.col("c") > LIGHT).groupBy("doc").agg(F.count("*").alias("long"))
    pairs = pairs.join(long.toDF("a", "ha"), "a", "left").join(long.toDF("b", "hb"), "b", "left")
    most = F.col("common") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))  # long lists may hold more
    return pairs.where(most >= least_common(F.least("na", "nb"))).select("a", "b", "common")


def _rare_lists(members: DataFrame) -> DataFrame:
    """token, doc, n, own, room, c: lists within each group of members (at, doc, n, tokens), over the prefixes in order of rarity there.

    own: shingles that no other member of the group has. A partner can share the others at most, so it has room elements
    at most. Only shingles that two members hold make a list, and of lists with the same members one stays.
    """
    rows = members.select("at", "doc", "n", F.explode("tokens").alias("token"))
    rows = rows.withColumn("token", F.when(F.col("at") == 0, F.col("token")).otherwise(F.xxhash64("at", "token")))
    held = _counted(rows)
    per = Window.partitionBy("at", "doc")
    ranked = held.withColumns({"r": F.row_number().over(per.orderBy("c", "token")), "shared": F.count("*").over(per)})
    ranked = ranked.withColumns({"own": F.col("n") - F.col("shared"), "room": F.floor((7 * F.col("shared") - 3 * F.col("n")) / 3)})
    kept = ranked.where((F.col("r") + F.col("own") <= F.floor(F.col("n") / 4) + 1) & (4 * F.col("room") >= 3 * F.col("n"))).select("token", "doc", "n", "own", "room")
    kept = materialize(kept, "rare-prefixes")
    who = [F.bit_xor(F.xxhash64("doc", F.lit(k))).alias(f"x{k}") for k in range(2)]
    alike = kept.groupBy("token").agg(F.count("*").alias("c"), *who).where("c > 1").groupBy("c", "x0", "x1").agg(F.min("token").alias("token"))
    return join_hot(kept, materialize(alike.select("token", "c"), "rare-sizes"), "token", size="c")


def _may_link(n: Column, room: Column, other_n: Column, other_room: Column) -> Column:
    return _sizes_fit(n, other_n) & (n <= other_room) & (other_n <= room)


def _pivots(lists: DataFrame, turn: int) -> DataFrame:
    """Pairs of every member of a list with one of them, one with few shingles of its own: it lies near all others."""
    near = F.floor(F.col("own") * (1024 if turn == 1 else 16) / F.col("n"))
    pick = lists.groupBy("token").agg(F.min(F.struct(near.alias("near"), F.xxhash64("doc", F.lit(turn)).alias("h"), "doc", "n", "room")).alias("p"), F.count("*").alias("size"))
    met = join_hot(lists, materialize(pick, "pivots"), "token", size="size").where((F.col("doc") != F.col("p.doc")) & _may_link(F.col("n"), F.col("room"), F.col("p.n"), F.col("p.room")))
    return met.select(F.least("doc", "p.doc").alias("a"), F.greatest("doc", "p.doc").alias("b")).distinct()


def _open(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists whose members no one component joins yet: lists, root, main (the largest component there), size, outside."""
    marked = materialize(lists.drop("c", "own").join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc")), "marked")
    groups = marked.groupBy("token", "root").agg(F.count("*").alias("g"))
    main = groups.groupBy("token").agg(F.max(F.struct("g", "root")).alias("m"), F.sum("g").alias("size")).where("m.g < size")
    main = materialize(main.select("token", F.col("m.root").alias("main"), "size", (F.col("size") - F.col("m.g")).alias("outside")), "open-lists")
    return join_hot(marked, main, "token", size="size")


def _rest(lists: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of list members that no component joins yet. Lists within one component drop out first.

    Open lists that are long are split by the rarity of shingles within them. Then the largest component of a list is met
    by the rest, and the rest by itself, some pairs in each task. That their sketches are near is part of the join's
    condition, so other pairs are not even made.
    """
    parts, long = [], F.col("outside") > LONG
    for _ in range(MOST_SPLITS):
        open_ = materialize(_open(lists, roots), "open-members")
        parts.append(open_.where(~long))
        if open_.where(long).isEmpty():
            break
        members = open_.where(long).select(F.col("token").alias("at"), "doc").join(sets, "doc")
        lists = only_result(lambda members=members: _rare_lists(members), "rare-lists")
    else:
        parts.append(materialize(_open(lists, roots), "open-members"))
    return reduce(DataFrame.unionByName, [_pairs_of(part, sets) for part in parts]).distinct()


def _pairs_of(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Members outside a list's largest component with all its members, in blocks of BLOCK by BLOCK."""
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("long")
    sketched = open_.join(sets.select("doc", "sketch"), "doc").withColumns({"across": blocks("outside"), "down": blocks("size")})
    own = lambda n: F.pmod(F.xxhash64("doc"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    x = sketched.where("root <> main").select("token", own("across").alias("i"), each("down").alias("j"), F.col("doc").alias("a"), F.col("n").alias("na"), F.col("room").alias("ma"), F.col("root").alias("ra"), F.col("sketch").alias("sa"))
    y = sketched.select("token", each("across").alias("i"), own("down").alias("j"), F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("room").alias("mb"), F.col("root").alias("rb"), F.col("sketch").alias("sb"))
    met = x.join(y, ["token", "i", "j"]).where((F.col("ra") != F.col("rb")) & _may_link(F.col("na"), F.col("ma"), F.col("nb"), F.col("mb")) & _near("sa", "sb", "na", "nb"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


#: What tells rows apart, by columns without nulls: a join and a grouping by them share one shuffle.
ROW = ["no_id", "id", "tie"]


def _by_row(rows: DataFrame) -> DataFrame:
    """rows with their id and tie as the columns of ROW."""
    return rows.withColumns({"no_id": F.col("id").isNull(), "id": F.coalesce("id", F.lit(0).cast("long"))})


def _sets_of(slim: DataFrame, named: DataFrame) -> DataFrame:
    """Whole sets of the named classes, with their column long, from one row of each. Rows that are repeated very often are combined first.

    Texts of most other rows are not shuffled at all.
    """

    def texts(rows: DataFrame, classes: DataFrame) -> DataFrame:
        return _by_row(rows).join(_by_row(classes.select("id", "tie", "doc", "long")), ROW).dropDuplicates(ROW).select("doc", "long", "text")

    slim = maybe_in(slim, "tie", named.select("tie")).where("maybe").drop("maybe")
    seen = named.agg(F.sum("held").alias("n"), F.max("held").alias("most")).first()  # two numbers
    least = max(HOT_ROWS, -(-(seen["n"] or 0) // HOT_KEYS))
    if (seen["most"] or 0) < least:
        found = texts(slim, named)
    else:
        often = named.where(F.col("held") >= least)  # HOT_KEYS classes at most
        ties = F.broadcast(often.select("tie").distinct())
        found = texts(slim.join(ties, "tie", "left_anti"), named.join(ties, "tie", "left_anti"))
        found = found.unionByName(texts(slim.join(ties, "tie", "left_semi").dropDuplicates(["id", "tie"]), named.join(ties, "tie", "left_semi")))
    return materialize(found.mapInArrow(_whole_sets, "doc long, long boolean, n int, tokens array<long>, sketch array<long>"), "whole-sets")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tie (hash of the text), n (size of the set), group (null for an empty set) and component_id of every row of docs."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("tie"), "text")
    keyed = materialize(slim.mapInArrow(_keys, "id long, tie long, n int, digest binary"), "set-keys")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "tie")).alias("r")
    named = keyed.where("n > 0").groupBy("digest").agg(first, F.first("n").alias("n"), F.count("*").alias("held"))
    named = materialize(named.select(F.monotonically_increasing_id().alias("doc"), "digest", "n", "held", "r.id", "r.tie"), "set-classes")
    prefixes = slim.select("text").mapInArrow(_prefixes, "digest binary, prefix array<long>").groupBy("digest").agg(F.first("prefix").alias("prefix"))  # equal sets, equal prefixes
    rows = prefixes.join(named.select("digest", "doc"), "digest").select("doc", F.explode("prefix").alias("token"))
    lists = only_result(lambda: _plausible_lists(rows, named.select("doc", "n")), "prefix-lists")
    boundary = _boundary(named, lists)
    small = named.where(F.col("n") <= boundary).withColumn("long", F.lit(False))
    links = materialize(_small_links(_sets_of(slim, small), boundary) if boundary else small.where(F.lit(False)).select(F.col("doc").alias("a"), F.col("doc").alias("b")), "small-links")
    light = materialize(_light_pairs(lists, boundary), "light-pairs")
    wanted = lists.where(F.col("c") > LIGHT).select("doc", F.lit(True).alias("long"))
    for end in ("a", "b"):
        wanted = wanted.union(light.select(end, F.lit(False)))
    wanted = materialize(named.join(wanted.groupBy("doc").agg(F.max("long").alias("long")), "doc").drop("digest"), "wanted-classes")
    discard(lists)
    sets = _sets_of(slim, wanted)
    rare = only_result(lambda: _rare_lists(sets.where("long").withColumn("at", F.lit(0).cast("long"))), "rare-lists")
    best = light.groupBy("a").agg(F.max(F.struct("common", F.col("b")))["b"].alias("b"))
    first = best.unionByName(_pivots(rare, 1))
    links = materialize(links.unionByName(_similar(first, sets)), "links-1")
    roots = connected(links)
    more = _apart(light.select("a", "b").unionByName(_pivots(rare, 2)), roots)
    links = materialize(links.unionByName(_similar(more, sets)), "links-2")
    roots = connected(links)
    last = materialize(_similar(_rest(rare, roots, sets), sets), "links-3")
    if not last.isEmpty():
        roots = connected(links.unionByName(last))
    # Back to rows: a component has the smallest id of its classes.
    named = materialize(named.select("digest", "doc", "held", "id").join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc")), "class-roots")
    least = materialize(named.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("size")), "components")
    named = materialize(join_hot(named.drop("id", "doc"), least, "root", size="size").select("digest", "held", F.col("root").alias("group"), "component_id"), "class-components")
    out = join_hot(keyed.where("n > 0"), named, "digest", size="held").select("id", "tie", "n", "group", "component_id")
    return out.unionByName(keyed.where("n = 0").select("id", "tie", "n", F.lit(None).cast("long").alias("group"), F.col("id").alias("component_id")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id (the smallest id reachable by links) of every row of docs."""
    return jaccard_groups(docs, id_col, text_col).select("id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id, then of the smallest hash of text and row.

    Rows with an empty set are linked with nothing and stay, all of them. So does a row that is the only one with its id
    and text and the first of its group; only rows that go or are repeated, and few others, are shuffled with their texts.
    """
    groups = only_result(lambda: jaccard_groups(docs, id_col, text_col), "groups")
    rows = _by_row(groups.where("group is not null").select("id", "tie", "group"))
    best = materialize(rows.groupBy("group").agg(F.min(F.struct(*ROW)).alias("r")).select("r.*"), "first-rows")
    held = rows.groupBy(*ROW).agg(F.count("*").alias("held"))
    single = best.withColumn("stays", F.lit(True))
    unsettled = materialize(held.join(single, ROW, "left").where("stays is null or held > 1").select("tie"), "unsettled-rows")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    marked = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("tie"), packed(docs).alias("row"), row_hash(docs).alias("h"), blank.alias("blank"))
    marked = maybe_in(marked, "tie", unsettled)
    chosen = _by_row(marked.where("maybe and not blank")).groupBy(*ROW).agg(F.min_by("row", "h").alias("row")).join(best, ROW, "left_semi")
    return chosen.select("row").union(marked.where("blank or not maybe").select("row")).select(*unpacked(F.col("row"), docs.columns))
