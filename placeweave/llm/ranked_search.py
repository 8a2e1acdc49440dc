"""Ranked lexical search: a tree of largest impacts over ranges of documents for each term, descended best bound first.

The index has, for every range of up to RANGE documents and every term in it, the term's postings and its largest impact
there. An impact is what one occurrence count adds to a score before it is multiplied by the term's weight; as weights
come from the collection's counts at the time of a search, the same index serves any query.

A search adds up, for every query and range, weight times largest impact over the query's terms: no document of the
range can score more. The range with the highest bound of each query is searched first; the score of its k-th document,
if it has so many, is a floor for all others. Then only ranges whose bound reaches the floor are read. Inside a range the tree has
two more levels (NODE and LEAF documents), built from the postings; nodes wait in a queue by their bound, the best are
opened, and their children join the queue. A leaf that is opened has all its documents scored exactly. The search of a range ends
when the best bound is below the k-th score found; nodes whose bound equals it are opened too, because a smaller id wins a tie.

No task holds more than one range of documents; a query's rows are shuffled with the ranges they need, and results are k
rows a query and range at most.

Scores: w = floor(1000 ln((2N + 2) / (2 df + 1))) for a term, summed over the query's distinct terms with
w * (10^9 tf div (1000 tf + 20 m)), m = 50 + 50 n N div L, in 64-bit whole numbers (see ``terms`` for what a term is).

Defined results: a null or blank text has no terms: such a document is never found and such a query has no rows; texts may be of
any length; queries with one id are separate only if they differ in text; documents with one id are separate rows; null ids of
documents come last among ties; an empty table of documents or queries gives an empty result. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeweave.llm.lexicon import spread
from placeweave.llm.shared import discard, materialize
from placeweave.llm.terms import as_strings, find_terms, stretches, text_bytes

#: Documents in a range, in a node and in a leaf of the tree, and bytes of text in a range (one longer text is a range).
RANGE, NODE, LEAF = 4096, 256, 16
RANGE_BYTES = 8_000_000
#: Leaves that are opened at once, the best of the queue.
WAVE = 16
_NODES, _LEAVES = RANGE // NODE, RANGE // LEAF


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """The impact of tf occurrences in texts of n terms, among docs texts with total terms."""
    m = 50 + (50 * n.astype(np.int64) * docs) // max(total, 1)
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and terms, of each batch."""
    for batch in batches:
        texts, docs, total = text_bytes(batch.column(0)), 0, 0
        for a, b in stretches(texts, RANGE, RANGE_BYTES):
            counts = find_terms(texts[a:b])[3]
            docs, total = docs + int((counts > 0).sum()), total + int(counts.sum())
        yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([total], pa.int64())], ["docs", "total"])


def _binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """values, cut into runs of counts, as one binary cell each."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))])


_INDEX = "range long, term string, df int, most long, docs binary, tfs binary, ids array<long>"


def _index_range(number: int, ids: pa.Array, texts: list[bytes], docs: int, total: int) -> Iterator[pa.RecordBatch]:
    """The rows of one range: one for each term, and one without a term that has the documents' ids and sizes."""
    data, start, end, counts = find_terms(texts)
    coded = as_strings(data, start, end).dictionary_encode()
    of = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
    pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * RANGE + of, return_counts=True)
    term, doc = pairs // RANGE, pairs % RANGE
    df = np.bincount(term, minlength=len(coded.dictionary))
    most = np.maximum.reduceat(impacts(tf, counts[doc], docs, total), np.cumsum(df) - df) if len(df) else np.empty(0, np.int64)
    n = len(df)
    columns = [
        pa.array(np.full(n + 1, number)), pa.concat_arrays([coded.dictionary.cast(pa.large_string()), pa.nulls(1, pa.large_string())]).cast(pa.string()),
        pa.array(np.append(df, 0), pa.int32()), pa.array(np.append(most, 0)), pa.concat_arrays([_binaries(doc.astype(np.uint16), df), pa.nulls(1, pa.large_binary())]).cast(pa.binary()),
        pa.concat_arrays([_binaries(tf.astype(np.uint32), df), _binaries(counts.astype(np.uint32), np.array([len(texts)]))]).cast(pa.binary()),
        pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), ids)]),
    ]
    whole = pa.RecordBatch.from_arrays(columns, ["range", "term", "df", "most", "docs", "tfs", "ids"])
    for at in range(0, n + 1, 20_000):
        yield whole.slice(at, 20_000)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """The index of docs, how many of them have a term, and how many terms they have. Ranges follow the partitions of docs."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = rows.select("text").mapInArrow(_sizes, "docs long, total long").agg(F.sum("docs"), F.sum("total")).first()  # two numbers
    n_docs, total = found[0] or 0, found[1] or 0

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, ids = text_bytes(batch.column(1)), batch.column(0)
            for a, b in stretches(texts, RANGE, RANGE_BYTES):
                yield from _index_range(number, ids.slice(a, b - a), texts[a:b], n_docs, total)
                number += 1

    return materialize(rows.mapInArrow(ranges, _INDEX), "search-index"), n_docs, total


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """q, text -> q and each distinct term of the text."""
    for batch in batches:
        texts = text_bytes(batch.column(1))
        for a, b in stretches(texts, RANGE, RANGE_BYTES):
            data, start, end, counts = find_terms(texts[a:b])
            q = batch.column(0).slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), counts)))
            pairs = pa.table({"q": q, "term": as_strings(data, start, end).cast(pa.string())}).group_by(["q", "term"]).aggregate([])
            yield from pairs.combine_chunks().to_batches()


class _Range:
    """The postings of the terms asked for in one range, and the levels of their trees."""

    def __init__(self, rows: pa.Table, n_docs: int, total: int) -> None:
        is_term = rows["term"].is_valid()
        listed, head = rows.filter(is_term), rows.filter(pc.invert(is_term))
        self.ids = head["ids"][0].values.to_pylist()
        sizes = np.frombuffer(head["tfs"][0].as_py(), np.uint32)
        self.row = {t: i for i, t in enumerate(listed["term"].to_pylist())}
        df = listed["df"].to_numpy()
        doc = np.frombuffer(b"".join(listed["docs"].to_pylist()), np.uint16).astype(np.int64)
        tf = np.frombuffer(b"".join(listed["tfs"].to_pylist()), np.uint32)
        self.impact = impacts(tf, sizes[doc], n_docs, total)
        self.key = np.repeat(np.arange(len(df), dtype=np.int64) * RANGE, df) + doc  # rising: terms by row, documents within
        self.leaf = np.zeros((len(df), _LEAVES), np.int64)
        if len(df):
            cell = self.key // LEAF
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            self.leaf.reshape(-1)[cell[first]] = np.maximum.reduceat(self.impact, first)
        self.node = self.leaf.reshape(len(df), _NODES, NODE // LEAF).max(axis=2) if len(df) else np.zeros((0, _NODES), np.int64)

    def best(self, terms: list[str], weights: list[int], k: int, floor: int) -> list[tuple[int, int]]:
        """(score, document) of the k best documents that reach floor, more only where the last ones tie."""
        known = [(self.row[t], w) for t, w in zip(terms, weights, strict=True) if t in self.row]
        if not known:
            return []
        row, w = (np.array(c, np.int64) for c in zip(*known, strict=True))
        least, wide = max(floor, 1), NODE // LEAF
        scores, docs = np.empty(0, np.int64), np.empty(0, np.int64)
        queue = [(-b, 0, i) for i, b in enumerate((w @ self.node[row]).tolist()) if b >= least]
        heapq.heapify(queue)
        while queue and -queue[0][0] >= least:
            leaves = []
            while queue and len(leaves) < WAVE and -queue[0][0] >= least:
                _, level, i = heapq.heappop(queue)
                if level:
                    leaves.append(i)
                    continue
                for j, b in enumerate((w @ self.leaf[row, i * wide : (i + 1) * wide]).tolist(), i * wide):
                    if b >= least:
                        heapq.heappush(queue, (-b, 1, j))
            s, d = self._scores(row, w, np.array(leaves, np.int64))
            scores, docs = np.concatenate([scores, s[s >= least]]), np.concatenate([docs, d[s >= least]])
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, -k)[-k]))
                scores, docs = scores[scores >= least], docs[scores >= least]
        return list(zip(scores.tolist(), docs.tolist(), strict=True))

    def _scores(self, row: np.ndarray, w: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores of all documents of the leaves, and the documents."""
        first = row[:, None] * RANGE + leaves * LEAF
        a, b = np.searchsorted(self.key, first).ravel(), np.searchsorted(self.key, first + LEAF).ravel()
        at = spread(a, b - a)
        cell = np.repeat(np.tile(np.arange(len(leaves)) * LEAF, len(row)), b - a) + self.key[at] % LEAF
        scores = np.zeros(len(leaves) * LEAF, np.int64)
        np.add.at(scores, cell, np.repeat(np.repeat(w, len(leaves)), b - a) * self.impact[at])
        return scores, (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()


def _search_ranges(k: int, n_docs: int, total: int):  # noqa: ANN202
    """One range's postings and the queries asked of it -> the best k documents of each query there."""

    def search(postings: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[int, int | None, int]] = []
        if asked.num_rows:
            there = _Range(postings, n_docs, total)
            for q, floor, terms, weights in zip(*(asked[c].to_pylist() for c in ("q", "floor", "terms", "weights")), strict=True):
                hits = [(s, there.ids[d]) for s, d in there.best(terms, weights, k, floor)]
                hits.sort(key=lambda h: (-h[0], h[1] is None, h[1] or 0))
                found += [(q, i, s) for s, i in hits[:k]]
        q, i, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"q": pa.array(q, pa.int64()), "id": pa.array(i, pa.int64()), "score": pa.array(s, pa.int64())})

    return search


def search(index: tuple[DataFrame, int, int], queries: DataFrame, k: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """query_id, rank (from 1), id and score of the k best documents of every row of queries, those with a score above 0."""
    table, n_docs, total = index
    asked = materialize(queries.select(F.col(f"`{id_col}`").alias("query_id"), F.col(f"`{text_col}`").alias("text")).distinct().withColumn("q", F.monotonically_increasing_id()), "search-queries")
    terms = materialize(asked.select("q", "text").mapInArrow(_query_terms, "q long, term string"), "query-terms")
    wanted = terms.select("term").distinct()
    # Only the narrow columns are read here: postings stay where they are.
    roots = materialize(table.where("term is not null").select("range", "term", "df", "most").join(wanted, "term", "left_semi"), "search-roots")
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weighed = roots.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.alias("w")).where("w > 0")
    weighed = materialize(terms.join(weighed, "term").select("q", "term", "w"), "query-weights")
    whole = weighed.groupBy("q").agg(F.collect_list(F.struct("term", "w")).alias("t")).select("q", F.col("t.term").alias("terms"), F.col("t.w").alias("weights"))
    bounds = roots.join(weighed, "term").groupBy("q", "range").agg(F.sum(F.col("w") * F.col("most")).alias("bound"))
    bounds = materialize(bounds, "search-bounds")
    first = bounds.groupBy("q").agg(F.max(F.struct("bound", "range"))["range"].alias("range"))

    def read(asks: DataFrame) -> DataFrame:
        """asks: q, range, floor."""
        asks = materialize(asks.join(whole, "q"), "search-asks")
        need = asks.select("range", F.explode("terms").alias("term")).distinct()
        lists = table.join(need, ["range", "term"], "left_semi").unionByName(table.where("term is null").join(asks.select("range").distinct(), "range", "left_semi"))
        ranges = lists.groupBy("range").cogroup(asks.groupBy("range"))
        return materialize(ranges.applyInArrow(_search_ranges(k, n_docs, total), "q long, id long, score long"), "search-hits")

    order = [F.desc("score"), F.asc_nulls_last("id")]
    seeds = read(first.select("q", "range", F.lit(0).cast("long").alias("floor")))
    floors = seeds.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("r") == k).select("q", F.col("score").alias("floor"))
    rest = bounds.join(first, ["q", "range"], "left_anti").join(floors, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(0)).cast("long"))
    hits = seeds.unionByName(read(rest.where("bound > 0 and bound >= floor").select("q", "range", "floor")))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
    discard(roots)
    return ranked.join(asked.select("q", "query_id"), "q").select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def search_documents(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Index docs and search them for every row of queries."""
    return search(build_index(docs), queries, k)
