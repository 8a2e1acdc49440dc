"""Toxicity of texts: logistic regression, trained by FTRL-proximal steps on hashed word n-grams and skip-grams.

Features of a text are the distinct 64-bit hashes of its terms, of pairs of neighbouring terms and of pairs with one term
between them. Coordinates are the features that at least MIN_TOXIC toxic training texts share: others could only lower
a score, and no weight that rests on few texts can be trusted. Every coordinate has its own learning rate (it falls with
the squares of its gradients) and an L1 threshold below which its weight stays exactly zero, so the model is a short
sorted list.

Training takes at most ``most`` labelled rows, those with the smallest hashes of their ids, the same at every run. They
are dealt to SHARDS groups, each held as one row; in each epoch every group takes its steps from the common state, and
changes are averaged over the groups that touched a coordinate. State and model have as many numbers as there are coordinates, which
the bound on labelled rows bounds. Scoring reads the broadcast weights alone: one pass over the texts, no shuffle.

Defined results: a null or empty text has no features and the score of the bias; texts may be of any length; ids may be null or
repeat (a row of labels counts for every text with its id; of several labels of one id, and of equal texts, the highest
counts); rows without a label are not learnt from; if all labelled texts are toxic or none is, every score is 1 or 0, and
0.5 without any; an empty table gives an empty table. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.llm.shared import discard, materialize
from placeweave.llm.terms import find_terms, hashes, stretches, text_bytes

#: Labelled rows that training takes at most.
MOST_LABELLED = 50_000
#: Toxic training texts that share a feature at least.
MIN_TOXIC = 4
#: Groups that train side by side, and passes over them.
SHARDS, EPOCHS = 8, 6
#: Learning rate, its offset, and strengths of L1 and L2.
ALPHA, BETA, L1, L2 = 3.0, 1.0, 2.0, 0.1
_STEP, _SKIP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes, their weights, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def _pairs(a: np.ndarray, b: np.ndarray, factor: np.uint64) -> np.ndarray:
    h = (a ^ (a >> np.uint64(29))) * factor + b
    return h ^ (h >> np.uint64(32))


def text_features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For some texts at a time: the features of all, one after the other (not distinct), and the number of the text of each."""
    for a, b in stretches(texts, len(texts), 4_000_000):
        data, start, end, counts = find_terms(texts[a:b])
        h, of = hashes(data, start, end), np.repeat(np.arange(a, b, dtype=np.int32), counts)
        near, far = of[1:] == of[:-1], of[2:] == of[:-2]
        pairs, skips = _pairs(h[:-1][near], h[1:][near], _STEP), _pairs(h[:-2][far], h[2:][far], _SKIP)
        yield np.concatenate([h, pairs, skips]), np.concatenate([of, of[1:][near], of[2:][far]])


def known_features(texts: list[bytes], known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As text_features, distinct, by place in the sorted list ``known``; features that are not there are left out."""
    high = np.uint64(42)
    there = np.zeros(1 << 22, bool)
    there[known >> high] = True
    for h, of in text_features(texts):
        maybe = np.flatnonzero(there[h >> high])
        h, of = h[maybe], of[maybe]
        at = np.searchsorted(known, h)
        hit = known[np.minimum(at, len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
        both = np.unique(of[hit].astype(np.int64) << 32 | at[hit])
        yield both & 0xFFFFFFFF, both >> 32


@dataclass
class Ftrl:
    """The state of FTRL-proximal over numbered coordinates; the last one is the bias, which L1 leaves alone."""

    z: np.ndarray
    n: np.ndarray

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        threshold = np.full(len(self.z), L1)
        threshold[-1] = 0.0
        threshold = threshold[at] if isinstance(at, slice) else np.where(at == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= threshold, 0.0, -(z - np.sign(z) * threshold) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def step(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = _sigmoid(w.sum()) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _sigmoid(x: np.ndarray | float) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def sample_labels(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """id and label (0 or 1) of at most ``most`` ids, those with the smallest hashes."""
    rows = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    one = rows.where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    return one.orderBy(F.xxhash64("id"), "id").limit(most)


def _toxic_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct features of each text, one row each."""
    for batch in batches:
        for h, of in text_features(text_bytes(batch.column(0))):
            order = np.lexsort((h, of))
            h, of = h[order], of[order]
            new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))[: len(h)]
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64))], ["feature"])


def _rows_of(known: np.ndarray):  # noqa: ANN202
    """text, label, turn -> turn, label and the places of the text's features in known, the bias last."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(0))
            lists: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
            for at, of in known_features(texts, known):
                edges = np.flatnonzero(np.diff(of, prepend=-1))
                for i, part in zip(of[edges].tolist(), np.split(at, edges[1:]), strict=True) if len(of) else ():
                    lists[i] = part
            flat = [np.append(x, len(known)).astype(np.int32) for x in lists]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in flat])])
            at_list = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*flat, np.empty(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), at_list], ["turn", "label", "at"])

    return coded


def _packed(table: pa.Table) -> pa.Table:
    """A group's training rows, in order of their texts' hashes, as one row; of equal texts one is left, toxic if one of them is."""
    table = table.sort_by([("turn", "ascending"), ("label", "descending")])
    turn = table["turn"].to_numpy()
    table = table.filter(pa.array(np.append(True, turn[1:] != turn[:-1]))).combine_chunks()
    ends = np.cumsum(table["at"].combine_chunks().value_lengths().to_numpy()).astype(np.int64)
    flat = table["at"].combine_chunks().flatten().to_numpy().astype(np.int32)
    label = table["label"].to_numpy().astype(np.int8)
    return pa.table({"labels": [label.tobytes()], "ends": [ends.tobytes()], "at": [flat.tobytes()]})


def _epoch(state: Ftrl):  # noqa: ANN202
    """Each group's steps from the common state -> the coordinates it changed, with the change of z and n."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                mine = Ftrl(state.z.copy(), state.n.copy())
                texts = np.split(np.frombuffer(row["at"], np.int32), np.frombuffer(row["ends"], np.int64)[:-1])
                for at, label in zip(texts, np.frombuffer(row["labels"], np.int8).tolist(), strict=True):
                    mine.step(at, label)
                moved = np.flatnonzero(mine.n != state.n)
                yield pa.RecordBatch.from_arrays([pa.array(moved, pa.int64()), pa.array(mine.z[moved] - state.z[moved]), pa.array(mine.n[moved] - state.n[moved])], ["at", "dz", "dn"])

    return steps


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_LABELLED) -> Model:
    """The model of labels (1 is toxic) of docs. Give only labels that may be learnt from."""
    chosen = materialize(sample_labels(labels, id_col, label_col, most), "chosen-labels")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # At most ``most`` rows of two numbers are broadcast, so the texts stay where they are and are read when they are needed.
    rows = texts.join(F.broadcast(chosen), "id").select("text", "label", F.xxhash64("text").alias("turn"))
    seen = {r["label"]: r["c"] for r in rows.groupBy("label").agg(F.count("*").alias("c")).collect()}  # two numbers
    if len(seen) < 2:
        share = 0.5 if not seen else float(1 in seen)
        return Model(np.empty(0, np.uint64), np.empty(0), {0.0: -500.0, 0.5: 0.0, 1.0: 500.0}[share])
    toxic = rows.where("label = 1").select("text", "turn").dropDuplicates(["turn"]).select("text")
    shared = toxic.mapInArrow(_toxic_features, "feature long").groupBy("feature").agg(F.count("*").alias("c"))
    listed = shared.where(F.col("c") >= MIN_TOXIC).select("feature").toArrow()["feature"].to_numpy()  # bounded by the sample's texts
    known = np.sort(listed.view(np.uint64))
    coded = rows.mapInArrow(_rows_of(known), "turn long, label int, at array<int>").groupBy(F.pmod(F.shiftright("turn", 7), F.lit(SHARDS)))
    groups = materialize(coded.applyInArrow(_packed, "labels binary, ends binary, at binary").repartition(SHARDS), "training-groups")
    state = Ftrl(np.zeros(len(known) + 1), np.zeros(len(known) + 1))
    for _ in range(EPOCHS):
        moves = groups.mapInArrow(_epoch(state), "at long, dz double, dn double")
        mean = moves.groupBy("at").agg(F.avg("dz").alias("dz"), F.avg("dn").alias("dn")).toArrow()  # a row a coordinate
        at = mean["at"].to_numpy()
        state.z[at] += mean["dz"].to_numpy()
        state.n[at] += mean["dn"].to_numpy()
    discard(chosen, groups)
    weights = state.weights(slice(None))
    used = np.flatnonzero(weights[:-1])
    return Model(known[used], weights[used], float(weights[-1]))


def score(model: Model, text: Column) -> Column:
    """The probability that text is toxic, as a column."""

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = text_bytes(batch)
            margin = np.full(len(texts), model.bias)
            for at, of in known_features(texts, model.features):
                margin += np.bincount(of, model.weights[at], len(texts))
            yield pa.array(_sigmoid(margin))

    scored.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(scored, "double")(text)
