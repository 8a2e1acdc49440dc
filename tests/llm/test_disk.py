"""What the pipeline's joins shuffle and leave on disk: only texts that a join may change, and no table that is used up."""

import glob

import pytest
from pyspark.sql import functions as F

from placeweave.llm import ngram_join, shared

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def spied(monkeypatch, module):
    """What module's calls of maybe_in return."""
    made = []

    def maybe_in(*args):
        made.append(shared.maybe_in(*args))
        return made[-1]

    monkeypatch.setattr(module, "maybe_in", maybe_in)
    return made


def text_of(i):
    return " ".join(f"w{i}x{j}" for j in range(40))


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("n", [0, 1, 300, 5000])
def test_maybe_in_misses_no_key_and_lets_few_others_through(spark, n):
    rows = spark.range(20_000).select((F.col("id") * 7919 - 5).alias("k"), "id")
    out = shared.maybe_in(rows, "k", rows.where(F.col("id") < n).select("k"))
    assert out.columns == ["k", "id", "maybe"] and out.count() == 20_000
    assert out.where(F.col("maybe") & (F.col("id") < n)).count() == n
    assert out.where(F.col("maybe") & (F.col("id") >= n)).count() <= 20_000 / 16 * 1.2


def test_near_duplicates_shuffle_only_texts_that_may_go_and_leave_no_sets(spark, monkeypatch):
    texts = [text_of(i) for i in range(120)]
    texts += [texts[3], texts[5] + " more", " "]
    docs = docs_of(spark, texts).union(docs_of(spark, texts).where("doc_id = 7"))  # row 7 comes twice
    made, before = spied(monkeypatch, ngram_join), set(glob.glob(shared.shared_dir(spark).removeprefix("file:") + "/placeweave/*"))
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(120), 122]
    assert {7, 120, 121} <= {r["id"] for r in made[-1].where("maybe").collect()} and made[-1].where("maybe").count() <= 40
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(shared.shared_dir(spark).removeprefix("file:") + "/placeweave/*")) - before}
    assert left <= {"groups", "first-rows", "unsettled-rows"}


def test_personal_spans_shuffle_only_texts_that_may_have_some(spark, monkeypatch):
    docs = docs_of(spark, [text_of(i) + (" write to a.b@example.org now" if i % 40 == 0 else "") for i in range(120)])
    made = spied(monkeypatch, corpus_pipeline)
    got = {r["doc_id"]: r for r in corpus_pipeline.personal_spans(spark, docs, "").collect()}
    assert len(got) == 120 and made[-1].where("maybe").count() <= 40
    for i, r in got.items():
        assert r["text"] == text_of(i) + (" write to [EMAIL] now" if i % 40 == 0 else "") and r["n_chars"] == len(r["text"])
