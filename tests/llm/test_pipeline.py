"""The pipeline's stages against plain versions, and their defined results at the edges."""

import brute
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
CLEAN = "Every word in this line is different from all others that stand near it so the rules keep what it says here. "


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or ""), "x") for i, t in enumerate(texts)], SCHEMA)


def test_stages_keep_their_columns_and_take_effect(spark, tmp_path):
    other = CLEAN.replace("word", "term").replace("line", "row").replace("rules", "laws").replace("near", "by").replace("keep", "hold").replace("others", "more").replace("different", "apart")
    texts = [CLEAN, CLEAN + "Write to a.b@example.org now.", other, "short", None, "Home | About\n" + other.upper() + CLEAN[::-1]]
    docs = docs_of(spark, texts)
    one = corpus_pipeline.quality_rules(spark, docs, "")
    assert one.columns == docs.columns
    kept = {r["doc_id"]: r for r in one.collect()}
    assert {0, 1, 2} <= set(kept) and not {3, 4} & set(kept)
    assert 5 not in kept or "Home" not in kept[5]["text"]
    two = corpus_pipeline.near_duplicates(spark, one, "")
    roots = brute.components([(i, r["text"]) for i, r in kept.items()])
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(i for i, (_, c) in roots.items() if i == c)
    three = corpus_pipeline.personal_spans(spark, docs.where("doc_id in (0, 1)"), "")
    got = {r["doc_id"]: r for r in three.collect()}
    assert got[0]["text"] == CLEAN and got[1]["text"].endswith("Write to [EMAIL] now.") and got[1]["n_chars"] == len(got[1]["text"])
    four = corpus_pipeline.mixture(spark, docs_of(spark, [CLEAN] * 30), "")
    assert four.columns == docs.columns and 0 < four.count() < 30
    five = {r["doc_id"]: r for r in corpus_pipeline.token_ids(spark, docs, "").collect()}
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in five.values()) and five[4]["n_tokens"] == 0


def test_run_on_an_empty_and_a_null_table(spark, tmp_path):
    for n, rows in enumerate(([], [(None, None, None, None, None, None), (None, CLEAN, None, None, None, None), (7, CLEAN, None, None, None, None)])):
        folder = tmp_path / str(n)
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(folder / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        assert out.columns[:2] == ["doc_id", "source"] and out.count() <= len(rows)


def test_run_on_the_smallest_tables(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) > 20 and out.where(~F.col("round_trip")).count() == 0
