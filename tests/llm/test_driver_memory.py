"""What the driver must not hold: tables that grow with the texts, as broadcasts."""

from pyspark.sql import functions as F

from placeweave.llm import collocations
from placeweave.llm.shared import materialize


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_and_phrases_are_not_broadcast(spark):
    n = F.col("id")
    words = materialize(spark.range(2000).select("id", F.lit("en").alias("lang"), F.concat(F.lit("w"), n).alias("word"), (n + 30).alias("f")), "words")
    rows = materialize(spark.range(3000).select((n % 2000).alias("a"), (n % 7).alias("b"), F.lit(40).cast("long").alias("f")), "pairs")
    two = collocations._with_word(rows, words, "a", "b", "fa", "word_a")
    assert "Broadcast" not in final_plan(two)
    assert {(r["a"], r["fa"], r["word_a"], r["lang"]) for r in two.collect()} == {(i, i + 30, f"w{i}", "en") for i in range(2000)} and two.count() == 3000
    longer = materialize(spark.range(100).select(n.alias("a"), (n % 7).alias("b"), F.lit(1).cast("long").alias("c"), F.lit(39).cast("long").alias("f")), "longer")
    kept = collocations._not_inside(rows, ["a", "b"], longer, [["a", "b"], ["b", "c"]])
    assert "Broadcast" not in final_plan(kept)
    inside = {(i, i % 7) for i in range(100)} | {(i % 7, 1) for i in range(100)}
    assert sorted((r["a"], r["b"]) for r in kept.collect()) == sorted((i % 2000, i % 7) for i in range(3000) if (i % 2000, i % 7) not in inside)
