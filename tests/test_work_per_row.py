"""Plans that read their rows once, in more than one task, and say things once."""

import pytest
from pyspark.sql import functions as F

from placeweave.functions.text import trigrams
from placeweave.plans import catalog

DATA = "/root/testdata/sf0.001"


def _plan(spark, name):
    return catalog.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["B23_post_items", "B23_skipped", "G20_collector_statistics"])
def test_posts_are_read_once(spark, name):
    assert _plan(spark, name).count("Relation [") == 1


@pytest.mark.parametrize("name", ["B16_sub_blocks", "B17_labelled_schedule", "B18_structured_blocks", "B20_narrative", "B23_post_items"])
def test_posts_are_dealt_before_they_are_read(spark, name):
    assert "RepartitionByExpression" in _plan(spark, name)


def test_trigrams_of_characters_beyond_the_basic_plane(spark):
    got = spark.createDataFrame([("a𝒜b",), ("x",), ("",), (None,)], "t string").select(trigrams(F.col("t")).alias("g")).collect()
    assert [r["g"] for r in got] == [[" a𝒜", "a𝒜b", "𝒜b "], [" x "], [], None]


def test_equal_places_meet_once(spark):
    """Distances between places come before the joins that give each centre and point its row."""
    from placeweave.operators import nearby

    c = spark.createDataFrame([(i, 1.0, 2.0) for i in range(3)], "centre_id long, centre_lat double, centre_lng double")
    p = spark.createDataFrame([(i, 1.0, 2.001) for i in range(4)], "venue_id long, lat double, lng double")
    met = nearby.within_radius(c, p, 300.0)
    assert met.count() == met.select("centre_id", "venue_id").distinct().count() == 12
    assert met._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") >= 2


@pytest.mark.parametrize("name", ["E18_outcomes", "E22_metrics", "E23_batch_summary"])
def test_outcomes_are_told_before_mentions_fan_out(spark, name):
    """The metrics of candidates are aggregated below the join with all mentions on the speaker."""
    plan = _plan(spark, name).splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    spoken = min(depth(x) for x in plan if "Join" in x and "speaker" in x)
    assert min(depth(x) for x in plan if "Aggregate" in x and "n_candidates" in x or "Aggregate" in x and "max(" in x and "rank" in x) > spoken


def test_names_are_compared_in_many_tasks(spark):
    assert "RepartitionByExpression" in _plan(spark, "E28_english_names")
