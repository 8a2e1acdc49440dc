"""Results that are far larger than their inputs are made by many tasks, from bounded pieces."""

from collections import Counter

from pyspark.sql import functions as F

from placeweave.operators import nearby


def test_pairs_around_centres_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearby, "BLOCK", 3)
    centres = [(i, 1.0, 2.0) for i in range(8)] + [(8, 1.0, 2.001), (9, 5.0, 5.0), (7, 1.0, 2.0), (10, None, 2.0)]  # 7 comes twice
    points = [(i, f"p{i}", 1.0, 2.0) for i in range(10)] + [(3, "p3", 1.0, 2.0), (11, None, 1.0, 2.0011), (None, "x", 0.0, 0.0), (12, "y", None, 2.0)]
    c = spark.createDataFrame(centres, "centre_id long, centre_lat double, centre_lng double").coalesce(1)
    p = spark.createDataFrame(points, "venue_id long, name string, lat double, lng double").coalesce(1)
    met = nearby.within_radius(c, p, 300.0)
    near = lambda a, b: None not in (*a, *b) and abs(a[0] - b[0]) < 0.002 and abs(a[1] - b[1]) < 0.002
    want = Counter((i, k, name) for i, *a in centres for k, name, *b in points if near(a, b))
    assert Counter((r["centre_id"], r["venue_id"], r["name"]) for r in met.collect()) == want and want[7, 3, "p3"] == 4
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(_points") < plan.index("RepartitionByExpression") < plan.index("Join Inner")
    blocks = nearby._blocks(p.where("lat = 1.0 and lng = 2.0"), ["lat", "lng"], "_points").select(F.size("_points").alias("n")).collect()
    assert sum(r["n"] for r in blocks) == 11 and max(r["n"] for r in blocks) <= 3


def test_only_places(spark):
    c = spark.createDataFrame([(1, 0.0, 0.0)], "centre_id long, centre_lat double, centre_lng double")
    p = spark.createDataFrame([(0.0, 0.0), (-0.0, 0.001), (0.0, 0.0)], "lat double, lng double")
    assert nearby.within_radius(c, p, 300.0).select("centre_id", "lat", "lng").count() == 3
