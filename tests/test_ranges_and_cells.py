"""Running sums and pages by ranges, points around many centres, farthest pairs: against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from placeweave.operators import nearby, publishing, ranges, review
from placeweave.sources import collect


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_budget_of_one_provider_is_many_tasks(spark):
    rnd = random.Random(1)
    rows = [(None if i % 97 == 0 else "big" if i % 3 else f"p{i % 7}", i * 5 % 6007, round(rnd.random(), 3)) for i in range(6007)]
    calls = spark.createDataFrame(rows, "provider string, seq long, cost double")
    got = {r["seq"]: r for r in collect.budget_gate(calls, 500.0, 0.8).collect()}
    spent = {}
    for provider, seq, cost in sorted(rows, key=lambda r: r[1]):
        s = round(spent.get(provider, 0.0), 6)
        assert abs(got[seq]["spent"] - s) < 1e-6 and got[seq]["allowed"] == (round(s + cost, 6) <= 500.0)
        spent[provider] = spent.get(provider, 0.0) + cost
    cut = calls.withColumn("r", ranges.range_number(F.col("seq"), ranges.boundaries(calls, "seq")))
    sizes = [r["count"] for r in cut.where("provider = 'big'").groupBy("r").count().collect()]
    assert len(sizes) >= 32 and max(sizes) < 6007 / 20
    assert collect.budget_gate(calls.where("seq < 0"), 500.0, 0.8).count() == 0


@pytest.mark.parametrize("descending", [True, False])
def test_pages_are_those_of_a_sorted_list(spark, descending):
    rows = [(i, None if i % 50 == 0 else 7 if i % 3 == 0 else i % 211) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v int").repartition(5)
    want = sorted(rows, key=lambda r: (r[1] is None, (-r[1] if descending else r[1]) if r[1] is not None else 0, r[0]))
    for page in (review.Page(1, 20), review.Page(75, 20), review.Page(150, 20), review.Page(200, 20), review.Page(30, 100)):
        got = [(r["id"], r["v"], r["total_rows"], r["total_pages"]) for r in review.page_with_total(df, page, "id", "v", descending).collect()]
        assert got == [(*r, 3000, math.ceil(3000 / page.size)) for r in want[page.offset : page.offset + page.size]]
    assert review.page_with_total(df.where("id < 0"), review.Page(), "id", "v").count() == 0


@pytest.mark.parametrize("radius", [250.0, 40_000.0, 900_000.0])
def test_points_around_many_centres(spark, radius):
    rnd = random.Random(int(radius))
    spot = lambda: rnd.choice([(rnd.uniform(-90, 90), rnd.uniform(-180, 180)), (rnd.uniform(89, 90), rnd.uniform(-180, 180)), (rnd.uniform(-1, 1), rnd.choice([-180, 180]) + rnd.uniform(-0.01, 0.01)), (-22.88 + rnd.uniform(-0.01, 0.01), -42.02 + rnd.uniform(-0.01, 0.01))])
    wrap = lambda p: (p[0], (p[1] + 180) % 360 - 180)
    points, centres = [(i, *wrap(spot())) for i in range(600)], [(i, *wrap(spot())) for i in range(150)]
    p = spark.createDataFrame([*points, (9999, None, 3.0)], "id long, lat double, lng double")
    c = spark.createDataFrame([*centres, (9999, None, None)], "centre_id long, centre_lat double, centre_lng double")
    met = nearby.within_radius(c, p, radius)
    got = sorted((r["centre_id"], r["id"]) for r in met.collect())
    want = sorted((i, k) for i, *a in centres for k, *b in points if round(metres(a, b), 6) <= radius)
    assert got == want and len(want) > 100
    assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()


def test_farthest_of_many_points_of_one_name(spark):
    rnd = random.Random(5)
    ring = [(-22.9 + 0.2 * math.sin(t), -42.0 + 0.2 * math.cos(t)) for t in (rnd.uniform(0, 6.3) for _ in range(3000))]
    rows = [("ring", *p) for p in ring] + [("dense", -22.9 + rnd.random() ** 4, -42 + rnd.random() ** 4) for _ in range(2000)] + [("same", 1.0, 2.0)] * 3 + [("two", 0.0, 0.0), ("two", 10.0, 170.0), ("line", 1.0, 1.0), ("line", 1.0, 2.0), ("line", 1.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, lat double, lng double")
    got = {r["k"]: r["far_m"] for r in nearby.farthest(df.distinct(), "k").collect()}
    for k in ("ring", "dense", "same", "two", "line"):
        own = [r[1:] for r in rows if r[0] == k]
        assert abs(got[k] - max(metres(a, b) for i, a in enumerate(own) for b in own[i:])) < 1e-3, k


def test_duplicates_without_points(spark):
    df = spark.createDataFrame([(1, "Casa", None, None), (2, " casa ", 1.0, 1.0), (3, "Bar", 1.0, 1.0), (4, "bar", 1.0, 1.1)], "venue_id long, name string, lat double, lng double")
    got = {r["name_key"]: (r["members"], r["max_distance_m"]) for r in publishing.duplicate_venues(df).collect()}
    assert got["casa"] == (2, None) and got["bar"][0] == 2 and got["bar"][1] > 11_000
