"""What the driver holds for a query does not follow the tables: no whole table is broadcast, and few copies of a plan are made."""

from pyspark.sql import functions as F

from placeweave.operators import resolution
from placeweave.plans import catalog, resolving
from placeweave.plans.adapters import adapt

DATA = "/root/testdata/sf0.001"


def plans(df):
    df.collect()
    run = df._jdf.queryExecution()
    return run.optimizedPlan().toString(), run.executedPlan().toString()


def test_refresh_holds_few_copies_of_the_mentions_and_venues(spark):
    plan = catalog.queries()["E20_refresh"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [c_custkey") <= 20 and plan.count("Relation [p_partkey") <= 60


def test_whole_tables_are_shuffled_though_their_files_are_small(spark):
    for df in (adapt(spark, DATA, "mentions"), resolving._venues(spark, DATA), resolving._staged(spark, DATA)):
        assert "BroadcastHashJoin" not in plans(df)[1]


def test_pools_are_broadcast_and_venues_are_not(spark):
    placed = resolution.place_mentions(resolving._todo(spark, DATA), adapt(spark, DATA, "contexts"), resolving.CONFIG)
    members = resolution.pool_members(placed, resolution.place_candidates(resolving._venues(spark, DATA)), resolving.CONFIG)
    logical = plans(members)[0]
    assert "strategy=broadcast" in logical and "Union" not in logical


def test_possible_pools_hold_all_that_mentions_have(spark):
    contexts = spark.createDataFrame([("a", "Cabo Frio", "RJ"), ("b", "Iguaba Grande", None), ("c", "Nowhere", "RJ"), ("d", "cabo frio rj", "RJ")], "source_key string, city string, state string")
    rows = [(i, f"p{i % 3}", s, "x", None, None) for i, s in enumerate(["a", "b", "c", "d", None, "other"] * 3)]
    m = spark.createDataFrame(rows, "activity_id long, product_key string, source_key string, raw_text string, raw_address_text string, hint string")
    v = spark.createDataFrame([("p0",), ("p1",), ("p1",), ("p7",)], "product_key string")
    for free in (False, True):
        config = resolution.ResolutionConfig(allow_cross_city=free)
        of = lambda df: {tuple(r) for r in df.select(*resolution.POOL, F.to_json("centre")).collect()}
        got, held = of(resolution.possible_pools(v, contexts, config)), of(resolution.place_mentions(m, contexts, config))
        assert {p for p in held if p[0] in ("p0", "p1")} <= got and {p[0] for p in got} == {"p0", "p1", "p7"}
        assert resolution.possible_pools(v, None, config).count() == 3
