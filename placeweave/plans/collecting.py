"""Sources, sinks and upserts (family A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeweave.operators import upserts as u
from placeweave.sources import collect as c
from placeweave.plans.adapters import adapt, with_tables
from placeweave.plans.registry import query


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("A01_queries", "SELECT r_regionkey, n_nationkey, n_name || ' em ' || r_name AS query_text FROM region CROSS JOIN nation")
def a01(spark, sf_dir):
    regions = _t(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region_label"))
    categories = _t(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("category_text"))
    return c.place_queries(regions, categories).select("r_regionkey", "n_nationkey", "query_text")


@query("A02_posts_since", "SELECT event_id, ts AS published_at FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def a02(spark, sf_dir):
    posts = _t(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("date_gmt"))
    since = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return c.posts_since(posts, since).select("event_id", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query("A04_enriched", "SELECT p_partkey, p_name, s_name FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def a04(spark, sf_dir):
    details = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), "s_name")
    return c.enrich(_t(spark, sf_dir, "part").select("p_partkey", "p_name"), details, "p_partkey")


@query("A05_first_seen", "SELECT l_partkey, min_by(l_returnflag, (o, l_returnflag)) AS l_returnflag, array_to_string((list(l_linestatus ORDER BY o, l_linestatus))[2:], ',') AS alternates FROM (SELECT *, l_orderkey * 10 + l_linenumber AS o FROM lineitem) GROUP BY l_partkey")
def a05(spark, sf_dir):
    found = _t(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), "l_returnflag", "l_linestatus")
    return c.first_seen(found, "l_partkey", "o", "l_linestatus").select("l_partkey", "l_returnflag", F.array_join("alternates", ",").alias("alternates"))


V = with_tables("venues")
_PLACES = "pl AS (SELECT CASE WHEN venue_id % 13 = 0 THEN NULL ELSE venue_id END AS place_id, '  ' || name || ' ' AS name, lat, lng, CASE venue_id % 5 WHEN 0 THEN 'CLOSED_PERMANENTLY' WHEN 1 THEN NULL ELSE 'CLOSED_TEMPORARILY' END AS business_status FROM venues)"


def _places(spark, sf_dir):
    v = adapt(spark, sf_dir, "venues")
    status = F.when(F.col("venue_id") % 5 == 0, "CLOSED_PERMANENTLY").when(F.col("venue_id") % 5 > 1, "CLOSED_TEMPORARILY")
    return v.select(F.when(F.col("venue_id") % 13 != 0, F.col("venue_id")).alias("place_id"), F.concat(F.lit("  "), "name", F.lit(" ")).alias("name"), "lat", "lng", status.alias("business_status"))


@query("A06_canonical", f"{V}, {_PLACES} SELECT place_id, trim(name) AS name, coalesce(business_status, 'OPERATIONAL') AS business_status FROM pl WHERE place_id IS NOT NULL AND lat IS NOT NULL AND coalesce(business_status, '') <> 'CLOSED_PERMANENTLY'")
def a06(spark, sf_dir):
    return c.to_canonical(_places(spark, sf_dir))[0].select("place_id", "name", "business_status")


@query("A06_rejects", f"{V}, {_PLACES} SELECT count(*) AS n FROM pl WHERE NOT (place_id IS NOT NULL AND lat IS NOT NULL AND coalesce(business_status, '') <> 'CLOSED_PERMANENTLY')")
def a06b(spark, sf_dir):
    return c.to_canonical(_places(spark, sf_dir))[1].agg(F.count("*").alias("n"))


@query("A07_budget_gate", """WITH c AS (SELECT o_custkey AS provider, o_orderkey AS seq, 0.032::DOUBLE AS cost FROM orders), s AS (SELECT *, round(coalesce(sum(cost) OVER (PARTITION BY provider ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS spent FROM c)
  SELECT seq, spent, round(spent + cost, 6) <= 0.25 AS allowed, spent / 0.25::DOUBLE >= 0.8 AS alert FROM s""")
def a07(spark, sf_dir):
    calls = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("provider"), F.col("o_orderkey").alias("seq"), F.lit(0.032).alias("cost"))
    return c.budget_gate(calls, 0.25, 0.8).select("seq", "spent", "allowed", "alert")


R = with_tables("raw_rows", "runs")
_OLD = "raw_id % 3 = 0"


def _raw(spark, sf_dir):
    raw = adapt(spark, sf_dir, "raw_rows")
    return raw.where(_OLD), raw.where(f"not ({_OLD})")


@query("A08_insert_ignore", f"{R}, old AS (SELECT DISTINCT source_key, source_item_id, run_id FROM raw_rows WHERE {_OLD}), f AS (SELECT *, row_number() OVER (PARTITION BY source_key, source_item_id, run_id ORDER BY raw_id) AS k FROM raw_rows WHERE NOT ({_OLD})) SELECT raw_id, source_key, source_item_id, run_id FROM f ANTI JOIN old USING (source_key, source_item_id, run_id) WHERE k = 1")
def a08(spark, sf_dir):
    old, new = _raw(spark, sf_dir)
    return u.insert_ignore(old, new, u.RAW_KEY, "raw_id").select("raw_id", *u.RAW_KEY)


_STAGE = f"""cl AS (SELECT source_key, source_item_id, product_key, decision, geographic_status, raw_id AS row_id FROM raw_rows WHERE NOT ({_OLD})), ids AS (SELECT source_key, source_item_id, min(raw_id) AS raw_id FROM raw_rows WHERE raw_id % 5 <> 0 GROUP BY 1, 2),
  lk AS (SELECT cl.*, ids.raw_id FROM cl JOIN ids USING (source_key, source_item_id) WHERE decision <> 'rejected')"""


def _stage(spark, sf_dir):
    old, new = _raw(spark, sf_dir)
    raw = adapt(spark, sf_dir, "raw_rows").where("raw_id % 5 <> 0")
    classified = new.select("source_key", "source_item_id", "product_key", "decision", "geographic_status")
    return u.stage_venues(old.where("raw_id % 2 = 0").select("source_key", "source_item_id", "product_key"), classified, raw)


@query("A09_stage_venues", f"{R}, {_STAGE}, ex AS (SELECT DISTINCT source_key, source_item_id, product_key FROM raw_rows WHERE {_OLD} AND raw_id % 2 = 0) SELECT source_key, source_item_id, product_key, min(raw_id) AS raw_id, 'pending_review' AS proposal_status FROM lk ANTI JOIN ex USING (source_key, source_item_id, product_key) GROUP BY 1, 2, 3")
def a09(spark, sf_dir):
    return _stage(spark, sf_dir)[0].select("source_key", "source_item_id", "product_key", "raw_id", "proposal_status")


@query("A09_unlinked", f"{R}, {_STAGE} SELECT count(*) AS n FROM cl ANTI JOIN ids USING (source_key, source_item_id) WHERE decision <> 'rejected'")
def a09b(spark, sf_dir):
    return _stage(spark, sf_dir)[1].agg(F.count("*").alias("n"))


@query("A10_stage_activities", f"{R} SELECT raw_id, 'unresolved' AS resolution_status, 'pending_review' AS proposal_status FROM raw_rows WHERE NOT ({_OLD})")
def a10(spark, sf_dir):
    raw = adapt(spark, sf_dir, "raw_rows").select("raw_id")
    return u.stage_activities(raw.where(_OLD), raw)


@query("A11_reprocess", f"{R} SELECT raw_id FROM raw_rows WHERE source_key = 'src3' AND product_key = 'p1'")
def a11(spark, sf_dir):
    return u.reprocess(adapt(spark, sf_dir, "raw_rows"), "src3", "p1").select("raw_id")


_LOG = "lg AS (SELECT run_id % 500 AS run, run_id AS seq, status, n_items FROM runs)"


@query("A12_run_states", f"{R}, {_LOG} SELECT run, max(seq) AS seq, max_by(status, seq) AS status, max_by(n_items, seq) AS n_items FROM lg GROUP BY run")
def a12(spark, sf_dir):
    log = adapt(spark, sf_dir, "runs").select((F.col("run_id") % 500).alias("run"), F.col("run_id").alias("seq"), "status", "n_items")
    return u.latest_state(log, "run", "seq")


@query("A13_close_orphans", f"{R} SELECT run_id, CASE WHEN status = 'running' AND product_key = 'p1' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' AND product_key = 'p1' THEN TIMESTAMP '2000-01-01' ELSE finished_at END AS finished_at FROM runs")
def a13(spark, sf_dir):
    return u.close_orphans(adapt(spark, sf_dir, "runs"), F.lit("p1"), F.lit("2000-01-01").cast("timestamp_ntz")).select("run_id", "status", "finished_at")


_MSG = "CASE event_id % 5 WHEN 0 THEN 'no_date: ' || event_type WHEN 1 THEN 'Erro: x' WHEN 2 THEN event_type || ': y' WHEN 3 THEN NULL ELSE '9x: z' END"


@query("A14_errors_by_reason", f"SELECT coalesce(nullif(regexp_extract({_MSG}, '^([a-z][a-z0-9_]{{0,63}}):', 1), ''), 'other') AS reason, count(*) AS n FROM events GROUP BY 1")
def a14(spark, sf_dir):
    return _t(spark, sf_dir, "events").selectExpr(f"{_MSG} AS m").groupBy(c.error_reason(F.col("m")).alias("reason")).agg(F.count("*").alias("n"))


_DIRTY = "CASE event_id % 4 WHEN 0 THEN 'see https://u:p@host' || user_id || '.org/a?b=c now' WHEN 1 THEN 'token=abc' || user_id || ', ok' WHEN 2 THEN 'Bearer xyz' || user_id || ' service_role   end' ELSE repeat('lorem ', 60) || props END"


@query("A17_sanitize", f"""WITH m AS (SELECT event_id, event_id % 4 AS k, user_id, {_DIRTY} AS x FROM events) SELECT event_id, CASE k WHEN 0 THEN 'see <url:host' || user_id || '.org> now' WHEN 1 THEN '<redacted-param>, ok' WHEN 2 THEN 'Bearer <redacted> <role> end' ELSE substr(x, 1, 300) || '…' END AS safe FROM m""")
def a17(spark, sf_dir):
    return _t(spark, sf_dir, "events").selectExpr("event_id", f"{_DIRTY} AS x").select("event_id", c.sanitize(F.col("x")).alias("safe"))


@query("A18_previous_run", f"{R}, m AS (SELECT run_id, product_key AS region, started_at, status, (run_id % 2) || ',' || (run_id % 3) AS sources, list_sort([run_id % 2, run_id % 3]) AS sorted FROM runs) SELECT region, array_to_string(sorted, ',') AS sources, max_by(run_id, (started_at, run_id)) AS run_id FROM m WHERE status NOT IN ('failed') GROUP BY region, sorted")
def a18(spark, sf_dir):
    m = adapt(spark, sf_dir, "runs").where("status <> 'failed'").select("run_id", F.col("product_key").alias("region"), "started_at", F.array_sort(F.array(F.col("run_id") % 2, F.col("run_id") % 3)).alias("sorted"))
    return m.groupBy("region", F.array_join(F.col("sorted").cast("array<string>"), ",").alias("sources")).agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))


@query("A19_recent_sources", f"{R} SELECT DISTINCT source_key FROM runs WHERE status = 'success' AND dry_run = 0 AND date_diff('second', finished_at, TIMESTAMP '1995-03-01') / 3600.0 <= 20 AND finished_at < TIMESTAMP '1995-03-01'")
def a19(spark, sf_dir):
    now = F.lit("1995-03-01").cast("timestamp_ntz")
    return c.recent_sources(adapt(spark, sf_dir, "runs").where(F.col("finished_at") < now), now)


_E = ["'[envGuard: x] no'", "'falhou (503)'", "'HTTP 404 gone'", "'VenueRepository.insert broke'", "'getaddrinfo ENOTFOUND h'", "'read ECONNRESET'", "'fetch failed'", "'weird'", "'http 429'", "'request timed out'"]
_K = ["env_guard", "http_transient", "http_permanent", "persistence", "network_permanent", "network_transient", "network_transient", "unknown", "http_transient", "network_transient"]
_ERR = "CASE event_id % 10 " + " ".join(f"WHEN {k} THEN {m}" for k, m in enumerate(_E)) + " END"


@query("A20_error_class", "SELECT event_id, CASE event_id % 10 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_K)) + " END AS class FROM events")
def a20(spark, sf_dir):
    none = F.lit(None).cast("string")
    return _t(spark, sf_dir, "events").selectExpr("event_id", f"{_ERR} AS m").select("event_id", c.error_class(F.col("m"), none, none.cast("int"), none).alias("class"))


@query("A21_backoff", "SELECT o_orderkey, least(15000, (2000 * pow(2, o_orderkey % 6))::BIGINT) AS ms FROM orders")
def a21(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", c.backoff_ms(F.col("o_orderkey") % 6 + 1).alias("ms"))


@query("A22_region_violations", """WITH r AS (SELECT CASE n_nationkey % 6 WHEN 0 THEN 'Bad Key' WHEN 1 THEN 'same' ELSE 'k' || n_nationkey END AS region_key, CASE WHEN n_nationkey % 7 = 0 THEN ' ' ELSE n_name END AS label, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey * 10 - 100 END AS lat, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey * 3000 - 3000 END AS radius_m, n_nationkey % 3 = 0 AS twice FROM nation)
  SELECT region_key, 'bad_key' AS violation FROM r WHERE region_key = 'Bad Key' UNION ALL SELECT region_key, 'duplicate_key' FROM r WHERE region_key IN ('same', 'Bad Key') UNION ALL SELECT region_key, 'empty_label' FROM r WHERE trim(label) = ''
  UNION ALL SELECT region_key, 'centre_without_radius' FROM r WHERE (lat IS NOT NULL) <> (radius_m IS NOT NULL) UNION ALL SELECT region_key, 'bad_coordinates' FROM r WHERE lat < -90 OR lat > 90 UNION ALL SELECT region_key, 'bad_radius' FROM r WHERE radius_m <= 0 OR radius_m > 50000 UNION ALL SELECT region_key, 'duplicate_sources' FROM r WHERE twice""")
def a22(spark, sf_dir):
    n = F.col("n_nationkey")
    key = F.when(n % 6 == 0, "Bad Key").when(n % 6 == 1, "same").otherwise(F.concat(F.lit("k"), n.cast("string")))
    r = _t(spark, sf_dir, "nation").select(key.alias("region_key"), F.when(n % 7 == 0, " ").otherwise(F.col("n_name")).alias("label"), F.when(n % 5 != 0, (n * 10 - 100).cast("double")).alias("lat"), F.when(n % 5 != 0, F.lit(0.0)).alias("lng"), F.when(n % 4 != 0, (n * 3000 - 3000).cast("double")).alias("radius_m"), F.array(F.lit("a"), F.when(n % 3 == 0, "a").otherwise("b")).alias("sources"))
    return c.region_violations(r)


@query("A23_plan_sources", """WITH e AS (SELECT 'k' || n_nationkey AS region_key, unnest(['google_places', 'w' || (n_nationkey % 4), 'w' || (n_nationkey % 4 + 1)]) AS source_key FROM nation), q AS (SELECT *, CASE WHEN source_key = 'google_places' THEN 'paid' WHEN source_key NOT IN ('w0', 'w1', 'w2') THEN 'not_registered' END AS reason FROM e)
  SELECT region_key, source_key, CASE WHEN reason IS NULL THEN 'planned' ELSE 'refused' END AS plan, reason FROM q""")
def a23(spark, sf_dir):
    w = lambda k: F.concat(F.lit("w"), (F.col("n_nationkey") % 4 + k).cast("string"))
    regions = _t(spark, sf_dir, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("region_key"), F.array(F.lit("google_places"), w(0), w(1)).alias("sources"))
    return c.plan_sources(regions, spark.createDataFrame([("w0",), ("w1",), ("w2",)], "source_key string"), ["google_places"])


@query("A24_json_occurrences", "SELECT event_id, event_id % 4 < 2 AS valid, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS n, CASE event_id % 4 WHEN 0 THEN '2026-01-02' WHEN 1 THEN '2026-02-02' END AS first_date FROM events")
def a24(spark, sf_dir):
    p = _t(spark, sf_dir, "events").select("event_id", u.parse_occurrences(_payload()).alias("p"))
    return p.select("event_id", "p.valid", F.when(F.col("p.valid"), F.size("p.value")).alias("n"), F.get("p.value", F.lit(0))["date"].alias("first_date"))


def _payload():
    k = F.col("event_id") % 4
    return F.when(k == 0, '[{"date":"2026-01-02","time":"10:00"},{"date":"2026-01-03"}]').when(k == 1, '"[{\\"date\\":\\"2026-02-02\\"}]"').when(k == 2, '[{"time":"10:00"}]').otherwise("oops")


@query("A25_backfill", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'set' ELSE c_name END AS c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def a25(spark, sf_dir):
    child = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 3 == 0, "set").alias("c_name"))
    return u.backfill(child, _t(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", "c_name").select("o_orderkey", "c_name")


_RB = "rn AS (SELECT raw_id FROM raw_rows WHERE run_id = {n}), sg AS (SELECT raw_id, raw_id + 5 AS staging_id, raw_id % 1000 = 7 AND run_id <> 4 AS promoted, run_id FROM raw_rows), dc AS (SELECT raw_id + 5 AS staging_id FROM raw_rows WHERE raw_id % 50 = 3 AND run_id <> 4)"


def _rollback(spark, sf_dir, n):
    raw = adapt(spark, sf_dir, "raw_rows")
    run = raw.where(F.col("run_id") == n).select("raw_id")
    staged = raw.select("raw_id", (F.col("raw_id") + 5).alias("staging_id"), ((F.col("raw_id") % 1000 == 7) & (F.col("run_id") != 4)).alias("promoted"))
    decided = raw.where("raw_id % 50 = 3 and run_id <> 4").select((F.col("raw_id") + 5).alias("staging_id"))
    return raw, run, u.rollback_refusals(run, staged, decided)


@query("A26_rollback_refusals", f"{R}, {_RB.format(n=3)} SELECT 'promoted' AS reason, count(*) AS n FROM sg WHERE promoted AND raw_id IN (SELECT raw_id FROM rn) UNION ALL SELECT 'decided', count(*) FROM sg WHERE raw_id IN (SELECT raw_id FROM rn) AND staging_id IN (SELECT staging_id FROM dc)")
def a26(spark, sf_dir):
    return _rollback(spark, sf_dir, 3)[2]


@query("A26_rollback", f"{R} SELECT raw_id FROM raw_rows WHERE run_id <> 4")
def a26b(spark, sf_dir):
    raw, run, refusals = _rollback(spark, sf_dir, 4)
    return u.rollback(raw, run, refusals).select("raw_id")
