"""Publishing (family F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeweave.functions.identity import ACTIVITY_NAMESPACE, uuid5
from placeweave.operators import publishing as p
from placeweave.plans.adapters import adapt, with_tables
from placeweave.plans.places import sql_haversine
from placeweave.plans.registry import query

AS_OF = "1996-06-15 12:00:00"

A = with_tables("activities", "occurrences", "published", "public_venues", "decisions")
ACT = "act AS (SELECT *, CASE WHEN recurrence_days IS NULL THEN NULL WHEN recurrence_days = '' THEN [] ELSE string_split(recurrence_days, ',') END AS days, activity_id + 1000000 AS public_key FROM activities), pub AS (SELECT public_id AS public_key, public_id AS state_id, last_published_at FROM published)"
SEL = "sel AS (SELECT * FROM act WHERE proposal_status = 'promoted' AND resolution_status IN ('matched', 'proposed_new'))"
INSTANT = "CASE WHEN time IS NULL THEN (date || ' 00:00:00')::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND ELSE (date || ' ' || time || ':00')::TIMESTAMP END + INTERVAL 3 HOUR"
NXT = f"nxt AS (SELECT activity_id, date, time, end_date, end_time FROM (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY i, ord) AS k FROM (SELECT *, {INSTANT} AS i FROM occurrences) WHERE i >= TIMESTAMP '{AS_OF}') WHERE k = 1)"
OKREC = "coalesce(recurrence_type IN ('daily', 'weekly', 'biweekly', 'monthly') AND (recurrence_type NOT IN ('weekly', 'biweekly') OR coalesce(len(days), 0) > 0), false)"
GATE = "lst AS (SELECT activity_id, action = 'matched' AND accepted_id IS NOT NULL AS approved FROM (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY reviewed_at DESC, decision_id DESC) AS k FROM decisions) WHERE k = 1)"
DEC = f"""{ACT}, {SEL}, {NXT}, {GATE}, jn AS (SELECT s.*, pub.state_id, pub.last_published_at, v.public_id AS public_venue_id, coalesce(v.lat IS NOT NULL AND v.lng IS NOT NULL AND v.lat <> 0 AND v.lng <> 0, false) AS located,
  n.date, n.time, n.end_date, n.end_time, coalesce(g.approved, false) AS approved, {OKREC} AS okrec
  FROM sel s LEFT JOIN pub USING (public_key) LEFT JOIN public_venues v ON v.venue_id = s.venue_id LEFT JOIN nxt n ON n.activity_id = s.activity_id LEFT JOIN lst g ON g.activity_id = s.activity_id),
dec AS (SELECT *, CASE WHEN resolution_status = 'matched' AND NOT approved THEN 'skip_missing_human_decision' WHEN state_id IS NULL AND promoted_id IS NOT NULL THEN 'error' WHEN state_id IS NULL AND NOT located THEN 'skip_no_location'
  WHEN state_id IS NULL AND date IS NULL AND NOT okrec THEN 'skip_expired' WHEN state_id IS NULL THEN 'insert' WHEN collected_at <= last_published_at THEN 'skip_not_dirty' WHEN date IS NULL AND NOT okrec THEN 'archive_expired' ELSE 'update' END AS action FROM jn)"""


def _now():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _acts(spark, sf_dir):
    days = F.when(F.col("recurrence_days") == "", F.array().cast("array<string>")).otherwise(F.split("recurrence_days", ","))
    return adapt(spark, sf_dir, "activities").withColumns({"days": days, "public_key": F.col("activity_id") + 1000000})


def _published(spark, sf_dir):
    return adapt(spark, sf_dir, "published").withColumn("public_key", F.col("public_id"))


def _decided(spark, sf_dir):
    # The decisions of the adapter are keyed by customer, as is every activity's number below the customers.
    return p.activity_decisions(p.activity_set(_acts(spark, sf_dir)), _published(spark, sf_dir), adapt(spark, sf_dir, "decisions"), adapt(spark, sf_dir, "public_venues"), adapt(spark, sf_dir, "occurrences"), _now())


@query("F02_activity_selection", f"{A}, {ACT}, {SEL} SELECT activity_id, promoted_id FROM sel")
def f02(spark, sf_dir):
    return p.activity_set(_acts(spark, sf_dir)).select("activity_id", "promoted_id")


STAGED = "st AS (SELECT activity_id AS venue_id, proposal_status, collected_at, promoted_id, CASE WHEN activity_id % 8 = 3 THEN 'outside_region' WHEN activity_id % 8 = 4 THEN NULL ELSE 'inside_radius' END AS geographic_status FROM (SELECT * REPLACE (CASE WHEN activity_id % 10 = 0 THEN 'rejected' ELSE proposal_status END AS proposal_status) FROM activities))"
VSEL = f"{STAGED}, vs AS (SELECT *, CASE WHEN proposal_status = 'promoted' AND coalesce(geographic_status, '') <> 'outside_region' THEN CASE WHEN promoted_id IS NULL THEN 'unpublished' ELSE 'dirty_candidate' END WHEN proposal_status = 'rejected' AND promoted_id IS NOT NULL THEN 'to_archive' END AS selection FROM st)"


def _staged_venues(spark, sf_dir):
    a = adapt(spark, sf_dir, "activities").withColumn("proposal_status", F.when(F.col("activity_id") % 10 == 0, "rejected").otherwise(F.col("proposal_status")))
    geo = F.when(F.col("activity_id") % 8 == 3, "outside_region").when(F.col("activity_id") % 8 != 4, "inside_radius")
    return a.select(F.col("activity_id").alias("venue_id"), "proposal_status", "collected_at", "promoted_id", geo.alias("geographic_status"))


@query("F01_venue_selection", f"{A}, {VSEL} SELECT venue_id, selection FROM vs WHERE selection IS NOT NULL")
def f01(spark, sf_dir):
    return p.venue_sets(_staged_venues(spark, sf_dir)).select("venue_id", "selection")


VDEC = f"{VSEL}, vd AS (SELECT vs.*, CASE selection WHEN 'unpublished' THEN 'insert' WHEN 'to_archive' THEN 'archive' ELSE CASE WHEN q.last_published_at IS NULL THEN 'error' WHEN collected_at <= q.last_published_at THEN 'skip_not_dirty' ELSE 'update' END END AS action FROM vs LEFT JOIN published q ON q.public_id = promoted_id WHERE selection IS NOT NULL)"


@query("F05_venue_decisions", f"{A}, {VDEC} SELECT venue_id, action FROM vd")
def f05(spark, sf_dir):
    return p.venue_decisions(p.venue_sets(_staged_venues(spark, sf_dir)), adapt(spark, sf_dir, "published")).select("venue_id", "action")


@query("F03_public_venue_ids", f"{A} SELECT a.activity_id, v.public_id AS public_venue_id FROM activities a LEFT JOIN public_venues v USING (venue_id)")
def f03(spark, sf_dir):
    v = adapt(spark, sf_dir, "public_venues").select("venue_id", F.col("public_id").alias("public_venue_id"))
    return adapt(spark, sf_dir, "activities").join(v, "venue_id", "left").select("activity_id", "public_venue_id")


@query("F06_activity_decisions", f"{A}, {DEC} SELECT activity_id, action, date AS next_date, public_venue_id FROM dec")
def f06(spark, sf_dir):
    return _decided(spark, sf_dir).select("activity_id", "action", F.col("date").alias("next_date"), "public_venue_id")


@query("F07_human_gate", f"{A}, {GATE} SELECT a.activity_id, coalesce(approved, false) AS approved FROM activities a LEFT JOIN lst USING (activity_id)")
def f07(spark, sf_dir):
    return p.human_gate(adapt(spark, sf_dir, "activities"), adapt(spark, sf_dir, "decisions")).select("activity_id", "approved")


@query("F08_dirty", f"{A} SELECT activity_id, collected_at > last_published_at AS dirty FROM activities JOIN published ON public_id = promoted_id")
def f08(spark, sf_dir):
    pub = adapt(spark, sf_dir, "published").withColumnRenamed("public_id", "promoted_id")
    return adapt(spark, sf_dir, "activities").join(pub, "promoted_id").select("activity_id", (F.col("collected_at") > F.col("last_published_at")).alias("dirty"))


_HEX = ACTIVITY_NAMESPACE.replace("-", "")
_SHA = f"sha1(unhex('{_HEX}') || encode(source_key || ':' || source_item_id))"


@query("F09_stable_identity", f"{A}, h AS (SELECT activity_id, {_SHA} AS d FROM activities) SELECT activity_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(d, 17, 1)), 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS engine_id FROM h")
def f09(spark, sf_dir):
    return adapt(spark, sf_dir, "activities").select("activity_id", uuid5(F.concat("source_key", F.lit(":"), "source_item_id")).alias("engine_id"))


@query("F10_next_occurrence", f"{A}, {NXT} SELECT * FROM nxt")
def f10(spark, sf_dir):
    return p.next_occurrences(adapt(spark, sf_dir, "occurrences"), _now())


@query("F11_stored_range", f"{A} SELECT activity_id, ord, (date || ' ' || coalesce(time, '00:00') || ':00')::TIMESTAMP AS start_date, (end_date || ' ' || coalesce(end_time, '00:00') || ':00')::TIMESTAMP AS end_date FROM occurrences")
def f11(spark, sf_dir):
    start, end = p.stored_range(*[F.col(c) for c in ("date", "time", "end_date", "end_time")])
    return adapt(spark, sf_dir, "occurrences").select("activity_id", "ord", start.alias("start_date"), end.alias("end_date"))


@query("F12_valid_recurrence", f"{A}, {ACT} SELECT activity_id, {OKREC} AS valid FROM act")
def f12(spark, sf_dir):
    return _acts(spark, sf_dir).select("activity_id", p.valid_recurrence(F.col("recurrence_type"), F.col("days")).alias("valid"))


TRN = f"""tr AS (SELECT activity_id, title, (date || ' ' || coalesce(time, '00:00') || ':00')::TIMESTAMP AS start_date, (end_date || ' ' || coalesce(end_time, '00:00') || ':00')::TIMESTAMP AS end_date, public_venue_id AS venue_id, source_key,
  CASE WHEN okrec THEN recurrence_type ELSE 'none' END AS recurrence_type, CASE WHEN okrec THEN array_to_string(days, ',') END AS recurrence_days, CASE WHEN okrec THEN recurrence_time ELSE time END AS recurrence_time FROM dec WHERE action IN ('insert', 'update'))"""


@query("F14_transform", f"{A}, {DEC}, {TRN} SELECT * FROM tr")
def f14(spark, sf_dir):
    out = p.transform_activity(_decided(spark, sf_dir).where("action in ('insert', 'update')"))
    return out.withColumn("recurrence_days", F.array_join("recurrence_days", ","))


@query("F13_event_time", "SELECT l_orderkey, l_linenumber, CASE WHEN regexp_full_match(t, '([01][0-9]|2[0-3]):[0-5][0-9]') THEN t END AS time FROM (SELECT l_orderkey, l_linenumber, (l_partkey % 30) || ':' || (l_suppkey % 70) AS t FROM lineitem)")
def f13(spark, sf_dir):
    t = F.concat_ws(":", (F.col("l_partkey") % 30).cast("string"), (F.col("l_suppkey") % 70).cast("string"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", p.event_time(t).alias("time"))


@query("F15_venue_name", "SELECT c_custkey, coalesce(nullif(trim(CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE ' Casa ' END), ''), trim(c_name)) AS name FROM customer")
def f15(spark, sf_dir):
    curated = F.when(F.col("c_custkey") % 3 == 1, "  ").when(F.col("c_custkey") % 3 == 2, " Casa ")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", p.venue_name(curated, F.col("c_name")).alias("name"))


PUBLIC = "pb AS (SELECT public_id, 'old ' || public_id AS title, NULL::TIMESTAMP AS end_date, CASE WHEN public_id % 2 = 0 THEN 'archived' ELSE 'active' END AS engine_status, last_published_at FROM published)"


@query("F16_apply", f"""{A}, {DEC}, {PUBLIC}, ch AS (SELECT state_id, action, title AS nt FROM dec WHERE action IN ('update', 'archive_expired'))
  SELECT public_id, CASE WHEN action = 'update' THEN nt ELSE title END AS title, CASE WHEN action = 'archive_expired' THEN TIMESTAMP '1996-06-13 00:00:00' ELSE end_date END AS end_date,
    CASE action WHEN 'update' THEN 'active' WHEN 'archive_expired' THEN 'archived' ELSE engine_status END AS engine_status, CASE WHEN action IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE last_published_at END AS last_published_at
  FROM pb LEFT JOIN ch ON state_id = public_id UNION ALL SELECT activity_id + 9000000, title, NULL, 'active', TIMESTAMP '{AS_OF}' FROM dec WHERE action = 'insert'""")
def f16(spark, sf_dir):
    pub = adapt(spark, sf_dir, "published").select("public_id", F.concat(F.lit("old "), F.col("public_id").cast("string")).alias("title"), F.lit(None).cast("timestamp_ntz").alias("end_date"), F.when(F.col("public_id") % 2 == 0, "archived").otherwise("active").alias("engine_status"), "last_published_at")
    return p.apply_decisions(pub, _decided(spark, sf_dir), _now(), p.archive_end(_now()))


@query("F18_run_metrics", f"""{A}, {DEC} SELECT count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action IN ('archive', 'archive_expired')) AS archived,
  count(*) FILTER (starts_with(action, 'skip')) AS skipped, count(*) FILTER (action = 'error') AS errors, CASE WHEN count(*) FILTER (action = 'error') > 0 THEN 'partial' ELSE 'success' END AS status FROM dec""")
def f18(spark, sf_dir):
    return p.run_metrics(_decided(spark, sf_dir))


DUP = f"""dv AS (SELECT *, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS name_key FROM venues), dg AS (SELECT name_key, count(*) AS members FROM dv GROUP BY 1 HAVING count(*) > 1),
  df AS (SELECT a.name_key, max({sql_haversine('a.lat', 'a.lng', 'b.lat', 'b.lng')}) AS far FROM dv a JOIN dv b ON a.name_key = b.name_key AND a.venue_id < b.venue_id WHERE a.lat IS NOT NULL AND b.lat IS NOT NULL GROUP BY 1)"""


@query("F19_duplicate_venues", f"{with_tables('venues')}, {DUP} SELECT name_key, members, round(far, 3) AS max_distance_m FROM dg LEFT JOIN df USING (name_key)")
def f19(spark, sf_dir):
    return p.duplicate_venues(adapt(spark, sf_dir, "venues")).withColumn("max_distance_m", F.round("max_distance_m", 3))


@query("F20_preview_counts", f"{A}, {DEC} SELECT action, count(*) AS n FROM dec GROUP BY action")
def f20(spark, sf_dir):
    return _decided(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))


@query("F21_funnel", f"{A} SELECT coalesce(resolution_status, 'unresolved') AS status, count(*) AS n, count(promoted_id) AS published FROM activities GROUP BY 1")
def f21(spark, sf_dir):
    a = adapt(spark, sf_dir, "activities").withColumn("status", F.coalesce("resolution_status", F.lit("unresolved")))
    return a.groupBy("status").agg(F.count("*").alias("n"), F.count("promoted_id").alias("published")).orderBy(F.desc("n"), "status")


@query("F22_bucket_samples", f"{A}, {DEC} SELECT action, position, activity_id, greatest(total - 5, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY action ORDER BY activity_id) AS position, count(*) OVER (PARTITION BY action) AS total FROM dec) WHERE position <= 5")
def f22(spark, sf_dir):
    return p.bucket_samples(_decided(spark, sf_dir), "activity_id")


@query("F23_manual_archive", f"{A}, rq AS (SELECT o_orderkey * 3 + 1000000 AS public_id, o_orderkey % 2 = 0 AS dry FROM orders), {PUBLIC} SELECT rq.public_id, dry, CASE WHEN pb.public_id IS NULL THEN 'not_found' WHEN engine_status = 'archived' THEN 'already_archived' WHEN dry THEN 'would_archive' ELSE 'archived' END AS outcome FROM rq LEFT JOIN pb USING (public_id)")
def f23(spark, sf_dir):
    rq = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") * 3 + 1000000).alias("public_id"), (F.col("o_orderkey") % 2 == 0).alias("dry"))
    pub = adapt(spark, sf_dir, "published").select("public_id", F.when(F.col("public_id") % 2 == 0, "archived").otherwise("active").alias("engine_status"))
    outcome = F.when(F.col("engine_status").isNull(), "not_found").when(F.col("engine_status") == "archived", "already_archived").when(F.col("dry"), "would_archive").otherwise("archived")
    return rq.join(pub, "public_id", "left").select("public_id", "dry", outcome.alias("outcome"))
