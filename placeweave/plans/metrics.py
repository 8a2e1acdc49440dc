"""Quality metrics, health and statistics (family G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeweave.functions.numbers import rate
from placeweave.operators import metrics as m
from placeweave.plans.adapters import adapt, with_tables
from placeweave.plans.registry import query

I = with_tables("items")  # noqa: E741


def _rate(c: str, t: str) -> str:
    return f"CASE WHEN {t} <> 0 THEN floor({c} / {t}::DOUBLE * 1000.0::DOUBLE + 0.5) / 10.0::DOUBLE END"


def _r1(x: str) -> str:
    return f"floor({x} * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE"


QUALITY = f"""r AS (SELECT source_key, source_item_id, n_occurrences > 0 AS dated, coalesce(n_occurrences > 0 AND time IS NOT NULL, false) AS timed, venue_text IS NOT NULL AS placed,
  coalesce(trim(address) <> '', false) OR coalesce(hint = 'explicit_name', false) AS geo, (epoch_us(collected_at) - epoch_us(published_at)) / 3.6e9::DOUBLE AS delay FROM items),
q AS (SELECT source_key, grouping(source_key)::BIGINT AS level, count(*) AS total, count(*) FILTER (dated) AS with_date, count(*) FILTER (timed) AS with_time, count(*) FILTER (placed) AS with_venue, count(*) FILTER (geo) AS geocodable,
  count(*) - count(DISTINCT (source_key, source_item_id)) AS duplicates, count(delay) AS n_delay, avg(delay) AS a, median(delay) AS md, max(delay) AS mx FROM r GROUP BY GROUPING SETS ((source_key), ()))"""


@query("G02_run_quality", f"""{I}, {QUALITY} SELECT source_key, level, total, with_date, {_rate('with_date', 'total')} AS date_pct, with_time, {_rate('with_time', 'total')} AS time_pct, with_venue, {_rate('with_venue', 'total')} AS venue_pct,
  geocodable, {_rate('geocodable', 'total')} AS geocodable_pct, duplicates, n_delay, {_r1('a')} AS mean_delay_h, {_r1('md')} AS median_delay_h, {_r1('mx')} AS max_delay_h FROM q""")
def g02(spark, sf_dir):
    return m.run_quality(adapt(spark, sf_dir, "items"))


@query("G01_rate", f"SELECT l_orderkey, l_linenumber, {_rate('l_linenumber', '(l_partkey % 7)')} AS pct FROM lineitem")
def g01(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", rate(F.col("l_linenumber"), F.col("l_partkey") % 7).alias("pct"))


@query("G03_predicates", f"{I} SELECT item_row, coalesce(trim(address) <> '', false) OR coalesce(hint = 'explicit_name', false) AS geocodable FROM items")
def g03(spark, sf_dir):
    return adapt(spark, sf_dir, "items").select("item_row", m.has_venue(F.col("address"), F.col("hint")).alias("geocodable"))


@query("G04_duplicates", f"{I} SELECT source_key, count(*) - count(DISTINCT source_item_id) AS duplicates FROM items GROUP BY source_key")
def g04(spark, sf_dir):
    return adapt(spark, sf_dir, "items").groupBy("source_key").agg((F.count("*") - F.count_distinct("source_item_id")).alias("duplicates"))


_B = ", ".join(f"count(*) FILTER (geographic_status = '{s}') AS {s}, {_rate(f'''count(*) FILTER (geographic_status = '{s}')''', 'count(geographic_status)')} AS {s}_pct" for s in ("inside_radius", "buffer_zone", "outside_region"))


@query("G06_gate_summary", f"{I} SELECT count(geographic_status) AS gated, {_B} FROM items")
def g06(spark, sf_dir):
    return m.gate_summary(adapt(spark, sf_dir, "items"))


@query("G07_sorted_groups", f"{I} SELECT source_key, row_number() OVER (ORDER BY source_key) AS position FROM (SELECT DISTINCT source_key FROM items)")
def g07(spark, sf_dir):
    from pyspark.sql import Window

    names = adapt(spark, sf_dir, "items").select("source_key").distinct()  # few sources: one ordering
    return names.withColumn("position", F.row_number().over(Window.orderBy(F.collate("source_key", "UNICODE")))).select("source_key", "position")


HEALTH_NOW = "1996-01-01 00:00:00"
HR = with_tables("items", "runs")
SRC = f"""cur AS (SELECT source_key, count(*) AS total, count(*) FILTER (n_occurrences > 1) AS with_date, max(collected_at) AS last_published FROM items WHERE run = 'current' AND (source_key <> 'error' OR item_row % 5 = 0) GROUP BY 1),
prv AS (SELECT source_key, count(*) AS previous FROM items WHERE run = 'previous' GROUP BY 1),
rr AS (SELECT * FROM runs WHERE started_at >= TIMESTAMP '1995-11-01 00:00:00' AND started_at < TIMESTAMP '{HEALTH_NOW}'),
uni AS (SELECT source_key FROM cur UNION SELECT source_key FROM prv UNION SELECT source_key FROM rr UNION SELECT 'expected_' || n_nationkey FROM nation),
so AS (SELECT u.source_key, total, previous, with_date, CASE WHEN last_published IS NULL THEN NULL ELSE TIMESTAMP '{HEALTH_NOW}' - INTERVAL 1 DAY * (total % 30) END AS last_published FROM uni u LEFT JOIN cur USING (source_key) LEFT JOIN prv USING (source_key)),
al AS (SELECT source_key, 'zero_items' AS code, 'critical' AS severity FROM so WHERE coalesce(total, 0) = 0
  UNION ALL SELECT source_key, 'volume_drop', 'warning' FROM so WHERE total > 0 AND previous >= 4 AND (previous - total) / previous::DOUBLE * 100 > 50
  UNION ALL SELECT source_key, 'high_no_date_rate', 'warning' FROM so WHERE total >= 2 AND (total - with_date) / total::DOUBLE * 100 > 50
  UNION ALL SELECT source_key, 'stale_source', 'warning' FROM so WHERE date_diff('second', last_published, TIMESTAMP '{HEALTH_NOW}') / 86400.0 > 14
  UNION ALL SELECT source_key, CASE status WHEN 'failed' THEN 'run_failed' WHEN 'partial' THEN 'run_partial' ELSE 'run_open' END, CASE status WHEN 'partial' THEN 'warning' ELSE 'critical' END FROM rr
    WHERE status IN ('failed', 'partial') OR (status = 'running' AND finished_at IS NULL AND date_diff('second', started_at, TIMESTAMP '{HEALTH_NOW}') / 3600.0 > 6))"""


def _health(spark, sf_dir):
    now = F.lit(HEALTH_NOW).cast("timestamp_ntz")
    items = adapt(spark, sf_dir, "items")
    current = items.where("run = 'current' and (source_key <> 'error' or item_row % 5 = 0)").groupBy("source_key").agg(F.count("*").alias("total"), F.count_if(F.col("n_occurrences") > 1).alias("with_date"))
    previous = items.where("run = 'previous'").groupBy("source_key").agg(F.count("*").alias("previous"))
    runs = adapt(spark, sf_dir, "runs").where((F.col("started_at") >= F.lit("1995-11-01").cast("timestamp_ntz")) & (F.col("started_at") < now))
    expected = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("expected_"), F.col("n_nationkey").cast("string")).alias("source_key"))
    known = current.select("source_key").union(previous.select("source_key")).union(runs.select("source_key")).union(expected).distinct()
    stale = F.when(F.col("total").isNotNull(), F.expr(f"TIMESTAMP_NTZ '{HEALTH_NOW}' - INTERVAL '1' DAY * cast(total % 30 as int)"))
    sources = known.join(current, "source_key", "left").join(previous, "source_key", "left").withColumn("last_published", stale)
    return sources, runs, now


@query("G08_source_universe", f"{HR}, {SRC} SELECT source_key FROM uni")
def g08(spark, sf_dir):
    return _health(spark, sf_dir)[0].select("source_key")


@query("G09_alerts", f"{HR}, {SRC} SELECT * FROM al")
def g09(spark, sf_dir):
    sources, runs, now = _health(spark, sf_dir)
    return m.source_alerts(sources, runs, now)


@query("G10_worst", f"{HR}, {SRC} SELECT so.source_key, CASE max(CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'ok' END AS status, count(al.source_key) AS n_alerts FROM so LEFT JOIN al USING (source_key) GROUP BY 1")
def g10(spark, sf_dir):
    sources, runs, now = _health(spark, sf_dir)
    return m.worst(sources, m.source_alerts(sources, runs, now))


@query("G11_alert_order", f"{HR}, {SRC} SELECT source_key, code, severity FROM al ORDER BY severity, source_key")
def g11(spark, sf_dir):
    sources, runs, now = _health(spark, sf_dir)
    return m.source_alerts(sources, runs, now).orderBy(F.desc(m.severity_rank(F.col("severity"))), F.collate("source_key", "UNICODE"))


@query("G12_report_lines", f"{I}, {QUALITY} SELECT coalesce(source_key, 'total') || ': ' || total || ' itens, ' || printf('%.1f', {_rate('with_date', 'total')}) || '% com data' AS line FROM q")
def g12(spark, sf_dir):
    q = m.run_quality(adapt(spark, sf_dir, "items"))
    return q.select(F.format_string("%s: %d itens, %.1f%% com data", F.coalesce("source_key", F.lit("total")), F.col("total"), F.col("date_pct")).alias("line"))


R = with_tables("runs", "activities", "venues", "mentions", "decisions")


@query("G13_latest_runs", f"{R} SELECT run_id, source_key, status FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY started_at DESC, run_id DESC) AS k FROM (SELECT * FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 20)) WHERE k = 1")
def g13(spark, sf_dir):
    return m.latest_by_source(adapt(spark, sf_dir, "runs")).select("run_id", "source_key", "status")


_SPENT = "floor(ceil(n / 20.0) * 0.032::DOUBLE * 100 + 0.5) / 100.0::DOUBLE"


@query("G13_budget", f"""{R}, b AS (SELECT source_key, sum(n_items) AS n FROM runs WHERE status = 'success' GROUP BY 1), c AS (SELECT source_key, ceil(n / 20.0)::BIGINT AS queries, {_SPENT} AS spent FROM b)
  SELECT source_key, queries, spent, floor((10.0::DOUBLE - spent) * 100 + 0.5) / 100.0::DOUBLE AS remaining, floor(spent / 10.0::DOUBLE * 1000 + 0.5) / 10.0::DOUBLE AS usage_pct, floor(spent / 10.0::DOUBLE * 1000 + 0.5) / 10.0::DOUBLE >= 80 AS alert FROM c""")
def g13b(spark, sf_dir):
    spent = adapt(spark, sf_dir, "runs").where("status = 'success'").groupBy("source_key").agg(F.sum("n_items").alias("n"))
    return spent.select("source_key", m.budget(F.col("n")).alias("b")).select("source_key", "b.*")


@query("G13_status_counts", f"{R} SELECT product_key, count(*) FILTER (proposal_status = 'approved') AS approved, count(*) FILTER (proposal_status = 'rejected') AS rejected, count(*) FILTER (proposal_status = 'promoted') AS promoted, count(*) AS total FROM venues GROUP BY 1")
def g13c(spark, sf_dir):
    n = lambda s: F.count_if(F.col("proposal_status") == s).alias(s)
    return adapt(spark, sf_dir, "venues").groupBy("product_key").agg(n("approved"), n("rejected"), n("promoted"), F.count("*").alias("total"))


@query("G14_active_view", f"""{R}, v AS (SELECT activity_id, recurrence_type, collected_at AS start_date, CASE WHEN activity_id % 3 = 0 THEN collected_at + INTERVAL 5 DAY END AS end_date FROM activities)
  SELECT activity_id FROM v WHERE (end_date IS NULL OR end_date >= TIMESTAMP '1996-01-01') AND recurrence_type IS NOT NULL AND (recurrence_type <> 'none' OR start_date >= TIMESTAMP '1996-01-01')""")
def g14(spark, sf_dir):
    v = adapt(spark, sf_dir, "activities").select("activity_id", "recurrence_type", F.col("collected_at").alias("start_date"), F.when(F.col("activity_id") % 3 == 0, F.col("collected_at") + F.expr("INTERVAL '5' DAY")).alias("end_date"))
    return m.active_activities(v, F.lit("1996-01-01").cast("timestamp_ntz")).select("activity_id")


@query("G15_queue_stats", f"{R} SELECT count(*) FILTER (resolution_status = 'matched') AS matched, count(*) FILTER (resolution_status = 'ambiguous') AS ambiguous, count(*) FILTER (resolution_status = 'unresolved') AS unresolved, count(*) AS total, (SELECT count(*) FROM decisions) AS decisions FROM mentions")
def g15(spark, sf_dir):
    n = lambda s: F.count_if(F.col("resolution_status") == s).alias(s)
    counts = adapt(spark, sf_dir, "mentions").agg(n("matched"), n("ambiguous"), n("unresolved"), F.count("*").alias("total"))
    return counts.crossJoin(adapt(spark, sf_dir, "decisions").agg(F.count("*").alias("decisions")))  # one row each


@query("G16_queue_health", f"""{R}, p AS (SELECT count(*) AS pending FROM mentions WHERE resolution_status IN ('unresolved', 'ambiguous')), d AS (SELECT count(*) AS recent FROM decisions WHERE reviewed_at >= TIMESTAMP '1995-06-01' - INTERVAL 24 HOUR AND reviewed_at <= TIMESTAMP '1995-06-01'),
  r AS (SELECT max(started_at) AS last_run FROM runs) SELECT pending, recent, last_run, CASE WHEN pending = 0 THEN 'healthy' WHEN pending <= 3 THEN 'warning' ELSE 'critical' END AS health FROM p, d, r""")
def g16(spark, sf_dir):
    at = F.lit("1995-06-01").cast("timestamp_ntz")
    pending = adapt(spark, sf_dir, "mentions").where("resolution_status in ('unresolved', 'ambiguous')").agg(F.count("*").alias("pending"))
    recent = adapt(spark, sf_dir, "decisions").where((F.col("reviewed_at") >= at - F.expr("INTERVAL '24' HOUR")) & (F.col("reviewed_at") <= at)).agg(F.count("*").alias("recent"))
    last = adapt(spark, sf_dir, "runs").agg(F.max("started_at").alias("last_run"))
    both = pending.crossJoin(recent).crossJoin(last)  # one row each
    return both.withColumn("health", F.when(F.col("pending") == 0, "healthy").when(F.col("pending") <= 3, "warning").otherwise("critical"))


@query("G17_last_published", f"{I} SELECT source_key, max(published_at) AS last_published FROM items GROUP BY 1")
def g17(spark, sf_dir):
    return adapt(spark, sf_dir, "items").groupBy("source_key").agg(F.max("published_at").alias("last_published"))


@query("G18_exit_code", f"{R} SELECT product_key, CASE WHEN bool_or(status = 'failed') THEN 1 WHEN bool_or(status = 'partial') THEN 2 ELSE 0 END AS code FROM runs GROUP BY 1")
def g18(spark, sf_dir):
    code = F.when(F.bool_or(F.col("status") == "failed"), 1).when(F.bool_or(F.col("status") == "partial"), 2).otherwise(0)
    return adapt(spark, sf_dir, "runs").groupBy("product_key").agg(code.alias("code"))


@query("G19_needing_review", f"{I} SELECT source_key, count(*) FILTER (n_review_reasons > 0) AS needing_review FROM items GROUP BY 1")
def g19(spark, sf_dir):
    return adapt(spark, sf_dir, "items").groupBy("source_key").agg(F.count_if(F.col("n_review_reasons") > 0).alias("needing_review"))


@query("G21_role_tally", "SELECT string_agg(role || '=' || n, ', ' ORDER BY role) AS tally FROM (SELECT role, count(*) AS n FROM conversations GROUP BY role)")
def g21(spark, sf_dir):
    roles = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("role").agg(F.count("*").alias("n"))
    return roles.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "role", F.col("n").cast("string")))), ", ").alias("tally"))  # one entry per role


@query("G22_source_priority", f"{R}, p(source_key, priority) AS (VALUES ('src0', 90), ('src1', 70), ('src2', 70)) SELECT a.activity_id, sign(coalesce(q.priority, 40) - coalesce(p.priority, 40))::INT AS order_of FROM activities a LEFT JOIN p USING (source_key) LEFT JOIN p q ON q.source_key = 'src' || a.venue_id % 4")
def g22(spark, sf_dir):
    table = spark.createDataFrame([("src0", 90), ("src1", 70), ("src2", 70)], "source_key string, priority int")
    a = adapt(spark, sf_dir, "activities").withColumn("other", F.concat(F.lit("src"), (F.col("venue_id") % 4).cast("string")))
    both = a.join(table, "source_key", "left").join(table.toDF("other", "other_priority"), "other", "left")
    return both.select("activity_id", F.signum((F.coalesce("other_priority", F.lit(40)) - F.coalesce("priority", F.lit(40))).cast("double")).cast("int").alias("order_of"))


@query("G23_interest_counter", "SELECT o_orderkey, greatest(0, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 2 END, 0) + d) AS n FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS d FROM orders) WHERE d <> 0")
def g23(spark, sf_dir):
    d = F.when(F.col("o_orderkey") % 4 == 0, 1).when(F.col("o_orderkey") % 4 == 1, -1)
    n = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 2)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("d", d).where("d is not null").select("o_orderkey", F.greatest(F.lit(0), F.coalesce(n, F.lit(0)) + F.col("d")).alias("n"))


@query("G24_update_guard", "SELECT o_orderkey, n IS NULL OR n < 0 OR abs(n - old) > 1 OR t <> o_orderstatus AS rejected FROM (SELECT o_orderkey, o_orderstatus, o_orderkey % 5 AS old, CASE o_orderkey % 7 WHEN 0 THEN NULL ELSE o_orderkey % 5 + o_orderkey % 4 - 2 END AS n, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS t FROM orders)")
def g24(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    o = o.withColumns({"old": F.col("o_orderkey") % 5, "n": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 5 + F.col("o_orderkey") % 4 - 2), "t": F.when(F.col("o_orderkey") % 9 == 0, "X").otherwise(F.col("o_orderstatus"))})
    return o.select("o_orderkey", (F.col("n").isNull() | (F.col("n") < 0) | (F.abs(F.col("n") - F.col("old")) > 1) | (F.col("t") != F.col("o_orderstatus"))).alias("rejected"))
