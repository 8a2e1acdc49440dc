"""Domain-shaped tables derived from the star schema, in SQL that Spark and DuckDB both read.

The driver ships no place data, so names, points, states and times are derived from keys by plain arithmetic. Only
the shape of the inputs is shared with the SQL equivalents; operators and oracles are written apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"]

_CITY = "CASE p_partkey % 6 WHEN 0 THEN 'Cabo Frio' WHEN 1 THEN 'iguaba grande rj' WHEN 2 THEN NULL WHEN 3 THEN 'Buzios' WHEN 4 THEN 'cabo frio rj' ELSE '' END"

ADAPTERS: dict[str, str] = {
    # Places: names, points around the centres, labels of regions, states.
    "venues": f"""
SELECT p_partkey AS venue_id, 'p' || CAST(p_partkey % 25 AS STRING) AS product_key, p_name AS name,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'Rua ' || p_brand || ' de ' || p_type END AS address, {_CITY} AS city,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(-22.9 AS DOUBLE) + (p_partkey % 97) * CAST(0.0007 AS DOUBLE) END AS lat,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(-42.05 AS DOUBLE) + (p_partkey % 89) * CAST(0.0009 AS DOUBLE) END AS lng,
  CASE p_partkey % 4 WHEN 0 THEN 'promoted' WHEN 1 THEN 'rejected' ELSE 'approved' END AS proposal_status,
  CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE 'R' || CAST(p_partkey % 5 AS STRING) END AS source_region_label,
  p_type AS category, p_brand AS brand, p_size AS size, p_partkey AS raw_id
FROM {{part}}""",
    "regions": """
SELECT 'k' || CAST(n_nationkey AS STRING) AS region_key, 'R' || CAST(n_nationkey AS STRING) AS label,
  CAST(-22.88 AS DOUBLE) + n_nationkey * CAST(0.004 AS DOUBLE) AS center_lat, CAST(-42.02 AS DOUBLE) AS center_lng,
  CAST(2000 + 400 * n_nationkey AS DOUBLE) AS radius_m
FROM {nation} WHERE n_nationkey < 3""",
    # Free-text mentions of places.
    "mentions": """
SELECT c.c_custkey AS activity_id, 'p' || CAST(c.c_custkey % 25 AS STRING) AS product_key,
  CASE c.c_custkey % 6 WHEN 0 THEN p.p_name WHEN 1 THEN 'Casa de ' || p.p_name WHEN 2 THEN upper(p.p_name) || ' em Cabo Frio'
    WHEN 3 THEN '' WHEN 4 THEN p.p_name || ', São José' ELSE c.c_mktsegment || ' ' || p.p_name END AS raw_text,
  CASE c.c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'rua ' || p.p_brand ELSE 'Rua ' || p.p_brand || ' de ' || p.p_type END AS raw_address_text,
  CASE c.c_custkey % 5 WHEN 0 THEN 'inferred' WHEN 1 THEN 'ambiguous' WHEN 2 THEN NULL ELSE 'explicit_name' END AS hint,
  's' || CAST(c.c_custkey % 4 AS STRING) AS source_key,
  CASE c.c_custkey % 7 WHEN 0 THEN 'matched' WHEN 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution_status, c.c_custkey AS raw_id
FROM {customer} c JOIN {part} p ON p.p_partkey = (c.c_custkey * 7) % 200 + 1""",
    "contexts": """
SELECT * FROM (VALUES ('s0', 'Cabo Frio', 'RJ'), ('s1', 'Iguaba Grande', 'RJ'), ('s2', NULL, 'RJ')) AS t(source_key, city, state)""",
    # Human decisions on activities, several per activity.
    "decisions": """
SELECT o_orderkey AS decision_id, o_custkey AS activity_id, o_orderdate AS reviewed_at,
  CASE o_orderkey % 4 WHEN 0 THEN 'skipped' WHEN 1 THEN 'matched' WHEN 2 THEN 'rejected' ELSE 'proposed_new' END AS action,
  CASE WHEN o_orderkey % 8 = 1 THEN NULL WHEN o_orderkey % 4 = 1 THEN o_orderkey % 50 END AS accepted_id
FROM {orders}""",
    # Staged activities for publishing.
    "activities": """
SELECT o_orderkey AS activity_id, 'src' || CAST(o_orderkey % 5 AS STRING) AS source_key, CAST(o_orderkey AS STRING) || '_0' AS source_item_id,
  'Atividade ' || CAST(o_custkey AS STRING) AS title, o_custkey AS venue_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'pending_review' ELSE 'promoted' END AS proposal_status,
  CASE o_orderkey % 5 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'proposed_new' WHEN 2 THEN NULL ELSE 'matched' END AS resolution_status,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 1000000 + o_orderkey END AS promoted_id,
  CASE o_orderkey % 6 WHEN 0 THEN 'weekly' WHEN 1 THEN 'none' WHEN 2 THEN 'daily' ELSE NULL END AS recurrence_type,
  CASE o_orderkey % 12 WHEN 0 THEN '1,3' WHEN 6 THEN '' ELSE NULL END AS recurrence_days,
  CASE WHEN o_orderkey % 7 = 0 THEN '19:30' ELSE NULL END AS recurrence_time,
  o_orderdate AS collected_at, o_orderdate + INTERVAL '10' DAY AS published_on, o_orderpriority AS category, o_orderstatus AS status
FROM {orders}""",
    # Dated occurrences of activities.
    "occurrences": """
SELECT l_orderkey AS activity_id, l_linenumber AS ord, CAST(CAST(l_shipdate AS DATE) AS STRING) AS date,
  CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN '09:30' ELSE '23:00' END AS time,
  CASE WHEN l_linenumber % 4 = 0 THEN CAST(CAST(l_shipdate AS DATE) AS STRING) END AS end_date,
  CASE WHEN l_linenumber % 4 = 0 THEN '23:30' END AS end_time
FROM {lineitem}""",
    # Published rows: state of an earlier run.
    "published": """
SELECT 1000000 + o_orderkey AS public_id, o_orderdate + INTERVAL '10' DAY - INTERVAL '1' DAY * (o_orderkey % 21) AS last_published_at
FROM {orders} WHERE o_orderkey % 9 <> 0""",
    "public_venues": """
SELECT c_custkey AS venue_id, 5000 + c_custkey AS public_id, c_name AS name,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(-22.9 AS DOUBLE) + (c_custkey % 97) * CAST(0.001 AS DOUBLE) END AS lat,
  CAST(-42.05 AS DOUBLE) + (c_custkey % 89) * CAST(0.001 AS DOUBLE) AS lng
FROM {customer}""",
    # Collected items with the fields that quality counts.
    "items": """
SELECT event_id AS item_row, event_type AS source_key, user_id AS source_item_id, ts AS collected_at,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts - INTERVAL '1' HOUR * (event_id % 200) - INTERVAL '1' MINUTE * (event_id % 60) END AS published_at,
  event_id % 4 AS n_occurrences, CASE WHEN event_id % 3 = 0 THEN '10:00' END AS time,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'Rua ' || CAST(user_id AS STRING) END AS address,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'Casa' END AS venue_text,
  CASE event_id % 3 WHEN 0 THEN 'explicit_name' ELSE 'inferred' END AS hint,
  CASE event_id % 4 WHEN 0 THEN 'inside_radius' WHEN 1 THEN 'buffer_zone' WHEN 2 THEN 'outside_region' END AS geographic_status,
  CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'previous' ELSE 'current' END AS run, event_id % 3 AS n_review_reasons
FROM {events}""",
    # Runs of collectors.
    "runs": """
SELECT o_orderkey AS run_id, 'src' || CAST(o_custkey % 37 AS STRING) AS source_key, o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 86400) AS started_at,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 86400) + INTERVAL '1' HOUR END AS finished_at,
  CASE o_orderkey % 10 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' WHEN 2 THEN 'partial' ELSE 'success' END AS status,
  'p' || CAST(o_custkey % 3 AS STRING) AS product_key, o_orderkey % 40 AS n_items, o_orderkey % 2 AS dry_run
FROM {orders}""",
    # Raw rows of several collection runs.
    "raw_rows": """
SELECT l_orderkey * 10 + l_linenumber AS raw_id, 'src' || CAST(l_suppkey % 7 AS STRING) AS source_key, CAST(l_partkey AS STRING) AS source_item_id,
  l_orderkey % 20 AS run_id, l_shipdate AS collected_at, 'p' || CAST(l_suppkey % 3 AS STRING) AS product_key,
  CASE l_linenumber % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'needs_review' ELSE 'accepted' END AS decision,
  CASE l_linenumber % 3 WHEN 0 THEN 'buffer_zone' ELSE 'inside_radius' END AS geographic_status
FROM {lineitem}""",
}


def adapt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The adapted table over the tables in sf_dir."""
    sql = ADAPTERS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    if len(used) > 1:  # joined as wholes: by a shuffle, however small their files
        used = {t: df.hint("merge") for t, df in used.items()}
    return spark.sql(sql, **used)


def with_tables(*names: str) -> str:
    """A WITH clause that defines the adapted tables for DuckDB, left open for more."""
    return "WITH " + ", ".join(f"{n} AS ({ADAPTERS[n].format(**{t: t for t in TABLES})})" for n in names)
