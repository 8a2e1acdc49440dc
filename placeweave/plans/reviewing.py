"""Review queries and state machine (family H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeweave.operators import review
from placeweave.plans.adapters import adapt, with_tables
from placeweave.plans.registry import query

T = with_tables("venues", "activities", "runs", "decisions")
CAND = "cand AS (SELECT l_orderkey * 10 + l_linenumber AS candidate_id, l_orderkey AS activity_id, l_suppkey AS venue_id, l_discount AS score, CASE WHEN l_orderkey % 6 = 0 AND l_linenumber = 1 THEN 'accepted' END AS outcome FROM lineitem)"


def _candidates(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    outcome = F.when((F.col("l_orderkey") % 6 == 0) & (F.col("l_linenumber") == 1), "accepted")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("candidate_id"), F.col("l_orderkey").alias("activity_id"), F.col("l_suppkey").alias("venue_id"), F.col("l_discount").alias("score"), outcome.alias("outcome"))


@query("H02_venue_list", f"{T} SELECT venue_id, name, city FROM venues WHERE proposal_status = 'approved' AND city ILIKE '%frio%' AND name ILIKE '%RING%' ORDER BY size DESC, venue_id LIMIT 10 OFFSET 10")
def h02(spark, sf_dir):
    page = review.Page(2, 10)
    return review.list_rows(adapt(spark, sf_dir, "venues"), page, "venue_id", "size", equal={"proposal_status": "approved"}, like={"city": "frio", "name": "RING"}).select("venue_id", "name", "city")


@query("H03_activity_list", f"{T} SELECT activity_id, title FROM activities WHERE proposal_status = 'promoted' AND title ILIKE '%atividade 1%' ORDER BY collected_at DESC NULLS LAST, activity_id LIMIT 20")
def h03(spark, sf_dir):
    """Search before paging, so that pages and totals agree."""
    return review.list_rows(adapt(spark, sf_dir, "activities"), review.Page(), "activity_id", "collected_at", equal={"proposal_status": "promoted"}, like={"title": "atividade 1"}).select("activity_id", "title")


@query("H01_paging", "SELECT * FROM (VALUES (1, 20, 0, 3), (1, 100, 0, 1), (4, 1, 3, 41)) AS t(page, size, first, pages)")
def h01(spark, sf_dir):
    pages = [review.Page(0, 20), review.Page(-3, 1000), review.Page(4, 0)]
    return spark.createDataFrame([(p.number, p.size, p.offset, p.total_pages(41)) for p in pages], "page int, size int, first int, pages int")


@query("H01_deep_page", f"""{T}, m AS (SELECT activity_id, title, collected_at FROM activities WHERE proposal_status = 'promoted')
  SELECT activity_id, title, (SELECT count(*) FROM m) AS total_rows, (SELECT ceil(count(*) / 20.0)::INT FROM m) AS total_pages FROM m ORDER BY collected_at DESC NULLS LAST, activity_id LIMIT 20 OFFSET 780""")
def h01_deep(spark, sf_dir):
    """Page 40 of the promoted activities, with the totals of the list."""
    rows = adapt(spark, sf_dir, "activities").select("activity_id", "title", "collected_at", "proposal_status")
    page = review.page_with_total(rows, review.Page(40, 20), "activity_id", "collected_at", equal={"proposal_status": "promoted"})
    return page.select("activity_id", "title", "total_rows", "total_pages")


@query("H12_pending_in_order", f"{T}, {CAND} SELECT DISTINCT activity_id FROM (SELECT activity_id FROM cand WHERE outcome IS NULL ORDER BY candidate_id LIMIT 100)")
def h12_ordered(spark, sf_dir):
    return review.pending_activities(_candidates(spark, sf_dir), 100)


@query("H04_detail", f"{T} SELECT venue_id, name, address, city FROM venues WHERE venue_id = 17")
def h04(spark, sf_dir):
    return adapt(spark, sf_dir, "venues").where("venue_id = 17").select("venue_id", "name", "address", "city")


@query("H05_queue", f"""{T}, {CAND}, a AS (SELECT activity_id, CASE WHEN activity_id % 5 = 0 THEN NULL ELSE (activity_id % 100) / 100.0::DOUBLE END AS confidence, CASE WHEN activity_id % 3 = 0 THEN venue_id END AS rid FROM activities WHERE resolution_status = 'matched')
  SELECT a.activity_id, coalesce(n, 0) AS n_candidates, v.name AS venue_name FROM a LEFT JOIN (SELECT activity_id, count(*) AS n FROM cand GROUP BY 1) c USING (activity_id) LEFT JOIN venues v ON v.venue_id = rid ORDER BY confidence DESC NULLS LAST, a.activity_id LIMIT 50""")
def h05(spark, sf_dir):
    a = adapt(spark, sf_dir, "activities").where("resolution_status = 'matched'")
    a = a.select("activity_id", F.when(F.col("activity_id") % 5 != 0, (F.col("activity_id") % 100) / 100.0).alias("confidence"), F.when(F.col("activity_id") % 3 == 0, F.col("venue_id")).alias("resolved_id"))
    top = review.list_rows(a, review.Page(1, 50), "activity_id", "confidence")
    return review.resolution_queue(top, _candidates(spark, sf_dir), adapt(spark, sf_dir, "venues")).select("activity_id", "n_candidates", "venue_name")


@query("H06_candidates", f"{T}, {CAND} SELECT candidate_id, row_number() OVER (PARTITION BY activity_id ORDER BY score DESC, c.venue_id, candidate_id) AS rank, coalesce(name, '') AS name, city FROM cand c LEFT JOIN venues v ON v.venue_id = c.venue_id")
def h06(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    from pyspark.sql import Window

    ranked = review.ranked_candidates(c, adapt(spark, sf_dir, "venues"))
    order = Window.partitionBy("activity_id").orderBy(F.desc("score"), "venue_id", "candidate_id")
    return ranked.withColumn("rank", F.row_number().over(order)).select("candidate_id", "rank", "name", "city")


@query("H07_latest_runs", f"{T} SELECT run_id, started_at FROM runs ORDER BY started_at DESC, run_id LIMIT 20")
def h07(spark, sf_dir):
    return adapt(spark, sf_dir, "runs").orderBy(F.desc("started_at"), "run_id").limit(20).select("run_id", "started_at")


@query("H08_transitions", f"""{T}, r AS (SELECT activity_id, CASE activity_id % 4 WHEN 0 THEN 'pending_review' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' ELSE 'promoted' END AS status, CASE activity_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'promoted' END AS wanted,
    CASE activity_id % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'viewer' ELSE 'reviewer' END AS role FROM activities),
  q AS (SELECT *, CASE WHEN NOT ((status = 'pending_review' AND wanted IN ('approved', 'rejected')) OR (status = 'approved' AND wanted IN ('promoted', 'rejected'))) THEN 'not_allowed' WHEN role = 'viewer' OR (wanted = 'promoted' AND role <> 'admin') THEN 'forbidden' ELSE 'done' END AS result FROM r)
  SELECT activity_id, result, CASE WHEN result = 'done' THEN wanted ELSE status END AS next_status FROM q""")
def h08(spark, sf_dir):
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("activity_id") % n + 1).cast("int"))
    r = adapt(spark, sf_dir, "activities").select("activity_id", pick(4, "pending_review", "approved", "rejected", "promoted").alias("status"), pick(3, "approved", "rejected", "promoted").alias("wanted"), pick(5, "admin", "viewer", "reviewer", "reviewer", "reviewer").alias("role"))
    return review.transition(r, spark).select("activity_id", "result", "next_status")


@query("H10_decide", f"""{T}, {CAND}, b AS (SELECT activity_id, bool_or(outcome IS NOT NULL) AS blocked FROM cand GROUP BY 1),
  rq AS (SELECT o_orderkey AS activity_id, CASE o_orderkey % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'override' ELSE 'propose_new' END AS kind, o_orderkey % 100 AS wanted, CASE WHEN o_orderkey % 2 = 0 THEN 'n' END AS notes FROM orders WHERE o_orderkey % 4 <> 0)
  SELECT candidate_id, CASE WHEN kind IS NOT NULL AND NOT blocked AND (kind <> 'override' OR notes IS NOT NULL) THEN CASE WHEN kind = 'propose_new' THEN 'skipped' WHEN venue_id = wanted THEN 'accepted' ELSE 'rejected' END ELSE outcome END AS outcome
  FROM cand JOIN b USING (activity_id) LEFT JOIN rq USING (activity_id)""")
def h10(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 4 <> 0")
    kind = F.element_at(F.array(F.lit("accept"), F.lit("override"), F.lit("propose_new")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rq = o.select(F.col("o_orderkey").alias("activity_id"), kind.alias("kind"), (F.col("o_orderkey") % 100).alias("venue_id"), F.when(F.col("o_orderkey") % 2 == 0, "n").alias("notes"))
    return review.decide(_candidates(spark, sf_dir), rq).select("candidate_id", "outcome")


@query("H11_latest_decision", f"{T} SELECT activity_id, decision_id, action FROM (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY reviewed_at DESC, decision_id DESC) AS k FROM decisions) WHERE k = 1")
def h11(spark, sf_dir):
    return review.latest(adapt(spark, sf_dir, "decisions"), "activity_id", "reviewed_at", "decision_id").select("activity_id", "decision_id", "action")


@query("H12_pending_activities")
def h12(spark, sf_dir):
    """Distinct activities among the first undecided candidates; which rows come first is not defined."""
    return _candidates(spark, sf_dir).where("outcome is null").limit(100).select("activity_id").dropDuplicates()
