"""Idempotent loads, run logs and cleanups. Every function returns rows or the next snapshot; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW_KEY = ["source_key", "source_item_id", "run_id"]


def insert_ignore(existing: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """The rows to append: the first of each key in order whose key is not there yet."""
    rest = [c for c in incoming.columns if c not in key and c != order]
    first = incoming.groupBy(*key).agg(F.min(F.struct(order, *rest)).alias("r")).select(*key, "r.*").select(*incoming.columns)
    return first.join(existing.select(*key).distinct(), key, "left_anti")


def stage_venues(existing: DataFrame, classified: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staging rows to append, and classified rows without a raw row.

    Rejected rows stop here; a place staged before, in any run, keeps its row and its geographic status.
    """
    live = classified.where("decision <> 'rejected'")
    ids = raw.groupBy("source_key", "source_item_id").agg(F.min("raw_id").alias("raw_id"))
    linked = live.drop("raw_id").join(ids, ["source_key", "source_item_id"]).withColumn("proposal_status", F.lit("pending_review"))
    lost = live.join(ids, ["source_key", "source_item_id"], "left_anti")
    return insert_ignore(existing, linked, ["source_key", "source_item_id", "product_key"], "raw_id"), lost


def stage_activities(existing: DataFrame, items: DataFrame) -> DataFrame:
    """Staging rows to append, one per raw row that has none."""
    fresh = items.join(existing.select("raw_id").distinct(), "raw_id", "left_anti")
    return fresh.withColumns({"resolution_status": F.lit("unresolved"), "proposal_status": F.lit("pending_review")})


def reprocess(raw: DataFrame, source_key: str, product_key: str) -> DataFrame:
    """Raw rows of a source and product, to run through the same stages again."""
    return raw.where((F.col("source_key") == source_key) & (F.col("product_key") == product_key))


def latest_state(log: DataFrame, key: str, at: str) -> DataFrame:
    """The last entry of each run in an append-only log."""
    rest = [c for c in log.columns if c not in (key, at)]
    return log.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("r")).select(key, "r.*")


def close_orphans(runs: DataFrame, product: Column, now: Column) -> DataFrame:
    """The run log with every running run of a product marked failed."""
    orphan = (F.col("status") == "running") & (F.col("product_key") == product)
    return runs.withColumns({"finished_at": F.when(orphan, now).otherwise(F.col("finished_at")), "status": F.when(orphan, "failed").otherwise(F.col("status"))})


def backfill(child: DataFrame, parent: DataFrame, key: str, column: str) -> DataFrame:
    """child with its null column values taken from the parent of the same key."""
    p = parent.select(key, F.col(column).alias("_from"))
    return child.join(p, key, "left").withColumn(column, F.coalesce(column, "_from")).drop("_from")


OCCURRENCES = "array<struct<date:string,time:string,endDate:string,endTime:string>>"


def parse_occurrences(payload: Column) -> Column:
    """struct<value, valid> of a JSON array, or of a JSON string that holds one; each element needs a date."""
    text = F.when(payload.rlike(r"\A\s*\""), F.from_json(F.concat(F.lit('{"x":'), payload, F.lit("}")), "x string")["x"]).otherwise(payload)
    value = F.from_json(text, OCCURRENCES)
    valid = F.coalesce(text.rlike(r"(?s)\A\s*\[.*\]\s*\z") & value.isNotNull() & F.forall(value, lambda o: o["date"].isNotNull()), F.lit(False))
    return F.struct(F.when(valid, value).alias("value"), valid.alias("valid"))


def rollback_refusals(run: DataFrame, staged: DataFrame, decided: DataFrame) -> DataFrame:
    """reason and n: what keeps a run's raw rows from being removed. run: raw_id; staged: raw_id, staging_id, promoted; decided: staging_id."""
    mine = staged.join(run, "raw_id", "left_semi")
    promoted = mine.where("promoted").agg(F.lit("promoted").alias("reason"), F.count("*").alias("n"))
    judged = mine.join(decided, "staging_id", "left_semi").agg(F.lit("decided").alias("reason"), F.count("*").alias("n"))
    return promoted.unionByName(judged)


def rollback(rows: DataFrame, run: DataFrame, refusals: DataFrame) -> DataFrame:
    """rows without those of the run, unless something refuses."""
    blocked = refusals.agg((F.sum("n") > 0).alias("blocked"))
    kept = rows.join(run.withColumn("gone", F.lit(True)), "raw_id", "left").crossJoin(F.broadcast(blocked))  # one row
    return kept.where(F.col("gone").isNull() | F.col("blocked")).drop("gone", "blocked")
