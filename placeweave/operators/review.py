"""Review lists, queues and the state machine of proposals."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeweave.operators.ranges import page_rows

# Allowed transitions, and who may take them.
TRANSITIONS = [("pending_review", "approved"), ("pending_review", "rejected"), ("approved", "promoted"), ("approved", "rejected")]
ROLES = {
    "approved": ("reviewer", "admin"), "rejected": ("reviewer", "admin"), "promoted": ("admin",),
    "accept": ("reviewer", "admin"), "override": ("reviewer", "admin"), "propose_new": ("admin",),
}


def may(role: Column, wanted: Column) -> Column:
    """Whether a role may take an action."""
    return F.coalesce(reduce(lambda out, item: out.when(wanted == item[0], role.isin(*item[1])), ROLES.items(), F), F.lit(False))


@dataclass(frozen=True)
class Page:
    """A page of a list: from 1 on, of 1 to 100 rows."""

    number: int = 1
    size: int = 20

    def __post_init__(self) -> None:
        object.__setattr__(self, "number", max(1, self.number))
        object.__setattr__(self, "size", min(100, max(1, self.size)))

    @property
    def offset(self) -> int:
        return (self.number - 1) * self.size

    def total_pages(self, rows: int) -> int:
        return ceil(rows / self.size)


def list_rows(rows: DataFrame, page: Page, id_col: str, sort_by: str, descending: bool = True, equal: dict[str, str] | None = None, like: dict[str, str] | None = None) -> DataFrame:
    """One page of the rows that match, by sort_by and then id. Search comes before paging."""
    for col, value in (equal or {}).items():
        rows = rows.where(F.col(col) == value)
    for col, part in (like or {}).items():
        rows = rows.where(F.contains(F.lower(col), F.lit(part.lower())))
    key = F.desc_nulls_last(sort_by) if descending else F.asc_nulls_last(sort_by)
    return rows.orderBy(key, id_col).offset(page.offset).limit(page.size)


def page_with_total(rows: DataFrame, page: Page, id_col: str, sort_by: str, descending: bool = True, equal: dict[str, str] | None = None) -> DataFrame:
    """One page of the rows that match, with total_rows and total_pages; a page far down costs no more than the first."""
    for col, value in (equal or {}).items():
        rows = rows.where(F.col(col) == value)
    out, total = page_rows(rows, page.offset, page.size, sort_by, id_col, descending)
    return out.withColumns({"total_rows": F.lit(total).cast("long"), "total_pages": F.lit(page.total_pages(total))})


def pending_activities(candidates: DataFrame, limit: int) -> DataFrame:
    """Distinct activities of the first ``limit`` candidates without an outcome, by candidate id."""
    first = candidates.where("outcome is null").orderBy("candidate_id").limit(limit)
    return first.select("activity_id").distinct()


def resolution_queue(activities: DataFrame, candidates: DataFrame, venues: DataFrame) -> DataFrame:
    """Activities with their number of candidates and the name of their venue: aggregates and joins, one job."""
    counts = candidates.groupBy("activity_id").agg(F.count("*").alias("n_candidates"))
    names = venues.select(F.col("venue_id").alias("resolved_id"), F.col("name").alias("venue_name"))
    return activities.join(counts, "activity_id", "left").join(names, "resolved_id", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))


def ranked_candidates(candidates: DataFrame, venues: DataFrame) -> DataFrame:
    """Candidates by score with their place in the list; unknown venues have an empty name and no city."""
    order = Window.partitionBy("activity_id").orderBy(F.desc("score"), "venue_id")
    out = candidates.join(venues.select("venue_id", "name", "city"), "venue_id", "left")
    return out.withColumns({"rank": F.row_number().over(order), "name": F.coalesce("name", F.lit(""))})


def transition(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """Adds result and next_status. rows: status, wanted, role.

    not_allowed: no such transition; forbidden: the role may not take it.
    """
    steps = spark.createDataFrame([(a, b, list(ROLES[b])) for a, b in TRANSITIONS], "status string, wanted string, roles array<string>")
    out = rows.join(F.broadcast(steps), ["status", "wanted"], "left")  # four rows
    result = F.when(F.col("roles").isNull(), "not_allowed").when(~F.array_contains("roles", F.col("role")), "forbidden").otherwise("done")
    return out.withColumn("result", result).withColumn("next_status", F.when(F.col("result") == "done", F.col("wanted")).otherwise(F.col("status"))).drop("roles")


def decide(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome of every candidate after the requests.

    requests: activity_id, kind (accept, override or propose_new), venue_id, notes. An activity with a decided
    candidate is blocked; an override needs notes. Accepting one candidate rejects all others; proposing a new venue
    skips all.
    """
    decided = candidates.groupBy("activity_id").agg(F.bool_or(F.col("outcome").isNotNull()).alias("blocked"))
    r = requests.withColumnRenamed("venue_id", "wanted")
    out = candidates.join(decided, "activity_id").join(r, "activity_id", "left")
    valid = F.col("kind").isNotNull() & ~F.col("blocked") & ((F.col("kind") != "override") | (F.coalesce("notes", F.lit("")) != ""))
    new = F.when(F.col("kind") == "propose_new", "skipped").when(F.col("venue_id") == F.col("wanted"), "accepted").otherwise("rejected")
    return out.withColumn("outcome", F.when(valid, new).otherwise(F.col("outcome"))).select(*candidates.columns)


def latest(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The row of each key with the greatest time, ties by the greatest tie."""
    fields = [at, tie, *[c for c in rows.columns if c not in (key, at, tie)]]
    return rows.groupBy(key).agg(F.max(F.struct(*fields)).alias("r")).select(key, "r.*")
