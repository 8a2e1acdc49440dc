"""Publishing: which staged rows are inserted, updated, archived or skipped, and the snapshots that follow.

Decisions are DataFrames; preview counts them and publishing applies them. Clocks are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.functions.geo import usable_coordinates
from placeweave.functions.text import SPACE, fold, trim
from placeweave.operators.nearby import farthest

# Kinds of structured recurrence, and hours between source time and UTC.
RECURRENCES = ["daily", "weekly", "biweekly", "monthly"]
SOURCE_OFFSET_HOURS = 3


def venue_sets(staged: DataFrame) -> DataFrame:
    """Adds selection: unpublished, dirty_candidate or to_archive; rows in none of them are left out."""
    live = (F.col("proposal_status") == "promoted") & (F.coalesce("geographic_status", F.lit("")) != "outside_region")
    linked = F.col("promoted_id").isNotNull()
    chosen = F.when(live & ~linked, "unpublished").when(live & linked, "dirty_candidate").when((F.col("proposal_status") == "rejected") & linked, "to_archive")
    return staged.withColumn("selection", chosen).where("selection is not null")


def venue_decisions(selected: DataFrame, published: DataFrame) -> DataFrame:
    """Adds action to the selected venues. published: public_id, last_published_at."""
    state = published.select(F.col("public_id").alias("promoted_id"), "last_published_at")
    out = selected.join(state, "promoted_id", "left")
    action = (
        F.when(F.col("selection") == "unpublished", "insert").when(F.col("selection") == "to_archive", "archive")
        .when(F.col("last_published_at").isNull(), "error").when(F.col("collected_at") <= F.col("last_published_at"), "skip_not_dirty").otherwise("update")
    )
    return out.withColumn("action", action)


def activity_set(staged: DataFrame) -> DataFrame:
    """Promoted activities whose venue is matched or proposed, with the list they are in: never published, or possibly changed."""
    live = staged.where((F.col("proposal_status") == "promoted") & F.col("resolution_status").isin("matched", "proposed_new"))
    return live.withColumn("list", F.when(F.col("promoted_id").isNull(), "unpublished").otherwise("dirty"))


def comparison_instant(date: Column, time: Column) -> Column:
    """When an occurrence ceases to lie ahead (UTC, without zone): its start, or the end of its day without a time."""
    start = F.to_timestamp_ntz(F.concat(date, F.lit(" "), F.coalesce(time, F.lit("00:00")), F.lit(":00")))
    local = F.when(time.isNull(), start + F.expr("INTERVAL '1' DAY") - F.expr("INTERVAL '0.001' SECOND")).otherwise(start)
    return local + F.expr(f"INTERVAL '{SOURCE_OFFSET_HOURS}' HOUR")


def next_occurrences(occurrences: DataFrame, as_of: Column) -> DataFrame:
    """activity_id, date, time, end_date, end_time of the first occurrence at or after as_of (ties: by ord)."""
    ahead = occurrences.withColumn("instant", comparison_instant(F.col("date"), F.col("time"))).where(F.col("instant") >= as_of)
    first = F.min(F.struct("instant", "ord", "date", "time", "end_date", "end_time")).alias("n")
    return ahead.groupBy("activity_id").agg(first).select("activity_id", "n.date", "n.time", "n.end_date", "n.end_time")


def stored_range(date: Column, time: Column, end_date: Column, end_time: Column) -> tuple[Column, Column]:
    """start_date and end_date as stored: local time taken as is."""
    at = lambda d, t: F.to_timestamp_ntz(F.concat(d, F.lit(" "), F.coalesce(t, F.lit("00:00")), F.lit(":00")))
    return at(date, time), at(end_date, end_time)


def valid_recurrence(kind: Column, days: Column) -> Column:
    weekly = kind.isin("weekly", "biweekly")
    return F.coalesce(kind.isin(*RECURRENCES) & (~weekly | (F.coalesce(F.size(days), F.lit(0)) > 0)), F.lit(False))


def event_time(time: Column) -> Column:
    """HH:MM where it is a time of day, else null."""
    return F.when(time.rlike(r"\A(?:[01]\d|2[0-3]):[0-5]\d\z"), time)


def human_gate(activities: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds approved: the latest decision is a match with an accepted candidate. decisions: activity_id, reviewed_at, ..."""
    last = decisions.groupBy("activity_id").agg(F.max(F.struct("reviewed_at", "decision_id", "action", "accepted_id")).alias("d"))
    ok = last.select("activity_id", ((F.col("d.action") == "matched") & F.col("d.accepted_id").isNotNull()).alias("approved"))
    return activities.join(ok, "activity_id", "left").withColumn("approved", F.coalesce("approved", F.lit(False)))


def activity_decisions(activities: DataFrame, published: DataFrame, decisions: DataFrame, venues: DataFrame, occurrences: DataFrame, as_of: Column) -> DataFrame:
    """Adds action, next occurrence and public venue to the selected activities, by the first rule that applies.

    published: public_key (the activity's stable key), public_id, last_published_at. venues: venue_id, public_id, lat, lng.
    """
    state = published.select("public_key", F.col("public_id").alias("state_id"), "last_published_at")
    places = venues.select("venue_id", F.col("public_id").alias("public_venue_id"), usable_coordinates(F.col("lat"), F.col("lng")).alias("located"))
    out = human_gate(activities, decisions).join(state, "public_key", "left").join(places, "venue_id", "left").join(next_occurrences(occurrences, as_of), "activity_id", "left")
    alive = F.col("date").isNotNull() | valid_recurrence(F.col("recurrence_type"), F.col("days"))
    new, located = F.col("state_id").isNull(), F.coalesce("located", F.lit(False))
    action = (
        F.when((F.col("resolution_status") == "matched") & ~F.col("approved"), "skip_missing_human_decision")
        .when(new & F.col("promoted_id").isNotNull(), "error").when(new & ~located, "skip_no_location").when(new & ~alive, "skip_expired").when(new, "insert")
        .when(F.col("collected_at") <= F.col("last_published_at"), "skip_not_dirty").when(~alive, "archive_expired").otherwise("update")
    )
    return out.withColumn("action", action)


def transform_activity(decided: DataFrame) -> DataFrame:
    """The published fields of decided activities."""
    start, end = stored_range(F.col("date"), F.col("time"), F.col("end_date"), F.col("end_time"))
    ok = valid_recurrence(F.col("recurrence_type"), F.col("days"))
    return decided.select(
        "activity_id", "title", start.alias("start_date"), end.alias("end_date"), F.col("public_venue_id").alias("venue_id"), "source_key",
        F.when(ok, F.col("recurrence_type")).otherwise("none").alias("recurrence_type"), F.when(ok, F.col("days")).alias("recurrence_days"),
        F.when(ok, F.col("recurrence_time")).otherwise(event_time(F.col("time"))).alias("recurrence_time"),
    )


def venue_name(curated: Column, raw: Column) -> Column:
    """The curated name if it has any character, else the raw one; both trimmed."""
    return F.coalesce(F.nullif(trim(curated), F.lit("")), trim(raw))


def archive_end(now: Column) -> Column:
    """The end date that an archived row takes: midnight two days before now."""
    return F.date_sub(now.cast("date"), 2).cast("timestamp_ntz")


def apply_decisions(public: DataFrame, decided: DataFrame, now: Column, archived_end: Column) -> DataFrame:
    """The next snapshot of public rows (public_id, title, end_date, engine_status, last_published_at).

    An update takes the new title and revives the row; an archive ends it two days before now; inserts append.
    """
    changes = decided.where(F.col("action").isin("update", "archive_expired")).select(F.col("state_id").alias("public_id"), "action", F.col("title").alias("new_title"))
    kept = public.join(changes, "public_id", "left").select(
        "public_id", F.when(F.col("action") == "update", F.col("new_title")).otherwise(F.col("title")).alias("title"),
        F.when(F.col("action") == "archive_expired", archived_end).otherwise(F.col("end_date")).alias("end_date"),
        F.when(F.col("action") == "update", "active").when(F.col("action") == "archive_expired", "archived").otherwise(F.col("engine_status")).alias("engine_status"),
        F.when(F.col("action").isNotNull(), now).otherwise(F.col("last_published_at")).alias("last_published_at"),
    )
    added = decided.where("action = 'insert'").select((F.col("activity_id") + 9_000_000).alias("public_id"), "title", F.lit(None).cast("timestamp_ntz").alias("end_date"), F.lit("active").alias("engine_status"), now.alias("last_published_at"))
    return kept.unionByName(added)


# The event that each applied action leaves.
EVENTS = {"insert": "Inserted", "update": "Updated", "archive": "Archived", "archive_expired": "Archived"}


def run_metrics(decided: DataFrame) -> DataFrame:
    """Counts per outcome and the run's status."""
    count = lambda *a: F.count_if(F.col("action").isin(*a))
    errors = count("error")
    return decided.agg(count("insert").alias("inserted"), count("update").alias("updated"), count("archive", "archive_expired").alias("archived"), F.count_if(F.col("action").startswith("skip")).alias("skipped"), errors.alias("errors"), F.when(errors > 0, "partial").otherwise("success").alias("status"))


def name_key(name: Column) -> Column:
    """Folded and collapsed, punctuation kept."""
    return F.regexp_replace(trim(fold(name)), f"{SPACE}+", " ")


def duplicate_venues(venues: DataFrame) -> DataFrame:
    """name_key, members and the largest distance between any two members with coordinates, for names used twice or more.

    Points are made distinct first, and a name's cells say which of them can be farthest apart.
    """
    keyed = venues.withColumn("name_key", name_key(F.col("name")))
    groups = keyed.groupBy("name_key").agg(F.count("*").alias("members")).where("members > 1")
    points = keyed.where("lat is not null and lng is not null").select("name_key", "lat", "lng").distinct().join(groups, "name_key", "left_semi")
    far = farthest(points, "name_key")
    located = keyed.where("lat is not null and lng is not null").groupBy("name_key").agg(F.count("*").alias("located"))
    out = groups.join(far, "name_key", "left").join(located, "name_key", "left")
    return out.select("name_key", "members", F.when(F.col("located") > 1, F.col("far_m")).alias("max_distance_m"))


def bucket_samples(decided: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first n rows of each action, with how many more there are."""
    per = Window.partitionBy("action")
    totals = decided.groupBy("action").agg(F.count("*").alias("total"))
    top = decided.withColumn("position", F.row_number().over(per.orderBy(key))).where(F.col("position") <= n)
    return top.join(totals, "action").select("action", "position", key, F.greatest(F.col("total") - n, F.lit(0)).alias("more"))
