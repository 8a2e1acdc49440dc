"""Run quality, source health, platform and queue statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.functions.numbers import rate, round_up
from placeweave.functions.text import trim


def has_venue(address: Column, hint: Column) -> Column:
    """Something a geocoder could use: an address, or a venue called by name."""
    return F.coalesce(trim(address) != "", F.lit(False)) | F.coalesce(hint == "explicit_name", F.lit(False))


def exact_median(rows: DataFrame, by: list[str], value: str, width: float = 1.0) -> DataFrame:
    """by and median: the mean of the middle value, or of the two middle ones. Nulls do not count.

    Two passes over counts: values are counted by cells of some width, and only values of the cells that hold the middle
    are put in order, so no task needs all values of a group.
    """
    cells = rows.where(F.col(value).isNotNull()).withColumn("cell", F.floor(F.col(value) / width))
    sizes = cells.groupBy(*by, "cell").agg(F.count("*").alias("n"))
    w, each = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("cell")
    sizes = sizes.withColumns({"upto": F.sum("n").over(each.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(w)})
    low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1
    middle = sizes.where((F.col("upto") >= low) & (F.col("upto") - F.col("n") < high)).withColumns({"low": low - F.col("upto") + F.col("n"), "high": high - F.col("upto") + F.col("n")}).drop("n", "upto", "all")
    values = cells.groupBy(*by, "cell", value).agg(F.count("*").alias("n")).join(middle, [*by, "cell"])
    upto = F.sum("n").over(Window.partitionBy(*by, "cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    values = values.withColumn("upto", upto).withColumn("first", F.col("upto") - F.col("n"))
    hit = lambda k: (F.col(k) > F.col("first")) & (F.col(k) <= F.col("upto"))
    at = lambda k: F.max(F.when(hit(k), F.col(value)))
    return values.groupBy(*by).agg(((at("low") + at("high")) / 2).alias("median"))


def delays(items: DataFrame) -> Column:
    """Hours from publication to collection."""
    return (F.unix_micros(F.col("collected_at").cast("timestamp")) - F.unix_micros(F.col("published_at").cast("timestamp"))) / 3.6e9


def publication_delay(items: DataFrame, *by: str) -> DataFrame:
    """by, n_delay, mean_delay_h, median_delay_h and max_delay_h, to one place after the point. by: at least one column."""
    rows = items.select(*by, delays(items).alias("delay"))
    plain = rows.groupBy(*by).agg(F.count("delay").alias("n_delay"), round_up(F.avg("delay"), 1).alias("mean_delay_h"), round_up(F.max("delay"), 1).alias("max_delay_h"))
    return plain.join(exact_median(rows, list(by), "delay"), list(by), "left").select(*by, "n_delay", "mean_delay_h", round_up(F.col("median"), 1).alias("median_delay_h"), "max_delay_h")


def run_quality(items: DataFrame) -> DataFrame:
    """Quality per source and, with source_key null, over all: one pass over the items for both.

    items: source_key, source_item_id, n_occurrences, time, address, venue_text, hint, published_at, collected_at.
    """
    rows = items.select(
        "source_key", "source_item_id", (F.col("n_occurrences") > 0).alias("dated"), F.coalesce((F.col("n_occurrences") > 0) & F.col("time").isNotNull(), F.lit(False)).alias("timed"),
        F.col("venue_text").isNotNull().alias("placed"), has_venue(F.col("address"), F.col("hint")).alias("geocodable"), delays(items).alias("delay"),
    )
    total = F.count("*")
    count = lambda c: F.count_if(F.col(c))
    pairs = F.count_distinct(F.struct("source_key", "source_item_id"))
    counted = rows.groupingSets([["source_key"], []], "source_key").agg(
        F.grouping_id().alias("level"), total.alias("total"), count("dated").alias("with_date"), rate(count("dated"), total).alias("date_pct"),
        count("timed").alias("with_time"), rate(count("timed"), total).alias("time_pct"), count("placed").alias("with_venue"), rate(count("placed"), total).alias("venue_pct"),
        count("geocodable").alias("geocodable"), rate(count("geocodable"), total).alias("geocodable_pct"), (total - pairs).alias("duplicates"),
        F.count("delay").alias("n_delay"), round_up(F.avg("delay"), 1).alias("mean_delay_h"), round_up(F.max("delay"), 1).alias("max_delay_h"),
    )
    each = exact_median(rows, ["source_key"], "delay").select(F.col("source_key").alias("s"), F.lit(0).alias("l"), "median")
    whole = exact_median(rows, [], "delay").select(F.lit(None).cast("string").alias("s"), F.lit(1).alias("l"), "median")
    out = counted.join(each.unionByName(whole), F.col("source_key").eqNullSafe(F.col("s")) & (F.col("level") == F.col("l")), "left")
    return out.withColumn("median_delay_h", round_up(F.col("median"), 1)).drop("s", "l", "median")


def gate_summary(items: DataFrame) -> DataFrame:
    """Counts and shares of the geographic bands."""
    n = F.count("geographic_status")
    out = [n.alias("gated")]
    for s in ("inside_radius", "buffer_zone", "outside_region"):
        c = F.count_if(F.col("geographic_status") == s)
        out += [c.alias(s), rate(c, n).alias(f"{s}_pct")]
    return items.agg(*out)


@dataclass(frozen=True)
class HealthLimits:
    drop_pct: float = 50.0
    least_previous: int = 4
    no_date_pct: float = 50.0
    least_items: int = 2
    running_hours: float = 6.0
    stale_days: float = 14.0


def source_alerts(sources: DataFrame, runs: DataFrame, now: Column, limits: HealthLimits = HealthLimits()) -> DataFrame:
    """source_key, code, severity: all alerts.

    sources: source_key, total, previous (null: none), with_date, last_published (null: unknown), one row per source
    known from anywhere. runs: source_key, status, started_at, finished_at.
    """
    total, previous = F.coalesce("total", F.lit(0)), F.col("previous")
    days = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_published").cast("timestamp"))) / 86400.0
    drop = (previous - total) / F.nullif(previous, F.lit(0)).cast("double") * 100
    no_date = (total - F.col("with_date")) / F.nullif(total, F.lit(0)).cast("double") * 100
    own = F.array_compact(F.array(
        F.when(total == 0, _alert("zero_items", "critical")),
        F.when((total > 0) & (previous >= limits.least_previous) & (drop > limits.drop_pct), _alert("volume_drop", "warning")),
        F.when((total >= limits.least_items) & (no_date > limits.no_date_pct), _alert("high_no_date_rate", "warning")),
        F.when(days > limits.stale_days, _alert("stale_source", "warning")),
    ))
    hours = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))) / 3600.0
    of_run = (
        F.when(F.col("status") == "failed", _alert("run_failed", "critical")).when(F.col("status") == "partial", _alert("run_partial", "warning"))
        .when((F.col("status") == "running") & F.col("finished_at").isNull() & (hours > limits.running_hours), _alert("run_open", "critical"))
    )
    from_runs = runs.select("source_key", of_run.alias("a")).where("a is not null").select("source_key", "a.*")
    return sources.select("source_key", F.inline(own)).unionByName(from_runs)


def _alert(code: str, severity: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 2).when(severity == "warning", 1).otherwise(0)


def worst(sources: DataFrame, alerts: DataFrame) -> DataFrame:
    """source_key, status, n_alerts: the worst severity of every source, ok without alerts."""
    per = alerts.groupBy("source_key").agg(F.max(severity_rank(F.col("severity"))).alias("r"), F.count("*").alias("n"))
    status = F.element_at(F.array(F.lit("ok"), F.lit("warning"), F.lit("critical")), F.coalesce("r", F.lit(0)) + 1)
    return sources.select("source_key").join(per, "source_key", "left").select("source_key", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n_alerts"))


def latest_by_source(runs: DataFrame, newest: int = 20) -> DataFrame:
    """The last run of each source among the newest runs of all."""
    top = runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(newest)
    order = Window.partitionBy("source_key").orderBy(F.desc("started_at"), F.desc("run_id"))
    return top.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def budget(items: Column, per_query: int = 20, price: float = 0.032, limit: float = 10.0, alert_pct: float = 80.0) -> Column:
    """struct<queries, spent, remaining, usage_pct, alert> of a month's items."""
    queries = F.ceil(items / per_query).cast("long")
    spent = round_up(queries * price, 2)
    usage = F.floor(spent / limit * 1000 + 0.5) / 10.0
    return F.struct(queries.alias("queries"), spent.alias("spent"), round_up(limit - spent, 2).alias("remaining"), usage.alias("usage_pct"), (usage >= alert_pct).alias("alert"))


def active_activities(activities: DataFrame, today: Column) -> DataFrame:
    """Not ended, and recurring or starting today or later; without a recurrence_type a row is not active."""
    kind = F.col("recurrence_type")
    return activities.where((F.col("end_date").isNull() | (F.col("end_date") >= today)) & kind.isNotNull() & ((kind != "none") | (F.col("start_date") >= today)))
