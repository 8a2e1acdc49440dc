"""URL filters as a sort-merge range join.

Reversing a host's labels and appending the path makes "this host, below this path" a prefix, and a prefix is an
interval in sorted order: it opens at the key and closes behind all keys that begin with it. A rule also fits
subdomains, so a url gives one point for each level of its host that a rule may have. Openings, points and closings
are range partitioned by key and swept in order. Prefix intervals are nested or apart, so a running count of openings
less closings is the height of the stack of active rules, and the top of the stack is the last rule that opened at
the present height. A point takes the top of its stack; of the levels of a url the longest rule wins.

Defined results: a null url, or one without ``://``, has empty host and path and so the default verdict; a rule
without a host fits nothing; repeated urls all get the same answer; the longest fitting rule wins (characters of host
and path, then of the host); of rules with the same host and path a blocking one wins; an empty table of rules gives
the default verdict everywhere, an empty table of pages an empty table; urls may be of any length. pages may hold
columns of any names; its own host, path, rule and verdict columns are replaced, even where one of them is the url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.llm.shared import materialize, packed, row_hash, unpacked

#: Ends the host part of a key; sorts before every character that a host or path holds.
END = "\x01"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OPEN, POINT, CLOSE = 0, 1, 2
#: Rows with one url are dealt to as many groups.
SALTS = 64


def url_host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    """Bytes of the reversed host and the path; byte 255 stands in no text, so key and 255 follow all that begin with key."""
    return F.concat(F.concat_ws(".", labels), F.lit(END), path).cast("binary")


def rule_events(rules: DataFrame) -> DataFrame:
    """key, kind, delta, rule of the opening and the closing of every rule. rules: host, path, verdict."""
    named = rules.where("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    text = F.concat("host", "path")
    rule = F.struct(F.length(text).alias("n"), F.length("host").alias("m"), text.alias("rule"), F.col("verdict"))
    key = _key(F.reverse(F.split("host", r"\.")), F.col("path"))
    opening = F.struct(key.alias("key"), F.lit(OPEN).alias("kind"), F.lit(1).alias("delta"), rule.alias("rule"))
    closing = F.struct(F.concat(key, F.lit(b"\xff")).alias("key"), F.lit(CLOSE).alias("kind"), F.lit(-1).alias("delta"), F.lit(None).cast("struct<n:int,m:int,rule:string,verdict:string>").alias("rule"))
    return named.select(F.inline(F.array(opening, closing)))


def sweep(events: DataFrame) -> DataFrame:
    """The points of events with the rule on top of the stack, where there is one.

    events: key, kind, delta, rule, and host, path, salt of points. Between partitions only one row for each and for each
    of its heights of the stack is carried.
    """
    dealt = materialize(events.repartitionByRange("key", "kind", "host", "salt").withColumn("pid", F.spark_partition_id()), "url-sweep")
    earlier = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("pid").agg(F.sum("delta").alias("net")).select("pid", F.coalesce(F.sum("net").over(earlier), F.lit(0)).alias("base"))
    here = Window.partitionBy("pid").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    high = dealt.withColumn("up", F.sum("delta").over(here)).join(base, "pid").withColumn("height", F.col("base") + F.col("up")).where(f"kind <> {CLOSE} and height > 0")
    high = materialize(high.drop("base", "up", "delta"), "url-heights")
    before = Window.partitionBy("height").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    last = high.groupBy("pid", "height").agg(F.max(F.when(F.col("kind") == OPEN, F.struct("key", "rule")))["rule"].alias("last"))
    carried = last.select("pid", "height", F.last("last", ignorenulls=True).over(before).alias("carried"))
    same = Window.partitionBy("pid", "height").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = high.withColumn("seen", F.last("rule", ignorenulls=True).over(same)).where(f"kind = {POINT}")
    return seen.join(carried, ["pid", "height"]).select("host", "path", "salt", F.coalesce("seen", "carried").alias("rule"))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (like ``net/``; null where none fits) and verdict to pages."""
    host, path = url_host_path(F.col(f"`{url_col}`"))
    row = packed(pages)
    parts = pages.select(row.alias("row"), host.alias("host"), path.alias("path"), F.pmod(row_hash(pages), F.lit(SALTS)).cast("int").alias("salt"))
    openings = materialize(rule_events(rules), "rule-events")
    deepest = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first()["n"] or 0  # one number
    labels = F.reverse(F.split("host", r"\."))
    levels = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(labels), F.lit(deepest))))
    points = (
        parts.where("host <> ''").select("host", "path", "salt").distinct()
        .withColumn("level", F.explode(levels))
        .select("host", "path", "salt", _key(F.slice(labels, F.lit(1), F.col("level")), F.col("path")).alias("key"), F.lit(POINT).alias("kind"), F.lit(0).alias("delta"))
    )
    found = sweep(points.unionByName(openings, allowMissingColumns=True)).groupBy("host", "path", "salt").agg(F.max("rule").alias("best"))
    named = parts.where("host <> ''").join(found, ["host", "path", "salt"], "left").select("row", "host", "path", "best")
    bare = parts.where("host = ''").select("row", "host", "path", F.lit(None).cast(found.schema["best"].dataType).alias("best"))
    own = ("host", "path", "rule", "verdict")
    return named.unionByName(bare).select(
        *unpacked(F.col("row"), pages.columns, own), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
