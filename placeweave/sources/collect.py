"""Sources: planning of queries, landed posts and places, budgets, manifests, error classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeweave.functions.text import SPACE, trim
from placeweave.operators.ranges import deal, sum_before

POST_SCHEMA = (
    "id long, date string, date_gmt string, link string, title struct<rendered:string>, content struct<rendered:string>, "
    "categories array<int>, yoast_head_json struct<og_image:array<struct<url:string>>>"
)


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Landed posts: JSON files, one array or one post per line."""
    return spark.read.schema(POST_SCHEMA).option("multiLine", True).json(path)


def posts_since(posts: DataFrame, since: Column) -> DataFrame:
    """Posts published at or after since (an instant). Partitioned by date, older files are not read."""
    from placeweave.functions.dates_pt import gmt_instant

    return posts.withColumn("published_at", gmt_instant(F.col("date_gmt"))).where(F.col("published_at") >= since)


def place_queries(regions: DataFrame, categories: DataFrame) -> DataFrame:
    """Every category in every region, as text. Both tables are configuration: a handful of rows each."""
    both = regions.crossJoin(categories)  # a small grid by definition
    return both.withColumn("query_text", F.concat(F.col("category_text"), F.lit(" em "), F.col("region_label")))


def enrich(places: DataFrame, details: DataFrame, key: str = "place_id") -> DataFrame:
    """Places with their details where there are any."""
    return places.join(details, key, "left")


def first_seen(found: DataFrame, key: str, order: str, hint: str) -> DataFrame:
    """One row per key, the first in order; the hints of the later ones follow in alternates, in order."""
    fields = F.struct(order, *[c for c in found.columns if c not in (key, order)])
    in_order = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(hint).alias("h"))))
    alternates = F.transform(F.filter(in_order, lambda x, i: i > 0), lambda x: x["h"])
    return found.groupBy(key).agg(F.min(fields).alias("r"), alternates.alias("alternates")).select(key, "r.*", "alternates")


def to_canonical(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable places, and the rejected: closed for good, or without id, name or point."""
    good = F.coalesce((F.col("business_status") != "CLOSED_PERMANENTLY") | F.col("business_status").isNull(), F.lit(True))
    for c in ("place_id", "name", "lat", "lng"):
        good = good & F.col(c).isNotNull()
    tidy = {"name": trim(F.col("name")), "business_status": F.coalesce("business_status", F.lit("OPERATIONAL"))}
    return places.where(good).withColumns(tidy), places.where(~good)


def budget_gate(calls: DataFrame, budget: float, alert_pct: float, hard_stop: bool = True) -> DataFrame:
    """Adds spent (before the call), allowed and alert to calls in order of seq, per provider. Costs are constant.

    There are a handful of providers, so the running sum of each is cut into ranges of seq. Costs are added as decimals.
    """
    summed = sum_before(calls, ["provider"], "seq", F.col("cost").cast("decimal(18,9)"))
    out = summed.withColumn("spent", F.round(F.col("before").cast("double"), 6)).drop("before")
    fits = F.round(F.col("spent") + F.col("cost"), 6) <= budget
    return out.withColumns({"allowed": fits if hard_stop else F.lit(True), "alert": F.col("spent") / budget >= alert_pct})


def error_reason(message: Column) -> Column:
    """The leading ``name:`` of a message, else other."""
    return F.coalesce(F.nullif(F.regexp_extract(message, r"\A([a-z][a-z0-9_]{0,63}):", 1), F.lit("")), F.lit("other"))


# Network codes, by whether trying again may help.
TRANSIENT = ["ECONNRESET", "ETIMEDOUT", "ECONNREFUSED", "ECONNABORTED", "EPIPE", "EAI_AGAIN", "UND_ERR_CONNECT_TIMEOUT", "UND_ERR_HEADERS_TIMEOUT", "UND_ERR_BODY_TIMEOUT", "UND_ERR_SOCKET"]
PERMANENT = ["ENOTFOUND", "CERT_HAS_EXPIRED", "ERR_TLS_CERT_ALTNAME_INVALID", "UNABLE_TO_VERIFY_LEAF_SIGNATURE"]


def error_class(message: Column, name: Column, status: Column, code: Column) -> Column:
    """env_guard, http_transient, http_permanent, persistence, network_permanent, network_transient or unknown."""
    seen = F.regexp_extract(message, rf"(?i)(?:falhou|HTTP){SPACE}*\(?(\d{{3}})\)?", 1)
    http = F.coalesce(status, F.nullif(seen, F.lit("")).cast("int"))
    return (
        F.when((name == "EnvGuardError") | message.rlike(r"\A\[envGuard:"), "env_guard")
        .when(http.isin(408, 429) | http.between(500, 599), "http_transient").when(http.between(400, 499), "http_permanent")
        .when(message.rlike(r"Repository\.|insertBatch|ingestion_runs?(?![A-Za-z0-9_])"), "persistence")
        .when(code.isin(PERMANENT), "network_permanent").when(code.isin(TRANSIENT), "network_transient").when(F.contains(message, F.lit("ENOTFOUND")), "network_permanent")
        .when(message.rlike("|".join(TRANSIENT)) | name.isin("AbortError", "TimeoutError") | message.rlike(r"(?i)fetch failed|socket hang up|network error|timed? ?out"), "network_transient")
        .otherwise("unknown")
    )


def backoff_ms(attempt: Column, base: int = 2000, most: int = 15000) -> Column:
    return F.least(F.lit(most), (base * F.pow(F.lit(2.0), attempt - 1)).cast("long"))


# Names of parameters that hold credentials.
CREDENTIALS = "x-api-key|api[_-]?key|apikey|access[_-]?token|refresh[_-]?token|id[_-]?token|auth[_-]?token|client[_-]?secret|secret|password|passwd|authorization|token"
_QUOTE = r"""(?:\\*["'])?"""
MOST_TEXT = 300


def sanitize(text: Column) -> Column:
    """Text without secrets, with urls reduced to hosts and white space collapsed, of 300 characters at most and an ellipsis."""
    out = F.regexp_replace(text, r"(?i)sb_(secret|publishable)_[A-Za-z0-9_-]*", "<redacted>")
    out = F.regexp_replace(out, r"eyJ[A-Za-z0-9_-]*(\.[A-Za-z0-9_-]*)*", "<redacted>")
    out = F.regexp_replace(out, rf"(?i)(?<![A-Za-z0-9_])(bearer|basic){SPACE}+[^\s\"',;}}]+", "$1 <redacted>")
    out = F.regexp_replace(out, r"(?i)(?<![A-Za-z0-9_])[a-z][a-z0-9+.-]*://(?:[^\s\"'<>/@]*@)?([A-Za-z0-9.-]+)[^\s\"'<>]*", "<url:$1>")
    out = F.regexp_replace(out, r"(?i)<url:[A-Za-z0-9.-]*\.supabase\.co>", "<url:supabase>")
    out = F.regexp_replace(out, r"(?i)[a-z0-9]{20}\.supabase\.co", "<supabase-host>")
    value = r"""(?:"[^"\\]*"|'[^'\\]*'|\\*["']?(?:(?:bearer|basic)\s+)?[^\s"'\\&,;}]+)"""
    out = F.regexp_replace(out, rf"(?i){_QUOTE}(?<![A-Za-z0-9_])(?:{CREDENTIALS}|key){_QUOTE}{SPACE}*[=:]{SPACE}*{value}", "<redacted-param>")
    out = trim(F.regexp_replace(F.regexp_replace(out, r"(?i)service_role", "<role>"), f"{SPACE}+", " "))
    return F.when(F.length(out) > MOST_TEXT, F.concat(F.substring(out, 1, MOST_TEXT), F.lit("…"))).otherwise(out)


# What no manifest may hold, by name.
FORBIDDEN = {
    "sb_secret": r"(?i)sb_secret_",
    "sb_publishable": r"(?i)sb_publishable_",
    "jwt": r"eyJ[A-Za-z0-9_-]{4,}",
    "service_role": r"(?i)service_role",
    "credential_param": rf"(?i)(?<![A-Za-z0-9_])(?:{CREDENTIALS}){_QUOTE}{SPACE}*[=:]",
    "bearer": rf"(?i)(?<![A-Za-z0-9_])(?:bearer|basic){SPACE}+(?!<redacted)[A-Za-z0-9._~+/=-]{{6,}}",
    "supabase_url": r"(?i)[a-z0-9]{20}\.supabase\.co",
    "env_var_assignment": rf"SUPABASE_SERVICE_KEY{SPACE}*=",
}


def forbidden(text: Column) -> Column:
    """Names of the forbidden patterns that text holds."""
    return F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in FORBIDDEN.items()]))


def write_manifests(manifests: DataFrame, path: str) -> None:
    """Run manifests as JSON, with every text column sanitised; a manifest that still holds a secret fails the write."""
    texts = [c for c, t in manifests.dtypes if t == "string"]
    # As one column made by explode, so that the filter reads the sanitised texts and does not make them anew for each pattern.
    dealt = deal(manifests, manifests.columns[0])
    safe = dealt.withColumn("_safe", F.explode(F.array(F.struct(F.lit(True), *[sanitize(F.col(c)).alias(c) for c in texts])))).select(*[F.col(f"_safe.{c}") if c in texts else c for c in manifests.columns])
    held = reduce(lambda a, b: a | b, [F.coalesce(F.size(forbidden(F.col(c))) > 0, F.lit(False)) for c in texts], F.lit(False))
    safe.where(F.when(held, F.raise_error(F.lit("a manifest holds a secret"))).otherwise(F.lit(True))).write.json(path)


def known_manifests(spark: SparkSession, path: str, schema: str, version: int = 1) -> DataFrame:
    """Manifests of the known version, in no order."""
    return spark.read.schema(schema).json(path).where(F.col("version") == version)


def read_manifests(spark: SparkSession, path: str, schema: str, version: int = 1) -> DataFrame:
    """Manifests of the known version, newest first."""
    return known_manifests(spark, path, schema, version).orderBy(F.desc("started_at"))


def recent_sources(runs: DataFrame, now: Column, hours: float = 20.0) -> DataFrame:
    """source_key of real runs that ended well within the last hours."""
    age = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("finished_at").cast("timestamp"))) / 3600.0
    return runs.where((F.col("status") == "success") & (F.col("dry_run") == 0) & (age <= hours)).select("source_key").distinct()


def plan_sources(regions: DataFrame, registry: DataFrame, paid: list[str]) -> DataFrame:
    """region_key, source_key, plan (planned or refused) and reason. regions: region_key, sources (array)."""
    each = regions.select("region_key", F.explode("sources").alias("source_key")).join(registry.select("source_key").distinct().withColumn("known", F.lit(True)), "source_key", "left")
    reason = F.when(F.col("source_key").isin(paid), "paid").when(F.col("known").isNull(), "not_registered")
    return each.select("region_key", "source_key", F.when(reason.isNull(), "planned").otherwise("refused").alias("plan"), reason.alias("reason"))


def region_violations(regions: DataFrame) -> DataFrame:
    """region_key and violation of each broken rule. regions: region_key, label, lat, lng, radius_m, sources."""
    twice = F.count("*").over(Window.partitionBy("region_key")) > 1
    centre, radius = F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.col("radius_m")
    rules = {
        "bad_key": ~F.col("region_key").rlike(r"\A[a-z][a-z0-9_]*\z"), "duplicate_key": twice, "empty_label": trim(F.col("label")) == "",
        "centre_without_radius": centre != radius.isNotNull(), "bad_coordinates": ~F.col("lat").between(-90, 90) | ~F.col("lng").between(-180, 180),
        "bad_radius": (radius <= 0) | (radius > 50000) | (radius != F.floor(radius)), "duplicate_sources": F.size(F.array_distinct("sources")) != F.size("sources"),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))
    return regions.select("region_key", found.alias("found")).select("region_key", F.explode("found").alias("violation"))
