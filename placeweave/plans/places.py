"""Geography and rule classification (families C and D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeweave.functions import geo
from placeweave.operators import gating, nearby, rules
from placeweave.plans.adapters import adapt, with_tables
from placeweave.plans.registry import query

HAV = "round(2 * 6371000.0::DOUBLE * atan2(sqrt({a}), sqrt(1 - ({a}))), 6)"


def sql_haversine(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2))"
    return HAV.format(a=a)


V = with_tables("venues")
CENTRE = ("-22.8806::DOUBLE", "-42.0187::DOUBLE")
DIST = sql_haversine(*CENTRE, "lat", "lng")


def _to_centre():
    return geo.haversine(F.lit(-22.8806), F.lit(-42.0187), F.col("lat"), F.col("lng"))


@query("D01_haversine", f"{V} SELECT venue_id, {DIST} AS distance_m FROM venues")
def d01(spark, sf_dir):
    return adapt(spark, sf_dir, "venues").select("venue_id", _to_centre().alias("distance_m"))


@query("D02_band", f"{V} SELECT venue_id, CASE WHEN {DIST} <= 4000 THEN 'inside_radius' WHEN {DIST} <= 4500 THEN 'buffer_zone' ELSE 'outside_region' END AS band FROM venues WHERE lat IS NOT NULL")
def d02(spark, sf_dir):
    return adapt(spark, sf_dir, "venues").where("lat is not null").select("venue_id", geo.band(_to_centre(), F.lit(4000.0)).alias("band"))


SCORE = "CASE WHEN {d} IS NULL THEN NULL WHEN {d} < 100 THEN 1.0 WHEN {d} < 500 THEN 0.85 WHEN {d} < 1000 THEN 0.7 WHEN {d} < 2000 THEN 0.5 WHEN {d} < 5000 THEN 0.3 ELSE 0.0 END::DOUBLE"


@query("D07_distance_score", f"{V} SELECT venue_id, {SCORE.format(d=DIST)} AS score FROM venues")
def d07(spark, sf_dir):
    return adapt(spark, sf_dir, "venues").select("venue_id", geo.distance_score(_to_centre()).alias("score"))


CENTRES = "(VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in geo.CITY_CENTRES.items()) + ") AS cc(label, clat, clng)"


@query("D08_city_centre", f"{V} SELECT venue_id, clat, clng FROM venues LEFT JOIN {CENTRES} ON label = trim(lower(city))")
def d08(spark, sf_dir):
    c = geo.city_centre(F.col("city"))
    return adapt(spark, sf_dir, "venues").select("venue_id", c["lat"].alias("clat"), c["lng"].alias("clng"))


@query("D09_box_then_radius", f"{V} SELECT venue_id FROM venues WHERE {DIST} <= 1500")
def d09(spark, sf_dir):
    south, north, west, east = geo.bounding_box(-22.8806, -42.0187, 1500.0)
    return adapt(spark, sf_dir, "venues").where(F.col("lat").between(south, north) & F.col("lng").between(west, east) & (_to_centre() <= 1500.0)).select("venue_id")


@query("D10_usable_coordinates", f"{with_tables('public_venues')} SELECT venue_id, lat IS NOT NULL AND lng IS NOT NULL AND lat <> 0 AND lng <> 0 AS usable FROM public_venues")
def d10(spark, sf_dir):
    return adapt(spark, sf_dir, "public_venues").select("venue_id", geo.usable_coordinates(F.col("lat"), F.col("lng")).alias("usable"))


@query("D11_nearest", f"{V} SELECT product_key, venue_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY product_key ORDER BY {DIST}, venue_id) AS rn FROM venues WHERE lat IS NOT NULL) WHERE rn <= 5")
def d11(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("product_key").orderBy("d", "venue_id")
    near = adapt(spark, sf_dir, "venues").where("lat is not null").withColumn("d", _to_centre())
    return near.withColumn("rn", F.row_number().over(order)).where("rn <= 5").select("product_key", "venue_id", "rn")


@query("D11_around_each", f"""{with_tables('venues', 'public_venues')}, w AS (SELECT p.public_id AS centre_id, v.venue_id, {sql_haversine('p.lat', 'p.lng', 'v.lat', 'v.lng')} AS distance_m FROM public_venues p, venues v)
  SELECT centre_id, venue_id, distance_m FROM w WHERE distance_m <= 300""")
def d11_around_each(spark, sf_dir):
    """All places within 300 m of each of all published places."""
    centres = adapt(spark, sf_dir, "public_venues").select(F.col("public_id").alias("centre_id"), F.col("lat").alias("centre_lat"), F.col("lng").alias("centre_lng"))
    return nearby.within_radius(centres, adapt(spark, sf_dir, "venues").select("venue_id", "lat", "lng"), 300.0).select("centre_id", "venue_id", "distance_m")


VR = with_tables("venues", "regions")
GATED_SQL = f"""
d AS (SELECT v.*, r.region_key, coalesce(radius_m, 0) AS radius_m, CASE WHEN r.region_key IS NULL THEN 0 ELSE {sql_haversine('center_lat', 'center_lng', 'lat', 'lng')} END AS distance_m
  FROM venues v LEFT JOIN regions r ON r.label = v.source_region_label),
g AS (SELECT *, CASE WHEN region_key IS NULL OR distance_m <= radius_m THEN 'inside_radius' WHEN distance_m <= radius_m + 500 THEN 'buffer_zone' ELSE 'outside_region' END AS geographic_status FROM d)"""


@query("D03_classify_distance", f"{VR}, {GATED_SQL} SELECT venue_id, region_key, distance_m, geographic_status FROM g")
def d03(spark, sf_dir):
    return gating.classify_distance(adapt(spark, sf_dir, "venues"), adapt(spark, sf_dir, "regions")).select("venue_id", "region_key", "distance_m", "geographic_status")


# A rule set over the star schema: types are p_type and p_brand in lower case, keywords are words of names.
PART_RULES = rules.RuleSet(
    reject_types=(rules.TypeRule("rt_promo", ("promo", "brand#13")),),
    reject_keywords=(rules.KeywordRule("rk_bolt", ("bolt", "old spring ")),),
    accept_types=(rules.TypeRule("at_standard", ("standard", "brand#21")), rules.TypeRule("at_b3", ("brand#32", "brand#33"))),
    accept_keywords=(rules.KeywordRule("ak_ring", ("ring", "wheel"), "name_or_website"),),
    review_keywords=(rules.KeywordRule("vk_small", ("small", "Größe")),),
    review_types=(rules.TypeRule("vt_economy", ("economy",)), rules.TypeRule("vt_b4", ("brand#41",))),
    weak_reviews=("vt_economy",),
    reinforcement=rules.KeywordRule("ak_meant", ("gear", "valve")),
    fallback=rules.TypeRule("fb_medium", ("medium", "small", "large")),
    fallback_label="likely_fitness_generic",
    fallback_reason="Genérico",
)


def _typed(spark, sf_dir):
    v = adapt(spark, sf_dir, "venues")
    site = F.when(F.col("size") % 3 == 0, F.concat(F.lit("loja wheel "), F.col("brand"))).otherwise(F.lit(None).cast("string"))
    return v.withColumns({"google_types": F.array(F.lower("category"), F.lower("brand")), "website": site, "source_query_kind": F.when(F.col("size") % 2 == 0, "activity_intent").otherwise("place_type")})


# The same rules as first-hit expressions; every hit is a list entry of (rule, layer, field, value).
def _has(kw: str, text: str = "lower(name)") -> str:
    return f"regexp_matches({text}, '(^|\\s){kw}(\\s|$)')"


def _entry(rule: str, layer: str, on: str, hit: str) -> str:
    return f"CASE WHEN ({hit}) IS NOT NULL THEN {{'rule_id': '{rule}', 'layer': '{layer}', 'matched_on': {on}, 'matched_value': ({hit})}} END"


def _types(*names: str) -> str:
    return "CASE " + " ".join(f"WHEN lower(category) = '{n}' OR lower(brand) = '{n}' THEN '{n}'" for n in names) + " END"


_RING = f"CASE WHEN {_has('ring')} THEN 'ring' WHEN {_has('wheel')} THEN 'wheel' END"
_SITE = "CASE WHEN size % 3 = 0 THEN 'wheel' END"
_MEANT = f"CASE WHEN size % 2 = 0 THEN CASE WHEN {_has('gear')} THEN 'gear' WHEN {_has('valve')} THEN 'valve' END END"
_GT = "'google_types'"
MATCHES_SQL = "list_filter([" + ", ".join([
    _entry("rt_promo", "reject", _GT, _types("promo", "brand#13")),
    _entry("rk_bolt", "reject", "'name'", f"CASE WHEN {_has('bolt')} THEN 'bolt' WHEN {_has('old spring')} THEN 'old spring ' END"),
    _entry("at_standard", "accept", _GT, _types("standard", "brand#21")),
    _entry("at_b3", "accept", _GT, _types("brand#32", "brand#33")),
    _entry("ak_ring", "accept", f"CASE WHEN ({_RING}) IS NOT NULL THEN 'name' ELSE 'website' END", f"coalesce({_RING}, {_SITE})"),
    _entry("ak_meant", "accept", "'name'", _MEANT),
    _entry("vk_small", "review", "'name'", f"CASE WHEN {_has('small')} THEN 'small' END"),
    _entry("vt_economy", "review", _GT, _types("economy")),
    _entry("vt_b4", "review", _GT, _types("brand#41")),
    _entry("fb_medium", "ambiguity_fallback", _GT, f"CASE WHEN ({_MEANT}) IS NULL THEN {_types('medium', 'small', 'large')} END"),
]) + "], lambda x: x IS NOT NULL)"


def _reason(prefix: str, layer: str) -> str:
    where = "CASE x.matched_on WHEN 'google_types' THEN 'tipo' WHEN 'name' THEN 'nome' ELSE 'website' END"
    return f"'{prefix} por: ' || array_to_string(list_transform(list_filter(m, lambda x: x.layer = '{layer}'), lambda x: x.rule_id || ' (' || {where} || ': \"' || x.matched_value || '\")'), '; ')"


def _any(layer: str, extra: str = "") -> str:
    return f"len(list_filter(m, lambda x: x.layer = '{layer}'{extra})) > 0"


CLASSIFIED_SQL = f"""
mm AS (SELECT *, {MATCHES_SQL} AS m FROM venues),
ll AS (SELECT *, CASE WHEN {_any('reject')} THEN 'reject' WHEN {_any('review', " AND x.rule_id <> 'vt_economy'")} OR ({_any('review')} AND NOT {_any('accept')}) THEN 'review'
  WHEN {_any('accept')} THEN 'accept' WHEN {_any('ambiguity_fallback')} THEN 'ambiguity_fallback' ELSE 'default' END AS decisive_layer FROM mm),
cl AS (SELECT *, CASE decisive_layer WHEN 'reject' THEN 'rejected' WHEN 'accept' THEN 'accepted' WHEN 'ambiguity_fallback' THEN 'likely_fitness_generic' ELSE 'needs_review' END AS decision,
  CASE decisive_layer WHEN 'reject' THEN {_reason(rules.REJECTED, 'reject')} WHEN 'review' THEN {_reason(rules.REVIEW, 'review')} WHEN 'accept' THEN {_reason(rules.ACCEPTED, 'accept')}
    WHEN 'ambiguity_fallback' THEN {_reason('Genérico', 'ambiguity_fallback')} ELSE '{rules.NO_RULE}' END AS reasoning,
  CASE decisive_layer WHEN 'default' THEN 0 ELSE len(m) END AS n_matches FROM ll)"""


@query("C07_classify", f"{V}, {CLASSIFIED_SQL} SELECT venue_id, decision, decisive_layer, reasoning, n_matches FROM cl")
def c07(spark, sf_dir):
    return rules.classify(_typed(spark, sf_dir), PART_RULES).select("venue_id", "decision", "decisive_layer", "reasoning", F.size("matches").alias("n_matches"))


@query("C06_matches", f"{V}, {CLASSIFIED_SQL} SELECT venue_id, x.rule_id, x.layer, x.matched_on, x.matched_value FROM (SELECT venue_id, unnest(m) AS x FROM mm)")
def c06(spark, sf_dir):
    return _typed(spark, sf_dir).select("venue_id", F.inline(rules.all_matches(PART_RULES)))


COUNTS = "count(*) AS total, count(*) FILTER (decision = 'accepted') AS accepted, count(*) FILTER (decision = 'needs_review') AS needs_review, count(*) FILTER (decision = 'rejected') AS rejected, count(*) FILTER (decision = 'likely_fitness_generic') AS ambiguous"


@query("C10_summary", f"{V}, {CLASSIFIED_SQL} SELECT {COUNTS} FROM cl")
def c10(spark, sf_dir):
    return rules.summarize(rules.classify(_typed(spark, sf_dir), PART_RULES))


@query("C11_by_category", f"{V}, {CLASSIFIED_SQL} SELECT category, {COUNTS} FROM cl GROUP BY category")
def c11(spark, sf_dir):
    return rules.summarize(rules.classify(_typed(spark, sf_dir), PART_RULES), "category")


@query("C01_resolved_rules", "SELECT * FROM (VALUES ('default', 8, 5, 6), ('extend', 9, 5, 6), ('override', 1, 5, 6)) AS t(mode, reject_types, reject_keywords, accept_types)")
def c01(spark, sf_dir):
    from placeweave.operators.default_rules import DEFAULTS

    own = rules.RuleSet(reject_types=(rules.TypeRule("own", ("zoo",)),))
    found = [(m, rules.resolve_rules(DEFAULTS, own, {"reject_types": m})) for m in ("default", "extend", "override")]
    return spark.createDataFrame([(m, len(r.reject_types), len(r.reject_keywords), len(r.accept_types)) for m, r in found], "mode string, reject_types int, reject_keywords int, accept_types int")


_OWN = "CASE WHEN category LIKE '%BRASS' THEN 'extend' WHEN category LIKE '%TIN' THEN 'override' ELSE 'default' END"


@query("C01_rules_by_category", f"""{V}, m AS (SELECT venue_id, category, {_OWN} AS mode, lower(category) LIKE '%steel%' AS base, lower(category) LIKE '%promo%' AS own FROM venues)
  SELECT venue_id, mode, CASE mode WHEN 'default' THEN base WHEN 'override' THEN own ELSE base OR own END AS rejected FROM m""")
def c01_by_category(spark, sf_dir):
    """Each category of places has its way of joining its own rules to the defaults; the rules it ends up with judge its places."""
    venues = adapt(spark, sf_dir, "venues")
    own = rules.RuleSet(reject_types=(rules.TypeRule("own", ("promo",)),))
    base = rules.RuleSet(reject_types=(rules.TypeRule("base", ("steel",)),))
    mode = F.when(F.col("category").endswith("BRASS"), "extend").when(F.col("category").endswith("TIN"), "override").otherwise("default")
    typed = venues.select("venue_id", F.split(F.lower("category"), " ").alias("types"), mode.alias("mode"))
    hit = lambda r: F.arrays_overlap("types", F.array(*[F.lit(t) for rule in r.reject_types for t in rule.types]))
    judged = F.coalesce(*[F.when(F.col("mode") == m, hit(rules.resolve_rules(base, own, {"reject_types": m}))) for m in ("default", "extend", "override")])
    return typed.select("venue_id", "mode", judged.alias("rejected"))


GATE_SQL = f"""{CLASSIFIED_SQL}, {GATED_SQL}, z AS (SELECT g.venue_id, g.category, g.region_key, g.distance_m, g.geographic_status, g.radius_m, cl.decision AS d0, cl.decisive_layer AS l0, cl.reasoning AS r0,
  g.geographic_status = 'buffer_zone' AND cl.decision = 'accepted' AS flip FROM g JOIN cl USING (venue_id))"""


@query("D04_gate", f"""{VR}, {GATE_SQL} SELECT venue_id, geographic_status, CASE WHEN flip THEN 'needs_review' ELSE d0 END AS decision, CASE WHEN flip THEN 'review' ELSE l0 END AS decisive_layer,
  CASE WHEN flip THEN r0 || '{gating.NOTE[0]}' || floor(distance_m + 0.5)::BIGINT || '{gating.NOTE[1]}' || radius_m::BIGINT || '{gating.NOTE[2]}' ELSE r0 END AS reasoning FROM z""")
def d04(spark, sf_dir):
    located = gating.classify_distance(_typed(spark, sf_dir), adapt(spark, sf_dir, "regions"))
    return gating.apply_gate(rules.classify(located, PART_RULES)).select("venue_id", "geographic_status", "decision", "decisive_layer", "reasoning")


@query("D06_geo_report", f"""{VR}, {GATE_SQL} SELECT category, count(*) FILTER (geographic_status = 'inside_radius') AS inside, count(*) FILTER (geographic_status = 'buffer_zone') AS buffer,
  count(*) FILTER (geographic_status = 'outside_region') AS outside, count(*) FILTER (geographic_status = 'outside_region' AND d0 = 'accepted') AS accepted_outside FROM z WHERE region_key IS NOT NULL GROUP BY category""")
def d06(spark, sf_dir):
    located = gating.classify_distance(_typed(spark, sf_dir), adapt(spark, sf_dir, "regions")).where("region_key is not null")
    at = lambda s: F.count_if(F.col("geographic_status") == s)
    return rules.classify(located, PART_RULES).groupBy("category").agg(
        at("inside_radius").alias("inside"), at("buffer_zone").alias("buffer"), at("outside_region").alias("outside"),
        F.count_if((F.col("geographic_status") == "outside_region") & (F.col("decision") == "accepted")).alias("accepted_outside"),
    )


@query("D05_gate_only_with_regions", f"{V} SELECT venue_id, CASE WHEN product_key < 'p2' THEN 'inside_radius' END AS geographic_status FROM venues WHERE source_region_label IS NULL")
def d05(spark, sf_dir):
    """A source without regions leaves the status null."""
    lone = adapt(spark, sf_dir, "venues").where("source_region_label is null")
    gated = gating.classify_distance(lone.where("product_key < 'p2'"), adapt(spark, sf_dir, "regions")).select("venue_id", "geographic_status")
    return gated.unionByName(lone.where("product_key >= 'p2'").select("venue_id", F.lit(None).cast("string").alias("geographic_status")))
