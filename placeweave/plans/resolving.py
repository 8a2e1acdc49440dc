"""Entity resolution (family E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeweave.functions.text import ACCENTED, PLAIN, STOP_WORDS_PT, dice, jaccard, normalize, tokens, trigrams
from placeweave.operators import resolution
from placeweave.operators.resolution import ResolutionConfig
from placeweave.plans.adapters import adapt, with_tables
from placeweave.plans.places import CENTRES, SCORE, sql_haversine
from placeweave.plans.registry import query

CONFIG = ResolutionConfig()

_BARE = rf"trim(regexp_replace(regexp_replace(regexp_replace(translate(lower({{x}}), '{ACCENTED}', '{PLAIN}'), '[̀-ͯ]', '', 'g'), '[^\p{{{{L}}}}\p{{{{N}}}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS_PT)


def sql_normalize(x: str) -> str:
    bare = _BARE.format(x=x).replace("{{", "{").replace("}}", "}")
    kept = f"list_filter(string_split({bare}, ' '), lambda w: w NOT IN ({_STOPS}))"
    return f"CASE WHEN len({kept}) = 0 THEN {bare} ELSE array_to_string({kept}, ' ') END"


def sql_grams(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_transform(generate_series(1, greatest(length({x}), 1)), lambda i: substr(' ' || {x} || ' ', i, 3))) END"


def sql_tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"


def sql_dice(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


def sql_jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def _staged(spark, sf_dir):
    m = adapt(spark, sf_dir, "mentions")
    return resolution.unresolved_mentions(m.select("activity_id", "product_key", "source_key", "resolution_status", "raw_id"), m.select("raw_id", "raw_text", "raw_address_text", "hint"))


def _venues(spark, sf_dir):
    v = adapt(spark, sf_dir, "venues")
    return resolution.eligible_venues(v.select("venue_id", "product_key", "proposal_status", "raw_id"), v.select("raw_id", "name", "address", "city", "lat", "lng"), CONFIG)


T = with_tables("mentions", "venues", "contexts", "decisions")
U = "u AS (SELECT activity_id, product_key, source_key, resolution_status, nullif(raw_text, '') AS raw_text, raw_address_text, CASE WHEN raw_text <> '' THEN coalesce(hint, 'explicit_name') END AS hint FROM mentions WHERE resolution_status IN ('unresolved', 'ambiguous'))"


@query("E01_unresolved", f"{T}, {U} SELECT * FROM u")
def e01(spark, sf_dir):
    return _staged(spark, sf_dir).select("activity_id", "product_key", "source_key", "resolution_status", "raw_text", "raw_address_text", "hint")


@query("E02_eligible_venues", f"{T} SELECT venue_id, product_key, name, city FROM venues WHERE proposal_status IN ('approved', 'promoted')")
def e02(spark, sf_dir):
    return _venues(spark, sf_dir).select("venue_id", "product_key", "name", "city")


@query("E03_pool_sizes", f"{T}, {U} SELECT activity_id, count(v.venue_id) AS pool FROM u LEFT JOIN (SELECT * FROM venues WHERE proposal_status IN ('approved', 'promoted')) v USING (product_key) GROUP BY activity_id")
def e03(spark, sf_dir):
    """The pool is all of the product; its size needs no pairs."""
    pools = _venues(spark, sf_dir).groupBy("product_key").agg(F.count("*").alias("pool"))
    return _staged(spark, sf_dir).join(pools, "product_key", "left").select("activity_id", F.coalesce("pool", F.lit(0)).alias("pool"))


@query("E08_normalize", f"WITH n AS (SELECT doc_id, {sql_normalize('text')} AS norm FROM documents) SELECT doc_id, norm FROM n")
def e08(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", normalize(F.col("text")).alias("norm"))


NEXT = "p AS (SELECT a.p_partkey, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"


def _neighbours(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", F.col("p_name").alias("x")).join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("y")), "p_partkey")


@query("E09_trigram_dice", f"WITH {NEXT} SELECT p_partkey, round({sql_dice('gx', 'gy')}, 9) AS s FROM (SELECT p_partkey, {sql_grams('x')} AS gx, {sql_grams('y')} AS gy FROM p)")
def e09(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("p_partkey", F.round(dice(trigrams(F.col("x")), trigrams(F.col("y"))), 9).alias("s"))


@query("E10_token_jaccard", f"WITH {NEXT} SELECT p_partkey, round({sql_jaccard('tx', 'ty')}, 9) AS s FROM (SELECT p_partkey, {sql_tokens('x')} AS tx, {sql_tokens('y')} AS ty FROM p)")
def e10(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("p_partkey", F.round(jaccard(tokens(F.col("x")), tokens(F.col("y"))), 9).alias("s"))


def sql_name(m: str = "m", c: str = "c") -> str:
    """Value and method of two normalised names with their sets."""
    inside = f"CASE WHEN contains({m}_n, {c}_n) THEN least(0.8, 0.8 * (0.6 + coalesce(length({c}_n)::DOUBLE / nullif(length({m}_n), 0), 0) * 0.4)) WHEN contains({c}_n, {m}_n) THEN least(0.8, 0.8 * (0.5 + coalesce(length({m}_n)::DOUBLE / nullif(length({c}_n), 0), 0) * 0.5)) END"
    return f"{inside} AS s_in, CASE WHEN {sql_jaccard(m + '_t', c + '_t')} >= 0.2 THEN {sql_jaccard(m + '_t', c + '_t')} * 0.75 END AS s_tok, CASE WHEN {sql_dice(m + '_g', c + '_g')} >= 0.2 THEN {sql_dice(m + '_g', c + '_g')} * 0.7 END AS s_gram"


NAME_VALUE = "CASE WHEN m_n = c_n THEN 1.0::DOUBLE ELSE coalesce(greatest(s_in, s_tok, s_gram), 0.0)::DOUBLE END"
NAME_METHOD = "CASE WHEN m_n = c_n THEN 'exact' WHEN greatest(s_in, s_tok, s_gram) IS NULL THEN 'no_match' WHEN s_in = greatest(s_in, s_tok, s_gram) THEN 'contains' WHEN s_tok = greatest(s_in, s_tok, s_gram) THEN 'token_overlap' ELSE 'trigram' END"

# All stages of resolution, one CTE each.
STAGES = f"""{U},
done AS (SELECT activity_id FROM (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY reviewed_at DESC, decision_id DESC) AS k FROM decisions) WHERE k = 1 AND action <> 'skipped'),
todo AS (SELECT * FROM u WHERE raw_text IS NOT NULL AND activity_id NOT IN (SELECT activity_id FROM done)),
mm AS (SELECT t.*, x.city AS tcity, cc.clat AS tlat, cc.clng AS tlng, {sql_normalize('raw_text')} AS m_n, {sql_normalize('raw_address_text')} AS ma_n
  FROM todo t LEFT JOIN (SELECT * FROM contexts WHERE city IS NOT NULL AND state IS NOT NULL) x USING (source_key) LEFT JOIN {CENTRES} ON cc.label = trim(lower(x.city))),
m2 AS (SELECT *, {sql_grams('m_n')} AS m_g, {sql_tokens('m_n')} AS m_t, {sql_grams('ma_n')} AS ma_g, {sql_tokens('ma_n')} AS ma_t FROM mm),
vv AS (SELECT venue_id, product_key, name, city, lat, lng, cc.clat, cc.clng, {sql_normalize('name')} AS c_n, {sql_normalize('address')} AS ca_n
  FROM venues LEFT JOIN {CENTRES} ON cc.label = trim(lower(city)) WHERE proposal_status IN ('approved', 'promoted')),
v2 AS (SELECT *, {sql_grams('c_n')} AS c_g, {sql_tokens('c_n')} AS c_t, {sql_grams('ca_n')} AS ca_g, {sql_tokens('ca_n')} AS ca_t FROM vv),
pr AS (SELECT m2.*, v2.* EXCLUDE (product_key), {sql_haversine('tlat', 'tlng', 'lat', 'lng')} AS away FROM m2 JOIN v2 USING (product_key)
  WHERE tcity IS NULL OR coalesce(v2.city, '') = '' OR (tlat = clat AND tlng = clng)),
pk AS (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY away NULLS LAST, venue_id) AS pair_rank FROM pr WHERE away IS NULL OR away <= 5000),
sc AS (SELECT *, {sql_name()}, {SCORE.format(d=sql_haversine('clat', 'clng', 'lat', 'lng'))} AS geo, {sql_jaccard('ma_t', 'ca_t')} AS aj, {sql_dice('ma_g', 'ca_g')} AS ag,
  CASE hint WHEN 'explicit_name' THEN 0.1 WHEN 'ambiguous' THEN -0.1 ELSE 0 END::DOUBLE AS boost FROM pk WHERE pair_rank <= 50),
s2 AS (SELECT *, {NAME_VALUE} AS nv, {NAME_METHOD} AS nm,
  CASE WHEN coalesce(ma_n, '') = '' OR coalesce(ca_n, '') = '' THEN NULL WHEN ma_n = ca_n THEN 0.7 WHEN contains(ma_n, ca_n) OR contains(ca_n, ma_n)
    THEN 0.7 * (0.55 + least(length(ma_n), length(ca_n))::DOUBLE / greatest(length(ma_n), length(ca_n)) * 0.35) WHEN aj >= 0.25 THEN aj * 0.7 * 0.85 WHEN ag >= 0.15 THEN ag * 0.7 * 0.7 END::DOUBLE AS av FROM sc),
s3 AS (SELECT *, 0.5::DOUBLE + CASE WHEN geo IS NULL THEN 0 ELSE 0.35 END::DOUBLE + CASE WHEN av IS NULL THEN 0 ELSE 0.15 END::DOUBLE AS tw FROM s2),
s4 AS (SELECT *, least(1.0, greatest(0.0, nv * (0.5::DOUBLE / tw) + coalesce(geo * (0.35::DOUBLE / tw), 0) + coalesce(av * (0.15::DOUBLE / tw), 0))) AS hy FROM s3),
s5 AS (SELECT *, round(least(1.0, greatest(0.0, hy + boost)), 9) AS fs FROM s4),
rk AS (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY fs DESC, venue_id) AS rank, count(*) FILTER (fs >= 0.85) OVER (PARTITION BY activity_id) AS k1, count(*) FILTER (fs >= 0.5) OVER (PARTITION BY activity_id) AS k2 FROM s5),
rc AS (SELECT *, CASE WHEN k1 = 1 THEN 'matched' WHEN k1 > 1 THEN 'ambiguous' WHEN k2 > 0 THEN 'unresolved' ELSE 'proposed_new' END AS classification FROM rk)"""


def _todo(spark, sf_dir):
    return resolution.to_resolve(_staged(spark, sf_dir), adapt(spark, sf_dir, "decisions"))


def _ranked(spark, sf_dir, todo=None):
    return resolution.resolve(_todo(spark, sf_dir) if todo is None else todo, _venues(spark, sf_dir), adapt(spark, sf_dir, "contexts"), CONFIG)


def _outcomes(spark, sf_dir):
    return resolution.resolved_outcomes(_todo(spark, sf_dir), _venues(spark, sf_dir), adapt(spark, sf_dir, "contexts"), CONFIG)


@query("E19_to_resolve", f"{T}, {STAGES} SELECT activity_id FROM todo")
def e19(spark, sf_dir):
    return _todo(spark, sf_dir).select("activity_id")


@query("E06_candidates", f"{T}, {STAGES} SELECT activity_id, venue_id, pair_rank FROM pk WHERE pair_rank <= 50")
def e06(spark, sf_dir):
    m = resolution.prepare_mentions(_todo(spark, sf_dir), adapt(spark, sf_dir, "contexts"), CONFIG)
    return resolution.candidate_pairs(m, resolution.prepare_candidates(_venues(spark, sf_dir), CONFIG), CONFIG).select("activity_id", "venue_id", "pair_rank")


@query("E04_pool_after_filters", f"{T}, {STAGES} SELECT activity_id, count(*) AS filtered FROM pk GROUP BY activity_id")
def e04(spark, sf_dir):
    m = resolution.place_mentions(_todo(spark, sf_dir), adapt(spark, sf_dir, "contexts"), CONFIG)
    sizes = resolution.pool_members(m, resolution.prepare_candidates(_venues(spark, sf_dir), CONFIG), CONFIG).groupBy(*resolution.POOL).agg(F.count("*").alias("filtered"))
    return m.join(sizes, resolution.POOL).select("activity_id", "filtered")


@query("E11_name_score", f"{T}, {STAGES} SELECT activity_id, venue_id, round(nv, 9) AS name_score, nm AS name_method FROM s2")
def e11(spark, sf_dir):
    return _ranked(spark, sf_dir).select("activity_id", "venue_id", F.round("name_score", 9).alias("name_score"), "name_method")


@query("E12_address_score", f"{T}, {STAGES} SELECT activity_id, venue_id, round(av, 9) AS address_score FROM s2 WHERE av IS NOT NULL")
def e12(spark, sf_dir):
    return _ranked(spark, sf_dir).where("address_score is not null").select("activity_id", "venue_id", F.round("address_score", 9).alias("address_score"))


@query("E13_geo_score", f"{T}, {STAGES} SELECT activity_id, venue_id, geo AS geo_score FROM s2")
def e13(spark, sf_dir):
    return _ranked(spark, sf_dir).select("activity_id", "venue_id", "geo_score")


@query("E14_hybrid_score", f"{T}, {STAGES} SELECT activity_id, venue_id, round(hy, 9) AS hybrid_score, boost, fs AS final_score FROM s5")
def e14(spark, sf_dir):
    return _ranked(spark, sf_dir).select("activity_id", "venue_id", F.round("hybrid_score", 9).alias("hybrid_score"), "boost", "final_score")


@query("E17_resolve_classify", f"{T}, {STAGES} SELECT activity_id, venue_id, rank, fs AS final_score, classification FROM rc")
def e17(spark, sf_dir):
    return _ranked(spark, sf_dir).select("activity_id", "venue_id", "rank", "final_score", "classification")


_PRIMARY = "CASE WHEN nm <> 'no_match' THEN nm WHEN geo IS NOT NULL THEN 'geo' WHEN av IS NOT NULL THEN CASE WHEN ma_n = ca_n THEN 'exact' WHEN contains(ma_n, ca_n) OR contains(ca_n, ma_n) THEN 'contains' WHEN aj >= 0.25 THEN 'token_overlap' ELSE 'trigram' END ELSE 'hybrid' END"


@query("E21_primary_method", f"{T}, {STAGES} SELECT activity_id, venue_id, {_PRIMARY} AS primary_method FROM rc")
def e21(spark, sf_dir):
    return _ranked(spark, sf_dir).select("activity_id", "venue_id", "primary_method")


OUT = f"""{STAGES}, oc AS (SELECT t.activity_id, coalesce(max(r.classification), 'proposed_new') AS status, max(CASE WHEN r.rank = 1 THEN r.venue_id END) AS top_id, max(r.fs) AS score, count(r.venue_id) AS n_candidates,
  max(r.fs) AS max_score, round(avg(r.fs), 6) AS avg_score, min(r.fs) AS min_score FROM todo t LEFT JOIN rc r USING (activity_id) GROUP BY t.activity_id)"""


@query("E18_outcomes", f"""{T}, {OUT} SELECT activity_id, status, CASE status WHEN 'matched' THEN 'success' WHEN 'ambiguous' THEN 'partial' ELSE 'unresolved' END AS kind,
  CASE WHEN status NOT IN ('matched', 'ambiguous') THEN 'all_below_threshold' END AS reason, CASE WHEN status = 'matched' THEN top_id END AS resolved_venue_id, score, n_candidates,
  max_score, avg_score, min_score, status = 'ambiguous' AS override_required FROM oc""")
def e18(spark, sf_dir):
    return _outcomes(spark, sf_dir)


@query("E23_batch_summary", f"""{T}, {OUT} SELECT count(*) AS total, count(*) FILTER (status = 'matched') AS succeeded, count(*) FILTER (status = 'ambiguous') AS partial,
  count(*) FILTER (status NOT IN ('matched', 'ambiguous')) AS unresolved, 0::BIGINT AS failed FROM oc""")
def e23(spark, sf_dir):
    return resolution.batch_summary(_outcomes(spark, sf_dir))


@query("E26_contexts", f"{T} SELECT activity_id, c.city FROM mentions LEFT JOIN (SELECT * FROM contexts WHERE city IS NOT NULL AND state IS NOT NULL) c USING (source_key)")
def e26(spark, sf_dir):
    m = resolution.prepare_mentions(adapt(spark, sf_dir, "mentions"), adapt(spark, sf_dir, "contexts"), CONFIG)
    return m.select("activity_id", F.col("trusted_city").alias("city"))


OLD = "old AS (SELECT l_orderkey * 10 + l_linenumber AS candidate_id, l_orderkey % 300 AS activity_id, CASE WHEN l_linenumber = 1 THEN 'accepted' END AS outcome FROM lineitem), fresh AS (SELECT DISTINCT l_orderkey % 300 AS activity_id FROM lineitem WHERE l_orderkey % 3 = 0)"


@query("E20_regenerate", f"WITH {OLD} SELECT candidate_id, activity_id, outcome FROM old WHERE outcome IS NOT NULL OR activity_id NOT IN (SELECT activity_id FROM fresh) UNION ALL SELECT NULL, activity_id, NULL FROM fresh")
def e20(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    old = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("candidate_id"), (F.col("l_orderkey") % 300).alias("activity_id"), F.when(F.col("l_linenumber") == 1, "accepted").alias("outcome"))
    fresh = li.where("l_orderkey % 3 = 0").select((F.col("l_orderkey") % 300).alias("activity_id")).distinct()
    return resolution.regenerate(old, fresh).select("candidate_id", "activity_id", "outcome")


_MOVED = T.replace("venues AS (", "venues_before AS (", 1) + """, venues AS (SELECT * REPLACE (CASE WHEN venue_id % 100 = 7 THEN name || ' novo' ELSE name END AS name,
  CASE WHEN venue_id % 100 = 9 THEN 'Iguaba Grande' ELSE city END AS city, CASE WHEN venue_id % 100 = 11 THEN 'rejected' ELSE proposal_status END AS proposal_status) FROM venues_before)"""


@query("E20_refresh", f"{_MOVED}, {STAGES} SELECT activity_id, venue_id, rank, fs AS final_score, classification FROM rc")
def e20_refresh(spark, sf_dir):
    """Some venues get another name, city or status; the mentions that share a pool with one are resolved again, the others stay."""
    k = F.col("venue_id") % 100
    v = adapt(spark, sf_dir, "venues")
    moved = v.withColumns({
        "name": F.when(k == 7, F.concat("name", F.lit(" novo"))).otherwise(F.col("name")), "city": F.when(k == 9, "Iguaba Grande").otherwise(F.col("city")),
        "proposal_status": F.when(k == 11, "rejected").otherwise(F.col("proposal_status")),
    })
    after = resolution.eligible_venues(moved.select("venue_id", "product_key", "proposal_status", "raw_id"), moved.select("raw_id", "name", "address", "city", "lat", "lng"), CONFIG)
    todo, contexts = _todo(spark, sf_dir), adapt(spark, sf_dir, "contexts")
    out = resolution.refresh(_ranked(spark, sf_dir, todo), todo, _venues(spark, sf_dir), after, contexts, CONFIG)
    return out.select("activity_id", "venue_id", "rank", "final_score", "classification")


@query("E27_human_accept", f"""{T}, a AS (SELECT activity_id, CASE WHEN activity_id % 4 = 0 THEN 'approved' ELSE 'pending_review' END AS proposal_status FROM mentions WHERE activity_id % 10 <> 9),
  c AS (SELECT activity_id, activity_id % 50 AS venue_id, 0.5::DOUBLE AS final_score FROM mentions WHERE activity_id % 3 <> 0),
  l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY reviewed_at DESC, decision_id DESC) AS k FROM decisions) WHERE k = 1),
  j AS (SELECT m.activity_id, m.activity_id % 50 AS venue_id, CASE WHEN a.proposal_status IS NULL THEN 'not_found' WHEN a.proposal_status <> 'pending_review' THEN 'not_pending' WHEN c.venue_id IS NULL THEN 'not_a_candidate'
    WHEN l.action = 'matched' AND l.accepted_id = m.activity_id % 50 THEN 'unchanged' WHEN l.action IS NOT NULL THEN 'conflict' ELSE 'accepted' END AS result, c.final_score
    FROM mentions m LEFT JOIN a USING (activity_id) LEFT JOIN c ON c.activity_id = m.activity_id LEFT JOIN l ON l.activity_id = m.activity_id)
  SELECT activity_id, venue_id, result, CASE WHEN result = 'accepted' THEN final_score END AS confidence FROM j""")
def e27(spark, sf_dir):
    m = adapt(spark, sf_dir, "mentions").select("activity_id", (F.col("activity_id") % 50).alias("venue_id"))
    acts = m.where("activity_id % 10 <> 9").select("activity_id", F.when(F.col("activity_id") % 4 == 0, "approved").otherwise("pending_review").alias("proposal_status"))
    cands = m.where("activity_id % 3 <> 0").withColumn("final_score", F.lit(0.5))
    last = adapt(spark, sf_dir, "decisions").groupBy("activity_id").agg(F.max(F.struct("reviewed_at", "decision_id", "action", "accepted_id")).alias("d")).select("activity_id", "d.action", "d.accepted_id")
    return resolution.human_accept(m, acts, cands, last)
