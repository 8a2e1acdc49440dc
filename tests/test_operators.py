"""Operators on small tables: worked numbers, boundaries, reruns."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from placeweave.operators import metrics, posts, publishing, resolution, review, rules, upserts
from placeweave.operators.default_rules import DEFAULTS, OVER_SIXTY
from placeweave.sources import collect
from placeweave.streaming import ingest


@pytest.mark.parametrize(("name", "geo", "address", "boost", "hybrid", "final"), [
    (1.0, 0.3, None, 0.1, 0.712, 0.812), (0.646, 0.85, None, 0.1, 0.730, 0.830), (1.0, 0.85, None, 0.0, 0.938, 0.938), (1.0, 0.7, None, 0.0, 0.876, 0.876), (0.8, 0.85, None, 0.1, 0.820, 0.920), (None, None, None, 0.1, 0.0, 0.1),
])
def test_hybrid_scores(spark, name, geo, address, boost, hybrid, final):
    df = spark.createDataFrame([(name, geo, address)], "n double, g double, a double")
    got = df.select(resolution.hybrid_score(F.col("n"), F.col("g"), F.col("a"), (0.5, 0.35, 0.15)).alias("h")).first()["h"]
    assert got == pytest.approx(hybrid, abs=1e-3) and min(1.0, got + boost) == pytest.approx(final, abs=1e-3)


def test_contains_score(spark):
    m = "Museu e Casa de Cultura José de Dome (Charitas) – Centro de Cabo Frio"
    mentions = spark.createDataFrame([(1, "p", "s", m, None, "explicit_name")], "activity_id long, product_key string, source_key string, raw_text string, raw_address_text string, hint string")
    venues = spark.createDataFrame([(7, "p", "Museu e Casa de Cultura José de Dome", None, "Cabo Frio", -22.8806, -42.0187)], "venue_id long, product_key string, name string, address string, city string, lat double, lng double")
    row = resolution.resolve(mentions, venues, None, resolution.ResolutionConfig()).first()
    assert round(row["name_score"], 3) == 0.646 and row["name_method"] == "contains" and row["geo_score"] == 1.0 and row["address_score"] is None


@pytest.mark.parametrize(("scores", "want"), [([0.85, 0.5], "matched"), ([0.85, 0.9], "ambiguous"), ([0.5], "unresolved"), ([0.49], "proposed_new")])
def test_classification(spark, scores, want):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "activity_id long, venue_id long, final_score double")
    got = resolution.rank_candidates(df, resolution.ResolutionConfig()).collect()
    assert {r["classification"] for r in got} == {want} and sorted(r["rank"] for r in got) == list(range(1, len(scores) + 1))


def test_bad_config_is_refused():
    with pytest.raises(ValueError):
        resolution.ResolutionConfig(weights=(0.5, 0.5, 0.5))
    with pytest.raises(ValueError):
        resolution.ResolutionConfig(matched_at=0.4)


@pytest.mark.parametrize(("name", "types", "kind", "decision", "layer"), [
    ("Banco do Brasil", [], "place_type", "rejected", "reject"), ("Bancada de jardim", ["park"], "place_type", "accepted", "accept"), ("Museu", ["museum", "tourist_attraction"], "place_type", "accepted", "accept"),
    ("Mirante", ["tourist_attraction"], "place_type", "needs_review", "review"), ("Praça Central", ["park"], "place_type", "needs_review", "review"), ("Academia X", ["gym"], "place_type", "likely_fitness_generic", "ambiguity_fallback"),
    ("Natação Azul", ["gym"], "activity_intent", "accepted", "accept"), ("Natação Azul", ["gym"], "place_type", "likely_fitness_generic", "ambiguity_fallback"), ("Loja", [], "place_type", "needs_review", "default"),
    ("CENTRO DE CONVIVÊNCIA feliz", None, "place_type", "accepted", "accept"),
])
def test_rules(spark, name, types, kind, decision, layer):
    df = spark.createDataFrame([(name, None, types, kind)], "name string, website string, google_types array<string>, source_query_kind string")
    row = rules.classify(df, rules.resolve_rules(DEFAULTS, OVER_SIXTY)).first()
    assert (row["decision"], row["decisive_layer"]) == (decision, layer)
    if name == "Banco do Brasil":
        assert row["reasoning"] == 'Rejeitado por: reject_keyword_bank_branch (nome: "banco do brasil")'
    if layer == "default":
        assert row["matches"] == []


def test_next_occurrence_edges(spark):
    rows = [(1, 1, "2026-06-10", None, None, None), (1, 2, "2026-06-09", "10:00", None, None), (2, 1, "2026-06-09", "08:59", None, None), (3, 1, "2026-06-09", "09:00", None, None), (4, 1, "2026-06-08", None, None, None)]
    df = spark.createDataFrame(rows, "activity_id long, ord int, date string, time string, end_date string, end_time string")
    got = {r["activity_id"]: r["date"] for r in publishing.next_occurrences(df, F.lit("2026-06-09 12:00:00").cast("timestamp_ntz")).collect()}
    assert got == {1: "2026-06-09", 3: "2026-06-09"}


def test_occurrence_without_time_lasts_its_day(spark):
    df = spark.createDataFrame([(1, 1, "2026-06-09", None, None, None)], "activity_id long, ord int, date string, time string, end_date string, end_time string")
    at = lambda t: publishing.next_occurrences(df, F.lit(t).cast("timestamp_ntz")).count()
    assert at("2026-06-10 02:59:59.999") == 1 and at("2026-06-10 03:00:00") == 0


def test_insert_ignore_is_idempotent(spark):
    new = spark.createDataFrame([("a", 1, 5), ("a", 1, 3), ("b", 2, 4)], "k string, run int, raw_id int")
    first = upserts.insert_ignore(new.limit(0), new, ["k", "run"], "raw_id")
    assert sorted(map(tuple, first.collect())) == [("a", 1, 3), ("b", 2, 4)]
    assert upserts.insert_ignore(first, new, ["k", "run"], "raw_id").count() == 0


def test_duplicate_venues(spark):
    rows = [(1, "Café  Bar", 0.0, 0.0), (2, "cafe bar", 0.0, 1.0), (3, "CAFÉ BAR ", None, None), (4, "só", 0.0, 0.0), (5, "dois", 0.0, 0.0), (6, "dois", None, None)]
    got = {r["name_key"]: r for r in publishing.duplicate_venues(spark.createDataFrame(rows, "venue_id long, name string, lat double, lng double")).collect()}
    assert set(got) == {"cafe bar", "dois"} and got["cafe bar"]["members"] == 3 and got["dois"]["max_distance_m"] is None
    assert got["cafe bar"]["max_distance_m"] == pytest.approx(111194.926645, abs=1e-3)


def test_transitions(spark):
    rows = [("pending_review", "approved", "reviewer"), ("pending_review", "promoted", "admin"), ("approved", "promoted", "reviewer"), ("approved", "promoted", "admin")]
    got = [r["result"] for r in review.transition(spark.createDataFrame(rows, "status string, wanted string, role string"), spark).collect()]
    assert sorted(got) == sorted(["done", "not_allowed", "forbidden", "done"])


def test_health_limits_are_strict(spark):
    now = F.lit("2026-01-20 00:00:00").cast("timestamp")
    day = lambda n: datetime(2026, 1, n)
    sources = spark.createDataFrame([("half", 2, 4, 1, day(6)), ("drop", 1, 4, 1, None), ("few", 1, 3, 1, None), ("stale", 5, None, 5, day(5)), ("none", None, None, None, None)], "source_key string, total long, previous long, with_date long, last_published timestamp")
    runs = spark.createDataFrame([("half", "running", day(19), None), ("half", "partial", day(19), day(19))], "source_key string, status string, started_at timestamp, finished_at timestamp")
    got = sorted((r["source_key"], r["code"]) for r in metrics.source_alerts(sources, runs, now).collect())
    assert got == [("drop", "volume_drop"), ("half", "run_open"), ("half", "run_partial"), ("none", "zero_items"), ("stale", "stale_source")]


POSTS = [
    (1, "Agenda", "<p>Veja</p><p><strong>Serviço</strong></p><p><strong>Yoga no Forte</strong><br />Dia: 28 de junho de 2026<br />Horário: 7h às 8h<br />Local: Canto do Forte</p><p><strong>Baile – Clube Náutico – 16h</strong><br />Domingo, 5 de julho</p>"),
    (2, "Feira", "<p>Feira acontece todas as sextas-feiras, das 10h às 15h, na Praça Central.</p>"),
    (3, "Nada", "<p>Sem agenda.</p>"),
    (4, "Dois dias", "<p>Encontro em 1 de julho e em 3 de julho.</p>"),
]


def test_posts_end_to_end(spark):
    df = spark.createDataFrame(POSTS, "post_id long, title string, html string").select(
        "*", F.lit("src").alias("source_key"), F.lit(r"(?iu)<strong>\s*servi[çc]o:?\s*</strong>").alias("marker"), F.to_timestamp(F.lit("2026-06-20 13:00:00")).alias("at"), F.lit(True).alias("exact")
    )
    items, skipped = posts.post_items(df)
    got = {r["source_item_id"]: r for r in posts.with_recurrence(items).collect()}
    assert set(got) == {"1_0", "1_1", "2_0"}
    first, second = got["1_0"]["occurrences"][0], got["1_1"]["occurrences"][0]
    assert tuple(first) == ("2026-06-28", "07:00", None, "08:00") and got["1_0"]["venue_name"] == "Canto do Forte"
    assert (second["date"], second["time"], got["1_1"]["venue_name"]) == ("2026-07-05", "16:00", "Clube Náutico")
    assert got["2_0"]["recurrence"]["type"] == "weekly" and got["2_0"]["recurrence"]["days"] == [5] and got["2_0"]["occurrences"] == []
    assert sorted((r["post_id"], r["reason"]) for r in skipped.collect()) == [(3, "no_extractable_schedule_found"), (4, "narrative_ambiguous")]


def test_labels_far_down_in_long_posts_are_found(spark):
    many = "<br>".join(["x"] * 100_002)
    parts = " – ".join(["x"] * 1002 + ["8h às 9h"])
    html = {
        1: f"SERVIÇO<p><strong>Yoga</strong><br>{many}<br>Dia: 12 de março de 2026</p>",
        2: f"SERVIÇO<p>Evento: Feira<br>{many}<br>Dia: 12 de março de 2026</p>",
        3: f"SERVIÇO<p><strong>Yoga</strong> – {parts}<br>Dia: 12 de março de 2026</p>",
    }
    rows = [(k, v, "SERVIÇO", datetime(2026, 3, 1)) for k, v in html.items()]
    got = {r["post_id"]: r for r in posts.structured_items(spark.createDataFrame(rows, "post_id long, html string, marker string, at timestamp")).collect()}
    assert {k: r["date"] for k, r in got.items()} == dict.fromkeys(html, "2026-03-12")
    assert got[3]["time"] == "08:00"
    values = F.array(F.lit("12 de março de 2026" + "y" * 100_001))
    scans = F.expr("array(named_struct('mentions', array(named_struct('date', '2026-03-12', 'end_date', cast(null as string), 'until', false, 'end', 19)), 'issues', cast(array() as array<string>)))")
    assert spark.range(1).select(F.length(posts.schedule(values, scans)["rest"]).alias("n")).first()["n"] == 100_001


def test_sanitized_manifests(spark, tmp_path):
    df = spark.createDataFrame([(1, "2026-01-01", "failed with apikey=abc at https://u:p@h.org/x"), (1, "2026-01-02", "ok"), (2, "2026-01-03", "other version")], "version int, started_at string, reason string")
    collect.write_manifests(df, str(tmp_path / "m"))
    got = collect.read_manifests(spark, str(tmp_path / "m"), "version int, started_at string, reason string").collect()
    assert [r["started_at"] for r in got] == ["2026-01-02", "2026-01-01"] and got[1]["reason"] == "failed with <redacted-param> at <url:h.org>"


def test_stream_deduplicates(spark, tmp_path):
    rows = [("a", 1, datetime(2026, 1, 1)), ("a", 1, datetime(2026, 1, 1)), ("a", 2, datetime(2026, 1, 1))]
    spark.createDataFrame(rows, "source_key string, source_item_id long, collected_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = ingest.first_seen_items(ingest.landed(spark, str(tmp_path / "in"), "source_key string, source_item_id long, collected_at timestamp"))
    out = str(tmp_path / "out")
    ingest.run_batches(stream, lambda df: df.write.mode("append").parquet(out), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 2
