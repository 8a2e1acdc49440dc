"""Expressions at their edges, with values worked out by hand."""

import uuid
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from placeweave.functions import dates_pt, geo, identity, numbers, recurrence, text
from placeweave.operators.date_scan import scan


def one(spark, column, *values, schema):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


def text_of(spark, column, value):
    return one(spark, column, value, schema="t string")


@pytest.mark.parametrize(("value", "want"), [
    ("Museu e Casa de Cultura José de Dome (Charitas) – Centro de Cabo Frio", "museu casa cultura jose dome charitas centro cabo frio"),
    ("de da", "de da"), ("", ""), ("  São João ", "sao joao"), ("Ção ñandu", "cao nandu"),
])
def test_normalize(spark, value, want):
    assert text_of(spark, text.normalize(F.col("t")), value) == want


def test_set_similarities(spark):
    s = lambda a, b, f: one(spark, f(F.col("a"), F.col("b")), a, b, schema="a array<string>, b array<string>")
    assert s([], [], text.jaccard) == 1.0 and s(["a"], [], text.jaccard) == 0.0 and s([], [], text.dice) == 0.0
    assert s(["a", "b"], ["b", "c"], text.jaccard) == pytest.approx(1 / 3) and s(["a", "b"], ["b", "c"], text.dice) == 0.5


def test_strip_html(spark):
    html = "<p>A&nbsp;b<br />c</p><p>d &amp; e</p>\n\n\n<b>f</b>&#8217; "
    assert text_of(spark, text.strip_html(F.col("t")), html) == "A b\nc\nd & e\n\nf’"


@pytest.mark.parametrize(("value", "digits", "want"), [(2.5, 0, 3.0), (-2.5, 0, -2.0), (0.25, 1, 0.3), (1.005, 1, 1.0)])
def test_rounding(spark, value, digits, want):
    assert one(spark, numbers.round_up(F.col("x"), digits), value, schema="x double") == want


def test_rate(spark):
    assert one(spark, numbers.rate(F.col("a"), F.col("b")), 1, 3, schema="a int, b int") == 33.3
    assert one(spark, numbers.rate(F.col("a"), F.col("b")), 1, 0, schema="a int, b int") is None


@pytest.mark.parametrize(("metres", "want"), [(4000.0, "inside_radius"), (4000.000001, "buffer_zone"), (4500.0, "buffer_zone"), (4500.1, "outside_region")])
def test_bands(spark, metres, want):
    assert one(spark, geo.band(F.col("d"), F.lit(4000.0)), metres, schema="d double") == want


@pytest.mark.parametrize(("metres", "want"), [(99.9, 1.0), (100.0, 0.85), (499.0, 0.85), (500.0, 0.7), (1999.0, 0.5), (4999.0, 0.3), (5000.0, 0.0), (None, None)])
def test_distance_scores(spark, metres, want):
    assert one(spark, geo.distance_score(F.col("d")), metres, schema="d double") == want


def test_haversine(spark):
    assert one(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.col("a"), F.lit(0.0)), 1.0, schema="a double") == pytest.approx(111194.926645, abs=1e-5)


def test_city_centres_keep_accents_unless_asked(spark):
    assert text_of(spark, geo.city_centre(F.col("t")), "São Pedro da Aldeia") is None
    assert text_of(spark, geo.city_centre(F.col("t"), fold_accents=True), "São Pedro da Aldeia")["lat"] == -22.8386
    assert text_of(spark, geo.city_centre(F.col("t")), " CABO FRIO ")["lng"] == -42.0187


@pytest.mark.parametrize("name", ["prefeitura_cabo_frio:1_0", "", "é:😀"])
def test_uuid5(spark, name):
    want = str(uuid.uuid5(uuid.UUID(identity.ACTIVITY_NAMESPACE), name))
    assert text_of(spark, identity.uuid5(F.col("t")), name) == want
    assert name != "prefeitura_cabo_frio:1_0" or want == "9ff51acc-318a-586d-a68f-6f43da5946ef"


@pytest.mark.parametrize(("value", "want"), [("7h", "07:00"), ("às 19h30", "19:30"), ("25h", None), ("9h75", None), ("nada", None), ("7H5", "07:00")])
def test_times(spark, value, want):
    assert text_of(spark, dates_pt.parse_time(F.col("t")), value) == want


@pytest.mark.parametrize(("value", "loose", "want"), [
    ("das 7h às 8h", True, ("07:00", "08:00")), ("a partir das 16h", True, ("16:00", None)), ("às19h30", True, ("19:30", None)), ("às19h30", False, (None, None)),
    ("16h", True, ("16:00", None)), ("às 25h", True, (None, None)), ("praça", True, (None, None)),
])
def test_time_ranges(spark, value, loose, want):
    assert tuple(text_of(spark, dates_pt.parse_time_range(F.col("t"), loose), value)) == want


def test_impossible_dates(spark):
    d = lambda y, m, n: one(spark, dates_pt.iso_date(F.lit(y), F.lit(m), F.col("d")), n, schema="d int")
    assert d(2026, 2, 31) is None and d(2026, 13, 1) is None and d(2028, 2, 29) == "2028-02-29"


@pytest.mark.parametrize(("day", "month", "at", "want"), [
    (10, 1, "2026-12-20", "2027-01-10"), (20, 12, "2027-01-05", "2026-12-20"), (1, 11, "2026-10-29", "2026-11-01"), (20, 4, "2026-11-10", None),
])
def test_year_near(spark, day, month, at, want):
    got = spark.createDataFrame([(day, month, at)], "d int, m int, t string").select(dates_pt.year_near(F.col("d"), F.col("m"), F.to_timestamp("t")).alias("x")).first()["x"]
    assert got == want


def test_day_with_weekday(spark):
    at = F.to_timestamp(F.lit("2026-10-29 12:00:00"))
    assert one(spark, dates_pt.day_with_weekday(F.col("d"), F.lit(2), at), 3, schema="d int") == "2026-11-03"


AT = datetime(2026, 10, 29, 12, tzinfo=timezone.utc)


@pytest.mark.parametrize(("value", "dates", "issues"), [
    ("de 10 a 12 de outubro de 2026", [("2026-10-10", "2026-10-12")], []),
    ("dias 7, 8 e 9 de novembro", [("2026-11-07", None), ("2026-11-08", None), ("2026-11-09", None)], []),
    ("Dia 21/10/2026 às 9h", [("2026-10-21", None)], []),
    ("Em 3/4 de xícara", [], []),
    ("terça (03)", [("2026-11-03", None)], []),
    ("Segunda, 8 de novembro", [], ["weekday_mismatch"]),
    ("Domingo, 8 de novembro", [("2026-11-08", None)], []),
    ("31 de fevereiro de 2026", [], ["invalid_calendar_date"]),
    ("20 de abril", [], ["year_not_evident"]),
    ("8 de novembro/2027", [], ["year_not_evident"]),
    ("O concerto foi realizado em 1 de novembro.", [], []),
    ("Foi ótimo. O próximo será em 1 de novembro.", [("2026-11-01", None)], []),
    ("O Dr. João foi visto, em 1 de novembro", [], []),
])
def test_scan(value, dates, issues):
    got = scan(value, AT)
    assert [(m["date"], m["end_date"]) for m in got["mentions"]] == dates and [i["reason"] for i in got["issues"]] == issues


def test_scan_marks_deadlines_and_labels():
    assert scan("inscrições até o dia 8 de novembro", AT)["mentions"][0]["until"]
    assert scan("21/10", AT, True)["mentions"][0]["date"] == "2026-10-21" and not scan("21/10", AT)["mentions"]


@pytest.mark.parametrize(("value", "want"), [
    ("toda sexta-feira", ("weekly", [5], None, [])),
    ("Todas as sextas-feiras, das 10h às 15h", ("weekly", [5], "10:00", [recurrence.END_LOST])),
    ("Terças das 14h às 16h15 e sextas das 9h às 11h", ("weekly", [2, 5], None, [recurrence.DAYS_DIFFER])),
    ("todo último domingo de cada mês", (None, None, None, [recurrence.ORDINAL_MONTH])),
    ("nesta sexta-feira (25/09), até as 17h", (None, None, None, [])),
    ("todos os documentos no sábado", (None, None, None, [])),
    ("", (None, None, None, [])),
])
def test_recurrence(spark, value, want):
    assert tuple(text_of(spark, recurrence.detect(F.col("t")), value)) == want


def test_recurrence_of_null(spark):
    assert text_of(spark, recurrence.detect(F.col("t")), None)["type"] is None
