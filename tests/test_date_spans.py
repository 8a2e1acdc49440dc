"""Dates read by column expressions against the plain reading of one text at a time."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from placeweave.operators import date_scan, date_spans
from placeweave.plans import catalog

MONTHS = ["janeiro", "fevereiro", "março", "marco", "abril", "Maio", "JUNHO", "julho", "setembro", "outubro", "dezembro"]
DAYS = ["domingo", "segunda", "terça", "terca-feira", "Quarta-feira", "sexta-feira", "SÁBADO", "sabado"]


def texts(n, seed):
    rnd = random.Random(seed)
    num = lambda: str(rnd.choice([0, 1, 3, 8, 9, 12, 21, 28, 29, 30, 31, 32])) + rnd.choice(["", "", "º", "°", "o"])
    year = lambda: rnd.choice(["", " de 2026", ", 2026", " 2027", "/2026", " de 26", " de 20261"])
    month, day = lambda: rnd.choice(MONTHS), lambda: rnd.choice(DAYS)
    pieces = [
        lambda: f"de {num()} a {num()} de {month()}{year()}", lambda: f"{num()} até o dia {num()} de {month()}", lambda: f"dias {num()}, {num()} e {num()} de {month()}{year()}",
        lambda: f"{num()} de {month()}{year()}", lambda: f"{rnd.randrange(33)}/{rnd.randrange(14)}", lambda: f"{rnd.randrange(33)}/{rnd.randrange(14)}/2026",
        lambda: f"{day()} ({num()})", lambda: f"{day()}, dia {num()}", lambda: f"{day()}, {num()} de {month()}", lambda: f"{num()} de {month()} ({day()})", lambda: f"{day()} dia {num()}",
        lambda: rnd.choice(["foi", "Aconteceu", "realizou-se", "teve"]), lambda: rnd.choice(["até", "até o dia", "até às 18h do"]), lambda: rnd.choice([". ", "! ", "; ", "\n", ".", "... "]),
        lambda: rnd.choice(["Dr. ", "av. ", "n. ", "10.30 ", "ltda. ", "ab. ", "casa. "]), lambda: "o evento", lambda: " ", num,
    ]
    return [rnd.choice([" ", "", " "]).join(rnd.choice(pieces)() for _ in range(rnd.randrange(1, 9))) for _ in range(n)]


def test_columns_read_what_the_plain_reader_reads(spark):
    rnd, at = random.Random(2), datetime(2026, 10, 29, 12)
    rows = [(i, t, at + timedelta(days=rnd.randrange(-200, 200), hours=rnd.randrange(24))) for i, t in enumerate([*texts(500, 7), "", None, "x " * 3000 + "3 de maio de 2026"])]
    df = spark.createDataFrame(rows, "i int, t string, at timestamp")
    got = {r["i"]: r for r in df.select("i", date_spans.scan(F.col("t"), F.col("at")).alias("a"), date_spans.scan_labels(F.array("t"), F.col("at")).alias("b")).collect()}
    plain = lambda s: None if s is None else {"mentions": [m.asDict() for m in s["mentions"]], "issues": [x.asDict() for x in s["issues"]]}
    found = 0
    for i, t, when in rows:
        for bare, value in ((False, got[i]["a"]), (True, got[i]["b"][0])):
            want = None if t is None else date_scan.scan(t, when.replace(tzinfo=timezone.utc), bare)
            found += len(want["mentions"]) + len(want["issues"]) if want else 0
            assert plain(value) == want, (t, when)
    assert found > 1000


def test_no_plan_of_dates_has_python(spark):
    for name in ("B10_scan_dates", "B12_until", "B14_labelled_date", "B20_narrative", "B18_structured_blocks"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan, name
