"""HTML, dates, times and recurrence in Portuguese text (family B).

The star schema has no such text: queries write it from known dates and read it back, so the oracle is the date.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeweave.functions import dates_pt as d
from placeweave.functions import recurrence as r
from placeweave.functions.text import strip_html
from placeweave.operators import posts, upserts
from placeweave.operators.date_spans import scan, scan_labels
from placeweave.plans.registry import query

NAMES = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]
DAYS = ["domingo", "segunda-feira", "terça-feira", "quarta-feira", "quinta-feira", "sexta-feira", "sábado"]


def _pick(names: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), at.cast("int") + 1)


def _orders(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return o.withColumns({"month_name": _pick(NAMES, F.month("day") - 1), "day_name": _pick(DAYS, F.dayofweek("day") - 1), "hour": F.col("o_orderkey") % 24})




_STRIP = "html"
for _p, _to in ((r"(?i)<br\s*/?>", "chr(10)"), (r"(?i)</p>", "chr(10)"), (r"<[^>]+>", "''")):
    _STRIP = f"regexp_replace({_STRIP}, '{_p}', {_to}, 'g')"
for _e, _c in (("&nbsp;", " "), ("&amp;", "&"), ("&#8211;", "–"), ("&#8216;", "‘"), ("&#8217;", "’"), ("&#8220;", "“"), ("&#8221;", "”")):
    _STRIP = f"replace({_STRIP}, '{_e}', '{_c}')"
_STRIP = f"regexp_replace(regexp_replace({_STRIP}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
_STRIP = f"regexp_replace(regexp_replace({_STRIP}, '^[\\s\\x{{a0}}]+', ''), '[\\s\\x{{a0}}]+$', '')"


@query("B01_strip_html", f"SELECT page_id, {_STRIP} AS text FROM pages")
def b01(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", strip_html(F.col("html")).alias("text"))


@query("B02_time", "SELECT o_orderkey, CASE WHEN h < 24 AND m < 60 THEN lpad(h::VARCHAR, 2, '0') || ':' || lpad(m::VARCHAR, 2, '0') END AS time FROM (SELECT o_orderkey, o_orderkey % 26 AS h, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 63 END AS m FROM orders)")
def b02(spark, sf_dir):
    k = F.col("o_orderkey")
    minute = F.when(k % 3 == 0, "").otherwise(F.lpad((k % 63).cast("string"), 2, "0"))
    text = F.concat(F.lit("começa às "), (k % 26).cast("string"), F.lit("h"), minute, F.lit(" em ponto"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", d.parse_time(text).alias("time"))


@query("B03_time_range", "SELECT o_orderkey, lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':00' AS time, CASE WHEN o_orderkey % 4 < 2 THEN '23:30' END AS end_time FROM orders")
def b03(spark, sf_dir):
    h = F.concat((F.col("o_orderkey") % 24).cast("string"), F.lit("h"))
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(F.lit("das "), h, F.lit(" às 23h30"))).when(k == 1, F.concat(h, F.lit(" as 23h30"))).when(k == 2, F.concat(F.lit("a partir das "), h)).otherwise(h)
    t = d.parse_time_range(text)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", t["time"].alias("time"), t["end_time"].alias("end_time"))


@query("B04_explicit_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders")
def b04(spark, sf_dir):
    text = F.concat(F.lit("No dia "), F.dayofmonth("day").cast("string"), F.lit(" de "), F.upper("month_name"), F.lit(" de "), F.year("day").cast("string"), F.lit(", às 9h"))
    return _orders(spark, sf_dir).select("o_orderkey", d.explicit_date(text).alias("date"))


@query("B05_parenthetical_day", "SELECT o_orderkey, day(o_orderdate)::INT AS n, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders")
def b05(spark, sf_dir):
    text = F.concat(F.lit("nesta "), F.col("day_name"), F.lit(" ("), F.dayofmonth("day").cast("string"), F.lit(")"))
    n = d.parenthetical_day(text)
    return _orders(spark, sf_dir).select("o_orderkey", n.alias("n"), d.day_in_month(n, F.year("day"), F.month("day")).alias("date"))


@query("B06_iso_date", "SELECT o_orderkey, strftime(try_strptime(y || '-' || m || '-' || d, '%Y-%m-%d'), '%Y-%m-%d') AS date FROM (SELECT o_orderkey, 1990 + o_orderkey % 20 AS y, o_orderkey % 14 AS m, o_orderkey % 33 AS d FROM orders)")
def b06(spark, sf_dir):
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", d.iso_date(1990 + k % 20, k % 14, k % 33).alias("date"))


@query("B07_weekday", "SELECT o_orderkey, dayofweek(o_orderdate)::INT AS weekday FROM orders")
def b07(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", d.weekday_of(F.col("day")).alias("weekday"))


def _near(options: str, most: int | None) -> str:
    limit = f" AND abs(epoch(c) - epoch(ref)) <= {most * 86400}" if most else ""
    return f"(SELECT strftime(arg_min(c, (abs(epoch(c) - epoch(ref)), -epoch(c))), '%Y-%m-%d') FROM (SELECT unnest([{options}]) AS c) WHERE c IS NOT NULL HAVING min(abs(epoch(c) - epoch(ref))) <= {(most or 100000) * 86400})"


_YEARS = ", ".join(f"try_strptime((year(ref) + {k}) || '-' || m || '-' || dd, '%Y-%m-%d')" for k in (-1, 0, 1))
_REF = "SELECT o_orderkey, o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24) AS ref, month(o_orderdate + INTERVAL 1 DAY * (o_orderkey % 300 - 150)) AS m, day(o_orderdate + INTERVAL 1 DAY * (o_orderkey % 300 - 150)) AS dd, dayofweek(o_orderdate + INTERVAL 1 DAY * (o_orderkey % 300 - 150)) AS wd FROM orders"


def _refs(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = (F.col("o_orderdate") + F.expr("INTERVAL '1' HOUR * cast(o_orderkey % 24 as int)")).cast("timestamp")
    other = F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 300 - 150).cast("int"))
    return o.select("o_orderkey", at.alias("ref"), F.month(other).alias("m"), F.dayofmonth(other).alias("dd"), (F.dayofweek(other) - 1).alias("wd"))


@query("B08_year_near", f"SELECT o_orderkey, {_near(_YEARS, 120)} AS date FROM ({_REF})")
def b08(spark, sf_dir):
    return _refs(spark, sf_dir).select("o_orderkey", d.year_near(F.col("dd"), F.col("m"), F.col("ref")).alias("date"))


@query("B24_year_near_unlimited", f"SELECT o_orderkey, {_near(_YEARS, None)} AS date FROM ({_REF})")
def b24(spark, sf_dir):
    return _refs(spark, sf_dir).select("o_orderkey", d.year_near(F.col("dd"), F.col("m"), F.col("ref"), None).alias("date"))


_MONTHS = ", ".join(f"(SELECT x FROM (SELECT try_strptime(strftime(date_trunc('month', ref) + INTERVAL ({k}) MONTH, '%Y-%m-') || dd, '%Y-%m-%d') AS x) WHERE dayofweek(x) = wd)" for k in (-1, 0, 1))


@query("B09_day_with_weekday", f"SELECT o_orderkey, {_near(_MONTHS, 45)} AS date FROM ({_REF})")
def b09(spark, sf_dir):
    return _refs(spark, sf_dir).select("o_orderkey", d.day_with_weekday(F.col("dd"), F.col("wd"), F.col("ref")).alias("date"))


_FORM = "o_orderkey % 8"


@query("B10_scan_dates", f"""SELECT o_orderkey, CASE WHEN {_FORM} <> 6 THEN strftime(o_orderdate, '%Y-%m-') || CASE {_FORM} WHEN 4 THEN '05' WHEN 5 THEN '03' WHEN 7 THEN '01' ELSE strftime(o_orderdate, '%d') END END AS date,
  CASE WHEN {_FORM} = 5 THEN strftime(o_orderdate, '%Y-%m-09') END AS end_date,
  CASE {_FORM} WHEN 1 THEN 'day_month' WHEN 2 THEN 'numeric' WHEN 3 THEN 'weekday_day' WHEN 4 THEN 'list_item' WHEN 5 THEN 'range' WHEN 6 THEN NULL ELSE 'full' END AS kind,
  CASE WHEN {_FORM} <> 6 THEN {_FORM} IN (1, 3) END AS inferred, CASE {_FORM} WHEN 4 THEN 3 WHEN 6 THEN 0 ELSE 1 END AS mentions, CASE WHEN {_FORM} = 6 THEN 'weekday_mismatch' END AS issue FROM orders""")
def b10(spark, sf_dir):
    """Dates written in eight forms and found again, one of them with a weekday that is not the date's."""
    o = _orders(spark, sf_dir)
    n, k, year = F.dayofmonth("day").cast("string"), F.col("o_orderkey") % 8, F.year("day").cast("string")
    full, month = F.concat(n, F.lit(" de "), "month_name", F.lit(" de "), year), F.concat(F.lit(" de "), "month_name", F.lit(" de "), year)
    text = (
        F.when(k == 0, F.concat(F.lit("O evento será no dia "), full, F.lit(", com entrada livre.")))
        .when(k == 1, F.concat(F.lit("Acontece em "), n, F.lit(" de "), "month_name", F.lit(" na praça.")))
        .when(k == 2, F.concat(F.lit("Data "), F.date_format("day", "dd/MM/yyyy"), F.lit(" no teatro")))
        .when(k == 3, F.concat(F.lit("Neste "), "day_name", F.lit(" ("), n, F.lit("), na orla")))
        .when(k == 4, F.concat(F.lit("Oficinas nos dias 5, 12 e 19"), month, F.lit(", às 9h.")))
        .when(k == 5, F.concat(F.lit("Festival de 3 a 9"), month, F.lit("; entrada livre")))
        .when(k == 6, F.concat(F.lit("Show "), _pick(DAYS, F.dayofweek("day") % 7), F.lit(", "), full))
        .otherwise(F.concat(F.lit("Abertura no dia 1º"), month))
    )
    found = o.select("o_orderkey", text.alias("text"), F.col("day").cast("timestamp").alias("at")).select("o_orderkey", scan(F.col("text"), F.col("at")).alias("s"))
    m = F.get("s.mentions", F.lit(0))
    issue = F.get("s.issues", F.lit(0))["reason"].alias("issue")
    return found.select("o_orderkey", m["date"].alias("date"), m["end_date"].alias("end_date"), m["kind"].alias("kind"), m["inferred"].alias("inferred"), F.size("s.mentions").alias("mentions"), issue)


@query("B13_distinct_dates", "SELECT l_orderkey, count(DISTINCT strftime(l_shipdate, '%Y-%m')) AS n FROM lineitem GROUP BY 1")
def b13(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lists = li.groupBy("l_orderkey").agg(F.collect_list(F.date_format("l_shipdate", "yyyy-MM")).alias("dates"))  # an order's few lines
    return lists.select("l_orderkey", F.size(F.array_distinct("dates")).cast("long").alias("n"))


@query("B14_labelled_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 2 = 0 THEN 'às 18h' END AS rest FROM orders")
def b14(spark, sf_dir):
    value = F.concat(F.date_format("day", "d/M"), F.when(F.col("o_orderkey") % 2 == 0, " – às 18h").otherwise(""))
    o = _orders(spark, sf_dir).withColumns({"values": F.array(value), "at": F.col("day").cast("timestamp")})
    s = posts.schedule(F.col("values"), scan_labels(F.col("values"), F.col("at")))
    return o.select("o_orderkey", s.alias("s")).select("o_orderkey", "s.date", "s.rest")


def _posts(spark, sf_dir):
    """A post per order: two labelled blocks, one, or prose, by key."""
    o = _orders(spark, sf_dir)
    n, k = F.dayofmonth("day").cast("string"), F.col("o_orderkey") % 4
    key, hour = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 22 + 1
    short = F.concat(n, F.lit(" de "), "month_name")
    full = F.concat(short, F.lit(" de "), F.year("day").cast("string"))
    block = lambda title: F.concat(F.lit(f"<p><strong>{title} "), key, F.lit("</strong><br />Dia: "), full, F.lit("<br>Horário: "), hour.cast("string"), F.lit("h às "), (hour + 1).cast("string"), F.lit("h<br/>Local: Canto "), key, F.lit("</p>"))
    html = (
        F.when(k == 0, F.concat(F.lit("<p>Texto</p>SERVIÇO"), block("Yoga na Casa"), block("Dança"))).when(k == 1, F.concat(F.lit("SERVIÇO"), block("Feira")))
        .when(k == 2, F.concat(F.lit("<p>O encontro será no dia "), full, F.lit(", às "), hour.cast("string"), F.lit("h, na Praia "), key, F.lit(".</p>")))
        .when(F.col("o_orderkey") % 8 == 3, F.concat(F.lit("<p>O encontro foi dia "), short, F.lit(".</p>"))).otherwise(F.lit("<p>Nada a dizer.</p>"))
    )
    return o.select(F.col("o_orderkey").alias("post_id"), F.lit("prefeitura").alias("source_key"), F.concat(F.lit("Post "), F.col("o_orderkey").cast("string")).alias("title"), html.alias("html"), F.lit("SERVIÇO").alias("marker"), F.col("day").cast("timestamp").alias("at"), F.lit(True).alias("exact"))


@query("B18_structured_blocks", """SELECT o_orderkey AS post_id, i::INT AS idx, CASE WHEN o_orderkey % 4 = 1 THEN 'Feira ' WHEN i = 0 THEN 'Yoga na Casa ' ELSE 'Dança ' END || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS date,
  lpad((o_orderkey % 22 + 1)::VARCHAR, 2, '0') || ':00' AS time, lpad((o_orderkey % 22 + 2)::VARCHAR, 2, '0') || ':00' AS end_time, 'Canto ' || o_orderkey AS venue_name
  FROM orders, generate_series(0, 1) AS g(i) WHERE o_orderkey % 4 = 0 OR (o_orderkey % 4 = 1 AND i = 0)""")
def b18(spark, sf_dir):
    return posts.structured_items(_posts(spark, sf_dir)).select("post_id", "idx", "title", "date", "time", "end_time", "venue_name")


@query("B20_narrative", """SELECT o_orderkey AS post_id, CASE o_orderkey % 4 WHEN 2 THEN 'extracted' WHEN 3 THEN 'not_found' ELSE 'ambiguous' END AS status, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, CASE WHEN o_orderkey % 4 = 2 THEN lpad((o_orderkey % 22 + 1)::VARCHAR, 2, '0') || ':00' END AS time,
  CASE o_orderkey % 4 WHEN 2 THEN 'Praia ' || o_orderkey WHEN 0 THEN 'Casa ' || o_orderkey END AS venue_name, CASE WHEN o_orderkey % 4 = 2 THEN 0.55::DOUBLE END AS confidence FROM orders""")
def b20(spark, sf_dir):
    return posts.narrative_items(_posts(spark, sf_dir)).select("post_id", "status", "date", "time", "venue_name", "confidence")


@query("B23_post_items", """SELECT o_orderkey || '_' || i AS source_item_id, CASE WHEN o_orderkey % 4 = 2 THEN 'narrative_fallback' ELSE 'structured_block' END AS method, 1 AS n_occurrences FROM orders, generate_series(0, 1) AS g(i)
  WHERE o_orderkey % 4 = 0 OR (o_orderkey % 4 < 3 AND i = 0)""")
def b23(spark, sf_dir):
    return posts.post_items(_posts(spark, sf_dir))[0].select("source_item_id", "method", F.size("occurrences").alias("n_occurrences"))


@query("B23_skipped", "SELECT o_orderkey AS post_id, 'no_extractable_schedule_found' AS reason FROM orders WHERE o_orderkey % 4 = 3")
def b23b(spark, sf_dir):
    return posts.post_items(_posts(spark, sf_dir))[1].select("post_id", "reason")


@query("G20_collector_statistics", """SELECT count(*) AS posts, count(*) FILTER (o_orderkey % 4 < 2) AS structured, count(*) FILTER (o_orderkey % 4 = 2) AS narrative, count(*) FILTER (o_orderkey % 4 = 3) AS without_schedule FROM orders""")
def g20(spark, sf_dir):
    read = posts.post_results(_posts(spark, sf_dir))
    each = read.select("post_id", F.when(F.col("source_item_id").isNotNull(), F.col("method")).otherwise(F.col("skipped")).alias("method")).distinct()
    n = lambda m: F.count_if(F.col("method") == m)
    return each.agg(F.count("*").alias("posts"), n("structured_block").alias("structured"), n("narrative_fallback").alias("narrative"), n("no_extractable_schedule_found").alias("without_schedule"))


@query("B21_venue_in_prose", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Casa ' || c_custkey END AS venue FROM customer")
def b21(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.when(k % 2 == 0, F.concat(F.lit("O show acontece na Casa "), k.cast("string"), F.lit(", com entrada livre"))).otherwise(F.lit("acontece na casa de cultura"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", posts.venue_in_prose(text).alias("venue"))


@query("B25_gmt_instant", "SELECT event_id, date_trunc('second', ts) AS at FROM events")
def b25(spark, sf_dir):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise(""))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", d.gmt_instant(text).cast("timestamp_ntz").alias("at"))


@query("B26_publication_reference", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate ELSE TIMESTAMP '1990-05-01' END AS at FROM orders")
def b26(spark, sf_dir):
    odd = F.col("o_orderkey") % 2 == 1
    at = d.publication_reference(F.col("o_orderdate").cast("timestamp"), F.when(odd, 1990).otherwise(F.year("o_orderdate")), F.when(odd, 5).otherwise(F.month("o_orderdate")))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", at.cast("timestamp_ntz").alias("at"))


@query("B27_occurrence_rejects", "SELECT event_id FROM events WHERE event_id % 3 = 2")
def b27(spark, sf_dir):
    k = F.col("event_id") % 3
    payload = F.when(k == 0, '[{"date":"2026-01-02"}]').when(k == 1, "[]").otherwise('{"date":"2026-01-02"}')
    return spark.read.parquet(f"{sf_dir}/events.parquet").where(~upserts.parse_occurrences(payload)["valid"]).select("event_id")


# Ten sentences about a weekday, another one three days later, an hour and a day of the month, all named by the order's key.
_FEIRAS = ["segunda", "terça", "quarta", "quinta", "sexta"]
STEMS = ["domingo", *_FEIRAS, "sábado"]
PLURALS = ["domingos", *[f"{f}s-feiras" for f in _FEIRAS], "sábados"]
_D, _E, _H = "(o_orderkey % 7)", "((o_orderkey % 7 + 3) % 7)", "(o_orderkey % 12 + 1)"
_BOTH = f"(least({_D}, {_E}) || ',' || greatest({_D}, {_E}))"
_ON_HOUR, _HALF = f"lpad({_H}::VARCHAR, 2, '0') || ':00'", f"lpad({_H}::VARCHAR, 2, '0') || ':30'"


def _sentences(spark, sf_dir):
    k = F.col("o_orderkey")
    d, e, h = k % 7, (k % 7 + 3) % 7, k % 12 + 1
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    hour = lambda more: (h + more).cast("string")
    day, stem, plural, nth = _pick(DAYS, d), lambda x: _pick(STEMS, x), lambda x: _pick(PLURALS, x), (k % 28 + 1).cast("string")
    told = [
        say("toda ", day), say("Todas as ", plural(d), ", das ", hour(0), "h às ", hour(2), "h"), say(stem(d), "s e ", stem(e), "s das ", hour(0), "h às ", hour(2), "h"),
        say(stem(d), "s das ", hour(0), "h às ", hour(2), "h15 e ", stem(e), "s das ", hour(1), "h às ", hour(3), "h"), say("toda ", day, ", às ", hour(0), "h"),
        say("todo último ", day, " de cada mês"), say("nesta ", day, " (", nth, "/09). Envie até as ", hour(0), "h"),
        say("a segunda apresentação será no ", _pick(["domingo", "sábado"], F.floor(k / 10) % 2)), say(F.upper(plural(d)), " e ", F.upper(plural(e)), " a partir das ", hour(0), "h30"),
        say(nth, " de outubro (", day, "), às ", hour(0), "h"),
    ]
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.element_at(F.array(*told), (k % 10 + 1).cast("int")).alias("text"))


def _by_sentence(values: dict[str, str], other: str = "NULL") -> str:
    """CASE over the number of the sentence; several numbers may share a value."""
    return "CASE " + " ".join(f"WHEN o_orderkey % 10 IN ({numbers}) THEN {value}" for numbers, value in values.items()) + f" ELSE {other} END"


@query("B28_time_mentions", f"SELECT o_orderkey, {_by_sentence({'1, 2': '1', '3': '2'}, '0')} AS ranges, {_by_sentence({'4, 6, 8, 9': '1'}, '0')} AS singles FROM orders")
def b28(spark, sf_dir):
    return _sentences(spark, sf_dir).select("o_orderkey", r.time_mentions(F.col("text")).alias("t")).select("o_orderkey", "t.ranges", "t.singles")


@query("B29_weekdays", f"SELECT o_orderkey, {_by_sentence({'2, 3, 8': _BOTH, '7': 'CASE WHEN (o_orderkey // 10) % 2 = 0 THEN 0 ELSE 6 END::VARCHAR'}, _D + '::VARCHAR')} AS days FROM orders")
def b29(spark, sf_dir):
    return _sentences(spark, sf_dir).select("o_orderkey", F.array_join(r.weekdays(F.col("text")).cast("array<string>"), ",").alias("days"))


@query("B35_qualifies", "SELECT o_orderkey, o_orderkey % 10 NOT IN (5, 6, 7, 9) AS qualifies FROM orders")
def b35(spark, sf_dir):
    return _sentences(spark, sf_dir).select("o_orderkey", r.qualifies(F.col("text")).alias("qualifies"))


@query("B33_recurrence", f"""SELECT o_orderkey, {_by_sentence({'0, 1, 2, 3, 4, 8': "'weekly'"})} AS type, {_by_sentence({'2, 3, 8': _BOTH, '0, 1, 4': _D + '::VARCHAR'})} AS days,
  {_by_sentence({'1, 2, 4': _ON_HOUR, '8': _HALF})} AS time, {_by_sentence({'1, 2': f"'{r.END_LOST}'", '3': f"'{r.DAYS_DIFFER}'", '5': f"'{r.ORDINAL_MONTH}'"}, "''")} AS reasons FROM orders""")
def b33(spark, sf_dir):
    found = _sentences(spark, sf_dir).select("o_orderkey", r.detect(F.col("text")).alias("r")).select("o_orderkey", "r.*")
    days = F.coalesce(F.array_join(F.col("days").cast("array<string>"), ","), F.lit(None).cast("string"))
    return found.select("o_orderkey", "type", days.alias("days"), "time", F.array_join("reasons", ",").alias("reasons"))


def _named(names: list[str], number: str) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


@query("B34_text_hint", f"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'toda ' || {_named(DAYS, _D)} WHEN 1 THEN 'às ' || {_named(PLURALS, _D)} ELSE 'título ' || o_orderkey END AS hint FROM orders")
def b34(spark, sf_dir):
    key, none = F.col("o_orderkey"), F.lit(None).cast("string")
    k, day, plural = key % 3, _pick(DAYS, key % 7), _pick(PLURALS, key % 7)
    description, raw = F.when(k == 0, F.concat(F.lit("toda "), day)).otherwise("nada"), F.when(k == 1, F.concat(F.lit("às "), plural))
    hint = r.text_hint(F.concat(F.lit("título "), key.cast("string")), description, raw, none)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", hint.alias("hint"))
