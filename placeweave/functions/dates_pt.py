"""Portuguese dates and times, and calendar arithmetic that never throws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeweave.functions.text import SPACE, let

# Names of months and weekdays.
MONTHS = {"janeiro": 1, "fevereiro": 2, "março": 3, "marco": 3, "abril": 4, "maio": 5, "junho": 6, "julho": 7, "agosto": 8, "setembro": 9, "outubro": 10, "novembro": 11, "dezembro": 12}
WEEKDAYS = {"domingo": 0, "segunda": 1, "terça": 2, "terca": 2, "quarta": 3, "quinta": 4, "sexta": 5, "sábado": 6, "sabado": 6}
MOST_WEEKDAY_DAYS, MOST_YEAR_DAYS = 45, 120


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without a match, and for a group that took no part."""
    return F.when(text.rlike(pattern), F.nullif(F.regexp_extract(text, pattern, group), F.lit("")))


def lookup(values: dict[str, int], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def parse_time(text: Column) -> Column:
    """HH:MM of the first time like 7h or 19h30; null if it is no time of day."""
    pattern = r"(?iu)(\d{1,2})h(\d{2})?"

    def read(found: Column) -> Column:
        hour, minute = F.regexp_extract(found, pattern, 1), F.coalesce(F.nullif(F.regexp_extract(found, pattern, 2), F.lit("")), F.lit("00"))
        fits = (hour.cast("int") <= 23) & (minute.cast("int") <= 59)
        return F.when(fits, F.concat_ws(":", F.lpad(hour, 2, "0"), minute))

    return let(F.regexp_substr(text, F.lit(pattern)), lambda found: F.when(found.isNotNull(), read(found)))


def parse_time_range(text: Column, loose: bool = True) -> Column:
    """struct<time, end_time>: "7h às 8h", else "às 17h" or "a partir das 16h", else a bare time.

    loose allows no blank after "às"; the recurrence rules do not.
    """
    ranged = rf"(?iu)(\d{{1,2}}h\d{{0,2}}){SPACE}+(?:às|as){SPACE}+(\d{{1,2}}h\d{{0,2}})"
    blank = f"{SPACE}*" if loose else f"{SPACE}+"
    single = rf"(?iu)(?:a partir d[ae]s?{SPACE}+|às{blank}|as{SPACE}+)(\d{{1,2}}h\d{{0,2}})"
    bare = r"(?iu)\A(\d{1,2}h\d{0,2})\z"

    def read(t: Column) -> Column:
        spans = F.filter(F.array(*[F.regexp_substr(t, F.lit(p)) for p in (ranged, single, bare)]), lambda x: x.isNotNull())
        is_range = t.rlike(ranged)
        start = let(F.get(spans, F.lit(0)), parse_time)
        end = parse_time(F.regexp_extract(t, ranged, 2))
        return F.struct(start.alias("time"), F.when(is_range, end).alias("end_time"))

    return let(text, read)


def explicit_date(text: Column) -> Column:
    """YYYY-MM-DD of the first "D de mês de YYYY"; the day is not checked against the month."""
    pattern = rf"(?iu)(\d{{1,2}}){SPACE}+de{SPACE}+([a-zçãâéê]+){SPACE}+de{SPACE}+(\d{{4}})"
    month = lookup(MONTHS, F.lower(first_group(text, pattern, 2)))
    return F.concat(first_group(text, pattern, 3), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(first_group(text, pattern), 2, "0"))


def parenthetical_day(text: Column) -> Column:
    """The number in "sexta-feira (19)"."""
    names = "|".join(WEEKDAYS)
    return first_group(text, rf"(?iu)(?:{names})[a-z-]*{SPACE}*\((\d{{1,2}})\)").cast("int")


def day_in_month(day: Column, year: Column, month: Column) -> Column:
    """YYYY-MM-DD as given, unchecked."""
    return F.format_string("%d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))


def real_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where the calendar has no such day. Plain arithmetic: nothing is formatted or parsed."""
    year, month, day = year.cast("int"), month.cast("int"), day.cast("int")
    first = F.when(year.between(1, 9999) & month.between(1, 12) & (day >= 1), F.make_date(year, month, F.lit(1)))
    return let(first, lambda d: F.when(day <= F.dayofmonth(F.last_day(d)), F.date_add(d, day - 1)))


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD, or null where the calendar has no such day."""
    return real_date(year, month, day).cast("string")


def weekday_of(date: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(date.cast("date")) - 1


def _nearest(options: Column, at: Column, most_days: int | None) -> Column:
    """Of an array of dates the one nearest to the instant at, the later of two as near; null if it is too far."""
    away = lambda d: F.abs(F.unix_timestamp(d.cast("timestamp")) - F.unix_timestamp(at))
    rated = F.transform(options, lambda d: F.when(d.isNotNull(), F.struct(away(d).alias("away"), (-F.unix_date(d)).alias("later"), d.alias("date"))))
    near = lambda best: best["date"] if most_days is None else F.when(best["away"] <= most_days * 86400, best["date"])
    return let(F.array_min(rated), near)


def _around() -> Column:
    return F.array(F.lit(-1), F.lit(0), F.lit(1))


def date_near(day: Column, month: Column, at: Column, most_days: int | None = MOST_YEAR_DAYS) -> Column:
    """The date with this day and month nearest to at, of the years before, of and after it."""
    return _nearest(F.transform(_around(), lambda k: real_date(F.year(at) + k, month, day)), at, most_days)


def weekday_date(day: Column, weekday: Column, at: Column) -> Column:
    """The date with this day of month and weekday nearest to at, of the months before, of and after it."""
    of_month = lambda f: real_date(F.year(f), F.month(f), day)
    options = F.transform(F.transform(_around(), lambda k: F.add_months(F.trunc(at, "month"), k)), of_month)
    return _nearest(F.transform(options, lambda d: F.when(F.dayofweek(d) - 1 == weekday, d)), at, MOST_WEEKDAY_DAYS)


def year_near(day: Column, month: Column, at: Column, most_days: int | None = MOST_YEAR_DAYS) -> Column:
    """date_near as YYYY-MM-DD."""
    return date_near(day, month, at, most_days).cast("string")


def day_with_weekday(day: Column, weekday: Column, at: Column) -> Column:
    """weekday_date as YYYY-MM-DD."""
    return weekday_date(day, weekday, at).cast("string")


def gmt_instant(text: Column) -> Column:
    """Instant of a publication time; without a zone it is UTC."""
    zoned = text.rlike(r"(?i)(Z|[+-]\d{2}:?\d{2})$")
    bare = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?$")
    return F.try_to_timestamp(F.when(zoned, text).when(bare, F.concat(text, F.lit("Z"))).otherwise(text))


def publication_reference(instant: Column, year: Column, month: Column) -> Column:
    """The instant, if its year and month are the declared ones; else the first of that month."""
    declared = F.make_timestamp(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))
    return F.when((F.year(instant) == year) & (F.month(instant) == month), instant).otherwise(declared)


