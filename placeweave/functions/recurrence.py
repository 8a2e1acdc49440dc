"""Weekly recurrence in Portuguese text, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeweave.functions.dates_pt import WEEKDAYS, lookup, parse_time_range
from placeweave.functions.text import BLANKS, SPACE, let

# What counts as a weekday, a time, a rule and a dated mention.
FEIRA = "segunda|ter[çc]a|quarta|quinta|sexta"
STEM = f"domingo|{FEIRA}|s[áa]bado"
CLOCK = r"\d{1,2}h\d{0,2}"
FULL_DAY = rf"(?iu)(?:(domingo|s[áa]bado)s?|({FEIRA})s?-?feiras?)"
RANGE = rf"(?iu){CLOCK}{SPACE}+(?:às|as){SPACE}+{CLOCK}"
SINGLE = rf"(?iu)(?:a partir d[ae]s?|às|as){SPACE}+{CLOCK}"
ORDINAL = rf"(?iu)(primeir[oa]|segund[oa]|terceir[oa]|quart[oa]|últim[oa]|ultim[oa]|pen[uú]ltim[oa]){SPACE}+(domingo|(?:{FEIRA})(?:-feira)?|s[áa]bado)"
EVERY = rf"(?iu)(?<![A-Za-z0-9_])tod[ao]s?{SPACE}+(?:\S+{SPACE}+)?(?:(?:domingo|s[áa]bado)s?(?![A-Za-z0-9_])|(?:{FEIRA})s?-?feiras?)"
DATED = rf"(?iu)({STEM})(?:-?feiras?)?{SPACE}*\(\d{{1,2}}(?:/\d{{1,2}})?\)"
DATED_AFTER = rf"(?iu)\d{{1,2}}{SPACE}+de{SPACE}+[a-zà-ú]+{SPACE}*\((domingo|(?:segunda|ter[çc]a|quarta|quinta|sexta)-?feiras?|s[áa]bado)\)"
#: A weekday followed, in its clause, by a time.
_IN_LINE = "[" + BLANKS.replace(r"\n", "") + "]+"
LISTED = rf"(?iu)({STEM})(?=[^.!?\n]*?(?:{CLOCK}{_IN_LINE}(?:às|as){_IN_LINE}{CLOCK}|(?:a partir d[ae]s?|às|as){_IN_LINE}{CLOCK}))"

END_LOST, DAYS_DIFFER, ORDINAL_MONTH = "recurrence_end_time_not_persisted", "recurrence_per_day_times_not_representable", "recurrence_ordinal_month_not_representable"


def _numbers(names: Column) -> Column:
    stem = lambda n: F.regexp_replace(F.lower(n), r"-?feiras?$", "")
    return F.filter(F.transform(names, lambda n: lookup(WEEKDAYS, stem(n))), lambda d: d.isNotNull())


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def weekdays(text: Column) -> Column:
    """Sorted distinct numbers of the weekdays meant: full forms, and short ones with a time after them."""
    found = F.concat(_all(text, FULL_DAY, 1), _all(text, FULL_DAY, 2), _all(text, LISTED, 1))
    return F.array_sort(F.array_distinct(_numbers(F.filter(found, lambda n: n != ""))))


def time_mentions(text: Column) -> Column:
    """struct<ranges, singles>: times inside a range do not count again."""
    masked = F.regexp_replace(text, RANGE, " ")
    return F.struct(F.regexp_count(text, F.lit(RANGE)).alias("ranges"), F.regexp_count(masked, F.lit(SINGLE)).alias("singles"))


def has_signal(text: Column) -> Column:
    return text.rlike(EVERY) | text.rlike(RANGE) | text.rlike(SINGLE)


def _dated(text: Column) -> Column:
    """Weekdays that stand next to a date."""
    return _numbers(F.concat(_all(text, DATED, 1), _all(text, DATED_AFTER, 1)))


def only_dated(text: Column, days: Column) -> Column:
    """All weekdays stand next to a date, and no "toda" asks for more."""
    return (F.size(days) > 0) & (F.size(F.array_except(days, _dated(text))) == 0) & ~text.rlike(EVERY)


def _facts(text: Column) -> Column:
    """What the rules ask of a text, each found once."""
    return F.struct(
        weekdays(text).alias("days"), time_mentions(text).alias("times"), _dated(text).alias("dated"),
        F.coalesce(text.rlike(EVERY), F.lit(False)).alias("every"), F.coalesce(text.rlike(ORDINAL), F.lit(False)).alias("ordinal"),
    )


def _live(f: Column) -> Column:
    """Weekdays with a signal of recurrence that are not all dated."""
    signal = f["every"] | (f["times"]["ranges"] > 0) | (f["times"]["singles"] > 0)  # without a range nothing is masked
    return (F.size(f["days"]) > 0) & signal & ((F.size(F.array_except(f["days"], f["dated"])) > 0) | f["every"])


def qualifies(text: Column) -> Column:
    """Whether a text is evidence of a weekly recurrence."""
    return let(_facts(text), lambda f: _live(f) & ~f["ordinal"])


def detect(text: Column) -> Column:
    """struct<type, days, time, reasons> of a candidate text; null members where nothing recurs."""

    def read(f: Column) -> Column:
        live, times = _live(f), f["times"]
        weekly, total = live & ~f["ordinal"], times["ranges"] + times["singles"]
        none = F.array().cast("array<string>")
        reasons = F.when(live & f["ordinal"], F.array(F.lit(ORDINAL_MONTH))).when(weekly & (total > 1), F.array(F.lit(DAYS_DIFFER))).when(weekly & (times["ranges"] == 1), F.array(F.lit(END_LOST))).otherwise(none)
        return F.struct(
            F.when(weekly, F.lit("weekly")).alias("type"), F.when(weekly, f["days"]).alias("days"),
            F.when(weekly & (total == 1), parse_time_range(text, loose=False)["time"]).alias("time"), reasons.alias("reasons"),
        )

    return let(_facts(text), read)


def candidate_text(title: Column, description: Column, raw_text: Column, article: Column) -> Column:
    """Title, description and context joined by blanks, without empty ones. raw_text: only of narrative items."""
    return F.array_join(F.filter(F.array(title, description, raw_text, article), lambda t: t.isNotNull() & (t != "")), " ")


def text_hint(title: Column, description: Column, raw_text: Column, article: Column) -> Column:
    """The field that holds the recurrence: description, then context, else the title."""
    days = lambda t: F.size(weekdays(t)) > 0
    return F.when(days(description) | has_signal(description), description).when(days(raw_text), raw_text).when(days(article), article).otherwise(title)
