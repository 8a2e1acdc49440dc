"""Dates mentioned in Portuguese prose, as column expressions.

The same reading as ``date_scan.scan``, for whole columns and without Python. Column expressions have no positions of
matches, so these come from lengths: splitting a text at a form gives the pieces between its matches, and running sums of
the lengths of pieces and matches say where every match stands. Forms are tried from the most to the least specific; a
match that touches a span taken by an earlier form is passed over. Context (a deadline or a weekday before, a loose
year behind, a past verb in the same sentence) is read from substrings and from the positions of sentence ends.

Dates are those of the session's time zone, which should be UTC.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeweave.functions.dates_pt import MONTHS, WEEKDAYS, date_near, lookup, real_date, weekday_date
from placeweave.functions.text import BLANKS, SPACE, let
from placeweave.operators import date_scan

MENTION, ISSUE, SCAN = date_scan.MENTION, date_scan.ISSUE, date_scan.SCAN
_NOT_SPACE = f"[^{BLANKS}]"


def _java(pattern: str) -> str:
    """A pattern of date_scan for Java: numbered groups, and white space of all kinds."""
    return "(?iu)" + re.sub(r"\(\?P<\w+>", "(", pattern).replace(r"\s", SPACE)


FORMS = {kind: _java(form.pattern) for kind, form in date_scan.FORMS}
_LOOSE_YEAR = r"\A" + _java(date_scan._LOOSE_YEAR.pattern)
_DONE = _java(date_scan._DONE.pattern)
_DEADLINE = _java(date_scan._DEADLINE.pattern)
_WEEKDAY_BEFORE, _WEEKDAY_AFTER = _java(date_scan._WEEKDAY_BEFORE.pattern), r"\A" + _java(date_scan._WEEKDAY_AFTER.pattern)
#: A full stop ends no sentence inside a number or name, before a small letter, or after a short or abbreviated word.
_STOP = rf"[!?;\n]|\.(?!{_NOT_SPACE})(?!{SPACE}+[\p{{Ll}}0-9])(?<!(?<![\p{{L}}º])(?:[\p{{L}}º]{{1,2}}|(?iu:{'|'.join(date_scan._SHORT)}))\.)"
_SPAN = "struct<m:string,s:int,e:int>"
_MARK = "\x00"

#: Parts of the words that patterns ask for, one of them in every match: looked for in the lower-cased text before a pattern
#: runs. They have no i, k or s, which patterns without case also find in letters that do not become these in lower case.
_PARTS = {
    "months": ["ane", "evere", "ma", "abr", "unho", "ulho", "ago", "utubro", "embro"],
    "weekdays": ["dom", "egunda", "ter", "quarta", "nta", "exta", "bado"],
    "done": ["fo", "ram", "eceu", "orreu", "zou", "teve", "rrou", "ebeu", "pou", "brou", "reun", "tou"],
    "until": ["até"],
    "slash": ["/"],
}


def _held(low: Column) -> Column:
    """struct: which of these words a lower-cased text may hold."""
    return F.struct(*[reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts]).alias(name) for name, parts in _PARTS.items()])


def _no(kind: str) -> Column:
    """An empty array of this type."""
    return F.array().cast(f"array<{kind}>")


def spans(text: Column, pattern: str) -> Column:
    """Every match of pattern in text with its place: array of struct<m, s, e>, positions from 0."""

    def placed(found: Column) -> Column:
        # Matches become a mark that the text cannot hold; text is split there, which compiles no pattern for each row.
        pieces = F.split(F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit("\x01")), pattern, _MARK), _MARK, -1)
        sizes = F.zip_with(found, pieces, lambda m, p: F.struct(m.alias("m"), F.length(p).alias("gap"), F.length(m).alias("size")))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + x["gap"]
            span = F.struct(x["m"].alias("m"), s.alias("s"), (s + x["size"]).alias("e"))
            return F.struct((s + x["size"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        begin = F.struct(F.lit(0).alias("at"), _no(_SPAN).alias("out"))
        known = F.filter(sizes, lambda x: x["m"].isNotNull())  # the last piece has no match behind it
        return F.when(F.size(found) == 0, _no(_SPAN)).otherwise(F.aggregate(known, begin, step, lambda acc: acc["out"]))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _free(found: Column, taken: Column) -> Column:
    return F.filter(found, lambda x: ~F.exists(taken, lambda y: (x["s"] < y["e"]) & (x["e"] > y["s"])))


def _before(text: Column, at: Column, size: int) -> Column:
    first = F.greatest(at - size, F.lit(0))
    return F.substring(text, first + 1, at - first)


def _after(text: Column, at: Column, size: int) -> Column:
    return F.substring(text, at + 1, F.lit(size))


#: What is known of a match from its own words: kind, text and place, days, last day of a range, month, year, weekday.
_FACTS = "struct<kind:string,m:string,s:int,e:int,days:array<int>,to:int,month:int,year:int,weekday:int>"


def _facts(kind: str, x: Column) -> Column:
    """The facts of a match of this form."""
    # All groups in one go, parted by a mark that is in none of them.
    n = re.compile(dict(date_scan.FORMS)[kind].pattern.replace(r"\p{L}", "a")).groups
    parts = F.split(F.regexp_replace(x["m"], FORMS[kind] + "(?s:.*)", _MARK.join(f"${k}" for k in range(1, n + 1))), _MARK, -1)
    return let(parts, lambda groups: _facts_of(kind, x, lambda k: F.nullif(F.get(groups, F.lit(k - 1)), F.lit(""))))


def _facts_of(kind: str, x: Column, group: Callable[[int], Column]) -> Column:
    none, named = F.lit(None).cast("int"), lambda k: lookup(MONTHS, F.lower(group(k)))
    one = lambda c: F.array(c.cast("int"))
    if kind == "range":
        rest = [one(group(1)), group(2), named(3), group(4), none]
    elif kind == "list_item":
        days = F.transform(F.regexp_extract_all(group(1), F.lit("[0-9]+"), F.lit(0)), lambda d: d.cast("int"))
        rest = [F.filter(days, lambda d: d != 0), none, named(2), group(3), none]
    elif kind == "day_month":
        rest = [one(group(1)), none, named(2), group(3), none]
    elif kind == "numeric":
        rest = [one(group(1)), none, group(2), group(3), none]
    else:
        rest = [one(F.coalesce(group(2), group(3), group(4))), none, none, none, lookup(WEEKDAYS, F.lower(group(1)))]
    return F.struct(F.lit(kind), x["m"], x["s"], x["e"], *rest).cast(_FACTS)


def _read(text: Column, at: Column, held: Column, places: Column, x: Column) -> Column:
    """struct<s, mentions, issues> of one match: a mention or an issue for each of its days, or nothing."""
    inferred = x["year"].isNull()
    # A date without a year is left alone before a loose year (an issue) and in a sentence about the past.
    loose = _after(text, x["e"], 12).rlike(_LOOSE_YEAR)
    first = F.coalesce(F.array_max(F.filter(places["stops"], lambda i: i < x["s"])), F.lit(-1))
    last = F.coalesce(F.array_min(F.filter(places["stops"], lambda i: i >= x["e"])), F.length(text))
    past = F.exists(places["done"], lambda d: (d > first) & (d < last))
    days = F.when(inferred & (loose | past), F.array().cast("array<int>")).otherwise(x["days"])

    def dated(d: Column) -> Column:
        date = F.when(x["kind"] == "weekday_day", weekday_date(d, x["weekday"], at)).when(inferred, date_near(d, x["month"], at)).otherwise(real_date(x["year"], x["month"], d))
        return F.struct(d.alias("day"), date.alias("date"))

    beside = lambda part, pattern: let(F.regexp_extract(part, pattern, 1), lambda w: F.nullif(w, F.lit("")))
    named = F.when(held["weekdays"], F.coalesce(beside(_before(text, x["s"], 30), _WEEKDAY_BEFORE), beside(_after(text, x["e"], 30), _WEEKDAY_AFTER)))

    def checked(d: Column) -> Column:
        until = F.when(x["kind"] == "range", real_date(F.year(d["date"]), x["month"], x["to"]))
        unknown = F.when(x["kind"] == "weekday_day", "weekday_mismatch").when(inferred & real_date(F.lit(2028), x["month"], d["day"]).isNotNull(), "year_not_evident").otherwise("invalid_calendar_date")
        backwards = (x["kind"] == "range") & F.coalesce(until <= d["date"], F.lit(True))
        other_day = x["kind"].isin("range", "day_month", "numeric") & (lookup(WEEKDAYS, F.lower(named)) != F.dayofweek(d["date"]) - 1)
        reason = F.when(d["date"].isNull(), unknown).when(backwards, "invalid_calendar_date").when(other_day, "weekday_mismatch")
        return F.struct(d["date"].alias("date"), until.alias("until"), reason.alias("reason"))

    def told(all_days: Column) -> Column:
        kind = F.when((x["kind"] == "day_month") & ~inferred, "full").otherwise(x["kind"])
        deadline = held["until"] & _before(text, x["s"], 40).rlike(_DEADLINE)
        mention = lambda d: F.struct(d["date"].cast("string"), d["until"].cast("string"), x["m"], x["s"], x["e"], kind, deadline, inferred)
        known = F.transform(F.filter(all_days, lambda d: d["reason"].isNull()), mention)
        lost = F.transform(F.filter(all_days, lambda d: d["reason"].isNotNull()), lambda d: F.struct(x["m"], d["reason"]))
        undated = F.when(inferred & loose, F.array(F.struct(x["m"], F.lit("year_not_evident")).cast(ISSUE))).otherwise(lost.cast(f"array<{ISSUE}>"))
        return F.struct(x["s"].alias("s"), known.cast(f"array<{MENTION}>").alias("mentions"), undated.alias("issues"))

    return let(F.transform(F.transform(days, dated), checked), told)


def _scan(text: Column, at: Column, held: Column, bare_numeric: bool) -> Column:
    def taken(t: Column, kinds: list[str], facts: Column) -> Column:
        """Forms one after the other, each passing over what those before it have taken."""
        if not kinds:
            return read_all(t, facts)
        kind = kinds[0]
        every = _free(spans(t, FORMS[kind]), facts)
        if kind == "numeric" and not bare_numeric:
            every = F.filter(every, lambda x: x["m"].rlike(r"/[0-9]{4}\z"))
        words = {"numeric": "slash", "weekday_day": "weekdays"}.get(kind, "months")
        more = F.when(held[words], F.concat(facts, F.transform(every, lambda x: _facts(kind, x)))).otherwise(facts)
        return let(more, lambda known: taken(t, kinds[1:], known))

    def read_all(t: Column, facts: Column) -> Column:
        starts = lambda pattern: F.transform(spans(t, pattern), lambda x: x["s"])
        # Sentences matter only around past verbs.
        verbs = F.when(held["done"], starts(_DONE)).otherwise(_no("int"))
        places = let(verbs, lambda v: F.struct(F.when(F.size(v) == 0, _no("int")).otherwise(starts(_STOP)).alias("stops"), v.alias("done")))
        # Context matters only to matches.
        return F.when(F.size(facts) == 0, F.struct(_no(MENTION).alias("mentions"), _no(ISSUE).alias("issues"))).otherwise(
            let(let(places, lambda p: F.transform(facts, lambda x: _read(t, at, held, p, x))), gathered)
        )

    def gathered(reads: Column) -> Column:
        mentions = F.flatten(F.transform(F.array_sort(reads, lambda a, b: a["s"] - b["s"]), lambda r: r["mentions"]))
        return F.struct(mentions.alias("mentions"), F.flatten(F.transform(reads, lambda r: r["issues"])).alias("issues"))

    return taken(text, list(FORMS), _no(_FACTS))


def scan(text: Column, at: Column, bare_numeric: bool = False) -> Column:
    """struct<mentions, issues> of text, mentions in order of position. Null where text or at is null; bare_numeric takes "dd/mm" without a year."""

    nothing = F.struct(_no(MENTION).alias("mentions"), _no(ISSUE).alias("issues"))

    def read(r: Column) -> Column:
        return let(_held(F.lower(r["text"])), lambda held: F.when(held["months"] | held["slash"] | held["weekdays"], _scan(r["text"], r["at"], held, bare_numeric)).otherwise(nothing))

    def dated(r: Column) -> Column:
        found = F.when(r["text"].rlike("[0-9]"), read(r)).otherwise(nothing)
        return F.when(r["text"].isNotNull() & r["at"].isNotNull(), found.cast(SCAN))

    return let(F.struct(text.alias("text"), at.alias("at")), dated)


def scan_labels(values: Column, at: Column) -> Column:
    """An array of struct<mentions, issues>, one for each label's value; "dd/mm" needs no year there. Empty without values."""
    return F.when(values.isNull() | at.isNull(), _no(SCAN)).otherwise(F.transform(values, lambda v: scan(v, at, True)))
