"""Dates mentioned in Portuguese prose, found span by span, for one text at a time outside Spark.

Forms are tried from the most to the least specific, and a stretch of text that one form has taken is closed to the
others. ``date_spans`` reads whole columns in the same way, with these forms and words; no query comes here.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field
from datetime import date, datetime, timezone

import regex

from placeweave.functions.dates_pt import MONTHS, MOST_WEEKDAY_DAYS, MOST_YEAR_DAYS, WEEKDAYS

MENTION = "struct<date:string,end_date:string,matched:string,start:int,end:int,kind:string,until:boolean,inferred:boolean>"
ISSUE = "struct<matched:string,reason:string>"
SCAN = f"struct<mentions:array<{MENTION}>,issues:array<{ISSUE}>>"

# How dates, sentences and deadlines are written.
_MONTH = "janeiro|fevereiro|mar[çc]o|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro"
_DAY = r"(?<!\p{L})(domingo|segunda|ter[çc]a|quarta|quinta|sexta|s[áa]bado)(?:-feira)?(?!\p{L})"
_ORD = r"(?:º|°|o(?!\p{L}))?"
_YEAR = r"(?:\s*,?\s*(?:de\s+)?((?:19|20)[0-9]{2})(?![0-9]))?"
_PAST = (
    "foi|foram|aconteceu|aconteceram|ocorreu|ocorreram|realizou(?:-se)?|realizaram(?:-se)?|teve|tiveram|encerrou|encerraram|recebeu|receberam|"
    "participou|participaram|esteve|estiveram|celebrou|celebraram|reuniu|reuniram|visitou|visitaram"
)
_SHORT = [
    "dr", "dra", "sr", "sra", "srta", "prof", "profa", "av", "r", "rod", "pç", "pça", "est", "jd", "vl", "pq", "sto", "sta", "nº", "n", "cel", "gen",
    "ten", "cap", "eng", "arq", "ltda", "cia", "etc", "aprox", "tel", "km",
]


def _re(pattern: str, flags: int = regex.I):
    return regex.compile(pattern, flags)


FORMS = [
    ("range", _re(rf"(?<![0-9])(?:de\s+)?(?P<d>[0-9]{{1,2}}){_ORD}\s+(?:a|até)\s+(?:o\s+dia\s+)?(?P<to>[0-9]{{1,2}}){_ORD}\s+de\s+(?P<m>{_MONTH})(?!\p{{L}}){_YEAR}")),
    ("list_item", _re(rf"(?<![0-9])(?P<days>[0-9]{{1,2}}{_ORD}(?:\s*,\s*[0-9]{{1,2}}{_ORD})*\s+e\s+[0-9]{{1,2}}){_ORD}\s+de\s+(?P<m>{_MONTH})(?!\p{{L}}){_YEAR}")),
    ("day_month", _re(rf"(?<![0-9])(?P<d>[0-9]{{1,2}}){_ORD}\s+de\s+(?P<m>{_MONTH})(?!\p{{L}}){_YEAR}")),
    ("numeric", _re(r"(?<![0-9/])(?P<d>[0-9]{1,2})/(?P<m>[0-9]{1,2})(?:/([0-9]{4}))?(?![0-9/])")),
    (
        "weekday_day",
        _re(rf"{_DAY}(?:\s*\(\s*(?P<a>[0-9]{{1,2}}){_ORD}\s*\)|\s*,\s*(?:dia\s+)?(?P<b>[0-9]{{1,2}}){_ORD}(?![0-9/:hH]|\s*(?:de\s+\p{{L}}|h(?![A-Za-z0-9_])))|\s+dia\s+(?P<c>[0-9]{{1,2}}){_ORD}(?![0-9/:hH]|\s*de\s+\p{{L}}))"),
    ),
]
_LOOSE_YEAR = _re(r"\s*[,/–-]?\s*(?:de\s+)?[0-9]{4}(?![0-9])")
_DONE = _re(rf"(?<!\p{{L}})(?:{_PAST})(?!\p{{L}})")
_DEADLINE = _re(r"(?<!\p{L})até\s+(?:(?:o|a|à|ao)\s+)?(?:às?\s+[0-9]{1,2}h[0-9]{0,2}\s+)?(?:(?:próxim[oa]|dia|d[oa]|est[ae]|nest[ae])\s+)*$")
_WEEKDAY_BEFORE = _re(rf"{_DAY}\s*[,(]?\s*(?:dia\s+)?$")
_WEEKDAY_AFTER = _re(rf"\s*[,(–-]\s*{_DAY}(?!(?:-feira)?\s+(?:a|à|e)\s)")
_STOP = _re(r"[!?;\n.]", 0)
_WORD_END = _re(r"[\p{L}º]+$", 0)
_NEXT = _re(r"(\s*)(\S?)", 0)
_LOWER_OR_DIGIT = _re(r"[\p{Ll}0-9]", 0)


def real_date(year: int, month: int, day: int) -> date | None:
    try:
        return date(year, month, day)
    except ValueError:
        return None


def _away(d: date, at: datetime) -> float:
    return abs((datetime(d.year, d.month, d.day, tzinfo=timezone.utc) - at).total_seconds())


def _nearest(options: list[date | None], at: datetime, most_days: int) -> date | None:
    """The option nearest to at, the later of two as near, unless it is too far."""
    known = [d for d in options if d]
    best = min(known, key=lambda d: (_away(d, at), -d.toordinal()), default=None)
    return best if best and _away(best, at) <= most_days * 86400 else None


def near_year(day: int, month: int, at: datetime) -> date | None:
    return _nearest([real_date(at.year + k, month, day) for k in (-1, 0, 1)], at, MOST_YEAR_DAYS)


def near_month(day: int, weekday: int, at: datetime) -> date | None:
    months = [divmod(at.year * 12 + at.month - 1 + k, 12) for k in (-1, 0, 1)]
    options = [real_date(y, m + 1, day) for y, m in months]
    return _nearest([d for d in options if d and d.isoweekday() % 7 == weekday], at, MOST_WEEKDAY_DAYS)


def _ends_sentence(text: str, i: int) -> bool:
    if text[i] != ".":
        return True
    blank, char = _NEXT.match(text, i + 1).groups()
    if char and (not blank or _LOWER_OR_DIGIT.match(char)):
        return False
    word = _WORD_END.search(text[max(0, i - 12) : i])
    return not word or (len(word[0]) > 2 and word[0].lower() not in _SHORT)


@dataclass
class _Scan:
    text: str
    at: datetime
    bare_numeric: bool
    taken: list[tuple[int, int]] = field(default_factory=list)
    mentions: list[dict] = field(default_factory=list)
    issues: list[dict] = field(default_factory=list)
    stops: list[int] | None = None

    def fail(self, m, reason: str) -> None:
        self.issues.append({"matched": m[0], "reason": reason})

    def sentence(self, start: int, end: int) -> str:
        if self.stops is None:
            self.stops = [m.start() for m in _STOP.finditer(self.text) if _ends_sentence(self.text, m.start())]
        before, after = bisect_left(self.stops, start), bisect_left(self.stops, end)
        return self.text[self.stops[before - 1] + 1 if before else 0 : self.stops[after] if after < len(self.stops) else len(self.text)]

    def may_infer(self, m) -> bool:
        """Whether a mention without a year may get one: not before a loose year, not in a sentence about the past."""
        if _LOOSE_YEAR.match(self.text[m.end() : m.end() + 12]):
            self.fail(m, "year_not_evident")
            return False
        return not _DONE.search(self.sentence(*m.span()))

    def weekday_agrees(self, m, found: date) -> bool:
        near = _WEEKDAY_BEFORE.search(self.text[max(0, m.start() - 30) : m.start()]) or _WEEKDAY_AFTER.match(self.text[m.end() : m.end() + 30])
        if near and WEEKDAYS[near[1].lower()] != found.isoweekday() % 7:
            self.fail(m, "weekday_mismatch")
            return False
        return True

    def add(self, m, kind: str, found: date, inferred: bool, until: date | None = None) -> None:
        deadline = bool(_DEADLINE.search(self.text[max(0, m.start() - 40) : m.start()]))
        self.mentions.append({"date": found.isoformat(), "end_date": until and until.isoformat(), "matched": m[0], "start": m.start(), "end": m.end(), "kind": kind, "until": deadline, "inferred": inferred})

    def resolve(self, m, day: int, month: int, year: int | None) -> date | None:
        found = real_date(year, month, day) if year is not None else near_year(day, month, self.at)
        if found is None:
            self.fail(m, "year_not_evident" if year is None and real_date(2028, month, day) else "invalid_calendar_date")
        return found

    def read(self, kind: str, m) -> None:
        groups = m.groupdict()
        if kind == "weekday_day":
            found = near_month(int(groups["a"] or groups["b"] or groups["c"]), WEEKDAYS[m[1].lower()], self.at) if self.may_infer(m) else False
            if found is None:
                self.fail(m, "weekday_mismatch")
            elif found:
                self.add(m, kind, found, True)
            return
        year = int(m[m.re.groups]) if m[m.re.groups] else None
        if year is None and not self.may_infer(m):
            return
        month = int(groups["m"]) if kind == "numeric" else MONTHS[groups["m"].lower()]
        if kind == "list_item":
            for day in map(int, regex.findall(r"[0-9]+", groups["days"])):
                if day and (found := self.resolve(m, day, month, year)):
                    self.add(m, kind, found, year is None)
            return
        found = self.resolve(m, int(groups["d"]), month, year)
        if found is None:
            return
        last = None
        if kind == "range":
            last = real_date(found.year, month, int(groups["to"]))
            if last is None or last <= found:
                self.fail(m, "invalid_calendar_date")
                return
        if self.weekday_agrees(m, found):
            self.add(m, "full" if kind == "day_month" and year is not None else kind, found, year is None, last)

    def run(self) -> dict:
        for kind, form in FORMS:
            for m in form.finditer(self.text):
                skip = kind == "numeric" and not m[m.re.groups] and not self.bare_numeric
                if skip or any(m.start() < b and m.end() > a for a, b in self.taken):
                    continue
                self.taken.append(m.span())
                self.read(kind, m)
        self.mentions.sort(key=lambda x: x["start"])
        return {"mentions": self.mentions, "issues": self.issues}


def scan(text: str, at: datetime, bare_numeric: bool = False) -> dict:
    """Mentions in order of position, and issues, of one text. at: an instant with a time zone."""
    return _Scan(text, at, bare_numeric).run()
