"""Posts to activity items: labelled blocks first, prose second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.functions import recurrence
from placeweave.functions.dates_pt import first_group, parse_time_range
from placeweave.functions.text import SPACE, let, strip_html, trim
from placeweave.operators.date_spans import scan, scan_labels
from placeweave.operators.ranges import deal

# Labels, weekdays and confidences.
WEEKDAY = "domingo|segunda|ter[çc]a|quarta|quinta|sexta|s[áa]bado"
MONTH = "janeiro|fevereiro|mar[çc]o|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro"
PURE_LABELS = ["local", "dia", "data", "horário", "horario"]
DATE_LABEL = rf"(?iu)^(?:dia|data)(?:{SPACE}+e{SPACE}+hor[áa]rio)?{SPACE}*:{SPACE}*"
START_LABEL = rf"(?iu)^in[íi]cio{SPACE}*:{SPACE}*"
TIME_LABEL = rf"(?iu)^hor[áa]rio{SPACE}*:{SPACE}*"
PLACE_LABEL = rf"(?iu)^local{SPACE}*:{SPACE}*"
EVENT_LABEL = rf"(?iu)^evento{SPACE}*:{SPACE}*"
LEADING_DATE = rf"(?iu)^(?:(?:{WEEKDAY})(?:-feira)?{SPACE}*,?{SPACE}*)?(?:de{SPACE}+)?\d{{1,2}}(?:º|°)?{SPACE}+(?:(?:a|até){SPACE}+\d{{1,2}}(?:º|°)?{SPACE}+)?de{SPACE}+(?:{MONTH})(?!\p{{L}})"
GROUPING = rf"(?iu)^(?:(?:{WEEKDAY})[a-zçã-]*{SPACE}*\(\d{{1,2}}\)|\d{{1,2}}/\d{{1,2}}(?:/\d{{2,4}})?|{MONTH}|(?:{WEEKDAY})(?:[a-zçã-]*feira)?)$"
STRONG = r"(?is)<strong>(.*?)</strong>"
CONFIDENCE = {"structured": 0.9, "clear": 0.55, "date_only": 0.35, "recurrence_only": 0.3}
VENUE = rf"(?<![A-Za-z0-9_])(?:n[ao]|em){SPACE}+([A-ZÀ-Ü][A-Za-z0-9_á-úÀ-Ü\s ]{{2,40}}?)(?:[,.\n]|{SPACE}+(?:em|neste|nesta)(?![A-Za-z0-9_])|$)"


def venue_in_prose(text: Column) -> Column:
    """The capitalised name after na, no or em."""
    return trim(first_group(text, VENUE))


def blocks(html: Column) -> Column:
    """Pieces of HTML that begin at a <strong>; pieces that are a label or a labelled field stay with the piece before."""
    inner = lambda p: trim(strip_html(F.regexp_extract(p, STRONG, 1)))
    bare = lambda t: F.lower(trim(F.regexp_replace(trim(t), ":$", "")))
    line = lambda p: strip_html(F.split(F.regexp_extract(p, r"(?is)\A<strong>.*?</strong>(.*)\z", 1), r"(?i)<br\s*/?>|</p>", 2)[0])

    def field_label(p: Column) -> Column:
        label, after = inner(p), line(p)
        name = trim(F.regexp_replace(label, ":$", ""))
        rest = trim(F.regexp_replace(after, rf"^{SPACE}*:", ""))
        colon = label.endswith(":") | after.rlike(rf"^{SPACE}*:")
        return p.rlike(r"(?is)\A<strong>.*?</strong>") & colon & (name != "") & ~name.rlike(r"\d") & (F.size(F.split(name, f"{SPACE}+")) <= 3) & (rest != "")

    def join(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        glued = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, p)))
        is_label = bare(inner(p)).isin(PURE_LABELS) & p.rlike(STRONG)
        return F.when((F.size(acc) > 0) & (is_label | (F.try_element_at(acc, F.lit(-1)).rlike("(?i)<strong>") & field_label(p))), glued).otherwise(F.concat(acc, F.array(p)))

    parts = F.filter(F.split(html, r"(?i)(?=<strong>)"), lambda p: trim(p) != "")
    return F.filter(F.aggregate(parts, F.array().cast("array<string>"), join), lambda p: p.rlike("(?i)<strong>"))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: trim(x) != "")


def _first(lines: Column, pattern: str) -> Column:
    """The value of the first line with this label."""
    return F.regexp_replace(F.get(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(0)), pattern, "")


def label_values(lines: Column) -> Column:
    """Values of date labels, else of start labels, else the only line that begins with a date."""
    of = lambda p: F.transform(F.filter(lines, lambda x: x.rlike(p)), lambda x: F.regexp_replace(x, p, ""))
    leading = F.transform(F.filter(lines, lambda x: trim(x).rlike(LEADING_DATE)), lambda x: trim(x))
    none = F.array().cast("array<string>")
    alone = let(leading, lambda x: F.when(F.size(x) == 1, x).otherwise(none))
    started = let(of(START_LABEL), lambda x: F.when(F.size(x) > 0, x).otherwise(alone))
    return let(of(DATE_LABEL), lambda x: F.when(F.size(x) > 0, x).otherwise(started))


def schedule(values: Column, scans: Column) -> Column:
    """struct<date, end_date, rest> where every value has exactly one date and all agree; rest: of a single value."""
    return let(scans, lambda found: _schedule(values, found))


def _schedule(values: Column, scans: Column) -> Column:
    dates = lambda s: F.array_distinct(F.transform(s["mentions"], lambda m: F.struct(m["date"].alias("date"), m["end_date"].alias("end_date"))))
    clear = lambda s: (F.size(s["issues"]) == 0) & (F.size(dates(s)) == 1) & ~F.exists(s["mentions"], lambda m: m["until"])
    end = F.element_at(F.get(scans, F.lit(0))["mentions"], -1)["end"]
    only = F.get(values, F.lit(0))
    rest = F.when(F.size(values) == 1, trim(F.regexp_replace(F.substring(only, end + 1, F.length(only)), rf"^(?:{SPACE}|[,;–-])+", "")))

    def agreed(all_dates: Column) -> Column:
        ok = (F.size(scans) > 0) & F.forall(scans, clear) & (F.size(all_dates) == 1)
        date = F.when(ok, F.get(all_dates, F.lit(0)))
        return F.struct(date["date"].alias("date"), date["end_date"].alias("end_date"), F.when(date.isNotNull(), F.nullif(rest, F.lit(""))).alias("rest"))

    return let(F.array_distinct(F.flatten(F.transform(scans, dates))), agreed)


def _once(value: Column) -> Column:
    """value as a column that later filters cannot repeat: they would be pushed down with all of value written out in each."""
    return F.explode(F.array(value))


def _pieces(posts: DataFrame) -> DataFrame:
    """Each post with a row for each of its blocks (idx, block, lines, event), or one row without a piece."""
    at = F.regexp_instr("html", F.col("marker"))
    after = F.when(at > 0, F.substring(F.col("html"), at + F.length(F.regexp_substr("html", F.col("marker"))), F.length("html")))
    found = posts.withColumn("after", after).withColumn("blocks", blocks(F.col("after")))
    none = F.array().cast("array<string>")
    strong = F.transform("blocks", lambda b: F.struct(b.alias("block"), none.alias("lines"), F.lit(False).alias("event")))

    def segments(lines: Column) -> Column:
        """Without any block, lines labelled "Evento:" begin the segments."""
        starts = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(EVENT_LABEL), i)), lambda i: i.isNotNull())
        cut = lambda found: F.transform(found, lambda start, i: F.slice(lines, start + 1, F.coalesce(F.get(found, i + 1), F.size(lines)) - start))
        return F.transform(let(starts, cut), lambda x: F.struct(F.lit(None).cast("string").alias("block"), x.alias("lines"), F.lit(True).alias("event")))

    lines = F.filter(F.transform(F.split(strip_html(F.col("after")), "\n"), trim), lambda x: x != "")
    pieces = F.when(F.size("blocks") > 0, strong).when(F.col("after").isNotNull(), let(lines, segments))
    found = found.select(*posts.columns, F.posexplode_outer(pieces).alias("idx", "piece"))
    return found.select(*posts.columns, "idx", "piece.*")


def _read_pieces(posts: DataFrame) -> DataFrame:
    """Each row of _pieces with title, date, end_date, time, end_time, venue_name, raw_text, grouping, and whether it is an item (kept)."""
    rows = _pieces(posts)
    none = F.array().cast("array<string>")
    rows = rows.withColumn("raw_text", F.when(F.col("event"), F.array_join("lines", "\n")).otherwise(strip_html(F.col("block"))))
    rows = rows.withColumn("lines", F.when(F.col("event"), F.col("lines")).otherwise(F.coalesce(_lines(F.col("raw_text")), none)))
    head = trim(F.regexp_replace(F.get("lines", F.lit(0)), EVENT_LABEL, ""))
    rows = rows.withColumn("title_", F.when(F.col("event"), head).otherwise(trim(strip_html(F.regexp_extract("block", STRONG, 1))))).drop("block")
    rows = rows.withColumn("values", label_values(F.slice("lines", F.lit(2), F.size("lines"))))
    # Values of labels, and a date like "sábado (17)" of the text and of the title for items without one: read in one go.
    pick = rf"(?iu)(?:{WEEKDAY})[a-z-]*{SPACE}*\(\d{{1,2}}\)"
    hint = lambda c: F.when(F.contains(F.col(c), F.lit("(")), F.coalesce(F.regexp_substr(c, F.lit(pick)), F.lit(""))).otherwise("")
    rows = rows.withColumn("scans", scan_labels(F.concat("values", F.array(hint("raw_text"), hint("title_"))), F.col("at")))
    n = F.size("values")
    hinted = F.transform(F.slice(F.col("scans"), n + 1, F.lit(2)), lambda s: F.get(s["mentions"], F.lit(0))["date"])
    found = F.struct(schedule(F.col("values"), F.slice(F.col("scans"), F.lit(1), n)).alias("s"), F.get(F.filter(hinted, lambda d: d.isNotNull()), F.lit(0)).alias("late"))
    head = F.transform(F.split(F.coalesce(F.get("lines", F.lit(0)), F.lit("")), rf"{SPACE}[–-]{SPACE}"), trim)
    rows = rows.withColumns({"found": _once(found), "head": head})
    time_of = lambda x: parse_time_range(x)["time"]
    second = F.get(F.col("head"), F.lit(1))
    labelled, dated = parse_time_range(trim(_first(F.col("lines"), TIME_LABEL))), parse_time_range(F.col("found.s.rest"))
    in_head = F.get(F.filter(F.transform(F.slice(F.col("head"), F.lit(2), F.size("head")), lambda x: parse_time_range(x)), lambda t: t["time"].isNotNull()), F.lit(0))
    known = lambda value, other: let(value, lambda t: F.when(t["time"].isNotNull(), t).otherwise(other))
    best = known(labelled, known(dated, F.when(~F.col("event"), in_head)))
    place = F.coalesce(F.nullif(trim(_first(F.col("lines"), PLACE_LABEL)), F.lit("")), F.when(~F.col("event") & time_of(second).isNull(), F.nullif(second, F.lit(""))))
    rows = rows.withColumn("read", _once(F.struct(best.alias("t"), place.alias("place"))))
    title, date, time, venue = F.col("title_"), F.col("found.s.date"), F.col("read.t.time"), F.col("read.place")
    words = F.size(F.split(trim(F.regexp_replace(title, ":$", "")), f"{SPACE}+"))
    generic = title.endswith(":") & (trim(F.regexp_replace(title, ":$", "")) != "") & (words <= 4) & ~title.rlike(r"\d")
    bare = F.lower(trim(F.regexp_replace(trim(title), ":$", "")))
    empty = date.isNull() & time.isNull() & venue.isNull()
    kept = F.coalesce(F.col("idx").isNotNull() & (title != "") & ~bare.isin(PURE_LABELS) & ~(generic & empty), F.lit(False))
    return rows.select(
        *[F.col(c).alias("post_title") if c == "title" else c for c in posts.columns], "idx", title.alias("title"), F.coalesce(date, "found.late").alias("date"), F.col("found.s.end_date").alias("end_date"), time.alias("time"),
        F.col("read.t.end_time").alias("end_time"), venue.alias("venue_name"), "raw_text", F.lower(trim(title)).rlike(GROUPING).alias("grouping"), _once(kept).alias("kept"),
    )


def structured_items(posts: DataFrame) -> DataFrame:
    """post_id, idx, title, date, end_date, time, end_time, venue_name, raw_text, grouping of each labelled block.

    posts: post_id, html, marker (a pattern before the blocks), at (instant of publication).
    """
    out = _read_pieces(deal(posts.select("post_id", "html", "marker", "at"), "post_id")).where("kept")
    order = Window.partitionBy("post_id").orderBy("idx")
    return out.select("post_id", (F.row_number().over(order) - 1).alias("idx"), "title", "date", "end_date", "time", "end_time", "venue_name", "raw_text", "grouping")


def _read_prose(posts: DataFrame, text: Column) -> DataFrame:
    """posts with prose: struct<status, date, end_date, time, end_time, venue_name, confidence, reason, raw_text>, read from text."""
    scanned = posts.withColumn("_text", text).withColumn("_s", _once(scan(F.col("_text"), F.col("at"))))
    since = F.date_format(F.when(F.col("exact"), F.col("at")).otherwise(F.col("at") - F.expr("INTERVAL '1' DAY")), "yyyy-MM-dd")
    live = F.filter("_s.mentions", lambda m: ~m["until"] & (~m["inferred"] | (m["date"] > since)))
    dates = F.array_distinct(F.transform(live, lambda m: F.struct(m["date"].alias("date"), m["end_date"].alias("end_date"))))
    times = F.array_distinct(F.transform(F.regexp_extract_all("_text", F.lit(r"(?i)(\d{1,2}h\d{0,2})"), F.lit(1)), F.lower))
    issues = F.size("_s.issues") > 0
    judged = scanned.withColumn("_dates", dates)
    n = F.size("_dates")
    # What a post's status does not depend on is not looked for.
    status = (
        F.when(issues, "ambiguous").when((n == 0) & recurrence.qualifies(F.col("_text")), "recurrence_only").when(n == 0, "not_found")
        .when((n > 1) | (F.size(times) > 1), "ambiguous").otherwise("extracted")
    )
    judged = judged.withColumn("_status", _once(status))
    only, status = F.get("_dates", F.lit(0)), F.col("_status")
    done, single = status == "extracted", (n == 1) & ~issues
    clock = F.when(done, parse_time_range(F.col("_text")))
    read = judged.withColumns({"_t": clock, "_venue": F.when(status != "not_found", venue_in_prose(F.col("_text")))})
    reason = F.when(issues, "inconsistent_date").when(n > 1, "several_dates").when(status == "ambiguous", "several_times")
    confidence = F.when(done & F.col("_t.time").isNotNull(), CONFIDENCE["clear"]).when(done, CONFIDENCE["date_only"]).when(status == "recurrence_only", CONFIDENCE["recurrence_only"])
    prose = F.struct(
        status.alias("status"), F.when(single, only["date"]).alias("date"), F.when(done, only["end_date"]).alias("end_date"), F.col("_t.time").alias("time"), F.col("_t.end_time").alias("end_time"),
        F.col("_venue").alias("venue_name"), confidence.alias("confidence"), reason.alias("reason"), F.col("_text").alias("raw_text"),
    )
    return read.select(*posts.columns, prose.alias("prose"))


def narrative_items(posts: DataFrame) -> DataFrame:
    """post_id, status, date, end_date, time, end_time, venue_name, confidence, reason of each post read as prose.

    posts: post_id, html, at, exact (whether at is the instant of publication; else only its month is known).
    """
    return _read_prose(deal(posts.select("post_id", "html", "at", "exact"), "post_id"), strip_html(F.col("html"))).select("post_id", "prose.*")


def post_results(posts: DataFrame) -> DataFrame:
    """What each post gave, read in one pass: the columns of items, then idx and skipped (why a block or a post gave no date).

    posts: post_id, source_key, title, html, marker, at, exact. A row without source_item_id is no item; a block without
    a date is one and is skipped as well.
    """
    own = Window.partitionBy("post_id")
    rows = _read_pieces(deal(posts.select("post_id", "source_key", "title", "html", "marker", "at", "exact"), "post_id"))
    rows = rows.withColumns({"n": F.count_if("kept").over(own), "idx": F.row_number().over(own.orderBy(F.desc("kept"), "idx")) - 1})
    rows = rows.where(F.col("kept") | ((F.col("n") == 0) & (F.col("idx") == 0)))
    rows = _read_prose(rows, F.when(~F.col("kept"), strip_html(F.col("html"))))
    block, prose, none = F.col("kept"), F.col("prose"), F.lit(None).cast("string")
    told = block | prose["status"].isin("extracted", "recurrence_only")
    of = lambda c: F.when(block, F.col(c)).otherwise(prose[c])
    occurrence = F.struct(*[of(c).alias(c) for c in ("date", "time", "end_date", "end_time")])
    occurrences = F.when(of("date").isNotNull(), F.array(occurrence)).otherwise(F.array().cast("array<struct<date:string,time:string,end_date:string,end_time:string>>"))
    reasons = F.array_compact(F.array(
        F.when(block & F.col("date").isNull(), "structured_subevent_missing_date"), F.when(block & F.col("grouping"), "schedule_grouping_detected"),
        F.when(~block & prose["venue_name"].isNull(), "venue_not_extracted_from_narrative"),
    ))
    skipped = F.when(block, F.when(F.col("date").isNull(), "structured_subevent_missing_date")).when(told, none).when(prose["status"] == "ambiguous", "narrative_ambiguous").otherwise("no_extractable_schedule_found")
    return rows.select(
        "post_id", "source_key", F.when(told, F.concat_ws("_", F.col("post_id").cast("string"), F.col("idx").cast("string"))).alias("source_item_id"), F.when(block, F.col("title")).otherwise(F.col("post_title")).alias("title"),
        occurrences.alias("occurrences"), of("venue_name").alias("venue_name"), F.when(of("venue_name").isNotNull(), F.when(block, "explicit_name").otherwise("inferred_from_context")).alias("hint"),
        F.when(block, "structured_block").otherwise("narrative_fallback").alias("method"), F.when(block, F.lit(CONFIDENCE["structured"])).otherwise(prose["confidence"]).alias("confidence"), reasons.alias("review_reasons"),
        F.when(~block, prose["raw_text"]).alias("raw_text"), F.when(block & (F.col("n") == 1), strip_html(F.col("html"))).alias("article"), "idx", skipped.alias("skipped"),
    )


def post_items(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Activity items, and what was skipped with the reason (post_id, idx, reason).

    posts: post_id, source_key, title, html, marker, at, exact. A post with labelled blocks gives one item per block;
    any other gives one or none from its prose. Who needs both in one query takes post_results.
    """
    rows = post_results(posts)
    items = rows.where("source_item_id is not null").drop("idx", "skipped")
    return items, rows.where("skipped is not null").select("post_id", "idx", F.col("skipped").alias("reason"))


def with_recurrence(items: DataFrame) -> DataFrame:
    """Adds recurrence (type, days, time, reasons) and recurrence_text_hint to items."""
    none = F.lit(None).cast("string")
    text = recurrence.candidate_text(F.col("title"), none, F.col("raw_text"), F.col("article"))
    out = items.withColumn("_text", text).withColumn("recurrence", recurrence.detect(F.col("_text"))).drop("_text")
    hint = recurrence.text_hint(F.col("title"), none, F.col("raw_text"), F.col("article"))
    return out.withColumn("recurrence_text_hint", F.when(F.col("recurrence.type").isNotNull() | (F.size("recurrence.reasons") > 0), hint))
