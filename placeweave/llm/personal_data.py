"""Personal data: fixed patterns, then bootstrapped contextual extraction.

Spans found by the four fixed patterns are seeds. The words around a seed form lexical patterns; other stretches of
identifier shape in the same contexts are candidates: tokens with a digit or an @, runs of such tokens, and addresses
that are spelled out. Patterns and instances make a bipartite graph that Spark scores in rounds, until no pattern is
added. A pattern counts if enough of its distinct instances are known, and the more of them the better; an instance is
as sure as its patterns together. Candidates of sure patterns become spans of the pattern's kind; fixed ones stay.

Defined results: a null or empty text has no spans; a candidate never overlaps a fixed span, has six code points or
more and MOST_TOKENS tokens at most (longer runs are tables of numbers); context words are whole words of up to CONTEXT
code points; texts may be of any length and are read whole; spans depend on the text alone, so repeated rows and
copies repeat their result; an empty table gives an empty table. Columns other than id and text are left to the caller.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.llm.shared import join_hot, materialize

KINDS = ["email", "ip", "card", "phone"]
#: A pattern needs as many distinct known instances, this share of known ones among all its instances, and this
#: strength (the share times log2 of the known ones and one more: as much as four known of four) to count.
MIN_KNOWN, MIN_CONFIDENCE, MIN_STRENGTH = 4, 0.5, 2.32
#: An instance needs this score to become a span: one minus the product of its patterns' doubts.
MIN_SCORE = 0.7
#: Tokens of one identifier at most.
MOST_TOKENS = 8
#: Code points looked at on either side of a span for its context words.
CONTEXT = 120
DIGESTS = ["text_digest_1", "text_digest_2"]
SPAN = "struct<start:int,end:int,kind:int>"
MENTION = "struct<start:int,end:int,kind:int,instance:string,patterns:array<string>>"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails from its first digit fails from all others too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_BLANK = re.compile(r"[\x20\x09-\x0D]")
_DIGIT = re.compile(r"[0-9]")
_EDGE = ".,;:!?()[]{}<>\"'"
_SPACED = re.compile(r"\s").search
_DOT = re.compile(r"(?i)[\x20(\[]dot[\x20)\]]")
_SPELLED = re.compile(r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]++(?:\x20at\x20|\x20?[(\[]at[)\]]\x20?|@)[A-Z0-9-]+(?:(?:\x20dot\x20|\x20?[(\[]dot[)\]]\x20?)[A-Z0-9-]+)+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost spans; found from the @ outwards, so that long runs without one cost no more than their length."""
    done = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        while at > done and text[at - 1] in _LOCAL:
            at -= 1
        if at < m.start():
            yield at, m.end()
            done = m.end()


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (int(d) * 2 - 9 if d > "4" else int(d) * 2) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """start, end, number of kind; by start, then kind."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def spelled_out(text: str) -> list[tuple[int, int]]:
    """Addresses like ``name at host dot org`` or ``name(at)host(dot)org``."""
    return [m.span() for m in _SPELLED.finditer(text)] if _DOT.search(text) else []


def _hinted(text: str) -> Iterator[tuple[int, int]]:
    """Tokens between blanks that hold a digit or an @."""
    after = 0
    for hit in _HINT.finditer(text):
        if hit.start() >= after:
            start = max(after, *(text.rfind(c, after, hit.start()) + 1 for c in " \t\n\x0b\f\r"))
            m = _BLANK.search(text, hit.start())
            after = m.start() if m else len(text)
            yield start, after


def _bare(text: str, start: int, end: int) -> tuple[int, int]:
    """start, end without edge marks; a bracket that closes within the stretch stays."""
    part = text[start:end]
    b = start + len(part.rstrip(_EDGE))
    a = start + len(part) - len(part.lstrip(_EDGE))
    if a > start and text[a - 1] in "([" and (")" if text[a - 1] == "(" else "]") in text[a:b]:
        a -= 1
    return a, b


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Stretches of identifier shape that overlap no taken span: spelled-out addresses, and runs of tokens with a hint."""
    runs: list[list[int]] = []  # start, end, tokens
    fixed = {i for a, b, _ in taken for i in (a, b)}
    for start, end in _hinted(text):
        if runs and text[runs[-1][1] : start] == " " and text[start - 2] not in ".,;:!?" and not fixed & {start, start - 1}:
            runs[-1][1:] = [end, runs[-1][2] + 1]
        else:
            runs.append([start, end, 1])
    loose = [_bare(text, a, b) for a, b, n in runs if n <= MOST_TOKENS]
    out, k, reach = [], 0, 0
    for a, b in sorted(spelled_out(text) + loose):
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if b - a >= 6 and reach <= a:
            out.append((a, b))
            reach = b
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span: the two words before it, and one on each side."""
    plain = lambda w: _DIGIT.sub("0", w.lower())
    before, after = text[max(0, start - CONTEXT) : start].split(), text[end : end + CONTEXT].split()
    if start > CONTEXT and before and not _SPACED(text[start - CONTEXT - 1 : start - CONTEXT + 1]):
        before = before[1:]  # cut in mid-word
    if end + CONTEXT < len(text) and len(after) == 1 and not _SPACED(text[end + CONTEXT - 1 : end + CONTEXT + 1]):
        after = []
    left, right = [plain(w) for w in before[-2:]], [plain(w) for w in after[:1]]
    out = [f"{left[0]} {left[1]} _"] if len(left) == 2 else []
    return out + ([f"{left[-1]} _ {right[0]}"] if left and right else [])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ints = [(n, pa.int32()) for n in ("start", "end", "kind")]
    more = [("instance", pa.string()), ("patterns", pa.list_(pa.string()))]
    for batch in batches:
        spans, mentions = [], []
        for text in batch.column("text").to_pylist():
            found = fixed_spans(text)
            loose = [(a, b, -1) for a, b in candidates(text, found)]
            spans.append([{"start": a, "end": b, "kind": k} for a, b, k in found])
            mentions.append([{"start": a, "end": b, "kind": k, "instance": text[a:b].lower(), "patterns": contexts(text, a, b)} for a, b, k in found + loose])
        keep = [batch.column(c) for c in ("id", *DIGESTS)]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(spans, pa.list_(pa.struct(ints))), pa.array(mentions, pa.list_(pa.struct(ints + more)))], ["id", *DIGESTS, "base", "mentions"])


def learn_patterns(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sure patterns (pattern, kind, confidence) and the unseen (pattern, instance, kind) edges that they make sure.

    mentions: instance, pattern, kind (-1: not known). Every round aggregates distinct edges, never single mentions.
    """
    edges = materialize(mentions.groupBy("pattern", "instance").agg(F.max("kind").alias("known")), "pii-edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("size")).where(F.col("size") >= MIN_KNOWN)
    known = edges.where("known >= 0").select("instance", F.col("known").alias("kind"), F.lit(1.0).alias("score")).distinct()
    scores, added = materialize(known, "pii-scores"), -1
    while True:  # a pattern once sure stays, so there are as many rounds as patterns at most; in practice a few
        per_kind = join_hot(edges.select("pattern", "instance"), _best(scores), "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"))
        rated = per_kind.where(F.col("mass") >= MIN_KNOWN).join(sizes, "pattern").withColumn("confidence", F.col("mass") / F.col("size"))
        rated = rated.where((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("confidence") * F.log2(F.col("mass") + 1) >= MIN_STRENGTH)).select("pattern", "kind", "confidence")
        now = rated if added < 0 else rated.unionByName(sure)
        sure = materialize(now.groupBy("pattern").agg(F.max(F.struct("confidence", "kind")).alias("r")).select("pattern", "r.kind", "r.confidence"), "pii-patterns")
        before, added = added, sure.count()
        met = materialize(join_hot(edges.where("known < 0").select("pattern", "instance"), sure, "pattern"), "pii-met")
        doubt = F.sum(F.log(1.0 - F.least(F.col("confidence"), F.lit(0.999))))
        new = met.groupBy("instance", "kind").agg((1.0 - F.exp(doubt)).alias("score"))
        if added == before:
            break
        scores = materialize(known.unionByName(new), "pii-scores")
    strong = _best(new.where(F.col("score") >= MIN_SCORE)).drop("score")
    return sure, join_hot(met.select("pattern", "instance"), strong, "instance")


def _best(scores: DataFrame) -> DataFrame:
    """One kind for each instance: that of the best score, then the first as listed."""
    best = scores.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("turn"))).alias("r"))
    return best.select("instance", (-F.col("r.turn")).alias("kind"), "r.score")


def with_digests(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the two 64-bit digests of the text by which its spans are found; a null text is an empty one."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.withColumns({DIGESTS[0]: F.xxhash64(text), DIGESTS[1]: F.xxhash64(text, F.lit(1))})


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, DIGESTS (of the text), base and spans: arrays of (start, end, kind), one row per row of docs.

    base holds the spans of the fixed patterns, spans these and the discovered ones; both by start, then kind.
    """
    slim = with_digests(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")))
    found = materialize(slim.mapInArrow(_extract, f"id long, {DIGESTS[0]} long, {DIGESTS[1]} long, base array<{SPAN}>, mentions array<{MENTION}>"), "pii-found")
    seen = found.where(F.size("mentions") > 0)
    flat = seen.select(*DIGESTS, F.inline("mentions")).withColumn("pattern", F.explode("patterns")).drop("patterns")
    sure, edges = learn_patterns(flat.select("instance", "pattern", "kind"))
    loose = flat.where("kind < 0").drop("kind")
    new = join_hot(loose, edges, ["pattern", "instance"]).groupBy(*DIGESTS).agg(F.collect_set(F.struct("start", "end", "kind")).alias("more"))
    joined = join_hot(found.select("id", *DIGESTS, "base"), materialize(new, "pii-new"), DIGESTS, "left")
    spans = F.array_sort(F.concat("base", F.coalesce(F.col("more").cast(f"array<{SPAN}>"), F.array().cast(f"array<{SPAN}>"))), _by_start)
    return joined.select("id", *DIGESTS, "base", spans.alias("spans"))


def _by_start(a: Column, b: Column) -> Column:
    key = lambda s: s["start"].cast("long") * len(KINDS) + s["kind"]
    return F.sign(key(a) - key(b)).cast("int")


def spans_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """text with every stretch covered by spans replaced by the kind of its first span, like ``[EMAIL]``."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))
        out = F.when(s["start"] >= acc["at"], gap).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, first, step, rest))
