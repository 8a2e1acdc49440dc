"""Line-first quality rules, with built-in functions only.

Every line is judged on its own: lines full of symbols, fragments without an end mark, navigation bars and
boilerplate are removed. A document goes when it fails the base rules (too short, too repetitive) or when more than
half of its word characters stood in removed lines.

Defined results: a null or blank text has no words and fails the base rules; a text without line breaks is one line;
texts may be of any length, their cost grows with it; rows are never dropped or merged, so repeated rows give repeated
results; an empty table gives an empty table; other columns pass through under any names, and own result names replace
columns that clash with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.llm.shared import let, packed, unpacked, words

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
OWN = [*MEASURES, "base_failed", "clean_text", "clean_chars", "kept"]
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: A line with more symbols than one in five of its characters fails.
SYMBOL_SHARE = 5
#: Shorter lines need an end mark.
FRAGMENT_WORDS = 4
END_MARK = r"[.!?:;,…。！？][\"'”’»)\]]*\s*$"
NAVIGATION = r"(?:[|»›•·>].*){2}"
BOILERPLATE = (
    r"(?i)(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|"
    r"click here|read more|sign (?:in|up)|log ?in|subscribe (?:now|to)|share (?:this|on)|enable javascript|"
    r"lorem ipsum|skip to (?:main )?content|back to top)"
)
BOILERPLATE_WORDS = 12
#: A document that loses more than this percentage of its word characters is rejected.
MOST_LOST = 50


def repeated_words(w: Column, size: int = 8) -> Column:
    """How many words of the array w lie in a window of size words that occurs twice or more in w.

    Hashes of the windows tell the texts without repeats; the others are decided on the windows themselves.
    """

    def exact(keys: Column) -> Column:
        ordered = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def flagged(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda a, b: F.get(s, a)["k"] == F.get(s, b)["k"]
            hit = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & same(j, F.greatest(j - 1, F.lit(0)))) | ((j < last) & same(j, F.least(j + 1, last))))
            return F.sort_array(F.transform(hit, lambda j: F.get(s, j)["i"]))

        first = F.struct(F.lit(-size).alias("at"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(size), p - acc["at"])).alias("n"))
        return F.aggregate(let(ordered, flagged), first, step, lambda acc: acc["n"])

    def windows(a: Column, key) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(a) - (size - 1)), lambda i: key(F.slice(a, i, size)))

    hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: windows(h, F.xxhash64))
    any_twice = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(w) <= size, 0).when(any_twice, exact(windows(w, lambda s: F.array_join(s, " ")))).otherwise(0).cast("long")


def line_passes(line: Column) -> Column:
    """Whether a line stays. Blank lines stay."""

    def judge(n_words: Column) -> Column:
        bad = (
            (F.regexp_count(line, F.lit(SYMBOLS)) * SYMBOL_SHARE > F.length(line))
            | (((n_words < FRAGMENT_WORDS) | line.rlike(NAVIGATION)) & ~line.rlike(END_MARK))
            | ((n_words <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE))
        )
        return (n_words == 0) | ~bad

    return let(F.regexp_count(line, F.lit(WORD)), judge)


def judged(text: Column) -> Column:
    """struct of MEASURES, base_failed, clean_text, clean_chars and kept, from a text that is not null."""

    def measured(t: Column) -> Column:
        full = F.filter(t["lines"], lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(t["words"]).cast("long").alias("n_words"),
            F.length(F.array_join(t["words"], "")).cast("long").alias("word_chars"),
            F.regexp_count(t["text"], F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(full, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
            repeated_words(t["words"]).alias("n_repeat_words"),
            F.array_join(F.filter(t["lines"], line_passes), "\n").alias("clean_text"),
        )

    def counted(m: Column) -> Column:
        failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
        clean = F.when(F.length(m["clean_text"]) == F.length(text), m["word_chars"]).otherwise(F.length(F.array_join(words(m["clean_text"]), "")).cast("long"))
        return F.struct(*[m[c].alias(c) for c in MEASURES], failed.alias("base_failed"), m["clean_text"].alias("clean_text"), clean.alias("clean_chars"))

    def decided(c: Column) -> Column:
        lost = 100 * (c["word_chars"] - c["clean_chars"]) > MOST_LOST * c["word_chars"]
        return F.struct(*[c[x].alias(x) for x in OWN[:-1]], (~c["base_failed"] & ~lost).alias("kept"))

    parts = F.struct(text.alias("text"), F.split(text, "\n").alias("lines"), words(text).alias("words"))
    return let(let(let(parts, measured), counted), decided)


def quality_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_text, clean_chars, kept."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # A generator's columns are computed once, whatever filters follow.
    both = docs.select(packed(docs).alias("row"), F.inline(F.array(judged(text))))
    return both.select(*unpacked(F.col("row"), docs.columns, OWN), *OWN)
