"""Text expressions: trimming, accent folding, normalised names, set similarities, HTML to text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripting languages see it; Java's \s and Spark's trim know less.
BLANKS = r"\t\n\x0B\f\r    -     　﻿"
SPACE = f"[{BLANKS}]"
#: The same, each character by itself.
_BLANK_CHARS = "".join(chr(c) for c in range(0x10000) if re.match(SPACE, chr(c)))

# Letters that lose a combining mark in canonical decomposition.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüýÿçñ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyycn"

# Words that carry no name.
STOP_WORDS_PT = ["a", "as", "o", "os", "um", "uma", "uns", "umas", "da", "de", "do", "das", "dos", "du", "na", "no", "nas", "nos", "em", "ao", "aos", "à", "às", "e", "ou", "mas", "por", "para", "com", "sem", "sob", "que", "se", "ne"]
STOP_WORDS_EN = ["a", "an", "the", "of", "in", "on", "at", "to", "for", "by", "with", "from", "and", "or", "but", "nor", "is", "are", "was", "were"]

# Entities that become characters, in order.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&#8211;", "–"), ("&#8216;", "‘"), ("&#8217;", "’"), ("&#8220;", "“"), ("&#8221;", "”")]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value written and computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(_BLANK_CHARS))


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"[̀-ͯ]", "")


def normalize(text: Column, stop_words: list[str] | None = None) -> Column:
    """Folded words without punctuation and stop words; all stop words stay if there is nothing else."""
    stop_words = STOP_WORDS_PT if stop_words is None else stop_words
    # Whatever is neither letter nor digit becomes one blank, white space included.
    bare = F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " "))

    def rest(b: Column) -> Column:
        kept = F.filter(F.split(b, " "), lambda w: ~w.isin(stop_words))
        return let(kept, lambda k: F.when(F.size(k) == 0, b).otherwise(F.array_join(k, " ")))

    return let(bare, rest)


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of text with one blank on either side; none for an empty text."""
    # Each character with the two behind it, which are not consumed.
    pieces = F.regexp_extract_all(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(r"(?s)(?=(...))."), F.lit(1))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_distinct(pieces))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared elements over all elements of two sets; 0 when both are empty."""
    total = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over united elements of two sets; 1 when both are empty, 0 when one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)).cast("double"))


def strip_html(html: Column) -> Column:
    """Text of a fragment: breaks and paragraph ends become newlines, tags go, known entities are decoded."""
    out = F.regexp_replace(html, rf"(?i)<br{SPACE}*/?>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)</p>", "\n"), r"<[^>]+>", "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}|\t", " "), r"\n{3,}", "\n\n")
    return trim(out)
