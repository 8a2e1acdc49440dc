"""Order MinHash fingerprints, with built-in functions only.

Each k-mer of words is numbered by its occurrence, so repeats count. All numbered k-mers are hashed once onto a ring;
component b of the fingerprint has a hash function of its own, the distance on the ring from the b-th of evenly spaced
points. It keeps the ``per_bin`` k-mers that are smallest under that function, in the order of the text, and hashes
their tuple: moving text around changes components even where the k-mers stay the same. Every component is filled,
however short the text. The likeness of two fingerprints is the share of equal components.

Defined results: a null or blank text has no k-mer, an all-empty fingerprint, and likeness 1 to another such text and
0 to any other; fewer than k words are one k-mer, and a text with fewer k-mers than ``per_bin`` keeps all of them in
every component; texts of any length cost in proportion to their words, times the logarithm of them for sorting; rows
are independent, so repeated rows give repeated results, and of equal ids the order is that of a hash of the row; an
empty table gives an empty table. Columns other than id and text are left to the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.llm.shared import let, materialize, words

K, BINS, PER_BIN = 4, 64, 2


def numbered_hashes(w: Column, k: int = K) -> Column:
    """Hashes of the occurrence-numbered k-mers of the words w, in text order.

    The first occurrence keeps the k-mer's own hash; later ones are hashed with their number.
    """
    size = F.size(w)
    several = let(
        F.transform(w, lambda x: F.xxhash64(x)),
        lambda h: F.transform(F.sequence(F.lit(1), size - (k - 1)), lambda i: F.xxhash64(F.slice(h, i, k))),
    )
    plain = F.when(size == 0, F.array().cast("array<bigint>")).when(size < k, F.array(F.xxhash64(w))).otherwise(several)

    def number(h: Column) -> Column:
        def runs(s: Column) -> Column:
            last = F.size(s) - 1
            starts = F.filter(F.sequence(F.lit(0), last), lambda j: (j == 0) | (F.get(s, j)["h"] != F.get(s, F.greatest(j - 1, F.lit(0)))["h"]))

            def each(st: Column) -> Column:
                end = lambda r: F.coalesce(F.get(st, r + 1), last + 1)
                one = lambda r: F.transform(
                    F.sequence(F.get(st, r), end(r) - 1),
                    lambda j: F.struct(F.get(s, j)["i"].alias("i"), F.when(j == F.get(st, r), F.get(s, j)["h"]).otherwise(F.xxhash64(F.get(s, j)["h"], j - F.get(st, r))).alias("h")),
                )
                return F.flatten(F.transform(F.sequence(F.lit(0), F.size(st) - 1), one))

            return let(starts, each)

        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.transform(F.sort_array(let(ordered, runs)), lambda p: p["h"])

    return let(plain, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), h).otherwise(number(h)))


#: Low bits of a ring place that hold the place in the text; the others are the hash. All ones mark a component's point.
PLACE = (1 << 30) - 1


def signature(text: Column, k: int = K, bins: int = BINS, per_bin: int = PER_BIN) -> Column:
    """array<int> of length bins; nulls where the text has no k-mer. bins: a power of two."""
    points = F.array(*[F.lit(((b << 64) // bins - (1 << 63)) | PLACE) for b in range(bins)])

    def components(h: Column) -> Column:
        n = F.size(h)
        ring = F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("bigint")))

        def on_ring(r: Column) -> Column:
            """Where the points fall among the sorted k-mers: their places in the joint order, less the points before them."""
            joint = F.sort_array(F.concat(r["k"], points))
            return let(joint, lambda j: F.filter(F.sequence(F.lit(0), F.size(j) - 1), lambda i: F.get(j, i).bitwiseAND(F.lit(PLACE)) == PLACE))

        def component(r: Column, at: Column) -> Column:
            least = F.transform(F.sequence(F.lit(0), F.least(F.lit(per_bin), n) - 1), lambda i: F.get(r["k"], (at + i) % n).bitwiseAND(F.lit(PLACE)))
            return F.shiftright(F.xxhash64(F.transform(F.sort_array(least), lambda p: F.get(h, p.cast("int")))), 32).cast("int")

        return let(F.struct(F.sort_array(ring).alias("k")), lambda r: F.transform(on_ring(r), lambda at, b: component(r, at - b)))

    nothing = F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda _: F.lit(None).cast("int"))
    return let(let(words(text), lambda w: numbered_hashes(w, k)), lambda h: F.when(F.size(h) == 0, nothing).otherwise(components(h)))


def fingerprint(sig: Column) -> Column:
    """A signature as text: eight hexadecimal digits a bin, dashes without k-mers."""
    return F.array_join(F.transform(sig, lambda x: F.coalesce(F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"), F.lit("--------"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Between 0 and 1: equal components among those that either signature fills."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), None).otherwise(F.coalesce(x == y, F.lit(False))))
    return let(pairs, lambda p: F.when(F.size(F.array_compact(p)) == 0, 1.0).otherwise(F.size(F.filter(p, lambda e: e)) / F.size(F.array_compact(p))))


#: Ranges of ids: so many quantiles at most, each cut into so many equal stretches at most.
QUANTILES, STRETCHES, RANGE_ROWS = 256, 256, 2000
LOWEST = -(1 << 63)


def id_ranges(docs: DataFrame, key: Column, tie: Column) -> Column:
    """A number rising with (key, tie) that deals the rows into ranges of about RANGE_ROWS rows, QUANTILES * STRETCHES at most.

    A key that is several quantiles at once has so many rows that they are dealt by their tie.
    """
    at = [i / QUANTILES for i in range(QUANTILES + 1)]
    seen = docs.select(key.alias("k")).agg(F.count("*").alias("n"), F.percentile_approx("k", at, 10_000).alias("q")).first()
    quantiles = seen["q"] or [0]
    cuts = sorted(set(quantiles))
    each = min(STRETCHES, max(1, -(-seen["n"] // (QUANTILES * RANGE_ROWS))))
    own = [min(STRETCHES, each * (quantiles.count(c) - 1)) for c in cuts]  # ranges of the key itself
    widths = [min(max(1, -(-(b - a) // each)), (1 << 63) - 1) for a, b in zip(cuts, [*cuts[1:], cuts[-1] + 1], strict=True)]
    array = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    part = F.greatest(F.size(F.filter(array(cuts), lambda c: c <= key)) - 1, F.lit(0))
    stretch = lambda s: F.floor((key.cast("double") - F.get(array(cuts), s)) / F.get(array(widths), s))
    spread = lambda s: F.floor((tie.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64) * F.get(array(own), s))
    is_cut = lambda s: (F.get(array(own), s) > 0) & (key == F.get(array(cuts), s))
    within = lambda s: F.when(is_cut(s), F.least(spread(s), F.get(array(own), s) - 1)).otherwise(STRETCHES + F.greatest(F.lit(0), F.least(F.lit(each - 1), stretch(s))))
    return let(part, lambda s: (s * 2 * STRETCHES + within(s)).cast("int"))


def by_ranges(docs: DataFrame) -> tuple[DataFrame, Window]:
    """docs (id and other columns) dealt into ranges of ids, and a window in which a row's lead is the next row of the table.

    The first row of each range also goes to the range before (the first of all to the last), as a ghost. Ghosts have
    ``ghost`` 1 and are for the caller to drop. Ties of ids are in the order of a hash of the row.
    """
    keyed = docs.withColumns({"key": F.coalesce(F.col("id").cast("long"), F.lit(LOWEST)), "tie": F.xxhash64(*docs.columns)})
    keyed = keyed.withColumn("range", id_ranges(keyed, F.col("key"), F.col("tie")))
    heads = keyed.groupBy("range").agg(F.min(F.struct("key", "tie")).alias("h"))
    order = Window.orderBy("range")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.col("h.key").alias("key"), F.col("h.tie").alias("tie"), F.coalesce(F.lag("range").over(order), F.last("range").over(whole)).alias("before"))
    heads = materialize(heads, "range-heads")  # 2 * QUANTILES * STRETCHES rows at most: may be broadcast
    places = F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("g")), F.struct(F.col("before").alias("r"), F.lit(1).alias("g")))
    dealt = keyed.join(F.broadcast(heads), ["key", "tie"], "left").withColumn("to", F.explode(F.filter(places, lambda p: p["r"].isNotNull())))
    dealt = dealt.select(*docs.columns, "key", "tie", F.col("to.r").alias("range"), F.col("to.g").alias("ghost")).repartition("range")
    return dealt, Window.partitionBy("range").orderBy("ghost", "key", "tie")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id (under its own name), n_chars, edited_text, its own, the edited and the next document's signature."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    dealt, window = by_ranges(slim)
    signed = dealt.withColumn("sig", signature(F.col("text")))
    both = signed.withColumns({"next_text": F.lead("text").over(window), "next_sig": F.lead("sig").over(window)}).where("ghost = 0")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    out = both.select(F.col("id").alias(id_col), F.length("text").cast("long").alias("n_chars"), edited.alias("edited_text"), "sig", "next_sig")
    return out.withColumn("edited_sig", signature(F.col("edited_text")))
