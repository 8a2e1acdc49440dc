"""Shards that all match the corpus mixture: proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; a row's fractional rank is its place in its source
between 0 and 1. In the order of fractional ranks every stretch holds the sources in their overall proportions, so
that order is cut into equal counts. Both orders are range sorts over all tasks; a place is the place within the task
and the counts of the tasks before. Only such counts, one for each task and source in it, meet in one window.

Defined results: the law is ``rows`` (counts of shards differ by one at most); null sources form one source, apart
from the empty name; rows with one id, or none, are in the order of a hash of the row; a null text has size 1; texts
of any length pass through; repeated rows are placed one by one; an empty table gives an empty table; fewer rows than
shards leave some shards empty. Other columns pass through under any names; those called shard and slot are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.llm.shared import materialize, numbered, packed, row_hash, unpacked


def shuffle_key(seed: int, *parts: Column) -> Column:
    """A hexadecimal digest, evenly spread; its order is a seeded shuffle."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def interleave(df: DataFrame, id_col: str, source_col: str, seed: int = 17) -> tuple[DataFrame, int]:
    """row (df's columns as one) and place (0-based, gapless, in the order of fractional ranks); also the number of rows."""
    row, source = packed(df), F.coalesce(F.concat(F.lit("-"), F.col(f"`{source_col}`").cast("string")), F.lit(""))
    keyed = df.select(row.alias("row"), source.alias("s"), shuffle_key(seed, F.col(f"`{id_col}`")).alias("h"), row_hash(df).alias("tie"))
    # Equal rows are interchangeable; their number tells them apart.
    ranked = numbered(materialize(keyed.withColumn("seq", F.monotonically_increasing_id()), "shard-keys"), "s", "h", "tie", "seq")
    sums = materialize(ranked.groupBy("s", "task").agg(F.count("*").alias("held"), F.min("at").alias("first")), "shard-counts")
    earlier = Window.partitionBy("s").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"before": F.coalesce(F.sum("held").over(earlier), F.lit(0)), "of": F.sum("held").over(Window.partitionBy("s"))}).drop("held")
    rank = F.col("before") + F.col("at") - F.col("first") + 1
    ranked = ranked.join(sums, ["s", "task"]).select("row", "s", "h", "tie", "seq", ((2 * rank - 1) / (2 * F.col("of"))).alias("f"))
    placed = numbered(ranked, "f", "s", "h", "tie", "seq")
    tasks = materialize(placed.groupBy("task").agg(F.count("*").alias("held")), "shard-places")  # one row for each task
    starts = tasks.select("task", F.coalesce(F.sum("held").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    n = tasks.agg(F.sum("held")).first()[0] or 0  # one number
    return placed.join(F.broadcast(starts), "task").select("row", (F.col("start") + F.col("at")).cast("long").alias("place")), n


def assign_shards(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", n_shards: int = 16, seed: int = 17) -> DataFrame:
    """Adds shard (0..n_shards-1) and slot (gapless from 0 within the shard)."""
    placed, n = interleave(df, id_col, source_col, seed)
    shard = F.floor(F.col("place") * F.lit(n_shards) / F.lit(max(n, 1)).cast("decimal(20,0)")).cast("int")
    placed = placed.withColumn("shard", shard)
    start = F.ceil(F.col("shard") * F.lit(n).cast("decimal(20,0)") / F.lit(n_shards)).cast("long")
    return placed.select(*unpacked(F.col("row"), df.columns, ("shard", "slot")), "shard", (F.col("place") - start).alias("slot"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", source_col: str = "source", n_shards: int = 16, seed: int = 17) -> None:
    """Write docs as one folder per shard (shard=0, ...), rows in slot order within each file."""
    placed = assign_shards(docs, id_col, source_col, n_shards, seed)
    # Ranges of slots, so the number of files of a shard follows its size.
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
