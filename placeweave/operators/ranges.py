"""Running sums and pages over ranges of an ordered column, so that neither needs one task for one key or a global sort.

Boundaries are approximate quantiles of the column; they decide how even the ranges are, and no result. A few of them
come to the driver, as do counts of rows by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges, unless the caller says how many.
RANGES = 64


def deal(rows: DataFrame, key: str | Column) -> DataFrame:
    """rows dealt evenly by key, for work that costs far more than moving them; a small file would be a single task."""
    session = rows.sparkSession
    n = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return rows.repartition(n, key)


def boundaries(rows: DataFrame, order: str, n: int = RANGES) -> list:
    """Up to n - 1 rising values that cut rows into ranges of about one size."""
    found = rows.agg(F.percentile_approx(order, [k / n for k in range(1, n)], F.lit(10_000)).alias("b")).first()["b"]
    return sorted(set(found or []))


def range_number(value: Column, bounds: list) -> Column:
    """How many boundaries value has reached; 0 for null."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= value)) if bounds else F.lit(0)


def sum_before(rows: DataFrame, keys: list[str], order: str, value: Column, n: int = RANGES) -> DataFrame:
    """Adds before: the sum of value over the rows of the same keys with a smaller order; 0 for the first.

    Sums within a key's ranges, then over the ranges before: one key with very many rows is as many tasks as ranges.
    value should be of a decimal or whole type, so that the order of addition does not matter.
    """
    cut = rows.withColumns({"_range": range_number(F.col(order), boundaries(rows, order, n)), "_value": value})
    here = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum")).withColumn("_offset", F.sum("_sum").over(earlier)).drop("_sum")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "_range")]
    both = cut.withColumn("_here", F.sum("_value").over(here)).alias("a").join(sums.alias("b"), same)
    nothing = F.lit(0)
    return both.select(*[f"a.{c}" for c in rows.columns], (F.coalesce("_here", nothing) + F.coalesce("_offset", nothing)).alias("before"))


def page_rows(rows: DataFrame, offset: int, size: int, sort_by: str, id_col: str, descending: bool = True, n: int = RANGES) -> tuple[DataFrame, int]:
    """The rows from offset on, size of them, by sort_by (nulls last) and then id, and how many rows there are.

    Rows are counted by range; only the ranges that the page touches are sorted, however far down it lies.
    """
    bounds = boundaries(rows, sort_by, n)
    place = F.when(F.col(sort_by).isNull(), -1).otherwise(range_number(F.col(sort_by), bounds))
    cut = rows.withColumn("_range", place)
    counts = {r["_range"]: r["held"] for r in cut.groupBy("_range").agg(F.count("*").alias("held")).collect()}  # a row a range
    before, touched, skipped = 0, [], 0
    for k in sorted(counts, key=lambda k: (k == -1, -k if descending else k)):
        if before + counts[k] <= offset:
            skipped = before + counts[k]
        elif before < offset + size:
            touched.append(k)
        before += counts[k]
    key = F.desc_nulls_last(sort_by) if descending else F.asc_nulls_last(sort_by)
    return cut.where(F.col("_range").isin(touched)).drop("_range").orderBy(key, id_col).offset(max(0, offset - skipped)).limit(size), before
