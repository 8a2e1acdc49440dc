"""Landed items as a file stream. An extension: the batch transforms above are what the streams call.

Late rows are bounded by a watermark; state is one key per item, or one window per source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files in a folder, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def first_seen_items(items: DataFrame, at: str = "collected_at", delay: str = "2 days") -> DataFrame:
    """Items without the repeats of a key that arrive within the delay."""
    return items.withWatermark(at, delay).dropDuplicatesWithinWatermark(["source_key", "source_item_id"])


def daily_quality(items: DataFrame, at: str = "collected_at", delay: str = "1 day") -> DataFrame:
    """Items and dated items per source and day."""
    per_day = items.withWatermark(at, delay).groupBy(F.window(at, "1 day"), "source_key")
    return per_day.agg(F.count("*").alias("total"), F.count_if(F.col("n_occurrences") > 0).alias("with_date"))


def run_batches(items: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Call a batch transform on everything that has landed, once; a rerun goes on where this one stopped."""
    stream = items.writeStream.foreachBatch(lambda df, _: apply(df)).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start()
