"""JSON snapshots of classified places, and where registered queries write them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SNAPSHOT = (
    "place_id long, name string, lat double, lng double, category string, google_types array<string>, decision string, reasoning string, "
    "distance_meters long, geographic_bucket string"
)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that the cluster names in spark.checkpoint.dir, removed when the session ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="placeweave-")
    path = f"{folder}/placeweave/{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def write_snapshot(classified: DataFrame, path: str) -> None:
    """Ten fields a place, as JSON lines; distances in whole metres."""
    metres = F.floor(F.col("distance_m") + 0.5).cast("long")
    fields = ["place_id", "name", "lat", "lng", "category", "google_types", "decision", "reasoning"]
    classified.select(*fields, metres.alias("distance_meters"), F.col("geographic_status").alias("geographic_bucket")).write.json(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).json(path)


def positions(rows: DataFrame, first: Column, second: Column, by: Column) -> DataFrame:
    """Adds position, from 1, in the order of first and second; by cuts that order, descending, into groups that fit a task."""
    dealt = rows.withColumn("group", by)
    sizes = dealt.groupBy("group").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.desc("group")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each group
    starts = sizes.select("group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("group").orderBy(first, second))
    return dealt.withColumn("inside", inside).join(starts, "group").select(*rows.columns, (F.col("start") + F.col("inside")).alias("position"))
