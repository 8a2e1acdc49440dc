"""Geographic gate: distance of each place to its region's centre, and what follows for its decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions.geo import band, haversine
from placeweave.functions.numbers import round_up


# What a reason gains when the gate overrules it, around the distance and the radius.
NOTE = (" | geographic_buffer_zone: resultado a ", "m do centro da região (raio configurado: ", "m) — forçado para revisão, nunca ACCEPTED automático na margem (ADR-0022)")


def _plain(x: Column) -> Column:
    return x.cast("long").cast("string")


def classify_distance(venues: DataFrame, regions: DataFrame) -> DataFrame:
    """Adds region_key, radius_m, distance_m and geographic_status by equal region label.

    regions: region_key, label, center_lat, center_lng, radius_m (a small table; Spark decides how to join it). A
    place without a known region is inside, at distance 0. No row is dropped.
    """
    r = regions.select(F.col("label").alias("source_region_label"), "region_key", "center_lat", "center_lng", "radius_m")
    joined = venues.join(r, "source_region_label", "left")
    known = F.col("region_key").isNotNull()
    distance = F.when(known, haversine(F.col("center_lat"), F.col("center_lng"), F.col("lat"), F.col("lng"))).otherwise(0.0)
    status = F.when(known, band(F.col("distance_m"), F.col("radius_m"))).otherwise("inside_radius")
    return joined.withColumn("distance_m", distance).withColumn("geographic_status", status).drop("center_lat", "center_lng")


def apply_gate(classified: DataFrame) -> DataFrame:
    """Accepted places in the buffer zone go to review; all others keep their decision."""
    flip = (F.col("geographic_status") == "buffer_zone") & (F.col("decision") == "accepted")
    note = F.concat(F.col("reasoning"), F.lit(NOTE[0]), _plain(round_up(F.col("distance_m"))), F.lit(NOTE[1]), _plain(F.coalesce("radius_m", F.lit(0.0))), F.lit(NOTE[2]))
    return classified.withColumns({
        "reasoning": F.when(flip, note).otherwise(F.col("reasoning")),
        "decisive_layer": F.when(flip, "review").otherwise(F.col("decisive_layer")),
        "decision": F.when(flip, "needs_review").otherwise(F.col("decision")),
    })
