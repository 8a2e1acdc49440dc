"""Points around many centres, and the farthest two of many points, by cells instead of all pairs."""

from __future__ import annotations

from math import degrees

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.functions.geo import EARTH_M, haversine
from placeweave.operators.ranges import deal

#: A little more than needed, so that rounding never loses a point at the edge.
_SLACK = 1.000001
#: Rows of one place that meet others as one.
BLOCK = 1024
#: Cells along each side of a cell of the level above, and levels.
SIDE_BITS, LEVELS = 3, 3


def _band(lat: Column, height: float) -> Column:
    return F.floor((lat + 90.0) / height)


def _cells_in(band: Column, height: float) -> Column:
    """Cells around the globe in a band: no cell is narrower than the band is high."""
    edge = lambda b: F.abs(b * height - 90.0)
    widest = F.cos(F.radians(F.least(F.greatest(edge(band), edge(band + 1)), F.lit(90.0))))
    return F.greatest(F.lit(1), F.floor(widest * (360.0 / height))).cast("long")


def within_radius(centres: DataFrame, points: DataFrame, radius_m: float) -> DataFrame:
    """Every pair of a centre (centre_id, centre_lat, centre_lng) and a point (lat, lng, ...) at most radius_m apart, with distance_m.

    Points lie in one cell of a band of latitudes as high as the radius. A centre covers the cells of three bands that its
    circle may touch, across the date line and around the poles; the two meet by an equi-join on the cell. Only different
    places meet, so distances are computed once for all centres and points that share them. Pairs are far more than what they
    are made of, so blocks of the centres and of the points of two places meet, are dealt to all tasks and fan out last.
    """
    centres = centres.select("centre_id", "centre_lat", "centre_lng").where("centre_lat is not null and centre_lng is not null")
    points = points.where("lat is not null and lng is not null")
    around = _places_within(centres.select("centre_lat", "centre_lng").distinct(), points.select("lat", "lng").distinct(), radius_m)
    # Their files say little about the size of tables with few different values, so these joins are told to shuffle.
    met = around.join(_blocks(centres, ["centre_lat", "centre_lng"], "_centres").hint("merge"), ["centre_lat", "centre_lng"])
    met = deal(met.join(_blocks(points, ["lat", "lng"], "_points").hint("merge"), ["lat", "lng"]), F.xxhash64("centre_lat", "centre_lng", "lat", "lng", "_centres_block", "_points_block"))
    known = ["lat", "lng", "centre_lat", "centre_lng"]
    one = met.select(*known, "distance_m", "_points", F.explode("_centres").alias("_centre"))
    both = one.select(*known, "_centre.centre_id", "distance_m", F.explode("_points").alias("_point"))
    return both.select(*known, "centre_id", "distance_m", *[F.col("_point").getField(c).alias(c) for c in points.columns if c not in known])


def _blocks(rows: DataFrame, place: list[str], name: str) -> DataFrame:
    """place, a block's number and, as name, a list of the other columns of up to BLOCK rows of one place.

    Rows are cut into ranges of places, and of rows of one place, and numbered there; a block lies within BLOCK rows in order.
    """
    held = [c for c in rows.columns if c not in place]
    order = [*place, "_tie"]
    dealt = rows.withColumn("_tie", F.xxhash64(F.to_json(F.struct(*rows.columns)))).repartitionByRange(*order).sortWithinPartitions(*order)
    block = F.floor(F.monotonically_increasing_id() / BLOCK).alias(f"{name}_block")
    return dealt.select(*place, block, F.struct(*held).alias(name)).groupBy(*place, f"{name}_block").agg(F.collect_list(name).alias(name))


def _places_within(centres: DataFrame, points: DataFrame, radius_m: float) -> DataFrame:
    """Every pair of different places, centre_lat, centre_lng and lat, lng, at most radius_m apart, with distance_m."""
    height = max(degrees(radius_m / EARTH_M) * _SLACK, 1e-6)
    p = points.where("lat is not null and lng is not null").withColumn("_band", _band(F.col("lat"), height))
    n = _cells_in(F.col("_band"), height)
    p = p.withColumn("_cell", F.pmod(F.floor((F.col("lng") + 180.0) / 360.0 * n), n))
    lat, lng = F.col("centre_lat"), F.col("centre_lng")
    c = centres.where("centre_lat is not null and centre_lng is not null").select("centre_lat", "centre_lng")
    c = c.withColumn("_band", F.explode(F.sequence(_band(lat, height) - 1, _band(lat, height) + 1)))
    half = F.when(F.abs(lat) + height >= 90.0, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(height))) / F.cos(F.radians(lat))))) * _SLACK)
    first, last = F.floor((lng - half + 180.0) / 360.0 * n), F.floor((lng + half + 180.0) / 360.0 * n)
    c = c.withColumn("_cell", F.explode(F.transform(F.sequence(first, F.least(last, first + n - 1)), lambda k: F.pmod(k, n))))
    met = c.join(p, ["_band", "_cell"]).withColumn("distance_m", haversine(lat, lng, F.col("lat"), F.col("lng")))
    return met.where(F.col("distance_m") <= radius_m).drop("_band", "_cell")


def farthest(points: DataFrame, key: str) -> DataFrame:
    """key and far_m: the largest distance between two points (lat, lng) of one key; 0 for a single point.

    Each key's box is cut into cells, finer level by level. A cell has one of its points and the distance to its farthest
    other point; two cells' points are at most the distance of their own points and both radii apart. Pairs of cells
    that cannot reach the largest distance known so far drop out, so only points of the last few cells are compared.
    """
    bits = SIDE_BITS * LEVELS
    boxes = points.groupBy(key).agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lng") for n, f in (("low", F.min), ("high", F.max))])
    at = lambda c: F.when(F.col(f"high_{c}") > F.col(f"low_{c}"), F.least(F.floor((F.col(c) - F.col(f"low_{c}")) / (F.col(f"high_{c}") - F.col(f"low_{c}")) * (1 << bits)), F.lit((1 << bits) - 1))).otherwise(0).cast("int")
    placed = points.select(key, "lat", "lng").join(boxes, key).select(key, "lat", "lng", at("lat").alias("x"), at("lng").alias("y"))
    pairs = None
    for level in range(1, LEVELS + 1):
        shift = SIDE_BITS * (LEVELS - level)
        cell = F.struct(F.shiftright("x", shift).alias("x"), F.shiftright("y", shift).alias("y"))
        inside = placed.select(key, "lat", "lng", cell.alias("cell"))
        own = inside.groupBy(key, "cell").agg(F.min(F.struct("lat", "lng")).alias("p"))
        wide = inside.join(own, [key, "cell"]).groupBy(key, "cell").agg(F.first("p").alias("p"), F.max(haversine(F.col("p.lat"), F.col("p.lng"), F.col("lat"), F.col("lng"))).alias("r"))
        up = F.struct(F.shiftright("cell.x", SIDE_BITS).alias("x"), F.shiftright("cell.y", SIDE_BITS).alias("y"))
        side = lambda s: wide.select(key, F.col("cell").alias(s), F.col("p").alias(f"p{s}"), F.col("r").alias(f"r{s}"), up.alias(f"up{s}"))  # noqa: B023, E731
        if pairs is None:
            met = side("a").drop("upa").join(side("b").drop("upb"), key).withColumn("known", F.lit(0.0))
        else:
            parents = pairs.select(key, F.col("a").alias("upa"), F.col("b").alias("upb"), "known")
            met = parents.join(side("a"), [key, "upa"]).join(side("b"), [key, "upb"]).drop("upa", "upb")
        met = met.where(F.col("a") <= F.col("b")) if level == 1 else met
        met = met.withColumn("d", haversine(F.col("pa.lat"), F.col("pa.lng"), F.col("pb.lat"), F.col("pb.lng")))
        # A key's pairs are bounded by its cells, so they may meet.
        met = met.withColumn("best", F.max(F.greatest("d", "known")).over(Window.partitionBy(key))).where(F.col("d") + F.col("ra") + F.col("rb") + 0.001 >= F.col("best"))
        pairs = met.select(key, "a", "b", F.col("best").alias("known"))
    last = placed.select(key, "lat", "lng", F.struct("x", "y").alias("cell"))
    one = last.select(key, F.col("cell").alias("a"), F.col("lat").alias("lat1"), F.col("lng").alias("lng1"))
    two = last.select(key, F.col("cell").alias("b"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    far = pairs.join(one, [key, "a"]).join(two, [key, "b"])
    return far.groupBy(key).agg(F.max(haversine(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"))).alias("far_m"))
