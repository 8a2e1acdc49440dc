"""Distances on the sphere, bands around a centre, and known city centres."""

from __future__ import annotations

from math import cos, degrees, radians

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
BUFFER_M = 500.0

# Centres of the cities known by label (lower case).
CITY_CENTRES = {
    "cabo frio rj": (-22.8806, -42.0187),
    "cabo frio": (-22.8806, -42.0187),
    "sao pedro da aldeia rj": (-22.8386, -42.0991),
    "são pedro da aldeia rj": (-22.8386, -42.0991),
    "sao pedro da aldeia": (-22.8386, -42.0991),
    "iguaba grande rj": (-22.8389, -42.2276),
    "iguaba grande": (-22.8389, -42.2276),
    "richmond uk": (51.4613, -0.3037),
    "richmond": (51.4613, -0.3037),
}
# Score of a distance below each limit, in metres.
DISTANCE_SCORES = [(100.0, 1.0), (500.0, 0.85), (1000.0, 0.7), (2000.0, 0.5), (5000.0, 0.3)]


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres between two points, to the micrometre so that limits compare alike everywhere."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2.0), F.lit(2.0))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    return F.round(2.0 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1.0 - a)), 6)


def band(distance: Column, radius: Column) -> Column:
    """inside_radius up to the radius, buffer_zone up to 500 m more, else outside_region."""
    return F.when(distance <= radius, "inside_radius").when(distance <= radius + BUFFER_M, "buffer_zone").otherwise("outside_region")


def distance_score(distance: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for limit, score in DISTANCE_SCORES:
        out = out.when(distance < limit, score)
    return F.when(distance.isNull(), None).otherwise(out.otherwise(0.0))


def city_centre(label: Column, fold_accents: bool = False) -> Column:
    """struct<lat, lng> of a known label, else null. Labels keep their accents unless fold_accents is set."""
    from placeweave.functions.text import fold, trim

    key = trim(fold(label) if fold_accents else F.lower(label))
    known = F.create_map(*[x for k, (a, b) in CITY_CENTRES.items() for x in (F.lit(k), F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lng")))])
    return F.element_at(known, key)


def bounding_box(lat: float, lng: float, radius_m: float) -> tuple[float, float, float, float]:
    """South, north, west, east of a box that holds the circle."""
    d = degrees(radius_m / EARTH_M)
    e = d / cos(radians(lat))
    return lat - d, lat + d, lng - e, lng + e


def usable_coordinates(lat: Column, lng: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & (x != 0.0)
    return F.coalesce(finite(lat) & finite(lng), F.lit(False))
