"""Stable identifiers."""

from __future__ import annotations

from uuid import UUID

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the namespace of published activities.
ACTIVITY_NAMESPACE = "72f123d8-74ac-55c2-9aa9-fe397133f4e9"


def uuid5(name: Column, namespace: str = ACTIVITY_NAMESPACE) -> Column:
    """The version-5 UUID of a name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(UUID(namespace).hex)), F.encode(name, "UTF-8")))
    # The first digit of the fourth group keeps its low two bits and gets the variant's high bits.
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))
