"""Rounding and rates with defined results at the edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_up(x: Column, digits: int = 0) -> Column:
    """Rounded to digits, halves towards plus infinity."""
    scale = float(10**digits)
    return F.floor(x.cast("double") * scale + 0.5).cast("double") / scale


def rate(count: Column, total: Column) -> Column:
    """Percentage with one decimal; null for a total of zero."""
    return F.when(total != 0, F.floor(count / F.nullif(total, F.lit(0)).cast("double") * 1000.0 + 0.5).cast("double") / 10.0)
