"""Distances, weighted sums, vectors, bounded whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: mean radius of the earth in miles.
EARTH_RADIUS_MILES = 3958.7613


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, null where a coordinate is; rounding errors beyond the antipode are clipped."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_MILES * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def weighted_sum(values: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum of weight times value, each term and the sum rounded to six places; the weights must cover the values and add to one."""
    if set(values) != set(weights) or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must name every component and add to one")
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.round(values[name] * F.lit(weight), 6)
    return F.round(total, 6)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column, floor: float = 1e-8) -> Column:
    return F.greatest(F.sqrt(dot(a, a)), F.lit(floor))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def distinctiveness(count: Column) -> Column:
    """1 / (1 + n); 0 where n is unknown."""
    return F.when(count.isNull(), 0.0).otherwise(1.0 / (1.0 + F.greatest(count, F.lit(0))))


def micros_to_units(value: Column) -> Column:
    return F.round(value / 1e6, 6)


def bounded_int(value: Column, low: int, high: int) -> Column:
    """The first whole number in a text, null unless it lies in the bounds."""
    n = F.regexp_extract(value, r"(-?\d+)", 1).try_cast("int")
    return F.when(n.between(low, high), n)
