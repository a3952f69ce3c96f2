"""Numbers: distances between names and places, normalising, softmax, vectors."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: Mean radius of the earth in km.
EARTH_KM = 6371.0088


def name_distances(query: Column, names: Column) -> Column:
    """Edit distances from query to each name."""
    return F.transform(names, lambda n: F.levenshtein(query, n))


def array_mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x), F.size(values))


def min_max(x: Column, group: WindowSpec) -> Column:
    """(x - least) / largest within a group (the largest itself, not the range); a largest of 0 counts as 0.001."""
    high = F.max(x).over(group)
    return (x - F.min(x).over(group)) / F.when(high == 0, F.lit(0.001)).otherwise(high)


def softmax(x: Column, group: WindowSpec) -> Column:
    e = F.exp(x - F.max(x).over(group))
    return e / F.sum(e).over(group)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column, least: float = 1e-8) -> Column:
    """Cosine of two arrays; lengths under `least` count as that."""
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(least))


def coordinates(lat: Column, lon: Column) -> Column:
    return F.concat_ws(",", lat.cast("string"), lon.cast("string"))
