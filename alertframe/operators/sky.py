"""Cone searches and joins by zones of declination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import separation_arcsec


def cone(points: DataFrame, ra: float, dec: float, radius_arcsec: float, limit: int | None = 50) -> DataFrame:
    """Points within the radius with sep_arcsec, nearest first. The declination band reaches the scan as a filter."""
    r = radius_arcsec / 3600.0
    near = points.filter(F.col("ra").isNotNull() & F.col("dec").between(dec - r, dec + r))
    near = near.withColumn("sep_arcsec", separation_arcsec(F.lit(ra), F.lit(dec), F.col("ra"), F.col("dec"))).filter(F.col("sep_arcsec") <= radius_arcsec)
    return near.orderBy("sep_arcsec").limit(limit) if limit else near


def _zone(dec: Column, size: float) -> Column:
    return F.floor(dec / size).cast("long")


def cone_join(a: DataFrame, b: DataFrame, radius_arcsec: float, zone_deg: float | None = None) -> DataFrame:
    """All pairs of rows of a (ra, dec) and b (ra2, dec2) within the radius, with sep_arcsec.

    An equi-join on zones at least as high as the radius: each row of b goes to its own zone and its neighbours. Right
    ascension cells within a zone keep crowded zones apart; their width grows towards the poles, where one is all.
    """
    size = max(zone_deg or 0.0, radius_arcsec / 3600.0, 1e-6)
    cell = min(10.0, max(size, 1.0))
    reach = F.lit(radius_arcsec / 3600.0) / F.greatest(F.cos(F.radians(F.least(F.abs(F.col("dec2")) + 2 * size, F.lit(90.0)))), F.lit(1e-9))
    wide = F.least(reach, F.lit(180.0))
    n = int(360 / cell)
    cell = 360 / n
    left = a.filter("ra is not null and dec is not null").withColumns({"_z": _zone(F.col("dec"), size), "_c": F.pmod(F.floor(F.col("ra") / cell).cast("long"), F.lit(n))})
    cells = F.array_distinct(F.transform(F.sequence(F.floor((F.col("ra2") - wide) / cell).cast("long"), F.floor((F.col("ra2") + wide) / cell).cast("long")), lambda x: F.pmod(x, F.lit(n))))
    zones = F.sequence(_zone(F.col("dec2"), size) - 1, _zone(F.col("dec2"), size) + 1)
    right = b.filter("ra2 is not null and dec2 is not null").withColumn("_z", F.explode(zones)).withColumn("_c", F.explode(cells))
    pairs = left.join(right, ["_z", "_c"]).drop("_z", "_c")
    return pairs.withColumn("sep_arcsec", separation_arcsec(F.col("ra"), F.col("dec"), F.col("ra2"), F.col("dec2"))).filter(F.col("sep_arcsec") <= radius_arcsec)
