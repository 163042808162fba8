"""Radius joins of places by grid cells: an equi-join on cells with the exact distance as residual.

The grid has bands of latitude as high as the radius and, in each band, cells of longitude at least as wide as the
radius anywhere in the band and its neighbours. The right side is sent to the cells around its own, so every pair within
the radius meets in exactly one cell: the left side's. Cells wrap at the date line; a band at a pole is one cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions.geo import EARTH_M, haversine


def _band(lat: Column, height: float) -> Column:
    return F.floor((lat + 90) / F.lit(height)).cast("bigint")


def _cells_in(band: Column, height: float) -> Column:
    """Number of longitude cells of a band, from the narrowest parallel within it and the next bands."""
    edge = F.greatest(F.abs((band - 1) * F.lit(height) - 90), F.abs((band + 2) * F.lit(height) - 90))
    width = F.lit(height) / F.cos(F.radians(F.least(edge, F.lit(90.0))))
    return F.when(edge >= 89.9, F.lit(1)).otherwise(F.greatest(F.floor(F.lit(360.0) / width), F.lit(1))).cast("bigint")


def _column(lon: Column, cells: Column) -> Column:
    return F.least(F.floor((lon + 180) / 360 * cells), cells - 1).cast("bigint")


def radius_join(left: DataFrame, right: DataFrame, radius_m: float, *, left_at=("l_lon", "l_lat"), right_at=("r_lon", "r_lat")) -> DataFrame:
    """Pairs of a left and a right row no farther apart than radius_m, with their distance; column names must differ."""
    height = math.degrees(radius_m / EARTH_M) * 1.000001
    (l_lon, l_lat), (r_lon, r_lat) = left_at, right_at
    cells = left.withColumn("_b", _band(F.col(l_lat), height)).withColumn("_n", _cells_in(F.col("_b"), height))
    cells = cells.withColumn("_c", _column(F.col(l_lon), F.col("_n"))).drop("_n")
    around = right.withColumn("_b0", _band(F.col(r_lat), height)).withColumn("_b", F.explode(F.array(F.col("_b0") - 1, F.col("_b0"), F.col("_b0") + 1)))
    around = around.withColumn("_n", _cells_in(F.col("_b"), height)).withColumn("_c0", _column(F.col(r_lon), F.col("_n")))
    near = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.pmod(F.col("_c0") + i, F.col("_n"))))
    around = around.withColumn("_c", F.explode(near)).drop("_b0", "_c0", "_n")
    pairs = cells.join(around, ["_b", "_c"]).drop("_b", "_c").withColumn("distance_m", haversine(l_lon, l_lat, r_lon, r_lat))
    return pairs.filter(F.col("distance_m") <= radius_m)


def nearest(left: DataFrame, right: DataFrame, radius_m: float, *, left_id: str, right_id: str, **at) -> DataFrame:
    """The nearest right row within the radius of each left row; of equally near ones the one with the smaller id."""
    pairs = radius_join(left, right, radius_m, **at)
    best = F.min(F.struct("distance_m", right_id)).alias("best")
    return pairs.groupBy(left_id).agg(best).select(left_id, f"best.{right_id}", "best.distance_m")
