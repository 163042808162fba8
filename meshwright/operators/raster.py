"""Rasters as tables of cells (ix, iy, z); all work is equi-joins on cells or tiles of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODATA = -32768.0


def cell_of(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """Nearest cell of a point, rounding half to even."""
    return F.bround(x / F.lit(size), 0).cast("bigint"), F.bround(y / F.lit(size), 0).cast("bigint")


def rasterize(points: DataFrame, size: float, how=F.max) -> DataFrame:
    """Cells from points (zone, x, y, z)."""
    ix, iy = cell_of(F.col("x"), F.col("y"), size)
    return points.filter("z is not null").groupBy("zone", ix.alias("ix"), iy.alias("iy")).agg(how("z").alias("z"))


def combine(a: DataFrame, b: DataFrame, minus: bool = False) -> DataFrame:
    """Cell-wise sum or difference; a cell that one side lacks or has no data for has none."""
    z = F.when((F.col("a.z") != NODATA) & (F.col("b.z") != NODATA), F.col("a.z") - F.col("b.z") if minus else F.col("a.z") + F.col("b.z")).otherwise(F.lit(NODATA))
    return a.alias("a").join(b.alias("b"), ["zone", "ix", "iy"]).select("zone", "ix", "iy", z.alias("z"))


def within(cells: DataFrame, x0: float, y0: float, x1: float, y1: float, size: float) -> DataFrame:
    """Cells whose centres lie within bounds."""
    return cells.filter((F.col("ix") * F.lit(size)).between(x0, x1) & (F.col("iy") * F.lit(size)).between(y0, y1))


def refine(cells: DataFrame, factor: int) -> DataFrame:
    """Nearest-neighbour resampling to cells `factor` times as fine."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    fine = cells.select("zone", "ix", "iy", "z", F.explode(steps).alias("i")).select("zone", "ix", "iy", "z", "i", F.explode(steps).alias("j"))
    return fine.select("zone", (F.col("ix") * factor + F.col("i")).alias("ix"), (F.col("iy") * factor + F.col("j")).alias("iy"), "z")


def thin(cells: DataFrame, step: int) -> DataFrame:
    """Every step-th cell with data: a coarser raster by nearest neighbour."""
    return cells.filter((F.pmod(F.col("ix"), F.lit(step)) == 0) & (F.pmod(F.col("iy"), F.lit(step)) == 0) & (F.col("z") != NODATA))


def fill_nodata(cells: DataFrame, reach: int) -> DataFrame:
    """Cells without data take the value of the nearest cell with data within reach, else the average of all."""
    missing, known = cells.filter(F.col("z") == NODATA), cells.filter(F.col("z") != NODATA)
    filled = nearest_value(missing.select("zone", "ix", "iy"), known, reach)
    return known.select("zone", "ix", "iy", "z").unionAll(filled.select("zone", "ix", "iy", "z"))


def nearest_value(at: DataFrame, known: DataFrame, reach: int) -> DataFrame:
    """For each cell (zone, ix, iy) the value of the nearest known cell within reach, by tiles as wide as the reach; else the average."""
    tile = lambda c: F.floor(F.col(c) / F.lit(reach))
    offsets = F.array(F.lit(-1), F.lit(0), F.lit(1))
    asks = at.distinct().withColumns({"tx": tile("ix"), "ty": tile("iy")})
    spread = known.select("zone", F.col("ix").alias("kx"), F.col("iy").alias("ky"), "z").withColumns({"ax": F.floor(F.col("kx") / reach), "ay": F.floor(F.col("ky") / reach)})
    spread = spread.withColumn("dx", F.explode(offsets)).withColumn("dy", F.explode(offsets))
    spread = spread.select("zone", (F.col("ax") + F.col("dx")).alias("tx"), (F.col("ay") + F.col("dy")).alias("ty"), "kx", "ky", "z")
    far = (F.col("ix") - F.col("kx")) * (F.col("ix") - F.col("kx")) + (F.col("iy") - F.col("ky")) * (F.col("iy") - F.col("ky"))
    pairs = asks.join(spread, ["zone", "tx", "ty"]).withColumn("far", far).filter(F.col("far") <= reach * reach)
    best = pairs.groupBy("zone", "ix", "iy").agg(F.min(F.struct("far", "kx", "ky", "z")).alias("best")).select("zone", "ix", "iy", F.col("best.z").alias("near"))
    average = known.agg(F.avg("z").alias("average"))  # one row
    out = asks.select("zone", "ix", "iy").join(best, ["zone", "ix", "iy"], "left").crossJoin(F.broadcast(average))
    return out.select("zone", "ix", "iy", F.coalesce("near", "average").alias("z"))


def sample(points: DataFrame, cells: DataFrame, size: float, reach: int) -> DataFrame:
    """Value at each point (id, zone, x, y): of its cell, else of the nearest with data."""
    ix, iy = cell_of(F.col("x"), F.col("y"), size)
    at = points.select("id", "zone", ix.alias("ix"), iy.alias("iy"))
    known = cells.filter(F.col("z") != NODATA)
    direct = at.join(known, ["zone", "ix", "iy"], "left")
    miss = direct.filter("z is null").select("zone", "ix", "iy")
    found = nearest_value(miss, known, reach).withColumnRenamed("z", "z2")
    return direct.join(found, ["zone", "ix", "iy"], "left").select("id", F.coalesce("z", "z2").alias("z"))
