"""Line of sight between pairs of places over raster cells.

Pairs meet the cells near them by tiles: a pair is sent to the tiles its corridor's box covers, which are few since
pairs are no longer than the greatest link length; the exact geometry decides what is left, and the minimum per pair is
combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE_M = 250.0


def corridor(pairs: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """Pairs (pair_id, zone, x1, y1, z1, x2, y2, z2, radius) with each cell centre (cx, cy, cz) in their rectangle of width 2 * radius."""
    tile = lambda v: F.floor(v / F.lit(TILE_M))
    low, high = (lambda a: F.least(f"{a}1", f"{a}2") - F.col("radius")), (lambda a: F.greatest(f"{a}1", f"{a}2") + F.col("radius"))
    sent = pairs.withColumn("tx", F.explode(F.sequence(tile(low("x")), tile(high("x"))))).withColumn("ty", F.explode(F.sequence(tile(low("y")), tile(high("y")))))
    centres = cells.select("zone", (F.col("ix") * F.lit(size)).alias("cx"), (F.col("iy") * F.lit(size)).alias("cy"), F.col("z").alias("cz"))
    centres = centres.withColumns({"tx": tile(F.col("cx")), "ty": tile(F.col("cy"))})
    joined = sent.join(centres, ["zone", "tx", "ty"]).drop("tx", "ty")
    joined = joined.withColumns({"bx": F.col("x2") - F.col("x1"), "by": F.col("y2") - F.col("y1"), "dx": F.col("cx") - F.col("x1"), "dy": F.col("cy") - F.col("y1")})
    along, across = F.col("dx") * F.col("bx") + F.col("dy") * F.col("by"), F.col("dy") * F.col("bx") - F.col("dx") * F.col("by")
    flat2 = F.col("bx") * F.col("bx") + F.col("by") * F.col("by")
    joined = joined.withColumns({"flat2": flat2, "along": along, "across": across})
    return joined.filter((F.col("along") >= 0) & (F.col("along") <= F.col("flat2")) & (F.col("across") * F.col("across") <= F.col("radius") * F.col("radius") * F.col("flat2")))


def distance_to_line() -> Column:
    """Distance of a cell's upright line, from its top downward, to the pair's segment; null behind an end."""
    bz, dz = F.col("z2") - F.col("z1"), F.col("cz") - F.col("z1")
    p = F.col("along") / F.col("flat2")
    # the segment passes beside the upright line: distance of two lines; else of the top to the segment
    beside = F.when(p.between(0, 1), F.abs(F.col("across")) / F.sqrt("flat2"))
    t = (F.col("along") + dz * bz) / (F.col("flat2") + bz * bz)
    off = lambda a, b: (t * a - b) * (t * a - b)
    above = F.when(t.between(0, 1), F.sqrt(off(F.col("bx"), F.col("dx")) + off(F.col("by"), F.col("dy")) + off(bz, dz)))
    return F.when(dz - p * bz > 0, beside).otherwise(above)


def cylinder_confidence(pairs: DataFrame, cells: DataFrame, size: float, threshold: float) -> DataFrame:
    """Clear part of each pair's cylinder, 0 below the threshold and 1 without an obstruction: pair_id, confidence."""
    near = corridor(pairs, cells, size).withColumn("distance", distance_to_line()).groupBy("pair_id").agg(F.min("distance").alias("distance"))
    out = pairs.select("pair_id", "radius").join(near, "pair_id", "left")
    clear = F.least(F.coalesce(F.col("distance") / F.col("radius"), F.lit(1.0)), F.lit(1.0))
    return out.select("pair_id", F.when(clear < F.lit(threshold), F.lit(0.0)).otherwise(clear).alias("confidence"))


def ellipsoid_confidence(pairs: DataFrame, cells: DataFrame, size: float, threshold: float) -> DataFrame:
    """Clear part of each pair's Fresnel ellipsoid: the largest radius of an ellipsoid around both ends that no cell enters,
    by the radius of the first zone; 0 if the part below the threshold is obstructed: pair_id, confidence.

    A cell reaches up to cz. Below the axis its top decides; at or above the axis the ellipse in plan does.
    """
    hit = corridor(pairs, cells, size)
    bz = F.col("z2") - F.col("z1")
    hit = hit.withColumns({"flat": F.sqrt("flat2"), "full2": F.col("flat2") + bz * bz})
    # coordinates along and across the axis from its middle
    u_flat = F.col("along") / F.col("flat") - F.col("flat") / 2
    v = F.col("across") / F.col("flat")
    w = F.col("cz") - (F.col("z1") + F.col("z2")) / 2
    hit = hit.withColumns({"u": (u_flat * F.col("flat") + w * bz) / F.sqrt("full2"), "v": v, "n": (w * F.col("flat") - u_flat * bz) / F.sqrt("full2"), "u_flat": u_flat})
    # the top is above the axis: what counts is the ellipse in plan
    plan = F.abs(F.col("v")) / F.sqrt(F.lit(1.0) - F.lit(4.0) * F.col("u_flat") * F.col("u_flat") / F.col("flat2"))
    solid = F.sqrt(F.col("v") * F.col("v") + F.col("n") * F.col("n")) / F.sqrt(F.lit(1.0) - F.lit(4.0) * F.col("u") * F.col("u") / F.col("full2"))
    inside_plan = F.lit(4.0) * F.col("u_flat") * F.col("u_flat") < F.col("flat2")
    inside = F.lit(4.0) * F.col("u") * F.col("u") < F.col("full2")
    radius = F.when((F.col("n") >= 0) & inside_plan, plan).when((F.col("n") < 0) & inside, solid)
    least = hit.withColumn("r", radius).groupBy("pair_id").agg(F.min("r").alias("r"))
    out = pairs.select("pair_id", "radius").join(least, "pair_id", "left")
    clear = F.least(F.coalesce(F.col("r") / F.col("radius"), F.lit(1.0)), F.lit(1.0))
    return out.select("pair_id", F.when(clear < F.lit(threshold), F.lit(0.0)).otherwise(clear).alias("confidence"))


def _side(ax, ay, bx, by, cx, cy) -> Column:
    """On which side of the line from a to b the point c lies: the sign of twice the triangle's area."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def meets_ring(x1: Column, y1: Column, x2: Column, y2: Column, ring: Column) -> Column:
    """Whether the line between two points touches a closed ring (array of lon, lat) or lies in it; edges are straight in both."""
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"]
        boxes = (F.greatest(ax, bx) >= F.least(x1, x2)) & (F.least(ax, bx) <= F.greatest(x1, x2)) & (F.greatest(ay, by) >= F.least(y1, y2)) & (F.least(ay, by) <= F.greatest(y1, y2))
        ends = F.signum(_side(x1, y1, x2, y2, ax, ay)) * F.signum(_side(x1, y1, x2, y2, bx, by)) <= 0
        return boxes & ends & (F.signum(_side(ax, ay, bx, by, x1, y1)) * F.signum(_side(ax, ay, bx, by, x2, y2)) <= 0)

    def above(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"]
        return ((ay > y1) != (by > y1)) & (x1 < (bx - ax) * (y1 - ay) / (by - ay) + ax)

    odd = F.size(F.filter(edges, above)) % 2 == 1
    return F.coalesce((F.size(ring) > 3) & (F.exists(edges, crosses) | odd), F.lit(False))


def through_zone(ring: Column, lon1="l_lon", lat1="l_lat", lon2="r_lon", lat2="r_lat") -> Column:
    """Whether the line of sight between two places meets a zone, seen from above; lines over the date line are tried on both sides."""
    x1, y1, y2 = F.col(lon1), F.col(lat1), F.col(lat2)
    x2 = x1 + (F.pmod(F.col(lon2) - x1 + 180, F.lit(360.0)) - 180)
    turn = F.when(x1 > 0, -360.0).otherwise(360.0)
    return meets_ring(x1, y1, x2, y2, ring) | (((x2 > 180) | (x2 < -180)) & meets_ring(x1 + turn, y1, x2 + turn, y2, ring))
