"""Building outlines: clipping, site candidates on roofs, rasters of heights, and where an input site stands.

Rings are short arrays of (lon, lat) or planar structs; all but the clipping are column functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions import geo

RING = "array<struct<lon:double,lat:double>>"


def clip_ring(ring: list[tuple[float, float]], window: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The part of a ring within a convex window (Sutherland-Hodgman); both without their closing corner."""
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(window, window[1:] + window[:1], strict=True))
    if area < 0:
        window = window[::-1]
    out = ring
    for (x1, y1), (x2, y2) in zip(window, window[1:] + window[:1], strict=True):
        side = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x, y in out]
        kept = []
        for i, (x, y) in enumerate(out):
            px, py, s, ps = *out[i - 1], side[i], side[i - 1]
            if (s >= 0) != (ps >= 0):
                t = ps / (ps - s)
                kept.append((px + t * (x - px), py + t * (y - py)))
            if s >= 0:
                kept.append((x, y))
        out = kept
        if not out:
            return []
    return [p for i, p in enumerate(out) if p != out[i - 1]]


def clipped(buildings: DataFrame, window: list[tuple[float, float]], least_m2: float = 50.0) -> DataFrame:
    """Buildings (building_id, ring) cut to a convex boundary, without those smaller than least_m2."""
    ring_type = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = []
            for ring in batch.column("ring").to_pylist():
                points = [(p["lon"], p["lat"]) for p in ring or ()]
                points = points[:-1] if len(points) > 1 and points[0] == points[-1] else points
                cut = clip_ring(points, window) if len(points) > 2 else []
                rings.append([{"lon": x, "lat": y} for x, y in cut])
            yield pa.RecordBatch.from_arrays([batch.column("building_id"), pa.array(rings, ring_type)], ["building_id", "ring"])

    out = buildings.select(F.col("building_id").cast("bigint").alias("building_id"), "ring").mapInArrow(run, f"building_id bigint, ring {RING}")
    return out.filter(F.size("ring") > 2).filter(geo.ring_area_m2("ring") > least_m2)


def _open(ring: str) -> Column:
    """The ring without its closing corner."""
    r = F.col(ring)
    closed = F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1)
    return F.when(closed, F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(1)))).otherwise(r)


def corners(buildings: DataFrame, least: float = 30.0, most: float = 150.0) -> DataFrame:
    """Corners with an inner angle from least to most degrees, all corners where none has: building_id, i, lon, lat, angle."""
    rings = buildings.select("building_id", _open("ring").alias("ring")).filter("size(ring) > 2")
    at = lambda i: F.get("ring", F.pmod(F.col("i") + i, F.size("ring")))
    each = rings.select("building_id", "ring", F.posexplode("ring").alias("i", "p")).select("building_id", "i", "p", at(-1).alias("a"), at(1).alias("b"))
    flat = lambda p: (p["lon"] * F.cos(F.radians("p.lat")), p["lat"])
    each = each.select("building_id", "i", "p.lon", "p.lat", F.round(geo.planar_angle(*flat(F.col("p")), *flat(F.col("a")), *flat(F.col("b"))), 2).alias("angle"))
    good = F.col("angle").between(least, most)
    some = each.groupBy("building_id").agg(F.bool_or(good).alias("some"))
    return each.join(some, "building_id").filter(~F.col("some") | good).drop("some")


def spread_corners(found: DataFrame, most: int = 3) -> DataFrame:
    """Of a building's corners about `most`, evenly spread along the ring; rings are short, so they are sorted as arrays."""
    per = found.groupBy("building_id").agg(F.array_sort(F.collect_list(F.struct("i", "lon", "lat"))).alias("c"))
    step = F.floor(F.size("c") / most).cast("int")
    kept = F.when(F.size("c") > most, F.filter("c", lambda _, k: (k % step == 0) & (k < step * most))).otherwise(F.col("c"))
    return per.select("building_id", F.explode(kept).alias("x")).select("building_id", "x.lon", "x.lat")


def centers(buildings: DataFrame) -> DataFrame:
    """Centroid of each building where it lies inside, else the middle of its first corner and the centroid that is nearest inside."""
    lon, lat = geo.ring_centroid("ring")
    found = buildings.filter("size(ring) > 2").withColumns({"lon": lon, "lat": lat})
    first = F.get("ring", F.lit(0))
    steps = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.struct((F.col("lon") + (first["lon"] - F.col("lon")) * k / 20).alias("lon"), (F.col("lat") + (first["lat"] - F.col("lat")) * k / 20).alias("lat")))
    walked = found.withColumn("steps", steps)
    inside = F.filter("steps", lambda p: geo.in_ring("ring", p["lon"], p["lat"]))
    best = F.coalesce(F.get(inside, F.lit(0)), first)
    return walked.select("building_id", best["lon"].alias("lon"), best["lat"].alias("lat"))


def highest(buildings: DataFrame, cells: DataFrame) -> DataFrame:
    """Highest cell (lon, lat, z) in each building, by the box's tiles of a thousandth of a degree and the exact test."""
    tile = lambda c: F.floor(c * 1000).cast("bigint")
    box = buildings.withColumns({f"{k}{n}": f(_axis(k)) for k in ("lon", "lat") for n, f in ((0, F.array_min), (1, F.array_max))})
    box = box.withColumn("tx", F.explode(F.sequence(tile(F.col("lon0")), tile(F.col("lon1"))))).withColumn("ty", F.explode(F.sequence(tile(F.col("lat0")), tile(F.col("lat1")))))
    tiled = cells.withColumns({"tx": tile(F.col("lon")), "ty": tile(F.col("lat"))})
    inside = box.join(tiled, ["tx", "ty"]).filter(geo.in_ring("ring", "lon", "lat"))
    best = F.max_by(F.struct("lon", "lat", "z"), F.struct("z", -F.col("lon"), -F.col("lat"))).alias("best")
    return inside.groupBy("building_id").agg(best).select("building_id", "best.lon", "best.lat", "best.z")


def _axis(name: str) -> Column:
    return F.transform("ring", lambda p: p[name])


def locate_inputs(sites: DataFrame, *, mount_above_roof: float = 1.5, pole_height: float = 5.0, roof_from: float = 2.0) -> DataFrame:
    """Location type and altitude of input sites with sampled surface and terrain heights (columns surface, terrain).

    A site stands on a roof where the surface is at least roof_from metres over the terrain. Its altitude is the one
    given, else terrain and height given, else the roof and the mount above it, else the terrain and a pole.
    """
    on_roof = (F.col("surface") - F.col("terrain")) >= roof_from
    kind = F.when(F.col("location_type") != "UNKNOWN", F.col("location_type")).when(on_roof, "ROOFTOP").when(~on_roof, "STREET_LEVEL").otherwise("UNKNOWN")
    altitude = F.coalesce("altitude", F.col("terrain") + F.col("height"), F.when(kind == "ROOFTOP", F.col("surface") + mount_above_roof), F.col("terrain") + pole_height)
    return sites.withColumns({"location_type": kind, "altitude": altitude})
