"""Queries of raster and line-of-sight operators. The surface is the highest recorded altitude in each 20 m cell of a UTM zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions import geo, rf
from meshwright.operators import los, raster
from meshwright.plans.domain import BASE_SQL, RADIO, links, sites
from meshwright.plans.relational import ORACLES as _relational
from meshwright.plans.relational import site_point_in_polygon
from meshwright.plans.scalars import _UTM, _utm_sql, r
from meshwright.tables import table

CELL = 20.0
REACH = 10


def _places(spark: SparkSession, d: str) -> DataFrame:
    x, y = geo.to_utm("lon", "lat")
    return sites(spark, d).select("site_id", geo.utm_epsg("lon", "lat").alias("zone"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.col("alt").alias("z"))


def _surface(spark: SparkSession, d: str) -> DataFrame:
    return raster.rasterize(_places(spark, d), CELL)


def raster_surface(spark: SparkSession, d: str) -> DataFrame:
    return _surface(spark, d)


def raster_sample(spark: SparkSession, d: str) -> DataFrame:
    """Altitude at each site from the cells, from the nearest one within 200 m where its own has none."""
    points = _places(spark, d).select(F.col("site_id").alias("id"), "zone", "x", "y")
    return raster.sample(points, _surface(spark, d), CELL, REACH).select("id", r("z", 6).alias("z"))


def raster_resample(spark: SparkSession, d: str) -> DataFrame:
    """Cells of half the size, summed up again."""
    fine = raster.refine(_surface(spark, d), 2)
    return fine.groupBy("zone", F.floor(F.col("ix") / 2).alias("ix"), F.floor(F.col("iy") / 2).alias("iy")).agg(F.count(F.lit(1)).alias("parts"), F.max("z").alias("z"))


def raster_add(spark: SparkSession, d: str) -> DataFrame:
    """Height of the surface over the lowest altitude of each cell, and their sum."""
    top, low = _surface(spark, d), raster.rasterize(_places(spark, d), CELL, F.min)
    both = raster.combine(top, low, minus=True).withColumnRenamed("z", "height").join(raster.combine(top, low).withColumnRenamed("z", "total"), ["zone", "ix", "iy"])
    return both.select("zone", "ix", "iy", r("height", 6).alias("height"), r("total", 6).alias("total"))


def raster_fill_nodata(spark: SparkSession, d: str) -> DataFrame:
    """The surface with every fifth cell made empty and filled again from its neighbours."""
    holes = F.when(F.pmod(F.col("ix") + F.col("iy"), F.lit(5)) == 0, F.lit(raster.NODATA)).otherwise(F.col("z"))
    filled = raster.fill_nodata(_surface(spark, d).withColumn("z", holes), REACH)
    return filled.select("zone", "ix", "iy", r("z", 6).alias("z"))


def raster_thin(spark: SparkSession, d: str) -> DataFrame:
    return raster.thin(_surface(spark, d), 2).groupBy("zone").agg(F.count(F.lit(1)).alias("cells"), F.max("z").alias("top"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of linked sites 20 to 1000 m apart, each once, a little above their ground, in the zone of the first."""
    place = sites(spark, d).filter("alt is not null")
    end = lambda k, n: place.select(F.col("site_id").alias(f"{k}_id"), *(F.col(a).alias(f"{a}{n}") for a in ("lon", "lat")), (F.col("alt") + 2.0).alias(f"z{n}"))
    pairs = links(spark, d).select(F.least("tx_id", "rx_id").alias("tx_id"), F.greatest("tx_id", "rx_id").alias("rx_id")).distinct()
    both = pairs.join(end("tx", 1), "tx_id").join(end("rx", 2), "rx_id").withColumn("zone", geo.utm_epsg("lon1", "lat1"))
    for n in (1, 2):
        x, y = geo.to_utm(f"lon{n}", f"lat{n}", "zone")
        both = both.withColumns({f"x{n}": F.round(x, 3), f"y{n}": F.round(y, 3)})
    flat = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    both = both.withColumn("flat", flat).filter("flat between 20 and 1000")
    full = F.sqrt(F.col("flat") * F.col("flat") + (F.col("z2") - F.col("z1")) ** 2)
    radius = F.greatest(rf.fresnel_radius(full, RADIO["mhz"]) * 10, F.lit(10.0))
    return both.select(F.concat_ws(">", "tx_id", "rx_id").alias("pair_id"), "zone", "x1", "y1", "z1", "x2", "y2", "z2", radius.alias("radius"))


def _ground(spark: SparkSession, d: str) -> DataFrame:
    """The surface with places near a border in the zones on both sides: a pair's cells reach beyond its own zone."""
    near = sites(spark, d).select("lon", "lat", "alt", F.explode(geo.utm_epsg_near("lon", "lat", 2000.0)).alias("zone"))
    x, y = geo.to_utm("lon", "lat", "zone")
    return raster.rasterize(near.select("zone", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.col("alt").alias("z")), CELL)


def los_cylinder(spark: SparkSession, d: str) -> DataFrame:
    out = los.cylinder_confidence(_pairs(spark, d), _ground(spark, d), CELL, 0.1)
    return out.select("pair_id", r("confidence").alias("confidence"))


def los_ellipsoid(spark: SparkSession, d: str) -> DataFrame:
    out = los.ellipsoid_confidence(_pairs(spark, d), _ground(spark, d), CELL, 0.1)
    return out.select("pair_id", r("confidence").alias("confidence"))


def site_detect_highest(spark: SparkSession, d: str) -> DataFrame:
    """The highest site of each area, of equally high ones the first."""
    inside = site_point_in_polygon(spark, d).join(sites(spark, d).select("site_id", "alt"), "site_id").filter("alt is not null")
    return inside.groupBy("area_id").agg(F.min(F.struct((-F.col("alt")).alias("less"), "site_id")).alias("x")).select("area_id", "x.site_id", (-F.col("x.less")).alias("alt"))


def site_detect_corners(spark: SparkSession, d: str) -> DataFrame:
    """Corners of each area's ring whose inner angle is from 30 to 150 degrees."""
    rings = table(spark, d, "areas").filter("size(outer_ring) > 3").select("area_id", F.slice("outer_ring", 1, F.size("outer_ring") - 1).alias("ring"))
    at = lambda i: F.get("ring", F.pmod(F.col("i") + i, F.size("ring")))
    corners = rings.select("area_id", "ring", F.posexplode("ring").alias("i", "p")).select("area_id", "i", "p", at(-1).alias("a"), at(1).alias("b"))
    flat = lambda p: (p["lon"] * F.cos(F.radians("p.lat")), p["lat"])
    angle = geo.planar_angle(*flat(F.col("p")), *flat(F.col("a")), *flat(F.col("b")))
    return corners.select("area_id", "i", r(angle, 2).alias("angle")).filter("angle between 30 and 150")


QUERIES = {
    f.__name__: f
    for f in (raster_surface, raster_sample, raster_resample, raster_add, raster_fill_nodata, raster_thin, los_cylinder, los_ellipsoid, site_detect_highest, site_detect_corners)
}

_CELLS = BASE_SQL + _UTM + f""", pl AS (SELECT p.site_id, CAST(CASE WHEN p.lat >= 0 THEN 32600 ELSE 32700 END + CAST(floor((p.lon + 180) / 6) AS INTEGER) % 60 + 1 AS INTEGER) AS zone, round(x, 3) AS x, round(y, 3) AS y, alt AS z FROM p JOIN st USING (site_id)),
pc AS (SELECT *, CAST(round_even(x / {CELL}, 0) AS BIGINT) AS ix, CAST(round_even(y / {CELL}, 0) AS BIGINT) AS iy FROM pl),
ce AS (SELECT zone, ix, iy, max(z) AS z, min(z) AS low FROM pc WHERE z IS NOT NULL GROUP BY 1, 2, 3)
"""


def _nearest(asks: str, known: str) -> str:
    return f"""nr AS (SELECT a.zone, a.ix, a.iy, arg_min(k.z, (pow(a.ix - k.ix, 2) + pow(a.iy - k.iy, 2), k.ix, k.iy)) AS near FROM {asks} a JOIN {known} k ON a.zone = k.zone AND abs(a.ix - k.ix) <= {REACH} AND abs(a.iy - k.iy) <= {REACH}
  WHERE pow(a.ix - k.ix, 2) + pow(a.iy - k.iy, 2) <= {REACH * REACH} GROUP BY 1, 2, 3)"""


# a place is projected in each zone within some km of it, so that pairs and their cells are in the zone of the pair's first end
_NEAR = "0.03e0 / cos(radians(least(abs(lat) + 0.03e0, 89.5e0)))"
_LOS = BASE_SQL + f""", zs AS (SELECT site_id, lon, lat, alt, CAST(floor((lon + 180) / 6) AS INTEGER) % 60 + 1 AS own, lat < 0 AS own_south,
    unnest(range(CAST(floor((lon - {_NEAR} + 180) / 6) AS BIGINT), CAST(floor((lon + {_NEAR} + 180) / 6) AS BIGINT) + 1)) AS k FROM st),
zr AS (SELECT DISTINCT site_id, lon, lat, alt, own, own_south, CAST((zs.k + 60) % 60 + 1 AS INTEGER) AS zone, h.south FROM zs JOIN (SELECT unnest([true, false]) AS south) h ON CASE WHEN south THEN lat < 0.03e0 ELSE lat > -0.03e0 END)
""" + _utm_sql("zr", "*") + f""", pl AS (SELECT site_id, own = zone AND own_south = south AS home, CAST(CASE WHEN south THEN 32700 ELSE 32600 END + zone AS INTEGER) AS zone, round(x, 3) AS x, round(y, 3) AS y, alt AS z FROM p),
ce AS (SELECT zone, ix, iy, max(z) AS z FROM (SELECT *, CAST(round_even(x / {CELL}, 0) AS BIGINT) AS ix, CAST(round_even(y / {CELL}, 0) AS BIGINT) AS iy FROM pl) WHERE z IS NOT NULL GROUP BY 1, 2, 3),
lp AS (SELECT DISTINCT least(tx_id, rx_id) AS a, greatest(tx_id, rx_id) AS b FROM ln),
pr AS (SELECT lp.a || '>' || lp.b AS pair_id, s.zone, s.x AS x1, s.y AS y1, s.z + 2 AS z1, t.x AS x2, t.y AS y2, t.z + 2 AS z2, sqrt(pow(t.x - s.x, 2) + pow(t.y - s.y, 2)) AS flat FROM lp JOIN pl s ON s.site_id = lp.a AND s.home JOIN pl t ON t.site_id = lp.b AND s.zone = t.zone WHERE s.z IS NOT NULL AND t.z IS NOT NULL),
pq AS (SELECT *, greatest(8.65725790883e0 * sqrt(sqrt(flat * flat + pow(z2 - z1, 2)) / {RADIO['mhz']}e0) * 10, 10e0) AS radius FROM pr WHERE flat BETWEEN 20 AND 1000),
jc AS (SELECT q.*, ix * {CELL}e0 - x1 AS dx, iy * {CELL}e0 - y1 AS dy, z - z1 AS dz, x2 - x1 AS bx, y2 - y1 AS by_, z2 - z1 AS bz FROM pq q JOIN ce ON ce.zone = q.zone AND ix * {CELL}e0 BETWEEN least(x1, x2) - radius AND greatest(x1, x2) + radius AND iy * {CELL}e0 BETWEEN least(y1, y2) - radius AND greatest(y1, y2) + radius),
ja AS (SELECT *, dx * bx + dy * by_ AS along, dy * bx - dx * by_ AS across, bx * bx + by_ * by_ AS flat2 FROM jc),
jo AS (SELECT *, along / flat2 AS p, (along + dz * bz) / (flat2 + bz * bz) AS t, along / sqrt(flat2) - sqrt(flat2) / 2 AS uf, across / sqrt(flat2) AS v, dz - bz / 2 AS w, flat2 + bz * bz AS full2 FROM ja WHERE along BETWEEN 0 AND flat2 AND across * across <= radius * radius * flat2)
"""
_CONF = "coalesce(least(m / radius, 1), 1)"
ORACLES = {
    "raster_surface": _CELLS + "SELECT zone, ix, iy, z FROM ce",
    "raster_sample": _CELLS + ", ms AS (SELECT DISTINCT zone, ix, iy FROM pc ANTI JOIN ce USING (zone, ix, iy)), " + _nearest("ms", "ce") + " SELECT site_id AS id, round(coalesce(ce.z, near, (SELECT avg(z) FROM ce)), 6) + 0 AS z FROM pc LEFT JOIN ce USING (zone, ix, iy) LEFT JOIN nr USING (zone, ix, iy)",
    "raster_resample": _CELLS + "SELECT zone, ix, iy, CAST(4 AS BIGINT) AS parts, z FROM ce",
    "raster_add": _CELLS + "SELECT zone, ix, iy, round(z - low, 6) + 0 AS height, round(z + low, 6) + 0 AS total FROM ce",
    "raster_fill_nodata": _CELLS + ", hole AS (SELECT * FROM ce WHERE (ix + iy) % 5 = 0), kn AS (SELECT * FROM ce WHERE (ix + iy) % 5 <> 0), " + _nearest("hole", "kn") + " SELECT zone, ix, iy, round(z, 6) + 0 AS z FROM kn UNION ALL SELECT zone, ix, iy, round(coalesce(near, (SELECT avg(z) FROM kn)), 6) + 0 FROM hole LEFT JOIN nr USING (zone, ix, iy)",
    "raster_thin": _CELLS + "SELECT zone, count(*) AS cells, max(z) AS top FROM ce WHERE ix % 2 = 0 AND iy % 2 = 0 GROUP BY 1",
    "los_cylinder": _LOS + f""", dd AS (SELECT pair_id, min(CASE WHEN dz - p * bz > 0 THEN CASE WHEN p BETWEEN 0 AND 1 THEN abs(across) / sqrt(flat2) END WHEN t BETWEEN 0 AND 1 THEN sqrt(pow(t * bx - dx, 2) + pow(t * by_ - dy, 2) + pow(t * bz - dz, 2)) END) AS m FROM jo GROUP BY 1)
SELECT pair_id, round(CASE WHEN {_CONF} < 0.1e0 THEN 0 ELSE {_CONF} END, 3) + 0 AS confidence FROM pq LEFT JOIN dd USING (pair_id)""",
    "los_ellipsoid": _LOS + f""", uu AS (SELECT *, (uf * sqrt(flat2) + w * bz) / sqrt(full2) AS u, (w * sqrt(flat2) - uf * bz) / sqrt(full2) AS n FROM jo),
dd AS (SELECT pair_id, min(CASE WHEN n >= 0 AND 4 * uf * uf < flat2 THEN abs(v) / sqrt(1 - 4 * uf * uf / flat2) WHEN n < 0 AND 4 * u * u < full2 THEN sqrt(v * v + n * n) / sqrt(1 - 4 * u * u / full2) END) AS m FROM uu GROUP BY 1)
SELECT pair_id, round(CASE WHEN {_CONF} < 0.1e0 THEN 0 ELSE {_CONF} END, 3) + 0 AS confidence FROM pq LEFT JOIN dd USING (pair_id)""",
    "site_detect_highest": _relational["site_point_in_polygon"].replace("SELECT area_id, site_id FROM crossed", ", i AS (SELECT area_id, site_id FROM crossed") + ") SELECT area_id, arg_min(site_id, (-alt, site_id)) AS site_id, max(alt) AS alt FROM i JOIN st USING (site_id) WHERE alt IS NOT NULL GROUP BY 1",
    "site_detect_corners": """WITH g AS (SELECT area_id, outer_ring[:-2] AS ring FROM areas WHERE len(outer_ring) > 3), e AS (SELECT area_id, ring, CAST(unnest(range(len(ring))) AS INTEGER) AS i FROM g),
k AS (SELECT area_id, i, ring[i + 1] AS p, ring[(i - 1 + len(ring)) % len(ring) + 1] AS a, ring[(i + 1) % len(ring) + 1] AS b FROM e),
x AS (SELECT area_id, i, sqrt(pow((p.lon - a.lon) * cos(radians(p.lat)), 2) + pow(p.lat - a.lat, 2)) AS s, sqrt(pow((p.lon - b.lon) * cos(radians(p.lat)), 2) + pow(p.lat - b.lat, 2)) AS t, sqrt(pow((b.lon - a.lon) * cos(radians(p.lat)), 2) + pow(b.lat - a.lat, 2)) AS o FROM k),
y AS (SELECT area_id, i, round(CASE WHEN o = 0 THEN 0e0 ELSE degrees(acos(least(greatest((s * s + t * t - o * o) / (2 * s * t), -1), 1))) END, 2) + 0 AS angle FROM x) SELECT * FROM y WHERE angle BETWEEN 30 AND 150""",
}
