"""Geodesy as column functions; angles in degrees, lengths in metres, all inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
# WGS 84 ellipsoid and transverse Mercator scale. Fixed values.
_A, _F, _K0 = 6_378_137.0, 1 / 298.257223563, 0.9996
_N = _F / (2 - _F)
_RECTIFYING = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180 - 127 * _N**5 / 288 + 7891 * _N**6 / 37800,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440 + 281 * _N**5 / 630 - 1983433 * _N**6 / 1935360,
    61 * _N**3 / 240 - 103 * _N**4 / 140 + 15061 * _N**5 / 26880 + 167603 * _N**6 / 181440,
    49561 * _N**4 / 161280 - 179 * _N**5 / 168 + 6601661 * _N**6 / 7257600,
    34729 * _N**5 / 80640 - 3418889 * _N**6 / 1995840,
    212378941 * _N**6 / 319334400,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360 - 81 * _N**5 / 512 + 96199 * _N**6 / 604800,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440 + 46 * _N**5 / 105 - 1118711 * _N**6 / 3870720,
    17 * _N**3 / 480 - 37 * _N**4 / 840 - 209 * _N**5 / 4480 + 5569 * _N**6 / 90720,
    4397 * _N**4 / 161280 - 11 * _N**5 / 504 - 830251 * _N**6 / 7257600,
    4583 * _N**5 / 161280 - 108847 * _N**6 / 3991680,
    20648693 * _N**6 / 638668800,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45 + 26 * _N**5 / 45 - 2854 * _N**6 / 675,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45 + 2704 * _N**5 / 315 + 2323 * _N**6 / 945,
    56 * _N**3 / 15 - 136 * _N**4 / 35 - 1262 * _N**5 / 105 + 73814 * _N**6 / 2835,
    4279 * _N**4 / 630 - 332 * _N**5 / 35 - 399572 * _N**6 / 14175,
    4174 * _N**5 / 315 - 144838 * _N**6 / 6237,
    601676 * _N**6 / 22275,
)
_E = math.sqrt(_F * (2 - _F))


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance."""
    p, q = F.radians(c(lat1)), F.radians(c(lat2))
    h = F.pow(F.sin((q - p) / 2), F.lit(2.0)) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(c(lon2) - c(lon1)) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def distance(lon1, lat1, alt1, lon2, lat2, alt2) -> Column:
    """Great-circle distance with the altitude difference where both altitudes are known."""
    ground, rise = haversine(lon1, lat1, lon2, lat2), F.coalesce(c(alt2) - c(alt1), F.lit(0.0))
    return F.sqrt(ground * ground + rise * rise)


def bearing(lon1, lat1, lon2, lat2) -> Column:
    """Initial bearing in [0, 360)."""
    p, q, d = F.radians(c(lat1)), F.radians(c(lat2)), F.radians(c(lon2) - c(lon1))
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d)))
    return F.pmod(angle, F.lit(360.0))


def angle_delta(a, b) -> Column:
    """a - b wrapped to (-180, 180]."""
    d = c(a) - c(b)
    return F.when(d > 180, d - 360).when(d <= -180, d + 360).otherwise(d)


def translate(lon, lat, bearing_deg, meters) -> tuple[Column, Column]:
    """Longitude and latitude of the point at a bearing and distance."""
    p, b, d = F.radians(c(lat)), F.radians(c(bearing_deg)), c(meters) / F.lit(EARTH_M)
    q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    east = F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q))
    return c(lon) + F.degrees(east), F.degrees(q)


def grid_deltas(lon, lat, spacing) -> tuple[Column, Column]:
    """Steps in longitude and latitude for a spacing in metres."""
    east, _ = translate(lon, lat, 90.0, spacing)
    _, north = translate(lon, lat, 0.0, spacing)
    return east - c(lon), north - c(lat)


def utm_zone(lon) -> Column:
    return (F.pmod(F.floor((c(lon) + 180) / 6), F.lit(60)) + 1).cast("int")


def utm_epsg(lon, lat) -> Column:
    return (F.when(c(lat) >= 0, 32600).otherwise(32700) + utm_zone(lon)).cast("int")


def utm_epsg_near(lon, lat, reach_m: float) -> Column:
    """All zones that have a point within reach_m: a point's own one, near a border also those beyond it."""
    high = math.degrees(reach_m / EARTH_M) * 1.01
    far = F.least(F.abs(c(lat)) + F.lit(high), F.lit(90.0))
    wide = F.when(far >= 89.9, F.lit(180.0)).otherwise(F.least(F.lit(high) / F.cos(F.radians(far)), F.lit(180.0)))
    at = lambda v: F.floor((v + 180) / F.lit(6.0)).cast("int")
    zones = F.array_distinct(F.transform(F.sequence(at(c(lon) - wide), at(c(lon) + wide)), lambda z: F.pmod(z, F.lit(60)) + 1))
    halves = F.array_distinct(F.array(*(F.when(v >= 0, 32600).otherwise(32700) for v in (c(lat) - high, c(lat) + high))))
    return F.flatten(F.transform(halves, lambda h: F.transform(zones, lambda z: (h + z).cast("int"))))


def geohash(lon, lat, precision: int = 10) -> Column:
    """Base-32 hash in digits 0-9a-v, longitude bit first; a value below the middle of its range gets a 0 bit."""
    half = precision * 5 // 2
    cells = float(2**half)

    def cell(x: Column, low: float, size: float) -> Column:
        at = F.floor((x - F.lit(low)) / F.lit(size) * F.lit(cells))
        return F.lpad(F.bin(F.least(F.greatest(at, F.lit(0)), F.lit(2**half - 1)).cast("bigint")), half, "0")

    bits = F.array_join(F.zip_with(F.split(cell(c(lon), -180.0, 360.0), ""), F.split(cell(c(lat), -90.0, 180.0), ""), lambda a, b: F.concat(a, b)), "")
    return F.lower(F.lpad(F.conv(bits, 2, 32), precision, "0"))


def law_of_cosines(len1: Column, len2: Column, opposite: Column) -> Column:
    """Angle between sides len1 and len2, clamped; 0 for an opposite side of 0."""
    ratio = (len1 * len1 + len2 * len2 - opposite * opposite) / (F.lit(2.0) * len1 * len2)
    return F.when(opposite == 0, F.lit(0.0)).otherwise(F.degrees(F.acos(F.least(F.greatest(ratio, F.lit(-1.0)), F.lit(1.0)))))


def length_ratio(a: Column, b: Column) -> Column:
    return F.greatest(a, b) / F.least(a, b)


def spherical_angle(lon0, lat0, lon1, lat1, lon2, lat2) -> tuple[Column, Column]:
    """Angle at point 0 between points 1 and 2, and the ratio of the two lengths."""
    a, b, o = haversine(lon0, lat0, lon1, lat1), haversine(lon0, lat0, lon2, lat2), haversine(lon1, lat1, lon2, lat2)
    return law_of_cosines(a, b, o), length_ratio(a, b)


def planar_angle(x0, y0, x1, y1, x2, y2) -> Column:
    d = lambda ax, ay, bx, by: F.sqrt((c(ax) - c(bx)) * (c(ax) - c(bx)) + (c(ay) - c(by)) * (c(ay) - c(by)))
    return law_of_cosines(d(x0, y0, x1, y1), d(x0, y0, x2, y2), d(x1, y1, x2, y2))


def central_meridian(zone: Column) -> Column:
    return zone * 6 - 183


def to_utm(lon, lat, epsg=None) -> tuple[Column, Column]:
    """Easting and northing by the Krüger series to the sixth order, in the point's own zone or in that of epsg."""
    p = F.radians(c(lat))
    south = c(lat) < 0 if epsg is None else c(epsg) >= 32700
    zone = utm_zone(lon) if epsg is None else F.pmod(c(epsg), F.lit(100))
    west_east = F.radians(c(lon) - central_meridian(zone))
    t = F.sinh(F.atanh(F.sin(p)) - F.lit(_E) * F.atanh(F.lit(_E) * F.sin(p)))
    xi, eta = F.atan2(t, F.cos(west_east)), F.atanh(F.sin(west_east) / F.sqrt(F.lit(1.0) + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + F.lit(a) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
        y = y + F.lit(a) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
    scale = F.lit(_K0 * _RECTIFYING)
    return F.lit(500_000.0) + scale * x, F.when(south, 10_000_000.0).otherwise(0.0) + scale * y


def from_utm(x, y, epsg) -> tuple[Column, Column]:
    """Longitude and latitude of a point in a zone."""
    scale = F.lit(_K0 * _RECTIFYING)
    south = c(epsg) >= 32700
    eta, xi = (c(x) - 500_000.0) / scale, (c(y) - F.when(south, 10_000_000.0).otherwise(0.0)) / scale
    e, n = eta, xi
    for j, b in enumerate(_BETA, 1):
        e = e - F.lit(b) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
        n = n - F.lit(b) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
    conformal = F.asin(F.sin(n) / F.cosh(e))
    lat = conformal
    for j, d in enumerate(_DELTA, 1):
        lat = lat + F.lit(d) * F.sin(F.lit(2.0 * j) * conformal)
    zone = F.when(south, c(epsg) - 32700).otherwise(c(epsg) - 32600)
    return F.degrees(F.atan2(F.sinh(e), F.cos(n))) + central_meridian(zone), F.degrees(lat)


def dms_to_decimal(text) -> Column:
    """Decimal degrees of `100°20'2.04"E`, `122.4194° W` or a plain number; null if it is none of these."""
    t = F.trim(c(text))
    pattern = r"^([+-]?\d+(?:\.\d+)?)[\s°]*(?:(\d+(?:\.\d+)?)[\s'′]+)?(?:(\d+(?:\.\d+)?)[\s\"″]*)?([NSEWnsew]?)$"
    part = [F.regexp_extract(t, pattern, i) for i in range(1, 5)]
    number = lambda x: F.coalesce(F.when(x != "", x.cast("double")), F.lit(0.0))
    value = part[0].try_cast("double")
    size = F.abs(value) + number(part[1]) / 60 + number(part[2]) / 3600
    negative = (F.upper(part[3]).isin("S", "W")) != part[0].startswith("-")
    return F.when(part[0] != "", F.when(negative, -size).otherwise(size))


def in_ring(ring, x, y) -> Column:
    """Even-odd test of a point against an array of structs (lon, lat) with edges straight in both."""
    r = c(ring)
    n = F.size(r)

    def crosses(a: Column, i: Column) -> Column:
        b = F.get(r, F.pmod(i + 1, n))
        over = (a["lat"] > c(y)) != (b["lat"] > c(y))
        return F.when(over & (c(x) < (b["lon"] - a["lon"]) * (c(y) - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]), 1).otherwise(0)

    crossings = F.aggregate(F.transform(r, crosses), F.lit(0), lambda acc, v: acc + v)
    return F.coalesce((crossings % 2) == 1, F.lit(False))


def ring_area_m2(ring) -> Column:
    """Shoelace area of a small ring in square metres, on a plane through its first corner."""
    r = c(ring)
    first = F.get(r, F.lit(0))
    k = F.lit(math.pi / 180 * EARTH_M)
    xs = F.transform(r, lambda p: F.struct(((p["lon"] - first["lon"]) * F.cos(F.radians(first["lat"])) * k).alias("x"), ((p["lat"] - first["lat"]) * k).alias("y")))
    twice = F.aggregate(F.transform(xs, lambda p, i: p["x"] * F.get(xs, F.pmod(i + 1, F.size(xs)))["y"] - F.get(xs, F.pmod(i + 1, F.size(xs)))["x"] * p["y"]), F.lit(0.0), lambda a, v: a + v)
    return F.abs(twice) / 2


def ring_centroid(ring) -> tuple[Column, Column]:
    """Centroid (lon, lat) of a ring."""
    r = c(ring)
    first = F.get(r, F.lit(0))
    terms = F.transform(r, lambda p, i: _term(p, F.get(r, F.pmod(i + 1, F.size(r))), first))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = F.aggregate(terms, zero, lambda acc, t: F.struct((acc["a"] + t["a"]).alias("a"), (acc["x"] + t["x"]).alias("x"), (acc["y"] + t["y"]).alias("y")))
    return first["lon"] + F.try_divide(total["x"], total["a"] * 3), first["lat"] + F.try_divide(total["y"], total["a"] * 3)


def _term(p: Column, q: Column, first: Column) -> Column:
    px, py, qx, qy = p["lon"] - first["lon"], p["lat"] - first["lat"], q["lon"] - first["lon"], q["lat"] - first["lat"]
    cross = px * qy - qx * py
    return F.struct(cross.alias("a"), ((px + qx) * cross).alias("x"), ((py + qy) * cross).alias("y"))
