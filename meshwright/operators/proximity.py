"""Problem 2: points near other points or regions.

Space is cut into Voronoi cells around pivots. A point lies in the cell of its nearest pivot. Whatever may have a partner
in another cell is sent there as well: by the triangle inequality, an object whose nearest pivot is at distance d and
that reaches out by r can only meet points of cells whose pivot is at most d + 2r away. Inside a cell a vantage-point
tree over the cell's own points answers radius queries with the exact great-circle metric, for points (radius = the
wanted distance) and for regions (radius = the region's circumscribed circle) alike; the altitude difference, and for
regions the exact point-in-polygon test, decide on what the tree returns.

Pivots only cut the work: any choice gives the same rows. They are the points with the lowest hashes, one for about
CELL_ROWS distinct places and at most MOST_PIVOTS, which bounds what tasks get sent; tasks find the nearest pivot and all
those in reach by a vantage-point tree over the pivots, in a time that grows with their logarithm. A cell of more than
BLOCK_ROWS points is cut into blocks and each pair of blocks is joined once, so no task gets a whole hot cell. Recordings
of one site at one place are joined once and expanded afterwards by equi-joins.

Defined results
---------------
* No location (null, out of range, 0/0, NaN) or no id: the row is in no result. Null or nodata altitude: distance on the ground.
* Sites with a null or blank name, or a null plan, differ from every other row but themselves.
* Repeated rows each pair with the rows of other sites; a pair is given once, with the smaller id first.
* Regions with a null or short (fewer than three corners) outer ring contain nothing; a null hole is none.
* Empty tables give empty results; columns beyond those named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.tables import checkpoint, name_key

EARTH_M = 6_371_000.0
NODATA = -32768.0
CELL_ROWS, MOST_PIVOTS, BLOCK_ROWS, LEAF = 2_000, 262_144, 20_000, 48
#: Slack in metres on the partition's bounds, over the rounding error of distances.
SLACK_M = 0.01


def great_circle(lat1, lon1, lat2, lon2):
    """Haversine distance in metres; arguments in radians."""
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


class VantagePointTree:
    """Radius queries over points (radians) by distances to vantage points; whole batches of queries go down together."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, leaf: int = LEAF) -> None:
        self.lat, self.lon, self.leaf = lat, lon, leaf
        self.root = self._build(np.arange(len(lat)))

    def _build(self, ids: np.ndarray):
        if len(ids) <= self.leaf:
            return ids
        top = ids[len(ids) // 2]
        d = great_circle(self.lat[top], self.lon[top], self.lat[ids], self.lon[ids])
        half = np.partition(d, len(d) // 2)[len(d) // 2]
        near = d < half
        if not near.any():  # half of the points, or more, lie on the vantage point or on one circle around it
            near = d <= half
            if near.all():
                return ids
        a, b = ids[near], ids[~near]
        return top, d[near].max(), d[~near].min(), self._build(a), self._build(b)

    def upper_bound(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """For each query the distance of some point near it, at least that of its nearest one."""
        out, stack = np.full(len(lat), np.inf), [(self.root, np.arange(len(lat)))]
        while stack:
            node, q = stack.pop()
            if not len(q):
                continue
            if isinstance(node, np.ndarray):
                step = max(1, 2_000_000 // max(len(node), 1))
                for i in range(0, len(q), step):
                    part = q[i : i + step]
                    out[part] = great_circle(lat[part, None], lon[part, None], self.lat[None, node], self.lon[None, node]).min(1)
                continue
            top, near_max, far_min, near, far = node
            closer = great_circle(self.lat[top], self.lon[top], lat[q], lon[q]) * 2 <= near_max + far_min
            stack += [(near, q[closer]), (far, q[~closer])]
        return out

    def query(self, lat: np.ndarray, lon: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a query's and a point's index no farther apart than the query's radius, batch by batch."""
        stack = [(self.root, np.arange(len(lat)))] if len(self.lat) and len(lat) else []
        while stack:
            node, q = stack.pop()
            if isinstance(node, np.ndarray):
                step = max(1, 2_000_000 // len(node))
                for i in range(0, len(q), step):
                    part = q[i : i + step]
                    d = great_circle(lat[part, None], lon[part, None], self.lat[None, node], self.lon[None, node])
                    a, b = np.nonzero(d <= radius[part, None])
                    if len(a):
                        yield part[a], node[b]
                continue
            top, near_max, far_min, near, far = node
            d = great_circle(self.lat[top], self.lon[top], lat[q], lon[q])
            if len(inside := q[d <= near_max + radius[q] + SLACK_M]):
                stack.append((near, inside))
            if len(outside := q[d >= far_min - radius[q] - SLACK_M]):
                stack.append((far, outside))


def cells_within(pivots: VantagePointTree, lat: np.ndarray, lon: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of an object and a cell that its ball of radius `reach` may meet, and whether the cell is that of its nearest pivot.

    Every object has its own cell among them; of equally near pivots the first is the nearest.
    """
    bound = pivots.upper_bound(lat, lon) + 2 * reach + SLACK_M
    found = list(pivots.query(lat, lon, bound))
    who, cell = (np.concatenate([x[i] for x in found]) if found else np.empty(0, np.int64) for i in (0, 1))
    away = great_circle(lat[who], lon[who], pivots.lat[cell], pivots.lon[cell])
    order = np.lexsort((cell, away, who))
    who, cell, away = who[order], cell[order], away[order]
    first = np.ones(len(who), bool)
    first[1:] = who[1:] != who[:-1]
    nearest = away[first][np.cumsum(first) - 1] if len(who) else away
    keep = away <= nearest + 2 * reach[who] + SLACK_M
    return who[keep], cell[keep], first[keep]


def _assign(lat: np.ndarray, lon: np.ndarray):
    """Sends each object to its own cell and to those it may reach."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots = VantagePointTree(lat, lon)
        for pdf in batches:
            if len(pdf):
                who, cell, own = cells_within(pivots, np.radians(pdf["lat"].to_numpy()), np.radians(pdf["lon"].to_numpy()), pdf["reach"].to_numpy())
                yield pdf.iloc[who].assign(cell=cell, home=own)

    return run


def _in_ring(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Even-odd test of points against a ring of (lon, lat) corners with edges straight in both."""
    a, b = ring, np.roll(ring, -1, axis=0)
    inside = np.zeros(len(x), bool)
    for (x1, y1), (x2, y2) in zip(a, b, strict=True):
        if y1 != y2:
            crosses = (y1 > y) != (y2 > y)
            inside ^= crosses & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return inside


def _ring(flat) -> np.ndarray | None:
    if flat is None or len(flat) < 6:
        return None
    ring = np.asarray(flat, float).reshape(-1, 2)
    return ring[:-1] if (ring[0] == ring[-1]).all() else ring


_PAIR = "kind string, a bigint, a2 bigint, b bigint, b2 bigint"


def _join_cell(pdf: pd.DataFrame, radius: float) -> pd.DataFrame:
    """Radius join of one cell or of two of its blocks: what asks (part) against the cell's own points (block).

    Points of two different blocks meet here only; others meet twice, and the one with the smaller key asks.
    """
    part, block = int(pdf["part"].iloc[0]), int(pdf["block"].iloc[0])
    own, home, region = pdf["own"].to_numpy(), pdf["home"].to_numpy(), pdf["region"].to_numpy()
    points = pdf[home & (own == block)]
    asks = pdf[~region & (~home | (own == part))]
    kinds, out = [], []
    if len(points):
        lat, lon = np.radians(points["lat"].to_numpy()), np.radians(points["lon"].to_numpy())
        tree = VantagePointTree(lat, lon)
        (p1, p2, s1, s2, alt), (q1, q2, t1, t2, q_alt) = ([df[c].to_numpy() for c in ("p1", "p2", "s1", "s2", "alt")] for df in (points, asks))
        q_lat, q_lon, q_home = np.radians(asks["lat"].to_numpy()), np.radians(asks["lon"].to_numpy()), asks["home"].to_numpy()
        for q, p in tree.query(q_lat, q_lon, np.full(len(asks), radius)):
            once = (q1[q] < p1[p]) | ((q1[q] == p1[p]) & (q2[q] < p2[p]))
            if part != block:
                once |= q_home[q]
            keep = once & ((t1[q] != s1[p]) | (t2[q] != s2[p]))
            q, p = q[keep], p[keep]
            ground = great_circle(q_lat[q], q_lon[q], lat[p], lon[p])
            near = np.sqrt(ground**2 + np.nan_to_num(q_alt[q] - alt[p]) ** 2) <= radius
            q, p = q[near], p[near]
            kinds.append(np.full(len(q), "site", object))
            out.append((q1[q], q2[q], p1[p], p2[p]))
        deg_lat, deg_lon = points["lat"].to_numpy(), points["lon"].to_numpy()
        for area, r_lat, r_lon, reach, outer, hole in pdf.loc[region, ["p1", "lat", "lon", "reach", "outer", "hole"]].itertuples(index=False, name=None):
            hits = [p for _, p in tree.query(np.radians([r_lat]), np.radians([r_lon]), np.array([reach + SLACK_M]))]
            p = np.concatenate(hits) if hits else np.empty(0, np.int64)
            inside = _in_ring(deg_lon[p], deg_lat[p], _ring(outer))
            if (gap := _ring(hole)) is not None:
                inside &= ~_in_ring(deg_lon[p], deg_lat[p], gap)
            p = p[inside]
            kinds.append(np.full(len(p), "area", object))
            out.append((np.full(len(p), area), np.zeros(len(p), np.int64), p1[p], p2[p]))
    columns = [np.concatenate([x[i] for x in out]).astype(np.int64) if out else np.empty(0, np.int64) for i in range(4)]
    return pd.DataFrame({"kind": np.concatenate(kinds) if kinds else np.empty(0, object), **dict(zip(("a", "a2", "b", "b2"), columns, strict=True))})


def located(sites: DataFrame) -> DataFrame:
    """Rows with a location: site_row, lat, lon, alt, s1, s2 (site), p1, p2 (place: one site at one point).

    Sites and places are known by two 64-bit hashes each; different ones agree in both once in 10^38.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    ok = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    key = name_key("site_name")
    site = lambda seed: F.when(F.col("plan_id").isNotNull() & key.isNotNull(), F.xxhash64(F.lit(seed), "plan_id", F.lit("/"), key)).otherwise(F.xxhash64(F.lit(seed), F.lit("row"), "site_row"))
    alt = F.when((F.col("altitude") != NODATA) & ~F.isnan("altitude"), F.col("altitude"))
    # -0.0 and 0.0 are one place
    rows = sites.filter(ok & F.col("site_row").isNotNull()).select("site_row", (lat + F.lit(0.0)).alias("lat"), (lon + F.lit(0.0)).alias("lon"), (alt + F.lit(0.0)).alias("alt"), site(0).alias("s1"), site(1).alias("s2"))
    place = lambda seed: F.xxhash64(F.lit(seed), "s1", "s2", "lat", "lon", "alt")
    return rows.withColumns({"p1": place(0), "p2": place(1)})


def region_balls(areas: DataFrame) -> DataFrame:
    """Centre and radius of a ball around each region's box. Distance from the centre of a box is largest at a corner."""
    ring = lambda c: F.when(F.size(c) >= 3, F.flatten(F.transform(c, lambda p: F.array(p["lon"], p["lat"]))))
    side = lambda c, k, f: f(F.transform(c, lambda p: p[k]))
    box = areas.filter((F.size("outer_ring") >= 3) & F.col("area_id").isNotNull()).select(
        F.col("area_id").alias("id"), ring("outer_ring").alias("outer"), ring("hole_ring").alias("hole"),
        *(side("outer_ring", k, f).alias(f"{k}{n}") for k in ("lon", "lat") for n, f in ((0, F.array_min), (1, F.array_max))),
    )
    lat, lon = (F.col("lat0") + F.col("lat1")) / 2, (F.col("lon0") + F.col("lon1")) / 2
    half = F.radians((F.col("lon1") - F.col("lon0")) / 2)

    def to_corner(corner):
        h = F.pow(F.sin(F.radians(corner - lat) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(corner)) * F.pow(F.sin(half / 2), 2)
        return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))

    reach = F.when(half > math.pi / 2, math.pi * EARTH_M).otherwise(F.greatest(to_corner(F.col("lat0")), to_corner(F.col("lat1"))))
    return box.select("id", lat.alias("lat"), lon.alias("lon"), (reach + 1.0).alias("reach"), "outer", "hole")


def near_and_inside(sites: DataFrame, areas: DataFrame, radius: float = 25.0, *, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs of site rows of different sites within radius, and of areas with the site rows in them.

    Returns match_kind (site, area), key_a, key_b.
    """
    rows = located(sites)
    n = sites.count()
    few = min(MOST_PIVOTS, max(1, math.ceil(n / cell_rows)))
    hashed = rows.select("lat", "lon", F.xxhash64("lat", "lon").alias("h"))
    # hashes are even, so the lowest ones are below a small part of their range; only that part is moved
    part = min(1.0, 8.0 * few / max(n, 1))
    lowest = lambda df: df.distinct().orderBy("h", "lat", "lon").limit(few).collect()
    chosen = lowest(hashed.filter(F.col("h") <= int(-(2**63) + part * (2**64 - 1025)))) or lowest(hashed)
    if not chosen:
        return rows.select(F.lit("site").alias("match_kind"), F.col("site_row").alias("key_a"), F.col("site_row").alias("key_b")).limit(0)
    send = _assign(np.radians([r.lat for r in chosen]), np.radians([r.lon for r in chosen]))
    places = rows.groupBy("s1", "s2", "lat", "lon", "alt").agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    fields = "p1 bigint, p2 bigint, s1 bigint, s2 bigint, lat double, lon double, alt double, reach double"
    points = places.withColumn("reach", F.lit(float(radius))).select("p1", "p2", "s1", "s2", "lat", "lon", "alt", "reach").mapInPandas(send, fields + ", cell bigint, home boolean")
    points = checkpoint(points)  # read to count the cells, and to join
    hot = points.filter("home").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks")).filter("blocks > 1")
    regions = region_balls(areas).select(F.col("id").alias("p1"), "lat", "lon", "reach", "outer", "hole")
    regions = regions.mapInPandas(send, "p1 bigint, lat double, lon double, reach double, outer array<double>, hole array<double>, cell bigint, home boolean")
    none = lambda kind: F.lit(None).cast(kind)
    rings = none("array<double>")
    points = points.select("*", F.lit(False).alias("region"), rings.alias("outer"), rings.alias("hole"))
    zero = F.lit(0).cast("bigint")
    regions = regions.select("p1", zero.alias("p2"), zero.alias("s1"), zero.alias("s2"), "lat", "lon", none("double").alias("alt"), "reach", "cell", F.lit(False).alias("home"), F.lit(True).alias("region"), "outer", "hole")
    sent = points.unionAll(regions)
    if hot.isEmpty():
        sent = sent.withColumns({"own": F.lit(0), "part": F.lit(0), "block": F.lit(0)})
    else:
        sent = sent.join(hot, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        sent = sent.withColumn("own", F.pmod(F.xxhash64("p1", "p2"), F.col("blocks")).cast("int"))
        sent = sent.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))).drop("blocks")
        sent = sent.withColumns({"part": F.least("own", "k"), "block": F.when(F.col("home"), F.greatest("own", "k")).otherwise(F.col("k"))}).drop("k")
    pairs = sent.groupBy("cell", "part", "block").applyInPandas(lambda pdf: _join_cell(pdf, radius), _PAIR)
    # from places back to their recordings; a region stands for itself
    members = rows.select(F.col("p1").alias("b"), F.col("p2").alias("b2"), F.col("site_row").alias("y"))
    firsts = rows.select("p1", "p2", F.col("site_row").alias("x"))
    found = pairs.join(members, ["b", "b2"])
    found = found.join(firsts, (F.col("a") == F.col("p1")) & (F.col("a2") == F.col("p2")) & (F.col("kind") == "site"), "left")
    is_site = F.col("kind") == "site"
    return found.select(F.col("kind").alias("match_kind"), F.when(is_site, F.least("x", "y")).otherwise(F.col("a")).alias("key_a"), F.when(is_site, F.greatest("x", "y")).otherwise(F.col("y")).alias("key_b"))
