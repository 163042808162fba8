import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshwright.operators import graph, interference, los, raster
from meshwright.operators.rangejoin import nearest, radius_join
from meshwright.operators.topology import Network, close_angle_pairs, nearest_sector, sector_azimuths, set_status, with_reverse


def _edges(spark, rows):
    return spark.createDataFrame([(a, b, float(c)) for a, b, c in rows], "src string, dst string, cost double")


def test_shortest_routes_and_zones(spark):
    edges = _edges(spark, [("p", "a", 1), ("a", "b", 1), ("p", "b", 5), ("b", "c", 1), ("q", "c", 3), ("c", "d", 1), ("x", "y", 1), ("d", "p", 1), ("a", "z", float("inf"))])
    starts = spark.createDataFrame([("p",), ("q",)], "node string")
    paths = graph.shortest(starts, edges)
    got = {r.node: (r.cost, r.parent) for r in paths.collect()}
    assert got == {"p": (0.0, None), "q": (0.0, None), "a": (1.0, "p"), "b": (2.0, "a"), "c": (3.0, "b"), "d": (4.0, "c")}
    assert {r.node: r.hops for r in graph.hops(starts, edges.filter("dst <> 'z'")).collect()} == {"p": 0, "q": 0, "a": 1, "b": 1, "c": 1, "d": 2}
    used = {(r.src, r.dst) for r in graph.route_edges(paths, spark.createDataFrame([("c",), ("nowhere",)], "node string")).collect()}
    assert used == {("p", "a"), ("a", "b"), ("b", "c")}
    assert {r.node: r.zone for r in graph.zones(paths).collect()} == {"p": "p", "q": "q", "a": "p", "b": "p", "c": "p", "d": "p"}
    assert graph.shortest(starts.limit(0), edges).count() == 0


def test_network_changes(spark):
    sites = spark.createDataFrame([("a", "DN", "PROPOSED"), ("b", "DN", "CANDIDATE"), ("c", "CN", "EXISTING")], "site_id string, site_type string, status string")
    links = spark.createDataFrame([("a-b", "a", "b", "a0", "b0"), ("b-c", "b", "c", "b0", "c0")], "link_id string, tx_id string, rx_id string, tx_sector string, rx_sector string")
    sectors = spark.createDataFrame([("a0", "a"), ("b0", "b"), ("c0", "c")], "sector_id string, site_id string")
    net = Network(sites, links, sectors, spark.createDataFrame([("d", ["a"])], "demand_id string, sites array<string>"))
    ids = lambda df, c: sorted(r[c] for r in df.collect())
    cut = net.without_sites(sites.filter("site_id = 'c'"))
    assert ids(cut.links, "link_id") == ["a-b"] and ids(cut.sectors, "sector_id") == ["a0", "b0"]
    assert {(r.link_id, r.tx_sector, r.rx_sector) for r in net.without_sectors(sectors.filter("sector_id = 'c0'")).links.collect()} == {("a-b", "a0", "b0"), ("b-c", None, None)}
    new = spark.createDataFrame([("b-a", "b", "a", None, None), ("a-b", "a", "b", None, None), ("a-x", "a", "x", None, None)], links.schema)
    assert ids(net.with_links(new).links, "link_id") == ["a-b", "b-a", "b-c"]
    assert ids(net.with_demands(spark.createDataFrame([("d", ["b"]), ("e", ["c"])], "demand_id string, sites array<string>")).demands, "demand_id") == ["d", "e"]
    wanted = spark.createDataFrame([("a", "UNREACHABLE"), ("b", "EXISTING"), ("c", "PROPOSED")], "site_id string, new_status string")
    assert {r.site_id: r.status for r in set_status(sites, "site_id", wanted).collect()} == {"a": "UNREACHABLE", "b": "CANDIDATE", "c": "EXISTING"}
    assert {r.link_id: r.reverse_link_id for r in with_reverse(net.with_links(new).links, "link_id").collect()} == {"a-b": "b-a", "b-a": "a-b", "b-c": None}


def test_radius_join_against_brute_force(spark):
    rng = random.Random(1)
    points = [(f"p{i}", rng.choice([179.9995, -179.9995, 10.0]) + rng.uniform(-5e-4, 5e-4), rng.choice([0.0, 60.0, 89.999, -89.9995]) + rng.uniform(-4e-4, 4e-4)) for i in range(120)]
    points = [(i, (x + 180) % 360 - 180, y) for i, x, y in points]
    a = spark.createDataFrame(points, "l string, l_lon double, l_lat double")
    b = spark.createDataFrame(points, "r string, r_lon double, r_lat double")
    from meshwright.functions.geo import haversine

    want = sorted((x.l, x.r) for x in a.crossJoin(b).filter(haversine("l_lon", "l_lat", "r_lon", "r_lat") <= 60).select("l", "r").collect())
    got = sorted((x.l, x.r) for x in radius_join(a, b, 60.0).select("l", "r").collect())
    assert got == want and len(got) > 200
    best = nearest(a, b.filter("r <> 'p0'"), 60.0, left_id="l", right_id="r").filter("l = 'p5'").collect()
    assert best[0].r == "p5" and best[0].distance_m == 0.0


def test_angles_and_sectors(spark):
    links = spark.createDataFrame([("t", 1, 359.0, 10.0), ("t", 2, 5.0, 40.0), ("t", 3, 100.0, 10.0), ("u", 4, 1.0, 10.0), ("t", 5, 22.0, 5.0)], "tx_id string, link_row bigint, azimuth double, length_m double")
    assert sorted((r.first, r.second, r.angle) for r in close_angle_pairs(links, 25.0).collect()) == [(1, 2, 6.0), (1, 5, 23.0), (2, 5, 17.0)]
    r = spark.range(1).select(sector_azimuths(F.lit(4)).alias("a")).select(nearest_sector(F.col("a"), F.lit(350.0), 90.0), nearest_sector(F.col("a"), F.lit(45.0), 60.0)).collect()[0]
    assert (r[0]["position"], r[0]["off"]) == (0, 10.0) and r[1] is None


def test_raster(spark):
    cells = spark.createDataFrame([(1, 0, 0, 5.0), (1, 1, 0, raster.NODATA), (1, 5, 5, 9.0)], "zone int, ix bigint, iy bigint, z double")
    assert {(r.ix, r.iy): r.z for r in raster.fill_nodata(cells, 2).collect()} == {(0, 0): 5.0, (1, 0): 5.0, (5, 5): 9.0}
    at = spark.createDataFrame([("a", 1, 10.4, 0.0), ("b", 1, 2000.0, 0.0)], "id string, zone int, x double, y double")
    assert {r.id: r.z for r in raster.sample(at, cells, 10.0, 2).collect()} == {"a": 5.0, "b": 7.0}
    assert raster.refine(cells, 3).count() == 27 and raster.within(cells, 0, 0, 10, 0, 10.0).count() == 2
    assert {r.z for r in raster.combine(cells, cells).collect()} == {10.0, raster.NODATA, 18.0}


def test_line_of_sight(spark):
    pairs = spark.createDataFrame([("p", 1, 0.0, 0.0, 10.0, 100.0, 0.0, 10.0, 4.0)], "pair_id string, zone int, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, radius double")

    def confidence(cells, model=los.cylinder_confidence, threshold=0.1):
        df = spark.createDataFrame([(1, x, y, float(z)) for x, y, z in cells], "zone int, ix bigint, iy bigint, z double")
        return model(pairs, df, 1.0, threshold).collect()[0].confidence

    assert confidence([]) == 1.0 and confidence([(50, 0, 20)]) == 0.0
    assert confidence([(50, 2, 20)]) == pytest.approx(0.5) and confidence([(50, 0, 8)]) == pytest.approx(0.5) and confidence([(50, 9, 99), (-5, 0, 99), (50, 1, 1)]) == 1.0
    assert confidence([(50, 1, 20)], threshold=0.5) == 0.0
    e = los.ellipsoid_confidence
    assert confidence([(50, 2, 20)], e) == pytest.approx(0.5) and confidence([(50, 0, 8)], e) == pytest.approx(0.5) and confidence([(25, 0, 8)], e) == pytest.approx(2 / (0.75**0.5) / 4)


def test_interference(spark):
    schema = "link_row bigint, tx_id string, rx_id string, tx_sector string, rx_sector string, azimuth double, gain double, tx_power double"
    links = spark.createDataFrame([(1, "a", "b", "a0", "b0", 0.0, -70.0, 10.0), (2, "c", "b", "c0", "b0", 0.0, -80.0, 10.0), (3, "c", "d", "c0", "d0", 0.0, -60.0, 10.0)], schema)
    # c sends to d while a sends to b: what reaches b is c's level on the path to b
    got = {r.link_row: r.mw for r in interference.interference(links).collect()}
    assert got == {1: pytest.approx(1e-7)}
    done = {r.link_row: r for r in interference.power_control(links, -74.0, 16.0, 0.0).collect()}
    assert done[3].mcs == 12 and done[3].tx_power <= 10.0 and done[1].sinr <= 14.0


def _simulated_anew(edges, link_availability, horizon, seed):
    """The same run of failures with everything reached found anew after each."""
    import heapq

    g = graph.Graph(list(edges["src"]), list(edges["dst"]))
    pairs = sorted({(min(a, b), max(a, b)) for a, b, k in edges[["src", "dst", "kind"]].itertuples(index=False, name=None) if k == "WIRELESS"})
    rng = np.random.default_rng(seed)
    events = [(float(rng.exponential(link_availability)), i, True) for i in range(len(pairs))]
    heapq.heapify(events)
    down, up, now = set(), dict.fromkeys(g.names, 0.0), 0.0
    while now < horizon:
        t, i, fails = heapq.heappop(events) if events else (horizon, -1, True)
        gone = {e for k in down for a, b in [pairs[k]] for e in ((g.at[a], g.at[b]), (g.at[b], g.at[a]))}
        for n in g.reached(g.at["SUPERSOURCE"], gone):
            up[g.names[n]] += min(t, horizon) - now
        now = min(t, horizon)
        (down.add if fails else down.discard)(i)
        heapq.heappush(events, (t + float(rng.exponential(1 - link_availability if fails else link_availability)), i, not fails))
    return {n: x / horizon for n, x in up.items() if n.startswith("demand:")}


def test_availability_against_reaching_anew():
    rng = np.random.default_rng(1)
    for trial in range(25):
        n = int(rng.integers(3, 25))
        rows, seen = [("SUPERSOURCE", f"s{i}", "SOURCE") for i in range(int(rng.integers(1, 3)))], set()
        for _ in range(int(rng.integers(n, 3 * n))):
            a, b = (int(x) for x in rng.choice(n, 2, replace=False))
            if not {(a, b), (b, a)} & seen:
                seen.add((a, b))
                kind = "WIRED" if rng.random() < 0.1 else "WIRELESS"
                rows += [(f"s{a}", f"s{b}", kind), (f"s{b}", f"s{a}", kind)][: 1 + (rng.random() < 0.7)]
        rows += [(f"s{i}", f"demand:s{i}", "DEMAND") for i in range(n) if rng.random() < 0.6]
        edges = pd.DataFrame(rows, columns=["src", "dst", "kind"])
        for share in (0.6, 0.95):
            got = graph.availability(edges, share, 20.0, trial)
            want = _simulated_anew(edges, share, 20.0, trial)
            assert dict(zip(got.demand, got.availability, strict=True)) == pytest.approx(want, abs=1e-9)
