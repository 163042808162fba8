import numpy as np

from meshwright.operators.proximity import EARTH_M, VantagePointTree, great_circle, near_and_inside

SITES = "site_row bigint, plan_id string, site_name string, latitude double, longitude double, altitude double, id string, cell string, region string"
AREAS = "area_id bigint, outer_ring array<struct<lon double, lat double>>, hole_ring array<struct<lon double, lat double>>, lat double"
M = 180 / (np.pi * EARTH_M)  # degrees a metre at the equator


def _site(row, name, lat, lon, alt=None, plan="p"):
    return (row, plan, name, lat, lon, alt, "", "", "")


def _square(x, y, r):
    x, y, r = float(x), float(y), float(r)
    return [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r), (x - r, y - r)]


def _run(spark, sites, areas=(), **more):
    out = near_and_inside(spark.createDataFrame(list(sites), SITES), spark.createDataFrame(list(areas), AREAS), **more)
    return sorted(tuple(r) for r in out.collect())


def test_rules(spark):
    sites = [
        _site(1, "a", 1.0, 2.0, 5.0), _site(2, "b", 1.0 + 20 * M, 2.0, 5.0), _site(3, "c", 1.0, 2.0, 29.0), _site(4, "d", 1.0, 2.0, 31.0), _site(5, "A ", 1.0, 2.0, 5.0),
        _site(6, "e", 1.0, 2.0, -32768.0), _site(7, "n", None, 2.0), _site(8, "z", 0.0, 0.0), _site(9, "o", 91.0, 2.0), _site(10, None, 50.0, 7.0), _site(11, None, 50.0, 7.0),
        _site(12, "w", 10.0, 180.0), _site(13, "v", 10.0, -180.0 + 10 * M), _site(14, "u", 89.99999, 0.0), _site(15, "t", 89.99999, 180.0), _site(1, "a", 1.0, 2.0, 5.0),
    ]
    got = [x[1:] for x in _run(spark, sites) if x[0] == "site"]
    assert (1, 2) in got and (2, 5) in got and (1, 5) not in got  # one site, recorded twice
    assert (1, 3) in got and (1, 4) not in got and (3, 4) in got  # altitude counts
    assert (1, 6) in got and (4, 6) in got  # nodata does not
    assert (10, 11) in got and (12, 13) in got and (14, 15) in got  # no name; date line; pole
    assert not {7, 8, 9} & {i for p in got for i in p}
    assert got.count((1, 2)) == 2  # repeated rows each pair


def test_against_brute_force_with_any_cut(spark):
    rng = np.random.default_rng(5)
    lat, lon = 60 + rng.normal(0, 3e-3, 700), 179.999 + rng.normal(0, 5e-3, 700)
    lon = (lon + 180) % 360 - 180
    lat[:150], lon[:150] = 60.001, 10.0  # many sites at one place
    alt = np.where(rng.random(700) < 0.3, -32768.0, rng.integers(0, 40, 700))
    sites = [_site(i, f"s{i % 600}", float(lat[i]), float(lon[i]), float(alt[i])) for i in range(700)]
    want = []
    for i in range(700):
        for j in range(i + 1, 700):
            if i % 600 != j % 600:
                d = float(great_circle(*np.radians([lat[i], lon[i], lat[j], lon[j]])))
                z = 0 if -32768 in (alt[i], alt[j]) else alt[i] - alt[j]
                if (d * d + z * z) ** 0.5 <= 25:
                    want.append(("site", i, j))
    assert _run(spark, sites) == sorted(want)
    assert _run(spark, sites, cell_rows=40, block_rows=15) == sorted(want)


def test_regions(spark):
    sites = [_site(1, "in", 0.5, 0.5), _site(2, "hole", 0.0, 0.01), _site(3, "out", 3.0, 3.0), _site(4, "north", 80.2, 20.0)]
    hole = _square(0.0, 0.0, 0.1)
    areas = [(100, _square(0, 0, 1), hole, 1.0), (101, _square(0, 0, 1)[::-1], None, 1.0), (102, _square(20, 80, 1), None, 1.0), (103, None, None, 1.0), (104, [(0.0, 0.0), (9.0, 9.0)], None, 1.0)]
    assert _run(spark, sites, areas) == [("area", 100, 1), ("area", 101, 1), ("area", 101, 2), ("area", 102, 4)]
    assert _run(spark, sites, areas, cell_rows=1, block_rows=1) == [("area", 100, 1), ("area", 101, 1), ("area", 101, 2), ("area", 102, 4)]


def test_empty(spark):
    assert _run(spark, []) == []
    assert _run(spark, [_site(1, "a", None, None)], [(1, _square(0, 0, 1), None, 0.0)]) == []


def test_tree_finds_all():
    rng = np.random.default_rng(1)
    lat, lon = np.radians(rng.uniform(-90, 90, 800)), np.radians(rng.uniform(-180, 180, 800))
    tree = VantagePointTree(lat, lon, leaf=5)
    got = sorted((int(a), int(b)) for q, p in tree.query(lat, lon, np.full(800, 4e5)) for a, b in zip(q, p, strict=True))
    d = great_circle(lat[:, None], lon[:, None], lat[None], lon[None])
    assert got == sorted(map(tuple, np.argwhere(d <= 4e5).tolist()))
