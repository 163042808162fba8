import pandas as pd
import pytest

from meshwright.operators import buildings as bl
from meshwright.operators import graph
from meshwright.plans.pipeline import LosRules, candidate_network, cover_clients, two_way_edges

RINGS = "building_id bigint, ring array<struct<lon double, lat double>>"


def _square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]


def test_clip():
    window = [(0, 0), (0, 2), (2, 2), (2, 0)]  # either turn
    assert sorted(bl.clip_ring([(1, 1), (3, 1), (3, 3), (1, 3)], window)) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert bl.clip_ring([(5, 5), (6, 5), (6, 6)], window) == []


def test_candidates(spark):
    shapes = spark.createDataFrame([(1, _square(0.0, 0.0, 0.001)), (2, [(0.002, 0.0), (0.003, 0.0), (0.0025, 0.0008), (0.002, 0.0)]), (3, None), (4, _square(9.0, 9.0, 1e-6))], RINGS)
    cut = {r.building_id: len(r.ring) for r in bl.clipped(shapes, [(0.0, -1.0), (0.0025, -1.0), (0.0025, 1.0), (0.0, 1.0)]).collect()}
    assert cut == {1: 4, 2: 3}
    found = bl.corners(shapes.filter("building_id < 3"))
    assert found.filter("building_id = 1").count() == 4 and {round(r.angle) for r in found.filter("building_id = 1").collect()} == {90}
    assert bl.spread_corners(found).filter("building_id = 1").count() == 3
    at = {r.building_id: (r.lon, r.lat) for r in bl.centers(shapes.filter("building_id < 3")).collect()}
    assert at[1] == (pytest.approx(0.0005), pytest.approx(0.0005))
    cells = spark.createDataFrame([(0.0002, 0.0002, 5.0), (0.0009, 0.0009, 9.0), (0.0015, 0.0005, 99.0)], "lon double, lat double, z double")
    assert [(r.building_id, r.z) for r in bl.highest(shapes.filter("building_id < 3"), cells).collect()] == [(1, 9.0)]


def test_inputs(spark):
    data = [("UNKNOWN", None, None, 10.0, 2.0), ("UNKNOWN", None, None, 3.0, 2.0), ("UNKNOWN", 7.0, 3.0, 3.0, 2.0), ("ROOFTOP", None, 4.0, 3.0, 2.0), ("UNKNOWN", None, None, None, 2.0)]
    df = spark.createDataFrame(data, "location_type string, altitude double, height double, surface double, terrain double")
    assert [(r.location_type, r.altitude) for r in bl.locate_inputs(df).collect()] == [("ROOFTOP", 11.5), ("STREET_LEVEL", 7.0), ("STREET_LEVEL", 7.0), ("ROOFTOP", 6.0), ("UNKNOWN", 7.0)]


def test_candidate_network(spark):
    k = 0.0009  # about 100 m
    rows = [("s", "p", "POP", 0.0, 0.0, 20.0), ("a", "p", "DN", k, 0.0, 20.0), ("c", "p", "CN", 2 * k, 0.0, 20.0), ("e", "p", "CN", k, k, 20.0), ("wall", "q", "DN", 1.5 * k, 0.0, 60.0), ("far", "p", "DN", 1.0, 0.0, 20.0), ("null", "p", "DN", 0.0, k, None)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "site_id string, plan_id string, site_type string, lon double, lat double, alt double, building_id bigint, location_type string")
    got = sorted((r.tx_id, r.rx_id) for r in candidate_network(df, LosRules(cell_m=5.0)).collect())
    # the wall between a and c blocks that pair and the longer one from s
    assert got == [("a", "e"), ("a", "s"), ("s", "a"), ("s", "e")]


NET = [(graph.SOURCE, "s", "SOURCE")] + [(x, y, "WIRELESS") for u, v in ("sa", "sb", "ad", "bd", "de") for x, y in ((u, v), (v, u))] + [("a", "c1", "WIRELESS"), ("d", "c2", "WIRELESS"), ("d", "c3", "WIRELESS"), ("e", "c2", "WIRELESS")] + [(c, f"demand:{c}", "DEMAND") for c in ("c1", "c2", "c3")]


def test_cover_and_two_ways():
    df = pd.DataFrame(NET, columns=["src", "dst", "kind"])
    steps = [tuple(r) for r in cover_clients(df).itertuples(index=False)]
    assert steps == [(1, "s", 0), (2, "a", 1), (3, "d", 2)]
    got = {(r.src, r.dst): r.relays for r in two_way_edges(df).itertuples()}
    # a, b and d have two ways each, e hangs on d
    assert got == {("s", "a"): 3, ("s", "b"): 3, ("a", "d"): 2, ("b", "d"): 2, ("d", "a"): 1, ("d", "b"): 1}
