"""Queries over the whole of their input: small tables, and SQL of the registry without the condition that cuts it."""

import math
import random
import time
from datetime import datetime
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from meshwright.operators import graph, outages
from meshwright.plans import networks
from meshwright.plans.pipeline import LosRules, candidate_network, cover_clients, two_way_edges

SF = Path("/root/testdata/sf0.001")
SITE = "site_row bigint, plan_id string, site_name string, site_type string, latitude double, longitude double, altitude double, device_sku string, site_status string, location_type string, building_id bigint, subscribers bigint, recorded_at timestamp"
LINK = "link_row bigint, plan_id string, tx_site string, rx_site string, link_status string, is_wireless boolean, confidence double, mcs bigint, snr double, capacity_gbps double"


def _folder(spark, path, sites, links=()):
    """sites: name, type, lat, lon, alt; links: from, to; all of plan p."""
    at = datetime(2024, 1, 1)
    rows = [(i, "p", n, t, lat, lon, alt, None, "PROPOSED", None, None, None, at) for i, (n, t, lat, lon, alt) in enumerate(sites)]
    spark.createDataFrame(rows, SITE).write.parquet(f"{path}/sites.parquet")
    rows = [(i, "p", a, b, "PROPOSED", True, 1.0, 9, 20.0, 1.0) for i, (a, b) in enumerate(links)]
    spark.createDataFrame(rows, LINK).write.parquet(f"{path}/links.parquet")
    return str(path)


def test_interference_at_clients(spark, tmp_path):
    at = lambda bearing, m: (m / 111_195 * math.cos(math.radians(bearing)), m / 111_195 * math.sin(math.radians(bearing)))
    sites = [("s", "POP", 0.001, 0.001, 20.0), *((n, t, 0.001 + y, 0.001 + x, 20.0) for n, t, (y, x) in (("a", "DN", at(70, 100)), ("c", "CN", at(72, 200)), ("e", "CN", at(68, 200))))]
    d = _folder(spark, tmp_path, sites, [("s", "a"), ("s", "c"), ("a", "c"), ("a", "e")])
    run = lambda name: {r.link_row: r for r in entry.queries()[name](spark, d).collect()}
    levels = {r.path_row: r.dbm for r in entry.queries()["intf_path_levels"](spark, d).collect()}
    assert set(levels) == {0, 1, 2, 3}  # each sender has another link in its sector
    # c is hit by s over its link from a and the other way; nothing else sends to a or e
    assert set(run("intf_rsl_map")) == {1, 2}
    assert set(run("intf_sinr")) == set(run("intf_tpc_converged")) == {0, 1, 2, 3}


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["intf_path_levels", "intf_rsl_map", "intf_sinr"])
def test_interference_against_sql(spark, name):
    con = pytest.importorskip("duckdb").connect()
    for t in ("sites", "links"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(entry.oracle_sql()[name]).fetchall()
    got = entry.queries()[name](spark, str(SF)).collect()
    near = lambda rows: {r[0]: r[1] for r in rows}
    assert len(got) == len(want) and near(got) == pytest.approx(near(want), abs=1.1e-3)


BORDERS = {"zones": (0.0005, 6.0), "equator": (0.0, 3.0), "date_line": (0.0005, 180.0), "high": (80.0, 12.0)}


def _across(border, *metres):
    lat, lon = BORDERS[border]
    off = lambda m: (m / 111_195, 0.0) if border == "equator" else (0.0, m / 111_195 / math.cos(math.radians(lat)))
    return [(lat + off(m)[0], (lon + off(m)[1] + 180) % 360 - 180) for m in metres]


@pytest.mark.parametrize("border", BORDERS)
def test_pairs_over_a_border(spark, border):
    # three plans: a clear pair and two with a wall on either side of the border, 100 m from each other
    rows = []
    for i, (plan, wall) in enumerate((("clear", None), ("near", -20), ("beyond", 20))):
        shift = lambda p, i=i: (p[0], p[1] + 0.01 * i) if border == "equator" else (p[0] + 0.01 * i, p[1])
        a, b = map(shift, _across(border, -60, 60))
        rows += [(f"{plan}/a", plan, "DN", *a, 20.0, None, None), (f"{plan}/b", plan, "DN", *b, 20.0, None, None)]
        rows += [(f"{plan}/w", "walls", "DN", *shift(p), 60.0, None, None) for p in _across(border, *([] if wall is None else [wall]))]
    df = spark.createDataFrame(rows, "site_id string, plan_id string, site_type string, lat double, lon double, alt double, building_id bigint, location_type string")
    got = sorted((r.tx_id, r.rx_id) for r in candidate_network(df, LosRules(cell_m=0.02)).collect())
    assert got == [("clear/a", "clear/b"), ("clear/b", "clear/a")]


def test_no_link_through_a_zone(spark):
    square = lambda x, y, r: [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r), (x - r, y - r)]
    schema, zone = "site_id string, plan_id string, site_type string, lat double, lon double, alt double, building_id bigint, location_type string", "ring array<struct<lon double, lat double>>"
    for border in ("date_line", "equator"):
        (a_lat, a_lon), (b_lat, b_lon) = _across(border, -60, 60)
        places = spark.createDataFrame([("a", "p", "DN", a_lat, a_lon, 20.0, None, None), ("b", "p", "DN", b_lat, b_lon, 20.0, None, None)], schema)
        run = lambda *rings, places=places: candidate_network(places, LosRules(cell_m=0.02), spark.createDataFrame([(r,) for r in rings], zone)).count()
        assert run() == 2 and run(square(a_lon, a_lat + 0.01, 0.001)) == 2 and run(None, [(0.0, 0.0)]) == 2
        assert run(square(b_lon, b_lat, 0.0001)) == 0  # the far end is inside
        between = (a_lon if border == "equator" else -179.99995, (a_lat + b_lat) / 2)
        assert run(square(*between, 0.00002)) == 0  # only the line passes


@pytest.mark.parametrize("name", ["los_cylinder", "los_ellipsoid"])
def test_sight_over_a_border(spark, tmp_path, name):
    ends = {(b, k): p for b in BORDERS for k, p in zip("xy", _across(b, -60, 60), strict=True)}
    d = _folder(spark, tmp_path, [(f"{b}{k}", "DN", *p, 20.0) for (b, k), p in ends.items()], [(f"{b}x", f"{b}y") for b in BORDERS])
    assert sorted(r.pair_id for r in entry.queries()[name](spark, d).collect()) == sorted(f"p/{b}x>p/{b}y" for b in BORDERS)


def test_grid_at_high_latitude(spark, tmp_path):
    d = _folder(spark, tmp_path, [("a", "CN", 79.0, 10.0, 1.0), ("b", "CN", 81.75, 12.0, 1.0)])
    (got,) = entry.queries()["demand_uniform_grid"](spark, d).collect()
    assert (got.points, got.last_column, got.last_row) == (5 * 7, 4, 6)


def test_availability_over_the_whole_time(spark, tmp_path):
    clients = [f"c{i}" for i in range(40)]
    d = _folder(spark, tmp_path, [("s", "POP", 1.0, 1.0, 20.0), *((c, "CN", 1.0 + i / 1e4, 1.001, 20.0) for i, c in enumerate(clients))], [("s", c) for c in clients])
    got = [r.availability for r in entry.queries()["graph_availability"](spark, d).collect()]
    # each hangs on one link, which fails about 100 times in that time
    assert len(got) == 40 and max(got) < 1.0 and sum(got) / 40 == pytest.approx(0.999, abs=2e-4)


def _network(links, sources, clients):
    """A plan's graph as pandas rows in the order that kernels get."""
    rows = [("SUPERSOURCE", s, "SOURCE") for s in sources] + [(a, b, "WIRELESS") for a, b in links] + [(c, f"demand:{c}", "DEMAND") for c in clients]
    return pd.DataFrame(rows, columns=["src", "dst", "kind"]).sort_values(["src", "dst"], kind="stable")


def _random_network(rng):
    n = rng.randint(2, 25)
    links = {(f"s{a}", f"s{b}") for _ in range(rng.randint(1, 3 * n)) for a, b in [rng.sample(range(n), 2)]}
    links |= {(b, a) for a, b in links if rng.random() < 0.7}
    return _network(sorted(links), [f"s{i}" for i in rng.sample(range(n), min(n, rng.randint(1, 3)))], [f"s{i}" for i in range(n) if rng.random() < 0.5])


def _within(seconds, kernel, edges):
    began = time.process_time()
    out = kernel(edges)
    assert time.process_time() - began < seconds
    return out


def _covered_by_trying_all(edges):
    ends = {k: [(a, b) for a, b, x in edges.itertuples(index=False, name=None) if x == k] for k in ("SOURCE", "WIRELESS", "DEMAND")}
    homes, ready, used, covered, out = {a for a, _ in ends["DEMAND"]}, {b for _, b in ends["SOURCE"]}, set(), set(), []
    near = lambda n, home: {b for a, b in ends["WIRELESS"] if a == n and (b in homes) == home}
    gain = lambda n: near(n, True) - covered
    while ready:
        best = min(ready, key=lambda n: (-len(gain(n)), n))
        if not gain(best):
            best = min((n for n in ready if any(gain(x) for x in near(n, False) - used)), default=None)
            if best is None:
                break
        out.append((len(out) + 1, best, len(gain(best))))
        covered |= gain(best)
        used.add(best)
        ready = (ready | near(best, False)) - used
    return out


def test_cover_clients():
    rng = random.Random(1)
    for _ in range(300):
        edges = _random_network(rng)
        assert list(cover_clients(edges).itertuples(index=False, name=None)) == _covered_by_trying_all(edges)
    n = 8000
    links = [x for i in range(n) for x in (("s", f"r{i}"), (f"r{i}", f"c{i}"))]
    out = _within(4, cover_clients, _network(links, ["s"], [f"c{i}" for i in range(n)]))
    assert len(out) == n + 1 and out["clients"].sum() == n


def _second_path_by_search(edges):
    g = graph.Graph(list(edges["src"]), list(edges["dst"]))
    out = []
    for n, name in enumerate(g.names):
        if name.startswith("demand:") and (path := g.path(g.at["SUPERSOURCE"], n)):
            used = {e for a, b in zip(path[1:-3], path[2:-2], strict=False) for e in ((a, b), (b, a))}
            out.append((name, len(path) - 3, bool(used) and g.path(g.at["SUPERSOURCE"], n, used) is not None))
    return out


def test_disjoint_paths():
    rng = random.Random(2)
    for _ in range(300):
        edges = _random_network(rng)
        assert list(graph.disjoint(edges).itertuples(index=False, name=None)) == _second_path_by_search(edges)
    # chains of three relays, each joined at its end to the next one's and with a client there
    n = 1500
    links = [x for i in range(n) for x in ((f"s{i}", f"a{i}"), (f"a{i}", f"b{i}"), (f"b{i}", f"c{i}"), (f"c{i}", f"c{(i + 1) % n}"), (f"c{i}", f"k{i}"))]
    out = _within(4, graph.disjoint, _network(links, [f"s{i}" for i in range(n)], [f"k{i}" for i in range(n)]))
    assert len(out) == n and set(out["hops"]) == {4} and out["two_paths"].all()


def _two_ways_by_search(edges):
    sources, homes = {b for _, b, k in edges.itertuples(index=False) if k == "SOURCE"}, {a for a, _, k in edges.itertuples(index=False) if k == "DEMAND"}
    real = [(a, b) for a, b, k in edges.itertuples(index=False) if k == "WIRELESS" and b not in sources | homes]
    relays, count = sorted({b for _, b in real}), {}
    out = {}
    for a, b in [((a, "out"), (b, "in")) for a, b in real] + [((n, "in"), (n, "out")) for n in relays]:
        out.setdefault(a, []).append(b)
    for relay in relays:
        flow = set()
        for ways in range(3):
            parent = {(s, "out"): None for s in sorted(sources, key=lambda s: f"{s}|out")}
            queue = list(parent)
            for n in queue:
                for m in [m for m in out.get(n, ()) if (n, m) not in flow] + [a for a, b in flow if b == n]:
                    if m not in parent:
                        parent[m] = n
                        queue.append(m)
            n = (relay, "in")
            if ways == 2 or n not in parent:
                break
            while p := parent[n]:
                flow.symmetric_difference_update([(n, p) if (n, p) in flow else (p, n)])
                n = p
        for (a, side), (b, _) in flow if ways == 2 else ():
            if side == "out":
                count[a, b] = count.get((a, b), 0) + 1
    return [(a, b, n) for (a, b), n in sorted(count.items())]


def test_two_way_edges():
    rng = random.Random(3)
    for _ in range(300):
        edges = _random_network(rng)
        assert list(two_way_edges(edges).itertuples(index=False, name=None)) == _two_ways_by_search(edges)
    n = 700
    links = [x for i in range(n) for x in ((f"s{i}", f"a{i}"), (f"a{i}", f"b{i}"), (f"b{i}", f"c{i}"), (f"c{i}", f"c{(i + 1) % n}"))]
    out = _within(4, two_way_edges, _network(links, [f"s{i}" for i in range(n)], []))
    assert len(out) == 4 * n and out["relays"].sum() == 7 * n  # only the ends have two, over three and four links
    # a second path that must take back a part of the first
    edges = _network([("s", "a"), ("a", "d"), ("d", "z"), ("s", "b"), ("b", "d"), ("a", "e"), ("e", "f"), ("f", "z")], ["s"], [])
    assert list(two_way_edges(edges).itertuples(index=False, name=None)) == _two_ways_by_search(edges) != []


def test_outages_against_reaching_anew():
    rng = random.Random(4)
    for trial in range(150):
        edges = _random_network(rng)
        g = graph.Graph(list(edges["src"]), list(edges["dst"]))
        pairs = sorted({(min(a, b), max(a, b)) for a, b, k in edges.itertuples(index=False) if k == "WIRELESS" and rng.random() < 0.9})
        pair_of = {e: k for k, (a, b) in enumerate(pairs) for e in ((g.at[a], g.at[b]), (g.at[b], g.at[a]))}
        net, draws, up = outages.Outages(g, g.at["SUPERSOURCE"], pair_of, len(pairs)), np.random.default_rng(trial), rng.choice([0.6, 0.9, 0.99])
        want, down = np.zeros(len(g.names)), draws.random(len(pairs)) < 0.2
        for _ in range(2):
            link, start, end, after = outages.draw(len(pairs), up, 1 - up, 5.0, down, draws)
            assert set(link[start == 0]) == set(np.flatnonzero(down)) and set(link[end == 5.0]) == set(np.flatnonzero(after))
            net.add(link, start, end, 5.0, 1 - up)
            cuts, down = sorted({0.0, 5.0, *start, *end}), after
            for a, b in zip(cuts, cuts[1:], strict=False):
                gone = {int(k) for k in link[(start <= (a + b) / 2) & (end > (a + b) / 2)]}
                want[[n for n in range(len(want)) if n not in g.reached(g.at["SUPERSOURCE"], {e for e, k in pair_of.items() if k in gone})]] += b - a
        for n, i in net.number.items():
            assert net.lost[i] == pytest.approx(want[n], abs=1e-9)
        assert all(want[n] == pytest.approx(10.0) for n in range(len(want)) if n not in net.number)


def test_availability_of_many_links():
    n = 2000  # two relays in turn behind each source; a client hears the second one, every other client the next one too
    links = [x for i in range(n) for x in ((f"s{i}", f"a{i}"), (f"a{i}", f"b{i}"), (f"b{i}", f"k{i}"), *([(f"b{(i + 1) % n}", f"k{i}")] if i % 2 else []))]
    edges = _network(links, [f"s{i}" for i in range(n)], [*(f"k{i}" for i in range(n)), "far"])
    got = _within(25, lambda e: outages.availability(e, 0.999, 100.0, 7), edges)
    by = dict(zip(got["demand"], got["availability"], strict=True))
    one, two = (np.array([by[f"demand:k{i}"] for i in range(k, n, 2)]) for k in (0, 1))
    assert len(got) == n + 1 and by["demand:far"] == 0.0
    assert one.mean() == pytest.approx(0.999**3, abs=1e-4) and 1 - two.mean() == pytest.approx((1 - 0.999**3) ** 2, rel=0.3)
    deep = _network([(f"r{i}", f"r{i + 1}") for i in range(200)], ["r0"], ["r200"])
    assert 0.7 < outages.availability(deep, 0.999, 100.0, 7)["availability"][0] < 0.9  # 0.999 ** 200 is 0.82


def test_queries_of_availability_at_size(spark, tmp_path):
    n = 900
    sites = [(f"{k}{i}", t, 1.0 + i / 1e4, 1.0 + j / 1e4, 20.0) for i in range(n) for j, (k, t) in enumerate((("s", "POP"), ("a", "DN"), ("b", "DN"), ("k", "CN")))]
    d = _folder(spark, tmp_path, sites, [x for i in range(n) for x in ((f"s{i}", f"a{i}"), (f"a{i}", f"b{i}"), (f"b{i}", f"k{i}"))])
    began = time.time()
    (row,) = entry.queries()["agg_availability_percentiles"](spark, d).collect()
    assert time.time() - began < 20 and row["mean"] == pytest.approx(0.999**3, abs=2e-4)


def test_outages_of_links_without_another_way(monkeypatch):
    # a tree: what hangs on a link that is down is lost, whatever else is down
    asked = []
    monkeypatch.setattr(outages.Outages, "_one_by_one", lambda *a: asked.append(a))
    links = [x for i in range(300) for x in (("s", f"a{i}"), (f"a{i}", f"b{i}"), (f"a{i}", f"k{i}"))]
    edges = _network(links, ["s"], [f"k{i}" for i in range(300)])
    got = outages.availability(edges, 0.999, 100.0, 7)
    assert got["availability"].mean() == pytest.approx(0.999**2, abs=1e-4) and len(asked) < 20  # those that meet two outages above
    assert outages.availability(edges.sample(frac=1, random_state=1), 0.999, 100.0, 7).equals(got)


def test_outages_of_wanted_nodes():
    rng = random.Random(5)
    for trial in range(100):
        edges = _random_network(rng)
        g = graph.Graph(list(edges["src"]), list(edges["dst"]))
        pairs = sorted({(min(a, b), max(a, b)) for a, b, k in edges.itertuples(index=False) if k == "WIRELESS"})
        pair_of = {e: k for k, (a, b) in enumerate(pairs) for e in ((g.at[a], g.at[b]), (g.at[b], g.at[a]))}
        wanted = {n for n in range(len(g.names)) if rng.random() < 0.3}
        whole, part = (outages.Outages(g, g.at["SUPERSOURCE"], pair_of, len(pairs), w) for w in (None, wanted))
        link, start, end, _ = outages.draw(len(pairs), 0.9, 0.1, 5.0, np.zeros(len(pairs), bool), np.random.default_rng(trial))
        for net in (whole, part):
            net.add(link, start, end, 5.0, 0.1)
        assert [part.lost[part.number[n]] for n in wanted if n in part.number] == pytest.approx([whole.lost[whole.number[n]] for n in wanted if n in whole.number])


@pytest.mark.parametrize("up", [0.999, 0.7, 0.3])
def test_draw_alternates(up):
    rng, down, lasts, shares, failures = np.random.default_rng(3), np.zeros(500, bool), [], [], 0
    for _ in range(3):
        link, start, end, down = outages.draw(500, up, 1 - up, 40.0, down, rng)
        assert (np.diff(link) >= 0).all() and ((start[1:] >= end[:-1]) | (link[1:] != link[:-1])).all() and start.min() >= 0 and end.max() <= 40.0
        lasts.append((end - start)[(start > 0) & (end < 40.0)].mean())
        shares.append((end - start).sum() / (500 * 40.0))
        failures += len(link)
    assert np.mean(lasts) == pytest.approx(1 - up, rel=0.05) and np.mean(shares) == pytest.approx(1 - up, rel=0.05)
    assert failures == pytest.approx(500 * 120, rel=0.05)


def test_available_links_without_sorting(spark, tmp_path):
    at = datetime(2024, 1, 1)
    names = [("s", "POP", "PROPOSED"), ("a", "DN", "EXISTING"), ("b", "DN", "PROPOSED"), ("k", "CN", "PROPOSED"), ("u", "DN", "UNAVAILABLE"), ("v", "DN", None)]
    spark.createDataFrame([(i, "p", n, t, 1.0, 1.0, 20.0, None, status, None, None, None, at) for i, (n, t, status) in enumerate(names)], SITE).write.parquet(f"{tmp_path}/sites.parquet")
    rng, rows = random.Random(6), []
    for i in range(120):
        a, b = rng.choice("saAbkuvx"), rng.choice(["s", "a", " B", "b ", "k", "K", "u", "v", "", None])
        rows.append((rng.choice([None, i, -i, 2**62 + i]), rng.choice(["p", "p", "p", None]), a, b, rng.choice(["PROPOSED", "EXISTING", "EXISTING", "EXISTING", "UNAVAILABLE", None]), rng.choice([True, True, False, None]), 1.0, rng.choice([None, 0, 9]), 20.0, 1.0))
    rows.append((7, "p", "k", "s", "PROPOSED", None, 1.0, 9, 20.0, 1.0))
    spark.createDataFrame(rows, LINK).write.parquet(f"{tmp_path}/links.parquet")
    got = networks._edges_without_cost(spark, str(tmp_path))
    want = networks._edges(spark, str(tmp_path)).drop("cost")
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and got.count() > 5
    assert got.columns == want.columns
    plan = networks.available_links(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
