import itertools

import pytest

from meshwright.operators import models
from meshwright.operators.models import Network, Rules

SITES = "plan_id string, site_id string, site_type string, status string, place string, weight double"
SECTORS = "plan_id string, sector_id string, site_id string, node string, site_type string, status string"
LINKS = "plan_id string, src string, dst string, wired boolean, capacity double, status string, tx_sector string, rx_sector string"
DEMANDS = "plan_id string, demand string, site_id string, size double"


def _network(spark, sites, links, demands, plan="p"):
    """sites: id -> (type, weight, status, place); links: (a, b, capacity) each way; demands: site -> size."""
    rows = [(plan, s, t, st, pl or s, w) for s, (t, w, st, pl) in sites.items()]
    sectors = [(plan, f"{s}-0", s, "0", v[0], "CANDIDATE") for s, v in sites.items()]
    ways = [(plan, a, b, False, c, "CANDIDATE", f"{a}-0", f"{b}-0") for a, b, c in links]
    need = [(plan, f"demand:{s}", s, x) for s, x in demands.items()]
    make = lambda data, schema: spark.createDataFrame(data, schema)
    return Network(make(rows, SITES), make(sectors, SECTORS), make(ways, LINKS), make(need, DEMANDS))


def _small(spark):
    sites = {"s": ("POP", 5.0, None, None), "r1": ("DN", 4.0, None, None), "r2": ("DN", 3.0, None, None), "c1": ("CN", 1.0, None, None), "c2": ("CN", 1.0, None, None)}
    links = [("s", "r1", 2.0), ("s", "r2", 2.0), ("r1", "c1", 2.0), ("r2", "c1", 2.0), ("r1", "c2", 2.0), ("r2", "c2", 0.0)]
    return sites, links, _network(spark, sites, links, {"c1": 0.5, "c2": 0.5})


def _values(model_solution):
    return {r.variable: r.amount for r in model_solution.collect()}


def test_least_weight_against_enumeration(spark):
    sites, links, net = _small(spark)
    for coverage in (1.0, 0.5):
        solution = models.solve(models.site_model(net, Rules(coverage=coverage))).cache()
        best = min(
            sum(sites[s][1] for s in chosen)
            for n in range(6) for chosen in map(set, itertools.combinations(sites, n))
            if sum(0.5 for c in ("c1", "c2") if c in chosen and "s" in chosen and any(r in chosen and ("s", r, 2.0) in links and (r, c, 2.0) in links for r in ("r1", "r2"))) >= coverage
        )
        assert solution.first().status == "optimal" and solution.first().value == pytest.approx(best)
        built, used = models.site_solution(net, Rules(), solution)
        names = {r.site_id for r in built.collect()}
        assert sum(sites[s][1] for s in names) == pytest.approx(best)
        assert all({a, b} <= names for _, a, b in used.collect()) and used.count() >= 2
        sent = {(r.src, r.dst): r.flow for r in models.flows(solution).collect()}
        assert sum(f for (_, b), f in sent.items() if b.startswith("demand:")) == pytest.approx(coverage, abs=1e-6)
        solution.unpersist()


def test_goals_and_decided_sites(spark):
    _, _, net = _small(spark)
    within = _values(models.solve(models.site_model(net, Rules(), "coverage", most_weight=9.0)))
    assert sum(v for k, v in within.items() if k.startswith("shortage:")) == pytest.approx(0.5)  # only c1, over r2
    sites, links, _ = _small(spark)
    sites = sites | {"r2": ("DN", 3.0, "PROPOSED", None), "r1": ("DN", 4.0, "UNAVAILABLE", None)}
    fixed = models.solve(models.site_model(_network(spark, sites, links, {"c1": 0.5, "c2": 0.5}), Rules(coverage=0.5)))
    assert _values(fixed)["site:r2"] == pytest.approx(1) and _values(fixed)["site:r1"] == pytest.approx(0)
    bandwidth = _values(models.solve(models.site_model(net, Rules(common_bandwidth=True), "coverage", most_weight=99.0)))
    assert bandwidth["bandwidth"] == pytest.approx(0.5)
    impossible = models.solve(models.site_model(net, Rules(source_capacity=0.1))).collect()
    assert [r.status for r in impossible] == ["infeasible"]


def test_places(spark):
    sites = {"a": ("CN", 1.0, "EXISTING", "x"), "b": ("CN", 1.0, None, "x"), "d": ("DN", 1.0, None, "x"), "e": ("DN", 1.0, "PROPOSED", "y"), "f": ("POP", 1.0, None, "y"), "g": ("DN", 1.0, None, "z"), "h": ("POP", 1.0, None, "z")}
    net = _network(spark, sites, [], {})
    assert {r.site_id for r in models.excluded_sites(net, Rules()).collect()} == {"b", "f"}
    rows = {(r.row_id, r.variable, r.sense, r.bound) for r in models.place_rows(net, Rules()).collect()}
    assert ("place:x", "site:a", "=", 1.0) in rows and ("place:z", "site:h", "<=", 1.0) in rows and ("excluded:x", "site:b", "=", 0.0) in rows and ("excluded:y", "site:f", "=", 0.0) in rows
    assert {r.site_id for r in models.excluded_sites(net, Rules(sources_stay=True)).collect()} == {"b", "e", "g"}


def test_connected_demands_and_buffer(spark):
    sites = {"s": ("POP", 1.0, "PROPOSED", None), "r": ("DN", 1.0, "PROPOSED", None), "c": ("CN", 1.0, "PROPOSED", None), "lost": ("CN", 1.0, "PROPOSED", None)}
    links = [("s", "r", 1.8), ("r", "c", 0.9)]
    net = _network(spark, sites, links, {"c": 1.0, "lost": 1.0})
    got = models.decisions(models.solve(models.demand_model(net, Rules())), "demand")
    assert [r.name for r in got.collect()] == ["demand:c"]
    sectors = net.sectors.drop("status").selectExpr("*", "'PROPOSED' AS status")
    connected = net.demands.filter("site_id = 'c'")
    buffer = _values(models.solve(models.buffer_model(Network(net.sites, sectors, net.links, net.demands), Rules(), connected)))
    assert buffer["buffer"] == pytest.approx(0.9) and buffer["time:r>c:0"] == pytest.approx(1)
    assert models.source_can_send(net).count() == 1 and models.demand_can_receive(net).count() == 1


def test_link_rows(spark):
    sites = {"s": ("POP", 1.0, None, None), "r": ("DN", 1.0, None, None), "q": ("DN", 1.0, None, None), "c": ("CN", 1.0, None, None)}
    both = [x for a, b in (("s", "r"), ("s", "q")) for x in ((a, b, 2.0), (b, a, 2.0))]
    net = _network(spark, sites, [*both, ("r", "c", 2.0), ("q", "c", 2.0)], {"c": 1.0})
    sharp = spark.createDataFrame([("p", "s", "r", "q")], "plan_id string, src string, dst string, dst2 string")
    one = models.link_rows(net, Rules(), sharp).groupBy("row_id").count().rdd.collectAsMap()
    assert one["client:c"] == 2 and one["both_ways:q>s"] == 2 and one["sharp:s>r|q"] == 2 and one["sector_relays:s-0"] == 3 and "sector_links:s-0" not in one
    two = models.link_rows(net, Rules(channels=2), sharp)
    kinds = {r.row_id.split(":")[0] for r in two.select("row_id").distinct().collect()}
    assert {"used_link", "used_tx", "used_rx", "used_all", "same_tx", "same_rx"} <= kinds
    levels = spark.createDataFrame([("p", "q", "c", "s", "r", 0.5)], "plan_id string, src string, dst string, by_src string, by_dst string, mw double")
    assert {(r.variable, r.coefficient) for r in models.interference_rows(net, levels).collect()} == {("time:s>r:0", 0.5), ("mw:q>c", -1.0)}


def test_redundancy(spark):
    sites = {"s": ("POP", 1.0, "PROPOSED", None), "t": ("POP", 1.0, "PROPOSED", None), "r": ("DN", 1.0, "PROPOSED", None), "x": ("DN", 2.0, None, None), "y": ("DN", 5.0, None, None)}
    links = [("s", "r", 1.0), ("t", "x", 1.0), ("x", "r", 1.0), ("t", "y", 1.0), ("y", "r", 1.0)]
    net = _network(spark, sites, links, {})
    ways = spark.createDataFrame([("p", "r", a, b) for a, b in [("SUPERSOURCE", "s"), ("SUPERSOURCE", "t"), *((a, b) for a, b, _ in links)]], "plan_id string, relay string, src string, dst string")
    first = models.solve(models.redundancy_model(net, ways, Rules(polarities=False)))
    assert first.first().value == pytest.approx(0)
    second = models.solve(models.redundancy_model(net, ways, Rules(polarities=False), with_shortage=False))
    assert {r.name for r in models.decisions(second, "site").collect()} == {"s", "t", "r", "x"}


def test_relays_as_sources(spark):
    sites, links, net = _small(spark)
    access = models.relays_as_sources(net)
    assert {r.site_id for r in access.sites.collect()} == {"s", "c1", "c2", "r1_source", "r2_source"}
    assert {(r.src, r.dst, r.tx_sector) for r in access.links.collect()} == {(f"{r}_source", c, f"{r}-0_source") for r in ("r1", "r2") for c in ("c1", "c2")}
    model = models.site_model(access, Rules(extra_sources=1), "sources", inputs=net.sites.filter("site_id <> 's'"))
    chosen = {r.name for r in models.decisions(models.solve(model), "site").collect()}
    assert "r1_source" in chosen and "r2_source" not in chosen and "s" not in chosen


def test_best_coverage_and_statuses(spark):
    sites, links, _ = _small(spark)
    net = _network(spark, sites, links[:2] + [("r1", "c1", 2.0)], {"c1": 0.5, "c2": 0.4})  # c2 hangs on nothing
    solution = models.least_weight_at_best_coverage(net, Rules()).cache()
    assert {r.coverage for r in solution.select("coverage").distinct().collect()} == {0.5}
    after = models.with_statuses(net, Rules(), solution)
    assert {r.site_id for r in after.sites.filter("status = 'PROPOSED'").collect()} == {"s", "r1", "c1"}
    assert {(r.src, r.dst) for r in after.links.filter("status = 'PROPOSED'").collect()} == {("s", "r1"), ("r1", "c1")}
    assert after.sectors.filter("status = 'PROPOSED'").count() == 3 and after.sites.count() == 5
    solution.unpersist()


def test_empty_and_large(spark, monkeypatch):
    empty = _network(spark, {}, [], {})
    model = models.site_model(empty, Rules())
    assert model.rows.count() == 0 and model.variables.count() == 0 and models.solve(model).count() == 0
    _, _, net = _small(spark)
    monkeypatch.setattr(models.planning, "MOST_CELLS", 100)
    assert [r.status for r in models.solve(models.site_model(net, Rules())).collect()] == ["too_large"]
