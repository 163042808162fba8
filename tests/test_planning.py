import itertools

import numpy as np
import pandas as pd
import pytest

from meshwright.operators import graph
from meshwright.operators.placement import STEP, best_azimuths
from meshwright.operators.planning import branch_and_bound, least_cost_sites, max_min_flow, simplex


def test_simplex_and_branching():
    status, value, x = simplex([-3, -5], [[1, 0], [0, 2], [3, 2]], [4, 12, 18], ["<="] * 3)
    assert status == "optimal" and value == pytest.approx(-36) and x == pytest.approx([2, 6])
    assert simplex([1], [[1], [1]], [1, 2], ["<=", ">="])[0] == "infeasible" and simplex([-1], [[1]], [1], [">="])[0] == "unbounded"
    assert simplex([1, 1], [[1, 1], [1, -1]], [4, -2], ["=", "="])[2] == pytest.approx([1, 3])
    rng = np.random.default_rng(2)
    for _ in range(8):
        c, a = rng.integers(-9, 10, 6), rng.integers(0, 9, (3, 6))
        b = a.sum(1) // 2
        want = min(c @ np.array(x) for x in itertools.product((0, 1), repeat=6) if (a @ np.array(x) <= b).all())
        assert branch_and_bound(c, a, b, ["<="] * 3, list(range(6)))[1] == pytest.approx(want)


def test_siting():
    links = [("p", "a", 2.0), ("p", "b", 2.0), ("a", "c", 2.0), ("b", "c", 1.0), ("b", "d", 1.0)]
    costs = {"p": 5.0, "a": 9.0, "b": 4.0, "c": 1.0, "d": 1.0}
    status, cost, chosen = least_cost_sites(costs, links, {"p"}, {"c": 1.0, "d": 1.0})
    assert (status, cost, chosen) == ("optimal", pytest.approx(11.0), {"p", "b", "c", "d"})
    assert least_cost_sites(costs, links, {"p"}, {"c": 2.0, "d": 1.0})[1] == pytest.approx(20.0)
    assert least_cost_sites(costs, links, {"p"}, {"c": 9.0})[0] == "infeasible"


def _frame(edges):
    return pd.DataFrame(edges, columns=["src", "dst", "kind", "cost"])


#: A source, a bridge to b, a ring b-c-d and a tail e.
NET = [(graph.SOURCE, "a", "SOURCE", 1.0)] + [(x, y, "WIRELESS", 1.0) for u, v in ("ab", "bc", "cd", "db", "de") for x, y in ((u, v), (v, u))] + [(n, f"demand:{n}", "DEMAND", 1.0) for n in "cde"]


def _reached(edges):
    g = graph.Graph([e[0] for e in edges], [e[1] for e in edges])
    return {g.names[i] for i in g.reached(g.at[graph.SOURCE]) if g.names[i].startswith("demand:")}


def test_failures_against_brute_force():
    rng = np.random.default_rng(0)
    for trial in range(12):
        if trial:
            names = [f"n{i}" for i in range(9)]
            pairs = {(a, b) for a, b in (rng.choice(names, 2, replace=False) for _ in range(13))}
            net = [(graph.SOURCE, "n0", "SOURCE", 1.0)] + [(a, b, "WIRELESS", 1.0) for a, b in sorted(pairs)] + [(b, a, "WIRELESS", 1.0) for a, b in sorted(pairs) if (b, a) not in pairs and rng.random() < 0.7]
            net += [(n, f"demand:{n}", "DEMAND", 1.0) for n in names[3:]]
        else:
            net = NET
        got = {(r.kind, r.a, r.b): r.lost for r in graph.failures(_frame(net)).itertuples()}
        every = _reached(net)
        for (kind, a, b), lost in got.items():
            left = [e for e in net if not (e[0] == a if kind == "site" else {e[0], e[1]} == {a, b})]
            assert lost == len(every - _reached(left)), (kind, a, b)
    assert graph.failures(_frame(NET[1:])).empty


def test_paths_flows_and_loops():
    out = {r.demand: (r.hops, r.two_paths) for r in graph.disjoint(_frame(NET)).itertuples()}
    assert out == {"demand:c": (2, False), "demand:d": (2, False), "demand:e": (3, False)}
    ring = [(graph.SOURCE, "a", "SOURCE", 1.0)] + [(x, y, "WIRELESS", 1.0) for u, v in ("ab", "bd", "ac", "cd") for x, y in ((u, v), (v, u))] + [("d", "demand:d", "DEMAND", 1.0)]
    assert [(r.hops, r.two_paths) for r in graph.disjoint(_frame(ring)).itertuples()] == [(2, True)]
    assert graph.max_flow([("s", "a", 3), ("s", "b", 2), ("a", "b", 1), ("a", "t", 2), ("b", "t", 3)], "s", "t") == 5
    assert graph.max_flow([("s", "a", 3)], "s", "t") == 0
    assert graph.prune_loops({("s", "a"): 2.0, ("a", "b"): 3.0, ("b", "a"): 1.0, ("b", "t"): 2.0}) == {("s", "a"): 2.0, ("a", "b"): 2.0, ("b", "t"): 2.0}
    flow, demands = max_min_flow(_frame(NET).assign(capacity=[None if k != "WIRELESS" else 1.5 for _, _, k, _ in NET])[["src", "dst", "capacity"]].astype({"capacity": float}))
    assert demands == 3 and flow == pytest.approx(0.5, abs=1e-3)


def test_availability():
    always = graph.availability(_frame(NET), 1 - 1e-9, 1.0, 1)
    assert (always.availability > 0.9).all() or len(always) == 3
    a, b = (graph.availability(_frame(NET), 0.7, 300.0, 5) for _ in range(2))
    assert a.equals(b) and a.availability.between(0.2, 0.9).all()
    # in series a and b must both be up; each is up for its mean share of the time
    line = [(graph.SOURCE, "a", "SOURCE", 1.0), ("a", "b", "WIRELESS", 1.0), ("b", "demand:b", "DEMAND", 1.0)]
    assert graph.availability(_frame(line), 0.8, 20_000.0, 3).availability[0] == pytest.approx(0.8, abs=0.01)


def test_sector_placement():
    rng = np.random.default_rng(4)
    for _ in range(15):
        bins = np.unique(rng.integers(0, 120, 5)) * STEP
        n = rng.integers(1, 4, len(bins))

        def cost(azimuths, bins=bins, n=n):
            off = np.min([np.abs((bins - a + 180) % 360 - 180) for a in azimuths], axis=0)
            return float((np.where(off <= 35, off, 360.0) ** 2 * n).sum())

        got, chosen = best_azimuths(bins, n, 2, 70.0)
        grid = range(0, 360, STEP)
        apart = lambda a, b: min((a - b) % 360, (b - a) % 360) >= 72
        want = min([cost((a,)) for a in grid] + [cost(p) for p in itertools.combinations(grid, 2) if apart(*p)])
        assert got == pytest.approx(want) and cost(chosen) == pytest.approx(want)
    assert best_azimuths(np.array([0, 90, 180, 270]), np.ones(4), 4, 70.0) == (0.0, [0, 90, 180, 270])
