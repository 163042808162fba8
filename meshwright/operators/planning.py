"""Planning models: rows of constraints as DataFrames, and small exact solvers.

Constraints are built by joins in long form (row_id, variable, coefficient, sense, bound), one row for each coefficient,
so a model of any size can be made and inspected without a driver holding it. Solvers take one plan's model: linear
programs by a dense simplex, integer ones by branch and bound over it, both for small models; the largest equal flow to
all demands by bisection over maximum flows, for large ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.operators.graph import SOURCE, max_flow

MOST_CELLS = 4_000_000


def flow_balance_rows(edges: DataFrame) -> DataFrame:
    """For each site: incoming less outgoing flow is 0, and for each demand incoming flow plus its shortage is its size (1).

    edges: plan_id, src, dst, kind.
    """
    name = F.concat(F.lit("flow:"), "src", F.lit(">"), "dst")
    signs = F.explode(F.array(F.struct(F.col("dst").alias("node"), F.lit(1.0).alias("c")), F.struct(F.col("src").alias("node"), F.lit(-1.0).alias("c")))).alias("s")
    rows = edges.select("plan_id", name.alias("variable"), signs).filter(F.col("s.node") != SOURCE)
    is_demand = F.col("s.node").startswith("demand:")
    flow = rows.select("plan_id", F.concat(F.lit("balance:"), "s.node").alias("row_id"), "variable", F.col("s.c").alias("coefficient"), F.lit("=").alias("sense"), F.when(is_demand, 1.0).otherwise(0.0).alias("bound"))
    short = edges.filter("kind = 'DEMAND'").select("plan_id", F.concat(F.lit("balance:"), "dst").alias("row_id"), F.concat(F.lit("shortage:"), "dst").alias("variable"), F.lit(1.0).alias("coefficient"), F.lit("=").alias("sense"), F.lit(1.0).alias("bound"))
    return flow.unionAll(short)


def capacity_rows(edges: DataFrame) -> DataFrame:
    """Wireless flow is at most capacity times its share of time: flow - capacity * time <= 0. edges with capacity."""
    w = edges.filter("kind = 'WIRELESS'")
    terms = F.explode(F.array(F.struct(F.lit("flow:").alias("v"), F.lit(1.0).alias("c")), F.struct(F.lit("time:").alias("v"), (-F.col("capacity")).alias("c")))).alias("t")
    link = F.concat("src", F.lit(">"), "dst")
    return w.select("plan_id", "src", "dst", terms).select("plan_id", F.concat(F.lit("capacity:"), link).alias("row_id"), F.concat("t.v", link).alias("variable"), F.col("t.c").alias("coefficient"), F.lit("<=").alias("sense"), F.lit(0.0).alias("bound"))


def sector_time_rows(links: DataFrame) -> DataFrame:
    """The shares of time of a sector's links add up to 1 at most, for sending and for receiving."""
    link = F.concat("tx_id", F.lit(">"), "rx_id")
    ends = F.explode(F.array(F.concat(F.lit("tx:"), "tx_sector"), F.concat(F.lit("rx:"), "rx_sector"))).alias("s")
    return links.select("plan_id", ends, F.concat(F.lit("time:"), link).alias("variable")).select(
        "plan_id", F.concat(F.lit("sector:"), "s").alias("row_id"), "variable", F.lit(1.0).alias("coefficient"), F.lit("<=").alias("sense"), F.lit(1.0).alias("bound")
    )


def polarity_rows(links: DataFrame) -> DataFrame:
    """Links between relays only carry if one end is odd and the other even: time <= odd_a + odd_b and time <= 2 - odd_a - odd_b."""
    b = links.filter("rx_type <> 'CN'")
    link = F.concat("tx_id", F.lit(">"), "rx_id")
    out = None
    for k, sign, bound in (("low", -1.0, 0.0), ("high", 1.0, 2.0)):
        terms = F.explode(F.array(*(F.struct(v.alias("v"), F.lit(c).alias("c")) for v, c in ((F.concat(F.lit("time:"), link), 1.0), (F.concat(F.lit("odd:"), "tx_id"), sign), (F.concat(F.lit("odd:"), "rx_id"), sign))))).alias("t")
        rows = b.select("plan_id", F.concat(F.lit(f"polarity_{k}:"), link).alias("row_id"), terms, F.lit("<=").alias("sense"), F.lit(bound).alias("bound"))
        rows = rows.select("plan_id", "row_id", F.col("t.v").alias("variable"), F.col("t.c").alias("coefficient"), "sense", "bound")
        out = rows if out is None else out.unionAll(rows)
    return out


def colocated_rows(sites: DataFrame) -> DataFrame:
    """Of the sites at one place at most one is built; a row is named by the first site there."""
    at = Window.partitionBy("plan_id", "lon", "lat", "alt")
    rows = sites.select("plan_id", "site_id", F.min("site_id").over(at).alias("first"), F.count(F.lit(1)).over(at).alias("n")).filter("n > 1")
    return rows.select("plan_id", F.concat(F.lit("place:"), "first").alias("row_id"), F.concat(F.lit("site:"), "site_id").alias("variable"), F.lit(1.0).alias("coefficient"), F.lit("<=").alias("sense"), F.lit(1.0).alias("bound"))


# --- solvers -----------------------------------------------------------------------------------------------------------
def simplex(c: np.ndarray, a: np.ndarray, b: np.ndarray, senses: list[str]) -> tuple[str, float, np.ndarray]:
    """Least c x over a x (<=, =, >=) b, x >= 0: status (optimal, infeasible, unbounded), value, x. Two phases, Bland's rule."""
    a, b, c = np.array(a, float), np.array(b, float), np.array(c, float)
    m, n = a.shape
    if (m + 1) * (n + 2 * m + 1) > MOST_CELLS:
        raise ValueError("the model is too large for the dense solver")
    flip = b < 0
    a[flip], b[flip] = -a[flip], -b[flip]
    senses = [{"<=": ">=", ">=": "<=", "=": "="}[s] if f else s for s, f in zip(senses, flip, strict=True)]
    slack = [i for i, s in enumerate(senses) if s != "="]
    art = [i for i, s in enumerate(senses) if s != "<="]
    t = np.zeros((m, n + len(slack) + len(art)))
    t[:, :n] = a
    basis = [-1] * m
    for k, i in enumerate(slack):
        t[i, n + k] = 1.0 if senses[i] == "<=" else -1.0
        if senses[i] == "<=":
            basis[i] = n + k
    for k, i in enumerate(art):
        t[i, n + len(slack) + k] = 1.0
        basis[i] = n + len(slack) + k
    first_art = n + len(slack)

    def run(cost: np.ndarray, allowed: int) -> str:
        nonlocal t, b
        while True:
            reduced = cost - cost[basis] @ t
            enter = next((j for j in range(allowed) if reduced[j] < -1e-9), None)
            if enter is None:
                return "optimal"
            column = t[:, enter]
            ratios = [(b[i] / column[i], basis[i], i) for i in range(m) if column[i] > 1e-9]
            if not ratios:
                return "unbounded"
            _, _, r = min(ratios)
            p = t[r, enter]
            t[r], b[r] = t[r] / p, b[r] / p
            for i in range(m):
                if i != r and abs(t[i, enter]) > 1e-12:
                    b[i] -= t[i, enter] * b[r]
                    t[i] = t[i] - t[i, enter] * t[r]
            basis[r] = enter

    if art:
        cost = np.zeros(t.shape[1])
        cost[first_art:] = 1.0
        run(cost, t.shape[1])
        if sum(b[i] for i in range(m) if basis[i] >= first_art) > 1e-7:
            return "infeasible", np.nan, np.full(n, np.nan)
        for i in range(m):  # artificial variables at 0 leave the basis where they can
            if basis[i] >= first_art:
                j = next((j for j in range(first_art) if abs(t[i, j]) > 1e-9), None)
                if j is not None:
                    p = t[i, j]
                    t[i], b[i] = t[i] / p, b[i] / p
                    for k in range(m):
                        if k != i:
                            b[k] -= t[k, j] * b[i]
                            t[k] = t[k] - t[k, j] * t[i]
                    basis[i] = j
    cost = np.zeros(t.shape[1])
    cost[:n] = c
    status = run(cost, first_art)
    x = np.zeros(t.shape[1])
    for i in range(m):
        x[basis[i]] = b[i]
    return status, float(c @ x[:n]) if status == "optimal" else np.nan, x[:n]


def branch_and_bound(c, a, b, senses, binaries: list[int], *, gap: float = 0.0, most_nodes: int = 20_000) -> tuple[str, float, np.ndarray]:
    """Least c x with the given variables 0 or 1: best-first over the relaxation; exact unless a gap or the node limit ends it."""
    import heapq

    c, a, b = np.array(c, float), np.array(a, float), np.array(b, float)
    ones = np.eye(a.shape[1])[binaries]
    a2, b2, s2 = np.vstack([a, ones]), np.concatenate([b, np.ones(len(binaries))]), [*senses, *["<="] * len(binaries)]
    best: tuple[str, float, np.ndarray] = ("infeasible", np.inf, np.full(len(c), np.nan))
    heap, count = [(-np.inf, 0, {})], 0
    while heap and count < most_nodes:
        bound, _, fixed = heapq.heappop(heap)
        if bound >= best[1] - abs(best[1]) * gap - 1e-9 and best[0] == "optimal":
            continue
        rows = np.eye(a.shape[1])[list(fixed)] if fixed else np.zeros((0, a.shape[1]))
        status, value, x = simplex(c, np.vstack([a2, rows]), np.concatenate([b2, [float(v) for v in fixed.values()]]), [*s2, *["="] * len(fixed)])
        count += 1
        if status == "unbounded":
            return "unbounded", np.nan, x
        if status != "optimal" or value >= best[1] - 1e-9:
            continue
        loose = [(abs(x[j] - 0.5), j) for j in binaries if 1e-6 < x[j] < 1 - 1e-6]
        if not loose:
            best = ("optimal", value, x)
            continue
        j = min(loose)[1]
        for v in (1, 0):
            heapq.heappush(heap, (value, count * 2 + v, fixed | {j: v}))
    return best if not heap or count < most_nodes else ("stopped", best[1], best[2])


def max_min_flow(edges: pd.DataFrame, precision: float = 1e-4) -> tuple[float, int]:
    """Largest flow that all connected demands can have at once, and how many they are. edges: src, dst, kind, capacity (null: any).

    A demand is connected if a path of edges with capacity leads to it. Wired edges carry anything, so where nothing else
    limits the flow it is infinite.
    """
    rows = [(a, b, 1e9 if not c == c or c is None else float(c)) for a, b, c in zip(edges["src"], edges["dst"], edges["capacity"], strict=True)]
    connected = _reached(rows, sorted({b for b in edges["dst"] if b.startswith("demand:")}))
    if not connected:
        return 0.0, 0
    carries = lambda x: max_flow([*rows, *((d, "sink", x) for d in connected)], SOURCE, "sink") >= x * len(connected) - 1e-7 * len(connected)
    low, high = 0.0, 1.0
    while carries(high):
        low, high = high, high * 2
        if high * len(connected) > 1e9:
            return np.inf, len(connected)
    while high - low > precision:
        middle = (low + high) / 2
        low, high = (middle, high) if carries(middle) else (low, middle)
    return low, len(connected)


def _reached(rows, demands: list[str]) -> list[str]:
    out: dict[str, list[str]] = {}
    for a, b, c in rows:
        if c > 1e-12:
            out.setdefault(a, []).append(b)
    seen, stack = {SOURCE}, [SOURCE]
    while stack:
        for b in out.get(stack.pop(), ()):
            if b not in seen:
                seen.add(b)
                stack.append(b)
    return [d for d in demands if d in seen]


def least_cost_sites(sites: dict[str, float], links: list[tuple[str, str, float]], sources: set[str], demands: dict[str, float], coverage: float = 1.0) -> tuple[str, float, set[str]]:
    """Exact small siting model: the cheapest sites so that flow from sources covers the share of all demand: status, cost, sites chosen.

    sites: cost of each; links: (a, b, capacity); demands: wanted at sites.
    """
    names, need = sorted(sites), sum(demands.values())
    n_s, edges = len(names), list(links)
    at = {n: i for i, n in enumerate(names)}
    shortage = sorted(demands)
    n = n_s + len(edges) + len(sources) + len(shortage)
    c = np.zeros(n)
    c[:n_s] = [sites[x] for x in names]
    rows, bounds, senses = [], [], []
    src = {s: n_s + len(edges) + i for i, s in enumerate(sorted(sources))}
    sh = {d: n_s + len(edges) + len(sources) + i for i, d in enumerate(shortage)}
    for x in names:  # what comes in is what goes out and what is used
        row = np.zeros(n)
        for k, (a, b, _) in enumerate(edges):
            row[n_s + k] += (b == x) - (a == x)
        if x in src:
            row[src[x]] = 1.0
        if x in sh:
            row[sh[x]] = 1.0
        rows.append(row)
        bounds.append(demands.get(x, 0.0))
        senses.append("=")
    for k, (a, b, cap) in enumerate(edges):
        for x in (a, b):
            row = np.zeros(n)
            row[n_s + k], row[at[x]] = 1.0, -cap
            rows.append(row)
            bounds.append(0.0)
            senses.append("<=")
    for s, k in src.items():
        row = np.zeros(n)
        row[k], row[at[s]] = 1.0, -need
        rows.append(row)
        bounds.append(0.0)
        senses.append("<=")
    row = np.zeros(n)
    for k in sh.values():
        row[k] = 1.0
    rows.append(row)
    bounds.append((1 - coverage) * need)
    senses.append("<=")
    status, cost, x = branch_and_bound(c, np.array(rows), np.array(bounds), senses, list(range(n_s)))
    return status, cost, {names[i] for i in range(n_s) if status == "optimal" and x[i] > 1 - 1e-5}
