"""Graph operators: reachability, routing, failures, disjoint paths, flow and availability.

Reachability and routing run as frontier loops over DataFrames: each round is one join of what changed with the edges
and one aggregation with partial combine, cut by a checkpoint, so neither the graph nor a path is ever held by one task.
Failure, flow and availability analyses are sequential by nature and take one plan's network per task; a plan has at
most MOST_EDGES edges there, more are refused rather than cut off.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.functions import rf
from meshwright.tables import checkpoint

MOST_EDGES = 5_000_000
SOURCE = "SUPERSOURCE"


def build_edges(sites: DataFrame, links: DataFrame) -> DataFrame:
    """Property graph (plan_id, src, dst, kind, cost): source to each POP, links by class, and sites to demands.

    Demands are the clients; sites and links that are unavailable are left out.
    """
    up = sites.filter("status <> 'UNAVAILABLE'")
    pops = up.filter("site_type = 'POP'").select("plan_id", F.lit(SOURCE).alias("src"), F.col("site_id").alias("dst"), F.lit("SOURCE").alias("kind"), F.lit(1.0).alias("cost"))
    usable = links.filter("status <> 'UNAVAILABLE' and tx_status <> 'UNAVAILABLE' and rx_status <> 'UNAVAILABLE' and (tx_type <> 'CN' or not is_wireless)")
    cost = F.when(F.col("is_wireless"), rf.mcs_cost("mcs")).otherwise(F.lit(1.0))
    kind = F.when(F.col("is_wireless"), "WIRELESS").otherwise("WIRED")
    edges = usable.select("plan_id", F.col("tx_id").alias("src"), F.col("rx_id").alias("dst"), kind.alias("kind"), cost.alias("cost"))
    demands = up.filter("site_type = 'CN'").select("plan_id", F.col("site_id").alias("src"), F.concat(F.lit("demand:"), "site_id").alias("dst"), F.lit("DEMAND").alias("kind"), F.lit(1.0).alias("cost"))
    return pops.unionAll(edges).unionAll(demands)


def shortest(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """Least cost from any start to each node reached, with the parent on that path: node, cost, parent.

    starts: node. edges: src, dst, cost > 0; infinite ones don't carry. Of equally dear parents the smallest is taken.
    """
    edges = checkpoint(edges.filter(F.col("cost") < math.inf).groupBy("src", "dst").agg(F.min("cost").alias("cost")))  # each round reads them
    best = checkpoint(starts.select("node").distinct().select("node", F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("parent")))
    changed = best
    while True:
        offers = changed.join(edges.withColumnRenamed("cost", "w"), F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.col("src").alias("parent"))
        offers = offers.groupBy("node").agg(F.min(F.struct("cost", "parent")).alias("offer"))
        known = best.select("node", F.struct("cost", "parent").alias("had"))
        better = offers.join(known, "node", "left").filter("had is null or offer.cost < had.cost or (offer.cost = had.cost and had.parent is not null and offer.parent < had.parent)")
        changed = checkpoint(better.select("node", "offer.cost", "offer.parent"))
        if changed.isEmpty():
            return best
        best = checkpoint(best.join(changed.select("node"), "node", "left_anti").unionAll(changed))


def hops(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """Breadth-first level of each node reached: node, hops."""
    steps = edges.select("src", "dst", F.lit(1.0).alias("cost"))
    return shortest(starts, steps).select("node", F.col("cost").cast("int").alias("hops"))


def route_edges(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges (src, dst) on the paths to the given nodes, by walking all paths back at once."""
    parents = paths.filter("parent is not null").select(F.col("node").alias("dst"), F.col("parent").alias("src"))
    frontier = checkpoint(ends.select(F.col("node").alias("dst")).distinct().join(parents, "dst"))
    found = frontier
    while True:
        if frontier.isEmpty():
            return found
        up = frontier.select(F.col("src").alias("dst")).distinct().join(parents, "dst").join(found.select("dst"), "dst", "left_anti")
        frontier = checkpoint(up)
        found = checkpoint(found.unionByName(frontier))


def zones(paths: DataFrame) -> DataFrame:
    """The start that each node's path begins at (node, zone), by pointer doubling: rounds grow as the log of the length."""
    at = checkpoint(paths.select("node", F.coalesce("parent", "node").alias("zone")))
    while True:
        step = at.join(at.select(F.col("node").alias("zone"), F.col("zone").alias("next")), "zone")
        if step.filter("next <> zone").isEmpty():
            return at
        at = checkpoint(step.select("node", F.col("next").alias("zone")))


def mark_unreachable(sites: DataFrame, levels: DataFrame, most_hops: int | None = None) -> DataFrame:
    """Candidates that are not reached, or not within most_hops (None or 0: any), become UNREACHABLE."""
    joined = sites.join(levels.select(F.col("node").alias("site_id"), "hops"), "site_id", "left")
    far = F.col("hops").isNull() if not most_hops else F.col("hops").isNull() | (F.col("hops") > most_hops)
    return joined.withColumn("status", F.when(far & (F.col("status") == "CANDIDATE"), "UNREACHABLE").otherwise(F.col("status")))


# --- kernels over one plan's network -----------------------------------------------------------------------------------
class Graph:
    """A directed graph over consecutive numbers, from arrays of ends."""

    def __init__(self, src, dst, cost=None) -> None:
        if len(src) > MOST_EDGES:
            raise ValueError(f"a plan's network has more than {MOST_EDGES} edges")
        self.names = sorted({*src, *dst})
        self.at = {n: i for i, n in enumerate(self.names)}
        self.out: list[list[int]] = [[] for _ in self.names]
        self.into: list[list[int]] = [[] for _ in self.names]
        self.cost: dict[tuple[int, int], float] = {}
        for k, (a, b) in enumerate(zip(src, dst, strict=True)):
            i, j = self.at[a], self.at[b]
            w = 1.0 if cost is None else float(cost[k])
            if (i, j) not in self.cost:
                self.out[i].append(j)
                self.into[j].append(i)
                self.cost[i, j] = w
            elif w < self.cost[i, j]:
                self.cost[i, j] = w
        for row in (*self.out, *self.into):
            row.sort()

    def reached(self, start: int, without=frozenset()) -> set[int]:
        """Nodes reached from start without the given directed edges."""
        seen, stack = {start}, [start]
        while stack:
            i = stack.pop()
            for j in self.out[i]:
                if j not in seen and (i, j) not in without:
                    seen.add(j)
                    stack.append(j)
        return seen

    def path(self, start: int, end: int, without=frozenset()) -> list[int] | None:
        """Path with fewest edges, the smallest numbers first."""
        parent, queue = {start: start}, deque([start])
        while queue:
            i = queue.popleft()
            if i == end:
                out = [end]
                while out[-1] != start:
                    out.append(parent[out[-1]])
                return out[::-1]
            for j in self.out[i]:
                if j not in parent and (i, j) not in without:
                    parent[j] = i
                    queue.append(j)
        return None

    def dominators(self, start: int) -> dict[int, int]:
        """Immediate dominators of all nodes reached from start, by intersecting in reverse postorder until nothing changes."""
        order, seen, stack = [], {start}, [(start, iter(self.out[start]))]
        while stack:
            i, it = stack[-1]
            for j in it:
                if j not in seen:
                    seen.add(j)
                    stack.append((j, iter(self.out[j])))
                    break
            else:
                order.append(i)
                stack.pop()
        rank = {n: k for k, n in enumerate(order)}
        idom = {start: start}
        changed = True
        while changed:
            changed = False
            for n in reversed(order[:-1]):
                new = None
                for p in self.into[n]:
                    if p in idom:
                        if new is None:
                            new = p
                        else:
                            a, b = p, new
                            while a != b:
                                while rank[a] < rank[b]:
                                    a = idom[a]
                                while rank[b] < rank[a]:
                                    b = idom[b]
                            new = a
                if idom.get(n) != new:
                    idom[n], changed = new, True
        return idom


def failures(edges: pd.DataFrame) -> pd.DataFrame:
    """Demands cut off by the failure of each site and of each link (both directions): kind, a, b, lost.

    One dominator tree of the graph with its links as nodes answers all failures at once: what a part dominates is lost.
    """
    out = []
    links = edges[edges["kind"].isin(["WIRELESS", "WIRED"])]
    src, dst = list(edges["src"]), list(edges["dst"])
    g = Graph(src, dst)
    if SOURCE not in g.at:
        return pd.DataFrame(columns=["kind", "a", "b", "lost"])
    middle = {(a, b): f"link:{a}>{b}" for a, b in zip(links["src"], links["dst"], strict=True)}
    s2, d2 = [], []
    for a, b in zip(src, dst, strict=True):
        if (a, b) in middle:
            s2 += [a, middle[a, b]]
            d2 += [middle[a, b], b]
        else:
            s2.append(a)
            d2.append(b)
    split = Graph(s2, d2)
    idom = split.dominators(split.at[SOURCE])
    # demands below each node of the dominator tree, children before parents
    children = defaultdict(list)
    for n, p in idom.items():
        if n != p:
            children[p].append(n)
    below, order, stack = {}, [], [split.at[SOURCE]]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += children[n]
    for n in reversed(order):
        below[n] = (1 if split.names[n].startswith("demand:") else 0) + sum(below[k] for k in children[n])
    for n in order:
        name = split.names[n]
        if not name.startswith(("demand:", "link:")) and name != SOURCE:
            out.append(("site", name, None, below[n]))
    lost = defaultdict(int)
    for (a, b), m in middle.items():
        if m in split.at and split.at[m] in below:
            lost[min(a, b), max(a, b)] += below[split.at[m]]
        else:
            lost[min(a, b), max(a, b)] += 0
    out += [("link", a, b, n) for (a, b), n in lost.items()]
    return pd.DataFrame(out, columns=["kind", "a", "b", "lost"])


def breadth_first(out: list[list[int]], starts: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Nodes in the order in which they are reached, and each node's parent and level; -1 where none is."""
    order, parent, level = list(starts), [-1] * len(out), [-1] * len(out)
    for n in starts:
        level[n] = 0
    for i in order:
        for j in out[i]:
            if level[j] < 0:
                parent[j], level[j] = i, level[i] + 1
                order.append(j)
    return order, parent, level


def disjoint(edges: pd.DataFrame) -> pd.DataFrame:
    """For each connected demand whether a second path exists without the links of its shortest one (but its last hop): demand, hops, two_paths.

    All shortest paths are in one breadth-first tree. A path that does not begin with the same link shares none with it,
    so a second one is looked for backwards and only among the nodes behind that link.
    """
    g = Graph(list(edges["src"]), list(edges["dst"]))
    out = []
    if SOURCE in g.at:
        order, parent, level = breadth_first(g.out, [g.at[SOURCE]])
        first = [-1] * len(g.names)  # the node behind the first link of each node's path
        for n in order:
            if level[n] > 1:
                first[n] = n if level[n] == 2 else first[parent[n]]
        # links into what is behind a first link, besides that one
        open_to = {first[j] for j in order if first[j] >= 0 for i in g.into[j] if level[i] >= 0 and first[i] != first[j] and not (first[j] == j and parent[j] == i)}

        def second(n: int, last: int) -> bool:
            top, path, i = first[last], set(), last
            if top not in open_to:
                return False
            while i != parent[top]:
                path.add(i)
                i = parent[i]
            seen, stack = {n}, [n]
            while stack:
                j = stack.pop()
                for i in g.into[j]:
                    if level[i] < 0 or i in seen or (j in path and parent[j] == i) or (i in path and parent[i] == j):
                        continue
                    if first[i] != top:
                        return True
                    seen.add(i)
                    stack.append(i)
            return False

        for n, name in enumerate(g.names):
            if name.startswith("demand:") and level[n] >= 0:
                # source and demand edges are imaginary; the last real hop leads to the client
                last = parent[parent[n]] if level[n] > 1 else -1
                out.append((name, level[n] - 2, last >= 0 and level[last] > 1 and second(n, last)))
    return pd.DataFrame(out, columns=["demand", "hops", "two_paths"])


def max_flow(edges, source: str, sink: str) -> float:
    """Dinic's maximum flow; edges: (src, dst, capacity)."""
    names = {}
    to, cap, head = [], [], []
    for a, b, c in edges:
        for n in (a, b):
            if n not in names:
                names[n] = len(names)
                head.append([])
        head[names[a]].append(len(to))
        to.append(names[b])
        cap.append(float(c))
        head[names[b]].append(len(to))
        to.append(names[a])
        cap.append(0.0)
    if source not in names or sink not in names:
        return 0.0
    s, t, total = names[source], names[sink], 0.0
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            i = queue.popleft()
            for e in head[i]:
                if cap[e] > 1e-12 and to[e] not in level:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if t not in level:
            return total
        at = [0] * len(head)
        while True:  # one augmenting path after another in the level graph
            path, i = [], s
            while i != t:
                while at[i] < len(head[i]):
                    e = head[i][at[i]]
                    if cap[e] > 1e-12 and level.get(to[e], -1) == level[i] + 1:
                        break
                    at[i] += 1
                else:
                    if not path:
                        break
                    back = path.pop()
                    i = to[back ^ 1]
                    at[i] += 1
                    continue
                path.append(head[i][at[i]])
                i = to[path[-1]]
            if i != t:
                break
            push = min(cap[e] for e in path)
            for e in path:
                cap[e] -= push
                cap[e ^ 1] += push
            total += push


def prune_loops(flows: dict[tuple[str, str], float]) -> dict[tuple[str, str], float]:
    """Cancels cycles of a flow: each found cycle is reduced by its smallest flow until none is left."""
    flows = {e: f for e, f in flows.items() if f > 1e-12}
    while True:
        out = defaultdict(list)
        for a, b in sorted(flows):
            out[a].append(b)
        state, cycle = {}, None
        for root in sorted(out):
            stack, trail = [(root, iter(out[root]))], [root]
            if root in state:
                continue
            state[root] = 1
            while stack and cycle is None:
                n, it = stack[-1]
                for m in it:
                    if state.get(m) == 1:
                        cycle = [*trail[trail.index(m) :], m]
                        break
                    if m not in state:
                        state[m] = 1
                        trail.append(m)
                        stack.append((m, iter(out.get(m, ()))))
                        break
                else:
                    state[n] = 2
                    stack.pop()
                    trail.pop()
            if cycle:
                break
        if cycle is None:
            return flows
        ring = list(zip(cycle, cycle[1:], strict=False))
        least = min(flows[e] for e in ring)
        for e in ring:
            flows[e] -= least
            if flows[e] <= 1e-12:
                del flows[e]


class LiveTree:
    """What a source reaches while links go down and up: a spanning tree in which only what hangs on a changed link is touched.

    lost has the time each node has been out of reach so far, up to the last time it was reached again.
    """

    def __init__(self, g: Graph, start: int, pair_of: dict[tuple[int, int], int]) -> None:
        n = len(g.names)
        self.out = [[(j, pair_of.get((i, j), -1)) for j in g.out[i]] for i in range(n)]
        self.into = [[(i, pair_of.get((i, j), -1)) for i in g.into[j]] for j in range(n)]
        self.down: set[int] = set()
        self.parent, self.children = [-1] * n, [set() for _ in range(n)]
        self.reached, self.since, self.lost = [False] * n, [0.0] * n, [0.0] * n
        self.reached[start] = True
        self._spread([start], 0.0)

    def _attach(self, node: int, parent: int, now: float) -> None:
        self.parent[node], self.reached[node] = parent, True
        self.children[parent].add(node)
        self.lost[node] += now - self.since[node]

    def _spread(self, queue: list[int], now: float) -> None:
        for i in queue:
            for j, pair in self.out[i]:
                if not self.reached[j] and pair not in self.down:
                    self._attach(j, i, now)
                    queue.append(j)

    def fail(self, pair: int, ends: tuple[int, int], now: float) -> None:
        self.down.add(pair)
        for a, b in (ends, ends[::-1]):
            if self.parent[b] == a:
                self.children[a].discard(b)
                below = [b]
                for i in below:
                    below += self.children[i]
                for i in below:
                    self.reached[i], self.parent[i], self.since[i] = False, -1, now
                    self.children[i].clear()
                # what another link still holds is back at once, with all behind it
                for i in below:
                    if not self.reached[i]:
                        up = next((u for u, p in self.into[i] if self.reached[u] and p not in self.down), None)
                        if up is not None:
                            self._attach(i, up, now)
                            self._spread([i], now)

    def repair(self, pair: int, ends: tuple[int, int], now: float) -> None:
        self.down.discard(pair)
        for a, b in (ends, ends[::-1]):
            if self.reached[a] and not self.reached[b] and any(j == b for j, _ in self.out[a]):
                self._attach(b, a, now)
                self._spread([b], now)


def availability(edges: pd.DataFrame, link_availability: float, horizon: float, seed: int) -> pd.DataFrame:
    """Share of time in which each demand is connected while wireless links fail and are repaired at random: demand, availability.

    Times between failures and to repairs are exponential with means a and 1 - a; a link fails in both directions.
    """
    src, dst, kind = list(edges["src"]), list(edges["dst"]), list(edges["kind"])
    g = Graph(src, dst)
    demands = [n for n in g.names if n.startswith("demand:")]
    if SOURCE not in g.at:
        return pd.DataFrame({"demand": demands, "availability": [0.0] * len(demands)})
    pairs = sorted({(min(a, b), max(a, b)) for a, b, k in zip(src, dst, kind, strict=True) if k == "WIRELESS"})
    ends = [(g.at[a], g.at[b]) for a, b in pairs]
    tree = LiveTree(g, g.at[SOURCE], {e: k for k, (a, b) in enumerate(ends) for e in ((a, b), (b, a))})
    rng = np.random.default_rng(seed)
    events = [(float(rng.exponential(link_availability)), i, True) for i in range(len(pairs))]
    heapq.heapify(events)
    while events and events[0][0] < horizon:
        t, i, fails = heapq.heappop(events)
        (tree.fail if fails else tree.repair)(i, ends[i], t)
        heapq.heappush(events, (t + float(rng.exponential(1 - link_availability if fails else link_availability)), i, not fails))
    gone = [tree.lost[k] + (0.0 if tree.reached[k] else horizon - tree.since[k]) for k in range(len(g.names))]
    return pd.DataFrame({"demand": demands, "availability": [1 - gone[g.at[n]] / horizon for n in demands]})


def per_plan(edges: DataFrame, kernel, schema: str, ordered: bool = True) -> DataFrame:
    """Runs a kernel over each plan's network; fails if one has more than MOST_EDGES edges. The edges are computed once.

    ordered: whether the kernel asks for edges by their ends.
    """

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_EDGES:
            raise ValueError(f"plan {key[0]} has more than {MOST_EDGES} edges")
        out = kernel(pdf.sort_values(["src", "dst"], kind="stable") if ordered else pdf)
        out.insert(0, "plan_id", key[0])
        return out

    return edges.groupBy("plan_id").applyInPandas(run, "plan_id string, " + schema)
