"""The engine's entry points: candidate networks from sites and terrain, and the analysis of a network."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions import geo, rf
from meshwright.operators import graph, los, raster
from meshwright.operators.rangejoin import radius_join
from meshwright.plans.domain import ACTIVE, BASE_SQL, RADIO, length_sql, link_length, link_type, links, sites
from meshwright.plans.networks import _edges
from meshwright.plans.scalars import budget, r, with_gain
from meshwright.tables import checkpoint, fixed, table


@dataclass(frozen=True)
class LosRules:
    least_m: float = 20.0
    most_m: float = 300.0
    steepest_deg: float = 25.0
    confidence: float = 0.1
    ellipsoid: bool = False
    cell_m: float = 20.0
    mount_m: float = 2.0


def candidate_network(places: DataFrame, rules: LosRules = LosRules(), zones: DataFrame | None = None) -> DataFrame:
    """Links that sites (site_id, plan_id, site_type, lon, lat, alt, building_id, location_type) of one plan could have.

    Relays and sources send to all, clients only receive. Pairs pass distance, slope and building checks, the line of
    sight over the surface of all sites, and a link budget with throughput. Each pair's sight is computed once, in the zone
    of its first end; places near a border are in the surface of the zones on both sides. zones (ring: array of lon, lat) are
    areas that no line of sight may meet, a table that is small by definition.
    """
    known = places.filter("alt is not null")
    side = lambda k: known.select(F.col("plan_id").alias(f"{k}_plan"), *(F.col(c).alias(f"{k}_{c}") for c in ("site_id", "site_type", "lon", "lat", "alt", "building_id", "location_type")))
    a, b = side("l"), side("r")
    pairs = radius_join(a, b, rules.most_m).filter("l_site_id < r_site_id and l_plan = r_plan and (l_site_type <> 'CN' or r_site_type <> 'CN')")
    one_roof = (F.col("l_location_type") == "ROOFTOP") & (F.col("r_location_type") == "ROOFTOP") & (F.col("l_building_id") == F.col("r_building_id"))
    rise = F.abs(F.col("r_alt") - F.col("l_alt"))
    pairs = pairs.withColumn("length_m", F.sqrt(F.col("distance_m") ** 2 + rise**2)).filter((F.col("length_m") >= rules.least_m) & (F.col("length_m") <= rules.most_m) & ~F.coalesce(one_roof, F.lit(False)))
    pairs = pairs.filter(F.degrees(F.asin(F.least(rise / F.col("length_m"), F.lit(1.0)))) <= rules.steepest_deg)
    if zones is not None:
        pairs = pairs.join(fixed(zones.select("ring")), los.through_zone(F.col("ring")), "left_anti")
    pairs = pairs.withColumn("zone", geo.utm_epsg("l_lon", "l_lat"))
    for k, n in (("l", 1), ("r", 2)):
        x, y = geo.to_utm(f"{k}_lon", f"{k}_lat", "zone")
        pairs = pairs.withColumns({f"x{n}": x, f"y{n}": y, f"z{n}": F.col(f"{k}_alt") + rules.mount_m})
    pairs = pairs.withColumns({"pair_id": F.concat_ws(">", "l_site_id", "r_site_id"), "radius": F.greatest(rf.fresnel_radius("length_m", RADIO["mhz"]), F.lit(rules.cell_m / 2))})
    pairs = checkpoint(pairs.select("pair_id", "zone", "x1", "y1", "z1", "x2", "y2", "z2", "radius", "length_m", "l_site_id", "r_site_id", "l_site_type", "r_site_type", "l_plan"))
    # a pair's cells are no farther from its first end than its length, the corridor's radius and a cell
    ground = known.select("lon", "lat", "alt", F.explode(geo.utm_epsg_near("lon", "lat", 2 * (rules.most_m + rules.cell_m))).alias("zone"))
    x, y = geo.to_utm("lon", "lat", "zone")
    surface = raster.rasterize(ground.select("zone", x.alias("x"), y.alias("y"), F.col("alt").alias("z")), rules.cell_m)
    model = los.ellipsoid_confidence if rules.ellipsoid else los.cylinder_confidence
    clear = model(pairs, surface, rules.cell_m, rules.confidence).filter("confidence > 0")
    seen = budget(with_gain(pairs.join(clear, "pair_id").withColumn("m", F.col("length_m")))).filter("gbps > 0")
    ways = F.explode(F.array(F.struct(F.col("l_site_id").alias("tx"), F.col("l_site_type").alias("t"), F.col("r_site_id").alias("rx")), F.struct(F.col("r_site_id").alias("tx"), F.col("r_site_type").alias("t"), F.col("l_site_id").alias("rx")))).alias("w")
    out = seen.select(F.col("l_plan").alias("plan_id"), ways, "length_m", "confidence", "mcs", "gbps").filter("w.t <> 'CN'")
    return out.select("plan_id", F.col("w.tx").alias("tx_id"), F.col("w.rx").alias("rx_id"), "length_m", "confidence", "mcs", "gbps")


def pipe_candidate_network(spark: SparkSession, d: str) -> DataFrame:
    out = candidate_network(sites(spark, d).filter("status <> 'UNAVAILABLE'"))
    return out.select("plan_id", "tx_id", "rx_id", r("length_m", 2).alias("length_m"), r("confidence", 3).alias("confidence"), "mcs")


def los_exclusion_zones(spark: SparkSession, d: str) -> DataFrame:
    """Links whose line of sight meets an area's outer ring, each with the area."""
    zones = fixed(table(spark, d, "areas").select("area_id", F.col("outer_ring").alias("ring")))
    ls = links(spark, d)
    side = lambda k, f: f(F.transform("ring", lambda p: p[k]))
    boxed = zones.select("*", *(side(k, f).alias(f"{k}{n}") for k in ("lon", "lat") for n, f in ((0, F.array_min), (1, F.array_max))))
    near = F.expr("greatest(tx_lat, rx_lat) >= lat0 and least(tx_lat, rx_lat) <= lat1 and (abs(tx_lon - rx_lon) > 180 or (greatest(tx_lon, rx_lon) >= lon0 and least(tx_lon, rx_lon) <= lon1))")
    hit = ls.join(F.broadcast(boxed), near).filter(los.through_zone(F.col("ring"), "tx_lon", "tx_lat", "rx_lon", "rx_lat"))  # a fixed table
    return hit.select("link_row", "area_id")


def metrics(network_sites: DataFrame, network_links: DataFrame) -> DataFrame:
    """One row of figures of a network: counts, lengths and classes, as nested structs; two scans, each combined before it moves."""
    active = F.col("status").isin(*ACTIVE)
    s = network_sites.agg(F.struct(F.count(F.lit(1)).alias("total"), F.count_if(active).alias("active"), *(F.count_if(active & (F.col("site_type") == t)).alias(t.lower()) for t in ("POP", "DN", "CN"))).alias("sites"))
    m = network_links.withColumns({"m": F.round(link_length(), 6), "link_type": link_type()})
    stats = F.struct(F.count(F.lit(1)).alias("total"), F.count_if(active).alias("active"), r(F.avg("m"), 2).alias("avg_m"), r(F.max("m"), 2).alias("max_m"), r(F.sum(F.when(active, F.col("capacity"))), 6).alias("gbps"))
    return s.crossJoin(F.broadcast(m.agg(stats.alias("links"))))  # one row each


def pipe_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = metrics(sites(spark, d), links(spark, d))
    return out.select(*(F.col(f"sites.{k}").alias(f"sites_{k}") for k in ("total", "active", "pop", "dn", "cn")), *(F.col(f"links.{k}").alias(f"links_{k}") for k in ("total", "active", "avg_m", "max_m", "gbps")))


def cover_clients(edges: pd.DataFrame) -> pd.DataFrame:
    """Relays picked one by one, each the one that newly connects most clients to the picked network, until none adds any: order, site_id, clients.

    edges: a plan's graph. A relay can be picked once it hears the source or a picked relay; ties go to the smaller name.
    """
    out_of: dict[str, set[str]] = {}
    clients: dict[str, set[str]] = {}
    homes = {a for a, k in zip(edges["src"], edges["kind"], strict=True) if k == "DEMAND"}
    for a, b, k in zip(edges["src"], edges["dst"], edges["kind"], strict=True):
        if k in ("WIRELESS", "WIRED"):
            (clients if b in homes else out_of).setdefault(a, set()).add(b)
    heard_by: dict[str, list[str]] = {}
    into: dict[str, list[str]] = {}
    for back, to in ((heard_by, clients), (into, out_of)):
        for a, ends in to.items():
            for b in ends:
                back.setdefault(b, []).append(a)
    gains = {a: len(c) for a, c in clients.items()}  # clients not covered yet
    leads = {a: sum(b in gains for b in ends) for a, ends in out_of.items()}  # neighbours that are not picked and have such clients
    # both only fall: an entry of by_gain may be too good and is put back then, one of by_name that leads nowhere never will again
    known = {b for b, k in zip(edges["dst"], edges["kind"], strict=True) if k == "SOURCE"}
    by_name = sorted(known)
    by_gain = [(-gains.get(n, 0), n) for n in by_name]
    heapq.heapify(by_gain)
    picked: list[tuple[int, str, int]] = []
    covered: set[str] = set()
    used: set[str] = set()
    while True:
        best = None
        while by_gain and best is None:
            had, n = by_gain[0]
            if n in used or not had:
                heapq.heappop(by_gain)
            elif -had != gains[n]:
                heapq.heapreplace(by_gain, (-gains[n], n))
            else:
                best = n
        if best is None:
            # a relay that leads on to others may still be needed
            while by_name and (by_name[0] in used or not leads.get(by_name[0])):
                heapq.heappop(by_name)
            if not by_name:
                break
            best = by_name[0]
        gain = clients.get(best, set()) - covered
        picked.append((len(picked) + 1, best, len(gain)))
        used.add(best)
        if gain:
            for n in into.get(best, ()):
                leads[n] -= 1
        covered |= gain
        for n in (x for c in gain for x in heard_by[c]):
            gains[n] -= 1
            if not gains[n] and n not in used:
                for x in into.get(n, ()):
                    leads[x] -= 1
        for n in out_of.get(best, set()) - known:
            known.add(n)
            heapq.heappush(by_name, n)
            heapq.heappush(by_gain, (-gains.get(n, 0), n))
    return pd.DataFrame(picked, columns=["step", "site_id", "clients"])


def pipe_cover_clients(spark: SparkSession, d: str) -> DataFrame:
    return graph.per_plan(_edges(spark, d), cover_clients, "step bigint, site_id string, clients bigint")


def two_way_edges(edges: pd.DataFrame) -> pd.DataFrame:
    """Links that carry two paths from sources to each relay that has them, sharing no other relay: src, dst, relays.

    Relays are split into an entry and an exit of capacity 1; two augmenting paths per relay are all that is needed, each
    a shortest one, the first in breadth-first order. Sources are not limited. First paths are in one breadth-first tree.
    Taking one changes neither level nor order of a node behind another first link, as a step back costs two levels, so the
    second search begins at the links from there into what is behind its own first link.
    """
    sources = {b for b, k in zip(edges["dst"], edges["kind"], strict=True) if k == "SOURCE"}
    homes = {a for a, k in zip(edges["src"], edges["kind"], strict=True) if k == "DEMAND"}
    real = [(a, b) for a, b, k in zip(edges["src"], edges["dst"], edges["kind"], strict=True) if k in ("WIRELESS", "WIRED") and b not in sources and b not in homes]
    names = sorted(sources.union(*real))
    at = {n: 2 * i for i, n in enumerate(names)}  # the entry; the exit is the next number
    out: list[list[int]] = [[] for _ in range(2 * len(names))]
    into: list[list[int]] = [[] for _ in out]
    relays = sorted({at[b] for _, b in real})
    for a, b in [(at[a] + 1, at[b]) for a, b in real] + [(n, n + 1) for n in relays]:
        out[a].append(b)
        into[b].append(a)
    starts = [at[s] + 1 for s in sorted(sources, key=lambda s: f"{s}|out")]
    order, parent, level = graph.breadth_first(out, starts)
    rank = {n: k for k, n in enumerate(order)}
    first = [-1] * len(out)  # the node behind the first link of each node's path
    for n in order:
        if level[n] > 0:
            first[n] = n if level[n] == 1 else first[parent[n]]
    entries: dict[int, dict[int, dict[int, int]]] = {}  # by first link, level and node: the foremost of the nodes from which a link enters there
    for m in order:
        for n in into[m] if first[m] >= 0 else ():
            if level[n] >= 0 and first[n] != first[m] and not (first[m] == m and parent[m] == n):
                here = entries.setdefault(first[m], {}).setdefault(level[n] + 1, {})
                if m not in here or rank[n] < rank[here[m]]:
                    here[m] = n

    def second(relay: int, before: dict[int, int]) -> dict[int, int] | None:
        """Each node's parent behind the first link when one path, of which before has each node's parent, is taken."""
        top, found, ahead = first[relay], {}, {}
        there = entries.get(top, {})
        after = {p: n for n, p in before.items()}

        def earlier(x: int, y: int) -> bool:
            """Whether x comes before y, both of one level, by the place at which their paths part."""
            px, py = found.get(x, parent[x]), found.get(y, parent[y])
            while px != py:
                if x not in found and y not in found:
                    return rank[x] < rank[y]
                if px < 0 or py < 0:
                    break
                x, y = px, py
                px, py = found.get(x, parent[x]), found.get(y, parent[y])
            if px < 0:
                return rank[x] < rank[y]
            place = lambda n: out[px].index(n) if n in out[px] else len(out[px])
            return place(x) < place(y)

        levels, now = sorted(there, reverse=True), 0
        while ahead or levels:
            now = now + 1 if ahead else levels[-1]
            if levels and levels[-1] == now:
                levels.pop()
                for m, n in there[now].items():
                    if m not in found and (m not in ahead or earlier(n, ahead[m])):
                        ahead[m] = n
            found |= ahead
            if relay in found:
                return found
            reached, ahead = ahead, {}
            for n in reached:
                for m in (*out[n], before[n]) if n in before else out[n]:
                    if first[m] == top and m not in found and after.get(n) != m and (m not in ahead or earlier(n, ahead[m])):
                        ahead[m] = n
        return None

    count: dict[tuple[int, int], int] = {}
    for relay in relays:
        if first[relay] not in entries:
            continue
        before, n = {}, relay
        while parent[n] >= 0:
            before[n], n = parent[n], parent[n]
        found = second(relay, before)
        if found is None:
            continue
        flow, n = {(p, n) for n, p in before.items()}, relay
        while (p := found.get(n, parent[n])) >= 0:
            if (n, p) in flow:
                flow.discard((n, p))
            else:
                flow.add((p, n))
            n = p
        for a, b in flow:
            if a % 2:
                count[a, b] = count.get((a, b), 0) + 1
    return pd.DataFrame([(names[a // 2], names[b // 2], n) for (a, b), n in sorted(count.items())], columns=["src", "dst", "relays"])


def pipe_two_way_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.per_plan(_edges(spark, d), two_way_edges, "src string, dst string, relays bigint")


QUERIES = {f.__name__: f for f in (pipe_candidate_network, los_exclusion_zones, pipe_metrics, pipe_cover_clients, pipe_two_way_edges)}
ORACLES = {
    "los_exclusion_zones": BASE_SQL + """, co AS (SELECT area_id, unnest(outer_ring) AS p, generate_subscripts(outer_ring, 1) AS i FROM areas WHERE len(outer_ring) > 3),
eg AS (SELECT a.area_id, a.p.lon AS ax, a.p.lat AS ay, b.p.lon AS bx, b.p.lat AS by_ FROM co a JOIN co b ON a.area_id = b.area_id AND b.i = a.i + 1),
lw AS (SELECT link_row, tx_lon AS x1, tx_lat AS y1, tx_lon + CASE WHEN rx_lon - tx_lon >= 180 THEN rx_lon - tx_lon - 360 WHEN rx_lon - tx_lon < -180 THEN rx_lon - tx_lon + 360 ELSE rx_lon - tx_lon END AS x2, rx_lat AS y2 FROM ln),
li AS (SELECT * FROM lw UNION ALL SELECT link_row, x1 - 360, y1, x2 - 360, y2 FROM lw WHERE x2 > 180 UNION ALL SELECT link_row, x1 + 360, y1, x2 + 360, y2 FROM lw WHERE x2 < -180),
tc AS (SELECT DISTINCT link_row, area_id FROM li JOIN eg ON greatest(ax, bx) >= least(x1, x2) AND least(ax, bx) <= greatest(x1, x2) AND greatest(ay, by_) >= least(y1, y2) AND least(ay, by_) <= greatest(y1, y2)
  WHERE sign((x2 - x1) * (ay - y1) - (y2 - y1) * (ax - x1)) * sign((x2 - x1) * (by_ - y1) - (y2 - y1) * (bx - x1)) <= 0 AND sign((bx - ax) * (y1 - ay) - (by_ - ay) * (x1 - ax)) * sign((bx - ax) * (y2 - ay) - (by_ - ay) * (x2 - ax)) <= 0),
ins AS (SELECT link_row, area_id FROM li JOIN eg ON (ay > y1) <> (by_ > y1) AND x1 < (bx - ax) * (y1 - ay) / (by_ - ay) + ax GROUP BY link_row, area_id, x1 HAVING count(*) % 2 = 1)
SELECT link_row, area_id FROM tc UNION SELECT link_row, area_id FROM ins""",
    "pipe_metrics": BASE_SQL
    + f""", s AS (SELECT count(*) AS sites_total, {", ".join(f"count(*) FILTER (status IN ('PROPOSED', 'EXISTING'){x}) AS sites_{n}" for n, x in (("active", ""), ("pop", " AND site_type = 'POP'"), ("dn", " AND site_type = 'DN'"), ("cn", " AND site_type = 'CN'")))} FROM st),
l AS (SELECT count(*) AS links_total, count(*) FILTER (status IN ('PROPOSED', 'EXISTING')) AS links_active, round(avg(round({length_sql()}, 6)), 2) + 0 AS links_avg_m, round(max(round({length_sql()}, 6)), 2) + 0 AS links_max_m, round(sum(capacity) FILTER (status IN ('PROPOSED', 'EXISTING')), 6) + 0 AS links_gbps FROM ln)
SELECT * FROM s, l""",
}
