"""Queries of the graph operators over each plan's network."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.operators import graph, outages, polarity
from meshwright.plans.domain import ACTIVE, BASE_SQL, available_links, links, sites, wireless
from meshwright.plans.relational import _SECTORED, _with_sectors


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.build_edges(sites(spark, d), links(spark, d))


def _edges_without_cost(spark: SparkSession, d: str) -> DataFrame:
    return graph.build_edges(sites(spark, d), links(spark, d, available_links(spark, d)).withColumn("mcs", F.lit(0))).drop("cost")


def _pops(edges: DataFrame) -> DataFrame:
    return edges.filter("kind = 'SOURCE'").select(F.col("dst").alias("node"))


def _real(edges: DataFrame) -> DataFrame:
    return edges.filter("kind in ('WIRELESS', 'WIRED')")


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """All edges; links without a usable class have no cost."""
    return _edges(spark, d).select("plan_id", "src", "dst", "kind", F.when(F.col("cost") < 1e9, F.col("cost")).alias("cost"))


def graph_hops_from_pops(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return graph.hops(_pops(e), _real(e))


def graph_reachable_demand(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    reached = graph.hops(_pops(e), _real(e))
    return e.filter("kind = 'DEMAND'").join(reached.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("demand"))


def graph_mark_unreachable(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return graph.mark_unreachable(sites(spark, d), graph.hops(_pops(e), _real(e)), 15).select("site_id", "site_type", "status")


def _paths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _edges(spark, d)
    return e, graph.shortest(_pops(e), _real(e))


def graph_route_mcs(spark: SparkSession, d: str) -> DataFrame:
    """Least routing cost of each site."""
    return _paths(spark, d)[1].select(F.col("node").alias("site_id"), "cost")


def graph_route_hops(spark: SparkSession, d: str) -> DataFrame:
    """Routes with the fewest hops: each site's level and the site before it, the first of several."""
    e = _edges(spark, d)
    paths = graph.shortest(_pops(e), _real(e).withColumn("cost", F.lit(1.0)))
    return paths.select(F.col("node").alias("site_id"), F.col("cost").cast("int").alias("hops"), "parent")


def graph_route_links(spark: SparkSession, d: str) -> DataFrame:
    """Links on the cheapest routes to all clients."""
    e, paths = _paths(spark, d)
    return graph.route_edges(paths, e.filter("kind = 'DEMAND'").select(F.col("src").alias("node")))


def graph_redundant_links(spark: SparkSession, d: str) -> DataFrame:
    """Links on no cheapest route in either direction."""
    e = _edges(spark, d)
    used = graph_route_links(spark, d)
    both = used.select("src", "dst").unionAll(used.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return _real(e).select("src", "dst").distinct().join(both.distinct(), ["src", "dst"], "left_anti")


def graph_route_zones(spark: SparkSession, d: str) -> DataFrame:
    """Sites of each source's zone: those whose route starts there."""
    return graph.zones(_paths(spark, d)[1]).groupBy(F.col("zone").alias("pop_id")).agg(F.count(F.lit(1)).alias("sites"))


def graph_edge_failures(spark: SparkSession, d: str) -> DataFrame:
    out = graph.per_plan(_edges(spark, d), graph.failures, "kind string, a string, b string, lost bigint")
    return out.filter("kind = 'link' and lost > 0").select("plan_id", "a", "b", "lost")


def graph_site_failures(spark: SparkSession, d: str) -> DataFrame:
    out = graph.per_plan(_edges(spark, d), graph.failures, "kind string, a string, b string, lost bigint")
    return out.filter("kind = 'site' and lost > 0").select("plan_id", F.col("a").alias("site_id"), "lost")


def topk_disruptive_links(spark: SparkSession, d: str) -> DataFrame:
    """The 10 links whose failure cuts off most demands: a top-k report."""
    return graph_edge_failures(spark, d).orderBy(F.desc("lost"), "a", "b").limit(10)


def graph_disjoint_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.per_plan(_edges(spark, d), graph.disjoint, "demand string, hops bigint, two_paths boolean")


def _flow(edges: pd.DataFrame) -> pd.DataFrame:
    """Most that all sources together can send to all clients, a class's cost standing for how little it carries."""
    rows = [(a, "sink" if k == "DEMAND" else b, 1e6 if k != "WIRELESS" else 15.0 / c) for a, b, k, c in zip(edges["src"], edges["dst"], edges["kind"], edges["cost"], strict=True)]
    return pd.DataFrame({"flow": [round(graph.max_flow(rows, graph.SOURCE, "sink"), 6)]})


def graph_max_flow(spark: SparkSession, d: str) -> DataFrame:
    return graph.per_plan(_edges(spark, d), _flow, "flow double")


def graph_availability(spark: SparkSession, d: str) -> DataFrame:
    kernel = functools.partial(outages.availability, link_availability=0.999, horizon=100.0, seed=7)
    return graph.per_plan(_edges_without_cost(spark, d), kernel, "demand string, availability double", ordered=False)


def agg_availability_percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = graph_availability(spark, d).groupBy("plan_id")
    return out.agg(F.avg("availability").alias("mean"), F.percentile("availability", F.array(*(F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("quartiles"))


def _polarity(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return polarity.by_hops(graph.hops(_pops(e), _real(e)))


def polarity_by_hops(spark: SparkSession, d: str) -> DataFrame:
    return _polarity(spark, d)


def polarity_of_clients(spark: SparkSession, d: str) -> DataFrame:
    relays = sites(spark, d).filter("site_type <> 'CN'").select("site_id")
    return polarity.of_clients(wireless(links(spark, d)), _polarity(spark, d).join(relays, "site_id", "left_semi"))


def polarity_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return polarity.conflicts(wireless(links(spark, d)), _polarity(spark, d)).select("link_row")


def sector_status_in_node(spark: SparkSession, d: str) -> DataFrame:
    """Sectors by whether they and their node (two neighbouring sectors) carry an active link."""
    ls = _with_sectors(links(spark, d))
    own = ls.groupBy("tx_id", "tx_sector").agg(F.bool_or(F.coalesce(F.col("status").isin(*ACTIVE), F.lit(False))).alias("active"))
    position = F.substring_index("tx_sector", "-", -1).cast("int")
    shared = polarity.share_in_node(own.select(F.col("tx_sector").alias("sector_id"), F.col("tx_id").alias("site_id"), F.floor(position / 2).alias("node"), "active"))
    return shared.select("sector_id", "active", "node_active")


QUERIES = {
    f.__name__: f
    for f in (
        graph_edges, graph_hops_from_pops, graph_reachable_demand, graph_mark_unreachable, graph_route_hops, graph_route_mcs, graph_route_links, graph_redundant_links, graph_route_zones, graph_edge_failures,
        graph_site_failures, topk_disruptive_links, graph_disjoint_paths, graph_max_flow, graph_availability, agg_availability_percentiles,
        polarity_by_hops, polarity_of_clients, polarity_conflicts, sector_status_in_node,
    )
}

_EDGES = BASE_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
re AS (SELECT plan_id, tx_id AS src, rx_id AS dst, is_wireless, CASE WHEN NOT is_wireless OR mcs >= 9 THEN 1e0 WHEN mcs >= 4 THEN 3e0 WHEN mcs >= 2 THEN 15e0 END AS cost FROM ln
  WHERE status <> 'UNAVAILABLE' AND tx_status <> 'UNAVAILABLE' AND rx_status <> 'UNAVAILABLE' AND (tx_type <> 'CN' OR NOT is_wireless)),
pop AS (SELECT site_id FROM st WHERE site_type = 'POP' AND status <> 'UNAVAILABLE'),
h AS (SELECT site_id AS node, 0 AS hops FROM pop UNION SELECT dst, hops + 1 FROM h JOIN re ON src = node WHERE hops < 40),
lv AS (SELECT node, min(hops) AS hops FROM h GROUP BY 1)
"""
# cheapest routes, by relaxing all of them at once up to a cost that none exceeds, with the smallest of equally good parents
_ROUTES = _EDGES + """, c AS (SELECT site_id AS node, 0e0 AS cost FROM pop UNION SELECT dst, c.cost + re.cost FROM c JOIN re ON src = node WHERE re.cost IS NOT NULL AND c.cost + re.cost <= 60),
bs AS (SELECT node, min(cost) AS cost FROM c GROUP BY 1),
pa AS (SELECT e.dst AS node, min(e.src) AS parent FROM re e JOIN bs b ON b.node = e.src JOIN bs t ON t.node = e.dst WHERE t.cost > 0 AND b.cost + e.cost = t.cost GROUP BY 1),
wk AS (SELECT site_id AS node FROM st WHERE site_type = 'CN' AND status <> 'UNAVAILABLE' UNION SELECT parent FROM wk JOIN pa USING (node)),
rt AS (SELECT parent AS src, node AS dst FROM wk JOIN pa USING (node)),
zn AS (SELECT node, node AS z FROM bs UNION SELECT zn.node, parent FROM zn JOIN pa ON pa.node = zn.z)
"""
# each failure by itself: what is still reached without the link (in both directions) or the site
_FAILURES = _EDGES + """, pp AS (SELECT plan_id, site_id FROM st WHERE site_type = 'POP' AND status <> 'UNAVAILABLE'),
cn AS (SELECT plan_id, site_id FROM st JOIN lv ON node = site_id WHERE site_type = 'CN' AND status <> 'UNAVAILABLE'),
al AS (SELECT plan_id, count(*) AS n FROM cn GROUP BY 1),
pr AS (SELECT DISTINCT plan_id, least(src, dst) AS a, greatest(src, dst) AS b FROM re),
fl AS (SELECT pr.plan_id, a, b, site_id AS node FROM pr JOIN pp USING (plan_id) UNION SELECT fl.plan_id, a, b, re.dst FROM fl JOIN re ON re.src = fl.node WHERE NOT (re.src IN (a, b) AND re.dst IN (a, b))),
fk AS (SELECT pr.plan_id, pr.a, pr.b, al.n - count(cn.site_id) AS lost FROM pr JOIN al USING (plan_id) LEFT JOIN fl ON fl.plan_id = pr.plan_id AND fl.a = pr.a AND fl.b = pr.b LEFT JOIN cn ON cn.site_id = fl.node GROUP BY pr.plan_id, pr.a, pr.b, al.n)
"""
_SITE_FAILURES = _EDGES + """, pp AS (SELECT plan_id, site_id FROM st WHERE site_type = 'POP' AND status <> 'UNAVAILABLE'),
cn AS (SELECT plan_id, site_id FROM st JOIN lv ON node = site_id WHERE site_type = 'CN' AND status <> 'UNAVAILABLE'),
al AS (SELECT plan_id, count(*) AS n FROM cn GROUP BY 1),
gs AS (SELECT plan_id, site_id AS gone FROM st JOIN lv ON node = site_id),
fs AS (SELECT gs.plan_id, gone, site_id AS node FROM gs JOIN pp USING (plan_id) WHERE site_id <> gone UNION SELECT fs.plan_id, gone, re.dst FROM fs JOIN re ON re.src = fs.node WHERE re.dst <> gone)
"""
ORACLES = {
    "graph_edges": _EDGES + "SELECT plan_id, 'SUPERSOURCE' AS src, site_id AS dst, 'SOURCE' AS kind, 1e0 AS cost FROM st WHERE site_type = 'POP' AND status <> 'UNAVAILABLE' UNION ALL SELECT plan_id, site_id, 'demand:' || site_id, 'DEMAND', 1e0 FROM st WHERE site_type = 'CN' AND status <> 'UNAVAILABLE' UNION ALL SELECT plan_id, src, dst, CASE WHEN is_wireless THEN 'WIRELESS' ELSE 'WIRED' END, cost FROM re",
    "graph_hops_from_pops": _EDGES + "SELECT node, hops FROM lv",
    "graph_reachable_demand": _EDGES + "SELECT 'demand:' || site_id AS demand FROM st JOIN lv ON node = site_id WHERE site_type = 'CN' AND status <> 'UNAVAILABLE'",
    "graph_mark_unreachable": _EDGES + "SELECT site_id, site_type, CASE WHEN status = 'CANDIDATE' AND (hops IS NULL OR hops > 15) THEN 'UNREACHABLE' ELSE status END AS status FROM st LEFT JOIN lv ON node = site_id",
    "graph_route_mcs": _EDGES + ", c AS (SELECT site_id AS node, 0e0 AS cost FROM pop UNION SELECT dst, c.cost + re.cost FROM c JOIN re ON src = node WHERE re.cost IS NOT NULL AND c.cost + re.cost <= 60) SELECT node AS site_id, min(cost) AS cost FROM c GROUP BY 1",
    "graph_route_hops": _EDGES + "SELECT t.node AS site_id, t.hops, min(b.node) AS parent FROM lv t LEFT JOIN re ON re.dst = t.node LEFT JOIN lv b ON b.node = re.src AND b.hops = t.hops - 1 GROUP BY 1, 2",
    "graph_route_links": _ROUTES + "SELECT src, dst FROM rt",
    "graph_redundant_links": _ROUTES + "SELECT src, dst FROM re EXCEPT (SELECT src, dst FROM rt UNION SELECT dst, src FROM rt)",
    "graph_route_zones": _ROUTES + "SELECT z AS pop_id, count(*) AS sites FROM zn WHERE z IN (SELECT site_id FROM pop) GROUP BY 1",
    "graph_edge_failures": _FAILURES + "SELECT plan_id, a, b, lost FROM fk WHERE lost > 0",
    "topk_disruptive_links": _FAILURES + "SELECT plan_id, a, b, lost FROM fk WHERE lost > 0 ORDER BY lost DESC, a, b LIMIT 10",
    "graph_site_failures": _SITE_FAILURES + "SELECT gs.plan_id, gs.gone AS site_id, al.n - count(cn.site_id) AS lost FROM gs JOIN al USING (plan_id) LEFT JOIN fs ON fs.plan_id = gs.plan_id AND fs.gone = gs.gone LEFT JOIN cn ON cn.site_id = fs.node GROUP BY gs.plan_id, gs.gone, al.n HAVING al.n > count(cn.site_id)",
    "polarity_by_hops": _EDGES + "SELECT node AS site_id, CASE WHEN hops % 2 = 0 THEN 'EVEN' ELSE 'ODD' END AS polarity FROM lv",
    "polarity_of_clients": _EDGES + """, po AS (SELECT node, hops % 2 AS p FROM lv JOIN st ON site_id = node WHERE site_type <> 'CN')
SELECT rx_id AS site_id, CASE WHEN count(*) = count(p) AND min(p) = max(p) THEN CASE WHEN min(p) = 1 THEN 'EVEN' ELSE 'ODD' END ELSE 'UNASSIGNED' END AS polarity FROM ln LEFT JOIN po ON node = tx_id WHERE is_wireless AND tx_type <> 'CN' AND rx_type = 'CN' GROUP BY 1""",
    "polarity_conflicts": _EDGES + "SELECT link_row FROM ln JOIN lv a ON a.node = tx_id JOIN lv b ON b.node = rx_id WHERE is_wireless AND tx_type <> 'CN' AND rx_type <> 'CN' AND a.hops % 2 = b.hops % 2",
    "sector_status_in_node": _SECTORED + """, o AS (SELECT tx_id, CAST(floor(CAST(split_part(tx_sector, '-', -1) AS INTEGER) / 2) AS INTEGER) AS node, tx_sector, bool_or(coalesce(status IN ('PROPOSED', 'EXISTING'), false)) AS active FROM sc GROUP BY 1, 2, 3)
SELECT tx_sector AS sector_id, active, bool_or(active) OVER (PARTITION BY tx_id, node) AS node_active FROM o""",
}
