"""Queries of the planning models' rows over all plans. Clients are demands of size 1; sites weigh 1 each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.operators import models
from meshwright.plans.domain import ACTIVE, links, sites
from meshwright.plans.relational import _SECTORED, _with_sectors
from meshwright.plans.scalars import r

RULES = models.Rules(coverage=0.9)


def network(spark: SparkSession, d: str) -> models.Network:
    s = sites(spark, d)
    place = F.min("site_id").over(Window.partitionBy("plan_id", "lon", "lat", "alt"))
    ls = links(spark, d).filter("tx_type <> 'CN' or not is_wireless")
    toward = _with_sectors(ls).select("link_row", "tx_sector", "rx_sector")
    ls = ls.join(toward, "link_row", "left")
    ends = F.explode(F.array(*(F.struct(F.col(f"{e}_sector").alias("sector_id"), F.col(f"{e}_id").alias("site_id"), F.col(f"{e}_type").alias("site_type")) for e in ("tx", "rx")))).alias("e")
    active = F.coalesce(F.col("status").isin(*ACTIVE), F.lit(False))
    sectors = ls.filter("tx_sector is not null").select("plan_id", ends, active.alias("active")).groupBy("plan_id", "e.sector_id", "e.site_id", "e.site_type").agg(F.bool_or("active").alias("active"))
    node = F.floor(F.substring_index("sector_id", "-", -1).cast("int") / 2).cast("string")
    return models.Network(
        s.select("plan_id", "site_id", "site_type", "status", place.alias("place"), F.lit(1.0).alias("weight")),
        sectors.select("plan_id", "sector_id", "site_id", node.alias("node"), "site_type", F.when(F.col("active"), "PROPOSED").otherwise("CANDIDATE").alias("status")),
        ls.select("plan_id", F.col("tx_id").alias("src"), F.col("rx_id").alias("dst"), (~F.col("is_wireless")).alias("wired"), "capacity", "status", "tx_sector", "rx_sector"),
        s.filter("site_type = 'CN'").select("plan_id", F.concat(F.lit("demand:"), "site_id").alias("demand"), "site_id", F.lit(1.0).alias("size")),
    )


def _out(rows: DataFrame) -> DataFrame:
    return rows.select("plan_id", "row_id", "variable", r("coefficient", 6).alias("coefficient"), "sense", r("bound", 6).alias("bound"))


def plan_site_rows(spark: SparkSession, d: str) -> DataFrame:
    """Flow needs built sites, sources have a capacity, and the shortage is limited."""
    net = models.prepared(network(spark, d))
    return _out(models.flow_site_rows(net).unionByName(models.source_load_rows(net, RULES)).unionByName(models.coverage_rows(net, RULES)))


def plan_balance_rows(spark: SparkSession, d: str) -> DataFrame:
    """What comes in less what goes out, with shortages at the demands and the source."""
    return _out(models.balance_rows(models.prepared(network(spark, d))))


def plan_decided_rows(spark: SparkSession, d: str) -> DataFrame:
    """Sites that are decided by their status or by others at their place, and links without flow."""
    net = models.prepared(network(spark, d))
    return _out(models.decided_site_rows(net, RULES).unionByName(models.place_rows(net, RULES)).unionByName(models.idle_link_rows(net)))


def plan_link_rows(spark: SparkSession, d: str) -> DataFrame:
    """Which links may be used together."""
    return _out(models.link_rows(network(spark, d), RULES))


def plan_sector_rows(spark: SparkSession, d: str) -> DataFrame:
    """Time, site and node of sectors."""
    return _out(models.sector_rows(models.prepared(network(spark, d)), RULES))


def plan_demand_rows(spark: SparkSession, d: str) -> DataFrame:
    """The model of the demands that can be connected at once."""
    return _out(models.demand_model(network(spark, d), models.Rules(polarities=False)).rows)


QUERIES = {f.__name__: f for f in (plan_site_rows, plan_balance_rows, plan_decided_rows, plan_link_rows, plan_sector_rows, plan_demand_rows)}

_MODEL = _SECTORED + """, nt AS (SELECT plan_id, site_id, site_type, coalesce(status, 'CANDIDATE') AS status, min(site_id) OVER (PARTITION BY plan_id, lon, lat, alt) AS place FROM st),
rk AS (SELECT ln.plan_id, ln.tx_id AS src, ln.rx_id AS dst, ln.tx_type AS src_type, ln.rx_type AS dst_type, NOT ln.is_wireless AS wired, coalesce(ln.capacity, 0e0) AS capacity, coalesce(ln.status, 'CANDIDATE') AS status, tx_sector, rx_sector
  FROM ln LEFT JOIN (SELECT link_row, tx_sector, rx_sector FROM sc) USING (link_row) WHERE ln.tx_type <> 'CN' OR NOT ln.is_wireless),
dm AS (SELECT plan_id, 'demand:' || site_id AS demand, site_id FROM nt WHERE site_type = 'CN'),
tt AS (SELECT plan_id, CAST(count(*) AS DOUBLE) AS total FROM dm GROUP BY 1),
ed AS (SELECT plan_id, src, dst, CASE WHEN wired THEN 'WIRED' ELSE 'WIRELESS' END AS kind FROM rk UNION ALL SELECT plan_id, 'SUPERSOURCE', site_id, 'SOURCE' FROM nt WHERE site_type = 'POP' UNION ALL SELECT plan_id, site_id, demand, 'DEMAND' FROM dm),
en AS (SELECT plan_id, src AS node, 'flow:' || src || '>' || dst AS flow, -1e0 AS sign FROM ed UNION ALL SELECT plan_id, dst, 'flow:' || src || '>' || dst, 1e0 FROM ed),
fe AS (SELECT en.*, coalesce(total, 0e0) AS total, node <> 'SUPERSOURCE' AND NOT starts_with(node, 'demand:') AS is_site, CASE WHEN sign > 0 THEN 'in:' ELSE 'out:' END AS side FROM en LEFT JOIN tt USING (plan_id)),
us AS (SELECT *, status IN ('PROPOSED', 'EXISTING') OR (plan_id, site_id) IN (SELECT (plan_id, unnest([src, dst])) FROM rk WHERE status IN ('PROPOSED', 'EXISTING')) AS used, CASE site_type WHEN 'POP' THEN 3 WHEN 'DN' THEN 2 ELSE 1 END AS rank FROM nt),
pw AS (SELECT *, count(*) OVER (PARTITION BY plan_id, place) AS n, max(CASE WHEN used THEN rank END) OVER (PARTITION BY plan_id, place) AS top FROM us),
ul AS (SELECT *, src || '>' || dst AS l FROM rk WHERE NOT wired AND capacity > 0 AND tx_sector IS NOT NULL AND rx_sector IS NOT NULL),
si AS (SELECT DISTINCT plan_id, unnest([tx_sector, rx_sector]) AS sector_id, unnest([src, dst]) AS site_id, unnest([src_type, dst_type]) AS site_type FROM rk WHERE tx_sector IS NOT NULL),
sa AS (SELECT DISTINCT plan_id, unnest([tx_sector, rx_sector]) AS sector_id FROM rk WHERE tx_sector IS NOT NULL AND status IN ('PROPOSED', 'EXISTING'))
"""


def _term(variable: str, coefficient: str = "1e0") -> str:
    return f"{variable} AS variable, {coefficient} AS coefficient"


def _union(*parts: str) -> str:
    return _MODEL + ", m(plan_id, row_id, variable, coefficient, sense, bound) AS (" + " UNION ALL ".join(parts) + ") SELECT plan_id, row_id, variable, round(coefficient, 6) + 0 AS coefficient, sense, round(bound, 6) + 0 AS bound FROM m"


_LIMIT = lambda name, most, some: (
    f"SELECT plan_id, 'sector_{name}:' || tx_sector, 'link:' || l, 1e0, '<=', 0e0 FROM ul WHERE {some} QUALIFY count(*) OVER (PARTITION BY plan_id, tx_sector) >= {most}",
    f"SELECT plan_id, 'sector_{name}:' || tx_sector, 'sector:' || tx_sector || ':0', -{most}e0, '<=', 0e0 FROM ul WHERE {some} GROUP BY plan_id, tx_sector HAVING count(*) >= {most}",
)
_RELAY = "src_type IN ('POP', 'DN') AND dst_type IN ('POP', 'DN')"
ORACLES = {
    "plan_site_rows": _union(
        "SELECT plan_id, 'use:' || side || node, flow, 1e0, '<=', CASE WHEN is_site THEN 0 ELSE total END FROM fe",
        "SELECT DISTINCT plan_id, 'use:' || side || node, 'site:' || node, -total, '<=', 0e0 FROM fe WHERE is_site",
        f"SELECT plan_id, 'load:' || src, 'flow:' || src || '>' || dst, 1e0, '<=', {RULES.source_capacity}e0 FROM ed WHERE (plan_id, src) IN (SELECT (plan_id, site_id) FROM nt WHERE site_type = 'POP')",
        f"SELECT plan_id, 'coverage', 'shortage:' || demand, 1e0, '<=', {1 - RULES.coverage!r}e0 * total FROM dm JOIN tt USING (plan_id)",
    ),
    "plan_balance_rows": _union(
        "SELECT plan_id, 'balance:' || node, flow, sign, '=', CASE WHEN node = 'SUPERSOURCE' THEN -total WHEN is_site THEN 0 ELSE 1 END FROM fe",
        "SELECT plan_id, 'balance:' || demand, 'shortage:' || demand, 1e0, '=', 1e0 FROM dm",
        "SELECT plan_id, 'balance:SUPERSOURCE', 'shortage:' || demand, -1e0, '=', -total FROM dm JOIN tt USING (plan_id) WHERE plan_id IN (SELECT plan_id FROM nt WHERE site_type = 'POP')",
    ),
    "plan_decided_rows": _union(
        "SELECT plan_id, 'decided:' || site_id, 'site:' || site_id, 1e0, '=', 1e0 FROM pw WHERE status IN ('PROPOSED', 'EXISTING') AND n = 1",
        "SELECT plan_id, 'decided:' || site_id, 'site:' || site_id, 1e0, '=', 0e0 FROM pw WHERE status IN ('UNAVAILABLE', 'UNREACHABLE')",
        "SELECT plan_id, 'place:' || place, 'site:' || site_id, 1e0, CASE WHEN top IS NULL THEN '<=' ELSE '=' END, 1e0 FROM pw WHERE n > 1",
        "SELECT plan_id, 'excluded:' || place, 'site:' || site_id, 1e0, '=', 0e0 FROM pw WHERE n > 1 AND top IS NOT NULL AND ((top > 1 AND rank <> top) OR (rank = top AND NOT used))",
        "SELECT plan_id, 'idle:' || src || '>' || dst, 'flow:' || src || '>' || dst, 1e0, '=', 0e0 FROM rk WHERE status IN ('UNAVAILABLE', 'UNREACHABLE')",
    ),
    "plan_link_rows": _union(
        "SELECT plan_id, 'carries:' || l, unnest(['flow:' || l, 'link:' || l]), unnest([1e0, -capacity]), '<=', 0e0 FROM ul",
        "SELECT plan_id, 'times:' || l, unnest(['time:' || l || ':0', 'link:' || l]), unnest([1e0, -1e0]), '<=', 0e0 FROM ul",
        "SELECT plan_id, 'client:' || dst, 'link:' || l, 1e0, '<=', 1e0 FROM ul WHERE dst_type = 'CN'",
        "SELECT plan_id, 'keeps:' || l, 'link:' || l, 1e0, '=', 1e0 FROM ul WHERE status IN ('PROPOSED', 'EXISTING')",
        "SELECT plan_id, 'drops:' || l, 'link:' || l, 1e0, '=', 0e0 FROM ul WHERE status IN ('UNAVAILABLE', 'UNREACHABLE')",
        "SELECT a.plan_id, 'both_ways:' || a.l, unnest(['link:' || a.l, 'link:' || b.l]), unnest([1e0, -1e0]), '=', 0e0 FROM ul a JOIN ul b ON a.plan_id = b.plan_id AND a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst",
        f"SELECT plan_id, 'link_polarity_low:' || l, unnest(['link:' || l, 'odd:' || src, 'odd:' || dst]), unnest([1e0, -1e0, -1e0]), '<=', 0e0 FROM ul WHERE {_RELAY} AND status NOT IN ('PROPOSED', 'EXISTING')",
        f"SELECT plan_id, 'link_polarity_high:' || l, unnest(['link:' || l, 'odd:' || src, 'odd:' || dst]), unnest([1e0, 1e0, 1e0]), '<=', 2e0 FROM ul WHERE {_RELAY} AND status NOT IN ('PROPOSED', 'EXISTING')",
        "SELECT plan_id, 'needs_tx_sector:' || l, unnest(['link:' || l, 'sector:' || tx_sector || ':0']), unnest([1e0, -1e0]), '<=', 0e0 FROM ul",
        "SELECT plan_id, 'needs_rx_sector:' || l, unnest(['link:' || l, 'sector:' || rx_sector || ':0']), unnest([1e0, -1e0]), '<=', 0e0 FROM ul",
        *_LIMIT("relays", RULES.relays_per_sector, _RELAY), *_LIMIT("links", RULES.links_per_sector, "src_type IN ('POP', 'DN')"),
    ),
    "plan_sector_rows": _union(
        "SELECT plan_id, 'time:' || unnest(['tx:', 'rx:']) || 'sector:' || unnest([tx_sector, rx_sector]) || ':0', 'time:' || src || '>' || dst || ':0', 1e0, '<=', 0e0 FROM rk WHERE NOT wired AND tx_sector IS NOT NULL",
        "SELECT DISTINCT plan_id, 'time:' || w || 'sector:' || s || ':0', 'sector:' || s || ':0', -1e0, '<=', 0e0 FROM (SELECT plan_id, unnest(['tx:', 'rx:']) AS w, unnest([tx_sector, rx_sector]) AS s FROM rk WHERE NOT wired AND tx_sector IS NOT NULL)",
        "SELECT plan_id, 'built:' || sector_id, unnest(['sector:' || sector_id || ':0', 'site:' || site_id]), unnest([1e0, -1e0]), '<=', 0e0 FROM si",
        "SELECT plan_id, 'stays:' || sector_id, 'sector:' || sector_id || ':0', 1e0, '=', 1e0 FROM sa",
        "SELECT plan_id, 'node:' || sector_id, unnest(['sector:' || sector_id || ':0', 'sector:' || next || ':0']), unnest([1e0, -1e0]), '=', 0e0 FROM (SELECT *, lead(sector_id) OVER (PARTITION BY plan_id, site_id, CAST(split_part(sector_id, '-', -1) AS INTEGER) // 2 ORDER BY sector_id) AS next FROM si) WHERE next IS NOT NULL",
    ),
    "plan_demand_rows": _union(
        "SELECT fe.plan_id, 'through:' || node, flow, sign, '=', 0e0 FROM fe JOIN nt ON nt.plan_id = fe.plan_id AND site_id = node WHERE status NOT IN ('UNAVAILABLE', 'UNREACHABLE')",
        "SELECT fe.plan_id, 'closed:' || node, flow, 1e0, '=', 0e0 FROM fe JOIN nt ON nt.plan_id = fe.plan_id AND site_id = node WHERE status IN ('UNAVAILABLE', 'UNREACHABLE')",
        "SELECT plan_id, 'reached:' || node, flow, -10 * total, '<=', 0e0 FROM fe WHERE starts_with(node, 'demand:')",
        "SELECT plan_id, 'reached:' || demand, 'demand:' || demand, 1e0, '<=', 0e0 FROM dm",
        "SELECT plan_id, 'idle:' || src || '>' || dst, 'flow:' || src || '>' || dst, 1e0, '=', 0e0 FROM rk WHERE status IN ('UNAVAILABLE', 'UNREACHABLE')",
    ),
}
