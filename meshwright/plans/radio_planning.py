"""Queries of interference, sector placement, planning rows and failure events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions import geo, rf
from meshwright.operators import graph, interference, placement, planning
from meshwright.plans.domain import RADIO, delta_sql, links, sites, wireless
from meshwright.plans.networks import _edges
from meshwright.plans.relational import _SECTORED, _with_sectors
from meshwright.plans.scalars import _MCS, _OFF, _SNR, _gain_sql, r, with_gain
from meshwright.streaming import failures
from meshwright.tables import table


def _radio(spark: SparkSession, d: str) -> DataFrame:
    """Wireless links, to relays and to clients, with sectors, bearing, net gain and full power."""
    ls = _with_sectors(wireless(links(spark, d))).withColumn("azimuth", F.round("azimuth", 6))
    gained = with_gain(ls.withColumn("m", F.col("length_m"))).withColumn("tx_power", F.lit(RADIO["max_power"]))
    return gained.select("plan_id", "link_row", "tx_id", "rx_id", "tx_sector", "rx_sector", "azimuth", F.col("g").alias("gain"), "tx_power")


def intf_path_levels(spark: SparkSession, d: str) -> DataFrame:
    """Mean level of each interfering path at its receiver, in dBm."""
    paths, _ = interference.sector_levels(_radio(spark, d))
    return paths.select("path_row", r(rf.to_log("level")).alias("dbm"))


def intf_net_gain_map(spark: SparkSession, d: str) -> DataFrame:
    """Net gain of each interfering path while its sender turns to each of the other links of its sector."""
    ls = _radio(spark, d)
    turned = ls.select("tx_sector", F.col("rx_id").alias("sends_to"), F.col("link_row").alias("sent_row"), F.col("azimuth").alias("send_azimuth"))
    each = ls.select(F.col("link_row").alias("path_row"), "tx_sector", "rx_id", "azimuth", "gain").join(turned, "tx_sector").filter("sends_to <> rx_id")
    gain = F.col("gain") + interference.turn_loss(F.abs(geo.angle_delta("send_azimuth", "azimuth")))
    return each.select("path_row", "sent_row", r(gain).alias("net_gain_db"))


def rf_tx_power_descent(spark: SparkSession, d: str) -> DataFrame:
    """For each class that a link can hold, from the best down, the least power that holds it."""
    gained = _radio(spark, d).select("link_row", "gain", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("mcs"))
    need = F.greatest(F.lit(RADIO["min_power"]), rf.snr_of_mcs("mcs") + F.lit(RADIO["noise"]) - F.col("gain"))
    full = rf.mcs_of_snr(F.lit(RADIO["max_power"]) + F.col("gain") - F.lit(RADIO["noise"]))
    rows = gained.withColumns({"need": need, "full": full}).filter((F.col("mcs") <= F.col("full")) & (F.col("need") <= F.lit(RADIO["max_power"]) - rf.backoff_of_mcs("mcs")))
    return rows.select("link_row", "mcs", r("need").alias("tx_power"))


def intf_rsl_map(spark: SparkSession, d: str) -> DataFrame:
    """Summed interference on each link, in dBm."""
    return interference.interference(_radio(spark, d)).select("link_row", r(rf.to_log("mw")).alias("dbm"))


def intf_sinr(spark: SparkSession, d: str) -> DataFrame:
    return interference.sinr(_radio(spark, d), RADIO["noise"]).select("link_row", r("sinr").alias("sinr"))


def intf_tpc_converged(spark: SparkSession, d: str) -> DataFrame:
    return interference.power_control(_radio(spark, d), RADIO["noise"], RADIO["max_power"], RADIO["min_power"])


def _bins(spark: SparkSession, d: str) -> DataFrame:
    return placement.bearing_bins(_with_sectors(wireless(links(spark, d))).withColumn("azimuth", F.round("azimuth", 6)))


def plan_sector_equidistant(spark: SparkSession, d: str) -> DataFrame:
    return placement.equidistant(_bins(spark, d), 4, 70.0)


def plan_sector_dp(spark: SparkSession, d: str) -> DataFrame:
    return placement.place_sectors(_bins(spark, d), 4, 70.0, 15).select("site_id", "cost", "azimuths")


def _rows(rows: DataFrame) -> DataFrame:
    return rows.select("plan_id", "row_id", "variable", r("coefficient", 6).alias("coefficient"), "sense", "bound")


def plan_flow_rows(spark: SparkSession, d: str) -> DataFrame:
    return _rows(planning.flow_balance_rows(_edges(spark, d)))


def plan_polarity_rows(spark: SparkSession, d: str) -> DataFrame:
    return _rows(planning.polarity_rows(wireless(links(spark, d))))


def plan_sector_time_rows(spark: SparkSession, d: str) -> DataFrame:
    return _rows(planning.sector_time_rows(_with_sectors(wireless(links(spark, d)))))


def plan_capacity_rows(spark: SparkSession, d: str) -> DataFrame:
    edges = wireless(links(spark, d)).select("plan_id", F.col("tx_id").alias("src"), F.col("rx_id").alias("dst"), F.lit("WIRELESS").alias("kind"), F.coalesce("capacity", F.lit(0.0)).alias("capacity"))
    return _rows(planning.capacity_rows(edges))


def plan_colocated_rows(spark: SparkSession, d: str) -> DataFrame:
    return _rows(planning.colocated_rows(sites(spark, d)))


def _largest_equal_flow(pdf: pd.DataFrame) -> pd.DataFrame:
    flow, demands = planning.max_min_flow(pdf.assign(capacity=[None if k != "WIRELESS" else (0.0 if c == float("inf") else 15.0 / c) for k, c in zip(pdf["kind"], pdf["cost"], strict=True)]).astype({"capacity": float}))
    return pd.DataFrame({"flow": [round(flow, 3)], "demands": [demands]})


def plan_max_min_flow(spark: SparkSession, d: str) -> DataFrame:
    """The largest flow that all connected demands of a plan can have at once."""
    return graph.per_plan(_edges(spark, d), _largest_equal_flow, "flow double, demands bigint")


def stream_down_time(spark: SparkSession, d: str) -> DataFrame:
    """Down time per component over the finished event table; the streaming operator gives the same as events come in."""
    return failures.down_time_batch(table(spark, d, "events"))


def stream_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and kind; the same plan runs over a stream with a watermark."""
    return failures.windowed_counts(table(spark, d, "events"))


QUERIES = {
    f.__name__: f
    for f in (
        intf_path_levels, intf_net_gain_map, rf_tx_power_descent, intf_rsl_map, intf_sinr, intf_tpc_converged, plan_sector_equidistant, plan_sector_dp, plan_flow_rows, plan_polarity_rows, plan_sector_time_rows, plan_capacity_rows, plan_colocated_rows,
        plan_max_min_flow, stream_down_time, stream_windowed_counts,
    )
}

_TURN = lambda dev: f"(-least(12 * pow({dev} / 65e0, 2), 30e0))"
_TURN_AWAY = _TURN(f"abs({delta_sql('s.azimuth', 'p.azimuth')})")
_INTF = _SECTORED + f""", rd AS (SELECT link_row, tx_id, rx_id, tx_sector, rx_sector, round(azimuth, 6) AS azimuth, round({_gain_sql('length_m')}, 9) AS gain FROM sc WHERE is_wireless AND tx_type <> 'CN'),
pt AS (SELECT p.link_row AS path_row, p.tx_id, p.rx_sector, p.azimuth AS paz, avg(pow(10, ({RADIO['max_power']}e0 + p.gain + {_TURN(f"abs({delta_sql('s.azimuth', 'p.azimuth')})")}) / 10)) AS level
  FROM rd p JOIN rd s ON p.tx_sector = s.tx_sector AND s.rx_id <> p.rx_id GROUP BY ALL),
vi AS (SELECT v.link_row, sum(level * pow(10, {_TURN(f"abs({delta_sql('paz', 'v.azimuth')})")} / 10)) AS mw FROM pt JOIN rd v ON pt.rx_sector = v.rx_sector AND pt.tx_id <> v.tx_id GROUP BY 1)
"""
_SUM = " SELECT plan_id, row_id, variable, round(coefficient, 6) + 0 AS coefficient, sense, bound FROM m"
_NET = _SECTORED.replace("WITH ", "WITH ", 1) + """, re AS (SELECT plan_id, tx_id AS src, rx_id AS dst FROM ln WHERE status <> 'UNAVAILABLE' AND tx_status <> 'UNAVAILABLE' AND rx_status <> 'UNAVAILABLE' AND (tx_type <> 'CN' OR NOT is_wireless)
  UNION ALL SELECT plan_id, 'SUPERSOURCE', site_id FROM st WHERE site_type = 'POP' AND status <> 'UNAVAILABLE' UNION ALL SELECT plan_id, site_id, 'demand:' || site_id FROM st WHERE site_type = 'CN' AND status <> 'UNAVAILABLE')
"""
_WL = "ln WHERE is_wireless AND tx_type <> 'CN'"
ORACLES = {
    "intf_path_levels": _INTF + "SELECT path_row, CASE WHEN level > 0 THEN round(10 * log10(level), 3) + 0 END AS dbm FROM pt",
    "intf_net_gain_map": _INTF + f"SELECT p.link_row AS path_row, s.link_row AS sent_row, round(p.gain + {_TURN_AWAY}, 3) + 0 AS net_gain_db FROM rd p JOIN rd s ON p.tx_sector = s.tx_sector AND s.rx_id <> p.rx_id",
    "rf_tx_power_descent": _INTF + f", k AS (SELECT link_row, gain, CAST(unnest(range(1, 13)) AS INTEGER) AS mcs FROM rd), n AS (SELECT *, greatest({RADIO['min_power']}e0, ({_SNR('mcs')}) + {RADIO['noise']}e0 - gain) AS need FROM k) SELECT link_row, mcs, round(need, 3) + 0 AS tx_power FROM n WHERE mcs <= {_MCS(f"({RADIO['max_power']}e0 + gain - {RADIO['noise']}e0)")} AND need <= {RADIO['max_power']}e0 - ({_OFF('mcs')})",
    "intf_rsl_map": _INTF + "SELECT link_row, CASE WHEN mw > 0 THEN round(10 * log10(mw), 3) + 0 END AS dbm FROM vi",
    "intf_sinr": _INTF + f"SELECT link_row, round({RADIO['max_power']}e0 + gain - 10 * log10(coalesce(mw, 0) + {10 ** (RADIO['noise'] / 10)!r}), 3) + 0 AS sinr FROM rd LEFT JOIN vi USING (link_row)",
    "plan_sector_equidistant": _SECTORED + """, bn AS (SELECT tx_id AS site_id, CAST(floor(round(azimuth, 6) / 3) * 3 AS INTEGER) % 360 AS bin, count(*) AS n FROM sc WHERE tx_type <> 'CN' GROUP BY 1, 2),
tn AS (SELECT *, unnest(range(0, 88, 3)) AS turn FROM bn), o AS (SELECT site_id, turn, n, least((bin - turn + 360) % 90, 90 - (bin - turn + 360) % 90) AS off FROM tn),
k AS (SELECT site_id, turn, sum((CASE WHEN off > 35 THEN 360e0 ELSE off END) ** 2 * n) AS cost FROM o GROUP BY 1, 2)
SELECT site_id, CAST(arg_min(turn, (cost, turn)) AS INTEGER) AS turn, min(cost) AS cost FROM k GROUP BY 1""",
    "plan_flow_rows": _NET + ", m AS (SELECT plan_id, 'balance:' || dst AS row_id, 'flow:' || src || '>' || dst AS variable, 1e0 AS coefficient, '=' AS sense, CASE WHEN starts_with(dst, 'demand:') THEN 1e0 ELSE 0e0 END AS bound FROM re UNION ALL SELECT plan_id, 'balance:' || src, 'flow:' || src || '>' || dst, -1e0, '=', 0e0 FROM re WHERE src <> 'SUPERSOURCE' UNION ALL SELECT plan_id, 'balance:' || dst, 'shortage:' || dst, 1e0, '=', 1e0 FROM re WHERE starts_with(dst, 'demand:'))" + _SUM,
    "plan_polarity_rows": _SECTORED + ", b AS (SELECT plan_id, tx_id, rx_id, tx_id || '>' || rx_id AS l, unnest([{'k': 'low', 's': -1e0, 'b': 0e0}, {'k': 'high', 's': 1e0, 'b': 2e0}]) AS x FROM " + _WL + " AND rx_type <> 'CN'), t AS (SELECT plan_id, l, x, unnest([{'v': 'time:' || l, 'c': 1e0}, {'v': 'odd:' || tx_id, 'c': x.s}, {'v': 'odd:' || rx_id, 'c': x.s}]) AS t FROM b), m AS (SELECT plan_id, 'polarity_' || x.k || ':' || l AS row_id, t.v AS variable, t.c AS coefficient, '<=' AS sense, x.b AS bound FROM t)" + _SUM,
    "plan_sector_time_rows": _SECTORED + ", m AS (SELECT plan_id, 'sector:' || unnest(['tx:' || tx_sector, 'rx:' || rx_sector]) AS row_id, 'time:' || tx_id || '>' || rx_id AS variable, 1e0 AS coefficient, '<=' AS sense, 1e0 AS bound FROM sc WHERE tx_type <> 'CN')" + _SUM,
    "plan_capacity_rows": _SECTORED + ", m AS (SELECT plan_id, 'capacity:' || tx_id || '>' || rx_id AS row_id, 'flow:' || tx_id || '>' || rx_id AS variable, 1e0 AS coefficient, '<=' AS sense, 0e0 AS bound FROM " + _WL + " UNION ALL SELECT plan_id, 'capacity:' || tx_id || '>' || rx_id, 'time:' || tx_id || '>' || rx_id, -coalesce(capacity, 0), '<=', 0e0 FROM " + _WL + ")" + _SUM,
    "plan_colocated_rows": _SECTORED + ", g AS (SELECT plan_id, site_id, min(site_id) OVER w AS first, count(*) OVER w AS n FROM st WINDOW w AS (PARTITION BY plan_id, lon, lat, alt)), m AS (SELECT plan_id, 'place:' || first AS row_id, 'site:' || site_id AS variable, 1e0 AS coefficient, '<=' AS sense, 1e0 AS bound FROM g WHERE n > 1)" + _SUM,
    "stream_down_time": """WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_type IN ('error', 'purchase')),
t AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM e WHERE before IS NULL OR before <> event_type)
SELECT user_id, count(*) AS outages, round(sum(epoch_us(next) - epoch_us(ts)) / 1e6, 3) AS down_s FROM t WHERE event_type = 'error' AND next_type = 'purchase' GROUP BY 1""",
    "stream_windowed_counts": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events FROM events GROUP BY 1, 2",
}
