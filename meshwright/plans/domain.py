"""The planning model over the input tables: current sites, links between them, and devices.

A site is its latest recording with a location; a link is the first row of its directed pair. Both are reductions with
partial aggregation, so a key with very many recordings is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions import geo
from meshwright.tables import name_key, table

ACTIVE = ("PROPOSED", "EXISTING")
#: Radio constants of all devices in these queries. Fixed values.
RADIO = {"mhz": 60480.0, "gain": 30.0, "loss": 0.0, "noise": -74.0, "max_power": 16.0, "min_power": 5.0, "rain": 30.0, "availability": 99.9}


def sites(spark: SparkSession, d: str) -> DataFrame:
    """site_id, plan_id, name, site_type, lat, lon, alt, sku, status, location_type, building_id, subscribers."""
    rows = table(spark, d, "sites").withColumn("name", name_key(F.col("site_name"))).filter("plan_id is not null and name is not null")
    kept = ["site_type", "latitude", "longitude", "altitude", "device_sku", "site_status", "location_type", "building_id", "subscribers"]
    latest = rows.groupBy("plan_id", "name").agg(F.max_by(F.struct(*kept), F.struct("recorded_at", "site_row")).alias("s"))
    alt = F.when(F.col("s.altitude") != -32768, F.col("s.altitude"))
    out = latest.select(
        F.concat_ws("/", "plan_id", "name").alias("site_id"), "plan_id", "name", F.upper(F.split(F.trim("s.site_type"), " ")[0]).alias("site_type"),
        F.col("s.latitude").alias("lat"), F.col("s.longitude").alias("lon"), alt.alias("alt"), F.upper(F.trim("s.device_sku")).alias("sku"),
        F.col("s.site_status").alias("status"), "s.location_type", "s.building_id", "s.subscribers",
    )
    return out.filter("lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0)")


SITES_SQL = """
latest AS (SELECT *, lower(trim(site_name)) AS name, row_number() OVER (PARTITION BY plan_id, lower(trim(site_name)) ORDER BY recorded_at DESC NULLS LAST, site_row DESC) AS rn
  FROM sites WHERE plan_id IS NOT NULL AND trim(site_name) <> ''),
st AS (SELECT plan_id || '/' || name AS site_id, plan_id, name, upper(split_part(trim(site_type), ' ', 1)) AS site_type, latitude AS lat, longitude AS lon,
    CASE WHEN altitude <> -32768 THEN altitude END AS alt, upper(trim(device_sku)) AS sku, site_status AS status, location_type, building_id, subscribers
  FROM latest WHERE rn = 1 AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0))"""


def raw_links(spark: SparkSession, d: str) -> DataFrame:
    """One row per directed pair of names: plan_id, tx, rx, status, is_wireless, confidence, mcs, snr, capacity."""
    rows = table(spark, d, "links").select(
        "link_row", "plan_id", name_key(F.col("tx_site")).alias("tx"), name_key(F.col("rx_site")).alias("rx"), "link_status", "is_wireless", "confidence", "mcs", "snr", "capacity_gbps"
    )
    rows = rows.filter("plan_id is not null and tx is not null and rx is not null and tx <> rx")
    kept = F.struct("link_row", "link_status", "is_wireless", "confidence", "mcs", "snr", "capacity_gbps")
    first = rows.groupBy("plan_id", "tx", "rx").agg(F.min_by(kept, "link_row").alias("x"))
    return first.select("plan_id", "tx", "rx", "x.link_row", F.col("x.link_status").alias("status"), "x.is_wireless", "x.confidence", F.coalesce("x.mcs", F.lit(0)).alias("mcs"), "x.snr", F.col("x.capacity_gbps").alias("capacity"))


LINKS_SQL = """
first_rows AS (SELECT plan_id, lower(trim(tx_site)) AS tx, lower(trim(rx_site)) AS rx, min(link_row) AS link_row FROM links
  WHERE plan_id IS NOT NULL AND trim(tx_site) <> '' AND trim(rx_site) <> '' AND lower(trim(tx_site)) <> lower(trim(rx_site)) GROUP BY 1, 2, 3),
rl AS (SELECT f.plan_id, f.tx, f.rx, f.link_row, l.link_status AS status, l.is_wireless, l.confidence, coalesce(l.mcs, 0) AS mcs, l.snr, l.capacity_gbps AS capacity
  FROM first_rows f JOIN links l USING (link_row))"""


def available_links(spark: SparkSession, d: str) -> DataFrame:
    """Of raw_links plan_id, tx, rx, is_wireless and status, without those that are unavailable.

    Row and state are one number, of which the least is taken in a hash table; whole rows would have to be sorted for it.
    """
    state = F.when(F.col("link_status") != "UNAVAILABLE", F.when(F.col("is_wireless"), 1).when(~F.col("is_wireless"), 2).otherwise(3)).otherwise(0)
    row = (F.col("link_row").cast("decimal(19,0)") * F.lit(4).cast("decimal(1,0)") + state.cast("decimal(1,0)")).cast("decimal(22,0)")
    rows = table(spark, d, "links").select("plan_id", name_key(F.col("tx_site")).alias("tx"), name_key(F.col("rx_site")).alias("rx"), row.alias("row"))
    rows = rows.filter("plan_id is not null and tx is not null and rx is not null and tx <> rx")
    first = rows.groupBy("plan_id", "tx", "rx").agg(F.min("row").alias("row")).withColumn("state", F.expr("cast(pmod(row, 4) as int)")).filter("state > 0")
    return first.select("plan_id", "tx", "rx", F.lit("AVAILABLE").alias("status"), F.when(F.col("state") < 3, F.col("state") == 1).alias("is_wireless"))


def links(spark: SparkSession, d: str, raw: DataFrame | None = None) -> DataFrame:
    """Links (raw, or all) whose ends are current sites, with both ends' type, status and place.

    link_row, tx_id, rx_id, status, is_wireless, confidence, mcs, snr, capacity, {tx,rx}_{type,status,lat,lon,alt,sku}.
    """
    s, raw = sites(spark, d), raw_links(spark, d) if raw is None else raw
    end = lambda k: s.select("plan_id", F.col("name").alias(k), F.col("site_id").alias(f"{k}_id"), *(F.col(a).alias(f"{k}_{b}") for a, b in (("site_type", "type"), ("status", "status"), ("lat", "lat"), ("lon", "lon"), ("alt", "alt"), ("sku", "sku"))))
    return raw.join(end("tx"), ["plan_id", "tx"]).join(end("rx"), ["plan_id", "rx"]).drop("tx", "rx")


BASE_SQL = "WITH " + SITES_SQL.strip() + "," + LINKS_SQL + """,
ln AS (SELECT rl.plan_id, rl.link_row, a.site_id AS tx_id, b.site_id AS rx_id, rl.status, is_wireless, confidence, mcs, snr, capacity,
    a.site_type AS tx_type, a.status AS tx_status, a.lat AS tx_lat, a.lon AS tx_lon, a.alt AS tx_alt, a.sku AS tx_sku,
    b.site_type AS rx_type, b.status AS rx_status, b.lat AS rx_lat, b.lon AS rx_lon, b.alt AS rx_alt, b.sku AS rx_sku
  FROM rl JOIN st a ON a.plan_id = rl.plan_id AND a.name = rl.tx JOIN st b ON b.plan_id = rl.plan_id AND b.name = rl.rx)
"""


def wireless(links_df: DataFrame) -> DataFrame:
    """Wireless links that a site can send: clients never do."""
    return links_df.filter("is_wireless and tx_type <> 'CN'")


def link_type() -> F.Column:
    return F.when(~F.col("is_wireless"), "ETHERNET").when(F.col("rx_type") == "CN", "WIRELESS_ACCESS").otherwise("WIRELESS_BACKHAUL")


LINK_TYPE_SQL = "CASE WHEN NOT is_wireless THEN 'ETHERNET' WHEN rx_type = 'CN' THEN 'WIRELESS_ACCESS' ELSE 'WIRELESS_BACKHAUL' END"


def link_length() -> F.Column:
    return geo.distance("tx_lon", "tx_lat", "tx_alt", "rx_lon", "rx_lat", "rx_alt")


def hav_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    h = f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(12742000e0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def length_sql(p: str = "tx", q: str = "rx") -> str:
    return f"sqrt(pow({hav_sql(f'{p}_lon', f'{p}_lat', f'{q}_lon', f'{q}_lat')}, 2) + pow(coalesce({q}_alt - {p}_alt, 0), 2))"


def bearing_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    d, p, q = f"radians({lon2} - {lon1})", f"radians({lat1})", f"radians({lat2})"
    a = f"degrees(atan2(sin({d}) * cos({q}), cos({p}) * sin({q}) - sin({p}) * cos({q}) * cos({d})))"
    return f"(CASE WHEN {a} < 0 THEN {a} + 360 ELSE {a} END)"


def delta_sql(a: str, b: str) -> str:
    return f"(CASE WHEN {a} - {b} > 180 THEN {a} - {b} - 360 WHEN {a} - {b} <= -180 THEN {a} - {b} + 360 ELSE {a} - {b} END)"
