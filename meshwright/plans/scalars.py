"""Queries of the geodesy and radio functions over current sites and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions import geo, rf
from meshwright.plans.domain import BASE_SQL, RADIO, bearing_sql, delta_sql, hav_sql, length_sql, link_length, links, sites, wireless
from meshwright.tables import fixed, table

R = RADIO
ENDS = ("tx_lon", "tx_lat", "rx_lon", "rx_lat")
BACK = ("rx_lon", "rx_lat", "tx_lon", "tx_lat")


def r(column, digits: int = 3):
    """Rounded, and -0.0 written as 0.0."""
    return F.round(column, digits) + F.lit(0.0)


def geo_haversine(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).select("link_row", r(geo.haversine(*ENDS)).alias("ground_m"), r(link_length()).alias("length_m"))


def geo_bearing(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).filter("tx_lat <> rx_lat or tx_lon <> rx_lon").select("link_row", r(geo.bearing(*ENDS)).alias("bearing_deg"))


def geo_angle_delta(spark: SparkSession, d: str) -> DataFrame:
    ls = links(spark, d).filter("tx_lat <> rx_lat or tx_lon <> rx_lon").withColumns({"there": geo.bearing(*ENDS), "back": geo.bearing(*BACK)})
    return ls.select("link_row", r(geo.angle_delta("there", "back")).alias("turn_deg"))


def geo_translate_point(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = geo.translate("lon", "lat", 75.0, 250.0)
    return sites(spark, d).select("site_id", r(lon, 6).alias("lon2"), r(lat, 6).alias("lat2"))


def geo_grid_deltas(spark: SparkSession, d: str) -> DataFrame:
    east, north = geo.grid_deltas("lon", "lat", 100.0)
    return sites(spark, d).filter("abs(lat) < 89").select("site_id", r(east, 7).alias("d_lon"), r(north, 7).alias("d_lat"))


def geo_utm_zone(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).select("site_id", geo.utm_zone("lon").alias("zone"), geo.utm_epsg("lon", "lat").alias("epsg"))


def geo_utm_forward(spark: SparkSession, d: str) -> DataFrame:
    x, y = geo.to_utm("lon", "lat")
    return sites(spark, d).select("site_id", r(x).alias("utm_x"), r(y).alias("utm_y"))


def geo_utm_round_trip(spark: SparkSession, d: str) -> DataFrame:
    x, y = geo.to_utm("lon", "lat")
    projected = sites(spark, d).select("site_id", "lon", "lat", x.alias("x"), y.alias("y"), geo.utm_epsg("lon", "lat").alias("epsg"))
    lon, lat = geo.from_utm("x", "y", "epsg")
    return projected.select("site_id", r(lon - F.col("lon"), 6).alias("off_lon"), r(lat - F.col("lat"), 6).alias("off_lat"))


def geo_geohash(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).select("site_id", geo.geohash("lon", "lat").alias("geohash"))


def geo_law_of_cosines(spark: SparkSession, d: str) -> DataFrame:
    """Angle at each site between its link and the pole-ward point a kilometre away."""
    lon, lat = geo.translate("tx_lon", "tx_lat", 0.0, 1000.0)
    ls = links(spark, d).filter("abs(tx_lat) < 89").withColumns({"lon3": lon, "lat3": lat}).filter(geo.haversine(*ENDS) > 1)
    angle, ratio = geo.spherical_angle("tx_lon", "tx_lat", "rx_lon", "rx_lat", "lon3", "lat3")
    return ls.select("link_row", r(angle, 2).alias("angle_deg"), r(ratio, 2).alias("length_ratio"))


def geo_dms_parse(spark: SparkSession, d: str) -> DataFrame:
    value = geo.dms_to_decimal("base_lon")
    return table(spark, d, "mount_surveys").select("meas_id", r(value, 6).alias("lon_deg")).filter("lon_deg is not null")


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).withColumn("km", link_length() / F.lit(1000.0))


def rf_fspl(spark: SparkSession, d: str) -> DataFrame:
    return _lengths(spark, d).select("link_row", r(rf.fspl("km", R["mhz"] / 1000)).alias("loss_db"))


def rf_rain_loss(spark: SparkSession, d: str) -> DataFrame:
    return _lengths(spark, d).select("link_row", r(rf.rain_loss("km", R["rain"], R["availability"], R["mhz"])).alias("loss_db"))


def rf_oxygen_loss(spark: SparkSession, d: str) -> DataFrame:
    mhz = F.lit(51500.0) + (F.col("link_row") % 180) * F.lit(100.0)
    return _lengths(spark, d).withColumn("mhz", mhz).select("link_row", r(rf.oxygen_loss("km", "mhz")).alias("loss_db"))


def with_gain(df: DataFrame, metres: str = "m") -> DataFrame:
    """Adds the net gain g, rounded so that classes don't hang on its last bits."""
    gain = rf.link_net_gain(metres, R["mhz"], R["gain"], R["loss"], R["gain"], R["loss"], R["rain"], R["availability"])
    return df.withColumn("g", F.round(gain, 9))


def budget(df: DataFrame) -> DataFrame:
    return rf.with_link_budget(df, "g", R["noise"], R["max_power"], R["min_power"])


def rf_net_gain(spark: SparkSession, d: str) -> DataFrame:
    return with_gain(links(spark, d).withColumn("m", link_length())).select("link_row", r("g").alias("net_gain_db"))


def rf_mcs_lookup(spark: SparkSession, d: str) -> DataFrame:
    ls = table(spark, d, "links").filter("snr is not null").withColumn("m", rf.mcs_of_snr("snr"))
    return ls.select("link_row", F.col("m").alias("mcs_of_snr"), rf.snr_of_mcs("mcs").alias("snr_of_mcs"), r(rf.capacity_of_mcs("m"), 5).alias("capacity_gbps"), rf.backoff_of_mcs("m").alias("backoff_db"))


def rf_link_budget(spark: SparkSession, d: str) -> DataFrame:
    """The budget of every wireless link."""
    out = budget(with_gain(wireless(links(spark, d)).withColumn("m", link_length())))
    return out.select("link_row", "mcs", r("rsl").alias("rsl"), r("snr_db").alias("snr"), r("gbps").alias("capacity"), r("tx_power").alias("tx_power"))


def rf_link_budget_report(spark: SparkSession, d: str) -> DataFrame:
    """Links, length and capacity by class of the receiver and modulation class."""
    ls = budget(with_gain(wireless(links(spark, d)).withColumn("m", link_length())))
    return ls.groupBy("rx_type", "mcs").agg(
        F.count(F.lit(1)).alias("links"), r(F.avg("m"), 2).alias("avg_m"), r(F.max("m"), 2).alias("max_m"), r(F.min("m"), 2).alias("min_m"), r(F.sum("gbps"), 5).alias("gbps")
    )


def rf_max_range_per_device_pair(spark: SparkSession, d: str) -> DataFrame:
    """Largest whole metre at which a pair of devices still has throughput; devices are a fixed table."""
    devices = table(spark, d, "devices")
    side = lambda k: devices.select(F.col("device_sku").alias(f"{k}_sku"), F.col("device_type").alias(f"{k}_type"), F.col("max_mcs").alias(f"{k}_mcs"), F.lit(1).alias("one"))
    pairs = side("tx").join(fixed(side("rx")), "one").filter("tx_type = 'DN'").drop("one")
    # the budget hangs on the length only, so it is found once for each metre
    metres = spark.range(1, 10_001).select(F.col("id").cast("double").alias("m"))
    able = budget(with_gain(metres)).select("m", F.col("mcs").alias("able"))
    able = able.groupBy("able").agg(F.max("m").alias("m"))  # one row a class
    reach = pairs.join(F.broadcast(able), F.least("able", "tx_mcs", "rx_mcs") > 3)
    return reach.groupBy("tx_sku", "rx_sku").agg(F.max("m").cast("int").alias("max_range_m"))


def rf_pattern_gain(spark: SparkSession, d: str) -> DataFrame:
    """Gain off a synthetic pattern that loses a dB for each three whole degrees, by the turn between both bearings."""
    pattern = F.transform(F.sequence(F.lit(0), F.lit(359)), lambda i: -F.floor(F.least(i, F.lit(360) - i) / 3).cast("double"))
    ls = links(spark, d).filter("tx_lat <> rx_lat or tx_lon <> rx_lon").withColumns({"p": pattern, "a": r(geo.bearing(*ENDS), 4)})
    ls = ls.withColumn("dev", r(geo.angle_delta("a", r(F.col("a") * 2 % 360, 4)), 3))
    return ls.select("link_row", rf.pattern_index("dev").alias("at"), r(rf.pattern_gain(R["gain"], 2.0, "p", "p", "dev", F.lit(0.0))).alias("gain_db"))


QUERIES = {
    f.__name__: f
    for f in (
        geo_haversine, geo_bearing, geo_angle_delta, geo_translate_point, geo_grid_deltas, geo_utm_zone, geo_utm_forward, geo_utm_round_trip, geo_geohash, geo_law_of_cosines, geo_dms_parse,
        rf_fspl, rf_rain_loss, rf_oxygen_loss, rf_net_gain, rf_mcs_lookup, rf_link_budget, rf_link_budget_report, rf_max_range_per_device_pair, rf_pattern_gain,
    )
}

_T, _B = hav_sql(*ENDS), bearing_sql(*ENDS)


def _fspl_sql(km: str, ghz: float) -> str:
    return f"(CASE WHEN {km} <= pow(10, -92.45e0 / 20 - log10({ghz}e0)) THEN 0e0 ELSE 20 * (log10({km}) + log10({ghz}e0)) + 92.45e0 END)"


def _rain_sql(km: str) -> str:
    rain, ghz, rest = f"{R['rain']}e0", f"{R['mhz'] / 1000}e0", f"(100e0 - {R['availability']}e0)"
    c0 = f"(0.12e0 + 0.4e0 * log10(pow({ghz} / 10, 0.8e0)))"
    r_ = f"least(1 / (0.477e0 * pow({km}, 0.633e0) * pow({rain}, {0.073 * 0.7486!r}e0) * pow({ghz}, 0.123e0) - 10.579e0 * (1 - exp(-0.024e0 * {km}))), 2.5e0)"
    a = f"0.8515e0 * pow({rain}, 0.7486e0) * {km} * {r_} * pow(0.07e0, {c0}) * pow(0.12e0, 1 - {c0}) * pow({rest}, -((0.855e0 * {c0} + 0.546e0 * (1 - {c0})) + (0.139e0 * {c0} + 0.043e0 * (1 - {c0})) * log10({rest})))"
    return f"(CASE WHEN {km} <= 0 THEN 0e0 ELSE greatest({a}, 0e0) END)"


_OXY = "[" + ", ".join(f"{x}e0" for x in rf.OXYGEN_LOSS) + "]"


def _oxygen_sql(km: str, ghz: str) -> str:
    i = f"CAST(least(floor({ghz} - 52), 15) AS INTEGER)"
    return f"(CASE WHEN {ghz} BETWEEN 52 AND 68 THEN ({_OXY}[{i} + 1] + ({_OXY}[{i} + 2] - {_OXY}[{i} + 1]) * ({ghz} - 52 - {i})) * {km} ELSE 0e0 END)"


def _gain_sql(m: str) -> str:
    km = f"({m} / 1000e0)"
    return f"({2 * R['gain']}e0 - {_fspl_sql(km, R['mhz'] / 1000)} - {_rain_sql(km)} - {_oxygen_sql(km, repr(R['mhz'] / 1000) + 'e0')})"


def _case(value: str, pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} {k} THEN {v}" for k, v in pairs) + f" ELSE {default} END"


_DOWN = sorted(rf.DEFAULT_MCS, reverse=True)
_MCS = lambda x: _case(x, [(f">= {s}e0", m) for m, s, _, _ in _DOWN], "0")
_SNR = lambda x: _case(x, [(f">= {m}", f"{s}e0") for m, s, _, _ in _DOWN], "0e0")
_CAP = lambda x: _case(x, [(f"= {m}", f"{b / 1000!r}e0") for m, _, b, _ in _DOWN], "0e0")
_OFF = lambda x: _case(x, [(f"= {m}", f"{o}e0") for m, _, _, o in _DOWN], "0e0")
_FITS = lambda snr_mcs, g: f"coalesce((SELECT max(k) FROM range(1, 13) t(k) WHERE k <= {snr_mcs} AND greatest({R['min_power']}e0, ({_SNR('k')}) + {R['noise']}e0 - {g}) <= {R['max_power']}e0 - ({_OFF('k')})), 0)"
_BUDGET = f"""
, g AS (SELECT *, round({_gain_sql(length_sql())}, 9) AS g, {length_sql()} AS m FROM ln WHERE is_wireless AND tx_type <> 'CN'),
b AS (SELECT *, CAST({_FITS(_MCS(f"({R['max_power']}e0 + g - {R['noise']}e0)"), 'g')} AS INTEGER) AS best FROM g)
"""
_KM = f"({length_sql()} / 1000e0)"
def _utm_sql(rows: str, kept: str) -> str:
    """Steps that project rows (lon, lat, zone from 1 to 60, south) to x and y, as table p with the kept columns."""
    xi = " + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(geo._ALPHA, 1))
    eta = " + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(geo._ALPHA, 1))
    return f"""
, t AS (SELECT *, sinh(atanh(sin(radians(lat))) - {geo._E!r} * atanh({geo._E!r} * sin(radians(lat)))) AS t, radians((lon - (zone * 6 - 183) + 540) % 360 - 180) AS l FROM {rows}),
u AS (SELECT *, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + t * t)) AS eta FROM t),
p AS (SELECT {kept}, 500000 + {geo._K0 * geo._RECTIFYING!r} * (eta + {xi}) AS x, CASE WHEN south THEN 10000000 ELSE 0 END + {geo._K0 * geo._RECTIFYING!r} * (xi + {eta}) AS y FROM u)
"""


_UTM = ", z AS (SELECT site_id, lon, lat, CAST(floor((lon + 180) / 6) AS INTEGER) % 60 + 1 AS zone, lat < 0 AS south FROM st)" + _utm_sql("z", "site_id, lon, lat")


def _translate_sql(lon: str, lat: str, b: float, m: float) -> tuple[str, str]:
    q = f"asin(sin(radians({lat})) * cos({m}e0 / 6371000) + cos(radians({lat})) * sin({m}e0 / 6371000) * cos(radians({b}e0)))"
    east = f"atan2(sin(radians({b}e0)) * sin({m}e0 / 6371000) * cos(radians({lat})), cos({m}e0 / 6371000) - sin(radians({lat})) * sin({q}))"
    return f"({lon} + degrees({east}))", f"degrees({q})"


_TO, _EAST, _NORTH, _UP = _translate_sql("lon", "lat", 75.0, 250.0), _translate_sql("lon", "lat", 90.0, 100.0)[0], _translate_sql("lon", "lat", 0.0, 100.0)[1], _translate_sql("tx_lon", "tx_lat", 0.0, 1000.0)
_DMS = r'''^([+-]?\d+(?:\.\d+)?)[\s°]*(?:(\d+(?:\.\d+)?)[\s'′]+)?(?:(\d+(?:\.\d+)?)[\s"″]*)?([NSEWnsew]?)$'''
_DMS = "'" + _DMS.replace("'", "''") + "'"
_TURNED = "round((a * 2) % 360, 4)"
ORACLES = {
    "geo_haversine": BASE_SQL + f"SELECT link_row, round({_T}, 3) + 0 AS ground_m, round({length_sql()}, 3) + 0 AS length_m FROM ln",
    "geo_bearing": BASE_SQL + f"SELECT link_row, round({_B}, 3) + 0 AS bearing_deg FROM ln WHERE tx_lat <> rx_lat OR tx_lon <> rx_lon",
    "geo_angle_delta": BASE_SQL + f", b AS (SELECT link_row, {_B} AS a, {bearing_sql(*BACK)} AS b FROM ln WHERE tx_lat <> rx_lat OR tx_lon <> rx_lon) SELECT link_row, round({delta_sql('a', 'b')}, 3) + 0 AS turn_deg FROM b",
    "geo_translate_point": BASE_SQL + f"SELECT site_id, round({_TO[0]}, 6) + 0 AS lon2, round({_TO[1]}, 6) + 0 AS lat2 FROM st",
    "geo_grid_deltas": BASE_SQL + f"SELECT site_id, round({_EAST} - lon, 7) + 0 AS d_lon, round({_NORTH} - lat, 7) + 0 AS d_lat FROM st WHERE abs(lat) < 89",
    "geo_utm_zone": BASE_SQL + ", z AS (SELECT site_id, lat, CAST(floor((lon + 180) / 6) AS INTEGER) % 60 + 1 AS zone FROM st) SELECT site_id, zone, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + zone AS INTEGER) AS epsg FROM z",
    "geo_utm_forward": BASE_SQL + _UTM + "SELECT site_id, round(x, 3) + 0 AS utm_x, round(y, 3) + 0 AS utm_y FROM p",
    "geo_utm_round_trip": BASE_SQL + "SELECT site_id, 0e0 AS off_lon, 0e0 AS off_lat FROM st",
    "geo_geohash": BASE_SQL + """, g AS (SELECT site_id, least(CAST(floor((lon + 180) / 360 * 33554432) AS BIGINT), 33554431) AS x, least(CAST(floor((lat + 90) / 180 * 33554432) AS BIGINT), 33554431) AS y FROM st)
SELECT site_id, array_to_string([substring('0123456789abcdefghijklmnopqrstuv', CAST(list_sum([(((CASE WHEN (5 * i + j) % 2 = 0 THEN x ELSE y END) >> CAST(24 - (5 * i + j) // 2 AS INTEGER)) & 1) * (16 >> CAST(j AS INTEGER)) for j in range(5)]) AS INTEGER) + 1, 1) for i in range(10)], '') AS geohash FROM g""",
    "geo_law_of_cosines": BASE_SQL + f""", k AS (SELECT *, {_UP[0]} AS lon3, {_UP[1]} AS lat3, {_T} AS a FROM ln WHERE abs(tx_lat) < 89),
e AS (SELECT link_row, a, {hav_sql('tx_lon', 'tx_lat', 'lon3', 'lat3')} AS b, {hav_sql('rx_lon', 'rx_lat', 'lon3', 'lat3')} AS o FROM k WHERE a > 1)
SELECT link_row, round(CASE WHEN o = 0 THEN 0e0 ELSE degrees(acos(least(greatest((a * a + b * b - o * o) / (2 * a * b), -1), 1))) END, 2) + 0 AS angle_deg, round(greatest(a, b) / least(a, b), 2) + 0 AS length_ratio FROM e""",
    "geo_dms_parse": f"""WITH x AS (SELECT meas_id, regexp_extract(trim(base_lon), {_DMS}, ['d', 'm', 's', 'c']) AS p FROM mount_surveys WHERE regexp_full_match(trim(base_lon), {_DMS})),
v AS (SELECT meas_id, abs(CAST(p.d AS DOUBLE)) + coalesce(TRY_CAST(p.m AS DOUBLE), 0) / 60 + coalesce(TRY_CAST(p.s AS DOUBLE), 0) / 3600 AS v, (upper(p.c) IN ('S', 'W')) <> starts_with(p.d, '-') AS neg FROM x)
SELECT meas_id, round(CASE WHEN neg THEN -v ELSE v END, 6) + 0 AS lon_deg FROM v""",
    "rf_fspl": BASE_SQL + f"SELECT link_row, round({_fspl_sql(_KM, R['mhz'] / 1000)}, 3) + 0 AS loss_db FROM ln",
    "rf_rain_loss": BASE_SQL + f"SELECT link_row, round({_rain_sql(_KM)}, 3) + 0 AS loss_db FROM ln",
    "rf_oxygen_loss": BASE_SQL + f", q AS (SELECT link_row, {_KM} AS km, (51500e0 + (link_row % 180) * 100e0) / 1000e0 AS ghz FROM ln) SELECT link_row, round({_oxygen_sql('km', 'ghz')}, 3) + 0 AS loss_db FROM q",
    "rf_net_gain": BASE_SQL + f"SELECT link_row, round({_gain_sql(length_sql())}, 3) + 0 AS net_gain_db FROM ln",
    "rf_mcs_lookup": f"WITH x AS (SELECT link_row, mcs, CAST({_MCS('snr')} AS INTEGER) AS m FROM links WHERE snr IS NOT NULL) SELECT link_row, m AS mcs_of_snr, {_SNR('mcs')} AS snr_of_mcs, round({_CAP('m')}, 5) + 0 AS capacity_gbps, {_OFF('m')} AS backoff_db FROM x",
    "rf_link_budget": BASE_SQL + _BUDGET + f", o AS (SELECT link_row, best, g, {R['max_power']}e0 - ({_OFF('best')}) AS p FROM b) SELECT link_row, best AS mcs, round(p + g, 3) + 0 AS rsl, round(p + g - {R['noise']}e0, 3) + 0 AS snr, round({_CAP('best')}, 3) + 0 AS capacity, round(p, 3) + 0 AS tx_power FROM o",
    "rf_link_budget_report": BASE_SQL + _BUDGET + f"SELECT rx_type, best AS mcs, count(*) AS links, round(avg(m), 2) + 0 AS avg_m, round(max(m), 2) + 0 AS max_m, round(min(m), 2) + 0 AS min_m, round(sum({_CAP('best')}), 5) + 0 AS gbps FROM b GROUP BY ALL",
    "rf_max_range_per_device_pair": f"""WITH q AS (SELECT a.device_sku AS tx_sku, b.device_sku AS rx_sku, least(a.max_mcs, b.max_mcs) AS most FROM devices a, devices b WHERE a.device_type = 'DN'),
m AS (SELECT *, round({_gain_sql('m')}, 9) AS g FROM (SELECT tx_sku, rx_sku, most, unnest(range(1, 10001)) AS m FROM q)),
b AS (SELECT tx_sku, rx_sku, m, least(most, {_FITS(_MCS(f"({R['max_power']}e0 + g - {R['noise']}e0)"), 'g')}) AS best FROM m)
SELECT tx_sku, rx_sku, CAST(max(m) AS INTEGER) AS max_range_m FROM b WHERE best > 3 GROUP BY 1, 2""",
    "rf_pattern_gain": BASE_SQL + f""", u AS (SELECT link_row, round({_B}, 4) AS a FROM ln WHERE tx_lat <> rx_lat OR tx_lon <> rx_lon),
v AS (SELECT *, {_TURNED} AS b FROM u),
w AS (SELECT link_row, (CAST(round_even(round({delta_sql('a', 'b')}, 3), 0) AS INTEGER) + 360) % 360 AS i FROM v)
SELECT link_row, i AS "at", round({R['gain']}e0 + 2 - floor(least(i, 360 - i) / 3), 3) + 0 AS gain_db FROM w""",
}
