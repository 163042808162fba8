"""Readers of delimited planning files: headers by alias, sites, links, modulation classes and antenna patterns.

Files are read by Spark's own sources as text columns; headers are resolved when the plan is built, values inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.functions.geo import dms_to_decimal
from meshwright.functions.rf import DEFAULT_MCS

#: Names in input files of the properties of sites and links. Fixed values.
SITE_ALIASES = {
    "name": ("name", "site_name", "site name", "pole_name"), "site_type": ("type", "site_type", "site type", "type_site"), "latitude": ("lat", "latitude", "base_lat"),
    "longitude": ("lon", "longitude", "base_lon"), "altitude": ("alt", "altitude"), "height": ("height", "install_height", "site_height", "height_m", "height (m)"),
    "device_sku": ("sku", "device_sku", "device sku"), "subscribers": ("demand_sites", "num_demand_points", "demand points", "number_of_subscribers"), "building_id": ("building_id", "building id"),
}
LINK_ALIASES = {
    "tx_site": ("tx_site", "tx site", "tx_site_id", "tx"), "rx_site": ("rx_site", "rx site", "rx_site_id", "rx"), "site1": ("site1", "site1_id", "site 1"), "site2": ("site2", "site2_id", "site 2"),
    "pair": ("sites", "site_pair", "link"), "confidence": ("confidence", "los_confidence"),
}
SITE_TYPES = ("POP", "DN", "CN")


class InputError(ValueError):
    """An input file that can't be read as what it should be."""


def _raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("multiLine", True).option("escape", '"').csv(path)


def resolve(columns: list[str], aliases: dict[str, tuple[str, ...]], required: tuple[tuple[str, ...], ...]) -> dict[str, str]:
    """Property -> column; refuses two columns of one property and headers that hold none of the required sets."""
    wanted = {a: k for k, names in aliases.items() for a in names}
    found: dict[str, str] = {}
    for column in columns:
        key = wanted.get(column.lstrip("\ufeff").strip().lower())
        if key in found:
            raise InputError(f"columns {found[key]!r} and {column!r} both stand for {key}")
        if key:
            found[key] = column
    if not any(all(k in found for k in option) for option in required):
        raise InputError(f"the header has none of {required}")
    return found


def _picked(df: DataFrame, found: dict[str, str]) -> DataFrame:
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return df.select(*(blank(F.col(f"`{column}`")).alias(key) for key, column in found.items()))


def _checked(value: Column, good: Column, message: str) -> Column:
    return F.when(value.isNull() | good, value).otherwise(F.raise_error(F.concat(F.lit(message + ": "), value)))


def read_sites(spark: SparkSession, path: str, *, for_network: bool = False) -> DataFrame:
    """Site file -> name, site_type, latitude, longitude, altitude, height, device_sku, subscribers, building_id, status, location_type.

    Rows without a place are left out; the type's first word counts, POP without one; an unknown type is an error.
    """
    raw = _raw(spark, path)
    required = (("name", "site_type", "latitude", "longitude"),) if for_network else (("latitude", "longitude"),)
    rows = _picked(raw, resolve(raw.columns, SITE_ALIASES, required))
    for key in SITE_ALIASES:
        if key not in rows.columns:
            rows = rows.withColumn(key, F.lit(None).cast("string"))
    kind = F.upper(F.split(F.coalesce("site_type", F.lit("POP")), r"\s+")[0])
    rows = rows.filter("latitude is not null and longitude is not null")
    return rows.select(
        "name", _checked(kind, kind.isin(*SITE_TYPES), "unknown site type").alias("site_type"), dms_to_decimal("latitude").alias("latitude"), dms_to_decimal("longitude").alias("longitude"),
        *(F.col(c).try_cast("double").alias(c) for c in ("altitude", "height")), "device_sku", *(F.col(c).try_cast("double").try_cast("bigint").alias(c) for c in ("subscribers", "building_id")),
        F.lit("CANDIDATE").alias("status"), F.lit("UNKNOWN").alias("location_type"),
    )


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Link file -> tx_site, rx_site, confidence. Columns of a pair `a --> b` or tx and rx are directed, site1 and site2 give both directions."""
    raw = _raw(spark, path)
    rows = _picked(raw, resolve(raw.columns, LINK_ALIASES, (("tx_site", "rx_site"), ("site1", "site2"), ("pair",))))
    confidence = F.col("confidence").try_cast("double") if "confidence" in rows.columns else F.lit(None).cast("double")
    if "pair" in rows.columns:
        part = F.split("pair", "-->")
        return rows.select(F.trim(part[0]).alias("tx_site"), F.trim(F.try_element_at(part, F.lit(2))).alias("rx_site"), confidence.alias("confidence"))
    if "site1" in rows.columns and "site2" in rows.columns:
        there = rows.select(F.col("site1").alias("tx_site"), F.col("site2").alias("rx_site"), confidence.alias("confidence"))
        return there.unionAll(there.select(F.col("rx_site").alias("tx_site"), F.col("tx_site").alias("rx_site"), "confidence"))
    return rows.select("tx_site", "rx_site", confidence.alias("confidence"))


def repeated_links(links: DataFrame) -> DataFrame:
    """Directed pairs that occur more than once: must be empty."""
    return links.groupBy("tx_site", "rx_site").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def read_network(spark: SparkSession, sites_path: str, links_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sites, links between them in both directions but from clients, and the names of links that no site has."""
    sites, links = read_sites(spark, sites_path, for_network=True), read_links(spark, links_path)
    if twice := [f"{r.tx_site} -> {r.rx_site}" for r in repeated_links(links).limit(10).collect()]:
        raise InputError(f"links given more than once: {', '.join(twice)}")
    ends = links.select(F.explode(F.array("tx_site", "rx_site")).alias("name")).distinct()
    unknown = ends.join(sites.select("name"), "name", "left_anti")
    both = links.unionAll(links.select(F.col("rx_site").alias("tx_site"), F.col("tx_site").alias("rx_site"), "confidence")).dropDuplicates(["tx_site", "rx_site"])
    senders = sites.filter("site_type <> 'CN'").select(F.col("name").alias("tx_site"))
    receivers = sites.select(F.col("name").alias("rx_site"))
    return sites, both.join(senders, "tx_site", "left_semi").join(receivers, "rx_site", "left_semi").select("tx_site", "rx_site", "confidence"), unknown


def read_mcs(spark: SparkSession, path: str, *, min_mcs: int | None = None) -> list[tuple[int, float, float, float]]:
    """Modulation classes from a file whose headers contain mcs, snr, mbps and perhaps tx_backoff; all must rise together."""
    raw = _raw(spark, path)
    found = {}
    for key in ("mcs", "snr", "mbps", "tx_backoff"):
        hits = [c for c in raw.columns if key in c.lower()]
        if len(hits) > 1 or (not hits and key != "tx_backoff"):
            raise InputError(f"{len(hits)} columns for {key}")
        if hits:
            found[key] = hits[0]
    rows = raw.select(*(F.col(f"`{c}`").cast("double").alias(k) for k, c in found.items()))
    table = sorted((int(r["mcs"]), float(r["snr"]), float(r["mbps"]), float(r["tx_backoff"]) if "tx_backoff" in found else 0.0) for r in rows.limit(1001).collect())
    if len(table) > 1000:
        raise InputError("more than 1000 classes")
    if any(a[i] > b[i] for a, b in zip(table, table[1:], strict=False) for i in (1, 2, 3)):
        raise InputError("snr, mbps and tx_backoff must rise with mcs")
    return [t for t in table if min_mcs is None or t[0] >= min_mcs] or list(DEFAULT_MCS)


def read_antenna_pattern(spark: SparkSession, path: str) -> DataFrame:
    """Antenna files -> antenna, axis (HORIZONTAL, VERTICAL), degree, gain: sections of 360 lines, losses turned into gains.

    Each file is read by itself; a section with another number of lines is refused.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    lines = lines.withColumn("w", F.split(F.trim("text"), r"[\s,;]+")).filter("trim(text) <> ''")
    head = F.upper(F.col("w")[0])
    order = Window.partitionBy("file").orderBy("line")  # a file of some hundred lines
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    name = F.when(head == "NAME", F.array_join(F.slice("w", 2, 99), " "))
    axis = F.when(head.isin("HORIZONTAL", "VERTICAL"), head)
    lines = lines.withColumns({"antenna": F.last(name, True).over(upto), "axis": F.last(axis, True).over(upto)})
    rows = lines.filter(axis.isNull() & name.isNull() & F.col("axis").isNotNull())
    degree, loss = F.col("w")[0].try_cast("double"), F.try_element_at("w", F.lit(2)).try_cast("double")
    rows = rows.select("file", "antenna", "axis", degree.cast("int").alias("degree"), (-loss).alias("gain")).filter("degree is not null and gain is not null")
    if bad := rows.groupBy("file", "antenna", "axis").count().filter("count <> 360").limit(10).collect():
        raise InputError("sections without 360 lines: " + ", ".join(f"{r.antenna} {r.axis} ({r['count']})" for r in bad))
    return rows.drop("file")


def read_scan_pattern(spark: SparkSession, path: str) -> DataFrame:
    """Scan file (a row for each azimuth, a column for each elevation) -> az, el, gain."""
    raw = _raw(spark, path)
    first, *rest = raw.columns
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("el"), F.col(f"`{c}`").alias("gain")) for c in rest))).alias("x")
    return raw.select(F.col(f"`{first}`").alias("az"), pairs).select(F.col("az").cast("double").alias("az"), F.col("x.el").cast("double").alias("el"), F.col("x.gain").cast("double").alias("gain"))
