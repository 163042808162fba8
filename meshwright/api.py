"""Public entry points over files: candidate networks and analyses, with reports written beside them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions import geo
from meshwright.plans.pipeline import LosRules, candidate_network, metrics
from meshwright.session import ship
from meshwright.sources import config
from meshwright.sources.geodata import read_geotiff
from meshwright.sources.kml import kml_sites, read_kml, write_kml
from meshwright.sources.sinks import write_csv, write_metrics
from meshwright.sources.tables import read_network, read_sites


def load_sites(spark: SparkSession, path: str) -> DataFrame:
    """Sites of a CSV or KML/KMZ file as site_id, plan_id, site_type, lon, lat, alt, building_id, location_type, status, name."""
    raw = kml_sites(read_kml(spark, path)) if path.lower().endswith((".kml", ".kmz")) else read_sites(spark, path)
    place = F.concat_ws(":", "site_type", F.round("latitude", 7), F.round("longitude", 7), F.coalesce("device_sku", F.lit("")))
    return raw.select(
        F.coalesce("name", F.md5(place)).alias("site_id"), F.lit("plan").alias("plan_id"), "site_type", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"),
        F.col("altitude").alias("alt"), "building_id", "location_type", "status", F.coalesce("name", F.md5(place)).alias("name"), "device_sku", "subscribers",
    ).dropDuplicates(["site_id"])


def with_ground(sites: DataFrame, raster: DataFrame, cell: float) -> DataFrame:
    """Fills missing altitudes from a raster (epsg, x, y, z) in the sites' UTM zone: its cell under each site, plus two metres."""
    x, y = geo.to_utm("lon", "lat")
    at = sites.withColumns({"epsg": geo.utm_epsg("lon", "lat"), "cx": F.floor(x / cell), "cy": F.floor(y / cell)})
    cells = raster.groupBy("epsg", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.max("z").alias("z"))
    return at.join(cells, ["epsg", "cx", "cy"], "left").withColumn("alt", F.coalesce("alt", F.col("z") + 2.0)).drop("epsg", "cx", "cy", "z")


def generate_candidate_network(spark: SparkSession, sites_path: str, out_dir: str, *, config_path: str | None = None, raster_path: str | None = None) -> DataFrame:
    """Candidate links between the sites of a file, written as CSV and KML; returns the links."""
    ship(spark)
    plan = config.load(config_path) if config_path else config.Plan()
    rules = LosRules(plan.los.minimum_los_distance, plan.los.maximum_los_distance, plan.los.maximum_elevation_scan_angle, min(plan.los.los_confidence_threshold, 1.0), plan.los.use_ellipsoidal_los_model)
    sites = load_sites(spark, sites_path)
    if raster_path:
        sites = with_ground(sites, read_geotiff(spark, raster_path), rules.cell_m)
    links = candidate_network(sites, rules).cache()
    os.makedirs(out_dir, exist_ok=True)
    write_csv(links.orderBy("tx_id", "rx_id"), os.path.join(out_dir, "links"))
    end = lambda k: sites.select(F.col("site_id").alias(f"{k}_id"), F.col("lon").alias(f"{k}_lon"), F.col("lat").alias(f"{k}_lat"), F.col("site_type").alias(f"{k}_type"))
    shown = links.join(end("tx"), "tx_id").join(end("rx"), "rx_id")
    kind = F.when(F.col("rx_type") == "CN", "WIRELESS_ACCESS").otherwise("WIRELESS_BACKHAUL")
    lines = shown.select(F.concat_ws("-", "tx_id", "rx_id").alias("name"), F.lit("CANDIDATE").alias("status"), kind.alias("kind"), "tx_lon", "tx_lat", "rx_lon", "rx_lat", "confidence", "mcs")
    write_kml(os.path.join(out_dir, "network.kml"), sites.select("name", "site_type", "status", "lat", "lon", "alt", "device_sku"), lines)
    return links


def analyze_network(spark: SparkSession, sites_path: str, links_path: str, out_dir: str) -> DataFrame:
    """Metrics of a network in files, written as YAML, with its sites and links as CSV; returns the metrics."""
    ship(spark)
    sites, links, unknown = read_network(spark, sites_path, links_path)
    if missing := [r.name for r in unknown.limit(10).collect()]:
        raise ValueError(f"links name sites that do not exist: {', '.join(missing)}")
    end = lambda k: sites.select(F.col("name").alias(f"{k}_site"), F.col("site_type").alias(f"{k}_type"), F.col("longitude").alias(f"{k}_lon"), F.col("latitude").alias(f"{k}_lat"), F.col("altitude").alias(f"{k}_alt"))
    full = links.join(end("tx"), "tx_site").join(end("rx"), "rx_site").withColumns({"status": F.lit("PROPOSED"), "is_wireless": F.lit(True), "capacity": F.lit(None).cast("double")})
    out = metrics(sites, full).cache()
    os.makedirs(out_dir, exist_ok=True)
    write_metrics(out, os.path.join(out_dir, "metrics.yaml"))
    write_csv(sites.orderBy("name"), os.path.join(out_dir, "sites"))
    write_csv(full.orderBy("tx_site", "rx_site"), os.path.join(out_dir, "links"))
    return out
