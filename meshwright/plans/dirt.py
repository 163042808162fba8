"""Queries of the general data problems 1 to 5, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.operators import linegrammar, orphans, proximity, schemadrift, units
from meshwright.plans import dirt_oracles
from meshwright.tables import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(
        table(spark, d, "links"), table(spark, d, "sites"), row_id="link_row", refs={"tx": "tx_site", "rx": "rx_site"}, child_scope="plan_id",
        at="planned_at", parent_scope="plan_id", parent_name="site_name", start="recorded_at", end="deleted_at", parent_table="sites",
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select(F.col("row_id").alias("link_row"), F.col("side").alias("link_side"))


def p1_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d), table(spark, d, "sites"), parent_scope="plan_id", parent_name="site_name")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return proximity.near_and_inside(table(spark, d, "sites"), table(spark, d, "areas"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return linegrammar.parse_lines(table(spark, d, "raw_lines")).filter("line_no > 1")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines in error, by the first error of each."""
    return _parsed(spark, d).filter("error_no = 1").select("line_id")


def p3_typed(spark: SparkSession, d: str) -> DataFrame:
    """Records of the lines without an error."""
    return _parsed(spark, d).filter("line_ok").select("line_id", "file_name", "file_kind", "line_no", *linegrammar.TYPED)


def p3_errors(spark: SparkSession, d: str) -> DataFrame:
    """Located errors."""
    return _parsed(spark, d).filter("error_reason is not null").select("line_id", "error_no", "error_reason", "error_field", "error_at", "raw_line")


def p3_recovered(spark: SparkSession, d: str) -> DataFrame:
    """Records that were read in lines with an error, before or behind it."""
    return _parsed(spark, d).filter("not line_ok and error_reason is null").select("line_id", "record_no", *linegrammar.TYPED)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    changes = schemadrift.schema_changes(table(spark, d, "feed_records"), table(spark, d, "field_aliases"))
    return changes.select("feed_id", "file_seq", "change_kind", "field_name")


def p4_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return schemadrift.alternatives(table(spark, d, "feed_records"))


def p4_sites(spark: SparkSession, d: str) -> DataFrame:
    return schemadrift.consistent_table(table(spark, d, "feed_records"), table(spark, d, "field_aliases"))


def p4_properties(spark: SparkSession, d: str) -> DataFrame:
    """The consistent table without the values of other names."""
    return p4_sites(spark, d).drop("other_fields")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return units.recorded_elsewise(p5_converted(spark, d)).select("meas_id", "field_name")


def p5_converted(spark: SparkSession, d: str) -> DataFrame:
    return units.convert_units(table(spark, d, "mount_surveys"), table(spark, d, "survey_notes"))


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """All values in canonical units, to six decimals."""
    return p5_converted(spark, d).filter("value is not null").select("meas_id", "field_name", (F.round("value", 6) + 0.0).alias("value"))


QUERIES = {f.__name__: f for f in (p1_found, p1_orphans_by_month, p2_found, p3_found, p3_typed, p3_errors, p3_recovered, p4_found, p4_alternatives, p4_sites, p4_properties, p5_found, p5_converted, p5_values)}

_CASES = """
WITH e AS (
  SELECT link_row, 'tx' AS link_side, plan_id, lower(trim(tx_site)) AS k, planned_at FROM links
  UNION ALL SELECT link_row, 'rx', plan_id, lower(trim(rx_site)), planned_at FROM links),
s AS (SELECT plan_id, lower(trim(site_name)) AS k, recorded_at, deleted_at FROM sites),
c AS (SELECT e.*, EXISTS (SELECT 1 FROM s WHERE s.plan_id = e.plan_id AND s.k = e.k AND s.recorded_at <= e.planned_at) AS seen_before
  FROM e WHERE k <> '' AND NOT EXISTS (SELECT 1 FROM s WHERE s.plan_id = e.plan_id AND s.k = e.k AND s.recorded_at <= e.planned_at
    AND (s.deleted_at IS NULL OR e.planned_at < s.deleted_at)))
"""
ORACLES = dirt_oracles.ORACLES | {
    "p1_found": _CASES + "SELECT link_row, link_side FROM c",
    "p1_orphans_by_month": _CASES + """, g AS (SELECT link_side, plan_id, k, strftime(planned_at, '%Y-%m') AS period,
  CASE WHEN seen_before THEN 'deleted' WHEN EXISTS (SELECT 1 FROM s WHERE s.plan_id = c.plan_id AND s.k = c.k) THEN 'not_yet_recorded' ELSE 'unknown' END AS cause FROM c)
SELECT 'sites' AS parent_table, link_side AS side, period, cause, count(*) AS orphan_refs, count(DISTINCT (plan_id, k)) AS missing_keys FROM g GROUP BY ALL""",
    "p2_found": """
WITH l AS (SELECT site_row, plan_id, lower(trim(site_name)) AS k, latitude AS lat, longitude AS lon, radians(latitude) AS rlat, radians(longitude) AS rlon,
    CASE WHEN altitude <> -32768 AND NOT isnan(altitude) THEN altitude END AS alt, CAST(floor(latitude * 4000) AS BIGINT) AS band
  FROM sites WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0)),
near AS (SELECT a.site_row AS x, b.site_row AS y, 12742000 * asin(sqrt(least(1, pow(sin((b.rlat - a.rlat) / 2), 2) + cos(a.rlat) * cos(b.rlat) * pow(sin((b.rlon - a.rlon) / 2), 2)))) AS ground,
    coalesce(a.alt - b.alt, 0) AS rise
  FROM l a JOIN (SELECT *, unnest([band - 1, band, band + 1]) AS near_band FROM l) b ON a.band = b.near_band AND a.site_row < b.site_row
    AND abs(a.lat - b.lat) < 0.00025 AND (a.plan_id IS DISTINCT FROM b.plan_id OR a.k IS DISTINCT FROM b.k)),
corners AS (SELECT area_id, 'outer' AS part, unnest(outer_ring) AS p, generate_subscripts(outer_ring, 1) AS i FROM areas
  UNION ALL SELECT area_id, 'hole', unnest(hole_ring), generate_subscripts(hole_ring, 1) FROM areas WHERE hole_ring IS NOT NULL),
edges AS (SELECT a.area_id, a.part, a.p.lon AS x1, a.p.lat AS y1, b.p.lon AS x2, b.p.lat AS y2 FROM corners a JOIN corners b ON a.area_id = b.area_id AND a.part = b.part AND b.i = a.i + 1),
crossed AS (SELECT area_id, site_row, count(*) FILTER (part = 'outer') AS o, count(*) FILTER (part = 'hole') AS h
  FROM edges JOIN l ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL)
SELECT 'site' AS match_kind, x AS key_a, y AS key_b FROM near WHERE sqrt(ground * ground + rise * rise) <= 25
UNION ALL SELECT 'area', area_id, site_row FROM crossed WHERE o % 2 = 1 AND h % 2 = 0""",
}
