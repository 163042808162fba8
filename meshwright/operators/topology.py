"""Operators on a network of sites and links as DataFrames; every change returns a new DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions import geo

ACTIVE = ("PROPOSED", "EXISTING")
FIXED = ("EXISTING", "UNAVAILABLE")


@dataclass(frozen=True)
class Network:
    """sites(site_id, site_type, status, ...), links(link_id, tx_id, rx_id, status, ...), sectors(sector_id, site_id, status, ...), demands(demand_id, sites array)."""

    sites: DataFrame
    links: DataFrame
    sectors: DataFrame
    demands: DataFrame

    def with_sites(self, new: DataFrame) -> Network:
        """Adds sites; those already there keep their row."""
        return replace(self, sites=self.sites.unionByName(new.join(self.sites.select("site_id"), "site_id", "left_anti").dropDuplicates(["site_id"]), allowMissingColumns=True))

    def without_sites(self, ids: DataFrame) -> Network:
        """Removes sites with their sectors and links."""
        gone = ids.select(F.col("site_id").alias("gone"))
        keep = lambda df, key: df.join(gone, df[key] == gone["gone"], "left_anti")
        return replace(self, sites=keep(self.sites, "site_id"), sectors=keep(self.sectors, "site_id"), links=keep(keep(self.links, "tx_id"), "rx_id"))

    def with_links(self, new: DataFrame) -> Network:
        """Adds links whose ends exist and that aren't there yet."""
        known = self.sites.select("site_id")
        ends = new.join(known.withColumnRenamed("site_id", "tx_id"), "tx_id", "left_semi").join(known.withColumnRenamed("site_id", "rx_id"), "rx_id", "left_semi")
        fresh = ends.join(self.links.select("link_id"), "link_id", "left_anti").dropDuplicates(["link_id"])
        return replace(self, links=self.links.unionByName(fresh, allowMissingColumns=True))

    def without_links(self, ids: DataFrame) -> Network:
        return replace(self, links=self.links.join(ids.select("link_id"), "link_id", "left_anti"))

    def with_sectors(self, new: DataFrame) -> Network:
        """Adds sectors of known sites."""
        fresh = new.join(self.sites.select("site_id"), "site_id", "left_semi").join(self.sectors.select("sector_id"), "sector_id", "left_anti").dropDuplicates(["sector_id"])
        return replace(self, sectors=self.sectors.unionByName(fresh, allowMissingColumns=True))

    def without_sectors(self, ids: DataFrame) -> Network:
        """Removes sectors; a link that used one loses both of its sectors."""
        gone = ids.select(F.col("sector_id").alias("gone")).distinct()
        links = self.links
        for end in ("tx_sector", "rx_sector"):
            hit = gone.withColumnRenamed("gone", end).withColumn(f"_{end}", F.lit(True))
            links = links.join(hit, end, "left")
        hit = F.coalesce("_tx_sector", "_rx_sector").isNotNull()
        links = links.withColumns({e: F.when(~hit, F.col(e)) for e in ("tx_sector", "rx_sector")}).drop("_tx_sector", "_rx_sector")
        return replace(self, sectors=self.sectors.join(gone, self.sectors["sector_id"] == gone["gone"], "left_anti"), links=links)

    def with_demands(self, new: DataFrame) -> Network:
        """Adds or replaces demands."""
        kept = self.demands.join(new.select("demand_id"), "demand_id", "left_anti")
        return replace(self, demands=kept.unionByName(new, allowMissingColumns=True))

    def without_demands(self, ids: DataFrame) -> Network:
        return replace(self, demands=self.demands.join(ids.select("demand_id"), "demand_id", "left_anti"))


def set_status(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Gives rows the status of `wanted` (key, new_status); existing and unavailable ones can't be left or entered."""
    joined = rows.join(wanted.select(key, "new_status"), key, "left")
    may = F.col("new_status").isNotNull() & ~F.col("status").isin(*FIXED) & ~F.col("new_status").isin(*FIXED)
    return joined.withColumn("status", F.when(may, F.col("new_status")).otherwise(F.col("status"))).drop("new_status")


def with_reverse(links: DataFrame, *columns: str) -> DataFrame:
    """Each link with the named columns of its reverse, prefixed reverse_, null without one; equi-join on swapped ends."""
    back = links.select(F.col("rx_id").alias("tx_id"), F.col("tx_id").alias("rx_id"), *(F.col(c).alias(f"reverse_{c}") for c in columns))
    return links.join(back, ["tx_id", "rx_id"], "left")


def neighbors(links: DataFrame, *, out: bool = True, wireless_only: bool = False) -> DataFrame:
    """site_id and its successors (or predecessors), one row per link."""
    a, b = ("tx_id", "rx_id") if out else ("rx_id", "tx_id")
    rows = links.filter("is_wireless") if wireless_only else links
    return rows.select(F.col(a).alias("site_id"), F.col(b).alias("neighbor_id")).distinct()


def colocated(sites: DataFrame) -> DataFrame:
    """Groups of sites at one place (longitude, latitude, altitude): sites, and how many are redundant, by type."""
    return sites.groupBy("lon", "lat", "alt").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("site_type").alias("types"), F.min("site_id").alias("first_id"))


def redundant_sites(sites: DataFrame) -> DataFrame:
    """Sites beyond the first of their type at a place, per type."""
    per = sites.groupBy("site_type", "lon", "lat", "alt").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("site_type").agg(F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("redundant"))


def sector_azimuths(count: Column) -> Column:
    """Array of equidistant azimuths."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: i.cast("double") * F.lit(360.0) / count)


def nearest_sector(azimuths: Column, bearing: Column, range_deg: Column | float) -> Column:
    """Struct (off, position) of the sector whose azimuth is nearest to a bearing; null if out of half its range.

    The sectors of a site are a short array, so the argmin needs no join.
    """
    offs = F.transform(azimuths, lambda a, i: F.struct(F.round(F.abs(geo.angle_delta(bearing, a)), 9).alias("off"), i.alias("position")))
    best = F.array_min(offs)
    width = range_deg if isinstance(range_deg, Column) else F.lit(float(range_deg))
    return F.when(best["off"] <= width / 2 + F.lit(0.01), best)


def site_flow(links: DataFrame, flow: str) -> DataFrame:
    """In- and outgoing flow of each site."""
    ends = F.explode(F.array(F.struct(F.col("tx_id").alias("site_id"), F.col(flow).alias("o"), F.lit(0.0).alias("i")), F.struct(F.col("rx_id").alias("site_id"), F.lit(0.0).alias("o"), F.col(flow).alias("i")))).alias("e")
    return links.select(ends).groupBy("e.site_id").agg(F.sum("e.o").alias("flow_out"), F.sum("e.i").alias("flow_in"))


def close_angle_pairs(links: DataFrame, limit_deg: float) -> DataFrame:
    """Pairs of links of one transmitter no more than limit_deg apart: tx_id, first (smaller link_row), second, angle.

    Bearings are cut into slots as wide as the limit and joined with the slots around, so far pairs never meet.
    """
    slots = int(360 // limit_deg)
    side = links.select("tx_id", "link_row", "azimuth", F.least(F.floor(F.col("azimuth") / (360.0 / slots)), F.lit(slots - 1)).cast("int").alias("slot"), "length_m")
    a = side.select("tx_id", F.col("link_row").alias("first"), F.col("azimuth").alias("az1"), F.col("length_m").alias("len1"), "slot")
    near = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.pmod(F.col("slot") + i, F.lit(slots))))
    b = side.withColumn("slot", F.explode(near)).select("tx_id", F.col("link_row").alias("second"), F.col("azimuth").alias("az2"), F.col("length_m").alias("len2"), "slot")
    pairs = a.join(b, ["tx_id", "slot"]).filter("first < second")
    pairs = pairs.withColumn("angle", F.abs(geo.angle_delta("az1", "az2")))
    return pairs.filter(F.col("angle") <= limit_deg).drop("slot")


def elevation_off(rise: Column, length: Column) -> Column:
    """Angle of a link over the horizontal in degrees; 0 without a length or a rise."""
    return F.when(length > 0, F.coalesce(F.degrees(F.asin(F.greatest(F.least(rise / length, F.lit(1.0)), F.lit(-1.0)))), F.lit(0.0))).otherwise(F.lit(0.0))


def link_channel(status: Column, tx_channel: Column, rx_channel: Column) -> Column:
    """Channel of a link in use, that of both its sectors; -1 for others and where the sectors differ."""
    return F.when(status.isin("PROPOSED", "EXISTING") & (tx_channel == rx_channel), tx_channel).otherwise(F.lit(-1))


def violating_links(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links of any of the pairs (first, second: link_row), in both directions: link_row."""
    named = pairs.select(F.explode(F.array("first", "second")).alias("link_row")).distinct()
    there = links.join(named, "link_row", "left_semi").select("tx_id", "rx_id")
    both = there.unionAll(there.select(F.col("rx_id").alias("tx_id"), F.col("tx_id").alias("rx_id"))).distinct()
    return links.join(both, ["tx_id", "rx_id"], "left_semi").select("link_row")


def connectable_status(sites: DataFrame, links: DataFrame, reached: DataFrame) -> DataFrame:
    """site_id and state: picked sites are connected or unconnected; others are connectable (one link from a connected one) or not.

    sites: site_id, picked. links: tx_id, rx_id. reached: node, the picked sites that a picked source reaches over picked ones.
    """
    near = links.join(reached.select(F.col("node").alias("tx_id")), "tx_id", "left_semi").select(F.col("rx_id").alias("site_id"), F.lit(True).alias("near")).distinct()
    on = reached.select(F.col("node").alias("site_id"), F.lit(True).alias("on")).distinct()
    state = F.when(F.col("picked"), F.when(F.col("on"), "connected").otherwise("unconnected")).when(F.col("near"), "potential_connectable").otherwise("potential_other")
    return sites.select("site_id", "picked").join(on, "site_id", "left").join(near, "site_id", "left").select("site_id", state.alias("state"))
