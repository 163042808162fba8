"""Polarity of sites (odd and even send in turn), channels, and the state that sectors of one node share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ODD, EVEN, NONE = "ODD", "EVEN", "UNASSIGNED"


def by_hops(levels: DataFrame) -> DataFrame:
    """Sites an even number of hops from a source are even, the others odd: site_id, polarity."""
    return levels.select(F.col("node").alias("site_id"), F.when(F.col("hops") % 2 == 0, EVEN).otherwise(ODD).alias("polarity"))


def of_clients(links: DataFrame, polarity: DataFrame) -> DataFrame:
    """A client has the opposite polarity of those that send to it; UNASSIGNED where they differ or have none: site_id, polarity."""
    heard = links.filter("rx_type = 'CN'").join(polarity.select(F.col("site_id").alias("tx_id"), "polarity"), "tx_id", "left")
    per = heard.groupBy(F.col("rx_id").alias("site_id")).agg(F.min("polarity").alias("a"), F.max("polarity").alias("b"), F.count_if(F.col("polarity").isNull()).alias("unknown"))
    opposite = F.when((F.col("unknown") == 0) & (F.col("a") == F.col("b")), F.when(F.col("a") == ODD, EVEN).when(F.col("a") == EVEN, ODD))
    return per.select("site_id", F.coalesce(opposite, F.lit(NONE)).alias("polarity"))


def compatible(a: Column, b: Column) -> Column:
    """Whether two polarities can talk: they differ, or one is unassigned."""
    return (F.coalesce(a, F.lit(NONE)) == NONE) | (F.coalesce(b, F.lit(NONE)) == NONE) | (a != b)


def same_channel(a: Column, b: Column) -> Column:
    """Whether two channels can talk: they are one, or one is unassigned (negative or null)."""
    return (F.coalesce(a, F.lit(-1)) < 0) | (F.coalesce(b, F.lit(-1)) < 0) | (a == b)


def conflicts(links: DataFrame, polarity: DataFrame) -> DataFrame:
    """Links between relays whose ends have one polarity."""
    side = lambda k: polarity.select(F.col("site_id").alias(f"{k}_id"), F.col("polarity").alias(f"{k}_polarity"))
    both = links.filter("rx_type <> 'CN'").join(side("tx"), "tx_id").join(side("rx"), "rx_id")
    return both.filter(~compatible(F.col("tx_polarity"), F.col("rx_polarity")))


def share_in_node(sectors: DataFrame) -> DataFrame:
    """A sector is active if any sector of its node is: sector_id, site_id, node, active -> active of the node; combined, not windowed."""
    nodes = sectors.groupBy("site_id", "node").agg(F.bool_or("active").alias("node_active"))
    return sectors.join(nodes, ["site_id", "node"])
