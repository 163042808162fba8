"""Interference between links and power control.

An interfering path runs from a transmitting sector to a receiving one along any link of the network. Its sender turns
to each of its own receivers in turn, so what it puts on a victim is the mean, over the links of its sector, of its
linear level; the levels of all paths into the victim's sector add up. The level of a path splits into what hangs on the
sender's turn and what hangs on the victim's, so the mean is taken per path first and only then joined with the victims:
the triples of path, sender's link and victim are never made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions import geo, rf
from meshwright.tables import checkpoint


def turn_loss(deviation: Column) -> Column:
    """Relative gain of a radio turned off its target: 12 (dev / 65)^2 dB less, 30 at most."""
    return -F.least(F.lit(12.0) * (deviation / 65.0) * (deviation / 65.0), F.lit(30.0))


def sector_levels(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean linear level of each path at its receiving end, and that of each victim's turn.

    links: link_row, tx_id, rx_id, tx_sector, rx_sector, azimuth, gain (net, pointing at each other), tx_power.
    Returns paths (path_row, tx_id, rx_id, rx_sector, azimuth, level in mW) and the links.
    """
    paths = links.select(F.col("link_row").alias("path_row"), "tx_id", "rx_id", "tx_sector", "rx_sector", F.col("azimuth").alias("path_azimuth"), F.col("gain").alias("path_gain"))
    senders = links.select("tx_sector", F.col("rx_id").alias("sends_to"), F.col("azimuth").alias("send_azimuth"), "tx_power")
    each = paths.join(senders, "tx_sector").filter("sends_to <> rx_id")
    level = rf.to_linear(F.col("tx_power") + F.col("path_gain") + turn_loss(F.abs(geo.angle_delta("send_azimuth", "path_azimuth"))))
    mean = each.withColumn("level", level).groupBy("path_row", "tx_id", "rx_id", "rx_sector", "path_azimuth").agg(F.avg("level").alias("level"))
    return mean, links


def interference(links: DataFrame) -> DataFrame:
    """Interference on each victim (link_row, mw): levels of all paths into its sector from other senders, by its own turn."""
    paths, links = sector_levels(links)
    victims = links.select("link_row", F.col("tx_id").alias("own_tx"), "rx_sector", "azimuth")
    pairs = paths.join(victims, "rx_sector").filter("own_tx <> tx_id")
    off = F.abs(geo.angle_delta("path_azimuth", "azimuth"))
    return pairs.withColumn("mw", F.col("level") * rf.to_linear(turn_loss(off))).groupBy("link_row").agg(F.sum("mw").alias("mw"))


def sinr(links: DataFrame, noise: float) -> DataFrame:
    """Adds sinr: level over interference and noise."""
    hit = links.join(interference(links), "link_row", "left")
    level = F.col("tx_power") + F.col("gain")
    return hit.withColumn("sinr", level - rf.to_log(F.coalesce("mw", F.lit(0.0)) + F.lit(10 ** (noise / 10)))).drop("mw")


def power_control(links: DataFrame, noise: float, max_power: float, min_power: float, *, most_rounds: int = 10, tolerance: float = 1e-5) -> DataFrame:
    """Turns each sender down to what its class needs until no power changes: link_row, mcs, sinr, tx_power, gbps, settled.

    It ends after most_rounds, the limit of the procedure; settled tells for each link if its power was still to change then.

    links as for interference, with tx_power to begin with. Each round is cut by a checkpoint.
    """
    # the class is kept with the least power that still meets its level under this interference
    needed = F.col("tx_power") - (F.col("sinr") - rf.snr_of_mcs("mcs"))
    power = F.when(F.col("mcs") > 0, F.least(F.greatest(needed, F.lit(min_power)), F.lit(max_power) - rf.backoff_of_mcs("mcs"))).otherwise(F.lit(min_power))
    step = lambda df: sinr(df, noise).withColumn("mcs", rf.mcs_of_snr("sinr")).withColumn("next", power)
    moves = F.abs(F.col("next") - F.col("tx_power"))
    state = checkpoint(links)
    for _ in range(most_rounds):
        now = checkpoint(step(state))
        moved = now.agg(F.max(moves).alias("m")).collect()[0]["m"]
        state = now.withColumn("tx_power", F.col("next")).select(*links.columns)
        if moved is None or moved <= tolerance:
            break
    return step(state).select("link_row", "mcs", "sinr", "tx_power", rf.capacity_of_mcs("mcs").alias("gbps"), (moves <= tolerance).alias("settled"))
