"""Radio link budgets as column functions; powers in dBm, gains and losses in dB, frequencies in MHz."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions.geo import c

FSPL_CONSTANT = 92.45
# Oxygen loss in dB/km at whole GHz from 52 to 68; public table 7.6.1-1 of ETSI TR 138 901. Fixed values.
OXYGEN_FIRST_GHZ = 52.0
OXYGEN_LOSS = (0.0, 1.0, 2.2, 4.0, 6.6, 9.7, 12.6, 14.6, 15.0, 14.6, 14.3, 10.5, 6.8, 3.9, 1.9, 1.0, 0.0)
# Default modulation classes: mcs, least SNR, Mbps, transmit back-off. Fixed values.
DEFAULT_MCS = (
    (3, 3.0, 0.0, 0.0), (4, 4.5, 67.5, 0.0), (5, 5.0, 115.0, 0.0), (6, 5.5, 260.0, 0.0), (7, 7.5, 452.5, 0.0), (8, 9.0, 645.0, 0.0),
    (9, 12.0, 741.25, 0.0), (10, 14.0, 1030.0, 2.0), (11, 16.0, 1415.0, 4.0), (12, 18.0, 1800.0, 6.0),
)
McsTable = Sequence[tuple[int, float, float, float]]


def fspl(km, ghz) -> Column:
    """Free-space path loss; 0 so near that it would be negative."""
    d, f = c(km), c(ghz)
    least = F.pow(F.lit(10.0), F.lit(-FSPL_CONSTANT / 20) - F.log10(f))
    return F.when(d <= least, F.lit(0.0)).otherwise(F.lit(20.0) * (F.log10(d) + F.log10(f)) + F.lit(FSPL_CONSTANT))


def to_linear(dbm) -> Column:
    return F.pow(F.lit(10.0), c(dbm) / F.lit(10.0))


def to_log(mw) -> Column:
    return F.lit(10.0) * F.log10(c(mw))


def rain_loss(km, rain_mm_h, availability_percent, mhz) -> Column:
    """ITU rain attenuation exceeded for the rest of the availability; constants are the model's."""
    d, rain, ghz = c(km), c(rain_mm_h), c(mhz) / F.lit(1000.0)
    alpha = 0.7486
    specific = F.lit(0.8515) * F.pow(rain, F.lit(alpha))
    length = F.lit(0.477) * F.pow(d, F.lit(0.633)) * F.pow(rain, F.lit(0.073 * alpha)) * F.pow(ghz, F.lit(0.123)) - F.lit(10.579) * (F.lit(1.0) - F.exp(F.lit(-0.024) * d))
    reduced = specific * d * F.least(F.lit(1.0) / length, F.lit(2.5))
    c0 = F.lit(0.12) + F.lit(0.4) * F.log10(F.pow(ghz / F.lit(10.0), F.lit(0.8)))
    c1 = F.pow(F.lit(0.07), c0) * F.pow(F.lit(0.12), F.lit(1.0) - c0)
    c2, c3 = F.lit(0.855) * c0 + F.lit(0.546) * (F.lit(1.0) - c0), F.lit(0.139) * c0 + F.lit(0.043) * (F.lit(1.0) - c0)
    rest = F.lit(100.0) - c(availability_percent)
    loss = reduced * c1 * F.pow(rest, -(c2 + c3 * F.log10(rest)))
    return F.when(d <= 0, F.lit(0.0)).otherwise(F.greatest(loss, F.lit(0.0)))


def oxygen_loss(km, mhz) -> Column:
    """Loss by oxygen, linear between the table's whole GHz and 0 outside it."""
    ghz = c(mhz) / F.lit(1000.0)
    table = F.array(*(F.lit(x) for x in OXYGEN_LOSS))
    at = F.least(F.floor(ghz - F.lit(OXYGEN_FIRST_GHZ)).cast("int"), F.lit(len(OXYGEN_LOSS) - 2))
    low, high = F.get(table, at), F.get(table, at + 1)
    per_km = low + (high - low) * (ghz - F.lit(OXYGEN_FIRST_GHZ) - at)
    inside = ghz.between(OXYGEN_FIRST_GHZ, OXYGEN_FIRST_GHZ + len(OXYGEN_LOSS) - 1)
    return F.when(inside, per_km * c(km)).otherwise(F.lit(0.0))


def net_gain(tx_gain, tx_loss, km, ghz, rx_gain=None, rx_loss=None, other_loss=0.0) -> Column:
    """All gains less all losses; a receiver without values is like the transmitter."""
    rx_g = c(tx_gain) if rx_gain is None else F.coalesce(c(rx_gain), c(tx_gain))
    rx_l = c(tx_loss) if rx_loss is None else F.coalesce(c(rx_loss), c(tx_loss))
    return c(tx_gain) - c(tx_loss) + rx_g - rx_l - fspl(km, ghz) - c(other_loss)


def link_net_gain(meters: str, mhz, tx_gain, tx_loss, rx_gain, rx_loss, rain_mm_h, availability_percent) -> Column:
    """Net gain with path, rain and oxygen losses; give lengths as a column's name, they are used several times."""
    km = c(meters) / F.lit(1000.0)
    weather = rain_loss(km, rain_mm_h, availability_percent, mhz) + oxygen_loss(km, mhz)
    return net_gain(tx_gain, tx_loss, km, c(mhz) / F.lit(1000.0), rx_gain, rx_loss, weather)


def max_tx_power(maximum, minimum, gain, max_eirp) -> Column:
    return F.greatest(c(minimum), F.least(c(maximum), c(max_eirp) - c(gain)))


def _first(cases: list[tuple[Column, Column]], default: Column) -> Column:
    chain = None
    for condition, value in cases:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return default if chain is None else chain.otherwise(default)


def mcs_of_snr(snr, table: McsTable = DEFAULT_MCS) -> Column:
    """Highest class whose least SNR is met; 0 below all and for NaN."""
    x = c(snr)
    return _first([(F.isnan(x), F.lit(0)), *((x >= F.lit(least), F.lit(mcs)) for mcs, least, _, _ in sorted(table, reverse=True))], F.lit(0))


def snr_of_mcs(mcs, table: McsTable = DEFAULT_MCS) -> Column:
    """Highest least SNR of the classes up to mcs; 0 below all."""
    highest = {k: max(s for m, s, _, _ in table if m <= k) for k, _, _, _ in table}
    return _first([(c(mcs) >= F.lit(k), F.lit(s)) for k, s in sorted(highest.items(), reverse=True)], F.lit(0.0))


def _of_mcs(mcs: Column, table: McsTable, at: int) -> Column:
    values = F.create_map(*(F.lit(x) for row in table for x in (row[0], float(row[at]))))
    return F.coalesce(values[mcs.cast("int")], F.lit(0.0))


def capacity_of_mcs(mcs, table: McsTable = DEFAULT_MCS) -> Column:
    """Gbps of a class, 0 for one not in the table."""
    return _of_mcs(c(mcs), table, 2) / F.lit(1000.0)


def backoff_of_mcs(mcs, table: McsTable = DEFAULT_MCS) -> Column:
    return _of_mcs(c(mcs), table, 3)


def mcs_within_power(mcs, gain, noise, max_power, min_power, table: McsTable = DEFAULT_MCS) -> Column:
    """Highest class up to mcs whose needed power is within the maximum less its back-off; 0 if none is.

    Classes that are missing in the table are tried, too: they need the SNR of the class below.
    """
    fits = F.filter(
        F.sequence(F.lit(1), F.greatest(c(mcs).cast("int"), F.lit(1))),
        lambda m: (F.greatest(c(min_power), snr_of_mcs(m, table) + c(noise) - c(gain)) <= c(max_power) - backoff_of_mcs(m, table)) & (m <= c(mcs)),
    )
    return F.coalesce(F.array_max(fits), F.lit(0))


def with_link_budget(df: DataFrame, gain: str, noise, max_power, min_power, table: McsTable = DEFAULT_MCS) -> DataFrame:
    """Adds mcs, tx_power, rsl, snr_db and gbps; tx_power is the most that the class allows.

    Steps are columns of their own, so that no expression is written out more than once in the generated code.
    """
    df = df.withColumn("mcs", mcs_of_snr(c(max_power) + c(gain) - c(noise), table))
    df = df.withColumn("mcs", mcs_within_power("mcs", gain, noise, max_power, min_power, table))
    df = df.withColumn("tx_power", c(max_power) - backoff_of_mcs("mcs", table))
    df = df.withColumn("rsl", F.col("tx_power") + c(gain))
    return df.withColumns({"snr_db": F.col("rsl") - c(noise), "gbps": capacity_of_mcs("mcs", table)})


def pattern_index(deviation) -> Column:
    """Index of a deviation in (-180, 180] in a pattern of 360 whole degrees, rounding half to even."""
    return F.pmod(F.bround(c(deviation), 0).cast("int"), F.lit(360))


def pattern_gain(boresight, diversity, pattern_az, pattern_el, az_dev, el_dev) -> Column:
    """Gain with two arrays of 360 relative gains; without patterns boresight and diversity gain."""
    gain = F.get(c(pattern_az), pattern_index(az_dev)) + F.get(c(pattern_el), pattern_index(el_dev))
    return c(boresight) + c(diversity) + F.coalesce(gain, F.lit(0.0))


def fresnel_radius(meters, mhz) -> Column:
    """Largest radius of the first Fresnel zone; the multiplier is half the root of the speed of light."""
    return F.lit(8.65725790883) * F.sqrt(c(meters) / c(mhz))


def mcs_cost(mcs) -> Column:
    """Routing cost by class: the slower the dearer; infinite for a class without throughput."""
    return F.when(c(mcs) >= 9, 1.0).when(c(mcs) >= 4, 3.0).when(c(mcs) >= 2, 15.0).otherwise(F.lit(math.inf))


def noise_power(noise_figure, thermal_noise) -> Column:
    """Noise power in dBm: the receiver's noise figure over the thermal noise."""
    return c(noise_figure) + c(thermal_noise)
