"""Sector placement: directions of a site's sectors towards its neighbours.

Directions of neighbours are first counted in STEP-degree bins, so a site hands at most 360 / STEP numbers on, however
many links it has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.functions import geo

STEP = 3


def bearing_bins(links: DataFrame) -> DataFrame:
    """site_id, bin (multiple of STEP degrees) and n: directions of a site's links."""
    at = (F.floor(F.col("azimuth") / STEP) * STEP).cast("int")
    return links.groupBy(F.col("tx_id").alias("site_id"), F.pmod(at, F.lit(360)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def equidistant(bins: DataFrame, sectors: int, range_deg: float) -> DataFrame:
    """Best turn of equidistant sectors: least sum of squared deviations, 360 for a direction no sector covers: site_id, turn, cost."""
    width = 360.0 / sectors
    turns = F.explode(F.sequence(F.lit(0), F.lit(int(width) - STEP if width > STEP else 0), F.lit(STEP))).alias("turn")
    each = bins.select("site_id", "bin", "n", turns)
    to_next = F.pmod(F.col("bin") - F.col("turn"), F.lit(width))
    off = F.least(to_next, F.lit(width) - to_next)
    off = F.when(off > range_deg / 2, F.lit(360.0)).otherwise(off)
    costs = each.groupBy("site_id", "turn").agg(F.sum(off * off * F.col("n")).alias("cost"))
    best = F.min(F.struct("cost", "turn")).alias("best")
    return costs.groupBy("site_id").agg(best).select("site_id", "best.turn", "best.cost")


def best_azimuths(bins: np.ndarray, n: np.ndarray, sectors: int, range_deg: float, limit: int | None = None) -> tuple[float, list[int]]:
    """Azimuths of up to `sectors` sectors, at least range_deg apart, that cover a site's directions at least squared deviation.

    Exact over multiples of STEP: the circle is cut at each possible first sector and a dynamic program runs over the
    others in order. A direction no sector covers costs 360 squared, and so does each link beyond a sector's limit.
    """
    order = np.argsort(bins)
    bins, n = bins[order].astype(float), n[order].astype(float)
    grid = np.arange(0, 360, STEP, dtype=float)
    off = np.abs((bins[None, :] - grid[:, None] + 180) % 360 - 180)
    covered = off <= range_deg / 2
    # sectors at least a range apart never share a direction but at their edges, so costs add up
    gain = np.where(covered, (360.0**2 - off**2) * n, 0.0)
    value = gain.sum(1)
    if limit is not None:
        over = np.maximum((covered * n).sum(1) - limit, 0)
        value = value - over * 360.0**2
    k, gap = len(grid), int(np.ceil(range_deg / STEP))
    base = float((n * 360.0**2).sum())
    best: tuple[float, list[int]] = (base, [])
    back = np.maximum(np.arange(k) - gap + 1, 0)  # how far a pick reaches back
    for first in np.flatnonzero(value > 0):
        # positions after the first that keep the gap to it on both sides
        room = np.arange(first + gap, first + k - gap + 1) % k
        score, takes = [np.zeros(len(room) + 1)], []
        for _ in range(sectors - 1):
            take = score[-1][back[: len(room)]] + value[room]
            takes.append(take)
            score.append(np.maximum(score[-1], np.concatenate([[0.0], np.maximum.accumulate(take)])) if len(room) else score[-1])
        total = value[first] + score[-1][-1]
        if base - total < best[0] - 1e-9:
            chosen, i = [int(grid[first])], len(room)
            for m in range(sectors - 2, -1, -1):
                if i > 0 and score[m + 1][i] > score[m][i] + 1e-9:  # this sector is used: the first best pick up to here
                    i = int(takes[m][:i].argmax())
                    chosen.append(int(grid[room[i]]))
                    i = int(back[i])
            best = (base - total, sorted(chosen))
    return best


def place_sectors(bins: DataFrame, sectors: int, range_deg: float, limit: int | None = None) -> DataFrame:
    """Best azimuths of each site: site_id, cost, azimuths."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        cost, azimuths = best_azimuths(pdf["bin"].to_numpy(), pdf["n"].to_numpy(), sectors, range_deg, limit)
        return pd.DataFrame({"site_id": [key[0]], "cost": [round(cost, 6)], "azimuths": [azimuths]})

    return bins.groupBy("site_id").applyInPandas(run, "site_id string, cost double, azimuths array<int>")


def deviations(links: DataFrame, placed: DataFrame) -> DataFrame:
    """Deviation of each link from the nearest of its site's placed sectors: link_row, off."""
    joined = links.join(placed.select(F.col("site_id").alias("tx_id"), "azimuths"), "tx_id")
    return joined.select("link_row", F.array_min(F.transform("azimuths", lambda a: F.abs(geo.angle_delta("azimuth", a.cast("double"))))).alias("off"))
