"""Problem 7: mixing sources to target weights.

Documents of each source are cut by hash into shards and, in a seeded order, into blocks of equal token counts. The
total is what the scarcest source can give at its highest number of repeats, or a wanted total below that. Sainte-Laguë
apportionment (highest quotients w / (2n + 1)) hands out the total's blocks to sources, each source's blocks to groups of
RUN_SHARDS shards, and each group's blocks to its shards, as integers; the first step is taken over the fixed table of
targets, the others by tasks. A shard repeats all its documents as often as its quota covers them and takes the rest of
it as seeded blocks. A block holds the documents that begin in its tokens, so blocks are equal up to a document.

Defined results
---------------
* Null or empty texts can't be used. Sources compare trimmed and ignoring case; repeated ids are separate documents.
* Sources without documents or with max_repeats below 1 reach nothing; the others' targets are scaled up to 1.
* Targets that are null or not above 0 get nothing; repeated sources in the targets are added up, the least cap holds.
* No document is used more often than max_repeats. Documents not used are not in the result. Empty tables: empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.llm.packing import fixed_rows
from meshwright.tables import checkpoint

SHARD_TOKENS, RUN_SHARDS = 8_000_000, 4096
#: The smallest source's part of a shard is at least so many blocks.
LEAST_BLOCKS, LEAST_BLOCK_TOKENS = 64, 256


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray | None = None) -> np.ndarray:
    """Seats by highest quotients w / (2n + 1), none above its cap; ties go to the lower index.

    Most seats are found at once by their divisor, the last few by quotients.
    """
    weights = np.maximum(np.asarray(weights, float), 0)
    caps = np.full(len(weights), np.inf) if caps is None else np.asarray(caps, float)
    seats = int(min(seats, np.where(weights > 0, caps, 0).sum()))
    if seats <= 0 or not weights.any():
        return np.zeros(len(weights), np.int64)
    given = lambda divisor: np.where(weights > 0, np.minimum(caps, np.floor(weights / divisor + 0.5)), 0)
    low, high = weights[weights > 0].min() / (4 * seats + 4), 4 * weights.max() + 1
    while given(low).sum() < seats:
        low /= 2
    for _ in range(200):
        middle = (low * high) ** 0.5
        if given(middle).sum() > seats:
            low = middle
        else:
            high = middle
    out = given(high).astype(np.int64)
    heap = [(-w / (2 * n + 1), i) for i, (w, n, c) in enumerate(zip(weights, out, caps, strict=True)) if w > 0 and n < c]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = fixed_rows(targets.groupBy(F.lower(F.trim("doc_source")).alias("s")).agg(F.sum("target_share").alias("w"), F.min("max_repeats").alias("m")))
    return {r.s: (float(r.w), int(r.m or 0)) for r in rows if r.s and r.w and r.w > 0}


def _quotas(rows: DataFrame, seats: dict[str, int], most: dict[str, int], block: int) -> DataFrame:
    """Each shard's quota: source, shard, passes (whole repeats of all it has), rest (tokens beyond them), most.

    A source's blocks go to runs of shards in one task, which reads one row for each RUN_SHARDS shards; a run's blocks go to
    its shards in another.
    """
    held = rows.groupBy("source", "shard").agg(F.sum("n_tokens").alias("held")).withColumn("run", F.floor(F.col("shard") / RUN_SHARDS))
    runs = held.groupBy("source", "run").agg(F.sum("held").alias("held"))

    def split(pdf: pd.DataFrame, seats_here: int) -> np.ndarray:
        tokens = pdf["held"].to_numpy()
        return sainte_lague(tokens, seats_here, -(-tokens * most[pdf["source"].iloc[0]] // block))

    def to_runs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("run")
        return pdf.assign(seats=split(pdf, seats[pdf["source"].iloc[0]]))[["source", "run", "seats"]]

    def to_shards(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        held, cap = pdf["held"].to_numpy(), most[pdf["source"].iloc[0]]
        quota = np.minimum(split(pdf, int(pdf["seats"].iloc[0])) * block, held * cap)
        return pdf.assign(passes=quota // held, rest=quota % held, most=cap)[["source", "shard", "passes", "rest", "most"]]

    of_runs = runs.groupBy("source").applyInPandas(to_runs, "source string, run bigint, seats bigint")
    return held.join(of_runs, ["source", "run"]).groupBy("source", "run").applyInPandas(to_shards, "source string, shard bigint, passes bigint, rest bigint, most bigint")


def mix(sizes: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, seed: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Documents used, with repeats: doc_id, source, n_tokens, repeats, shard, block. sizes: doc_id, source, n_tokens."""
    spark = sizes.sparkSession
    wanted = _targets(targets)
    sizes = checkpoint(sizes.filter(F.col("source").isin(sorted(wanted))))  # texts are read once
    totals = {r[0]: int(r[1]) for r in sizes.groupBy("source").agg(F.sum("n_tokens")).collect()}  # one row a target source
    able = {s: (w, m) for s, (w, m) in wanted.items() if m >= 1 and totals.get(s)}
    schema = "doc_id bigint, source string, n_tokens bigint, repeats bigint, shard bigint, block bigint"
    if not able:
        return spark.createDataFrame([], schema)
    scale = sum(w for w, _ in able.values())
    total = min(totals[s] * m * scale / w for s, (w, m) in able.items())
    total = min(total, total_tokens) if total_tokens else total
    shards = max(1, -(-sum(totals.values()) // shard_tokens))
    least = min(w for w, _ in able.values()) / scale
    block = max(LEAST_BLOCK_TOKENS, int(total * least / (shards * LEAST_BLOCKS)))
    names = sorted(able)
    seats = dict(zip(names, sainte_lague([able[s][0] for s in names], round(total / block), [totals[s] * able[s][1] // block for s in names]), strict=True))
    # copies of a row are spread by their places in the checkpointed table, which are the same in every attempt
    place = F.monotonically_increasing_id()
    rows = sizes.withColumns({"shard": F.pmod(F.xxhash64("doc_id", place, F.lit(seed)), F.lit(shards)), "h": F.xxhash64("doc_id", "n_tokens", place, F.lit(seed + 1))}).filter(F.col("source").isin(names))
    quotas = _quotas(rows, seats, {s: able[s][1] for s in names}, block)
    in_shard = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("block", F.floor(F.coalesce(F.sum("n_tokens").over(in_shard), F.lit(0)) / block))
    rows = rows.join(quotas, ["source", "shard"])
    # whole blocks in a seeded order until the rest of the quota is met, to the nearest block
    blocks = rows.groupBy("source", "shard", "block", "rest").agg(F.sum("n_tokens").alias("b"))
    seeded = Window.partitionBy("source", "shard").orderBy(F.xxhash64("source", "shard", "block", F.lit(seed + 2)), "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("b").over(seeded), F.lit(0)))
    more = blocks.select("source", "shard", "block", (F.col("before") + F.col("b") / 2 <= F.col("rest")).cast("bigint").alias("more"))
    used = rows.join(more, ["source", "shard", "block"]).withColumn("repeats", F.least(F.col("passes") + F.col("more"), F.col("most")))
    return used.filter("repeats > 0").select("doc_id", "source", "n_tokens", "repeats", "shard", "block")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share of each target source, its tokens, documents and highest number of repeats."""
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    wanted = targets.groupBy(F.lower(F.trim("doc_source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    all_tokens = used.agg(F.sum("tokens").alias("all_tokens"))
    out = wanted.join(used, "source", "left").crossJoin(F.broadcast(all_tokens))  # one row
    share = F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("source", "target_share", share.alias("reached_share"), zero("tokens"), zero("documents"), zero("most_repeats"), "max_repeats")
