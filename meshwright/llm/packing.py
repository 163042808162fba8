"""Problem 6: filling fixed-capacity containers with items.

Mixture-controlled packing. All documents are put into one stream in which every source holds its target share of the
tokens; once a source has run out, its share goes to the others in proportion. How many tokens of a source stand before
any place of the stream is a piecewise linear function of sums per source, so a document's place follows from the tokens
of its source before it (in a seeded order), which takes prefix sums only. The stream is cut into shards of about
SHARD_TOKENS tokens, each packed by one task.

In a shard every source has a queue, and a deficit round-robin fills window by window: each round adds to every source's
deficit its target share of a container's tokens, and a source gives whole documents while its deficit covers them. What
is left of a deficit is carried to the next window. Deficits are carried over shards, too: a shard begins with what each
source's target is at its place of the stream, less the tokens that the shards before have of it. Such a debt is less
than a document, whatever the number of shards.

The documents of a window go, longest first, into the fullest open container that holds them (best fit decreasing), and
no container reaches over windows: those left emptier than LEAST_FILL give their documents back to the queues, with
their deficits, as long as more documents follow. A document longer than the capacity, and only such a one, is divided:
its full pieces fill containers of their own and the rest is an item like any other.

Defined results
---------------
* Null or empty texts have no tokens and are not placed. Every other row is placed once per capacity, repeated ids too.
* Sources are compared trimmed and in lower case. Documents of sources without a target share form one further queue,
  whose target is its share of all tokens; the other targets are scaled to the rest.
* Null, zero or negative capacities are left out; equal pack names with different capacities are packed one by one.
* A window's share of a source differs from its target by what one document of that source holds, at most.
* The order within a source depends on the rows' places in the input files, not only on ids, so copies of one row spread.
* Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.tables import checkpoint

SHARD_TOKENS = 8_000_000
#: Containers' worth of tokens in a window; a container filled less is given up while documents follow.
WINDOW_CONTAINERS, LEAST_FILL = 64, 0.95
#: Sources with a target share: their stream positions are sent to tasks as a table of at most so many squared rows.
MOST_SOURCES = 256
#: Partitions that shards are spread over.
MOST_TASKS = 20_000
MOST_FIXED_ROWS = 10_000
OTHERS = "(others)"


def fixed_rows(df: DataFrame) -> list:
    """Rows of a table that is small by definition; refused otherwise."""
    rows = df.limit(MOST_FIXED_ROWS + 1).collect()
    if len(rows) > MOST_FIXED_ROWS:
        raise ValueError(f"more than {MOST_FIXED_ROWS} rows in a table that should be fixed")
    return rows


class DeficitQueues:
    """Queues of items, served in rounds; each round adds its share of the quantum to the deficit of every queue that is not empty."""

    def __init__(self, sizes: np.ndarray, queues: np.ndarray, targets: np.ndarray, owed: np.ndarray, quantum: float) -> None:
        self.sizes, self.queues, self.targets, self.quantum = sizes.tolist(), queues.tolist(), targets, max(float(quantum), 1.0)
        # the next item of a queue is its list's last one
        self.waiting = [np.flatnonzero(queues == q)[::-1].tolist() for q in range(len(targets))]
        self.deficit = [float(x) for x in owed]
        self.left = len(sizes)

    def _credit(self) -> list[tuple[int, float]]:
        live = [q for q, w in enumerate(self.waiting) if w]
        total = sum(self.targets[q] for q in live)
        return [(q, self.quantum * (self.targets[q] / total if total > 0 else 1 / len(live))) for q in live]

    def window(self, tokens: int) -> list[int]:
        """Items of the next window, which ends once it holds so many tokens."""
        taken, held, credit = [], 0, self._credit()
        while self.left and held < tokens:
            emptied = False
            for q, more in sorted(credit, key=lambda x: -self.deficit[x[0]]):
                queue, deficit = self.waiting[q], self.deficit[q] + more
                while queue and self.sizes[queue[-1]] <= deficit and held < tokens:
                    item = queue.pop()
                    taken.append(item)
                    deficit -= self.sizes[item]
                    held += self.sizes[item]
                self.deficit[q] = deficit
                emptied |= not queue
            if emptied:
                self.left = sum(map(len, self.waiting))
                credit = self._credit()
        self.left = sum(map(len, self.waiting))
        return taken

    def give_back(self, items: list[int]) -> None:
        """Puts items of the last window first in their queues again and takes them off their sources' account."""
        for item in reversed(items):
            q = self.queues[item]
            self.waiting[q].append(item)
            self.deficit[q] += self.sizes[item]
        self.left += len(items)


def deficit_windows(sizes: np.ndarray, queues: np.ndarray, targets: np.ndarray, owed: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Order in which items leave their queues, and the window of each (by item).

    sizes: tokens; queues: index of each item's queue; targets: share of each queue; owed: deficits to begin with.
    """
    served = DeficitQueues(sizes, queues, targets, owed, window / WINDOW_CONTAINERS)
    order, of, w = [], np.zeros(len(sizes), np.int64), 0
    while served.left:
        taken = served.window(window)
        of[taken] = w
        order += taken
        w += 1
    return np.array(order, np.int64), of


def best_fit(items: list[tuple[int, int]], capacity: int, room: list[tuple[int, int]], fresh: int) -> tuple[dict[int, int], int]:
    """Containers of (size, item) by best fit decreasing; room holds (free tokens, container) sorted and is kept."""
    placed = {}
    for size, item in sorted(items, key=lambda x: (-x[0], x[1])):
        i = bisect_left(room, (size, -1))
        if i < len(room):
            free, box = room.pop(i)
        else:
            free, box, fresh = capacity, fresh, fresh + 1
        placed[item] = box
        if free > size:
            insort(room, (free - size, box))
    return placed, fresh


def pack_shard(sizes: np.ndarray, queues: np.ndarray, targets: np.ndarray, owed: np.ndarray, capacity: int) -> pd.DataFrame:
    """Placement of one shard's items: item, piece_no, token_start, token_count, window_no, box."""
    served = DeficitQueues(sizes, queues, targets, owed, capacity)
    full, rest = sizes // capacity, sizes % capacity
    n_full, n_rest = full.tolist(), rest.tolist()
    boxes, of, first_full = (np.full(len(sizes), -1, np.int64) for _ in range(3))
    fresh, w = 0, 0
    while served.left:
        items = served.window(WINDOW_CONTAINERS * capacity)
        placed, opened = best_fit([(n_rest[i], i) for i in items if n_rest[i]], capacity, [], 0)
        held: list[list[int]] = [[] for _ in range(opened)]
        for i, box in placed.items():
            held[box].append(i)
        loose = [x for x in held if sum(n_rest[i] for i in x) < LEAST_FILL * capacity and not any(n_full[i] for i in x)] if served.left else []
        back = {i for x in loose for i in x}
        if len(back) == len(items):  # a window keeps something, whatever it looks like
            loose, back = [], set()
        if back:
            served.give_back([i for i in items if i in back])
            items = [i for i in items if i not in back]
        for x in held:
            if x and x[0] not in back:
                boxes[x] = fresh
                fresh += 1
        for i in items:
            if n_full[i]:
                first_full[i], fresh = fresh, fresh + n_full[i]
        of[items] = w
        w += 1
    pieces = full + (rest > 0)
    item = np.repeat(np.arange(len(sizes)), pieces)
    piece = np.arange(len(item)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    is_full = piece < full[item]
    return pd.DataFrame({
        "item": item, "piece_no": piece, "token_start": piece * capacity, "token_count": np.where(is_full, capacity, rest[item]),
        "window_no": of[item], "box": np.where(is_full, first_full[item] + piece, boxes[item]),
    })


def stream_phases(tokens: np.ndarray, targets: np.ndarray) -> list[tuple[float, float, np.ndarray, np.ndarray]]:
    """Parts of the stream between two sources' ends: where it begins, its length, the shares in it and each source's tokens before it."""
    left, at, before, out = tokens.astype(float), 0.0, np.zeros(len(tokens)), []
    while (live := left > 0).any():
        share = np.where(live, targets, 0.0)
        share = share / share.sum() if share.sum() > 0 else live / live.sum()
        # a live source without a share of its own waits for the end
        ends = np.where(share > 0, left / np.where(share > 0, share, 1.0), np.inf)
        length = ends.min()
        out.append((at, float(length), share, before.copy()))
        at, before = at + length, before + share * length
        left = np.where(ends <= length * (1 + 1e-12), 0.0, np.maximum(left - share * length, 0.0))
    return out


PLACEMENT = "pack_name string, capacity_tokens bigint, container_id bigint, doc_id bigint, source string, piece_no bigint, token_start bigint, token_count bigint, shard bigint, window_no bigint"


def target_shares(targets: DataFrame) -> dict[str, float]:
    """Share of each source that has one; they are few by definition and refused beyond MOST_SOURCES."""
    shares = {r[0]: float(r[1]) for r in fixed_rows(targets.groupBy(F.lower(F.trim("doc_source"))).agg(F.sum("target_share"))) if r[0] and r[1] and r[1] > 0}
    if len(shares) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources with a target share")
    return shares


def _in_stream(sizes: DataFrame, tokens: np.ndarray, phases: list, bucket_tokens: int) -> DataFrame:
    """Adds before (tokens of the same source before each row) and position (in the stream) to rows with q and n_tokens."""
    spark = sizes.sparkSession
    many = F.create_map(*(F.lit(x) for q, n in enumerate(tokens) for x in (q, max(1, -(-int(n) // bucket_tokens)))))
    # places in the checkpointed table are the same in every attempt
    rows = sizes.withColumn("h", F.xxhash64("doc_id", "n_tokens", F.monotonically_increasing_id()))
    rows = rows.withColumn("bucket", F.pmod(F.col("h"), many[F.col("q")]))
    sums = rows.groupBy("q", "bucket").agg(F.sum("n_tokens").alias("t")).withColumn("run", F.floor(F.col("bucket") / 4096))
    # buckets are summed up in two steps, runs of buckets first, so that no task gets all of them
    earlier = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    runs = sums.groupBy("q", "run").agg(F.sum("t").alias("t")).select("q", "run", F.coalesce(F.sum("t").over(earlier(["q"], "run")), zero).alias("r"))
    starts = sums.join(runs, ["q", "run"]).select("q", "bucket", (F.coalesce(F.sum("t").over(earlier(["q", "run"], "bucket")), zero) + F.col("r")).alias("start"))
    rows = rows.join(starts, ["q", "bucket"])
    within = Window.partitionBy("q", "bucket").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("start") + F.coalesce(F.sum("n_tokens").over(within), zero))
    parts = []
    for q in range(len(tokens)):
        mine = [(at, y[q], y[q] + share[q] * length, share[q]) for at, length, share, y in phases if share[q] > 0]
        for i, (at, low, high, rate) in enumerate(mine):
            parts.append((q, 0.0 if i == 0 else float(low), float(high) if i + 1 < len(mine) else float("inf"), float(at), float(rate)))
    parts = F.broadcast(spark.createDataFrame(parts, "part_q int, low double, high double, at double, rate double"))  # MOST_SOURCES squared at most
    rows = rows.join(parts, (F.col("q") == F.col("part_q")) & (F.col("before") >= F.col("low")) & (F.col("before") < F.col("high")))
    return rows.withColumn("position", F.col("at") + (F.col("before") - F.col("low")) / F.col("rate"))


def pack(sizes: DataFrame, specs: DataFrame, targets: DataFrame, *, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Places all documents into containers of each capacity; sizes: doc_id, source, n_tokens.

    container_id is unique within a pack_name; its upper bits are the shard.
    """
    packs = sorted({(r[0], int(r[1])) for r in fixed_rows(specs.select("pack_name", "capacity_tokens")) if r[1] and r[1] > 0}, key=lambda x: (x[1], str(x[0])))
    shares = target_shares(targets)
    names = sorted(shares)
    queue_names = [*names, OTHERS]
    number = F.create_map(*(F.lit(x) for i, n in enumerate(queue_names) for x in (n, i)))
    queue = F.when(F.col("source").isin(names), F.col("source")).otherwise(OTHERS)
    sizes = checkpoint(sizes.filter("n_tokens > 0").select("doc_id", "source", "n_tokens", number[queue].alias("q")))  # texts are read once
    totals = {r[0]: int(r[1]) for r in sizes.groupBy("q").agg(F.sum("n_tokens")).collect()}  # one row a target source
    tokens = np.array([totals.get(i, 0) for i in range(len(queue_names))])
    everything = int(tokens.sum())
    if not packs or not everything:
        return sizes.sparkSession.createDataFrame([], PLACEMENT)
    others = tokens[-1] / everything
    scale = (1 - others) / sum(shares.values()) if shares else 0.0
    target = np.array([shares[n] * scale for n in names] + [others])
    phases = stream_phases(tokens, target)
    shards = max(1, -(-everything // shard_tokens))
    length = everything / shards
    at = np.array([p[0] for p in phases] + [float(everything)])
    wanted = np.stack([p[3] for p in phases] + [tokens.astype(float)])
    rows = _in_stream(sizes, tokens, phases, shard_tokens)
    rows = rows.withColumn("shard", F.least(F.floor(F.col("position") / length), F.lit(shards - 1)))

    def run(key, docs: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        docs = docs.sort_values(["q", "before"], kind="stable")
        ids, n, q, source = (docs[c].to_numpy() for c in ("doc_id", "n_tokens", "q", "source"))
        # what the target is here, less what the shards before have
        owed = np.zeros(len(target))
        for k, had in docs.groupby("q")["before"].min().items():
            owed[k] = np.interp(shard * length, at, wanted[:, k]) - had
        out = []
        for name, capacity in packs:
            got = pack_shard(n, q, target, owed, capacity)
            i = got["item"].to_numpy()
            out.append(pd.DataFrame({
                "pack_name": name, "capacity_tokens": capacity, "container_id": (shard << 32) + got["box"], "doc_id": ids[i], "source": source[i],
                "piece_no": got["piece_no"], "token_start": got["token_start"], "token_count": got["token_count"], "shard": shard, "window_no": got["window_no"],
            }))
        return pd.concat(out)

    # ids go through as text, which keeps them whole if some are null
    rows = rows.select("shard", F.col("doc_id").cast("string").alias("doc_id"), "source", "n_tokens", "q", "before")
    # rows are thin and shards take time: partitions are made by shards, not by bytes
    rows = rows.repartition(min(shards, MOST_TASKS), "shard")
    placed = rows.groupBy("shard").applyInPandas(run, PLACEMENT.replace("doc_id bigint", "doc_id string"))
    return placed.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def window_report(placed: DataFrame, targets: DataFrame) -> DataFrame:
    """Tokens, share and target of each source in each window, and its debt at the window's end.

    In the window in which a source runs out its target is the share it still had, and the others' targets are scaled to
    the rest; afterwards it has no row. The debt is what the targets of the shard's windows so far add up to, less the
    tokens had.
    """
    shares = target_shares(targets)
    names = sorted(shares)
    key = ["pack_name", "capacity_tokens", "shard", "window_no"]
    queue = F.when(F.col("source").isin(names), F.col("source")).otherwise(OTHERS).alias("source")
    held = placed.groupBy(*key, queue).agg(F.sum("token_count").alias("tokens"))
    others = placed.groupBy("pack_name", "capacity_tokens").agg((F.sum(F.when(~F.col("source").isin(names), F.col("token_count")).otherwise(0)) / F.sum("token_count")).alias("others"))
    size = held.groupBy(*key).agg(F.sum("tokens").alias("window_tokens"))
    last = held.groupBy("pack_name", "capacity_tokens", "shard", "source").agg(F.max("window_no").alias("last"))
    total = sum(shares.values()) or 1.0
    raw = F.create_map(*(F.lit(x) for n in names for x in (n, shares[n] / total)))[F.col("source")] * (1 - F.col("others")) if names else F.lit(None)
    live = size.join(last, ["pack_name", "capacity_tokens", "shard"]).filter("window_no <= last").join(others, ["pack_name", "capacity_tokens"])
    rows = live.join(held, [*key, "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    rows = rows.withColumns({"raw": F.coalesce(raw, F.col("others")), "share": F.col("tokens") / F.col("window_tokens"), "runs_out": F.col("window_no") == F.col("last")})
    window, goes_on = Window.partitionBy(*key), lambda c: F.when(~F.col("runs_out"), F.col(c))
    rest = F.lit(1.0) - F.coalesce(F.sum(F.when(F.col("runs_out"), F.col("share"))).over(window), F.lit(0.0))
    rows = rows.withColumn("target_share", F.when(F.col("runs_out"), F.col("share")).otherwise(rest * F.col("raw") / F.sum(goes_on("raw")).over(window)))
    so_far = Window.partitionBy("pack_name", "capacity_tokens", "shard", "source").orderBy("window_no")
    debt = F.sum(F.col("target_share") * F.col("window_tokens") - F.col("tokens")).over(so_far)
    return rows.select(*key, "source", "tokens", "share", "target_share", debt.alias("debt"), "runs_out")


def container_fill(placed: DataFrame) -> DataFrame:
    """Fill of each container."""
    fill = placed.groupBy("pack_name", "capacity_tokens", "container_id").agg(F.count(F.lit(1)).alias("items"), F.sum("token_count").alias("tokens"))
    return fill.select("*", (F.col("capacity_tokens") - F.col("tokens")).alias("unused_tokens"), F.round(F.col("tokens") / F.col("capacity_tokens"), 6).alias("fill"))


def pack_report(placed: DataFrame) -> DataFrame:
    """Containers, tokens and overall fill of each capacity."""
    boxes = container_fill(placed).groupBy("pack_name", "capacity_tokens")
    return boxes.agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.sum("unused_tokens").alias("unused_tokens")).withColumn(
        "fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6)
    )
