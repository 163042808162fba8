"""Structured Streaming over failure and repair events: windowed counts with late data, and connected time per component."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema: str, *, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, *, window: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Events per window and kind (columns ts, event_type); what comes later than `late` is left out, as the watermark says."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = events.withWatermark("ts", late).groupBy(span.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "events")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of events of one user without a gap."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def down_time(events: DataFrame, *, down: str = "error", up: str = "purchase") -> DataFrame:
    """Seconds each component (user_id) was down between a `down` event and the next `up` event, as they get known: user_id, outages, down_s.

    State is two numbers and a time per component; events of a batch are taken in order of time.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        outages, seconds, since = state.get if state.exists else (0, 0.0, None)
        rows = pd.concat(list(batches))
        for ts, kind in rows.sort_values("ts", kind="stable")[["ts", "event_type"]].itertuples(index=False):
            at = ts.timestamp()
            if kind == down and since is None:
                since = at
            elif kind == up and since is not None:
                outages, seconds, since = outages + 1, seconds + max(0.0, at - since), None
        state.update((outages, seconds, since))
        yield pd.DataFrame({"user_id": [key[0]], "outages": [outages], "down_s": [seconds]})

    wanted = events.filter(F.col("event_type").isin(down, up)).select("user_id", "ts", "event_type")
    return wanted.groupBy("user_id").applyInPandasWithState(
        run, "user_id bigint, outages bigint, down_s double", "outages bigint, seconds double, since double", "update", GroupStateTimeout.NoTimeout
    )


def down_time_batch(events: DataFrame, *, down: str = "error", up: str = "purchase") -> DataFrame:
    """The same over a finished table, by windows: a down event counts if the last event before it was none."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.filter(F.col("event_type").isin(down, up)).withColumn("before", F.lag("event_type").over(order))
    turns = rows.filter(F.col("before").isNull() | (F.col("before") != F.col("event_type")))
    turns = turns.withColumns({"next": F.lead("ts").over(order), "next_type": F.lead("event_type").over(order)})
    spans = turns.filter((F.col("event_type") == down) & (F.col("next_type") == up))
    seconds = F.expr("timestampdiff(MICROSECOND, ts, next)") / F.lit(1e6)
    return spans.groupBy("user_id").agg(F.count(F.lit(1)).alias("outages"), F.round(F.sum(seconds), 3).alias("down_s"))
