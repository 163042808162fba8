from datetime import datetime, timedelta

from meshwright.streaming.failures import down_time, down_time_batch, event_stream, sessions, windowed_counts

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string"
T0 = datetime(2024, 1, 1)


def _events(spark, rows):
    return spark.createDataFrame([(i, T0 + timedelta(minutes=m), u, k) for i, (m, u, k) in enumerate(rows)], SCHEMA)


ROWS = [(0, 1, "error"), (5, 1, "error"), (10, 1, "purchase"), (12, 2, "purchase"), (20, 2, "error"), (70, 1, "error"), (75, 1, "purchase"), (80, 2, "view"), (400, 2, "purchase")]


def _run(spark, tmp_path, name, build, mode):
    folder = tmp_path / "in"
    if not folder.exists():
        for i, part in enumerate((ROWS[:4], ROWS[4:7], ROWS[7:])):
            _events(spark, part).coalesce(1).write.mode("append").parquet(str(folder))
    stream = build(event_stream(spark, str(folder), SCHEMA))
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_down_time(spark, tmp_path):
    last = {}
    for r in _run(spark, tmp_path, "down", down_time, "update"):
        if r.outages >= last.get(r.user_id, (-1, 0))[0]:
            last[r.user_id] = (r.outages, r.down_s)
    batch = {r.user_id: (r.outages, r.down_s) for r in down_time_batch(_events(spark, ROWS)).collect()}
    assert batch == {1: (2, 900.0), 2: (1, 22800.0)} and last == batch


def test_windows_and_sessions(spark, tmp_path):
    batch = sorted((r.window_start, r.event_type, r.events) for r in windowed_counts(_events(spark, ROWS)).collect())
    assert batch[0] == (T0, "error", 3) and len(batch) == 6
    done = {(r.window_start, r.event_type): r.events for r in _run(spark, tmp_path, "counts", windowed_counts, "append")}
    assert done[T0, "error"] == 3  # closed by the watermark
    runs = sorted((r.user_id, r.events) for r in sessions(_events(spark, ROWS)).collect())
    assert runs == [(1, 2), (1, 3), (2, 1), (2, 1), (2, 2)]
