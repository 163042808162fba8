import numpy as np
import pytest

from meshwright.llm.mixing import mix, mix_report, sainte_lague
from meshwright.llm.packing import best_fit, container_fill, deficit_windows, pack, pack_report, stream_phases, window_report
from meshwright.llm.sizes import DEFAULT_TOKENIZER, encoder, token_sizes

SPECS = [("tiny", 100), ("big", 1000), ("none", None), ("zero", 0)]
TARGETS = [("A", 0.5, 1), (" b ", 0.3, 3), ("gone", 0.2, 5), (None, 0.1, 1)]
T = "doc_source string, target_share double, max_repeats bigint"


def _docs(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    source = rng.choice(["a", "b", "c", ""], n, p=[0.6, 0.1, 0.2, 0.1])
    return spark.createDataFrame([(int(i), str(s), int(x)) for i, s, x in zip(range(n), source, rng.integers(1, 400, n), strict=True)], "doc_id bigint, source string, n_tokens bigint")


@pytest.mark.parametrize("shard_tokens", [10**9, 20_000])
def test_pack(spark, shard_tokens):
    docs = _docs(spark)
    out = pack(docs, spark.createDataFrame(SPECS, "pack_name string, capacity_tokens bigint"), spark.createDataFrame(TARGETS, T), shard_tokens=shard_tokens).toPandas()
    size = docs.toPandas().set_index("doc_id").n_tokens
    assert set(out.pack_name) == {"tiny", "big"}
    for name, cap in (("tiny", 100), ("big", 1000)):
        mine = out[out.pack_name == name]
        assert (mine.groupby("doc_id").token_count.sum() == size).all()
        fills = mine.groupby("container_id").token_count.sum()
        assert fills.max() <= cap
        pieces = mine.groupby("doc_id").piece_no.count()
        assert (pieces[size <= cap] == 1).all() and (pieces == -(-size // cap)).all()
        ordered = mine.sort_values(["doc_id", "piece_no"])
        assert (ordered.token_start == ordered.piece_no * cap).all()
        if shard_tokens > 10**6:
            assert fills.sum() / (len(fills) * cap) > 0.97


def test_windows_hold_the_mixture():
    rng = np.random.default_rng(3)
    queues, sizes = rng.integers(0, 3, 6000), rng.integers(1, 60, 6000)
    order, window = deficit_windows(sizes, queues, np.array([0.5, 0.3, 0.2]), np.zeros(3), 5000)
    assert sorted(order) == list(range(6000))
    for w in range(8):
        held = np.bincount(queues[window == w], sizes[window == w], 3)
        assert np.allclose(held / held.sum(), [0.5, 0.3, 0.2], atol=0.02)
    owed, _ = deficit_windows(sizes, queues, np.array([0.5, 0.3, 0.2]), np.array([0, 0, 2000.0]), 5000)
    assert (queues[owed[:10]] == 2).all()  # what is owed from before comes first


def test_stream_phases():
    phases = stream_phases(np.array([100, 600, 300]), np.array([0.5, 0.3, 0.2]))
    assert [p[0] for p in phases] == pytest.approx([0, 200, 850]) and sum(p[1] for p in phases) == pytest.approx(1000)
    assert phases[1][2] == pytest.approx([0, 0.6, 0.4]) and phases[2][3] == pytest.approx([100, 450, 300])


def test_mixture_in_first_and_last_shards(spark, monkeypatch):
    from meshwright.llm import packing

    monkeypatch.setattr(packing, "MOST_TASKS", 8)  # many small shards a task
    docs = spark.range(300_000).selectExpr("id AS doc_id", "CASE WHEN id % 10 < 6 THEN 'a' WHEN id % 10 < 9 THEN 'b' ELSE 'c' END AS source", "1 + id % 7 % 5 AS n_tokens")
    specs, targets = spark.createDataFrame([("p", 10)], "pack_name string, capacity_tokens bigint"), spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 1), ("c", 0.1, 1)], T)
    out = pack(docs, specs, targets, shard_tokens=800).cache()
    assert out.selectExpr("max(shard)").first()[0] > 950 and out.selectExpr("sum(token_count)").first()[0] == docs.selectExpr("sum(n_tokens)").first()[0]
    # a container is in one window
    assert out.groupBy("container_id").agg({"window_no": "max"}).join(out.groupBy("container_id").agg({"window_no": "min"}), "container_id").filter("`max(window_no)` <> `min(window_no)`").isEmpty()
    report = window_report(out, targets).toPandas()
    going = report[~report.runs_out]
    assert set(report.shard) == set(range(report.shard.max() + 1)) and (going[going.shard == 0].shape[0], going[going.shard > 940].shape[0]) > (0, 0)
    assert (going.share - going.target_share).abs().max() < 0.02 and going.debt.abs().max() < 12
    out.unpersist()


def test_best_fit_keeps_open_room():
    room = [(30, 0), (50, 1)]
    placed, fresh = best_fit([(30, 7), (45, 8), (90, 9)], 100, room, 2)
    assert placed == {9: 2, 8: 1, 7: 0} and fresh == 3 and room == [(5, 1), (10, 2)]


def test_pack_edges(spark):
    specs, targets = spark.createDataFrame(SPECS, "pack_name string, capacity_tokens bigint"), spark.createDataFrame(TARGETS, T)
    empty = _docs(spark).limit(0)
    assert pack(empty, specs, targets).count() == 0 and pack(_docs(spark), specs.limit(0), targets).count() == 0
    only = pack(_docs(spark).filter("doc_id < 5"), specs, targets.limit(0))
    assert only.select("doc_id").distinct().count() == 5
    assert pack_report(only).count() == 2 and container_fill(only).filter("fill > 1").count() == 0
    twice = _docs(spark).filter("doc_id < 3")
    assert pack(twice.unionAll(twice), specs, targets).filter("pack_name = 'big'").count() == 6


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a", 30), (2**60 + 1, "a", 20), (None, None, 10)], "doc_id bigint, source string, n_tokens bigint")
    out = pack(docs, spark.createDataFrame(SPECS, "pack_name string, capacity_tokens bigint"), spark.createDataFrame(TARGETS, T)).filter("pack_name = 'big'")
    assert sorted((r.doc_id or 0, r.token_count) for r in out.collect()) == [(0, 10), (0, 30), (2**60 + 1, 20)]
    assert {r.doc_id for r in mix(docs, spark.createDataFrame(TARGETS, T)).collect()} <= {None, 2**60 + 1}


def test_sainte_lague():
    def slow(w, n, caps):
        out = [0] * len(w)
        for _ in range(n):
            q = [(-x / (2 * o + 1), i) for i, (x, o, c) in enumerate(zip(w, out, caps, strict=True)) if x > 0 and o < c]
            if not q:
                break
            out[min(q)[1]] += 1
        return out

    rng = np.random.default_rng(0)
    for _ in range(60):
        k = int(rng.integers(1, 7))
        w, caps, n = rng.integers(0, 50, k), rng.integers(0, 40, k), int(rng.integers(0, 90))
        assert list(sainte_lague(w, n, caps)) == slow(list(w), n, list(caps))
    assert list(sainte_lague([53, 24, 23], 7)) == [3, 2, 2]


@pytest.mark.parametrize("shard_tokens", [10**9, 30_000])
def test_mix(spark, shard_tokens):
    targets = spark.createDataFrame(TARGETS, T)
    docs = _docs(spark, 3000)
    mixed = mix(docs, targets, shard_tokens=shard_tokens)
    got = {r.source: r for r in mix_report(mixed, targets).collect()}
    assert got["a"].reached_share == pytest.approx(0.625, abs=0.01) and got["b"].reached_share == pytest.approx(0.375, abs=0.01)
    assert got["gone"].tokens == 0 and got["a"].most_repeats == 1 and got["b"].most_repeats <= 3
    assert mixed.filter("source not in ('a', 'b')").count() == 0
    small = mix_report(mix(docs, targets, total_tokens=20_000, shard_tokens=shard_tokens), targets).collect()
    assert sum(r.tokens for r in small) == pytest.approx(20_000, rel=0.05)


def test_mix_over_runs_of_shards(spark, monkeypatch):
    from meshwright.llm import mixing

    monkeypatch.setattr(mixing, "RUN_SHARDS", 4)
    targets, docs = spark.createDataFrame(TARGETS, T), _docs(spark, 3000)
    mixed = mix(docs, targets, shard_tokens=20_000)
    assert mixed.selectExpr("max(shard)").first()[0] > 12
    got = {r.source: r for r in mix_report(mixed, targets).collect()}
    assert got["a"].reached_share == pytest.approx(0.625, abs=0.01) and got["b"].reached_share == pytest.approx(0.375, abs=0.01)
    copies = spark.range(600).selectExpr("1L AS doc_id", "IF(id < 500, 'a', 'b') AS source", "100L AS n_tokens")
    assert mix(copies, targets, shard_tokens=10_000).selectExpr("count(DISTINCT shard)").first()[0] > 3


def test_mix_edges(spark):
    targets = spark.createDataFrame(TARGETS, T)
    assert mix(_docs(spark).limit(0), targets).count() == 0 and mix(_docs(spark), targets.limit(0)).count() == 0
    assert mix_report(mix(_docs(spark).limit(0), targets), targets).filter("tokens > 0").count() == 0


def test_sizes(spark):
    docs = spark.createDataFrame([(1, "one two  three", " WOXA "), (2, None, "x"), (3, "", None), (4, "é" * 5000, None)], "doc_id bigint, text string, source string")
    got = {r.doc_id: (r.source, r.n_tokens) for r in token_sizes(docs, DEFAULT_TOKENIZER).collect()}
    assert set(got) == {1, 4} and got[1] == ("woxa", len(encoder(DEFAULT_TOKENIZER).encode_ordinary("one two  three"))) and got[4][0] == ""
