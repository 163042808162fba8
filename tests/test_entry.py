"""The registered queries against their SQL on the smallest tables, where these are there."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
SOME = ("p1_found", "p1_orphans_by_month", "p2_found", "p3_found", "p4_found", "p5_found", "rf_link_budget", "join_candidate_links", "rule_angle_pairs", "graph_hops_from_pops", "raster_sample", "los_cylinder", "intf_sinr", "plan_flow_rows")


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 90
    for n in range(1, 6):
        assert f"p{n}_found" in queries


def _plain(value):
    if value is None or value != value:
        return None
    return round(float(value), 6) if isinstance(value, float) else value


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = con.sql(entry.oracle_sql()[name]).to_arrow_table()
    got = entry.queries()[name](spark, str(SF)).toArrow()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    rows = lambda t: sorted((tuple(_plain(r[c]) for c in columns) for r in t.select(columns).to_pylist()), key=str)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_smoke(spark):
    assert len(entry.entry(spark).columns) == 6
