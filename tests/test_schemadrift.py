import json

from meshwright.operators.schemadrift import alternatives, consistent_table, schema_changes

FEED = "record_id bigint, feed_id bigint, file_seq bigint, payload string, field string, kind string"
ALIASES = [("name", "site_name"), ("site name", "site_name"), ("lat", "latitude"), ("base_lat", "latitude"), ("alt", "altitude"), ("type", "site_type")]


def _feed(spark, files, feed=1):
    data, n = [], 0
    for seq, records in files:
        for r in records:
            n += 1
            data.append((n, feed, seq, r if isinstance(r, str) or r is None else json.dumps(r), "clash", "clash"))
    return spark.createDataFrame(data, FEED)


def _changes(spark, files):
    out = schema_changes(_feed(spark, files), spark.createDataFrame(ALIASES, "alias_name string, site_field string"))
    return sorted((r.file_seq, r.change_kind, r.field_name) for r in out.collect())


def test_changes(spark):
    files = [
        (1, [{"name": "a", "lat": 1.0, "h": 5, "x": 9}, {"name": "b", "lat": 2.0, "h": 6, "x": None}]),
        (3, [{" NAME ": "a", "base_lat": 1.0, "hh": 5, "y": 2}, {"name": "b", "Base_Lat": 2.0, "hh": 6.0, "y": 3}]),
        (4, [{"name": "a", "base_lat": "1 N", "hh": 5}, {"name": "b", "base_lat": "2 N", "hh": 6, "z": None}]),
        (7, [{"site name": "a", "base_lat": "1 N", "hh": 5, "z": True}]),
    ]
    assert _changes(spark, files) == [
        (3, "added", "y"), (3, "removed", "x"), (3, "renamed", "base_lat"), (3, "renamed", "hh"),
        (4, "added", "z"), (4, "removed", "y"), (4, "retyped", "base_lat"), (7, "renamed", "site name"),
    ]


def test_edges(spark):
    assert _changes(spark, []) == []
    assert _changes(spark, [(1, [None, "not json", "[1]", "{}"]), (2, [{"name": "a", "": 1}]), (2, [{"name": "a", "": 1}])]) == [(2, "added", "name")]
    # unequal at one site; null values don't count; no common site proves nothing
    files = [(1, [{"name": "a", "p": 1}, {"name": "b", "p": 2}]), (2, [{"name": "a", "q": 1}, {"name": "b", "q": 3}]), (3, [{"name": "c", "r": 9}]), (4, [{"name": "c", "s": 9, "t": None}, {"name": "d", "s": 4}])]
    got = _changes(spark, files)
    assert (2, "added", "q") in got and (2, "removed", "p") in got and (3, "added", "r") in got and (4, "renamed", "s") in got and (4, "added", "t") in got


def test_table_and_alternatives(spark):
    files = [(1, [{"name": "a", "lat": 1.5, "type": "DN"}]), (2, [{"name": "a", "y_deg": 1.5, "alt": "12", "note": "x"}]), (3, [{"name": "a", "y_deg": "bad", "alt": 13}])]
    aliases = spark.createDataFrame(ALIASES, "alias_name string, site_field string")
    rows = {r.file_seq: r for r in consistent_table(_feed(spark, files), aliases).collect()}
    assert rows[1].latitude == 1.5 and rows[2].latitude == 1.5 and rows[2].altitude == 12.0 and rows[3].altitude == 13.0 and rows[3].latitude is None
    assert rows[2].altitude_string == "12" and rows[3].latitude_string == "bad" and rows[2].latitude_string is None and rows[3].altitude_string is None
    assert json.loads(rows[2].other_fields) == {"note": "x"}
    got = {(r.field_name, r.kind): (r.first_file, r.last_file) for r in alternatives(_feed(spark, files)).collect()}
    assert got["y_deg", "number"] == (2, 2) and got["y_deg", "string"] == (3, 3) and got["name", "string"] == (1, 3)


def test_records_without_ids(spark):
    feed = spark.createDataFrame([(None, 1, 1, '{"name": "a", "lat": "1 N"}'), (None, 1, 1, '{"name": "a", "lat": "1 N"}'), (None, 1, 1, '{"name": "b"}'), (5, None, 1, '{"name": "c"}')], "record_id bigint, feed_id bigint, file_seq bigint, payload string")
    got = sorted((r.site_name, r.latitude) for r in consistent_table(feed, spark.createDataFrame(ALIASES, "alias_name string, site_field string")).collect())
    assert got == [("a", 1.0), ("b", None)]


def test_meaning_over_many_renames(spark):
    files = [(i, [{"name": "a", n: 1.5}, {"name": "b", n: 2.5}]) for i, n in enumerate(["lat", "u1", "u2", "u3", "u4", "u5", "u6"])]
    rows = consistent_table(_feed(spark, files), spark.createDataFrame(ALIASES, "alias_name string, site_field string")).collect()
    assert {r.latitude for r in rows if r.site_name == "a"} == {1.5} and {r.latitude for r in rows if r.site_name == "b"} == {2.5} and len(rows) == 14


def test_typed_branches(spark):
    files = [(1, [{"name": 7, "lat": True, "alt": [1], "y": None, "Z": 1, "z ": 2}, None, {}])]
    rows = consistent_table(_feed(spark, files), spark.createDataFrame(ALIASES, "alias_name string, site_field string")).orderBy("record_id").collect()
    assert len(rows) == 3 and rows[1].site_name is None and rows[2].other_fields in (None, "{}")
    assert rows[0].site_name_number == 7.0 and rows[0].latitude_boolean is True and rows[0].altitude is None and json.loads(rows[0].other_fields) == {"alt": "[1]", "z": "1.0"}
