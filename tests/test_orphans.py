from datetime import datetime as dt

from meshwright.operators.orphans import Parents, References, find_orphans, orphan_references, orphan_report

SITES = "plan_id string, site_name string, recorded_at timestamp, deleted_at timestamp, row_id int, key string, n int"
LINKS = "link_row bigint, plan_id string, tx_site string, rx_site string, planned_at timestamp, scope string, at string"
DAY = [dt(2024, 1, d) for d in range(1, 29)]
ARGS = dict(row_id="link_row", refs={"tx": "tx_site", "rx": "rx_site"}, child_scope="plan_id", at="planned_at", parent_scope="plan_id", parent_name="site_name", start="recorded_at", end="deleted_at", parent_table="sites")


def _find(spark, links, sites, **more):
    out = orphan_references(spark.createDataFrame(links, LINKS), spark.createDataFrame(sites, SITES), **ARGS, **more)
    return sorted((r.row_id, r.side, r.seen_before) for r in out.collect())


def _link(i, tx, rx, at=DAY[10], plan="p"):
    return (i, plan, tx, rx, at, "clash", "clash")


def _site(name, start=DAY[0], end=None, plan="p"):
    return (plan, name, start, end, 7, "clash", 1)


def test_states_and_names(spark):
    sites = [_site(" A "), _site("b", DAY[0], DAY[5]), _site("B", DAY[8], DAY[20]), _site("late", DAY[15]), _site("x", plan="q"), _site(None), ("p", "dead", DAY[3], DAY[3], 1, "", 1)]
    links = [
        _link(1, "a", "B"), _link(2, "b ", "late"), _link(3, "x", ""), _link(4, None, "a"), _link(5, "b", "b", DAY[6]), _link(5, "b", "b", DAY[6]),
        _link(6, "b", "a", DAY[20]), _link(7, "b", "a", DAY[8]), _link(8, "dead", "a"), _link(9, "a", "a", None), _link(10, "a", "a", DAY[9], None), _link(11, "a", "a", DAY[0]),
    ]
    assert _find(spark, links, sites) == [
        (2, "rx", False), (3, "tx", False), (5, "rx", True), (5, "rx", True), (5, "tx", True), (5, "tx", True), (6, "tx", True), (8, "tx", False),
        (9, "rx", False), (9, "tx", False), (10, "rx", False), (10, "tx", False),
    ]


def test_hot_keys_are_cut_into_days_with_the_same_result(spark):
    sites = [_site("hub", DAY[i], DAY[i + 2] if i % 2 else None) for i in (3, 9, 15, 21)] + [_site("hub2", DAY[2], DAY[6])] * 3
    links = [_link(i, "hub", "hub2", DAY[i % 28]) for i in range(200)] + [_link(900, "other", "hub", DAY[1])]
    assert _find(spark, links, sites, hot_rows=20) == _find(spark, links, sites)


def test_one_moment_is_salted_with_the_same_result(spark):
    sites = [_site("hub", DAY[9], DAY[10]), _site("hub", DAY[10], DAY[12]), _site("hub2", DAY[11])] + [_site("hub2", DAY[10], DAY[11])] * 30
    links = [_link(i, "hub", "hub2", DAY[10]) for i in range(300)] + [_link(300 + i, "hub", "hub2", DAY[i % 28]) for i in range(60)] + [_link(i, "hub", None, None) for i in range(40)]
    assert _find(spark, links, sites, hot_rows=10) == _find(spark, links, sites)


def test_several_tables_at_once(spark):
    sites, links = spark.createDataFrame([_site("a"), _site("b", DAY[20])], SITES), spark.createDataFrame([_link(1, "a", "b"), _link(2, "c", "a")], LINKS)
    kinds = spark.createDataFrame([("p", "a", DAY[15], None)], "area string, kind string, since timestamp, until timestamp")
    notes = spark.createDataFrame([("n1", "p", "a", DAY[10]), ("n2", "p", "a", DAY[16])], "note string, area string, about string, made timestamp")
    children = [References(links, "link_row", {"tx": "tx_site", "rx": "rx_site"}, "plan_id", "planned_at", "sites", "links"), References(notes, "note", {"about": "about"}, "area", "made", "kinds", "notes"), References(notes, "note", {"site": "about"}, "area", "made", "sites", "notes")]
    parents = [Parents(sites, "sites", "plan_id", "site_name", "recorded_at", "deleted_at"), Parents(kinds, "kinds", "area", "kind", "since", "until")]
    got = sorted((r.child_table, r.row_id, r.side, r.parent_table) for r in find_orphans(children, parents).collect())
    assert got == [("links", "1", "rx", "sites"), ("links", "2", "tx", "sites"), ("notes", "n1", "about", "kinds")]


def test_empty_tables(spark):
    assert _find(spark, [], [_site("a")]) == []
    assert _find(spark, [_link(1, "a", None)], []) == [(1, "tx", False)]


def test_report(spark):
    sites = [_site("gone", DAY[0], DAY[1]), _site("late", DAY[20])]
    links = [_link(1, "gone", "late"), _link(2, "gone", "none"), _link(3, "none", "late", None)]
    parent = spark.createDataFrame(sites, SITES)
    out = orphan_references(spark.createDataFrame(links, LINKS), parent, **ARGS)
    got = {(r.side, r.period, r.cause): (r.orphan_refs, r.missing_keys) for r in orphan_report(out, parent, parent_scope="plan_id", parent_name="site_name").collect()}
    assert got == {
        ("tx", "2024-01", "deleted"): (2, 1), ("rx", "2024-01", "not_yet_recorded"): (1, 1), ("rx", "2024-01", "unknown"): (1, 1),
        ("tx", None, "unknown"): (1, 1), ("rx", None, "not_yet_recorded"): (1, 1),
    }


def test_random_tables_against_brute_force(spark):
    import random

    rng = random.Random(3)
    names = ["a", " B", "c ", "hub", None, ""]
    sites = []
    for _ in range(60):
        s = rng.choice([None, *DAY])
        sites.append((rng.choice(["p", "q", None]), rng.choice(names), s, rng.choice([None, *DAY]), 1, "", 1))
    links = [_link(i, rng.choice(names), rng.choice([*names, "hub"]), rng.choice([None, *DAY]), rng.choice(["p", "q", None])) for i in range(300)]
    norm = lambda x: (x or "").strip().lower()
    want = []
    for i, plan, tx, rx, at, *_ in links:
        for side, name in (("tx", tx), ("rx", rx)):
            if norm(name) and not any(
                plan and at and p == plan and norm(n) == norm(name) and s and s <= at and (e is None or at < e) for p, n, s, e, *_ in sites
            ):
                want.append((i, side))
    for hot_rows in (10**9, 30):
        assert [x[:2] for x in _find(spark, links, sites, hot_rows=hot_rows)] == sorted(want)
