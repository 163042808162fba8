import pytest

from meshwright.operators.linegrammar import header_fields, parse_line, parse_lines, parse_text, read_text

LATLON = header_fields("latlon", "\ufeff base_lon , BASE_LAT,power,light,height,feet,type,remarks\r")
MCS = header_fields("mcs", "snr_b, mcs_b,mbps_b,tx_backoff_b")


def reason(columns, line, kind="latlon"):
    return parse_line(kind, columns, line)[1]


def test_headers():
    assert LATLON == ["base_lon", "base_lat", "power", "light", "height", "feet", "type", "remarks"]
    assert MCS == ["snr", "mcs", "mbps", "tx_backoff"]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("1.5,2,TRUE,false,,,DN,", None),
        (" 1.5 E , 2°30'7.5\"S ,true,FALSE, 3 ,4,pop rooftop,\"a, \"\"b\"\"\"\r", None),
        ('"1°2\'3""W",2,TRUE,TRUE,1,1,"cn ",x "y" z', None),
        ("1,2,TRUE,TRUE,1,1,DN,\"two\nlines\"", None),
        ('1,2,TRUE,TRUE,1,1,DN,"open', "unclosed_quote"),
        ('1,2,TRUE,TRUE,1,1,"DN "B" side",x', "text_after_quote"),
        ("1,2,TRUE,TRUE,1,1,DN", "field_count"),
        ("1,2,TRUE,TRUE,1,1,DN,a,b", "field_count"),
        (None, "field_count"),
        ("181,2,TRUE,TRUE,1,1,DN,", "bad_base_lon"),
        ("1 e,2,TRUE,TRUE,1,1,DN,", "bad_base_lon"),
        ("1 N,2,TRUE,TRUE,1,1,DN,", "bad_base_lon"),
        ("-1 E,2,TRUE,TRUE,1,1,DN,", "bad_base_lon"),
        ("1°60'1\"E,2,TRUE,TRUE,1,1,DN,", "bad_base_lon"),
        ("1,2,yes,TRUE,1,1,DN,", "bad_power"),
        ("1,2,TRUE,TRUE,-1,1,DN,", "bad_height"),
        ("1,2,TRUE,TRUE,nan,1,DN,", "bad_height"),
        ("1,2,TRUE,TRUE,1,1,DNX,", "bad_type"),
        ("1,2,TRUE,TRUE,1,1,,", "bad_type"),
    ],
)
def test_latlon(line, want):
    assert reason(LATLON, line) == want


@pytest.mark.parametrize(("line", "want"), [("+1e1, 15 ,3.,0", None), ("1,16,3,0", "bad_mcs"), ("1,7.5,3,0", "bad_mcs"), ("Infinity,1,3,0", "bad_snr"), ("1,1,-3,0", "bad_mbps"), ("1,1,3,0x1F", "bad_tx_backoff"), ("1,1,3", "field_count")])
def test_mcs(line, want):
    assert reason(MCS, line, "mcs") == want


def test_values_and_places():
    values, error, name, at = parse_line("latlon", LATLON, "1°30'0\"W, 2 ,TRUE,false,,7,dn x,r")
    assert values == {"base_lon": -1.5, "base_lat": 2.0, "power": True, "light": False, "feet": 7.0, "type": "DN", "remarks": "r"} and error is None
    assert parse_line("latlon", LATLON, "1, 2 ,TRUE,maybe,,7,dn,")[1:] == ("bad_light", "light", 12)


def test_recovery_at_validated_anchors():
    text = 'a,b\n"broken, x\nonly one\nc,d\n"q\nr",e\nf,"g" h\ni,j'
    records = list(read_text(text, lambda r: len(r.fields) == 2))
    assert [(r.fields if not r.error else r.error) for r in records] == [["a", "b"], "text_after_quote", ["c", "d"], ["q\nr", "e"], "text_after_quote", ["i", "j"]]
    lines = list(read_text('a,b\nc,"open\nd,e\nf,g', lambda r: len(r.fields) == 2))
    assert [(r.fields if not r.error else r.error) for r in lines] == [["a", "b"], "unclosed_quote", ["d", "e"], ["f", "g"]]


def test_records_behind_an_error_are_typed():
    rows = parse_text("mcs", ["mcs", "snr", "mbps", "tx_backoff"], '3,"broken,1,0\n4,4.5,67.5,0\nx,1\n5,5,115,0\n6,y,1,0')
    assert [(p.reason, p.at, p.values.get("mcs")) for p in rows] == [("unclosed_quote", 3, None), (None, 0, 4), ("field_count", 30, None), (None, 0, 5), ("bad_snr", 44, None)]
    assert [(p.reason, p.at) for p in parse_text("mcs", MCS, "1,2,3,0\n4,5,6,0")] == [(None, 0), ("line_break", 8), (None, 0)]


def test_anchor_search_is_linear():
    import time

    def took(n):
        text = '1,2,3,"' + 'a"b\n"c\n,"",\n' * n
        began = time.process_time()
        assert parse_text("mcs", MCS, text)[0].reason
        return time.process_time() - began

    took(100)
    assert took(40_000) < 12 * took(8_000) + 0.2


def test_table(spark):
    schema = "line_id bigint, file_name string, file_kind string, line_no bigint, raw_line string, header string"
    data = [
        (1, "m", "mcs", 1, "mcs,snr,mbps", "clash"), (2, "m", "mcs", 1, "mcs,snr,mbps", "clash"), (3, "m", "mcs", 2, "1,2,3", ""), (4, "m", "mcs", 2, "1,2,3", ""),
        (5, "m", "mcs", 3, "x,2,3", None), (6, "none", "mcs", 2, "1,2,3", ""), (7, "m", "mcs", 4, None, ""), (8, "m", "mcs", 5, "1," * 50_000, ""), (9, None, None, 2, "1", ""),
    ]
    out = {r.line_id: (r.mcs, r.error_reason) for r in parse_lines(spark.createDataFrame(data, schema)).collect()}
    assert out == {3: (1, None), 4: (1, None), 5: (None, "bad_mcs"), 6: (None, "no_header"), 7: (None, "field_count"), 8: (None, "field_count"), 9: (None, "no_header")}
    assert parse_lines(spark.createDataFrame([], schema)).count() == 0
