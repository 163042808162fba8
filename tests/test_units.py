import pytest

from meshwright.operators.units import EDGES, compositions, convert_units, note_units, recorded_elsewise

ROWS = "meas_id bigint, survey_id bigint, height string, feet string, base_lon string, unit string, note string"
NOTES = "survey_id bigint, crew string, unit_note string"


def test_graph():
    c = compositions()
    assert c["yd", "mm"][0] == pytest.approx(914.4) and c["deg360", "deg"] == (1.0, -360.0) and c["deg", "deg360"] == (1.0, 360.0)
    assert c["rad", "gon"][0] == pytest.approx(63.66197723675813)
    with pytest.raises(ValueError, match="inconsistent"):
        compositions([*EDGES, ("yd", "cm", 91.0, 0.0)])
    affine = compositions([("c", "k", 1.0, 273.15), ("c", "f", 1.8, 32.0), ("k", "r", 1.8, 0.0)])
    assert affine["f", "r"] == pytest.approx((1.0, 459.67))


@pytest.mark.parametrize(
    ("note", "want"),
    [
        ("Höhe in m", ("m", None, None)), ("heights in ft; lon in degrees", ("ft", None, "deg")), ("heights are metric (m), not ft / base_lon in gon", ("m", None, "gon")),
        ("all heights: feet, not metres. checked twice", ("ft", None, None)), ("height x 100 (cm not m)", ("cm", None, None)), ("feet of ladders replaced. hauteur: cm", ("cm", None, None)),
        ("height [m], feet column derived", ("m", None, None)), ("feet col. actually metres. longitudes: total arcsec", (None, "m", "arcsec")), ("wrong column: metres were put under feet", (None, "m", None)),
        ("metre reading of power box skipped", (None, None, None)), ("heights by laser. base_lon: radians not degrees", (None, None, "rad")), ("mount height, inches (imperial tape)", ("in", None, None)),
        ("hgt col. [ft]", ("ft", None, None)), ("millimetres for all heights", ("mm", None, None)), ("Höhe in Fuß notiert", ("ft", None, None)),
    ],
)
def test_notes(spark, note, want):
    (r,) = note_units(spark.createDataFrame([(1, "", note), (2, "", None), (None, "", note)], NOTES)).collect()
    assert (r.height, r.feet, r.base_lon) == want


def _convert(spark, rows, notes=()):
    df = spark.createDataFrame([(i, s, h, f, x, "clash", "clash") for i, (s, h, f, x) in enumerate(rows)], ROWS)
    return convert_units(df, spark.createDataFrame(list(notes), NOTES))


@pytest.mark.parametrize(
    ("height", "value", "unit"),
    [("12.5", 12.5, "m"), (" 10,09 m", 10.09, "m"), ("0.02 km", 20.0, "km"), ("369 inches", 9.3726, "in"), ('980"', 24.892, "in"), ("9' 6\"", 2.8956, "ft_in"), ("9 ft 6 in", 2.8956, "ft_in"), ("~9 cm", 0.09, "cm"), ("ca. 10 FT", 3.048, "ft"), ("3 M", 3.0, "m"), ("2 parsec", None, "?"), ("unknown", None, None)],
)
def test_values(spark, height, value, unit):
    (r,) = _convert(spark, [(1, height, None, " ")]).collect()
    assert r.source_unit == unit and (r.value is None if value is None else r.value == pytest.approx(value))


def test_sources_of_units(spark):
    rows = [(1, "1000", "32.8", "10 E"), (1, "10", "32.8", "64800"), (2, "33", "10", "-0.5"), (3, "12", None, "20° 30.0' W"), (4, "120", "10 ft 0 in", "-1234567890"), (3, None, "", None)]
    got = {(r.meas_id, r.field_name): (r.source_unit, r.how, None if r.value is None else round(r.value, 3)) for r in _convert(spark, rows, [(2, "", "feet col. actually metres. base_lon: radians not degrees")]).collect()}
    assert got == {
        (0, "height"): ("cm", "row", 10.0), (0, "feet"): ("ft", "row", 32.8), (0, "base_lon"): ("deg", "value", 10.0), (1, "height"): ("m", "row", 10.0), (1, "feet"): ("ft", "row", 32.8),
        (1, "base_lon"): ("arcsec", "row", 18.0), (2, "height"): ("ft", "row", 10.058), (2, "feet"): ("m", "note", 32.808), (2, "base_lon"): ("rad", "note", -28.648), (3, "height"): ("m", "row", 12.0),
        (3, "base_lon"): ("dms", "value", -20.5), (4, "height"): ("in", "row", 3.048), (4, "feet"): ("ft_in", "value", 10.0), (4, "base_lon"): ("e7deg", "row", -123.457),
    }
    found = sorted((r.meas_id, r.field_name) for r in recorded_elsewise(_convert(spark, rows)).collect())
    assert (0, "base_lon") not in found and (0, "height") in found and (3, "base_lon") in found and (4, "feet") in found


def test_values_that_look_like_others(spark):
    rows = [(1, "1,234.5 mm", "1.234,5", "270"), (1, "12,345,678 mm", "1 234 ft", "-190.5"), (1, "12 fathoms", "3", "-9271298"), (1, "5", None, "700000.5")]
    got = {(r.meas_id, r.field_name): r for r in _convert(spark, rows).collect()}
    value = lambda i, f: round(got[i, f].value, 6)
    assert (value(0, "height"), value(0, "feet"), value(0, "base_lon")) == (1.2345, 1234.5, -90.0)
    assert (value(1, "height"), value(1, "feet"), value(1, "base_lon")) == (12345.678, 1234.0, 169.5)
    assert (got[2, "height"].value, got[2, "height"].source_unit, value(2, "base_lon"), value(3, "base_lon")) == (None, "?", -0.92713, 0.7)
    found = {(r.meas_id, r.field_name) for r in recorded_elsewise(_convert(spark, rows)).collect()}
    assert (2, "height") in found and (0, "base_lon") in found and (1, "feet") not in found


def test_empty(spark):
    assert _convert(spark, []).count() == 0
