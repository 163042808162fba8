import pytest
from pyspark.sql import functions as F

from meshwright.functions import geo, rf


def _one(spark, *columns):
    return spark.range(1).select(*columns).collect()[0]


def test_classes(spark):
    snr = {3.0: 3, 4.5: 4, 5.0: 5, 5.5: 6, 18.0: 12, 2.0: 0, 20.0: 12, 5.3: 5, float("nan"): 0}
    assert list(_one(spark, *(rf.mcs_of_snr(F.lit(x)).alias(str(i)) for i, x in enumerate(snr)))) == list(snr.values())
    back = {3: 3.0, 4: 4.5, 12: 18.0, 0: 0.0, 14: 18.0}
    assert list(_one(spark, *(rf.snr_of_mcs(F.lit(x)).alias(str(i)) for i, x in enumerate(back)))) == list(back.values())


def test_budget(spark):
    """40 m: class 10; 60 m: class 9, each with 15 dBi radios at full power."""
    df = spark.createDataFrame([(40.0,), (60.0,)], "m double")
    df = df.withColumn("g", rf.link_net_gain("m", 60_000.0, 15.0, 0.0, 15.0, 0.0, 30.0, 99.9))
    rows = rf.with_link_budget(df, "g", -74.0, 16.0, 0.0).orderBy("m").collect()
    assert [r.mcs for r in rows] == [10, 9] and [r.tx_power for r in rows] == [14.0, 16.0]
    assert rows[0].rsl == pytest.approx(-57.1, abs=0.05) and rows[1].snr_db == pytest.approx(14.9, abs=0.05) and rows[1].gbps == pytest.approx(0.74125)


def test_losses(spark):
    r = _one(spark, rf.rain_loss(1.0, 30.0, 99.9, 60_000.0), rf.oxygen_loss(2.0, 60_500.0), rf.oxygen_loss(1.0, 68_000.0), rf.oxygen_loss(1.0, 70_000.0), rf.fspl(1e-9, 60.0), rf.rain_loss(0.0, 30.0, 99.9, 6e4))
    assert r[0] == pytest.approx(5.8, abs=0.05) and r[1] == pytest.approx(2 * 14.8) and tuple(r[2:]) == (0.0, 0.0, 0.0, 0.0)


def test_angles(spark):
    r = _one(spark, geo.law_of_cosines(F.lit(1.0), F.lit(1.0), F.lit(2.0000001)), geo.law_of_cosines(F.lit(1.0), F.lit(2.0000001), F.lit(1.0)), geo.angle_delta(350.0, 10.0), geo.angle_delta(10.0, 190.0), geo.bearing(0.0, 0.0, 0.0, 1.0), geo.bearing(0.0, 0.0, -1.0, 0.0))
    assert r[0] == pytest.approx(180.0) and r[1] == pytest.approx(0.0, abs=1e-6) and r[2] == -20.0 and r[3] == 180.0 and r[4] == 0.0 and r[5] == pytest.approx(270.0)


def test_utm(spark):
    x, y = geo.to_utm(F.lit(3.0), F.lit(0.0))
    df = spark.createDataFrame([(lon, lat) for lon in (-179.9, -0.1, 3.0, 77.7, 179.99) for lat in (-79.5, -33.3, 0.0, 12.3, 83.9)], "lon double, lat double")
    px, py = geo.to_utm("lon", "lat")
    back = df.withColumns({"x": px, "y": py, "e": geo.utm_epsg("lon", "lat")})
    lon, lat = geo.from_utm("x", "y", "e")
    off = back.select(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat")))).collect()[0]
    assert _one(spark, x, y) == (pytest.approx(500_000.0), pytest.approx(0.0)) and max(off) < 1e-9
    # a degree of longitude at the equator in zone 31, by the published series
    assert _one(spark, geo.to_utm(F.lit(4.0), F.lit(0.0))[0])[0] == pytest.approx(611_280.9, abs=0.5)


@pytest.mark.parametrize(("text", "value"), [("100°20'2.04\"E", 100.3339), ("122.4194° W", -122.4194), ("-3.5", -3.5), ("10 30 S", -10.5), ("5°N", 5.0), ("x", None), (None, None)])
def test_dms(spark, text, value):
    (got,) = _one(spark, geo.dms_to_decimal(F.lit(text).cast("string")))
    assert got is None if value is None else got == pytest.approx(value)


def test_pattern(spark):
    p = F.array(*(F.lit(float(-i)) for i in range(360)))
    r = _one(spark, rf.pattern_gain(30.0, 1.0, p, p, F.lit(-0.4), F.lit(2.5)), rf.pattern_gain(30.0, 1.0, F.lit(None).cast("array<double>"), p, F.lit(5.0), F.lit(5.0)), rf.pattern_index(F.lit(-1.0)))
    assert r[0] == 29.0 and r[1] == 31.0 and r[2] == 359


def test_geohash_and_polygons(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))))
    r = _one(spark, geo.geohash(0.0, 0.0), geo.geohash(180.0, 90.0), geo.geohash(-180.0, -90.0), geo.in_ring(ring, 1.0, 1.0), geo.in_ring(ring, 3.0, 1.0), *geo.ring_centroid(ring))
    assert r[0] == "o000000000" and r[1] == "vvvvvvvvvv" and r[2] == "0000000000" and r[3] is True and r[4] is False and tuple(r[5:]) == (pytest.approx(1.0), pytest.approx(1.0))
