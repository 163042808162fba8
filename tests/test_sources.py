import json

import numpy as np
import pytest

from meshwright.sources import config
from meshwright.sources.geodata import Tiff, raster_problems, read_geotiff, read_shapefile, write_geotiff, write_shapefile, zip_problems
from meshwright.sources.kml import kml_demands, kml_links, kml_polygons, kml_sites, read_kml, write_kml
from meshwright.sources.sinks import write_csv, write_metrics
from meshwright.sources.tables import InputError, read_antenna_pattern, read_links, read_mcs, read_network, read_scan_pattern, read_sites, repeated_links


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    return write


def test_sites(spark, put):
    path = put("s.csv", "\ufeffbase_lon, BASE_LAT ,Type_Site,SITE name,ALT,junk,demand_sites\n\"100°20'2.04\"\"E\",10.5 S,dn rooftop,Ä,5,x,\n1,2,,b,,,3\n,2,cn,c,,,\n")
    rows = sorted(read_sites(spark, path).collect(), key=lambda r: r.name)
    assert [(r.name, r.site_type, round(r.longitude, 5), r.latitude, r.altitude, r.subscribers) for r in rows] == [("b", "POP", 1.0, 2.0, None, 3), ("Ä", "DN", 100.33390, -10.5, 5.0, None)]
    with pytest.raises(InputError, match="both stand for"):
        read_sites(spark, put("t.csv", "lat,latitude,lon\n1,2,3\n"))
    with pytest.raises(InputError, match="none of"):
        read_sites(spark, put("u.csv", "lat,name\n1,2\n"))
    with pytest.raises(Exception, match="unknown site type"):
        read_sites(spark, put("v.csv", "lat,lon,type\n1,2,XX\n")).collect()


def test_links(spark, put):
    pair = read_links(spark, put("a.csv", "sites\nA --> B\nB-->C\n")).collect()
    assert [(r.tx_site, r.rx_site) for r in pair] == [("A", "B"), ("B", "C")]
    both = read_links(spark, put("b.csv", "site1, site2_id\nA,B\n")).collect()
    assert sorted((r.tx_site, r.rx_site) for r in both) == [("A", "B"), ("B", "A")]
    twice = read_links(spark, put("c.csv", "tx_site, RX_SITE\nA,B\nA,B\nB,A\n"))
    assert [(r.tx_site, r.n) for r in repeated_links(twice).collect()] == [("A", 2)]
    sites = put("n.csv", "name,type,lat,lon\nA,POP,1,1\nB,DN,1,2\nC,CN,1,3\n")
    _, links, unknown = read_network(spark, sites, put("d.csv", "tx_site,rx_site\nA,B\nB,C\nC,X\n"))
    assert sorted((r.tx_site, r.rx_site) for r in links.collect()) == [("A", "B"), ("B", "A"), ("B", "C")] and [r.name for r in unknown.collect()] == ["X"]


def test_mcs_and_patterns(spark, put):
    assert read_mcs(spark, put("m.csv", "snr_b,mcs_radio1,mbps (60)\n4.5,4,67.5\n3,3,0\n")) == [(3, 3.0, 0.0, 0.0), (4, 4.5, 67.5, 0.0)]
    for bad in ("mcs,snr\n1,2\n", "mcs,mcs2,snr,mbps\n1,1,1,1\n", "mcs,snr,mbps\n1,5,1\n2,4,2\n"):
        with pytest.raises(InputError):
            read_mcs(spark, put("bad.csv", bad))
    text = "NAME antenna one\nGAIN 1\nHORIZONTAL 360\n" + "".join(f"{i} {i / 10}\n" for i in range(360)) + "VERTICAL 360\n" + "".join(f"{i} 1\n" for i in range(360))
    rows = read_antenna_pattern(spark, put("a.txt", text)).collect()
    assert len(rows) == 720 and {(r.antenna, r.axis) for r in rows} == {("antenna one", "HORIZONTAL"), ("antenna one", "VERTICAL")}
    assert next(r.gain for r in rows if r.axis == "HORIZONTAL" and r.degree == 25) == -2.5
    scan = read_scan_pattern(spark, put("s.csv", "az,-1.5,0\n-3,1,2\n0,3,4\n")).collect()
    assert {(r.az, r.el): r.gain for r in scan} == {(-3.0, -1.5): 1.0, (-3.0, 0.0): 2.0, (0.0, -1.5): 3.0, (0.0, 0.0): 4.0}


def test_kml_round_trip(spark, tmp_path):
    sites = spark.createDataFrame([("a & b", "DN", "PROPOSED", 1.5, 2.5, 7.0, "X1"), ("c", "CN", "CANDIDATE", 1.0, 2.0, None, None)], "name string, site_type string, status string, lat double, lon double, alt double, sku string")
    links = spark.createDataFrame([("l", "PROPOSED", "WIRELESS_BACKHAUL", 2.5, 1.5, 2.0, 1.0, 0.85)], "name string, status string, kind string, tx_lon double, tx_lat double, rx_lon double, rx_lat double, confidence double")
    path = str(tmp_path / "n.kml")
    write_kml(path, sites, links)
    marks = read_kml(spark, path)
    got = {r.name: r for r in kml_sites(marks).collect()}
    assert (got["a & b"].site_type, got["a & b"].status, got["a & b"].latitude, got["a & b"].altitude, got["a & b"].device_sku) == ("DN", "PROPOSED", 1.5, 7.0, "X1")
    assert got["c"].altitude is None and got["c"].site_type == "CN"
    (link,) = kml_links(marks).collect()
    assert (link.tx_lon, link.rx_lat, link.status, link.confidence, link.is_wireless) == (2.5, 1.0, "PROPOSED", 0.85, True)


def test_kml_shapes_and_kmz(spark, tmp_path):
    import zipfile

    text = """<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder><name>Demand sites</name><Placemark><name>d</name><Point><coordinates>3,4,0</coordinates></Point></Placemark></Folder>
    <Placemark><name>p</name><MultiGeometry><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 1,0 1,1 0,0</coordinates></LinearRing></outerBoundaryIs></Polygon>
    <Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 1,1 0,0</coordinates></LinearRing></outerBoundaryIs></Polygon></MultiGeometry></Placemark></Document></kml>"""
    with zipfile.ZipFile(tmp_path / "x.kmz", "w") as z:
        z.writestr("doc.kml", text)
    marks = read_kml(spark, str(tmp_path / "x.kmz"))
    assert [(r.name, r.latitude) for r in kml_demands(marks).collect()] == [("d", 4.0)]
    assert [(r.name, len(r.ring)) for r in kml_polygons(marks).collect()] == [("p", 4)] and kml_sites(marks).count() == 0


def test_geotiff(spark, tmp_path):
    z = np.arange(300 * 70, dtype=float).reshape(300, 70)
    z[5, 6] = np.nan
    path = str(tmp_path / "z.tif")
    write_geotiff(path, z, 500_000.5, 4_000_000.5, 1.0, 32631)
    t = Tiff(path)
    assert (t.width, t.height, t.epsg, t.size_x, t.nodata) == (70, 300, 32631, 1.0, -32768.0) and raster_problems(path) == []
    rows = {(r.ix, r.iy): r for r in read_geotiff(spark, path).collect()}
    assert len(rows) == 300 * 70 - 1 and (6, 5) not in rows
    assert rows[3, 299].z == 299 * 70 + 3 and (rows[3, 299].x, rows[3, 299].y) == (500_003.5, 4_000_000.5 - 299)
    write_geotiff(path, z[:2, :2], 0, 0, 90.0, 32631)
    assert len(raster_problems(path)) == 2 and read_geotiff(spark, path).count() == 4


def test_shapefile(spark, tmp_path):
    rings = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)],), ([(5.0, 5.0), (5.0, 6.0), (6.0, 6.0)],)], "ring array<struct<lon double, lat double>>")
    path = str(tmp_path / "b.zip")
    write_shapefile(path, rings, "GEOGCS")
    got = sorted(read_shapefile(spark, path).collect(), key=lambda r: r.feature)
    assert [r.crs for r in got] == ["GEOGCS"] * 2 and {len(r.ring) for r in got} == {4} and {(p.lon, p.lat) for p in got[1].ring} == {(5.0, 5.0), (5.0, 6.0), (6.0, 6.0)}
    assert zip_problems(["a.shp", "a.dbf"]) == [] and len(zip_problems(["d/a.shp", "b.shp"])) == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, (2.5, "x"))], "n int, inner struct<a:double,b:string>")
    write_metrics(df, str(tmp_path / "m.yaml"))
    assert (tmp_path / "m.yaml").read_text().splitlines()[:2] == ["n: 1", "inner:"]
    write_csv(df.select("n"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).collect()[0].n == "1"


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("Rain_Rate: 20\ndevice_list:\n- device_sku: A\n  device_type: cn\n  number_of_nodes_per_site: 1\nlos: {use_ellipsoidal_los_model: true, maximum_los_distance: null}\n")
    plan = config.load(str(path))
    assert plan.rain_rate == 20.0 and plan.device_list[0].device_type is config.SiteType.CN and plan.los.use_ellipsoidal_los_model and plan.los.maximum_los_distance == 400.0
    again = tmp_path / "c.json"
    again.write_text(json.dumps(config.to_dict(plan)))
    assert config.load(str(again)) == plan
    for bad in ({"rain_rat": 1}, {"device_list": [{"device_type": "XX"}]}, {"rain_rate": "wet"}, {"device_list": [{"device_sku": "a"}, {"device_sku": "A"}]}, {"los": {"los_confidence_threshold": 2}}, {"device_list": [{"number_of_nodes_per_site": 9}]}):
        with pytest.raises(config.ConfigError):
            config.from_dict(config.Plan, bad)


def test_ends_by_name_then_by_place(spark):
    from meshwright.sources.kml import resolve_ends

    m = 9e-6  # about a metre
    sites = spark.createDataFrame([("a", "A", "DN", 3.0, 1.0), ("a2", "A2", "POP", 3.0, 1.0), ("b", "B", "DN", 3.1, 1.0), ("c", "C", "CN", 3.2, 1.0), ("d", "D", "DN", 3.0 + 8 * m, 1.0)], "site_id string, name string, site_type string, lon double, lat double")
    links = spark.createDataFrame([(1, "A", "B", 9.0, 9.0, 9.0, 9.0), (2, None, " ", 3.0 + m, 1.0, 3.2, 1.0), (3, None, "B", 3.05, 1.0, 3.1, 1.0), (4, "C", "B", 0.0, 0.0, 0.0, 0.0)], "link_id int, tx_site string, rx_site string, tx_lon double, tx_lat double, rx_lon double, rx_lat double")
    assert sorted(tuple(r) for r in resolve_ends(links, sites).collect()) == [(1, "a", "b"), (2, "a", "c"), (2, "a2", "c")]
