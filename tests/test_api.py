import numpy as np

from meshwright import api
from meshwright.sources.geodata import write_geotiff
from meshwright.sources.kml import kml_links, read_kml


def test_candidates_and_analysis(spark, tmp_path):
    k = 0.0009
    (tmp_path / "s.csv").write_text(f"name,type,lat,lon,alt\ns,POP,0.5,3,20\na,DN,0.5,{3 + k},20\nc,CN,0.5,{3 + 2 * k},\n")
    write_geotiff(str(tmp_path / "z.tif"), np.full((60, 60), 18.0), 499_900.0, 55_800.0, 20.0, 32631)
    (tmp_path / "c.yaml").write_text("los: {maximum_los_distance: 150, los_confidence_threshold: 0.1}\n")
    links = api.generate_candidate_network(spark, str(tmp_path / "s.csv"), str(tmp_path / "out"), config_path=str(tmp_path / "c.yaml"), raster_path=str(tmp_path / "z.tif"))
    assert sorted((r.tx_id, r.rx_id) for r in links.collect()) == [("a", "c"), ("a", "s"), ("s", "a")]
    assert kml_links(read_kml(spark, str(tmp_path / "out" / "network.kml"))).count() == 3
    again = api.load_sites(spark, str(tmp_path / "out" / "network.kml"))
    assert {(r.site_id, r.site_type) for r in again.collect()} == {("s", "POP"), ("a", "DN"), ("c", "CN")}
    (tmp_path / "l.csv").write_text("tx_site,rx_site\ns,a\na,c\n")
    out = api.analyze_network(spark, str(tmp_path / "s.csv"), str(tmp_path / "l.csv"), str(tmp_path / "report")).collect()[0]
    assert out.sites.total == 3 and out.links.total == 3 and (tmp_path / "report" / "metrics.yaml").exists()
