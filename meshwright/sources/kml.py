"""KML and KMZ as a Spark data source, and a writer of KML.

`spark.read.format("kml").load(path)` gives a row for each placemark: its folders, name, geometry and extended data.
One file is one partition; files are parsed as they stream by.
"""

from __future__ import annotations

import glob
import io
import os
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "folders array<string>, name string, geometry string, altitude_mode string, coordinates array<struct<lon double, lat double, alt double>>, data map<string,string>"
STATUSES = ("EXISTING", "PROPOSED", "CANDIDATE", "UNAVAILABLE", "UNREACHABLE")


def _open(path: str):
    if path.lower().endswith(".kmz"):
        with zipfile.ZipFile(path) as z:
            inner = next((n for n in z.namelist() if n.lower().endswith(".kml")), None)
            if inner is None:
                raise ValueError(f"{path} holds no .kml file")
            return io.BytesIO(z.read(inner))
    return open(path, "rb")


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def _coordinates(text: str) -> list[tuple]:
    out = []
    for word in text.split():
        p = [float(x) for x in word.split(",") if x]
        if len(p) >= 2:
            out.append((p[0], p[1], p[2] if len(p) > 2 else None))
    return out


def placemarks(path: str) -> Iterator[tuple]:
    """Rows of a file; a geometry of several polygons gives a row for the outer ring of each."""
    folders: list[list[str | None]] = []
    with _open(path) as f:
        for event, e in ElementTree.iterparse(f, events=("start", "end")):
            tag = _tag(e)
            if tag in ("Folder", "Document"):
                if event == "start":
                    folders.append([None])
                else:
                    folders.pop()
                    e.clear()
            elif event == "end" and tag == "name" and folders and folders[-1][0] is None:
                folders[-1][0] = (e.text or "").strip()
            elif event == "start" and tag == "Placemark":
                folders.append(["placemark"])  # its name is no folder's
            elif event == "end" and tag == "Placemark":
                folders.pop()
                yield from _placemark(e, [x[0] or "" for x in folders])
                e.clear()


def _placemark(e, folders: list[str]) -> Iterator[tuple]:
    name, data = None, {}
    for x in e.iter():
        tag = _tag(x)
        if tag == "name" and name is None:
            name = (x.text or "").strip()
        elif tag == "Data":
            value = next((v.text for v in x if _tag(v) == "value"), None)
            data[(x.get("name") or "").strip().lower()] = (value or "").strip()
        elif tag == "SimpleData":
            data[(x.get("name") or "").strip().lower()] = (x.text or "").strip()
    found = False
    for x in e.iter():
        kind = _tag(x)
        if kind in ("Point", "LineString", "Polygon"):
            mode = next((m.text for m in x if _tag(m) == "altitudeMode"), None)
            text = next((c.text for c in x.iter() if _tag(c) == "coordinates"), None)
            found = True
            yield folders, name, kind, mode, _coordinates(text or ""), data
    if not found:
        yield folders, name, None, None, [], data


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_File]:
        paths = sorted(p for g in glob.glob(self.path) for p in ([g] if os.path.isfile(g) else glob.glob(os.path.join(g, "*.km[lz]"))))
        if not paths:
            raise FileNotFoundError(self.path)
        return [_File(p) for p in paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        yield from placemarks(partition.path)


class KmlSource(DataSource):
    """The `kml` format."""

    @classmethod
    def name(cls) -> str:
        return "kml"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(KmlSource)
    return spark.read.format("kml").load(path)


def _folder_word(words: tuple[str, ...]) -> F.Column:
    """The last folder on the way that names one of the words."""
    hit = F.filter(F.transform(F.reverse("folders"), lambda f: F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(F.upper(f), w))), lambda h: F.size(h) > 0)
    return F.get(F.get(hit, F.lit(0)), F.lit(0))


def kml_sites(placemarks_df: DataFrame) -> DataFrame:
    """Sites: points in folders that name a type; the status comes from a folder, too, CANDIDATE without one."""
    points = placemarks_df.filter("geometry = 'Point' and size(coordinates) > 0 and not exists(folders, f -> lower(f) like '%demand%')")
    value = lambda *names: F.coalesce(*(F.nullif(F.col("data")[n], F.lit("")) for n in names), F.lit(None).cast("string"))
    at = F.col("coordinates")[0]
    mode = F.col("altitude_mode")
    kind = _folder_word(("POP", "DN", "CN"))
    return points.select(
        F.coalesce(value("name", "site name"), F.col("name")).alias("name"), F.coalesce(kind, F.lit("POP")).alias("site_type"), at["lat"].alias("latitude"), at["lon"].alias("longitude"),
        F.when(mode == "absolute", at["alt"]).alias("altitude"), F.when(mode == "relativeToGround", at["alt"]).alias("height"), F.coalesce(_folder_word(STATUSES), F.lit("CANDIDATE")).alias("status"),
        value("device sku", "device_sku", "sku").alias("device_sku"), F.upper(F.coalesce(value("location type"), F.lit("STREET_LEVEL"))).alias("location_type"),
        value("building id", "building_id").try_cast("bigint").alias("building_id"), value("number of subscribers").try_cast("bigint").alias("subscribers"),
    )


def kml_links(placemarks_df: DataFrame) -> DataFrame:
    """Links: lines by their first two corners, with the ends' names where given."""
    lines = placemarks_df.filter("geometry = 'LineString' and size(coordinates) > 1")
    value = lambda *names: F.coalesce(*(F.nullif(F.col("data")[n], F.lit("")) for n in names), F.lit(None).cast("string"))
    a, b = F.col("coordinates")[0], F.col("coordinates")[1]
    wired = F.exists("folders", lambda f: F.contains(F.upper(f), F.lit("ETHERNET")))
    return lines.select(
        value("tx site name", "tx_site", "tx site").alias("tx_site"), value("rx site name", "rx_site", "rx site").alias("rx_site"), a["lon"].alias("tx_lon"), a["lat"].alias("tx_lat"), b["lon"].alias("rx_lon"), b["lat"].alias("rx_lat"),
        (~wired).alias("is_wireless"), F.coalesce(_folder_word(STATUSES), F.lit("CANDIDATE")).alias("status"), value("confidence", "los confidence").try_cast("double").alias("confidence"),
    )


def kml_demands(placemarks_df: DataFrame) -> DataFrame:
    at = F.col("coordinates")[0]
    return placemarks_df.filter("geometry = 'Point' and size(coordinates) > 0 and exists(folders, f -> lower(f) like '%demand%')").select("name", at["lat"].alias("latitude"), at["lon"].alias("longitude"))


def kml_polygons(placemarks_df: DataFrame) -> DataFrame:
    """Rings of at least three corners and their closure, without altitudes."""
    ring = F.transform("coordinates", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    return placemarks_df.filter("geometry = 'Polygon' and size(coordinates) > 3").select("name", ring.alias("ring"))


def _mark(name: str, data: dict, geometry: str) -> str:
    fields = "".join(f'<Data name="{escape(k, {chr(34): "&quot;"})}"><value>{escape("N/A" if v is None else str(v))}</value></Data>' for k, v in data.items())
    return f"<Placemark><name>{escape(name or '')}</name><ExtendedData>{fields}</ExtendedData>{geometry}</Placemark>\n"


def write_kml(path: str, sites: DataFrame, links: DataFrame) -> None:
    """One KML file: folders by status, then by type, sites by name and links by length of use; rows stream through the driver.

    sites: name, site_type, status, lat, lon, alt and any more. links: name, status, kind, tx_lon, tx_lat, rx_lon, rx_lat and any more.
    """
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document>\n')
        for df, kind, own, point in ((sites, "site_type", ("name", "site_type", "status", "lat", "lon", "alt"), True), (links, "kind", ("name", "kind", "status", "tx_lon", "tx_lat", "rx_lon", "rx_lat"), False)):
            status = group = None
            for row in df.orderBy("status", kind, "name").toLocalIterator():
                if (row["status"], row[kind]) != (status, group):
                    if status is not None:
                        f.write("</Folder></Folder>\n")
                    status, group = row["status"], row[kind]
                    f.write(f"<Folder><name>{escape(str(status))}</name><Folder><name>{escape(str(group))}</name>\n")
                data = {k: row[k] for k in df.columns if k not in own}
                if point:
                    mode = "clampToGround" if row["alt"] is None else "absolute"
                    geometry = f"<Point><altitudeMode>{mode}</altitudeMode><coordinates>{row['lon']},{row['lat']},{row['alt'] or 0}</coordinates></Point>"
                else:
                    geometry = f"<LineString><coordinates>{row['tx_lon']},{row['tx_lat']},0 {row['rx_lon']},{row['rx_lat']},0</coordinates></LineString>"
                f.write(_mark(row["name"], data, geometry))
            if status is not None:
                f.write("</Folder></Folder>\n")
        f.write("</Document></kml>\n")


def resolve_ends(links: DataFrame, sites: DataFrame, radius_m: float = 10.0) -> DataFrame:
    """Sites at the ends of links (link_id, tx_site, rx_site, tx_lon, ...): link_id, tx_id, rx_id.

    An end with a name is the site of that name. One without is the nearest site within radius_m, and the others within
    it that stand in the nearest one's geohash cell: co-located sites are all ends. Links from a client are left out.
    sites: site_id, name, site_type, lon, lat.
    """
    from meshwright.functions.geo import geohash
    from meshwright.operators.rangejoin import radius_join

    def end(k: str) -> DataFrame:
        ends = links.select("link_id", F.nullif(F.trim(f"{k}_site"), F.lit("")).alias("end_name"), F.col(f"{k}_lon").alias("l_lon"), F.col(f"{k}_lat").alias("l_lat"))
        named = ends.filter("end_name is not null").join(sites.select(F.col("name").alias("end_name"), "site_id", "site_type"), "end_name").select("link_id", "site_id", "site_type")
        places = sites.select("site_id", "site_type", F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"), geohash("lon", "lat").alias("cell"))
        near = radius_join(ends.filter("end_name is null"), places, radius_m)
        best = near.groupBy("link_id").agg(F.min(F.struct("distance_m", "site_id", "cell")).alias("best")).select("link_id", F.col("best.cell").alias("cell"))
        found = named.unionAll(near.join(best, ["link_id", "cell"]).select("link_id", "site_id", "site_type"))
        return found.select("link_id", F.col("site_id").alias(f"{k}_id"), F.col("site_type").alias(f"{k}_type"))

    both = end("tx").filter("tx_type <> 'CN'").join(end("rx"), "link_id").filter("tx_id <> rx_id")
    return both.select("link_id", "tx_id", "rx_id").distinct()
