"""GeoTIFF rasters and zipped shapefiles as Spark data sources, and their writers; formats are read by the public specifications.

`geotiff` gives a row for each cell with data: file, epsg, ix, iy, x, y, z. A file's rows of blocks are partitions of
their own, so a large raster is read by many tasks. `shapefile` gives a row for each outer ring: feature, ring.
"""

from __future__ import annotations

import glob
import io
import os
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NODATA = -32768.0
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


class Tiff:
    """Metadata of a one-band, north-up GeoTIFF and its blocks (strips or tiles; plain, deflate; no predictor or horizontal)."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, "rb") as f:
            head = f.read(8)
            self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
            if self.order is None or struct.unpack(self.order + "H", head[2:4])[0] != 42:
                raise ValueError(f"{path} is no TIFF")
            f.seek(struct.unpack(self.order + "I", head[4:8])[0])
            tags = {}
            for _ in range(struct.unpack(self.order + "H", f.read(2))[0]):
                tag, kind, n, raw = struct.unpack(self.order + "HHI4s", f.read(12))
                code = _TYPES.get(kind)
                if code is None:
                    continue
                size = struct.calcsize(self.order + code) * n
                if size > 4:
                    back = f.tell()
                    f.seek(struct.unpack(self.order + "I", raw)[0])
                    raw = f.read(size)
                    f.seek(back)
                tags[tag] = raw[:size] if kind == 2 else struct.unpack(self.order + code * n, raw[:size])
        one = lambda t, default=None: tags[t][0] if t in tags else default
        self.width, self.height = one(256), one(257)
        self.bits, self.sample, self.compression, self.predictor = one(258, 8), one(339, 1), one(259, 1), one(317, 1)
        if one(277, 1) != 1 or self.compression not in (1, 8, 32946) or self.predictor not in (1, 2):
            raise ValueError(f"{path}: only one band, plain or deflated, can be read")
        if 322 in tags:
            self.block_w, self.block_h, self.offsets, self.counts = one(322), one(323), tags[324], tags[325]
        else:
            self.block_w, self.block_h, self.offsets, self.counts = self.width, one(278, self.height), tags[273], tags[279]
        scale, tie = tags[33550], tags[33922]
        self.size_x, self.size_y = scale[0], scale[1]
        # the tie point is a corner of a cell unless the raster says points
        keys = tags.get(34735, ())
        entries = {keys[i]: keys[i + 3] for i in range(4, len(keys), 4)}
        half = 0.0 if entries.get(1025) == 2 else 0.5
        self.x0, self.y0 = tie[3] + (half - tie[0]) * self.size_x, tie[4] - (half - tie[1]) * self.size_y
        self.epsg = entries.get(3072) or entries.get(2048)
        text = tags.get(42113, b"")
        self.nodata = float(text.rstrip(b"\0 ")) if text.rstrip(b"\0 ") else NODATA
        self.dtype = np.dtype({(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}[self.sample, self.bits]).newbyteorder(self.order)
        self.across = -(-self.width // self.block_w)

    def block_rows(self) -> int:
        return -(-self.height // self.block_h)

    def blocks(self, row: int) -> Iterator[tuple[int, np.ndarray]]:
        """First column and values of each block in a row of blocks."""
        with open(self.path, "rb") as f:
            for k in range(self.across):
                i = row * self.across + k
                f.seek(self.offsets[i])
                raw = f.read(self.counts[i])
                if self.compression != 1:
                    raw = zlib.decompress(raw)
                rows = self.block_h if self.across * self.block_w > self.width or 0 else min(self.block_h, len(raw) // (self.block_w * self.dtype.itemsize))
                z = np.frombuffer(raw, self.dtype, min(rows, len(raw) // (self.block_w * self.dtype.itemsize)) * self.block_w).reshape(-1, self.block_w)
                if self.predictor == 2:
                    z = np.cumsum(z, axis=1, dtype=self.dtype)
                yield k * self.block_w, z


class _Blocks(InputPartition):
    def __init__(self, path: str, row: int) -> None:
        self.path, self.row = path, row


class _TiffReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_Blocks]:
        paths = sorted(glob.glob(self.path) if not os.path.isdir(self.path) else glob.glob(os.path.join(self.path, "*.tif*")))
        if not paths:
            raise FileNotFoundError(self.path)
        return [_Blocks(p, r) for p in paths for r in range(Tiff(p).block_rows())]

    def read(self, partition: _Blocks) -> Iterator[tuple]:
        t = Tiff(partition.path)
        for column, z in t.blocks(partition.row):
            iy, ix = np.nonzero((z != t.nodata) & ~np.isnan(z.astype("f8")))
            keep = (ix + column < t.width) & (iy + partition.row * t.block_h < t.height)
            for i, j in zip(ix[keep], iy[keep], strict=True):
                c, r = int(i) + column, int(j) + partition.row * t.block_h
                yield os.path.basename(t.path), t.epsg, c, r, t.x0 + c * t.size_x, t.y0 - r * t.size_y, float(z[j, i])


class GeoTiffSource(DataSource):
    """The `geotiff` format."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "file string, epsg int, ix int, iy int, x double, y double, z double"

    def reader(self, schema) -> DataSourceReader:
        return _TiffReader(self.options["path"])


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(GeoTiffSource)
    return spark.read.format("geotiff").load(path)


def raster_problems(path: str, *, least: float = 0.15, most: float = 35.0) -> list[str]:
    """What keeps a raster from being used: no reference system, or cells of unlikely size."""
    t = Tiff(path)
    out = [] if t.epsg else ["no reference system"]
    return out + [f"cell size {s} is not within {least} and {most}" for s in (t.size_x, t.size_y) if not least <= s <= most]


def write_geotiff(path: str, z: np.ndarray, x0: float, y0: float, size: float, epsg: int, nodata: float = NODATA) -> None:
    """A north-up float32 raster in deflated strips; x0, y0 are the centre of the first cell."""
    z = np.where(np.isnan(z), nodata, z).astype("<f4")
    h, w = z.shape
    per = max(1, 65536 // (w * 4))
    strips = [zlib.compress(z[i : i + per].tobytes()) for i in range(0, h, per)]
    keys = (1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg)
    text = f"{nodata:g}".encode() + b"\0"
    entries, extra = [], io.BytesIO()
    start = 8 + 2 + 12 * 15 + 4

    def add(tag: int, code: str, values) -> None:
        kind = {"H": 3, "I": 4, "d": 12, "c": 2}[code]
        raw = values if code == "c" else struct.pack("<" + code * len(values), *values)
        if len(raw) <= 4:
            at = raw.ljust(4, b"\0")
        else:
            at = struct.pack("<I", start + extra.tell())
            extra.write(raw + b"\0" * (len(raw) % 2))
        entries.append(struct.pack("<HHI", tag, kind, len(values)) + at)

    body = start + sum(len(x) + len(x) % 2 for x in (struct.pack("<3d", 0, 0, 0), b"0" * 48, struct.pack("<16H", *keys), text if len(text) > 4 else b"")) + (8 * len(strips) if len(strips) > 1 else 0)
    offsets = [body + sum(map(len, strips[:i])) for i in range(len(strips))]
    for tag, code, values in (
        (256, "I", (w,)), (257, "I", (h,)), (258, "H", (32,)), (259, "H", (8,)), (262, "H", (1,)), (273, "I", offsets), (277, "H", (1,)), (278, "I", (per,)), (279, "I", [len(s) for s in strips]),
        (284, "H", (1,)), (339, "H", (3,)), (33550, "d", (size, size, 0.0)), (33922, "d", (0.0, 0.0, 0.0, x0 - size / 2, y0 + size / 2, 0.0)), (34735, "H", keys), (42113, "c", text),
    ):
        add(tag, code, values)
    with open(path, "wb") as f:
        f.write(b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + b"".join(entries) + struct.pack("<I", 0) + extra.getvalue())
        f.write(b"\0" * (body - f.tell()) + b"".join(strips))


# --- shapefiles ---------------------------------------------------------------------------------------------------------
def zip_problems(names: list[str]) -> list[str]:
    """What is wrong with a zipped shapefile's layout."""
    out = [f"{n} is not at the top level" for n in names if "/" in n.rstrip("/")]
    shapes = [n for n in names if n.lower().endswith(".shp")]
    return out + ([] if len(shapes) == 1 else [f"{len(shapes)} .shp files instead of one"])


def _parts(raw: bytes) -> Iterator[tuple[int, list[list[tuple[float, float]]]]]:
    at, n = 100, 0
    while at + 8 <= len(raw):
        length = struct.unpack(">I", raw[at + 4 : at + 8])[0] * 2
        body = raw[at + 8 : at + 8 + length]
        at += 8 + length
        n += 1
        kind = struct.unpack("<i", body[:4])[0]
        if kind not in (5, 15, 25):
            continue
        parts, points = struct.unpack("<ii", body[36:44])
        starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
        xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
        yield n - 1, [[(xy[2 * i], xy[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]


def _turn(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


class _ZipFile(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _ShapeReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_ZipFile]:
        paths = sorted(glob.glob(self.path))
        if not paths:
            raise FileNotFoundError(self.path)
        return [_ZipFile(p) for p in paths]

    def read(self, partition: _ZipFile) -> Iterator[tuple]:
        with zipfile.ZipFile(partition.path) as z:
            if problems := zip_problems(z.namelist()):
                raise ValueError("; ".join(problems))
            raw = z.read(next(n for n in z.namelist() if n.lower().endswith(".shp")))
            prj = next((z.read(n).decode(errors="replace") for n in z.namelist() if n.lower().endswith(".prj")), None)
        for feature, rings in _parts(raw):
            # outer rings run clockwise
            for ring in rings:
                if _turn(ring) < 0:
                    yield feature, prj, ring


class ShapefileSource(DataSource):
    """The `shapefile` format: zip files with one shapefile of polygons each."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return "feature int, crs string, ring array<struct<lon double, lat double>>"

    def reader(self, schema) -> DataSourceReader:
        return _ShapeReader(self.options["path"])


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ShapefileSource)
    return spark.read.format("shapefile").load(path)


def write_shapefile(path: str, rings: DataFrame, crs: str) -> None:
    """One zip file with the rings (column ring) as polygons; rows stream through the driver."""
    shp, shx, dbf, n = io.BytesIO(), io.BytesIO(), io.BytesIO(), 0
    box = [np.inf, np.inf, -np.inf, -np.inf]
    at = 50
    for row in rings.select("ring").toLocalIterator():
        ring = [(p["lon"], p["lat"]) for p in row["ring"]]
        if ring[0] != ring[-1]:
            ring.append(ring[0])
        if _turn(ring) > 0:
            ring.reverse()
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        own = (min(xs), min(ys), max(xs), max(ys))
        box = [*map(min, box[:2], own[:2]), *map(max, box[2:], own[2:])]
        body = struct.pack("<i4d3i", 5, *own, 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)
        n += 1
        shp.write(struct.pack(">2I", n, len(body) // 2) + body)
        shx.write(struct.pack(">2I", at, len(body) // 2))
        dbf.write(b" " + str(n).rjust(10).encode())
        at += 4 + len(body) // 2
    head = lambda length: struct.pack(">7I", 9994, 0, 0, 0, 0, 0, length) + struct.pack("<2i8d", 1000, 5, *(box if n else [0.0] * 4), 0, 0, 0, 0)
    field = b"ID".ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([10, 0]) + b"\0" * 14
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("shapes.shp", head(at) + shp.getvalue())
        z.writestr("shapes.shx", head(50 + 4 * n) + shx.getvalue())
        z.writestr("shapes.dbf", struct.pack("<4BIHH20x", 3, 124, 1, 1, n, 65, 11) + field + b"\r" + dbf.getvalue() + b"\x1a")
        z.writestr("shapes.prj", crs)
