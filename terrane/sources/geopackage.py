"""GeoPackage layers (SQLite files) as a Spark data source, and a writer; GeoJSON lines.

Geometries are read as shapes (rings of x, y): outer rings counter-clockwise and
holes clockwise, those of a multipolygon one after another; a point or a line is
one list of places.
"""

from __future__ import annotations

import json
import sqlite3
import struct
from collections.abc import Iterator, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_ENVELOPES = (0, 32, 48, 48, 64)


Ring = list[tuple[float, float]]


def turned(ring: Sequence[tuple[float, float]], outer: bool) -> Ring:
    """A ring without the repeated first point, counter-clockwise if it is an outer one, else clockwise."""
    open_ = list(ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring)
    twice = sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(open_, open_[1:] + open_[:1], strict=True))
    return open_[::-1] if (twice > 0) != outer else open_


def decode(blob: bytes) -> list[Ring]:
    """The shape of a GeoPackage or plain WKB geometry."""
    at = 8 + _ENVELOPES[(blob[3] >> 1) & 7] if blob[:2] == b"GP" else 0

    def read(at: int) -> tuple[list[Ring], int]:
        order = "<" if blob[at] else ">"
        kind = struct.unpack_from(f"{order}I", blob, at + 1)[0] % 1000
        at += 5
        if kind == 1:
            return [[struct.unpack_from(f"{order}2d", blob, at)]], at + 16
        (count,) = struct.unpack_from(f"{order}I", blob, at)
        at += 4
        if kind == 2:
            flat = struct.unpack_from(f"{order}{2 * count}d", blob, at)
            return [list(zip(flat[::2], flat[1::2], strict=True))], at + 16 * count
        out = []
        for k in range(count):
            if kind == 3:
                (points,) = struct.unpack_from(f"{order}I", blob, at)
                flat = struct.unpack_from(f"{order}{2 * points}d", blob, at + 4)
                at += 4 + 16 * points
                out.append(turned(list(zip(flat[::2], flat[1::2], strict=True)), outer=k == 0))
            else:
                rings, at = read(at)
                out += rings
        return out, at

    return read(at)[0]


def polygons(shape: Sequence[Ring]) -> list[list[Ring]]:
    """The rings of each polygon of a shape: an outer ring and the holes that follow it."""
    out: list[list[Ring]] = []
    for ring in shape:
        if not out or turned(ring, outer=True) == list(ring):
            out.append([ring])
        else:
            out[-1].append(ring)
    return out


def encode(shape: Sequence[Ring] | Ring, srid: int) -> bytes:
    """A point (one place), polygon or multipolygon as a GeoPackage geometry; a single ring may stand for a shape."""
    head = b"GP\x00\x01" + struct.pack("<i", srid)
    rings = [list(shape)] if shape and isinstance(shape[0][0], (int, float)) else [list(r) for r in shape]
    if len(rings) == 1 and len(rings[0]) == 1:
        return head + struct.pack("<BI2d", 1, 1, *rings[0][0])

    def polygon(own: list[Ring]) -> bytes:
        closed = [[*r, r[0]] for r in own]
        return struct.pack("<BII", 1, 3, len(closed)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r) for r in closed)

    parts = polygons([turned(rings[0], outer=True), *rings[1:]])
    if len(parts) == 1:
        return head + polygon(parts[0])
    return head + struct.pack("<BII", 1, 6, len(parts)) + b"".join(map(polygon, parts))


def _layers(path: str) -> dict[str, str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as base:
        return dict(base.execute("select table_name, column_name from gpkg_geometry_columns"))


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.schema = options["path"], schema
        layers = _layers(self.path)
        self.layer = options.get("layer") or next(iter(layers))
        self.geometry = layers[self.layer]

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as base:
            low, high = base.execute(f'select min(rowid), max(rowid) from "{self.layer}"').fetchone()
        if low is None:
            return [InputPartition((0, -1))]
        step = max(10_000, (high - low) // 64 + 1)
        return [InputPartition((a, min(a + step - 1, high))) for a in range(low, high + 1, step)]

    def read(self, partition) -> Iterator[tuple]:
        names = [f.name for f in self.schema if f.name != "rings"]
        listed = "".join(f', "{n}"' for n in names)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as base:
            rows = base.execute(f'select "{self.geometry}"{listed} from "{self.layer}" where rowid between ? and ?', partition.value)
            for geometry, *values in rows:
                rings = None if geometry is None else [[{"x": x, "y": y} for x, y in ring] for ring in decode(geometry)]
                yield (*values, rings)


class GeoPackageSource(DataSource):
    """spark.read.format("geopackage").option("layer", name).load(path): attributes and `rings`."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> str:
        path = self.options["path"]
        layers = _layers(path)
        layer = self.options.get("layer") or next(iter(layers))
        kinds = {"INT": "bigint", "REAL": "double", "DOUB": "double", "FLOA": "double", "BOOL": "bigint", "MEDI": "bigint"}
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as base:
            columns = [(c[1], kinds.get(c[2].upper()[:4], kinds.get(c[2].upper()[:3], "string"))) for c in base.execute(f'pragma table_info("{layer}")') if c[1] != layers[layer]]
        return ", ".join([*(f"`{n}` {k}" for n, k in columns), "rings array<array<struct<x:double,y:double>>>"])

    def reader(self, schema):
        return _Reader(self.options, schema)


def read_layer(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    spark.dataSource.register(GeoPackageSource)
    reader = spark.read.format("geopackage")
    return (reader.option("layer", layer) if layer else reader).load(path)


def write_layer(df: DataFrame, path: str, layer: str, srid: int = 5179, overwrite: bool = True) -> int:
    """A layer of (attributes, ring or rings) into one file, beside layers that it holds already; rows pass one partition at a time, as the format is one file."""
    column = "rings" if "rings" in df.columns else "ring"
    names = [f.name for f in df.schema if f.name != column]
    kinds = {f.name: "INTEGER" if isinstance(f.dataType, (T.LongType, T.IntegerType, T.BooleanType)) else "REAL" if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else "TEXT" for f in df.schema}
    base = sqlite3.connect(path)
    try:
        base.execute("pragma application_id = 1196444487")
        base.execute("create table if not exists gpkg_spatial_ref_sys (srs_name text, srs_id integer primary key, organization text, organization_coordsys_id integer, definition text, description text)")
        base.execute("create table if not exists gpkg_contents (table_name text primary key, data_type text, identifier text, description text, last_change text, min_x real, min_y real, max_x real, max_y real, srs_id integer)")
        base.execute("create table if not exists gpkg_geometry_columns (table_name text primary key, column_name text, geometry_type_name text, srs_id integer, z integer, m integer)")
        base.execute("insert or replace into gpkg_spatial_ref_sys values (?, ?, 'EPSG', ?, 'undefined', null)", (f"EPSG:{srid}", srid, srid))
        if overwrite:
            base.execute(f'drop table if exists "{layer}"')
        base.execute(f'create table if not exists "{layer}" (fid integer primary key, geom blob' + "".join(f', "{n}" {kinds[n]}' for n in names) + ")")
        base.execute("insert or replace into gpkg_contents (table_name, data_type, identifier, srs_id) values (?, 'features', ?, ?)", (layer, layer, srid))
        base.execute("insert or replace into gpkg_geometry_columns values (?, 'geom', 'GEOMETRY', ?, 0, 0)", (layer, srid))
        listed, marks, count = "".join(f', "{n}"' for n in names), ", ?" * len(names), 0
        for row in df.select(*[f"`{n}`" for n in names], column).toLocalIterator():
            rings = row[column] if column == "rings" or row[column] is None else [row[column]]
            shape = None if rings is None else encode([[(p["x"], p["y"]) for p in r] for r in rings], srid)
            base.execute(f'insert into "{layer}" (geom{listed}) values (?{marks})', (shape, *(row[n] for n in names)))
            count += 1
        base.commit()
        return count
    finally:
        base.close()


def simplified(ring: Sequence[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Ring without points nearer than the tolerance to the line between those kept (farthest point first)."""
    if len(ring) < 4:
        return list(ring)
    keep = {0, len(ring) - 1}
    stack = [(0, len(ring) - 1)]
    while stack:
        a, b = stack.pop()
        (x0, y0), (x1, y1) = ring[a], ring[b]
        size = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
        far, most = -1, tolerance
        for k in range(a + 1, b):
            x, y = ring[k]
            d = abs((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) / size if size else ((x - x0) ** 2 + (y - y0) ** 2) ** 0.5
            if d > most:
                far, most = k, d
        if far >= 0:
            keep.add(far)
            stack += [(a, far), (far, b)]
    return [ring[k] for k in sorted(keep)]


def feature_lines(df: DataFrame, digits: int = 6, tolerance: float = 0.0, zone: int | None = 5179) -> DataFrame:
    """One GeoJSON feature a row as text: attributes rounded, shapes (ring or rings) simplified (in metres) and turned to degrees."""
    import pyarrow as pa

    from terrane.functions import cleaning
    from terrane.functions import geometry as g

    names = [c for c in df.columns if c not in ("ring", "rings")]
    df = df.select(*names, g.shape(df).alias("rings"))
    if tolerance > 0:

        def thin(batches):
            for batch in batches:
                at = batch.schema.get_field_index("rings")
                shapes = [None if s is None else [[{"x": x, "y": y} for x, y in simplified([(p["x"], p["y"]) for p in r], tolerance)] for r in s] for s in batch.column(at).to_pylist()]
                yield batch.set_column(at, "rings", pa.array(shapes, type=batch.schema.field(at).type))

        df = df.mapInArrow(thin, df.schema)
    rounded = cleaning.round_numeric(df, digits)

    def place(p):
        lon, lat = g.unproject(p.x, p.y, zone) if zone else (p.x, p.y)
        return F.array(F.bround(lon, digits), F.bround(lat, digits))

    closed = lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), place)
    # an outer ring opens a polygon, holes join the one before
    none = F.array().cast(f"array<{g.SHAPE}>")
    parts = F.aggregate("rings", none, lambda out, r: F.when((g.signed_area(r) > 0) | (F.size(out) == 0), F.concat(out, F.array(F.array(r)))).otherwise(
        F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.concat(F.element_at(out, -1), F.array(r))))
    ))
    polygon = lambda p: F.transform(p, closed)
    properties = F.struct(*names).alias("properties")
    feature = lambda kind, where: F.to_json(F.struct(F.lit("Feature").alias("type"), properties, F.struct(F.lit(kind).alias("type"), where.alias("coordinates")).alias("geometry")))
    many = rounded.withColumn("_parts", parts)
    one = feature("Polygon", polygon(F.element_at("_parts", 1)))
    return many.select(F.when(F.size("_parts") > 1, feature("MultiPolygon", F.transform("_parts", polygon))).otherwise(one).alias("value"))


def write_features(df: DataFrame, path: str, **options) -> None:
    """A FeatureCollection in one file, for maps; rows pass one partition at a time. For large tables write feature_lines() as text from the tasks."""
    with Path(path).open("w", encoding="utf-8") as out:
        out.write('{"type": "FeatureCollection", "features": [')
        for k, row in enumerate(feature_lines(df, **options).toLocalIterator()):
            out.write((", " if k else "") + row["value"])
        out.write("]}")
    json.loads(Path(path).read_text(encoding="utf-8"))
