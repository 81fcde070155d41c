"""Shapefiles (.shp, .shx, .dbf) as a Spark data source, with nothing but the standard library.

    spark.dataSource.register(ShapefileSource)
    spark.read.format("shapefile").option("encoding", "cp949").load(path)

gives the attributes and `rings`, a shape as in the GeoPackage source. The index
file tells where records stand, so several tasks read one file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terrane.sources.geopackage import Ring, turned

#: Records that a task reads.
_RECORDS = 20_000


def _fields(table: Path) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """Records, bytes of the head and of a record, and the fields (name, kind, size, decimals) of a .dbf table."""
    with table.open("rb") as file:
        head = file.read(32)
        count, start, size = struct.unpack_from("<IHH", head, 4)
        found = []
        while (raw := file.read(32)) and raw[0] != 0x0D:
            found.append((raw[:11].split(b"\0")[0].decode("ascii", "replace"), chr(raw[11]), raw[16], raw[17]))
    return count, start, size, found


def _value(raw: bytes, kind: str, decimals: int, encoding: str):
    text = raw.decode(encoding, "replace").strip().strip("\0")
    if kind in "NF":
        try:
            return float(text) if decimals or kind == "F" else int(text)
        except ValueError:
            return None
    if kind == "L":
        return {"Y": True, "T": True, "N": False, "F": False}.get(text.upper())
    return text or None


def shape_of(record: bytes) -> list[Ring] | None:
    """Rings of a polygon, lists of places of a line, or the place of a point; None for a null shape. Outer rings are clockwise in the file."""
    kind = struct.unpack_from("<i", record)[0] % 10
    if kind == 1:
        return [[struct.unpack_from("<2d", record, 4)]]
    if kind not in (3, 5):
        return None
    parts, points = struct.unpack_from("<2i", record, 36)
    opens = [*struct.unpack_from(f"<{parts}i", record, 44), points]
    flat = struct.unpack_from(f"<{2 * points}d", record, 44 + 4 * parts)
    places = list(zip(flat[::2], flat[1::2], strict=True))
    lists = [places[a:b] for a, b in zip(opens[:-1], opens[1:], strict=True)]
    if kind == 3:
        return lists
    clockwise = lambda r: sum((x1 - x0) * (y1 + y0) for (x0, y0), (x1, y1) in zip(r, r[1:] + r[:1], strict=True)) > 0
    return [turned(r, outer=clockwise(r)) for r in lists]


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.encoding, self.schema = Path(options["path"]), options.get("encoding", "cp949"), schema

    def partitions(self):
        count = (self.path.with_suffix(".shx").stat().st_size - 100) // 8
        return [InputPartition((a, min(a + _RECORDS, count))) for a in range(0, max(count, 1), _RECORDS)]

    def read(self, partition) -> Iterator[tuple]:
        low, high = partition.value
        _, start, size, fields = _fields(self.path.with_suffix(".dbf"))
        with self.path.with_suffix(".shx").open("rb") as index, self.path.open("rb") as shapes, self.path.with_suffix(".dbf").open("rb") as table:
            index.seek(100 + 8 * low)
            table.seek(start + size * low)
            for _ in range(low, high):
                offset, length = struct.unpack(">2i", index.read(8))
                row = table.read(size)
                if row[:1] == b"*":  # a deleted record
                    continue
                values, at = [], 1
                for _, kind, width, decimals in fields:
                    values.append(_value(row[at : at + width], kind, decimals, self.encoding))
                    at += width
                shapes.seek(2 * offset + 8)
                rings = shape_of(shapes.read(2 * length))
                yield (*values, None if rings is None else [[{"x": x, "y": y} for x, y in r] for r in rings])


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        kind = lambda k, decimals: "double" if k == "F" or (k == "N" and decimals) else {"N": "bigint", "L": "boolean"}.get(k, "string")
        found = _fields(Path(self.options["path"]).with_suffix(".dbf"))[3]
        return ", ".join([*(f"`{n}` {kind(k, d)}" for n, k, _, d in found), "rings array<array<struct<x:double,y:double>>>"])

    def reader(self, schema):
        return _Reader(self.options, schema)


def read_shapefile(spark: SparkSession, path: str, encoding: str = "cp949") -> DataFrame:
    spark.dataSource.register(ShapefileSource)
    return spark.read.format("shapefile").option("encoding", encoding).load(path)


def write_shapefile(df: DataFrame, path: str, encoding: str = "cp949") -> int:
    """Polygons (attributes as text, rings) as a shapefile, which is one file of some gigabytes at most; rows pass one partition at a time."""
    from terrane.sources.geopackage import polygons

    base, names = Path(path), [c for c in df.columns if c != "rings"]
    rows = [(tuple(r[n] for n in names), [[(p["x"], p["y"]) for p in x] for x in r["rings"]]) for r in df.toLocalIterator()]
    shapes, index, at = [], [], 50
    for k, (_, rings) in enumerate(rows, 1):
        turned_ = [turned(r, outer=bool(j)) for part in polygons(rings) for j, r in enumerate(part)]  # outer ones clockwise
        closed = [[*r, r[0]] for r in turned_]
        places = [p for r in closed for p in r]
        xs, ys = [p[0] for p in places], [p[1] for p in places]
        opens = [sum(map(len, closed[:j])) for j in range(len(closed))]
        body = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(closed), len(places)) + struct.pack(f"<{len(opens)}i", *opens) + b"".join(struct.pack("<2d", *p) for p in places)
        shapes.append(struct.pack(">2i", k, len(body) // 2) + body)
        index.append(struct.pack(">2i", at, len(body) // 2))
        at += len(shapes[-1]) // 2
    head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    base.write_bytes(head(at) + b"".join(shapes))
    base.with_suffix(".shx").write_bytes(head(50 + 4 * len(index)) + b"".join(index))
    width = 80
    fields = b"".join(n.encode("ascii")[:10].ljust(11, b"\0") + b"C" + bytes(4) + bytes([width]) + bytes(15) for n in names)
    cell = lambda v: ("" if v is None else str(v)).encode(encoding)[:width].ljust(width)
    table = b"".join(b" " + b"".join(map(cell, values)) for values, _ in rows)
    base.with_suffix(".dbf").write_bytes(struct.pack("<B3BIHH20x", 3, 26, 1, 1, len(rows), 33 + 32 * len(names), 1 + width * len(names)) + fields + b"\r" + table + b"\x1a")
    return len(rows)
