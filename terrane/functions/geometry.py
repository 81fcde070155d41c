"""Plane geometry on columns: rings of points, areas, containment, clipping against convex cells, projection, hexagons.

A ring is array<struct<x,y>> without the repeated first point. A shape is an array
of rings, the outer ones counter-clockwise and holes clockwise; multipolygons
have several outer ones. All is built from array functions, so it runs in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.cleaning import col

RING = "array<struct<x:double,y:double>>"
SHAPE = f"array<{RING}>"


def ring(points: list[tuple[float, float]]) -> Column:
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


def box_ring(west: Column, south: Column, east: Column, north: Column) -> Column:
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(point(west, south), point(east, south), point(east, north), point(west, north))


def _rotated(r: Column) -> Column:
    return F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))


def _edges(r: Column) -> Column:
    return F.arrays_zip(r.alias("a"), _rotated(r).alias("b"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def signed_area(r: Column | str) -> Column:
    """Shoelace; positive counter-clockwise."""
    r = col(r)
    return _sum(F.zip_with(r, _rotated(r), lambda a, b: a.x * b.y - b.x * a.y)) / 2.0


def area(r: Column | str) -> Column:
    return F.abs(signed_area(r))


def centroid(r: Column | str) -> tuple[Column, Column]:
    r = col(r)
    cross = lambda a, b: a.x * b.y - b.x * a.y
    six = F.nullif(6.0 * signed_area(r), F.lit(0.0))
    x = _sum(F.zip_with(r, _rotated(r), lambda a, b: (a.x + b.x) * cross(a, b)))
    y = _sum(F.zip_with(r, _rotated(r), lambda a, b: (a.y + b.y) * cross(a, b)))
    return F.try_divide(x, six), F.try_divide(y, six)


def bounds(r: Column | str) -> tuple[Column, Column, Column, Column]:
    """West, south, east, north."""
    xs, ys = F.transform(col(r), lambda p: p.x), F.transform(col(r), lambda p: p.y)
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def on_border(r: Column | str, x: Column, y: Column) -> Column:
    r = col(r)

    def touches(a, b):
        cross = (b.x - a.x) * (y - a.y) - (b.y - a.y) * (x - a.x)
        return (cross == 0) & x.between(F.least(a.x, b.x), F.greatest(a.x, b.x)) & y.between(F.least(a.y, b.y), F.greatest(a.y, b.y))

    return F.exists(F.zip_with(r, _rotated(r), touches), lambda t: t)


def _odd_crossings(r: Column, x: Column, y: Column) -> Column:
    def crosses(a, b):
        return F.when(((a.y > y) != (b.y > y)) & (x < (b.x - a.x) * (y - a.y) / (b.y - a.y) + a.x), 1).otherwise(0)

    return F.aggregate(F.zip_with(r, _rotated(r), crosses), F.lit(0), lambda s, c: s + c) % 2 == 1


def within(r: Column | str, x: Column, y: Column) -> Column:
    """Strictly inside the ring."""
    return _odd_crossings(col(r), x, y) & ~on_border(r, x, y)


def covers(r: Column | str, x: Column, y: Column) -> Column:
    """Inside or on the border."""
    return _odd_crossings(col(r), x, y) | on_border(r, x, y)


def border_distance(r: Column | str, x: Column, y: Column) -> Column:
    """To the nearest point of the border."""
    r = col(r)

    def distance(a, b):
        dx, dy = b.x - a.x, b.y - a.y
        along = F.coalesce(F.try_divide((x - a.x) * dx + (y - a.y) * dy, F.nullif(dx * dx + dy * dy, F.lit(0.0))), F.lit(0.0))
        t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
        return F.hypot(a.x + t * dx - x, a.y + t * dy - y)

    return F.array_min(F.zip_with(r, _rotated(r), distance))


def clip(subject: Column | str, convex: Column | str) -> Column:
    """Part of a ring inside a convex counter-clockwise ring, cut by one border after the other."""
    subject, convex = col(subject), col(convex)

    def cut(left: Column, edge: Column) -> Column:
        side = lambda p: (edge.b.x - edge.a.x) * (p.y - edge.a.y) - (edge.b.y - edge.a.y) * (p.x - edge.a.x)

        def keep(p, q):
            sp, sq = side(p), side(q)
            t = F.try_divide(sp, F.nullif(sp - sq, F.lit(0.0)))
            meet = F.struct((p.x + t * (q.x - p.x)).alias("x"), (p.y + t * (q.y - p.y)).alias("y"))
            empty = F.array().cast(RING)
            first = F.when(sp >= 0, F.array(F.struct(p.x.alias("x"), p.y.alias("y")))).otherwise(empty)
            second = F.when(((sp > 0) & (sq < 0)) | ((sp < 0) & (sq > 0)), F.array(meet)).otherwise(empty)
            return F.concat(first, second)

        return F.flatten(F.zip_with(left, _rotated(left), keep))

    edges = F.zip_with(convex, _rotated(convex), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.aggregate(edges, subject.cast(RING), cut)


def clipped_area(subject: Column | str, convex: Column | str) -> Column:
    return F.coalesce(area(clip(subject, convex)), F.lit(0.0))


def outward(r: Column | str) -> Column:
    """The ring counter-clockwise."""
    r = col(r)
    return F.when(signed_area(r) < 0, F.reverse(r)).otherwise(r)


def shape(df: DataFrame, ring: str = "ring", rings: str = "rings") -> Column:
    """The shape of a table's rows: its column of rings, or its one ring."""
    return F.col(rings) if rings in df.columns else F.array(outward(ring))


def shape_area(s: Column | str) -> Column:
    return _sum(F.transform(col(s), signed_area))


def shape_bounds(s: Column | str) -> tuple[Column, Column, Column, Column]:
    return bounds(F.flatten(col(s)))


def shape_centroid(s: Column | str) -> tuple[Column, Column]:
    s = col(s)
    cross = lambda a, b: a.x * b.y - b.x * a.y
    six = F.nullif(6.0 * shape_area(s), F.lit(0.0))
    x = _sum(F.transform(s, lambda r: _sum(F.zip_with(r, _rotated(r), lambda a, b: (a.x + b.x) * cross(a, b)))))
    y = _sum(F.transform(s, lambda r: _sum(F.zip_with(r, _rotated(r), lambda a, b: (a.y + b.y) * cross(a, b)))))
    return F.try_divide(x, six), F.try_divide(y, six)


def _shape_odd(s: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings: holes are outside, and so are the doubled parts of a ring that crosses itself."""
    return F.aggregate(F.transform(s, lambda r: _odd_crossings(r, x, y).cast("int")), F.lit(0), lambda n, c: n + c) % 2 == 1


def shape_border(s: Column | str, x: Column, y: Column) -> Column:
    return F.exists(col(s), lambda r: on_border(r, x, y))


def shape_within(s: Column | str, x: Column, y: Column) -> Column:
    """Strictly inside."""
    return _shape_odd(col(s), x, y) & ~shape_border(s, x, y)


def points_within(shapes, x, y, n):
    """How many of the points (arrays x, y; n times each) are strictly inside each shape of an Arrow array; the arithmetic of shape_within()."""
    import numpy as np

    rings = shapes.flatten()
    corners = rings.flatten()
    cx, cy = (corners.field(c).to_numpy(zero_copy_only=False) for c in "xy")
    of_shape, of_ring = (np.asarray(o.offsets) - o.offsets[0].as_py() for o in (shapes, rings))
    following = np.arange(1, len(cx) + 1)
    some = of_ring[1:] > of_ring[:-1]
    following[of_ring[1:][some] - 1] = of_ring[:-1][some]
    dx, dy = cx[following], cy[following]
    order = np.argsort(y, kind="stable")
    x, y, n = x[order], y[order], n[order]
    west, south, east, north = np.minimum(cx, dx), np.minimum(cy, dy), np.maximum(cx, dx), np.maximum(cy, dy)
    out = np.zeros(len(shapes), np.int64)
    for k in range(len(shapes)):
        e = slice(of_ring[of_shape[k]], of_ring[of_shape[k + 1]])
        if e.start == e.stop:
            continue
        low, high = np.searchsorted(y, south[e].min(), "left"), np.searchsorted(y, north[e].max(), "right")
        held = np.flatnonzero((x[low:high] >= west[e].min()) & (x[low:high] <= east[e].max())) + low
        px, py = x[held], y[held]
        odd, border = np.zeros(len(held), bool), np.zeros(len(held), bool)
        for ax, ay, bx, by, w, s, r, t in zip(cx[e], cy[e], dx[e], dy[e], west[e], south[e], east[e], north[e], strict=True):
            if ay != by:
                odd ^= ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
            border |= ((bx - ax) * (py - ay) - (by - ay) * (px - ax) == 0) & (px >= w) & (px <= r) & (py >= s) & (py <= t)
        out[k] = n[held[odd & ~border]].sum()
    return out


def shape_covers(s: Column | str, x: Column, y: Column) -> Column:
    """Inside or on a border."""
    return _shape_odd(col(s), x, y) | shape_border(s, x, y)


def shape_distance(s: Column | str, x: Column, y: Column) -> Column:
    """To the nearest point of any border."""
    return F.array_min(F.transform(col(s), lambda r: border_distance(r, x, y)))


def shape_clipped_area(s: Column | str, convex: Column | str) -> Column:
    """Surface of a shape inside a convex counter-clockwise ring; holes take theirs away."""
    return F.coalesce(_sum(F.transform(col(s), lambda r: F.coalesce(signed_area(clip(r, convex)), F.lit(0.0)))), F.lit(0.0))


def with_inner_point(df: DataFrame, s: Column | str, x: str = "x", y: str = "y") -> DataFrame:
    """Add a point inside each shape: the middle of the widest part of a level line, half way between the corners next to the middle of its height.

    NULL for a shape without surface. Each step is a column, so that none is computed twice.
    """
    df = df.withColumn("_shape", col(s)).withColumn("_heights", F.transform(F.flatten("_shape"), lambda p: p.y))
    df = df.withColumn("_middle", (F.array_min("_heights") + F.array_max("_heights")) / 2)
    below, above = F.array_max(F.filter("_heights", lambda h: h <= F.col("_middle"))), F.array_min(F.filter("_heights", lambda h: h > F.col("_middle")))
    df = df.withColumn("_level", (below + above) / 2)
    level = F.col("_level")

    def meets(a, b):
        return F.when((a.y > level) != (b.y > level), a.x + (level - a.y) / (b.y - a.y) * (b.x - a.x))

    df = df.withColumn("_xs", F.array_sort(F.filter(F.flatten(F.transform("_shape", lambda r: F.zip_with(r, _rotated(r), meets))), lambda v: v.isNotNull())))
    # the line enters and leaves by turns: of its widest parts the first
    place = lambda k: F.get("_xs", k)
    part = lambda k: F.struct((place(2 * k + 1) - place(2 * k)).alias("wide"), (-k).alias("k"))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("_xs") / 2).cast("int") - 1, F.lit(0))), part)
    df = df.withColumn("_best", F.array_max(F.filter(parts, lambda p: p.wide > 0)))
    at = -2 * F.col("_best.k")
    df = df.withColumn(x, (place(at) + place(at + 1)) / 2).withColumn(y, F.when(F.col("_best").isNotNull(), level))
    return df.drop("_shape", "_heights", "_middle", "_level", "_xs", "_best")


def line_from_wkt(text: Column | str) -> Column:
    """Points of a LINESTRING."""
    inside = F.regexp_extract(col(text), r"\(\s*([^()]*?)\s*\)", 1)
    parts = F.transform(F.split(inside, r"\s*,\s*"), lambda p: F.split(p, r"\s+"))
    return F.when(inside != "", F.transform(parts, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("double").alias("x"), F.get(p, F.lit(1)).try_cast("double").alias("y"))))


def line_length(points: Column | str) -> Column:
    p = col(points)
    return _sum(F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.hypot(b.x - a.x, b.y - a.y)))


# Transverse Mercator on GRS 80 by Krueger's series (fixed values of EPSG:5179 and EPSG:5186).
_AXIS, _FLATTENING = 6378137.0, 1 / 298.257222101
ZONES = {5179: (127.5, 38.0, 0.9996, 1_000_000.0, 2_000_000.0), 5186: (127.0, 38.0, 1.0, 200_000.0, 600_000.0)}
_N = _FLATTENING / (2 - _FLATTENING)
_RADIUS = _AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3, 13 / 48 * _N**2 - 3 / 5 * _N**3, 61 / 240 * _N**3)
_BETA = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3, 1 / 48 * _N**2 + 1 / 15 * _N**3, 17 / 480 * _N**3)
_DELTA = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3, 7 / 3 * _N**2 - 8 / 5 * _N**3, 56 / 15 * _N**3)


def _northing_of_origin(latitude: float) -> float:
    e = 2 * math.sqrt(_N) / (1 + _N)
    s = math.sin(math.radians(latitude))
    xi = math.atan(math.sinh(math.atanh(s) - e * math.atanh(e * s)))
    return _RADIUS * (xi + sum(a * math.sin(2 * (k + 1) * xi) for k, a in enumerate(_ALPHA)))


def project(lon: Column | str, lat: Column | str, zone: int = 5179) -> tuple[Column, Column]:
    """Degrees to metres (x, y)."""
    meridian, origin, scale, east, north = ZONES[zone]
    e = 2 * math.sqrt(_N) / (1 + _N)
    s = F.sin(F.radians(col(lat)))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    away = F.radians(col(lon) - meridian)
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(_ALPHA):
        m = 2.0 * (k + 1)
        x, y = x + a * F.cos(m * xi) * F.sinh(m * eta), y + a * F.sin(m * xi) * F.cosh(m * eta)
    return east + scale * _RADIUS * x, north + scale * (_RADIUS * y - _northing_of_origin(origin))


def unproject(x: Column | str, y: Column | str, zone: int = 5179) -> tuple[Column, Column]:
    """Metres to degrees (lon, lat)."""
    meridian, origin, scale, east, north = ZONES[zone]
    xi = ((col(y) - north) / scale + _northing_of_origin(origin)) / _RADIUS
    eta = (col(x) - east) / (scale * _RADIUS)
    a, b = xi, eta
    for k, beta in enumerate(_BETA):
        m = 2.0 * (k + 1)
        a, b = a - beta * F.sin(m * xi) * F.cosh(m * eta), b - beta * F.cos(m * xi) * F.sinh(m * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi
    for k, delta in enumerate(_DELTA):
        lat = lat + delta * F.sin(2.0 * (k + 1) * chi)
    return meridian + F.degrees(F.atan2(F.sinh(b), F.cos(a))), F.degrees(lat)


# Planar grid of pointy-top hexagons in metres, in place of a global cell system: id "q:r" in axial coordinates.


def hex_at(x: Column | str, y: Column | str, edge: float) -> tuple[Column, Column]:
    """Axial coordinates of the hexagon at a point (cube rounding)."""
    q = (math.sqrt(3) / 3 * col(x) - col(y) / 3) / edge
    r = 2 / 3 * col(y) / edge
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fixed_q = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    fixed_r = F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr)
    return fixed_q.cast("long"), fixed_r.cast("long")


def hex_center(q: Column | str, r: Column | str, edge: float) -> tuple[Column, Column]:
    return edge * (math.sqrt(3) * col(q) + math.sqrt(3) / 2 * col(r)), edge * 1.5 * col(r)


def hex_id(q: Column | str, r: Column | str) -> Column:
    return F.concat_ws(":", col(q).cast("string"), col(r).cast("string"))


def hex_ring(q: Column | str, r: Column | str, edge: float) -> Column:
    """Six corners, counter-clockwise."""
    x, y = hex_center(q, r, edge)
    corner = lambda k: (edge * math.cos(math.radians(60 * k - 30)), edge * math.sin(math.radians(60 * k - 30)))
    return F.array(*(F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in map(corner, range(6))))
