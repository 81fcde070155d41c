"""Spatial joins by grid buckets: equal cells are joined, the exact predicate follows. No all-pairs comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import geometry as g
from terrane.functions.store import cut


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size)


def _around(value: Column, size: float) -> Column:
    return F.explode(F.sequence(_cell(value, size) - 1, _cell(value, size) + 1))


def snap(points: DataFrame, nodes: DataFrame, keys: Sequence[str], most: float = 100.0, unique: bool = False) -> DataFrame:
    """Nearest node (node_id, x, y) of each point (keys, x, y) within a distance, included: keys, node_id, distance; NULL beyond.

    Equally near nodes give a row each, or the least id alone if unique. Nodes,
    which are fewer than what is snapped to them, stand in nine grid cells each.
    """
    near = nodes.select("node_id", F.col("x").alias("_nx"), F.col("y").alias("_ny"), _around(F.col("x"), most).alias("_cx"), "y").withColumn("_cy", _around(F.col("y"), most)).drop("y")
    asked = points.where("x is not null and y is not null").withColumn("_cx", _cell(F.col("x"), most)).withColumn("_cy", _cell(F.col("y"), most))
    found = asked.join(near, ["_cx", "_cy"]).withColumn("distance", F.hypot(F.col("_nx") - F.col("x"), F.col("_ny") - F.col("y"))).where(F.col("distance") <= most)
    if unique:
        best = found.groupBy(*keys).agg(F.min(F.struct("distance", "node_id")).alias("b")).select(*keys, "b.node_id", "b.distance")
    else:
        least = found.groupBy(*keys).agg(F.min("distance").alias("distance"))
        best = found.join(least, [*keys, "distance"]).select(*keys, "node_id", "distance")
    return points.select(*keys).join(best, list(keys), "left")


def nearest(points: DataFrame, targets: DataFrame, key: str, target: str, step: float) -> DataFrame:
    """Nearest target (id, x, y) of every point, however far: key, target, distance (ties: the least id).

    Points with a target within `step` are found in their grid cells. The others
    go down a pyramid of target cells, each half as wide as its parent: at each
    level a point keeps the cells whose box is no further than the nearest
    target that it has seen. Cells are split until none holds many targets, so
    no join multiplies far points by all targets. Every level is written.
    """
    asked = cut(points.select(key, "x", "y").where("x is not null and y is not null"))
    # of targets at one place the least id is enough
    goals = cut(targets.where("x is not null and y is not null").groupBy(F.col("x").alias("_tx"), F.col("y").alias("_ty")).agg(F.min(target).alias(target)))
    box = goals.agg(F.min("_tx"), F.min("_ty"), F.max("_tx"), F.max("_ty")).first()
    if box[0] is None:
        return points.select(key).withColumn(target, F.lit(None).cast(targets.schema[target].dataType)).withColumn("distance", F.lit(None).cast("double"))
    near = cut(snap(asked, goals.select(F.col(target).alias("node_id"), F.col("_tx").alias("x"), F.col("_ty").alias("y")), [key], step, unique=True))
    done = near.where("node_id is not null").select(key, F.col("node_id").alias(target), "distance")
    far = asked.join(near.where("node_id is null").select(key), key, "left_semi")
    return done.union(_down_the_pyramid(far, goals, key, target, box, step))


#: Targets of a cell at the foot of the pyramid, unless cells of a thousandth of the step still hold more.
_FOOT_TARGETS = 64


def _down_the_pyramid(asked: DataFrame, goals: DataFrame, key: str, target: str, box: tuple, step: float) -> DataFrame:
    west, south, east, north = box
    wide = max(east - west, north - south, step)
    foot = 0
    while True:  # the foot's cells, counted by halving until they are small
        size = wide / 2**foot
        place = [F.least(F.floor((F.col(c) - low) / size), F.lit(2**foot - 1)) for c, low in (("_tx", west), ("_ty", south))]  # the outermost are in the last cell
        cells = goals.groupBy(place[0].alias("_cx"), place[1].alias("_cy"))
        most = cells.agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if most <= _FOOT_TARGETS or size <= step / 1000:
            break
        foot += 2
    corners = [F.min("_tx").alias("_w"), F.min("_ty").alias("_s"), F.max("_tx").alias("_e"), F.max("_ty").alias("_n"), F.min(F.struct("_tx", "_ty")).alias("_one")]
    leaves = cut(cells.agg(*corners))
    x, y = F.col("x"), F.col("y")
    open_ = asked.withColumns({"_cx": F.lit(0).cast("long"), "_cy": F.lit(0).cast("long")})
    lower = F.hypot(F.greatest(F.col("_w") - x, x - F.col("_e"), F.lit(0.0)), F.greatest(F.col("_s") - y, y - F.col("_n"), F.lit(0.0)))
    upper = F.hypot(F.col("_one._tx") - x, F.col("_one._ty") - y)
    for level in range(1, foot + 1):
        up = foot - level
        child = leaves.groupBy(F.shiftright("_cx", up).alias("_x"), F.shiftright("_cy", up).alias("_y")).agg(
            F.min("_w").alias("_w"), F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.max("_n").alias("_n"), F.min("_one").alias("_one")
        ).withColumns({"_cx": F.shiftright("_x", 1), "_cy": F.shiftright("_y", 1)})
        seen = open_.join(child, ["_cx", "_cy"]).select(key, "x", "y", F.col("_x").alias("_cx"), F.col("_y").alias("_cy"), lower.alias("_lower"), upper.alias("_upper"))
        best = F.min("_upper").over(Window.partitionBy(key))
        open_ = cut(seen.withColumn("_best", best).where(F.col("_lower") <= F.col("_best") * (1 + 1e-12)).select(key, "x", "y", "_cx", "_cy"))
    there = goals.withColumns({"_cx": place[0], "_cy": place[1]})
    met = open_.join(there, ["_cx", "_cy"]).withColumn("distance", F.hypot(F.col("_tx") - x, F.col("_ty") - y))
    return met.groupBy(key).agg(F.min(F.struct("distance", target)).alias("b")).select(key, f"b.{target}", "b.distance")


def within_distance(a: DataFrame, b: DataFrame, most: float) -> DataFrame:
    """All pairs of rows of a and b (x, y each) no further apart than `most`, with their distance; coordinates are dropped."""
    there = b.withColumnsRenamed({"x": "_bx", "y": "_by"}).withColumn("_cx", _around(F.col("_bx"), most)).withColumn("_cy", _around(F.col("_by"), most))
    # a short table may still have many pairs, which its bytes don't tell
    asked = a.where("x is not null and y is not null").repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = asked.withColumn("_cx", _cell(F.col("x"), most)).withColumn("_cy", _cell(F.col("y"), most))
    met = asked.join(there, ["_cx", "_cy"]).withColumn("distance", F.hypot(F.col("_bx") - F.col("x"), F.col("_by") - F.col("y")))
    return met.where(F.col("distance") <= most).drop("_cx", "_cy", "_bx", "_by", "x", "y")


def containing(points: DataFrame, areas: DataFrame, size: float, predicate: str = "within") -> DataFrame:
    """Pairs of points (x, y) and areas (ring, or rings with holes) by within (border outside) or covers (border inside), by way of grid cells that areas touch."""
    areas = areas.withColumn("_shape", g.shape(areas))
    west, south, east, north = g.shape_bounds("_shape")
    tiles = areas.withColumn("_cx", F.explode(F.sequence(_cell(west, size), _cell(east, size)))).withColumn("_cy", F.explode(F.sequence(_cell(south, size), _cell(north, size))))
    asked = points.where("x is not null and y is not null").withColumn("_cx", _cell(F.col("x"), size)).withColumn("_cy", _cell(F.col("y"), size))
    test = {"within": g.shape_within, "covers": g.shape_covers}[predicate]
    return asked.join(tiles, ["_cx", "_cy"]).where(test("_shape", F.col("x"), F.col("y"))).drop("_cx", "_cy", "_shape")


#: Different points, and areas, of a grid cell that a task compares at once.
_BLOCK_POINTS, _BLOCK_AREAS = 1 << 16, 1 << 12


def counted_within(points: DataFrame, areas: DataFrame, key: str, size: float) -> DataFrame:
    """(key, points): points (x, y) strictly inside each area (ring, or rings with holes) that has any; the same test as containing(), without a row for each pair.

    Areas and points meet in the grid cells that areas touch. A task takes a cell
    or, if it is crowded, a block of its points and one of its areas, sorts the
    points once, and tests those in an area's bounds all at once.
    """
    import pyarrow as pa

    kind = areas.schema[key].dataType.simpleString()
    shapes = areas.select(F.col(key).alias("_key"), g.shape(areas).alias("_shape"))
    west, south, east, north = g.shape_bounds("_shape")
    tiles = shapes.withColumn("_cx", F.explode(F.sequence(_cell(west, size), _cell(east, size)))).withColumn("_cy", F.explode(F.sequence(_cell(south, size), _cell(north, size))))
    # of points at one place a row is enough
    spots = points.where("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("_n")).withColumn("_cx", _cell(F.col("x"), size)).withColumn("_cy", _cell(F.col("y"), size))
    blocks = lambda rows, name, most: rows.groupBy("_cx", "_cy").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    cells = cut(blocks(spots, "_ps", _BLOCK_POINTS).join(blocks(tiles, "_as", _BLOCK_AREAS), ["_cx", "_cy"]))
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    p = spots.join(cells, ["_cx", "_cy"]).withColumn("_p", F.pmod(F.xxhash64("x", "y"), "_ps").cast("int")).withColumn("_a", spread("_as"))
    a = tiles.join(cells, ["_cx", "_cy"]).withColumn("_a", F.pmod(F.xxhash64("_key"), "_as").cast("int")).withColumn("_p", spread("_ps"))
    block = ["_cx", "_cy", "_p", "_a"]

    def count(here: pa.Table, there: pa.Table) -> pa.Table:
        inside = g.points_within(there.column("_shape").combine_chunks(), *(here.column(c).to_numpy() for c in ("x", "y", "_n")))
        found = pa.table({"key": there.column("_key"), "points": pa.array(inside, pa.int64())})
        return found.filter(pa.array(inside > 0))

    met = p.select("x", "y", "_n", *block).groupBy(*block).cogroup(a.select("_key", "_shape", *block).groupBy(*block)).applyInArrow(count, f"key {kind}, points long")
    return met.groupBy(F.col("key").alias(key)).agg(F.sum("points").alias("points"))


def count_points(cells: DataFrame, sources: dict[str, DataFrame], size: float) -> DataFrame:
    """Cells (hex_id, ring) with <name>_poi_count of points strictly inside, and poi_total_count."""
    out = cells.select("hex_id")
    for name, points in sources.items():
        found = containing(points.select("x", "y"), cells.select("hex_id", "ring"), size).groupBy("hex_id").agg(F.count("*").alias(f"{name}_poi_count"))
        out = out.join(found, "hex_id", "left")
    counts = [f"{n}_poi_count" for n in sources]
    out = out.fillna(0, subset=counts) if counts else out
    return out.withColumn("poi_total_count", sum((F.col(c) for c in counts), F.lit(0)).cast("long"))


def label(cells: DataFrame, areas: DataFrame, names: Sequence[str], size: float, key: str = "hex_id", point: str = "centroid") -> DataFrame:
    """Cells (key, ring or rings) with the names of the area that holds their centroid, or a point inside them ("inner"); of several the least names; NULL outside all."""
    if not names:
        return cells
    if point == "inner":
        placed = cut(g.with_inner_point(cells, g.shape(cells)).select(key, "x", "y"))  # else a filter on x would be pushed through all its steps
    else:
        x, y = g.shape_centroid(g.shape(cells))
        placed = cells.select(key, x.alias("x"), y.alias("y"))
    shapes = [c for c in ("ring", "rings") if c in areas.columns]
    found = containing(placed, areas.select(*names, *shapes), size, "covers")
    first = found.groupBy(key).agg(F.min(F.struct(*names)).alias("_a")).select(key, "_a.*")
    return cells.drop(*names).join(first, key, "left")


def split_by_boundary(points: DataFrame, boundary: DataFrame, buffer: float = 0.0, size: float = 1000.0) -> tuple[DataFrame, DataFrame]:
    """Points inside (or on, or within a buffer of) any area of a boundary, and the others; areas meet points in the grid cells that they, widened by the buffer, touch."""
    areas = boundary.select(g.shape(boundary).alias("_shape"))
    west, south, east, north = g.shape_bounds("_shape")
    tiles = areas.withColumn("_cx", F.explode(F.sequence(_cell(west - buffer, size), _cell(east + buffer, size))))
    tiles = tiles.withColumn("_cy", F.explode(F.sequence(_cell(south - buffer, size), _cell(north + buffer, size))))
    x, y = F.col("x"), F.col("y")
    marked = cut(points.withColumn("_row", F.monotonically_increasing_id()))
    asked = marked.where("x is not null and y is not null").withColumn("_cx", _cell(x, size)).withColumn("_cy", _cell(y, size))
    hit = g.shape_covers("_shape", x, y) | (F.lit(buffer > 0) & (g.shape_distance("_shape", x, y) <= buffer))
    inside = asked.join(tiles, ["_cx", "_cy"]).where(hit).select("_row").distinct()
    return marked.join(inside, "_row", "left_semi").drop("_row"), marked.join(inside, "_row", "left_anti").drop("_row")


def overlaps(areas: DataFrame, cells: DataFrame, area_key: str, cell_key: str, size: float) -> DataFrame:
    """(area key, cell key, piece, area_size, cell_size): shared surface of every area (any ring, or rings with holes) and convex cell that meet."""

    def tiled(df: DataFrame, key: str, name: str, value: Column, edges: tuple[Column, ...], surface: Column) -> DataFrame:
        df = df.select(key, value.alias(name), F.struct(*(c.alias(n) for c, n in zip(edges, "wsen", strict=True))).alias(f"_b{name}"), surface.alias(f"_s{name}"))
        box = lambda n: F.floor(F.col(f"_b{name}.{n}") / size)
        return df.withColumn("_cx", F.explode(F.sequence(box("w"), box("e")))).withColumn("_cy", F.explode(F.sequence(box("s"), box("n"))))

    # bounds and surfaces are computed once for each area and cell, not for each pair
    shape = g.shape(areas)
    a = tiled(areas, area_key, "_a", shape, g.shape_bounds(shape), g.shape_area(shape))
    ring = g.outward("ring")
    c = tiled(cells, cell_key, "_c", ring, g.bounds("ring"), g.area("ring"))
    # a pair that meets in several grid cells counts in the one with its common lower left corner
    met = a.join(c, ["_cx", "_cy"]).where(
        (F.col("_cx") == F.floor(F.greatest("_b_a.w", "_b_c.w") / size)) & (F.col("_cy") == F.floor(F.greatest("_b_a.s", "_b_c.s") / size))
        & (F.col("_b_a.w") <= F.col("_b_c.e")) & (F.col("_b_c.w") <= F.col("_b_a.e")) & (F.col("_b_a.s") <= F.col("_b_c.n")) & (F.col("_b_c.s") <= F.col("_b_a.n"))
    )
    pieces = met.select(area_key, cell_key, g.shape_clipped_area("_a", "_c").alias("piece"), F.col("_s_a").alias("area_size"), F.col("_s_c").alias("cell_size"))
    return pieces.where("piece > 0")


def spread_by_source(areas: DataFrame, cells: DataFrame, values: Sequence[str], area_key: str, size: float, joined: str | None = None, prefix: str = "living_", cell_key: str = "hex_id") -> DataFrame:
    """Values of areas to the cells by share of the area's own surface (what lies outside all cells is lost); cells that meet none are left out."""
    pieces = overlaps(areas, cells, area_key, cell_key, size).join(areas.drop("ring", "rings"), area_key)
    flag = F.coalesce(F.col(joined), F.lit(False)) if joined else F.lit(False)
    share = F.col("piece") / F.col("area_size")
    out = pieces.groupBy(cell_key).agg(
        F.sum("piece").alias(f"{prefix}intersection_area_m2"), F.sum(F.when(flag, F.col("piece")).otherwise(0.0)).alias(f"{prefix}joined_intersection_area_m2"),
        *(F.sum(F.coalesce(F.col(v).cast("double"), F.lit(0.0)) * share).alias(f"{prefix}{v}") for v in values), F.first("cell_size").alias("_cell"),
    )
    return out.withColumns({
        f"{prefix}hex_coverage_ratio": F.col(f"{prefix}intersection_area_m2") / F.col("_cell"),
        f"{prefix}joined_coverage_ratio": F.col(f"{prefix}joined_intersection_area_m2") / F.col("_cell"),
    }).drop("_cell")


def spread_kept(areas: DataFrame, cells: DataFrame, values: Sequence[str], area_key: str, size: float, prefix: str = "registered_", cell_key: str = "hex_id") -> DataFrame:
    """Values of areas to the cells by share of the surface that cells cover, so each area that meets a cell keeps its sum; all cells, 0 where none."""
    pieces = cut(overlaps(areas, cells, area_key, cell_key, size))
    covered = pieces.groupBy(area_key).agg(F.sum("piece").alias("_covered"))
    pieces = pieces.join(covered.join(areas.drop("ring", "rings"), area_key), area_key).withColumn("_share", F.col("piece") / F.col("_covered"))
    sums = pieces.groupBy(cell_key).agg(
        F.sum("piece").alias(f"{prefix}intersection_area_m2"), *(F.sum(F.coalesce(F.col(v).cast("double"), F.lit(0.0)) * F.col("_share")).alias(v) for v in values)
    )
    out = cells.select(cell_key, g.area("ring").alias("_size")).join(sums, cell_key, "left").fillna(0.0, subset=[f"{prefix}intersection_area_m2", *values])
    return out.withColumn(f"{prefix}hex_coverage_ratio", F.coalesce(F.try_divide(f"{prefix}intersection_area_m2", "_size"), F.lit(0.0))).drop("_size")


def union_pieces(areas: DataFrame, key: str, tile: float) -> DataFrame:
    """(key, tile_x, tile_y, rings, area): the union of each key's shapes (ring or rings, which may overlap), as disjoint trapezoids in every tile.

    Shapes are cut by square tiles first, so a task unites what lies in one tile
    of one key, however large the whole is.
    """
    import pyarrow as pa

    from terrane.functions.union import trapezoids

    shapes = areas.select(key, g.shape(areas).alias("_s"))
    west, south, east, north = g.shape_bounds("_s")
    tiles = shapes.withColumn("tile_x", F.explode(F.sequence(_cell(west, tile), _cell(east, tile)))).withColumn("tile_y", F.explode(F.sequence(_cell(south, tile), _cell(north, tile))))
    box = g.box_ring(F.col("tile_x") * tile, F.col("tile_y") * tile, (F.col("tile_x") + 1) * tile, (F.col("tile_y") + 1) * tile)
    cuts = tiles.select(key, "tile_x", "tile_y", F.transform("_s", lambda r: g.clip(r, box)).alias("_s"))

    def unite(table: pa.Table) -> pa.Table:
        rings = [[(p["x"], p["y"]) for p in r] for s in table.column("_s").to_pylist() for r in s]
        pieces, area = trapezoids(rings)
        made = pa.array([[[{"x": x, "y": y} for x, y in p] for p in pieces]], type=pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
        first = table.slice(0, 1).select([key, "tile_x", "tile_y"])
        return first.append_column("rings", made).append_column("area", pa.array([area]))

    kind = shapes.schema[key].dataType.simpleString()
    return cuts.groupBy(key, "tile_x", "tile_y").applyInArrow(unite, f"`{key}` {kind}, tile_x long, tile_y long, rings {g.SHAPE}, area double").where("area > 0")


def hex_grid(mask: DataFrame, edge: float, size: float | None = None) -> DataFrame:
    """Hexagons (hex_id, q, r, x, y, ring) whose centre is strictly inside the mask's shapes, of which there may be many and which may overlap; holes stay free; an empty mask is an error."""
    if mask.isEmpty():
        raise ValueError("the mask is empty")
    mask = mask.select(g.shape(mask).alias("ring"))
    west, south, east, north = g.shape_bounds("ring")
    step = 1.5 * edge
    rows = mask.select("ring", F.explode(F.sequence(F.floor(south / step), F.ceil(north / step))).alias("r"), west.alias("w"), east.alias("e"))
    wide = 3**0.5 * edge
    across = rows.select("ring", "r", F.explode(F.sequence(F.floor(F.col("w") / wide - F.col("r") / 2), F.ceil(F.col("e") / wide - F.col("r") / 2))).alias("q"))
    x, y = g.hex_center("q", "r", edge)
    inside = across.withColumn("x", x).withColumn("y", y).where(g.shape_within("ring", F.col("x"), F.col("y"))).select("q", "r", "x", "y").distinct()
    return inside.select(g.hex_id("q", "r").alias("hex_id"), "q", "r", "x", "y", g.hex_ring("q", "r", edge).alias("ring"))


def stops_near(candidates: DataFrame, stops: DataFrame, key: str, radii: Sequence[float] = (300.0, 400.0)) -> DataFrame:
    """Candidates (key, x, y) with the number of stops within each radius and the distance of the nearest one in the widest."""
    widest = max(radii)
    there = stops.select(F.col("x").alias("_sx"), F.col("y").alias("_sy"), _cell(F.col("x"), widest).alias("_cx"), _cell(F.col("y"), widest).alias("_cy"))
    asked = candidates.withColumn("_cx", _around(F.col("x"), widest)).withColumn("_cy", _around(F.col("y"), widest)).join(there, ["_cx", "_cy"])
    d = F.hypot(F.col("_sx") - F.col("x"), F.col("_sy") - F.col("y"))
    sums = asked.groupBy(key).agg(*(F.count_if(d <= r).alias(f"stops_{r:g}m") for r in radii), F.min(F.when(d <= widest, d)).alias("nearest_stop_m"))
    return candidates.select(key).join(sums, key, "left").fillna(0, subset=[f"stops_{r:g}m" for r in radii])
