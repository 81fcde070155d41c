"""Queries over points, cells and areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import geometry as g
from terrane.operators import population as pop
from terrane.operators import routing, spatial
from terrane.plans import commands
from terrane.plans.analog import rounded, view, with_views
from terrane.plans.registry import register


def boxes(spark, sf_dir, name):
    return view(spark, sf_dir, name).withColumn("ring", g.box_ring(F.col("w"), F.col("s"), F.col("e"), F.col("n"))).drop("w", "s", "e", "n")


@register("j10_snap", rounded(with_views("""
select point_id, node_id, distance from points left join (
  select point_id, node_id, distance from (select p.point_id, q.node_id, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) as distance, min(distance) over (partition by p.point_id) as best
    from points p join nodes q on abs(p.x - q.x) <= 300 and abs(p.y - q.y) <= 300) where distance <= 300 and distance = best) using (point_id)""", "points", "nodes"), "distance"))  # fmt: skip
def snap(spark, sf_dir):
    return spatial.snap(view(spark, sf_dir, "points"), view(spark, sf_dir, "nodes"), ["point_id"], 300.0)


@register("j11_j06_nearest", rounded(with_views("""
select point_id, node_id, distance from (select p.point_id, q.node_id, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) as distance, row_number() over (partition by p.point_id order by distance, q.node_id) as r from points p, nodes q) where r = 1""", "points", "nodes"), "distance"))  # fmt: skip
def nearest(spark, sf_dir):
    return spatial.nearest(view(spark, sf_dir, "points"), view(spark, sf_dir, "nodes"), "point_id", "node_id", 400.0)


@register("j12_poi_counts", with_views("""
select hex_id, coalesce(a, 0) as shop_poi_count, coalesce(b, 0) as park_poi_count, coalesce(a, 0) + coalesce(b, 0) as poi_total_count
from squares left join (select hex_id, count(*) as a from squares join points on x > w and x < e and y > s and y < n where point_id % 3 > 0 group by 1) using (hex_id)
left join (select hex_id, count(*) as b from squares join points on x > w and x < e and y > s and y < n where point_id % 3 = 0 group by 1) using (hex_id)""", "squares", "points"))  # fmt: skip
def poi_counts(spark, sf_dir):
    p = view(spark, sf_dir, "points")
    return spatial.count_points(boxes(spark, sf_dir, "squares"), {"shop": p.where("point_id % 3 > 0"), "park": p.where("point_id % 3 = 0")}, 400.0)


@register("j13_j14_j17_labels", with_views("""
select hex_id, min(area_name) as area_name from squares left join (select area_name, w as aw, e as ae, s as a_s, n as an from areas) on (w + e) / 2 between aw and ae and (s + n) / 2 between a_s and an group by hex_id""", "squares", "areas"))  # fmt: skip
def labels(spark, sf_dir):
    return spatial.label(boxes(spark, sf_dir, "squares"), boxes(spark, sf_dir, "areas"), ["area_name"], 800.0).select("hex_id", "area_name")


@register("j16_boundary_split", with_views(" select point_id, x between 1000 and 6000 and y between 2000 and 7000 as inside from points", "points"))
def split(spark, sf_dir):
    one = spark.range(1).select(g.ring([(1000, 2000), (6000, 2000), (6000, 7000), (1000, 7000)]).alias("ring"))
    inside, outside = spatial.split_by_boundary(view(spark, sf_dir, "points"), one)
    return inside.select("point_id", F.lit(True).alias("inside")).union(outside.select("point_id", F.lit(False)))


PIECES = """, pieces as (
  select area_id, hex_id, pop, joined, greatest(0, least(a.e, q.e) - greatest(a.w, q.w)) * greatest(0, least(a.n, q.n) - greatest(a.s, q.s)) as piece, (a.e - a.w) * (a.n - a.s) as area, 160000.0::double as cell
  from areas a join squares q on a.w < q.e and q.w < a.e and a.s < q.n and q.s < a.n)
"""


@register("j15_overlaps", rounded(with_views(PIECES + "select area_id, hex_id, piece, area as area_size, cell as cell_size from pieces where piece > 0", "areas", "squares"), "piece", "area_size", "cell_size"))
def overlaps(spark, sf_dir):
    return spatial.overlaps(boxes(spark, sf_dir, "areas"), boxes(spark, sf_dir, "squares"), "area_id", "hex_id", 800.0)


@register("a08_living_spread", rounded(with_views(PIECES + """
select hex_id, sum(piece) as living_intersection_area_m2, sum(case when joined then piece else 0 end) as living_joined_intersection_area_m2, sum(pop * piece / area) as living_pop,
  sum(piece) / 160000 as living_hex_coverage_ratio, sum(case when joined then piece else 0 end) / 160000 as living_joined_coverage_ratio from pieces where piece > 0 group by 1""", "areas", "squares"),
    "living_intersection_area_m2", "living_joined_intersection_area_m2", "living_pop", "living_hex_coverage_ratio", "living_joined_coverage_ratio"))
def living_spread(spark, sf_dir):
    return spatial.spread_by_source(boxes(spark, sf_dir, "areas"), boxes(spark, sf_dir, "squares"), ["pop"], "area_id", 800.0, joined="joined")


@register("a09_a10_kept_spread", rounded(with_views(PIECES + """
select hex_id, coalesce(sum(piece), 0) as registered_intersection_area_m2, coalesce(sum(pop * piece / covered), 0) as pop, coalesce(sum(piece), 0) / 160000 as registered_hex_coverage_ratio
from squares left join (select *, sum(piece) over (partition by area_id) as covered from pieces where piece > 0) using (hex_id) group by 1""", "areas", "squares"), "registered_intersection_area_m2", "pop", "registered_hex_coverage_ratio"))  # fmt: skip
def kept_spread(spark, sf_dir):
    return spatial.spread_kept(boxes(spark, sf_dir, "areas"), boxes(spark, sf_dir, "squares"), ["pop"], "area_id", 800.0)


@register("a37_stops_near", rounded(with_views("""
select point_id, count(*) filter (d <= 300) as stops_300m, count(*) filter (d <= 400) as stops_400m, min(d) filter (d <= 400) as nearest_stop_m
from (select point_id, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) as d from points p left join nodes q on abs(p.x - q.x) <= 400 and abs(p.y - q.y) <= 400) group by 1""", "points", "nodes"), "nearest_stop_m"))  # fmt: skip
def stops_near(spark, sf_dir):
    return spatial.stops_near(view(spark, sf_dir, "points"), view(spark, sf_dir, "nodes"), "point_id")


@register("a07_dissolve", "select substr(cast(1123051000 + n_nationkey as varchar), 1, 9) as k, string_agg(distinct n_name, ',' order by n_name) as n_names, count(*) as parts, min(string_split(n_name, ' ')[1]) as district, 5.0 * (max(n_nationkey) + 5 - min(n_nationkey)) as area from nation group by 1")
def dissolve(spark, sf_dir):
    """Areas of 5 x 5 that overlap in a row: their union counts shared surface once."""
    k = F.col("n_nationkey").cast("double")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    outer = g.box_ring(k, F.lit(0.0), k + 5, F.lit(5.0))
    return pop.dissolve(n.withColumn("rings", F.array(outer)), F.substring((F.lit(1123051000) + F.col("n_nationkey")).cast("string"), 1, 9), "k", ["n_name"], tile=3.0).select("k", "n_names", "parts", "district", "area")


@register("g06_area_centroid", rounded(with_views(" select hex_id, 160000.0::double as area, (w + e) / 2 as cx, (s + n) / 2 as cy from squares", "squares"), "area", "cx", "cy"))
def area_centroid(spark, sf_dir):
    x, y = g.centroid("ring")
    return boxes(spark, sf_dir, "squares").select("hex_id", g.area("ring").alias("area"), x.alias("cx"), y.alias("cy"))


def with_holes(spark, sf_dir):
    """Areas of 700 x 500 with a hole of 200 x 350."""
    a, w, s = view(spark, sf_dir, "areas"), F.col("w"), F.col("s")
    return a.withColumn("rings", F.array(g.box_ring(w, s, F.col("e"), F.col("n")), F.reverse(g.box_ring(w + 100, s + 50, w + 300, s + 400))))


@register("g02_g05_g09_c06_hex_grid", rounded(with_views("""
, cells as (
  select distinct q, r, 300 * (sqrt(3) * q + sqrt(3) / 2 * r) as x, 450.0 * r as y from (
    select *, unnest(range(cast(floor(w / (sqrt(3) * 300) - r / 2.0) as bigint), cast(ceil(e / (sqrt(3) * 300) - r / 2.0) as bigint) + 1)) as q
    from (select *, unnest(range(cast(floor(s / 450.0) as bigint), cast(ceil(n / 450.0) as bigint) + 1)) as r from areas))
  where 300 * (sqrt(3) * q + sqrt(3) / 2 * r) > w and 300 * (sqrt(3) * q + sqrt(3) / 2 * r) < e and 450.0 * r > s and 450.0 * r < n
    and not (300 * (sqrt(3) * q + sqrt(3) / 2 * r) between w + 100 and w + 300 and 450.0 * r between s + 50 and s + 400))
select q || ':' || r as hex_id, x, y, 1.5 * sqrt(3) * 90000 as area, count(*) over () as cells from cells""", "areas"), "x", "y", "area"))  # fmt: skip
def hex_grid(spark, sf_dir):
    """Hexagons of 300 m edges over areas that overlap and have holes."""
    made = commands.build_analysis_hexes(with_holes(spark, sf_dir).select("rings"), 300.0)
    return made.select("hex_id", "x", "y", g.area("ring").alias("area")).crossJoin(F.broadcast(made.agg(F.count("*").alias("cells"))))


@register("g06_j13_inner_points", rounded(with_views("""
, best as (select area_id, w + 500 as x, s + 225 as y from areas), labels as (select area_name as label, w as aw, e as ae, s as a_s, n as an from areas)
select area_id, x, y, 280000.0::double as surface, w + (350 * 350000 - 200 * 70000) / 280000.0 as cx, (select min(label) from labels where x between aw and ae and y between a_s and an and not (x > aw + 100 and x < aw + 300 and y > a_s + 50 and y < a_s + 400)) as label
from areas join best using (area_id)""", "areas"), "x", "y", "surface", "cx"))  # fmt: skip
def inner_points(spark, sf_dir):
    """A point inside each area, which its centre may not be; surface and centre without the hole; the label at the point."""
    a = with_holes(spark, sf_dir)
    cx, _ = g.shape_centroid("rings")
    named = spatial.label(a.select(F.col("area_id").alias("hex_id"), "rings"), a.select(F.col("area_name").alias("label"), "rings"), ["label"], 800.0, point="inner")
    return g.with_inner_point(a, "rings").select("area_id", "x", "y", g.shape_area("rings").alias("surface"), cx.alias("cx")).join(named.select(F.col("hex_id").alias("area_id"), "label"), "area_id")


@register("j12_j17_holed_counts", with_views(" select area_id, count(point_id) as points from areas left join points on x > w and x < e and y > s and y < n and not (x between w + 100 and w + 300 and y between s + 50 and s + 400) group by 1", "areas", "points"))
def holed_counts(spark, sf_dir):
    """Points strictly inside each area and outside its hole."""
    a = with_holes(spark, sf_dir)
    found = spatial.counted_within(view(spark, sf_dir, "points"), a.select("area_id", "rings"), "area_id", 400.0)
    return a.select("area_id").join(found, "area_id", "left").fillna(0, subset=["points"])


@register("g07_reach_gaps", with_views("""
, near as (select a.node_id as source, b.node_id as node, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as d from nodes a join nodes b on abs(a.x - b.x) <= 900 and abs(a.y - b.y) <= 900)
select source, node, case when source = node or 2 * d <= 900 then 'reached' when 1.2 * d <= 900 then 'slope' else 'detour' end as gap from near where d <= 900""", "nodes"))  # fmt: skip
def reach_gaps(spark, sf_dir):
    """Nodes in a circle that are out of reach by detour or by slope, on a network of direct streets, flat 1.2 and hard 2 times as long as the crow flies."""
    n = view(spark, sf_dir, "nodes")
    streets = spatial.within_distance(n.select(F.col("node_id").alias("u"), "x", "y"), n.select(F.col("node_id").alias("v"), "x", "y"), 900.0).where("u != v")
    streets = streets.select("u", "v", "distance", (F.col("distance") * 1.2).alias("cost_m0"), (F.col("distance") * 2).alias("cost_m3"))
    return routing.reach_gaps(n, streets, n.select(F.col("node_id").alias("node")), 900.0)


def projected_sql(name: str, source: str, lon: str, lat: str, others: str, zone: int = 5179) -> str:
    """Expressions up to `name` (others, x, y) that project the source's degrees, by the same series as geometry.project()."""
    meridian, _, scale, east, north = g.ZONES[zone]
    n = g._N
    e = 2 * n**0.5 / (1 + n)
    xs = "eta" + "".join(f" + {a!r}::double * cos({2 * (k + 1)} * xi) * sinh({2 * (k + 1)} * eta)" for k, a in enumerate(g._ALPHA))
    ys = "xi" + "".join(f" + {a!r}::double * sin({2 * (k + 1)} * xi) * cosh({2 * (k + 1)} * eta)" for k, a in enumerate(g._ALPHA))
    return f"""{name}_1 as (select {others}, sin(radians({lat})) as sine, radians({lon} - {meridian}) as away from {source}),
{name}_2 as (select *, sinh(atanh(sine) - {e!r}::double * atanh({e!r}::double * sine)) as t from {name}_1),
{name}_3 as (select *, atan2(t, cos(away)) as xi, atanh(sin(away) / sqrt(1 + t * t)) as eta from {name}_2),
{name} as (select {others}, {east} + {scale}::double * {g._RADIUS!r}::double * ({xs}) as x, {north} + {scale}::double * ({g._RADIUS!r}::double * ({ys}) - {g._northing_of_origin(g.ZONES[zone][1])!r}::double) as y from {name}_3)"""


@register("g01_projection", rounded(with_views(", " + projected_sql("placed", "(select point_id, 126.0 + x / 5000 as lon, 36.0 + y / 5000 as lat from points)", "lon", "lat", "point_id") + """
select point_id, x, y, 0.0::double as error_lon, 0.0::double as error_lat from placed""", "points"), "x", "y", digits=3), digits=3)  # fmt: skip
def projection(spark, sf_dir):
    """Degrees to metres and back: the error of the round trip in degrees."""
    p = view(spark, sf_dir, "points").select("point_id", (126.0 + F.col("x") / 5000).alias("lon"), (36.0 + F.col("y") / 5000).alias("lat"))
    x, y = g.project("lon", "lat")
    p = p.withColumn("x", x).withColumn("y", y)
    lon, lat = g.unproject("x", "y")
    return p.select("point_id", "x", "y", (lon - F.col("lon")).alias("error_lon"), (lat - F.col("lat")).alias("error_lat"))


@register("s12_wkt_lines", rounded(with_views(" select point_id, sqrt(x * x + y * y) as length from points", "points"), "length"))
def wkt_lines(spark, sf_dir):
    p = view(spark, sf_dir, "points").select("point_id", F.concat(F.lit("LINESTRING (0 0, "), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")")).alias("wkt"))
    return p.select("point_id", g.line_length(g.line_from_wkt("wkt")).alias("length"))
