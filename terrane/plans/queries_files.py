"""Queries over sources and sinks: each writes rows of the test tables in a format and reads them back."""

from __future__ import annotations

import json
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import functions as F

from terrane.functions import geometry as g
from terrane.functions.store import run_dir
from terrane.plans.analog import rounded, view, with_views
from terrane.plans.registry import register
from terrane.sources import files, geopackage, manifest, shapefile, workbook


def shared(spark, name: str) -> str:
    """A new path that all executors see."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def local(spark, name: str) -> str:
    """A new path for formats that are one file written by the driver: in the shared folder where that is a plain path, else a temporary one of the driver."""
    base = run_dir(spark).removeprefix("file://")
    folder = Path(tempfile.mkdtemp()) if "://" in base else Path(base) / uuid.uuid4().hex
    folder.mkdir(parents=True, exist_ok=True)
    return str(folder / name)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("s01_s02_s06_s07_csv_scan", "select cast(s_suppkey as varchar) as s_suppkey, s_name, try_cast(case when s_suppkey % 9 = 0 then 'bad' else cast(s_nationkey as varchar) end as bigint) as nation from supplier")
def csv_scan(spark, sf_dir):
    """Many files by one pattern, some columns, a byte order mark, and a value that doesn't parse."""
    path = shared(spark, "csv")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 9 == 0, "bad").otherwise(F.col("s_nationkey").cast("string")).alias("s_nationkey"), "s_acctbal")
    rows.repartition(3).write.option("header", True).option("encoding", "UTF-8").csv(path)
    found = files.scan_csv(spark, f"{path}/*.csv", ["s_suppkey", "s_name", "s_nationkey"], "utf-8-sig")
    return found.select("s_suppkey", "s_name", F.col("s_nationkey").try_cast("long").alias("nation"))


@register("s03_first_rows", "select cast(s_suppkey as varchar) as s_suppkey, s_name from supplier order by supplier.s_suppkey limit 7")
def first_rows(spark, sf_dir):
    """The first rows of the first file that a pattern matches."""
    path = shared(spark, "csv")
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").orderBy("s_suppkey").coalesce(1).write.option("header", True).csv(path)
    return files.sample_csv(spark, f"{path}/part-*.csv", 7)


@register("s04_guarded_read", "select true as refused, n_regionkey, count(*) as n from nation group by n_regionkey")
def guarded_read(spark, sf_dir):
    """A file over the limit is refused; forced, it is gathered."""
    path = shared(spark, "csv")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").write.option("header", True).csv(path)
    try:
        files.eager_csv(spark, path, most_bytes=1)
        refused = False
    except files.LargeInputError:
        refused = True
    counts = files.eager_csv(spark, f"{path}/*.csv", most_bytes=1, force=True).groupby("n_regionkey").size()
    return spark.createDataFrame([(refused, int(k), int(n)) for k, n in counts.items()], "refused boolean, n_regionkey int, n long")


@register("s05_schema_probe", "select * from (values ('s_suppkey', 'int'), ('s_name', 'string'), ('s_acctbal', 'double')) t(name, kind)")
def schema_probe(spark, sf_dir):
    path = shared(spark, "csv")
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").cast("double")).write.option("header", True).csv(path)
    return spark.createDataFrame(list(files.probe_csv(spark, f"{path}/*.csv").items()), "name string, kind string")


@register("s08_network_nodes", with_views(" select node_id, x, y from nodes where node_id % 11 > 0 and node_id % 13 > 0", "nodes"))
def network_nodes(spark, sf_dir):
    """Nodes with a number for id and place; others are dropped."""
    path = shared(spark, "csv")
    n = view(spark, sf_dir, "nodes")
    n.select(F.when(F.col("node_id") % 11 == 0, "x").otherwise(F.concat(F.col("node_id").cast("string"), F.lit(".0"))).alias("node_id"), F.when(F.col("node_id") % 13 > 0, F.col("x")).alias("x"), "y").write.option("header", True).csv(path)
    return files.network_nodes(spark, f"{path}/*.csv")


@register("s09_parquet_columns", "select p_partkey, p_size from part")
def parquet_columns(spark, sf_dir):
    return files.scan_parquet(spark, f"{sf_dir}/part.parquet", ["p_partkey", "p_size"])


HOLED = """
select area_id, area_name, 700.0 * 500.0 - 200.0 * 350.0 as surface, 2 as rings, 8 as places from areas"""


def holed(spark, sf_dir):
    """Areas of 700 x 500 with a hole of 200 x 350."""
    a = view(spark, sf_dir, "areas")
    w, s = F.col("w"), F.col("s")
    outer, inner = g.box_ring(w, s, F.col("e"), F.col("n")), F.reverse(g.box_ring(w + 100, s + 50, w + 300, s + 400))
    return a.withColumn("rings", F.array(outer, inner)).drop("w", "s", "e", "n")


def measured(df):
    return df.select(F.col("area_id").cast("long").alias("area_id"), "area_name", g.shape_area("rings").alias("surface"), F.size("rings").alias("rings"), F.size(F.flatten("rings")).alias("places"))


@register("s10_k04_layers", rounded(with_views(HOLED + " union all select -1, 'other layer', 350000.0, 1, 4", "areas"), "surface"))
def layers(spark, sf_dir):
    """Two layers in one file, one of them written twice; holes stay."""
    path = local(spark, "layers.gpkg")
    rows = holed(spark, sf_dir).select("area_id", "area_name", "rings")
    other = spark.createDataFrame([(-1, "other layer")], "area_id long, area_name string").withColumn("rings", F.array(g.ring([(0, 0), (700, 0), (700, 500), (0, 500)])))
    geopackage.write_layer(rows.limit(3), path, "areas")
    geopackage.write_layer(rows, path, "areas")
    geopackage.write_layer(other, path, "other")
    return measured(geopackage.read_layer(spark, path, "areas")).union(measured(geopackage.read_layer(spark, path, "other")))


@register("s10_shapefile", rounded(with_views(HOLED, "areas"), "surface"))
def shapes(spark, sf_dir):
    """Attributes in cp949, polygons with holes."""
    path = local(spark, "areas.shp")
    shapefile.write_shapefile(holed(spark, sf_dir).select("area_id", F.concat(F.lit("가"), "area_name").alias("area_name"), "rings"), path)
    return measured(shapefile.read_shapefile(spark, path).withColumn("area_name", F.substring("area_name", 2, 99)))


@register("s14_source_registry", "select * from (values ('a', '/data/x.csv', false), ('b', '/other/*.csv', false), ('c', null, true)) t(name, place, unknown)")
def source_registry(spark, sf_dir):
    sources = manifest.Sources({"a": {"path": "x.csv"}, "b": {"glob": "/other/*.csv"}}, "/data")
    rows = []
    for name in "abc":
        try:
            found = sources.resolve(name)
            rows.append((name, found.get("path", found.get("glob")), False))
        except KeyError:
            rows.append((name, None, True))
    return spark.createDataFrame(rows, "name string, place string, unknown boolean")


@register("k01_k02_parquet_sink", "select count(*) as written, count(*) as rows, 2 as columns, sum(p_size) as total from part")
def parquet_sink(spark, sf_dir):
    """Rows are counted as they pass; the geometry column stays out."""
    path = shared(spark, "sink")
    written = files.write_parquet(table(spark, sf_dir, "part").select("p_partkey", "p_size", F.lit("POINT (0 0)").alias("geometry")), path)
    back = files.scan_parquet(spark, path)
    return back.agg(F.lit(written).cast("long").alias("written"), F.count("*").alias("rows"), F.lit(len(back.columns)).alias("columns"), F.sum("p_size").alias("total"))


@register("k03_csv_with_mark", "select cast(n_nationkey as varchar) as n_nationkey, n_name, true as marked from nation")
def csv_with_mark(spark, sf_dir):
    path = local(spark, "out.csv")
    files.write_csv_bom(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    marked = Path(path).read_bytes().startswith(b"\xef\xbb\xbf")
    return files.scan_csv(spark, path, encoding="utf-8-sig").withColumn("marked", F.lit(marked))


@register("k05_s13_report", "select count(*) as rows, sum(n_regionkey) as total, true as missing_is_empty from nation")
def report(spark, sf_dir):
    path = local(spark, "report.json")
    made = files.report_of(table(spark, sf_dir, "nation").agg(F.count("*").alias("rows"), F.sum("n_regionkey").alias("total")))
    files.write_report(made, path)
    back = files.read_report(path)
    return spark.createDataFrame([(back["rows"], back["total"], files.read_report(f"{path}.none") == {})], "rows long, total long, missing_is_empty boolean")


@register("k06_g08_features", rounded(with_views(" select area_name, 5 as outer_places, 5 as hole_places, round(w / 7, 6) as west, true as closed from areas", "areas"), "west"))
def features(spark, sf_dir):
    """GeoJSON lines from the tasks: corners that lie on a line go, rings are closed, holes stay, figures are rounded."""
    a = view(spark, sf_dir, "areas")
    w, s, e, n = (F.col(c) for c in "wsen")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    outer = F.array(point(w, s), point((w + e) / 2, s), point(e, s), point(e, n), point(w, n), point(w, (s + n) / 2))
    lines = geopackage.feature_lines(a.select("area_name", (w / 7).alias("west"), F.array(outer, F.reverse(g.box_ring(w + 100, s + 50, w + 300, s + 400))).alias("rings")), tolerance=0.5, zone=None)
    path = shared(spark, "features")
    lines.write.text(path)
    kind = "struct<properties:struct<area_name:string,west:double>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>"
    made = spark.read.text(path).select(F.from_json("value", kind).alias("f")).select("f.properties.*", F.col("f.geometry.coordinates").alias("c"))
    # the corner half way up the west side is the last place of its ring, which thinning keeps
    places = F.size(F.array_distinct(F.filter(F.col("c")[0], lambda p: p[1] != (F.col("c")[0][0][1] + F.col("c")[0][2][1]) / 2)))
    return made.select("area_name", (places + 1).alias("outer_places"), F.size(F.col("c")[1]).alias("hole_places"), "west", (F.element_at(F.col("c")[0], 1) == F.element_at(F.col("c")[0], -1)).alias("closed"))


@register("k07_markdown", "select n_nationkey + 3 as line, '| ' || n_nationkey || ' | ' || n_name || ' |' as text from nation union all select 1, '| n_nationkey | n_name |' union all select 2, '|---|---|'")
def markdown(spark, sf_dir):
    text = files.markdown_table(table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey"))
    return spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "line long, text string")


@register("k08_h15_manifest", "select 'pass' as fresh, 'inputs: in.json was changed' as later, true as same_id, 12 as keys, true as known_hash")
def run_manifest(spark, sf_dir):
    """A manifest holds; after an input has changed it says which."""
    path = local(spark, "in.json")
    root = Path(path).parent
    rows = [r.asDict() for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    Path(path).write_text(json.dumps(rows, default=str), encoding="utf-8")
    made, again = (manifest.build("run", {"x": 1}, [], [path], [root / "out.txt"], root) for _ in range(2))
    manifest.write(made, root / "m.json")
    fresh = manifest.validate(root / "m.json", root)["status"]
    Path(path).write_text("[]", encoding="utf-8")
    later = manifest.validate(root / "m.json", root)["problems"]
    known = manifest.stable_sha256({"b": 1, "a": "가"}) == manifest.stable_sha256({"a": "가", "b": 1})
    return spark.createDataFrame([(fresh, "; ".join(later), made["run_id"] == again["run_id"], len(set(manifest.REQUIRED) & set(made)), known)], "fresh string, later string, same_id boolean, keys int, known_hash boolean")


@register("h01_reuse_guard", "select * from (values ('same', true), ('other size', false), ('sample', false), ('no rows', false), ('file gone', false)) t(run, reusable)")
def reuse_guard(spark, sf_dir):
    path = local(spark, "out.txt")
    Path(path).write_text("x", encoding="utf-8")
    done = {"status": "complete", "max_rows": None, "source_bytes": 5, "rows": 3}
    cases = [("same", done, [path], 5, None), ("other size", done, [path], 6, None), ("sample", done, [path], 5, 10), ("no rows", done | {"rows": 0}, [path], 5, None), ("file gone", done, [f"{path}.none"], 5, None)]
    return spark.createDataFrame([(name, manifest.reusable(*rest)) for name, *rest in cases], "run string, reusable boolean")


@register("s11_x10_x03_workbook", "select n_name as admin_name, r_name as district_name, n_nationkey * 1000 as registered_population, n_nationkey * 10 as registered_senior_population from nation join region on n_regionkey = r_regionkey where n_nationkey < 26")
def population_workbook(spark, sf_dir):
    """A workbook of shared and inline strings whose second sheet lists regions (as districts) and their nations; headings have blanks."""
    path = local(spark, "pop.xlsx")
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_regionkey", "n_nationkey").collect()
    rows, last = [[], ["구분", "총 인구", "65세 이상 총인구"], [None, "계", "계"], ["서울시", "1", "1"]], None
    names = list(workbook_districts())
    for r in nations:
        if r["n_regionkey"] != last:
            rows.append([names[r["n_regionkey"]], "1", "1"])
            last = r["n_regionkey"]
        rows.append([r["n_name"], f"{r['n_nationkey'] * 1000:,}", str(r["n_nationkey"] * 10)])
    workbook.write_workbook(path, {"표지": [], "2-1": rows})
    from terrane.plans import commands

    found = commands.extract_registered_population(spark, path)
    regions = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("_r"))
    named = spark.createDataFrame([(k, n) for k, n in enumerate(names[:25])], "r_regionkey int, district_name string")
    return found.join(named, "district_name").join(regions, "r_regionkey").select("admin_name", F.col("_r").alias("district_name"), "registered_population", "registered_senior_population")


def workbook_districts():
    from terrane.operators import population

    return population.DISTRICTS.values()
