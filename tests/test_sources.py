"""Files, workbooks, layers, manifests, commands and incremental figures."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from terrane.functions import geometry as g
from terrane.plans import commands
from terrane.sources import files, geopackage, manifest, workbook
from terrane.streaming import incremental


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,name\n1,가\n2,나\n".encode())
    (tmp_path / "b.csv").write_bytes("id,name\n3,다\n".encode("cp949"))
    assert [tuple(r) for r in files.scan_csv(spark, str(tmp_path / "a.csv"), ["name", "id"], "utf-8-sig").collect()] == [("가", "1"), ("나", "2")]
    assert files.scan_csv(spark, str(tmp_path / "b.csv"), encoding="cp949").first().name == "다"
    assert files.sample_csv(spark, str(tmp_path / "*.csv"), 1).count() == 1
    assert files.probe_csv(spark, str(tmp_path / "a.csv"))["id"] == "int"
    assert len(files.eager_csv(spark, str(tmp_path / "a.csv"))) == 2
    with pytest.raises(files.LargeInputError):
        files.eager_csv(spark, str(tmp_path / "a.csv"), most_bytes=3)
    with pytest.raises(FileNotFoundError):
        files.sample_csv(spark, str(tmp_path / "none*.csv"))
    df = spark.createDataFrame([(1, "가", 2.5)], "id int, name string, geometry double")
    assert files.write_parquet(df, str(tmp_path / "p")) == 1 and files.scan_parquet(spark, str(tmp_path / "p")).columns == ["id", "name"]
    files.write_csv_bom(df, str(tmp_path / "out.csv"))
    assert (tmp_path / "out.csv").read_bytes().startswith(b"\xef\xbb\xbfid,name")
    assert files.read_report(str(tmp_path / "none.json")) == {}
    files.write_report({"a": "가"}, str(tmp_path / "r" / "x.json"))
    assert files.read_report(str(tmp_path / "r" / "x.json")) == {"a": "가"}
    assert files.markdown_table(df).count("\n") == 2


def make_workbook(path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = [
        (5, ["구분", "총 인구", "65세 이상 총인구", "비고"]), (6, [None, "계", "계", None]), (7, ["서울시", "2100", "420"]), (8, ["종로구", "2100", "420"]), (9, ["사직동", "100", "20"]), (10, ["삼청동", "2,000", "400"]),
    ]
    shared = ["구분"]
    body = ""
    for number, cells in rows:
        body += f'<row r="{number}">'
        for k, x in enumerate(cells):
            if x is not None:
                ref = f"{'ABCD'[k]}{number}"
                body += f'<c r="{ref}" t="s"><v>0</v></c>' if x == shared[0] else f'<c r="{ref}" t="inlineStr"><is><t>{x}</t></is></c>'
        body += "</row>"
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="표지" sheetId="1" r:id="r1"/><sheet name="2-1" sheetId="2" r:id="r2"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>{shared[0]}</t></si></sst>")
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData/></worksheet>")
        book.writestr("xl/worksheets/sheet2.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    make_workbook(tmp_path / "pop.xlsx")
    got = commands.extract_registered_population(spark, str(tmp_path / "pop.xlsx"))
    assert sorted(tuple(r)[:4] for r in got.collect()) == [("사직동", "종로구", 100, 20), ("삼청동", "종로구", 2000, 400)]
    assert commands.registered_quality(got)["population"] == 2100
    spark.dataSource.register(workbook.WorkbookSource)
    assert spark.read.format("workbook").option("sheet", "2-1").load(str(tmp_path / "pop.xlsx")).where("row_idx = 5").count() == 4
    assert workbook.column_number("AA7") == 26
    with pytest.raises(ValueError, match="no sheet"):
        workbook.choose_sheet([], None)


def test_geopackage(spark, tmp_path):
    cells = spark.createDataFrame([("h1", 1.5), ("h2", None)], "hex_id string, v double").withColumn("ring", g.ring([(0, 0), (10, 0), (10, 10), (0, 10)]))
    path = str(tmp_path / "x.gpkg")
    assert geopackage.write_layer(cells, path, "cells") == 2
    assert geopackage.write_layer(cells.where("hex_id = 'h1'"), path, "other") == 1
    back = geopackage.read_layer(spark, path, "cells").withColumn("ring", F.col("rings")[0])
    assert sorted((r.hex_id, r.v, r.a) for r in back.select("hex_id", "v", g.area("ring").alias("a")).collect()) == [("h1", 1.5, 100.0), ("h2", None, 100.0)]
    geopackage.write_features(cells, str(tmp_path / "x.geojson"), zone=None)
    features = json.loads((tmp_path / "x.geojson").read_text())["features"]
    assert len(features) == 2 and features[0]["geometry"]["coordinates"][0][0] == features[0]["geometry"]["coordinates"][0][-1]
    assert geopackage.simplified([(0, 0), (1, 0.01), (2, 0), (3, 5), (4, 0)], 0.1) == [(0, 0), (2, 0), (3, 5), (4, 0)]


def test_manifest(tmp_path):
    (tmp_path / "in.txt").write_text("a")
    made = manifest.build("run", {"x": 1}, [], [tmp_path / "in.txt"], [tmp_path / "out.txt"], tmp_path)
    again = manifest.build("run", {"x": 1}, [], [tmp_path / "in.txt"], [tmp_path / "out.txt"], tmp_path)
    assert made["run_id"] == again["run_id"] and set(manifest.REQUIRED) <= set(made)
    manifest.write(made, tmp_path / "m.json")
    assert manifest.validate(tmp_path / "m.json", tmp_path)["status"] == "pass"
    (tmp_path / "in.txt").write_text("b")
    assert manifest.validate(tmp_path / "m.json", tmp_path)["problems"] == ["inputs: in.txt was changed"]
    (tmp_path / "in.txt").write_text("a")
    (tmp_path / "out.txt").write_text("now here")
    assert "has come" in manifest.validate(tmp_path / "m.json", tmp_path)["problems"][0]
    made["arguments"]["x"] = 2
    manifest.write(made, tmp_path / "m.json")
    assert commands.main(["validate-run-manifest", "--table", f"manifest={tmp_path}/m.json", "--table", f"root={tmp_path}", "--strict"]) == 1
    report = {"status": "complete", "max_rows": None, "source_bytes": 5, "rows": 3}
    assert manifest.reusable(report, [tmp_path / "in.txt"], 5, None) and not manifest.reusable(report, [tmp_path / "in.txt"], 6, None)
    with pytest.raises(KeyError):
        manifest.Sources({"a": {"path": "x.csv"}}, "/data").resolve("b")
    assert manifest.Sources({"a": {"path": "x.csv"}}, "/data").resolve("a")["path"] == "/data/x.csv"


def test_commands(spark, tmp_path):
    cells = spark.createDataFrame([("h1", 0.0), ("h2", 100.0), ("h3", 200.0)], "hex_id string, w double").withColumn("ring", g.box_ring(F.col("w"), F.lit(0.0), F.col("w") + 100, F.lit(100.0))).drop("w")
    living = cells.select(F.col("hex_id").alias("CELL_ID"), "ring", F.lit(True).alias("livingpop_joined"), (F.ascii(F.substring("hex_id", 2, 1)) * 1.0).alias("mean_living_population"), F.lit(2.0).alias("mean_senior_population"))
    pois = spark.createDataFrame([(50.0, 50.0), (150.0, 50.0), (160.0, 50.0)], "x double, y double")
    registered = cells.select(F.col("hex_id").alias("code"), "ring", F.lit(100.0).alias("registered_population"), F.lit(10.0).alias("registered_senior_population"))
    demand = commands.build_demand(cells, living, {"shop": pois}, registered)
    assert demand.count() == 3 and demand.agg(F.sum("registered_population")).first()[0] == pytest.approx(300)
    nodes = spark.createDataFrame([(1, 50.0, 50.0), (2, 150.0, 50.0), (3, 250.0, 50.0)], "node_id long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 100.0, 5.0), (2, 3, 100.0, 1.0)], "u long, v long, length_m double, grade_abs_percent double")
    stops = spark.createDataFrame([("s", 251.0, 50.0)], "stop_id string, x double, y double")
    access = commands.build_accessibility(cells, nodes, commands.build_edge_costs(edges, rain_mm=2.0), stops)
    assert {r.hex_id: r.access_cost_m0 for r in access.collect()} == {"h1": 200.0, "h2": 100.0, "h3": 0.0}
    final = commands.build_vulnerability(demand, access, q=0.5).cache()
    checks = commands.validate_vulnerability(final, final, commands.score_report(final))
    assert checks["hex_id_is_unique"] and checks["ids_equal"]
    assert commands.export_shortlist(final).columns[:2] == ["rank", "hex_id"]
    assert commands.export_diagnostics(final)[1].count() >= 0 and commands.build_typology(final)[0].count() == 3
    edges.write.parquet(str(tmp_path / "edges"))
    assert commands.main(["build-edge-costs", "--table", f"edges={tmp_path}/edges", "--set", "rain_mm=2.0", "--out", str(tmp_path / "costs")]) == 0
    assert spark.read.parquet(str(tmp_path / "costs")).count() == 2 and (tmp_path / "costs.manifest.json").exists()
    (tmp_path / "poi.csv").write_text("lon,lat\n1,2\n")
    assert commands.validate_data(spark, {"poi": str(tmp_path / "poi.csv")})["ok"]
    assert commands.profile_data(spark, {"poi": str(tmp_path / "poi.csv"), "gone": str(tmp_path / "no.csv")}).count() == 2


def test_incremental_grid(spark, tmp_path):
    folder = tmp_path / "days"
    folder.mkdir()
    schema = spark.createDataFrame([], "grid string, hour int, living double, old double").schema
    partial = lambda df: incremental.grid_partials(df, "grid", "hour", "living", ["old"])
    for day in range(2):
        (folder / f"{day}.csv").write_text("grid,hour,living,old\n" + "".join(f"g{k % 2},{(k * 7 + day) % 24},{k}.5,1\n" for k in range(20)))
        for _ in range(2):  # a run without new files adds nothing
            incremental.ingest(spark, str(folder), schema, partial, str(tmp_path / "parts"), str(tmp_path / "check"))
    got = incremental.merged_grid(spark.read.parquet(str(tmp_path / "parts")))
    from terrane.operators.population import summarise_grid

    want = summarise_grid(spark.read.schema(schema).option("header", True).csv(str(folder)), "grid", "hour", "living", ["old"])
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(sorted(df.columns)).collect())
    assert key(got) == key(want)
