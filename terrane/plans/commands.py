"""The command surface: each command is a function of frames; `python -m terrane` runs it over Parquet tables.

A command that gives a table writes it to --out; one that checks prints a report
and ends with 1 where a strict check fails. Every written table gets a manifest
of its arguments beside it.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import geometry as g
from terrane.functions import stats
from terrane.functions.cleaning import dong_key, select_existing, standard_name
from terrane.operators import edges as edge_ops
from terrane.operators import population as pop
from terrane.operators import reports, routing, spatial
from terrane.operators import vulnerability as vul
from terrane.sources import files, manifest, workbook

COST_COLUMNS = ("cost_m0", "cost_m1", "cost_m2", "cost_m3")
#: Grid cells (metres) of spatial joins.
TILE = 500.0


def profile_data(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """Name, path, bytes and columns of each source; what cannot be read is said so."""
    rows = []
    for name, path in sources.items():
        try:
            found = files._files(spark, path)
            rows.append((name, path, sum(n for _, n in found), json.dumps(files.probe_csv(spark, found[0][0]), ensure_ascii=False)))
        except Exception as error:  # a source that is not there is part of the profile
            rows.append((name, path, None, f"unreadable: {type(error).__name__}"))
    return spark.createDataFrame(rows, "name string, path string, bytes long, columns string")


def validate_data(spark: SparkSession, sources: dict[str, str], rows: int = 100) -> dict:
    """Contract issues of a sample of every file of every source; FileNotFoundError where a pattern matches nothing."""
    report = {}
    for name, pattern in sources.items():
        found = files._files(spark, pattern)
        if not found:
            raise FileNotFoundError(pattern)
        report[name] = {path: reports.contract_issues(files.scan_csv(spark, path).limit(rows), name) for path, _ in found}
    return {"ok": not any(issues for per in report.values() for issues in per.values()), "sources": report}


def build_edge_costs(edges: DataFrame, rain_mm: float = 0.0, snow_cm: float = 0.0) -> DataFrame:
    return edge_ops.with_costs(edges, rain_mm, snow_cm)


def build_edge_cost_sample(edges: DataFrame, rows: int = 1000, rain_mm: float = 0.0, snow_cm: float = 0.0) -> DataFrame:
    return edge_ops.sample_costs(edges, rows, rain_mm=rain_mm, snow_cm=snow_cm)


def build_analysis_hexes(mask: DataFrame, edge_m: float = 200.786) -> DataFrame:
    """Planar hexagons whose edge matches the mean of resolution 9."""
    return spatial.hex_grid(mask, edge_m)


def build_transit_candidates(bus: DataFrame, subway: DataFrame, boundary: DataFrame, buffer_m: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Bus and subway stops with projected places, inside the boundary and outside."""
    stops = pop.stop_candidates(pop.normalised_stops(bus, "bus"), "bus", "stop_id", "stop_name", flags=("coord_valid", "location_matched"))
    stops = stops.unionByName(pop.stop_candidates(pop.normalised_stops(subway, "subway"), "subway", "stop_id", "stop_name"))
    x, y = g.project("lon", "lat")
    return spatial.split_by_boundary(stops.withColumn("x", x).withColumn("y", y), boundary, buffer_m)


def aggregate_local_resident(rows: DataFrame) -> DataFrame:
    names = pop.GRID_COLUMNS
    seniors = [c for c in pop.SENIOR_COLUMNS if c in rows.columns]
    return pop.summarise_grid(rows, names["grid"], names["hour"], names["living"], seniors)


def join_local_resident(cells: DataFrame, summary: DataFrame, key: str = "CELL_ID") -> DataFrame:
    return pop.join_grid(cells, summary, key)


def extract_registered_population(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    found = workbook.read_workbook(spark, path, sheet)
    return pop.registered_rows(workbook.population_sheet(found))


def registered_quality(registered: DataFrame) -> dict:
    """Rows, totals and names that stand in several districts."""
    row = registered.agg(F.count("*").alias("rows"), F.sum("registered_population").alias("population"), F.sum("registered_senior_population").alias("senior_population"), F.countDistinct("admin_name").alias("names"))
    return files.report_of(row) | {"repeated_names": [r[0] for r in reports.repeated(registered, ["admin_name"]).select("admin_name").distinct().orderBy("admin_name").collect()]}


def build_registered_layer(boundary: DataFrame, registered: DataFrame, aliases: DataFrame) -> DataFrame:
    return pop.register_by_boundary(boundary, registered, aliases)


def registered_key_issues(boundary: DataFrame, registered: DataFrame) -> DataFrame:
    a = boundary.select("district_name", standard_name("admin_name").alias("key"))
    return pop.unmatched_keys(a, registered.select("district_name", dong_key("admin_name").alias("key")), ["district_name", "key"])


LIVING = ("mean_living_population", "mean_senior_population")


def build_demand(cells: DataFrame, living: DataFrame, pois: dict[str, DataFrame], registered: DataFrame | None = None, living_key: str = "CELL_ID", admin_key: str = "code") -> DataFrame:
    """Preliminary index (three axes), or final (four) with registered population."""
    spread = spatial.spread_by_source(living, cells, LIVING, living_key, TILE, joined="livingpop_joined")
    counts = spatial.count_points(cells, pois, TILE)
    kept = None if registered is None else spatial.spread_kept(registered, cells, ("registered_population", "registered_senior_population"), admin_key, TILE)
    return pop.demand_features(cells.drop("ring"), spread, counts, kept)


def build_accessibility(cells: DataFrame, nodes: DataFrame, edges: DataFrame, stops: DataFrame, most_m: float = 100.0) -> DataFrame:
    """Cells (hex_id, ring) snapped to nodes and routed to the nodes of stops (x, y) under all four costs."""
    x, y = g.centroid("ring")
    origins = spatial.snap(cells.select("hex_id", x.alias("x"), y.alias("y")), nodes, ["hex_id"], most_m, unique=True)
    origins = origins.select("hex_id", F.col("node_id").alias("origin_node_id"), F.col("distance").alias("snap_distance_m"))
    goals = spatial.snap(stops.select("stop_id", "x", "y"), nodes, ["stop_id"], most_m, unique=True).where("node_id is not null").select(F.col("node_id").alias("node")).distinct()
    return routing.cell_access(cells.drop("ring"), origins, routing.nearest_cost(edges, goals, COST_COLUMNS), COST_COLUMNS)


def build_vulnerability(demand: DataFrame, accessibility: DataFrame, suffix: str = "final", q: float = 0.8) -> DataFrame:
    joined = demand.join(accessibility, "hex_id", "left")
    return vul.score(joined, f"demand_index_{suffix}", suffix, q=q)


def build_typology(cells: DataFrame, suffix: str = "final") -> tuple[DataFrame, DataFrame]:
    typed = vul.classify(cells, suffix)
    return typed, vul.summarise_types(typed)


def validate_vulnerability(cells: DataFrame, other: DataFrame | None = None, quality: dict | None = None, suffix: str = "final", tolerance: float = 1e-9) -> dict:
    """Audit of the table; that another copy has the same ids; that a report's figures are those of the table."""
    checks = files.report_of(vul.audit(cells, suffix))
    if other is not None:
        checks["ids_equal"] = reports.same_rows(cells.select("hex_id"), other.select("hex_id"))
    for key, value in (quality or {}).items():
        if key in checks:
            same = value == checks[key] if not isinstance(value, float) or checks[key] is None else abs(value - checks[key]) <= tolerance + 1e-9 * abs(value)
            checks[f"report_{key}_ok"] = bool(same)
    return checks | {"ok": all(v for k, v in checks.items() if k.endswith("_ok") or k in ("hex_id_is_unique", "threshold_matches_quantile", "ids_equal"))}


SHORTLIST = ("rank", "hex_id", "admin_name", "district_name", "vulnerability_m3_final", "access_cost_m0", "access_cost_m3", "demand_index_final", "registered_population", "registered_senior_population", "primary_reason")


def export_shortlist(cells: DataFrame, areas: DataFrame | None = None, limit: int | None = None, suffix: str = "final") -> DataFrame:
    labelled = cells if areas is None else spatial.label(cells, areas, ["admin_name", "district_name"], TILE)
    return select_existing(vul.shortlist(labelled, suffix, limit), SHORTLIST).orderBy("rank")


def export_diagnostics(cells: DataFrame, areas: DataFrame | None = None, suffix: str = "final") -> tuple[DataFrame, DataFrame]:
    """Hidden cells with reasons, and how often each reason stands."""
    labelled = cells if areas is None else spatial.label(cells, areas, ["admin_name", "district_name"], TILE)
    found = vul.diagnose(labelled, suffix)
    return found, reports.value_counts(found, "primary_reason")


def build_mobility(trips: DataFrame, codes: DataFrame) -> tuple[DataFrame, dict]:
    """Figures of every code, and the quality report with codes that lack a dimension row."""
    typed = pop.prepare_trips(trips)
    quality = files.report_of(pop.mobility_quality(typed, codes))
    for end in ("origin", "destination"):
        quality[f"top_unmatched_{end}_codes"] = [r.asDict() for r in pop.unmatched_codes(typed, codes, end).collect()]
    return pop.mobility_by_code(typed, codes), quality


def build_hex_mobility(areas: DataFrame, cells: DataFrame, figures: Sequence[str]) -> DataFrame:
    return pop.mobility_demand(spatial.spread_kept(areas, cells, figures, "mobility_admin_code", TILE, prefix="mobility_"))


def figures(df: DataFrame, columns: Sequence[str]) -> dict:
    """Stage report of a built table."""
    return {r["column"]: {k: v for k, v in r.asDict().items() if k != "column"} for r in reports.stage_figures(df, columns).collect()} | {"rows": df.count()}


def score_report(df: DataFrame, suffix: str = "final") -> dict:
    """Score figures and counts, and the population of hidden cells."""
    people = [c for c in ("registered_population", "registered_senior_population") if c in df.columns]
    hidden = F.col(f"hidden_vulnerable_{suffix}")
    counts = df.agg(F.count_if(f"vulnerable_m3_{suffix}").alias("vulnerable"), F.count_if(hidden).alias("hidden"), *(F.sum(F.when(hidden, F.col(c))).alias(f"hidden_{c}") for c in people))
    return files.report_of(stats.score_stats(df, f"vulnerability_m3_{suffix}")) | files.report_of(counts)


def _tables(spark: SparkSession, given: dict[str, str]) -> dict[str, DataFrame]:
    return {k: spark.read.parquet(v) for k, v in given.items()}


#: Commands that turn named Parquet tables into tables: name -> (function, tables, numbers).
COMMANDS: dict[str, tuple[Callable, tuple[str, ...], tuple[str, ...]]] = {
    "build-edge-cost-sample": (build_edge_cost_sample, ("edges",), ("rows", "rain_mm", "snow_cm")),
    "build-edge-costs": (build_edge_costs, ("edges",), ("rain_mm", "snow_cm")),
    "build-analysis-hexes": (build_analysis_hexes, ("mask",), ("edge_m",)),
    "build-transit-d-candidates": (build_transit_candidates, ("bus", "subway", "boundary"), ("buffer_m",)),
    "aggregate-local-resident-250m": (aggregate_local_resident, ("rows",), ()),
    "join-local-resident-grid": (join_local_resident, ("cells", "summary"), ()),
    "build-registered-admin-layer": (build_registered_layer, ("boundary", "registered", "aliases"), ()),
    "build-hex-demand-prelim": (lambda cells, living, pois: build_demand(cells, living, {"poi": pois}), ("cells", "living", "pois"), ()),
    "build-hex-demand-final": (lambda cells, living, pois, registered: build_demand(cells, living, {"poi": pois}, registered), ("cells", "living", "pois", "registered"), ()),
    "build-accessibility-prelim": (build_accessibility, ("cells", "nodes", "edges", "stops"), ("most_m",)),
    "build-vulnerability-prelim": (lambda demand, accessibility, q=0.8: build_vulnerability(demand, accessibility, "prelim", q), ("demand", "accessibility"), ("q",)),
    "build-vulnerability-final": (build_vulnerability, ("demand", "accessibility"), ("q",)),
    "build-vulnerability-typology": (build_typology, ("cells",), ()),
    "export-hidden-vulnerability-shortlist": (export_shortlist, ("cells",), ("limit",)),
    "export-hidden-vulnerability-diagnostics": (export_diagnostics, ("cells",), ()),
    "build-life-mobility-od-aux": (lambda trips, codes: build_mobility(trips, codes)[0], ("trips", "codes"), ()),
    "build-hex-mobility-aux": (lambda areas, cells: build_hex_mobility(areas, cells, [c for c in areas.columns if c.startswith("mobility_") and c != "mobility_admin_code"]), ("areas", "cells"), ()),
}


def main(arguments: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="terrane")
    parser.add_argument("command", choices=[*COMMANDS, "profile-data", "validate-data", "extract-registered-population", "validate-vulnerability-final", "validate-run-manifest", "profile-life-mobility-od"])
    parser.add_argument("--table", action="append", default=[], metavar="NAME=PATH", help="an input")
    parser.add_argument("--set", action="append", default=[], metavar="NAME=NUMBER", help="a parameter")
    parser.add_argument("--out", help="folder to write to")
    parser.add_argument("--strict", action="store_true")
    given = parser.parse_args(arguments)
    paths = dict(x.split("=", 1) for x in given.table)
    numbers = {k: float(v) if "." in v else int(v) for k, v in (x.split("=", 1) for x in given.set)}
    if given.command == "validate-run-manifest":
        report = manifest.validate(paths["manifest"], paths.get("root", "."))
        print(json.dumps(report, ensure_ascii=False))
        return int(given.strict and report["status"] != "pass")
    spark = SparkSession.builder.appName(f"terrane {given.command}").getOrCreate()
    if given.command in ("profile-data", "profile-life-mobility-od"):
        profile_data(spark, paths).show(truncate=False)
        return 0
    if given.command == "validate-data":
        report = validate_data(spark, paths)
        print(json.dumps(report, ensure_ascii=False))
        return int(given.strict and not report["ok"])
    if given.command == "validate-vulnerability-final":
        tables = _tables(spark, {k: v for k, v in paths.items() if k in ("cells", "other")})
        report = validate_vulnerability(tables["cells"], tables.get("other"), files.read_report(paths["report"]) if "report" in paths else None)
        print(json.dumps(report, ensure_ascii=False, default=str))
        return int(given.strict and not report["ok"])
    if given.command == "extract-registered-population":
        made = extract_registered_population(spark, paths["workbook"], paths.get("sheet"))
    else:
        run, names, allowed = COMMANDS[given.command]
        made = run(**_tables(spark, {n: paths[n] for n in names}), **{k: v for k, v in numbers.items() if k in allowed})
    for k, df in enumerate(made if isinstance(made, tuple) else (made,)):
        df.write.mode("overwrite").parquet(given.out if not k else f"{given.out.rstrip('/')}-{k}")
    manifest.write(manifest.build(given.command, {"tables": paths, "numbers": numbers}, [], [], [], "."), f"{given.out.rstrip('/')}.manifest.json")
    return 0


if __name__ == "__main__":
    sys.exit(main())
