"""Queries that run the commands as functions of frames, and one through the command line."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F

from terrane.functions import geometry as g
from terrane.functions import stats
from terrane.operators import population as pop
from terrane.plans import commands
from terrane.plans.analog import rounded, view, with_views
from terrane.plans.queries_files import local, shared, table
from terrane.plans.queries_model import ACCESS_COLUMNS, OFFICIAL, SCORED, TYPED, access, model_sql, paths, scored
from terrane.plans.queries_space import PIECES, boxes, projected_sql
from terrane.plans.queries_table import COSTS, MARKED, TRIP_NAMES, USABLE, mobility
from terrane.plans.registry import ORACLE, register


@register("c01_c21_profile", "select * from (values ('gone', false, null), ('nations', true, '[\"n_nationkey\", \"n_name\"]')) t(name, readable, columns)")
def profile(spark, sf_dir):
    """Columns of each source; one that is not there is part of the profile."""
    path = shared(spark, "csv")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").coalesce(1).write.option("header", True).csv(path)
    found = commands.profile_data(spark, {"nations": f"{path}/part-*.csv", "gone": f"{path}/none/*.csv"})
    rows = [(r["name"], not (r["columns"] or "").startswith("unreadable") and r["columns"] is not None, r["columns"]) for r in found.collect()]
    return spark.createDataFrame([(n, ok, json.dumps(list(json.loads(c))) if ok else None) for n, ok, c in rows], "name string, readable boolean, columns string")


@register("c02_validate_sources", "select * from (values ('poi', true, null), ('broken', false, 'lat'), ('absent', false, 'no file')) t(source, ok, missing)")
def validate_sources(spark, sf_dir):
    """A sample of every file against its contract; a pattern without files is an error."""
    good, bad = shared(spark, "poi"), shared(spark, "poi")
    rows = table(spark, sf_dir, "nation").select(F.lit(127.0).alias("lon"), F.lit(37.5).alias("lat"))
    rows.write.option("header", True).csv(good)
    rows.drop("lat").write.option("header", True).csv(bad)
    out = []
    for name, path in (("poi", good), ("broken", bad), ("absent", f"{bad}/none")):
        try:
            report = commands.validate_data(spark, {"poi": f"{path}/*.csv"})
            missing = sorted({c for issues in report["sources"]["poi"].values() for c in issues})
            out.append((name, report["ok"], ", ".join(missing) or None))
        except FileNotFoundError:
            out.append((name, False, "no file"))
    return spark.createDataFrame(out, "source string, ok boolean, missing string")


@register("c03_c05_h16_command_line", rounded(with_views(USABLE + "select osmid, key, cost_m0, cost_m3, true as manifest, 0 as unknown_input from costed", "edges"), "cost_m0", "cost_m3"))
def command_line(spark, sf_dir):
    """build-edge-costs and validate-run-manifest as a user runs them."""
    edges, out = shared(spark, "edges"), local(spark, "costs")
    view(spark, sf_dir, "edges").write.parquet(edges)
    code = commands.main(["build-edge-costs", "--table", f"edges={edges}", "--set", "rain_mm=2.0", "--set", "snow_cm=0.5", "--out", out])
    strict = commands.main(["validate-run-manifest", "--table", f"manifest={out}.manifest.json", "--table", f"root={Path(out).parent}", "--strict"])
    made = spark.read.parquet(out).select("osmid", "key", "cost_m0", "cost_m3")
    return made.withColumns({"manifest": F.lit(code == 0 and Path(f"{out}.manifest.json").exists()), "unknown_input": F.lit(strict)})


@register("c04_edge_cost_sample", rounded(with_views(USABLE + "select count(*) as n, sum(cost_m3) as total from costed", "edges"), "total"))
def cost_sample(spark, sf_dir):
    """A sample of no fewer rows than there are is the whole table."""
    return commands.build_edge_cost_sample(view(spark, sf_dir, "edges"), 1 << 30, 2.0, 0.5).agg(F.count("*").alias("n"), F.sum("cost_m3").alias("total"))


BOX = (950_000.0, 1_945_000.0, 970_000.0, 1_960_000.0)


@register("c07_g01_transit_candidates", rounded(with_views(""",
bus as (
  select 'bus' as mode, cast(stop_id as varchar) as stop_id, avg(lon) as lon, avg(lat) as lat, sum(coalesce(try_cast(passengers as double), 0)) as passengers_sum from rides
  where lower(trim(location_matched)) in ('true', '1', 'yes', 'y') and lon between 126.70 and 127.25 and lat between 37.40 and 37.75 group by all),
subway as (select 'subway', c_mktsegment, 126.9 + min(c_nationkey) * 0.01, 37.5 + min(c_nationkey) * 0.005, sum(c_acctbal) from customer group by c_mktsegment),
stops as (select * from bus union all select * from subway),
""" + projected_sql("placed", "stops", "lon", "lat", "mode, stop_id, passengers_sum") + f"""
select mode, stop_id, passengers_sum, x between {BOX[0]} and {BOX[2]} and y between {BOX[1]} and {BOX[3]} as inside from placed""", "rides"), "passengers_sum"))  # fmt: skip
def transit_candidates(spark, sf_dir):
    """Bus and subway stops, projected, inside and outside a boundary."""
    r = view(spark, sf_dir, "rides")
    bus = r.select(F.col("stop_id").cast("string").alias("표준버스정류장ID"), F.col("stop_name").alias("역명"), "passengers", "lon", "lat", "location_matched", F.lit("Y").alias("coord_valid"))
    c = table(spark, sf_dir, "customer")
    place = c.groupBy("c_mktsegment").agg(F.min("c_nationkey").alias("k"))
    subway = c.join(place, "c_mktsegment").select(
        F.col("c_mktsegment").alias("지하철역"), F.col("c_acctbal").alias("passengers"), (126.9 + F.col("k") * 0.01).alias("lon"), (37.5 + F.col("k") * 0.005).alias("lat"), F.lit("y").alias("location_matched")
    )
    w, s, e, n = BOX
    boundary = spark.range(1).select(g.ring([(w, s), (e, s), (e, n), (w, n)]).alias("ring"))
    inside, outside = commands.build_transit_candidates(bus, subway, boundary)
    return inside.withColumn("inside", F.lit(True)).union(outside.withColumn("inside", F.lit(False))).select("mode", "stop_id", "passengers_sum", "inside")


@register("c08_c09_local_resident", rounded(with_views("""
, sums as (select grid, count(*) as observed_rows, avg(living) as mean_living_population, avg(living) filter (hr between 9 and 17) as daytime_mean_population, avg(old * 2) as mean_senior_population from grid group by grid)
select 'g' || p_partkey as cell, observed_rows, mean_living_population, daytime_mean_population, mean_senior_population, grid is not null as livingpop_joined from part left join sums on grid = 'g' || p_partkey""", "grid"),
    "mean_living_population", "daytime_mean_population", "mean_senior_population", digits=6))
def local_resident(spark, sf_dir):
    """Figures of the files' own columns, on all cells."""
    names = pop.GRID_COLUMNS
    rows = view(spark, sf_dir, "grid").select(
        F.col("grid").alias(names["grid"]), F.col("hr").cast("string").alias(names["hour"]), F.col("living").alias(names["living"]), F.col("old").alias(pop.SENIOR_COLUMNS[0]), F.col("old").alias(pop.SENIOR_COLUMNS[3])
    )
    cells = table(spark, sf_dir, "part").select(F.concat(F.lit("g"), F.col("p_partkey")).alias("CELL_ID"))
    found = commands.join_local_resident(cells, commands.aggregate_local_resident(rows))
    return found.select(F.col("CELL_ID").alias("cell"), "observed_rows", "mean_living_population", "daytime_mean_population", "mean_senior_population", "livingpop_joined")


@register("c10_registered_figures", "select count(*) as rows, sum(n_nationkey * 10) as population, sum(n_regionkey) as senior_population, count(distinct n_regionkey) as names, string_agg(distinct 'r' || n_regionkey, ',' order by 'r' || n_regionkey) as repeated from nation")
def registered_figures(spark, sf_dir):
    """Rows, totals, and names that stand in several districts."""
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("admin_name"), (F.col("n_nationkey") * 10).alias("registered_population"), F.col("n_regionkey").alias("registered_senior_population"))
    found = commands.registered_quality(rows)
    return spark.createDataFrame([(found["rows"], found["population"], found["senior_population"], found["names"], ",".join(found["repeated_names"]))], "rows long, population long, senior_population long, names long, repeated string")


@register("c11_registered_layer", """
select n_name || 'x동' as admin_name, n_nationkey * 7 as registered_population, true as unmatched from nation""")  # fmt: skip
def registered_layer(spark, sf_dir):
    """The boundary layer with population, and keys that only one side has."""
    n = table(spark, sf_dir, "nation")
    code = F.concat(F.lit("11"), F.lpad((F.col("n_regionkey") * 10 + 10).cast("string"), 3, "0"), F.col("n_nationkey").cast("string"))
    boundary = n.select(code.alias("code"), F.concat("n_name", F.lit("x동")).alias("admin_name"), pop.district_of(code).alias("district_name"))
    registered = n.select(F.concat("n_name", F.lit("x 동")).alias("admin_name"), pop.district_of(code).alias("district_name"), (F.col("n_nationkey") * 7).cast("long").alias("registered_population"), F.lit(1).cast("long").alias("registered_senior_population"))
    issues = commands.registered_key_issues(boundary.where("admin_name != ''"), registered.limit(20)).count() == n.count() - 20
    return commands.build_registered_layer(boundary, registered, spark.createDataFrame([], pop.ALIAS_COLUMNS)).select("admin_name", "registered_population", F.lit(issues).alias("unmatched"))


DEMAND = PIECES.rstrip() + """,
living as (select hex_id, sum(abs(pop) * piece / area) as lp, sum(abs(pop) / 7 * piece / area) as ls from pieces where piece > 0 group by 1),
kept as (select hex_id, sum(abs(pop) * piece / covered) as rp, sum(abs(pop) / 3 * piece / covered) as rs from (select *, sum(piece) over (partition by area_id) as covered from pieces where piece > 0) group by 1),
shops as (select hex_id, count(*) as n from squares join points on x > w and x < e and y > s and y < n group by 1),
axes as (select hex_id, coalesce(lp, 0) as lp, coalesce(ls, 0) as ls, coalesce(rp, 0) as rp, coalesce(rs, 0) as rs, coalesce(shops.n, 0) as poi from squares left join living using (hex_id) left join kept using (hex_id) left join shops using (hex_id)),
scaled as (select hex_id, poi, """ + ", ".join(f"({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()) as {c}_norm" for c in ("lp", "ls", "rp", "rs", "poi")) + " from axes)"  # fmt: skip


def demand(spark, sf_dir, registered):
    a = boxes(spark, sf_dir, "areas").withColumn("pop", F.abs("pop"))
    living = a.select(F.col("area_id").alias("CELL_ID"), "ring", F.col("joined").alias("livingpop_joined"), F.col("pop").alias("mean_living_population"), (F.col("pop") / 7).alias("mean_senior_population"))
    layer = a.select(F.col("area_id").alias("code"), "ring", F.col("pop").alias("registered_population"), (F.col("pop") / 3).alias("registered_senior_population"))
    cells = boxes(spark, sf_dir, "squares").select("hex_id", "ring")
    return commands.build_demand(cells, living, {"shop": view(spark, sf_dir, "points")}, layer if registered else None)


@register("r06_c12_demand_prelim", rounded(with_views(DEMAND + "select hex_id, poi as poi_total_count, (lp_norm + ls_norm + poi_norm) / 3 as demand_index_prelim from scaled", "areas", "squares", "points"), "demand_index_prelim"))
def demand_prelim(spark, sf_dir):
    return demand(spark, sf_dir, False).select("hex_id", "poi_total_count", "demand_index_prelim")


@register("r07_c13_demand_final", rounded(with_views(DEMAND + "select hex_id, poi as poi_total_count, (rp_norm + rs_norm + lp_norm + poi_norm) / 4 as demand_index_final from scaled", "areas", "squares", "points"), "demand_index_final"))
def demand_final(spark, sf_dir):
    return demand(spark, sf_dir, True).select("hex_id", "poi_total_count", "demand_index_final")


SNAPPED = """
origins as (
  select hex_id, node_id as origin_node_id, d as snap_distance_m from (
    select hex_id, node_id, sqrt(((w + e) / 2 - x) ** 2 + ((s + n) / 2 - y) ** 2) as d, row_number() over (partition by hex_id order by sqrt(((w + e) / 2 - x) ** 2 + ((s + n) / 2 - y) ** 2), node_id) as r
    from squares join nodes on abs((w + e) / 2 - x) <= 250 and abs((s + n) / 2 - y) <= 250) where r = 1 and d <= 250),
goals as (select distinct node_id as node from nodes join supplier on node_id = s_suppkey where s_acctbal > 5000),
"""


@register("c14_accessibility", rounded(with_views(
    USABLE.rstrip() + "," + SNAPPED.strip().rstrip(",") + "," + paths("d0", "cost_m0", "g0", "goals") + "," + paths("d3", "cost_m3", "g3", "goals") + """
select hex_id, origin_node_id, snap_distance_m, d0.cost as access_cost_m0, d3.cost as access_cost_m3, d3.cost is not null as cost_m3_reachable
from squares left join origins using (hex_id) left join d0 on d0.node = origin_node_id left join d3 on d3.node = origin_node_id""", "edges", "squares", "nodes", recursive=True), "snap_distance_m", "access_cost_m0", "access_cost_m3"))  # fmt: skip
def accessibility(spark, sf_dir):
    """Cells snapped to nodes and routed to the stops that snap to one."""
    stops = view(spark, sf_dir, "nodes").join(table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("node_id")), "node_id").select(F.col("node_id").alias("stop_id"), "x", "y")
    edges = commands.build_edge_costs(view(spark, sf_dir, "edges"), 2.0, 0.5)
    found = commands.build_accessibility(boxes(spark, sf_dir, "squares").select("hex_id", "ring"), view(spark, sf_dir, "nodes"), edges, stops, 250.0)
    return found.select("hex_id", "origin_node_id", "snap_distance_m", "access_cost_m0", "access_cost_m3", "cost_m3_reachable")


@register("c15_c16_vulnerability", rounded(model_sql(SCORED + """
select count(*) filter (vulnerable) as vulnerable, count(*) filter (coalesce(access_cost_m0 <= 400, false) and vulnerable) as hidden, min(score) as min, quantile_cont(score, 0.5) as median, max(score) as max, avg(score) as mean,
  sum(population) filter (coalesce(access_cost_m0 <= 400, false) and vulnerable) as hidden_registered_population from scored"""), "min", "median", "max", "mean", "hidden_registered_population"))  # fmt: skip
def vulnerability_report(spark, sf_dir):
    """The joined and scored table's report."""
    cells = access(spark, sf_dir)
    needs = cells.select("hex_id", F.col("demand").alias("demand_index_final"), F.col("population").alias("registered_population"))
    made = commands.build_vulnerability(needs, cells.select("hex_id", *ACCESS_COLUMNS))
    found = commands.score_report(made)
    names = ("vulnerable", "hidden", "min", "median", "max", "mean", "hidden_registered_population")
    return spark.createDataFrame([tuple(found[n] for n in names)], "vulnerable long, hidden long, min double, median double, max double, mean double, hidden_registered_population double")


@register("c17_typology", model_sql(TYPED.replace(">= 0.6 then", ">= 0.4 then") + " select kind as vulnerability_type, count(*) as hex_count, sum(count(*)) over () as typed from typed where kind is not null group by 1"))
def typology(spark, sf_dir):
    typed, sums = commands.build_typology(scored(spark, sf_dir))
    return sums.select("vulnerability_type", "hex_count", F.lit(typed.where("vulnerability_type is not null").count()).alias("typed"))


@register("c18_validate_final", model_sql(SCORED + " select true as ids_equal, true as threshold_matches_quantile, true as report_ok, false as wrong_report_ok, count(*) as row_count from scored"))
def validate_final(spark, sf_dir):
    """The audit against another copy and a report; a report with another figure fails."""
    cells = scored(spark, sf_dir, 400.0)
    report = {"row_count": cells.count(), "vulnerable_count": cells.where("vulnerable_m3_final").count()}
    good = commands.validate_vulnerability(cells, cells.repartition(3), report)
    bad = commands.validate_vulnerability(cells, cells, report | {"vulnerable_count": -1})
    row = (good["ids_equal"], good["threshold_matches_quantile"], good["report_vulnerable_count_ok"] and good["report_row_count_ok"], bad["ok"] or bad["report_vulnerable_count_ok"], good["row_count"])
    return spark.createDataFrame([row], "ids_equal boolean, threshold_matches_quantile boolean, report_ok boolean, wrong_report_ok boolean, row_count long")


@register("c19_shortlist", rounded(model_sql(SCORED + " select row_number() over (order by score desc, hex_id) as rank, hex_id, score, access_cost_m0 from scored where official and vulnerable"), "score", "access_cost_m0"))
def export_shortlist(spark, sf_dir):
    return commands.export_shortlist(scored(spark, sf_dir)).select("rank", "hex_id", F.col("vulnerability_m3_final").alias("score"), "access_cost_m0")


@register("c20_diagnostics", model_sql(SCORED + """,
env as (select *, access_cost_m3 - access_cost_m0 as inc from scored where score is not null),
cuts as (select quantile_cont(demand, 0.75) as d, quantile_cont(inc, 0.75) as e from env)
select case when demand >= d and inc >= e then 'high_demand_plus_slope_weather_penalty' when demand >= d and access_cost_m0 >= 320 then 'high_demand_plus_near_400m_distance' when demand >= d then 'high_demand'
    when inc >= e then 'slope_weather_penalty' when access_cost_m0 >= 320 then 'near_400m_distance' else 'mixed' end as primary_reason, count(*) as count from env, cuts where official and vulnerable group by 1"""))  # fmt: skip
def export_diagnostics(spark, sf_dir):
    """How often each reason stands among the hidden cells."""
    return commands.export_diagnostics(scored(spark, sf_dir, OFFICIAL))[1]


@register("c22_mobility_report", with_views(MARKED + """
select count(*) as used_row_count, (select count(*) from (select distinct origin, destination from marked where oi or di)) as od_pair_count,
  (select string_agg(code, ',' order by m desc, code) from (select origin as code, sum(move_pop) as m from trips where hour is not null and origin like '11%' and origin not in (select code from codes) group by 1 order by 2 desc, 1 limit 10)) as top_unmatched,
  (select count(*) from codes) as codes from marked""", "trips", "codes"))  # fmt: skip
def mobility_report(spark, sf_dir):
    """The quality report of the mobility table."""
    named = view(spark, sf_dir, "trips").withColumnsRenamed({TRIP_NAMES[k]: v for k, v in pop.MOBILITY.items()})
    made, quality = commands.build_mobility(named, view(spark, sf_dir, "codes"))
    top = ",".join(r["code"] for r in quality["top_unmatched_origin_codes"])
    return spark.createDataFrame([(quality["used_row_count"], quality["od_pair_count"], top, made.count())], "used_row_count long, od_pair_count long, top_unmatched string, codes long")


@register("c23_hex_mobility", rounded(with_views(PIECES.rstrip() + """,
kept as (select hex_id, sum(abs(pop) * piece / covered) as dep, sum(abs(pop) * 2 * piece / covered) as arr, sum(abs(pop) * 3 * piece / covered) as tot, sum(abs(pop) / 5 * piece / covered) as peak
  from (select *, sum(piece) over (partition by area_id) as covered from pieces where piece > 0) group by 1),
filled as (select hex_id, coalesce(dep, 0) as dep, coalesce(arr, 0) as arr, coalesce(tot, 0) as tot, coalesce(peak, 0) as peak from squares left join kept using (hex_id))
select hex_id, arr - dep as mobility_net_inflow, ((tot - min(tot) over ()) / (max(tot) over () - min(tot) over ()) + (peak - min(peak) over ()) / (max(peak) over () - min(peak) over ())) / 2 as mobility_index from filled""", "areas", "squares"),
    "mobility_net_inflow", "mobility_index"))
def hex_mobility(spark, sf_dir):
    a, v = boxes(spark, sf_dir, "areas"), F.abs("pop")
    figures = {"mobility_departures": v, "mobility_arrivals": v * 2, "mobility_total_trips": v * 3, "mobility_peak_total_trips": v / 5}
    layer = a.select(F.col("area_id").alias("mobility_admin_code"), "ring", *(x.alias(n) for n, x in figures.items()))
    return commands.build_hex_mobility(layer, boxes(spark, sf_dir, "squares").select("hex_id", "ring"), list(figures)).select("hex_id", "mobility_net_inflow", "mobility_index")
