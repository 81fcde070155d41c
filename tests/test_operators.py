"""Operators against small hand-computed cases."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from terrane.functions import geometry as g
from terrane.functions import store
from terrane.operators import edges, population, reports, routing, scenario, sensitivity, spatial
from terrane.operators import vulnerability as vul


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_edge_costs_keep_raw_columns(spark):
    df = spark.createDataFrame([(1, 2, 100.0, 10.0), (2, 3, 100.0, 684.6), (3, 4, 100.0, None), (4, 5, 100.0, 47.7)], "u int, v int, length_m double, grade_abs_percent double")
    got = edges.with_costs(df, rain_mm=2.0).orderBy("u").collect()
    assert [r.u for r in got] == [1, 4] and got[1].grade_abs_percent == 47.7
    assert round(got[0].cost_m3, 6) == 139.88 and got[1].cost_m1 == pytest.approx(190)
    dry = edges.with_costs(df).first()
    assert dry.cost_m3 == dry.cost_m1


def test_nearest_cost(spark):
    e = spark.createDataFrame([(1, 2, 5.0), (2, 3, 6.0), (1, 3, 20.0), (1, 3, -1.0), (9, 8, 1.0), (2, 3, None)], "u long, v long, w double")
    goals = spark.createDataFrame([(3,), (77,)], "node long")
    assert rows(routing.nearest_cost(e, goals, ["w"]), "node") == [(1, 11.0), (2, 6.0), (3, 0.0)]
    with pytest.raises(ValueError, match="no destination"):
        routing.nearest_cost(e, goals.where("node = 77"), ["w"])
    by = e.withColumn("k", F.lit("a")).union(e.withColumn("w", F.col("w") * 2).withColumn("k", F.lit("b")))
    assert ("b", 1, 22.0) in rows(routing.nearest_cost(by, goals, ["w"], by=["k"]), "k", "node")


def test_k_nearest_and_reach(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (1, 4, 10.0), (4, 5, 1.0)], "u long, v long, w double")
    goals = spark.createDataFrame([(2,), (3,), (5,)], "node long")
    got = {r.node: (r.n_found, r.mean_cost) for r in routing.k_nearest_cost(e, goals, "w", 2).collect()}
    assert got[1] == (2, 2.0) and got[4] == (1, None) and got[2] == (2, 1.0)
    reach = routing.reach_within(e, spark.createDataFrame([(1,)], "node long"), "w", 3.0)
    assert rows(reach, "node") == [(1, 1, 0.0), (1, 2, 1.0), (1, 3, 3.0)]


def test_cell_access(spark):
    cells = spark.createDataFrame([("h1",), ("h2",)], "hex_id string")
    origins = spark.createDataFrame([("h1", 1, 0.0)], "hex_id string, origin_node_id long, snap_distance_m double")
    cost = spark.createDataFrame([(1, 10.0)], "node long, cost_m0 double")
    assert [(r.hex_id, r.access_cost_m0, r.cost_m0_reachable) for r in routing.cell_access(cells, origins, cost, ["cost_m0"]).orderBy("hex_id").collect()] == [("h1", 10.0, True), ("h2", None, False)]


CELLS = "hex_id string, demand_index_final double, access_cost_m0 double, access_cost_m1 double, access_cost_m2 double, access_cost_m3 double"


def test_score(spark):
    df = spark.createDataFrame([("h1", 0.1, 100.0, 110.0, 115.0, 120.0), ("h2", 1.0, 300.0, 400.0, 450.0, 500.0), ("h3", 0.9, 600.0, 700.0, 750.0, 800.0), ("h4", None, 1.0, 1.0, 1.0, None)], CELLS)
    got = {r.hex_id: r for r in vul.score(df, "demand_index_final", q=0.5).collect()}
    assert got["h2"].hidden_vulnerable_final and got["h3"].vulnerable_m3_final and not got["h3"].hidden_vulnerable_final
    assert [got[h].cost_gap_m3_minus_m0 for h in ("h1", "h2", "h3")] == [20, 200, 200] and not got["h4"].analysis_valid_final
    checks = vul.audit(vul.score(df, "demand_index_final", q=0.5), q=0.5).first()
    assert checks.hex_id_is_unique and checks.threshold_matches_quantile and checks.hidden_formula_ok and checks.cost_monotonic_ok and checks.numeric_inf_ok
    none = vul.score(df.where("hex_id = 'h4'"), "demand_index_final").first()
    assert none.vulnerability_threshold_final is None and not none.vulnerable_m3_final


def test_diagnose(spark):
    df = spark.createDataFrame([("h1", 0.2, 100.0, 110.0, 115.0, 120.0), ("h2", 0.9, 350.0, 420.0, 450.0, 455.0), ("h3", 0.3, 200.0, 210.0, 215.0, 220.0)], CELLS)
    df = df.withColumn("hidden_vulnerable_final", F.col("hex_id") == "h2")
    got = vul.diagnose(df).collect()
    assert len(got) == 1 and (got[0].slope_increment_m1_m0, got[0].weather_additive_increment_m2_m1, got[0].interaction_increment_m3_m2) == (70, 30, 5)
    assert got[0].near_400m_distance_pressure and got[0].primary_reason == "high_demand_plus_slope_weather_penalty"
    with pytest.raises(KeyError):
        vul.diagnose(df.drop("access_cost_m2"))


@pytest.mark.parametrize(
    ("costs", "kind"),
    [((200, 350, 360, 365), "slope_vulnerable"), ((200, 210, 220, 260), "weather_amplified"), ((500, 503, 508, 509), "supply_shortage")],
)
def test_classify(spark, costs, kind):
    table = [("a", True, *map(float, costs)), ("b", True, 100.0, 101.0, 104.0, 105.0), ("c", False, 900.0, 900.0, 900.0, 900.0)]
    df = spark.createDataFrame(table, "hex_id string, vulnerable_m3_final boolean, access_cost_m0 double, access_cost_m1 double, access_cost_m2 double, access_cost_m3 double")
    got = {r.hex_id: r.vulnerability_type for r in vul.classify(df, far_quantile=0.5).collect()}
    assert got["a"] == kind and got["c"] is None
    with pytest.raises(KeyError):
        vul.classify(df.drop("access_cost_m1"))
    assert vul.classify(df.where("hex_id = 'c'")).first().vulnerability_type is None


def test_frozen_scenario(spark):
    df = spark.createDataFrame([(k, 10.0 * k, s, float(k), p) for k, s, p in ((1, 10.0, 10.0), (2, 20.0, 20.0), (3, 30.0, 30.0), (4, 10.0, 40.0))], "hex_id int, base double, scen double, demand double, pop double")
    frozen = scenario.FrozenBaseline.fit(df, "base", "demand", 0.75)
    got = rows(scenario.compare(df.withColumn("ok", F.lit(True)), frozen, "base", "scen", "demand", "ok").select("hex_id", "baseline_vulnerable", "scenario_vulnerable", "delta_cost", "resolved_hidden", "delta_rank_improvement"), "hex_id")
    assert [r[1] for r in got] == [False, False, False, True] and got[3][2:5] == (False, 30.0, True) and got[3][5] > 0
    figures = scenario.evaluate(df, frozen, "base", "scen", "demand", "pop")
    assert (figures["baseline_vulnerable_count"], figures["scenario_vulnerable_count"]) == (1, 0)
    assert figures["vulnerable_hex_reduction"] == figures["vulnerable_population_reduction"] == 1.0 and figures["population_weighted_mean_cost_reduction"] > 0
    assert scenario.summarise(scenario.compare(df, frozen, "base", "base", "demand")).first().is_no_op


def test_mobility(spark):
    table = [
        (1, "월", 8, 1106081, 1106081, "F", 1, "HH", 10.0, 0.0, 5.0), (1, "월", 8, 1106081, 1101053, "F", 1, "HW", 20.0, 0.0, 30.0), (1, "월", 18, 1101053, 1106081, "F", 1, "WH", 5.0, 0.0, 40.0),
        (1, "월", 12, 1106081, 21000, "F", 1, "HE", 7.0, 0.0, 60.0), (1, "월", 17, 21000, 1101053, "F", 1, "EH", 3.0, 0.0, 50.0), (1, "월", 18, 1101053, 1101053, "F", 1, "HH", 0.0, 0.0, None), (1, "월", None, 1, 1, "F", 1, "HH", 9.0, 0.0, 1.0),
    ]
    names = list(population.MOBILITY.values())
    df = spark.createDataFrame(table, f"`{names[0]}` int, `{names[1]}` string, `{names[2]}` int, `{names[3]}` long, `{names[4]}` long, `{names[5]}` string, `{names[6]}` int, `{names[7]}` string, {names[8]} double, {names[9]} double, {names[10]} double")
    codes = spark.createDataFrame([("1106081",), ("1101053",), ("1199999",)], "code string")
    trips = population.prepare_trips(df)
    got = {r.mobility_admin_code: r for r in population.mobility_by_code(trips, codes, (8, 17, 18)).collect()}
    a, b = got["1106081"], got["1101053"]
    assert (a.mobility_departures, a.mobility_arrivals, a.mobility_internal_trips, a.mobility_outbound_to_nonseoul) == (37, 15, 10, 7)
    assert a.mobility_origin_avg_move_time_min == pytest.approx((50 + 600 + 420) / 37)
    assert b.mobility_inbound_from_nonseoul == 3 and b.mobility_home_work_departures == 5 and got["1199999"].mobility_total_trips == 0
    quality = population.mobility_quality(trips, codes).first()
    assert (quality.used_row_count, quality.zero_or_negative_move_pop_count, quality.total_move_pop, quality.od_pair_count) == (6, 1, 45.0, 6)


def test_registered(spark):
    sheet = [(1, "서울시", "2400", "260"), (2, "종로구", "2100", "220"), (3, " 사직동", "100", "25"), (4, "삼청동", "2,000", "400"), (5, "중구", "300", "30"), (6, "명동", "300", "30"), (7, "빈동", "-", "-"), (8, None, "5", "1")]
    got = population.registered_rows(spark.createDataFrame(sheet, "row_idx int, name string, population string, senior string"))
    assert rows(got, "admin_name") == [("명동", "중구", 300, 30, 0.1), ("사직동", "종로구", 100, 25, 0.25), ("삼청동", "종로구", 2000, 400, 0.2)]
    registered = spark.createDataFrame([("용신동", "동대문구", 10, 1), ("용두동", "동대문구", 20, 2), ("신설동", "동대문구", 30, 3), ("홍제제1동", "서대문구", 40, 4)], "admin_name string, district_name string, registered_population long, registered_senior_population long")
    aliases = spark.createDataFrame(population.REGISTERED_ALIASES, population.ALIAS_COLUMNS)
    boundary = spark.createDataFrame([("11230", "용신동", "동대문구"), ("11410", "홍제1동", "서대문구"), ("41000", "다른동", "다른구")], "code string, admin_name string, district_name string")
    got = {r.code: r for r in population.register_by_boundary(boundary, registered, aliases).collect()}
    assert {k: r.registered_population for k, r in got.items()} == {"11230": 60, "11410": 40} and got["11230"].registered_source_names == "신설동,용두동,용신동"
    with pytest.raises(ValueError, match="without a match"):
        population.register_by_boundary(boundary, registered.where("admin_name != '홍제제1동'"), aliases)
    assert rows(population.unmatched_keys(boundary, registered, ["district_name"]), "district_name") == [("다른구", "left")]


def square(spark, table, extra=""):
    df = spark.createDataFrame(table, f"key string, w double, e double{extra}")
    return df.withColumn("ring", g.box_ring(F.col("w"), F.lit(0.0), F.col("e"), F.lit(1.0))).drop("w", "e")


def test_area_weights(spark):
    cells = square(spark, [("a", 0.0, 1.0), ("b", 1.0, 2.0)]).withColumnRenamed("key", "hex_id")
    grid = square(spark, [("g", 0.0, 2.0, 100.0, 20.0)], ", pop double, old double")
    got = spatial.spread_by_source(grid, cells, ["pop", "old"], "key", 1.5)
    assert got.agg(F.sum("living_pop"), F.sum("living_old")).first() == (100.0, 20.0)
    three = square(spark, [("a", 0.0, 1.0), ("b", 1.0, 3.0), ("c", 3.0, 4.0), ("d", 8.0, 9.0)]).withColumnRenamed("key", "hex_id")
    admin = square(spark, [("x", 0.0, 2.0, 100.0), ("y", 2.0, 4.0, 300.0)], ", pop double")
    got = rows(spatial.spread_kept(admin, three, ["pop"], "key", 1.5).select("hex_id", "pop", "registered_hex_coverage_ratio"), "hex_id")
    assert got == [("a", 50.0, 1.0), ("b", 200.0, 1.0), ("c", 150.0, 1.0), ("d", 0.0, 0.0)]
    wide = square(spark, [("x", 0.0, 4.0, 100.0)], ", pop double")
    assert [r[1] for r in rows(spatial.spread_kept(wide, cells, ["pop"], "key", 1.5).select("hex_id", "pop"), "hex_id")] == [50.0, 50.0]


def test_snap_nearest_and_labels(spark):
    points = spark.createDataFrame([("near", 1.0, 0.0), ("far", 1000.0, 0.0), ("edge", 0.0, 10.0)], "k string, x double, y double")
    nodes = spark.createDataFrame([(10, 0.0, 0.0)], "node_id long, x double, y double")
    assert rows(spatial.snap(points, nodes, ["k"], 10.0), "k") == [("edge", 10, 10.0), ("far", None, None), ("near", 10, 1.0)]
    ties = spark.createDataFrame([(1, 0.0, 0.0), (2, 2.0, 0.0)], "node_id long, x double, y double")
    assert spatial.snap(points.where("k = 'near'"), ties, ["k"], 10.0).count() == 2 and spatial.snap(points.where("k = 'near'"), ties, ["k"], 10.0, unique=True).count() == 1
    assert rows(spatial.nearest(points, nodes, "k", "node_id", 5.0), "k") == [("edge", 10, 10.0), ("far", 10, 1000.0), ("near", 10, 1.0)]
    inside, outside = spatial.split_by_boundary(points, square(spark, [("b", 0.0, 5.0)]))
    assert [r.k for r in inside.collect()] == ["near"] and outside.count() == 2
    assert spatial.split_by_boundary(points, square(spark, [("b", 0.0, 5.0)]), buffer=9.0)[0].count() == 2
    cells = square(spark, [("h1", 0.0, 1.0), ("h2", 1.0, 2.0)]).withColumnRenamed("key", "hex_id")
    areas = square(spark, [("A", 0.0, 1.1), ("B", 1.1, 3.0)]).withColumnRenamed("key", "admin_name")
    assert [(r.hex_id, r.admin_name) for r in spatial.label(cells, areas, ["admin_name"], 1.0).orderBy("hex_id").collect()] == [("h1", "A"), ("h2", "B")]
    grid = spatial.hex_grid(spark.range(1).select(g.ring([(0, 0), (5000, 0), (5000, 5000), (0, 5000)]).alias("ring")), 200.0)
    assert grid.count() == grid.select("hex_id").distinct().count() and grid.count() == pytest.approx(25e6 / 103923, rel=0.1)
    with pytest.raises(ValueError, match="empty"):
        spatial.hex_grid(grid.limit(0), 200.0)


def test_stops_and_weather(spark):
    rides = spark.createDataFrame([("s", "a", "10", 126.98, 37.56, "True"), ("s", "a", "20", 126.98, 37.56, "1"), ("s", "a", "5", 126.98, 37.56, "False"), ("t", "b", "5", 120.0, 37.56, "True")], "id string, name string, passengers string, lon double, lat double, location_matched string")
    assert rows(population.stop_candidates(rides, "subway", "id", "name").select("stop_id", "passengers_sum", "source_rows"), "stop_id") == [("s", 30.0, 2)]
    raw = spark.createDataFrame([("2025-01-01 01:00", None, "x"), ("bad", "2", "1.5")], "`일시` string, `강수량(mm)` string, `기온(°C)` string")
    assert [(r.rain_mm, r.temp_c, r.observed_at is None) for r in population.normalised_weather(raw).collect()] == [(0.0, 0.0, False), (2.0, 1.5, True)]
    poi = population.normalised_pois(spark.createDataFrame([("", "병원", "127.0", "x", "7")], "`기관명` string, `상호명` string, lon string, lat string, `연번` string"), "hospital").first()
    assert (poi.poi_id, poi.name, poi.category, poi.lon, poi.lat) == ("7", "병원", None, 127.0, None)
    bus = population.normalised_stops(spark.createDataFrame([("100", "종로", "5")], "`표준버스정류장ID` string, `역명` string, passengers string"), "bus").first()
    assert (bus.stop_id, bus.stop_name, bus.passengers, bus.lon) == ("100", "종로", 5.0, None)


def test_quality_reports(spark):
    df = spark.createDataFrame([("126.98", "37.56", "10"), ("129", "35", "-1"), ("bad", "37", "fast"), (None, None, "")], "lon string, lat string, v string")
    assert reports.coordinate_issues(df).first() == (4, 2, 1)
    assert reports.range_issues(df, {"v": (0, 30)}).first() == ("v", 1, 1, 0)
    assert reports.contract_issues(df, "poi") == [] and "node_id" in reports.contract_issues(df, "walking_nodes")
    assert reports.table_hash(df).first() == reports.table_hash(df.repartition(3).orderBy("v")).first() != reports.table_hash(df.limit(2)).first()
    assert reports.same_rows(df, df.orderBy("v")) and not reports.same_rows(df, df.limit(1))


def test_senior_and_robustness(spark):
    e = spark.createDataFrame([(1, 2, 90.0, 0.0, "steps"), (3, 2, 90.0, 0.0, None), (1, 3, 900.0, 0.0, None), (4, 2, 90.0, 0.0, "steps")], "u long, v long, length_m double, grade_percent double, highway string").withColumn("grade_abs_percent", F.abs("grade_percent"))
    cells = spark.createDataFrame([("a", 1, 1.0, 1.0), ("b", 3, 2.0, 1.0), ("c", 4, 3.0, 1.0)], "hex_id string, origin_node_id long, senior double, access_cost_m0 double")
    long = sensitivity.senior_variants(edges.senior_minutes(e), spark.createDataFrame([(2,)], "node long"), cells, "senior")
    assert long.count() == 27
    barred = long.where("hex_id = 'c' and step_policy = 'steps_barrier'").first()
    assert barred.minutes is None and barred.vulnerable and not barred.reachable
    assert [(r.hex_id, r.no_alternative, r.uses_steps) for r in sensitivity.steps_dependence(long).orderBy("hex_id").collect()] == [("a", False, True), ("b", False, False), ("c", True, True)]
    assert sensitivity.reordering(0.97, 0.9) == "reordered" and sensitivity.reordering(0.99, 0.81) == "stable"


def test_nearest_far_clustered_and_missing(spark):
    """Far points, thousands of targets at one spot, ties and missing places, against all pairs."""
    import random

    from terrane.operators import spatial

    rng = random.Random(7)
    targets = [(k, 1000 + rng.random(), 1000 + rng.random()) for k in range(1500)] + [(2000 + k, rng.uniform(0, 50_000), rng.uniform(0, 50_000)) for k in range(40)]
    targets += [(5000, 10.0, 10.0), (4999, 10.0, 10.0), (6000, None, 3.0)]
    points = [(k, rng.uniform(-20_000, 70_000), rng.uniform(-20_000, 70_000)) for k in range(60)] + [(100, 10.0, 10.0), (101, 1000.5, 1000.5), (102, None, 1.0)]
    p = spark.createDataFrame(points, "id long, x double, y double")
    t = spark.createDataFrame(targets, "t long, x double, y double")
    got = {r.id: (r.t, r.distance) for r in spatial.nearest(p, t, "id", "t", 50.0).collect()}
    want = {}
    for k, x, y in points:
        if x is not None:
            d, best = min((((x - a) ** 2 + (y - b) ** 2) ** 0.5, n) for n, a, b in targets if a is not None)
            want[k] = (best, d)
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    none = spatial.nearest(p, t.limit(0), "id", "t", 50.0).collect()
    assert len(none) == len(points) and all(r.t is None for r in none)


def test_best_of_each_type(spark):
    from terrane.operators import vulnerability

    rows = [(f"h{k}", float(k % 10), float(k % 3), "ab"[k % 2]) for k in range(60)] + [("n", 99.0, 1.0, None)]
    cells = spark.createDataFrame(rows, "hex_id string, vulnerability_m3_final double, registered_population double, vulnerability_type string")
    got = vulnerability.leading_by_type(cells, 4).collect()
    for name in ("all", "a", "b"):
        own = [r for r in rows if r[3] is not None and name in ("all", r[3])]
        want = [r[0] for r in sorted(own, key=lambda r: (-r[1], -r[2], r[0]))[:4]]
        assert [r.hex_id for r in sorted((r for r in got if r["list"] == name), key=lambda r: r.rank)] == want


def test_reach_gaps_by_direct_streets(spark, monkeypatch):
    """A street between all pairs in the circle: no source needs more than its own streets, or a round would try every two of them."""
    spots = {k: (float(k * 37 % 101), float(k * 61 % 97)) for k in range(120)}
    nodes = spark.createDataFrame([(k, *p) for k, p in spots.items()], "node_id long, x double, y double")
    d = {(a, b): ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5 for a, p in spots.items() for b, q in spots.items()}
    near = {k: v for k, v in d.items() if v <= 30}
    streets = spark.createDataFrame([(a, b, v * 1.2, v * 2) for (a, b), v in near.items() if a != b], "u long, v long, cost_m0 double, cost_m3 double")
    want = [(a, b, "reached" if 2 * v <= 30 else "slope" if 1.2 * v <= 30 else "detour") for (a, b), v in sorted(near.items())]
    asked = nodes.select(F.col("node_id").alias("node"))

    def routed(*args):
        raise AssertionError("routed")

    with monkeypatch.context() as patch:
        patch.setattr(routing, "reach_within", routed)
        assert rows(routing.reach_gaps(nodes, streets, asked, 30.0), "source", "node") == want
    # without one street its end is reached by two others, if at all; parallel streets count once
    lost = next(k for k, v in near.items() if k[0] != k[1] and v <= 14 and any(near.get((k[0], m), 99) + near.get((m, k[1]), 99) <= 15 for m in spots if m not in k))
    assert rows(routing.reach_gaps(nodes, streets.where(~((F.col("u") == lost[0]) & (F.col("v") == lost[1]))), asked, 30.0), "source", "node") == want
    assert rows(routing.reach_gaps(nodes, streets.union(streets.where("u < 3")), asked, 30.0), "source", "node") == want


def test_reach_gaps_by_shortcuts(spark):
    """Ways under the straight distance lead round the circle; a node without a place may lie on one."""
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 25.0, 0.0), (3, 5.0, 0.0), (4, None, None)], "node_id long, x double, y double")
    streets = spark.createDataFrame([(1, 2, 1.0, 9.0), (2, 3, 1.0, 9.0), (3, 4, 1.0, 1.0)], "u long, v long, cost_m0 double, cost_m3 double")
    got = rows(routing.reach_gaps(nodes, streets, spark.createDataFrame([(1,), (3,)], "node long"), 10.0), "source", "node")
    assert got == [(1, 1, "reached"), (1, 3, "slope"), (3, 1, "detour"), (3, 3, "reached")]


@pytest.mark.parametrize("most", [None, 3])
def test_counts_within_without_pairs(spark, monkeypatch, most):
    """As many points as containing() has pairs, on slanted, holed, crossing and double shapes, corners and borders, also in blocks; but no row for each pair."""
    if most:
        monkeypatch.setattr(spatial, "_BLOCK_POINTS", most)
        monkeypatch.setattr(spatial, "_BLOCK_AREAS", 1)
    shapes = [
        ("holed", [[(0, 0), (12, 0), (12, 9), (0, 9)], [(2, 6), (4, 6), (4, 2), (2, 2)]]), ("slanted", [[(1, 1), (11, 4), (5, 9)]]), ("crossing", [[(0, 0), (8, 8), (8, 0), (0, 8)]]),
        ("two", [[(0, 0), (3, 0), (3, 3), (0, 3)], [], [(6, 6), (9, 6), (9, 9), (6, 9)]]), ("far", [[(50, 50), (51, 50), (51, 51)]]), ("empty", []), ("none", None),
    ]
    shapes = [(name, rings and [[(float(x), float(y)) for x, y in r] for r in rings]) for name, rings in shapes]
    areas = spark.createDataFrame(shapes, f"area string, rings {g.SHAPE}")
    points = [(x / 2, y / 2) for x in range(-2, 28) for y in range(-2, 22)] + [(1.5, 1.5)] * 5 + [(None, 1.0), (1.0, None), (float("nan"), 1.0), (1.0, float("nan"))]
    points = spark.createDataFrame(points, "x double, y double")
    want = spatial.containing(points, areas, 5.0).groupBy("area").count()
    got = spatial.counted_within(points, areas, "area", 5.0)
    assert rows(got, "area") == rows(want, "area") and got.count() == 4
    assert "shape_within" not in got._jdf.queryExecution().toString() and "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString()


def test_nearest_cost_by_limits(spark, monkeypatch):
    """Costs of all sizes, chains, far and cut-off nodes, as Dijkstra finds them; edges that lead to settled nodes are not followed again, and only one table of costs is kept."""
    import heapq
    import random

    pick = random.Random(4)
    e = [(pick.randrange(80), pick.randrange(80), pick.choice([0.0, 1.0, 7.0, 60.0]), pick.choice([None, 2.0, 9.0])) for _ in range(240)]
    e += [(100 + k, 99 + k if k else 3, 1.0, 500.0) for k in range(12)] + [(200, 100, 1e6, 1e6), (300, 301, 1.0, 1.0), (301, 300, 1.0, 1.0)]
    goals = [3, 17, 999]
    kept, writes = [], store.Rewritten.write
    monkeypatch.setattr(store.Rewritten, "write", lambda self, df: (writes(self, df), kept.append(self.path))[0])

    def dijkstra(k):
        best, heap = {}, [(0.0, g) for g in goals if any(g in x[:2] for x in e)]
        while heap:
            c, n = heapq.heappop(heap)
            if n not in best:
                best[n] = c
                for x in e:
                    if x[1] == n and x[k] is not None:
                        heapq.heappush(heap, (c + x[k], x[0]))
        return best

    a, b = dijkstra(2), dijkstra(3)
    got = routing.nearest_cost(spark.createDataFrame(e, "u long, v long, a double, b double"), spark.createDataFrame([(g,) for g in goals], "node long"), ["a", "b"])
    assert rows(got, "node") == [(n, a.get(n), b.get(n)) for n in sorted(a.keys() | b.keys())]
    assert len(kept) > 3 and [Path(p.removeprefix("file:")).exists() for p in kept] == [False] * (len(kept) - 1) + [True]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("terrane_")]
