"""Expressions, ranks, scaling and statistics against hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from terrane.functions import cleaning, costs, geometry, ranking, scaling, senior, stats


def values(spark, column, rows=((),), schema="x int"):
    return [r[0] for r in spark.createDataFrame([(1,)] if rows == ((),) else rows, schema).select(column).collect()]


def test_cost_models(spark):
    df = spark.createDataFrame([(100.0, 10.0), (100.0, -47.7), (100.0, None)], "l double, g double")
    i = costs.weather_intensity(F.lit(2.0), F.lit(None))
    got = df.select(*(costs.cost(m, "l", "g", i).alias(m) for m in ("M0", "m1", "M2", "m3"))).collect()
    assert [round(x, 6) for x in got[0]] == [100, 130, 137.8, 139.88]
    assert got[1]["m1"] == pytest.approx(190) and got[2]["m1"] is None and got[2]["M0"] == 100
    with pytest.raises(ValueError, match="unknown"):
        costs.cost("m9", "l", "g", i)
    assert costs.CostParameters.of({"alpha": 0.05, "rain_weight": 9}).alpha == 0.05


def test_grades_and_weather(spark):
    df = spark.createDataFrame([("684.6",), ("-8",), ("",), ("x",), (None,)], "g string")
    assert [r[0] for r in df.select(costs.sane_grade("g")).collect()] == [None, 8.0, None, None, None]
    assert values(spark, costs.weather_intensity(F.lit(-1), F.lit(0.5))) == [2.5]
    assert values(spark, costs.friction(F.lit(-100), F.lit(0))) == [1.0]
    assert values(spark, costs.minutes(F.lit(67.0))) == [1.0]


def test_senior(spark):
    assert values(spark, senior.base_minutes(F.lit(90.0)))[0] == pytest.approx(1.6667, abs=1e-4)
    assert values(spark, senior.base_minutes(F.lit(90.0), 1.12))[0] == pytest.approx(1.3393, abs=1e-4)
    for grade, want in ((0, 1.0), (5, math.exp(0.175)), (-5, 1.0), (90, math.exp(3.5 * 0.3))):
        assert values(spark, senior.slope_factor(F.lit(float(grade))))[0] == pytest.approx(want)
    steps = spark.createDataFrame([("['steps', 'path']",), ("footway",), (None,)], "h string")
    for policy, want in (("steps_allowed", [1, 1, 1]), ("steps_penalty", [3, 1, 1]), ("steps_barrier", [None, 1, 1])):
        assert [r[0] for r in steps.select(senior.steps_factor("h", policy)).collect()] == want
    assert values(spark, senior.rescaled(F.lit(7.0), "very_slow"))[0] == pytest.approx(9.0)
    for wrong in (lambda: senior.weather_factor("hail"), lambda: senior.steps_factor("h", "no"), lambda: senior.base_minutes("h", 0)):
        with pytest.raises(ValueError, match="."):
            wrong()
    bands = spark.createDataFrame([(2.0,), (-5.0,), (8.33,), (12.0,), (13.0,), (None,)], "g double")
    assert [r[0] for r in bands.select(senior.grade_band("g")).collect()] == ["near_flat", "mild", "ramp_like", "steep", "very_steep", None]


def test_cleaning(spark):
    df = spark.createDataFrame([("TRUE ", "2,000", "1106081.0", "홍제 제1동", "NaN"), ("no", "-", None, "종로1·2가동", "x")], "a string, b string, c string, d string, e string")
    got = df.select(cleaning.truthy("a"), cleaning.counted("b"), cleaning.code("c"), cleaning.dong_key("d"), cleaning.number("e")).collect()
    assert [tuple(r) for r in got] == [(True, 2000, "1106081", "홍제1동", None), (False, None, "", "종로12가동", None)]
    box = spark.createDataFrame([("126.98", "37.56"), ("129", "35"), ("bad", "37.5"), (None, None)], "x string, y string")
    assert [r[0] for r in box.select(cleaning.in_box("x", "y")).collect()] == [True, False, False, False]
    with pytest.raises(KeyError):
        cleaning.require(df, ["a", "zz"])
    assert values(spark, cleaning.ratio(F.lit(1), F.lit(0))) == [None]
    assert cleaning.round_numeric(spark.createDataFrame([(0.5, 2.5)], "a double, b double"), 0).first() == (0.0, 2.0)
    assert cleaning.fill_numeric(spark.createDataFrame([(None, None)], "hex_id long, v double")).first() == (None, 0.0)


def test_ranks(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 4.0), (3, 9.0), (4, None), (5, 1.0)], "k int, x double")
    up = {r.k: r.r for r in ranking.average_rank(df, "x", "r").collect()}
    down = {r.k: r.r for r in ranking.average_rank(df, "x", "r", descending=True).collect()}
    assert up == {1: 2.5, 2: 2.5, 3: 4.0, 4: None, 5: 1.0} and down == {1: 2.5, 2: 2.5, 3: 1.0, 4: None, 5: 4.0}
    assert {r.k: r.r for r in ranking.percent_rank(df, "x", "r").collect()}[3] == 1.0
    for n, want in ((10, [3, 2, 2, 3]), (7, [2, 2, 1, 2])):
        got = ranking.quantile_bucket(spark.range(n).select("id", F.col("id").alias("v")), "v", "id", "b").groupBy("b").count().orderBy("b").collect()
        assert [r[1] for r in got] == want


def test_scaling(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (30.0,)], "x double")
    fitted = scaling.Fitted.of(df, "x")
    assert [r[0] for r in spark.createDataFrame([(5.0,), (20.0,), (25.0,)], "x double").select(fitted.apply("x")).collect()] == [-0.25, 0.5, 0.75]
    flat = spark.createDataFrame([(2.0,), (None,)], "x double")
    assert [r.s for r in scaling.scaled(flat, "x", "s").collect()] == [0.0, None]
    assert [r.s for r in scaling.scaled(flat, "x", "s", constant=None).collect()] == [None, None]
    assert [r.s for r in scaling.scaled(flat, "x", "s", missing_as_zero=True).collect()] == [1.0, 0.0]


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (2.0, 1.0, 1.0), (3.0, 10.0, 1.0)], "x double, w double, one double")
    assert stats.weighted_percentile(df, "x", 50, "one").first()[0] == 2 and stats.weighted_percentile(df, "x", 50, "w").first()[0] == 3
    assert stats.gini(df, "x", "w").first()[0] == pytest.approx(0.078283, abs=1e-6)
    assert stats.gini(df, "one").first()[0] == pytest.approx(0) and stats.theil(df, "one").first()[0] == pytest.approx(0)
    assert stats.theil(df, "x").first()[0] > 0
    assert spark.createDataFrame([(1.0, 1.0), (3.0, 3.0)], "x double, w double").agg(stats.weighted_mean("x", "w")).first()[0] == 2.5
    assert spark.createDataFrame([(float(k),) for k in range(1, 5)], "x double").agg(stats.quantile("x", 0.5)).first()[0] == 2.5
    flags = spark.createDataFrame([(True, False, 10), (True, True, 30), (False, False, 100)], "a boolean, b boolean, p int")
    assert flags.agg(stats.flagged_reduction("a", "b", "p"), stats.jaccard("a", "b"), stats.dropped_share("a", "b")).first() == (0.25, 0.5, 0.5)
    assert flags.where("p > 50").agg(stats.jaccard("a", "b"), stats.jaccard("a", "b", 1.0)).first() == (None, 1.0)


def test_geometry(spark):
    ring = geometry.ring([(0, 0), (4, 0), (4, 2), (0, 2)])
    tri = geometry.ring([(-1, -1), (3, -1), (-1, 3)])
    assert values(spark, geometry.area(ring)) == [8.0]
    assert values(spark, geometry.clipped_area(ring, tri)) == [2.0]
    assert values(spark, geometry.clipped_area(geometry.ring([(9, 9), (10, 9), (9, 10)]), tri)) == [0.0]
    x, y = geometry.centroid(ring)
    assert values(spark, F.struct(x, y)) == [(2.0, 1.0)]
    for px, py, inside, covered in ((1, 1, True, True), (4, 1, False, True), (0, 0, False, True), (5, 1, False, False)):
        point = (F.lit(float(px)), F.lit(float(py)))
        assert values(spark, geometry.within(ring, *point)) == [inside] and values(spark, geometry.covers(ring, *point)) == [covered]
    assert values(spark, geometry.border_distance(ring, F.lit(7.0), F.lit(6.0))) == [5.0]
    assert values(spark, geometry.line_length(geometry.line_from_wkt(F.lit("LINESTRING (0 0, 3 4, 3 5)")))) == [6.0]


def test_projection(spark):
    # the meridian's scale and the false origin fix these points
    x, y = geometry.project(F.lit(127.5), F.lit(38.0))
    assert values(spark, F.struct(F.round(x, 6), F.round(y, 6))) == [(1_000_000.0, 2_000_000.0)]
    x, y = geometry.project(F.lit(126.978), F.lit(37.5665))
    lon, lat = geometry.unproject(x, y)
    got = values(spark, F.struct(lon, lat))[0]
    assert got[0] == pytest.approx(126.978, abs=1e-8) and got[1] == pytest.approx(37.5665, abs=1e-8)
    x2, y2 = geometry.project(F.lit(126.978), F.lit(37.5675))
    metres = values(spark, F.hypot(x2 - x, y2 - y))[0]
    assert metres == pytest.approx(110.99 * 0.9996, abs=0.1)  # a thousandth of a degree of latitude here


def test_hexagons(spark):
    q, r = geometry.hex_at(F.lit(1234.5), F.lit(-987.6), 200.0)
    cx, cy = geometry.hex_center(q, r, 200.0)
    assert values(spark, F.hypot(cx - 1234.5, cy + 987.6))[0] <= 200.0
    assert values(spark, geometry.area(geometry.hex_ring(q, r, 200.0)))[0] == pytest.approx(1.5 * math.sqrt(3) * 200**2)


def test_quantiles_are_exact_beyond_the_sketch(spark):
    """More values than the sketch keeps, many ties, groups of one and of none."""
    import numpy as np

    rng = np.random.default_rng(3)
    wide = np.round(rng.normal(size=60_000) ** 3, 2)
    rows = spark.createDataFrame([("a", float(x)) for x in wide] + [("b", 1.0), ("c", None), (None, 5.0), (None, 7.0), ("d", 2.0), ("d", 2.0), ("d", 9.0)], "g string, x double").repartition(5)
    parts = {f"q{k}": q for k, q in enumerate((0.0, 0.001, 0.25, 0.5, 0.8, 0.995, 1.0))}
    got = {r.g: [r[n] for n in parts] for r in stats.quantiles(rows, {n: ("x", q) for n, q in parts.items()}, ["g"]).collect()}
    want = {"a": wide, "b": [1.0], None: [5.0, 7.0], "d": [2.0, 2.0, 9.0]}
    assert set(got) == set(want)
    for g, values in want.items():
        assert got[g] == pytest.approx(np.quantile(values, list(parts.values())).tolist(), abs=1e-12)
    one = stats.quantile_values(rows.where("g = 'a'"), {"m": ("x", 0.5), "n": (F.col("x") * 2, 0.9)})
    assert one == pytest.approx((np.quantile(wide, 0.5), 2 * np.quantile(wide, 0.9)))
    assert stats.quantiles(rows.limit(0), {"m": ("x", 0.5)}).collect() in ([], [(None,)])


def test_small_quantiles(spark):
    import numpy as np

    for n in range(1, 12):
        values = [float(k * k % 7) for k in range(n)]
        frame = spark.createDataFrame([(x,) for x in values], "x double")
        qs = [0.0, 0.01, 0.1, 0.5, 0.75, 0.9, 0.99, 1.0]
        assert stats.quantile_values(frame, {str(q): ("x", q) for q in qs}) == pytest.approx(np.quantile(values, qs).tolist(), abs=1e-12)


def test_trapezoids_unite_overlaps_and_keep_holes():
    from terrane.functions.union import trapezoids

    box = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n)]
    assert trapezoids([box(0, 0, 4, 4), box(2, 2, 6, 6)])[1] == pytest.approx(28)
    holed = [box(0, 0, 4, 4), box(1, 1, 3, 3)[::-1]]
    assert trapezoids(holed)[1] == pytest.approx(12)
    assert trapezoids([*holed, box(1, 1, 2, 3)])[1] == pytest.approx(14)
    assert trapezoids([[(0, 0), (4, 0), (2, 4)], [(0, 3), (2, -1), (4, 3)]])[1] == pytest.approx(trapezoids([[(0, 3), (2, -1), (4, 3)], [(0, 0), (4, 0), (2, 4)]])[1])
    assert trapezoids([]) == ([], 0.0)


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from types import SimpleNamespace

    from terrane.functions import store

    session = lambda master, named=None, checkpoint=None: SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: named), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint)
    )
    with pytest.raises(RuntimeError):
        store.shared_dir(session("spark://host:7077"))
    with pytest.raises(RuntimeError):
        store.shared_dir(session("local-cluster[2,1,512]"))
    assert store.shared_dir(session("yarn", named="hdfs://x/y/")) == "hdfs://x/y"
    assert store.shared_dir(session("yarn", checkpoint="hdfs://x/z")) == "hdfs://x/z"
    assert store.shared_dir(session("local[2]"))


def test_inequality_of_several_pairs_at_once(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.choice([0.0, 1.0, 2.5, 7.0, 90.0]) if rng.random() < 0.9 else None, rng.uniform(0, 100), float(rng.randrange(0, 9)), rng.choice([None, 1.0, 3.0])) for _ in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, p double, q double").repartition(4)
    pairs = {"ap": ("a", "p"), "bp": ("b", "p"), "aq": ("a", "q"), "bq": ("b", "q")}
    got = stats.inequality(df, pairs, 90)
    for name, (v, w) in pairs.items():
        assert got[name]["percentile"] == stats.weighted_percentile(df, v, 90, w).first()[0]
        assert got[name]["gini"] == pytest.approx(stats.gini(df, v, w).first()[0], abs=1e-12)
        assert got[name]["theil"] == pytest.approx(stats.theil(df, v, w).first()[0], abs=1e-12)
    assert stats.inequality(df.limit(0), {"x": ("a", "p")}, 90) == {"x": {"percentile": None, "gini": None, "theil": None}}
