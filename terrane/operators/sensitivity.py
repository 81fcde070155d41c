"""How results hold: parameter variants, normalisations, thresholds, robust cores, environment burden, senior variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import senior, stats
from terrane.functions.cleaning import ratio
from terrane.functions.ranking import average_ranks, percent_ranks, quantile_bucket
from terrane.functions.scaling import scaled_all
from terrane.operators import routing
from terrane.operators.scenario import FrozenBaseline


def variant_flags(cells: DataFrame, by: str, cost: str, demand: str, m0: str = "access_cost_m0", q: float = 0.8, official_m: float = 400.0) -> DataFrame:
    """Cells of all variants at once, each scaled and cut by its own limits: score, vulnerable, hidden."""
    valid = F.col(cost).isNotNull() & F.col(demand).isNotNull()
    limits = cells.where(valid).groupBy(by).agg(F.min(cost).alias("_c0"), F.max(cost).alias("_c1"), F.min(demand).alias("_d0"), F.max(demand).alias("_d1"))
    # a row of limits for each variant: small enough, Spark broadcasts them
    out = cells.join(limits, by, "left")
    part = lambda x, a, b: ratio(F.col(x) - F.col(a), F.col(b) - F.col(a))
    out = out.withColumn("score", F.when(valid, part(cost, "_c0", "_c1") * part(demand, "_d0", "_d1"))).drop("_c0", "_c1", "_d0", "_d1")
    out = out.join(stats.quantiles(out, {"threshold": ("score", q)}, [by]), by, "left").withColumn("vulnerable", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)))
    return out.withColumn("hidden", F.col("vulnerable") & F.coalesce(F.col(m0) <= official_m, F.lit(False)))


def against_baseline(flags: DataFrame, baseline: DataFrame, by: str, key: str = "hex_id", flag: str = "hidden") -> DataFrame:
    """Each variant against a baseline (key, flag): counts, Jaccard, share of the baseline's cells that were replaced."""
    base = baseline.select(key, F.col(flag).alias("_base"))
    return flags.join(base, key, "left").groupBy(by).agg(
        F.count_if(flag).alias("count"), F.count_if("_base").alias("baseline_count"), stats.jaccard("_base", flag).alias("jaccard"), stats.dropped_share("_base", flag).alias("replacement_rate")
    )


#: Score of each normalisation, from cost and demand.
NORMALISATIONS = ("base", "winsor", "log1p", "rank", "additive")


def normalised_variants(cells: DataFrame, cost: str, demand: str, share: float = 0.2, key: str = "hex_id") -> DataFrame:
    """Cells with score_<variant> and top_<variant>: min-max, after winsorising, after log1p, percent ranks, and the mean instead of the product."""
    limits = stats.quantile_values(cells, {f"{c}{q}": (c, q) for c in (cost, demand) for q in (0.01, 0.99)})
    held = lambda c, low, high: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(low)), F.lit(high)))
    sources = {}
    for k, (c, name) in enumerate(((cost, "c"), (demand, "d"))):
        sources |= {f"_base_{name}": F.col(c), f"_winsor_{name}": held(c, *limits[2 * k : 2 * k + 2]), f"_log1p_{name}": F.log1p(F.col(c))}
    out = percent_ranks(scaled_all(cells, sources, constant=None), {cost: "_rank_c", demand: "_rank_d"})
    for v in NORMALISATIONS[:4]:
        out = out.withColumn(f"score_{v}", F.col(f"_{v}_c") * F.col(f"_{v}_d")).drop(*(() if v == "base" else (f"_{v}_c", f"_{v}_d")))
    out = out.withColumn("score_additive", (F.col("_base_c") + F.col("_base_d")) / 2).drop("_base_c", "_base_d")
    tops = stats.quantile_values(out, {v: (f"score_{v}", 1 - share) for v in NORMALISATIONS})
    return out.withColumns({f"top_{v}": F.coalesce(F.col(f"score_{v}") >= F.lit(x), F.lit(False)) for v, x in zip(NORMALISATIONS, tops, strict=True)})


def robust_core(flags: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows with in how many variants they are flagged, in all (core), in any, in some but not all (sensitive)."""
    values = [F.coalesce(F.col(n), F.lit(False)) for n in names]
    n = sum((v.cast("int") for v in values), F.lit(0))
    return flags.withColumns({"variant_count": n, "robust_core": n == len(names), "any_variant": n > 0, "sensitive": (n > 0) & (n < len(names))})


def core_over(rows: DataFrame, key: str, flag: str) -> DataFrame:
    """The same from a long table with a row per variant: flagged in all."""
    return rows.groupBy(key).agg(F.bool_and(F.coalesce(flag, F.lit(False))).alias("robust_core"), F.bool_or(F.coalesce(flag, F.lit(False))).alias("any_variant"))


def burden_by_area(cells: DataFrame, area: str, increase: str, flags: Sequence[str]) -> DataFrame:
    """Areas with counts, flags, mean and 90th percentile, the heaviest first; cells without an area don't count."""
    some = cells.where(F.col(area).isNotNull())
    sums = some.groupBy(area).agg(F.count("*").alias("hex_count"), *(F.count_if(f).alias(f"{f}_count") for f in flags), F.avg(increase).alias("mean_increase"))
    return sums.join(stats.quantiles(some, {"p90_increase": (increase, 0.9)}, [area]), area, "left").orderBy(*(F.desc(f"{f}_count") for f in flags[:2]), F.desc("mean_increase"), area)


def quadrants(cells: DataFrame, x: str, y: str, flag: str, key: str = "hex_id", k: int = 4) -> DataFrame:
    """k x k table of equal-frequency buckets with counts and share of flagged cells, empty ones included."""
    out = quantile_bucket(quantile_bucket(cells, x, key, "_x", k), y, key, "_y", k)
    sums = out.where("_x is not null and _y is not null").groupBy("_x", "_y").agg(F.count("*").alias("cells"), F.count_if(flag).alias("flagged"))
    spark = cells.sparkSession
    steps = spark.range(1, k + 1)
    whole = steps.select(F.col("id").cast("int").alias("_x")).join(steps.select(F.col("id").cast("int").alias("_y")), F.lit(True))
    out = whole.join(sums, ["_x", "_y"], "left").fillna(0, subset=["cells", "flagged"])
    return out.select(F.col("_x").alias("x_bucket"), F.col("_y").alias("y_bucket"), "cells", "flagged", ratio("flagged", "cells").alias("flagged_share"))


def environment_burden(cells: DataFrame, demand: str, m0: str = "access_cost_m0", m3: str = "access_cost_m3", q: float = 0.8, official_m: float = 400.0, hidden_flag: str = "hidden_vulnerable_final") -> DataFrame:
    """Cells under m0 and m3 on limits frozen on m0: increase, ranks and their shift, crossings, and a label."""
    frozen = FrozenBaseline.fit(cells, m0, demand, q)
    a, b = F.col(m0), F.col(m3)
    out = cells.withColumns({
        "increase": b - a, "increase_pct": 100 * ratio(b - a, a), "score_m0": frozen.vulnerability(m0, demand), "score_m3": frozen.vulnerability(m3, demand),
        "vulnerable_m0": frozen.vulnerable(m0, demand), "vulnerable_m3": frozen.vulnerable(m3, demand),
    })
    out = average_ranks(out, {"score_m0": "rank_m0", "score_m3": "rank_m3"}, descending=True)
    crossed = F.coalesce((a <= official_m) & (b > official_m), F.lit(False))
    new = F.col("vulnerable_m3") & ~F.col("vulnerable_m0")
    hidden = F.coalesce(F.col(hidden_flag), F.lit(False)) if hidden_flag in cells.columns else F.lit(False)
    label = F.when(new, "threshold_crossing_under_environment_cost").when(crossed, "distance_standard_crossing").when(hidden, "hidden_vulnerable_under_m3_threshold").otherwise("no_crossing")
    return out.withColumns({"rank_shift": F.col("rank_m0") - F.col("rank_m3"), "crossed_400m": crossed, "new_vulnerable": new, "burden_label": label})


def senior_variants(edges: DataFrame, destinations: DataFrame, cells: DataFrame, exposure: str, node: str = "origin_node_id", reference: tuple[str, str] = ("rain", "steps_penalty"), q: float = 0.8, official_m: float = 400.0) -> DataFrame:
    """Long table of cells x weather x steps policy: minutes, score and flags on limits frozen on the reference; unreachable counts as vulnerable.

    Weather multiplies every edge alike, so only the three policies are routed,
    all in one pass, and their minutes are scaled.
    """
    policies = list(senior.STEPS)
    found = routing.nearest_cost(edges, destinations, [f"minutes_{p}" for p in policies])
    wide = cells.join(found.withColumnRenamed("node", node), node, "left")
    long = wide.select(
        "hex_id", exposure, "access_cost_m0",
        F.explode(F.array(*(
            F.struct(F.lit(w).alias("weather_profile"), F.lit(p).alias("step_policy"), (F.col(f"minutes_{p}") * f).alias("minutes")) for w, f in senior.WEATHER.items() for p in policies
        ))).alias("v"),
    ).select("hex_id", exposure, "access_cost_m0", "v.*")
    base = long.where((F.col("weather_profile") == reference[0]) & (F.col("step_policy") == reference[1]) & F.col("minutes").isNotNull())
    frozen = FrozenBaseline.fit(base, "minutes", exposure, q)
    flag = F.col("minutes").isNull() | frozen.vulnerable("minutes", exposure)
    near = F.coalesce(F.col("access_cost_m0") <= official_m, F.lit(False))
    return long.withColumns({
        "score": frozen.vulnerability("minutes", exposure), "reachable": F.col("minutes").isNotNull(), "vulnerable": flag, "hidden": flag & near,
        **{f"minutes_{s}": senior.rescaled("minutes", s) for s in senior.SPEEDS},
    })


def steps_dependence(long: DataFrame, weather: str = "rain") -> DataFrame:
    """Cells: whether the way uses steps (barred or longer without them), and whether there is no other."""
    side = lambda p: F.max(F.when(F.col("step_policy") == p, F.col("minutes")))
    out = long.where(F.col("weather_profile") == weather).groupBy("hex_id").agg(side("steps_allowed").alias("allowed"), side("steps_barrier").alias("barrier"))
    none = F.col("barrier").isNull() & F.col("allowed").isNotNull()
    return out.withColumns({"no_alternative": none, "uses_steps": none | F.coalesce(F.col("barrier") - F.col("allowed") > 1e-9, F.lit(False))})


def reordering(spearman: float | None, jaccard: float | None) -> str:
    """Verdict on two rankings."""
    return "reordered" if (spearman is not None and spearman < 0.98) or (jaccard is not None and jaccard < 0.80) else "stable"


def parameter_scan(cells: DataFrame, scale: DataFrame, demand: str) -> DataFrame:
    """Cells under scaled cost increments without routing anew: scale has (variant, slope, weather, interaction) factors (a handful of rows)."""
    a, b, c, d = (F.col(f"access_cost_m{k}") for k in range(4))
    cost = a + F.col("slope") * (b - a) + F.col("weather") * (c - b) + F.col("interaction") * (d - c)
    return cells.crossJoin(F.broadcast(scale)).withColumn("cost", cost).select("variant", "hex_id", "access_cost_m0", demand, "cost")


def weather_response(cells: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Cells with response_score: weighted sum of percent ranks of the named columns."""
    out = percent_ranks(cells, {name: f"_p{k}" for k, name in enumerate(weights)})
    return out.withColumn("response_score", sum((F.col(f"_p{k}") * w for k, w in enumerate(weights.values())), F.lit(0.0))).drop(*(f"_p{k}" for k in range(len(weights))))


def actions(tests: dict[str, Column], default: str) -> Column:
    """Names of the tests that hold, in order, without repeats, joined by ", "."""
    named = F.array_distinct(F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())), lambda x: x.isNotNull()))
    return F.when(F.size(named) > 0, F.array_join(named, ", ")).otherwise(F.lit(default))


def greatest_name(values: dict[str, Column]) -> Column:
    """Name of the greatest value; of equal ones the first."""
    top = F.greatest(*values.values())
    out = F.lit(None).cast("string")
    for name, value in reversed(values.items()):
        out = F.when(value == top, F.lit(name)).otherwise(out)
    return out


def burden_class(metres: Column | str, limits: Sequence[float] = (10, 25, 50, 75, 100), missing: str = "자료 없음") -> Column:
    """Class of a rise in cost by upper limits (excluded)."""
    c = F.col(metres) if isinstance(metres, str) else metres
    label = F.lit(f"{limits[-1]:g}m 이상")
    for low, high in reversed(list(zip([0, *limits], limits, strict=False))):
        label = F.when(c < high, F.lit(f"{low:g}-{high:g}m")).otherwise(label)
    return F.when(c.isNull(), F.lit(missing)).otherwise(label)


def policy_label(tests: dict[str, Column], default: str = "none") -> Column:
    """Name of the first test that holds."""
    label = F.lit(default)
    for name, test in reversed(tests.items()):
        label = F.when(F.coalesce(test, F.lit(False)), F.lit(name)).otherwise(label)
    return label


#: Labels of the main reasons and of the policies, the first that holds.
REASON_LABELS = {
    "slope_weather_penalty": "경사·기상 부담형", "high_demand": "수요집중형", "high_demand_plus_slope_weather_penalty": "복합형", "mixed": "혼합형",
    "near_400m_distance": "400m 경계형", "high_demand_plus_near_400m_distance": "수요+경계형",
}
POLICIES = {
    "step_no_alt": "계단·눈 대체경로 없음", "s4_weather_sensitive": "S4 기상 민감 후보", "s1_resolved_hidden": "S1 정류장·접근로 검토", "uses_steps": "계단 사용 경로",
}


def reason_label(reason: Column | str) -> Column:
    """Label of a reason; unknown ones as they are."""
    c = F.col(reason) if isinstance(reason, str) else reason
    label = c
    for code, name in REASON_LABELS.items():
        label = F.when(c == code, F.lit(name)).otherwise(label)
    return label


def merged_policies(cells: DataFrame, flags: dict[str, tuple[DataFrame, str]], key: str = "hex_id") -> DataFrame:
    """All cells with a column for each flag (name: table and its column); cells that a table lacks are not flagged. Tables have a row for a cell at most."""
    out = cells
    for name, (rows, column) in flags.items():
        out = out.join(rows.select(key, F.col(column).alias(name)), key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
    return out


def policy_candidates(cells: DataFrame) -> DataFrame:
    """Cells that any policy flag marks, with the label of the first."""
    flags = {name: F.coalesce(F.col(flag), F.lit(False)) for flag, name in POLICIES.items()}
    any_flag = F.lit(False)
    for flag in flags.values():
        any_flag = any_flag | flag
    return cells.where(any_flag).withColumn("policy_review_type", policy_label(flags, "기타"))


#: Weights of the percent ranks in the weather response.
RESPONSE_WEIGHTS = {
    "weather_effect": 0.34, "total_env_increment_m3_m0": 0.18, "vulnerability_m3_final": 0.16, "demand_index_final": 0.12, "access_cost_m3": 0.10, "registered_senior_population": 0.10,
}


def weather_candidates(cells: DataFrame, top: int | None = None) -> DataFrame:
    """Diagnosed cells with weather pressures, the score, low-cost actions and the leading kind, the highest score first."""
    slope, weather, both = F.col("slope_increment_m1_m0"), F.col("weather_additive_increment_m2_m1"), F.col("interaction_increment_m3_m2")
    pressures = {"snow_ice_pressure": slope + both, "anti_slip_pressure": 0.7 * slope + 1.3 * both, "drainage_pressure": 0.85 * weather + 0.35 * both}
    out = cells.withColumns({"weather_effect": weather + both, **pressures})
    out = percent_ranks(out, {name: f"{name}_pct" for name in (*pressures, "weather_effect")})
    snow, slip, water, effect = (F.col(f"{n}_pct") for n in ("snow_ice_pressure", "anti_slip_pressure", "drainage_pressure", "weather_effect"))
    tests = {
        "제설 우선순위": (snow >= 0.75) | ((F.col("slope_increment_share") >= 0.65) & (effect >= 0.6)),
        "배수/침수 점검": (water >= 0.75) | ((F.col("weather_additive_increment_share") >= 0.22) & (effect >= 0.7)),
        "미끄럼 방지 포장": (slip >= 0.75) | (F.col("interaction_increment_share") >= 0.06),
    }
    out = weather_response(out, RESPONSE_WEIGHTS).withColumnRenamed("response_score", "scenario3_score")
    out = out.withColumn("recommended_actions", actions(tests, "현장 점검"))
    out = out.withColumn("primary_low_cost_type", greatest_name({"제설 우선구간": snow, "배수 불량/침수 가능": water, "미끄럼 방지 포장": slip}))
    out = out.orderBy(F.desc("scenario3_score"), F.desc("vulnerability_m3_final"), "hex_id")
    return out if top is None else out.limit(top)


def leading_by_group(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Groups with rows, and the most frequent value (of equals the least)."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(group).agg(F.sum("n").alias("rows"), F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("b"))
    return best.select(group, "rows", F.col("b.v").alias(f"top_{value}"), (-F.col("b.n")).alias("top_count"))


def relabel(rows: DataFrame, labels: DataFrame, key: str, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with label columns dropped and joined anew (first by the names' order where keys repeat); and their missing values before and after."""
    first = labels.groupBy(key).agg(F.min(F.struct(*names)).alias("_l")).select(key, "_l.*")
    out = rows.drop(*names).join(first, key, "left")
    missing = lambda df, when: df.agg(F.lit(when).alias("stage"), F.count("*").alias("rows"), *((F.count_if(F.col(n).isNull()) if n in df.columns else F.count("*")).alias(f"{n}_missing") for n in names))
    return out, missing(rows, "before").union(missing(out, "after"))
