"""Vulnerable and hidden vulnerable cells: scores, reasons, types, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.cleaning import numeric_columns, ratio, require
from terrane.functions.ranking import percent_ranks
from terrane.functions.scaling import Fitted
from terrane.functions.stats import quantile_values, quantiles
from terrane.functions.store import cut

COSTS = ("access_cost_m0", "access_cost_m1", "access_cost_m2", "access_cost_m3")


def _true(value: Column | str) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(False))


def score(cells: DataFrame, demand: str, suffix: str = "final", m0: str = "access_cost_m0", m3: str = "access_cost_m3", q: float = 0.8, official_m: float = 400.0) -> DataFrame:
    """Normalised cost times normalised demand of valid cells, its threshold (a quantile), and the flags.

    Valid cells have both demand and cost. A cell at the threshold is vulnerable.
    Vulnerable cells within the official distance are hidden.
    """
    valid = F.col(demand).isNotNull() & F.col(m3).isNotNull()
    cost, need = Fitted.of_all(cells.where(valid), m3, demand)
    out = cells.withColumns({
        f"analysis_valid_{suffix}": valid,
        f"cost_m3_norm_{suffix}": F.when(valid, cost.apply(m3)),
        f"demand_norm_{suffix}": F.when(valid, need.apply(demand)),
    })
    out = out.withColumn(f"vulnerability_m3_{suffix}", F.col(f"cost_m3_norm_{suffix}") * F.col(f"demand_norm_{suffix}"))
    (limit,) = quantile_values(out, {"limit": (f"vulnerability_m3_{suffix}", q)})
    out = out.withColumn(f"vulnerability_threshold_{suffix}", F.lit(limit).cast("double"))
    vulnerable = _true(F.col(f"vulnerability_m3_{suffix}") >= F.col(f"vulnerability_threshold_{suffix}"))
    near = _true(F.col(m0) <= official_m)
    return out.withColumns({
        f"vulnerable_m3_{suffix}": vulnerable,
        "official_400m_ok_m0": near,
        f"hidden_vulnerable_{suffix}": near & vulnerable,
        "cost_gap_m3_minus_m0": F.col(m3) - F.col(m0),
        "cost_gap_ratio_m3_over_m0": ratio(m3, m0),
    })


def increments() -> dict[str, Column]:
    """What slope, weather and their interaction add to the cost, and their shares (NULL where nothing is added)."""
    a, b, c, d = (F.col(x) for x in COSTS)
    return {
        "slope_increment_m1_m0": b - a, "weather_additive_increment_m2_m1": c - b, "interaction_increment_m3_m2": d - c, "total_env_increment_m3_m0": d - a,
        "slope_increment_share": ratio(b - a, d - a), "weather_additive_increment_share": ratio(c - b, d - a), "interaction_increment_share": ratio(d - c, d - a),
    }


def diagnose(cells: DataFrame, suffix: str = "final", official_m: float = 400.0, high: float = 0.75) -> DataFrame:
    """Hidden cells with increments, percentile ranks among valid cells, pressures and the main reason."""
    hidden, demand, valid = f"hidden_vulnerable_{suffix}", f"demand_index_{suffix}", f"analysis_valid_{suffix}"
    require(cells, [hidden, demand, *COSTS])
    out = cells.withColumns(increments())
    is_valid = _true(valid) if valid in cells.columns else F.col(demand).isNotNull() & F.col("access_cost_m3").isNotNull()
    measures = {f"demand_percentile_{suffix}": demand, f"cost_m3_percentile_{suffix}": "access_cost_m3", f"env_penalty_percentile_{suffix}": "total_env_increment_m3_m0"}
    out = cut(out.withColumns({f"_m{k}": F.when(is_valid, F.col(c)) for k, c in enumerate(measures.values())}))
    limits = quantile_values(out, {name: (f"_m{k}", high) for k, name in enumerate(measures)})
    out = percent_ranks(out, {f"_m{k}": name for k, name in enumerate(measures)}).drop(*(f"_m{k}" for k in range(len(measures))))
    need, cost, env = (_true(F.col(c) >= F.lit(x)) for c, x in zip(measures.values(), limits, strict=True))
    out = out.withColumns({
        "high_demand_pressure": need, "high_m3_cost_pressure": cost, "high_env_penalty": env,
        "near_400m_distance_pressure": _true(F.col("access_cost_m0") >= official_m * 0.8),
    })
    d, e, n = F.col("high_demand_pressure"), F.col("high_env_penalty"), F.col("near_400m_distance_pressure")
    reason = (
        F.when(d & e, "high_demand_plus_slope_weather_penalty").when(d & n, "high_demand_plus_near_400m_distance").when(d, "high_demand")
        .when(e, "slope_weather_penalty").when(n, "near_400m_distance").otherwise("mixed")
    )
    return out.withColumn("primary_reason", reason).where(_true(hidden))


def classify(cells: DataFrame, suffix: str = "final", far_quantile: float = 0.75, slope_share: float = 0.40, interaction_share: float = 0.25, out: str = "vulnerability_type") -> DataFrame:
    """Type of each vulnerable cell: slope before weather before supply, else demand; NULL for the others."""
    flag = f"vulnerable_m3_{suffix}"
    require(cells, [flag, *COSTS])
    (far,) = quantile_values(cells.where(_true(flag)), {"far": ("access_cost_m0", far_quantile)})
    a, b, c, d = (F.col(x) for x in COSTS)
    kind = (
        F.when(F.coalesce(ratio(b - a, d - a), F.lit(0.0)) >= slope_share, "slope_vulnerable")
        .when(F.coalesce(ratio(d - c, d - a), F.lit(0.0)) >= interaction_share, "weather_amplified")
        .when(_true(a >= F.lit(far).cast("double")), "supply_shortage")
        .otherwise("high_demand")
    )
    return cells.withColumn(out, F.when(_true(flag), kind))


def summarise_types(cells: DataFrame, kind: str = "vulnerability_type", population: str = "registered_population", senior: str = "registered_senior_population") -> DataFrame:
    """Cells, population, senior population and share of population by type; columns that are missing count as 0."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in cells.columns else F.lit(0.0)
    sums = cells.where(F.col(kind).isNotNull()).groupBy(F.col(kind).alias("vulnerability_type")).agg(
        F.count("*").alias("hex_count"), F.sum(value(population)).alias("population_sum"), F.sum(value(senior)).alias("senior_population_sum")
    )
    total = sums.agg(F.sum("population_sum")).first()[0]  # four types at most
    share = F.col("population_sum") / F.lit(float(total)) if total else F.lit(0.0)
    return sums.withColumn("population_share", share).orderBy("vulnerability_type")


def audit(cells: DataFrame, suffix: str = "final", q: float = 0.8, official_m: float = 400.0, tolerance: float = 1e-9) -> DataFrame:
    """One row of checks: counts, unique ids, score figures, threshold, formulas, order of costs, missing and infinite values."""
    valid, flag, hidden, value, limit = (x.format(suffix) for x in ("analysis_valid_{}", "vulnerable_m3_{}", "hidden_vulnerable_{}", "vulnerability_m3_{}", "vulnerability_threshold_{}"))
    require(cells, ["hex_id", *COSTS, "official_400m_ok_m0", valid, flag, hidden, value, limit])
    ok, near = _true(valid), _true("official_400m_ok_m0")
    own = F.when(ok, F.col(value))
    a, b, c, d = (F.col(x) for x in COSTS)
    whole = ok & a.isNotNull() & b.isNotNull() & c.isNotNull() & d.isNotNull()
    falling = (b + tolerance < a) | (c + tolerance < b) | (d + tolerance < c)
    nulls = sum((F.count_if(ok & F.col(x).isNull()) for x in ("access_cost_m0", "access_cost_m3", value, limit, flag, hidden)), F.lit(0))
    infinite = sum((F.count_if(F.abs(F.col(x).cast("double")) == float("inf")) for x in numeric_columns(cells)), F.lit(0))
    row = cells.agg(
        F.count("*").alias("row_count"), F.count_distinct("hex_id").alias("hex_id_unique_count"), F.count_if(ok).alias("analysis_valid_count"),
        F.count_if(~ok).alias("analysis_invalid_count"), F.count_if(_true(flag)).alias("vulnerable_count"), F.count_if(_true(hidden)).alias("hidden_vulnerable_count"),
        F.count_if(near).alias("official_400m_ok_count"), F.min(own).alias("vulnerability_score_min"),
        F.max(own).alias("vulnerability_score_max"), F.avg(own).alias("vulnerability_score_mean"),
        F.min(F.when(ok, F.col(limit))).alias("table_threshold"), F.count_if(_true(hidden) != (near & _true(flag))).alias("hidden_formula_mismatch_count"),
        F.count_if(near != _true(a <= official_m)).alias("official_400m_formula_mismatch_count"), F.count_if(whole).alias("cost_monotonic_checked_rows"),
        F.count_if(whole & falling).alias("cost_monotonic_violation_count"), nulls.alias("valid_required_null_count"), infinite.alias("numeric_inf_count"),
    )
    none = lambda c: F.col(c) == 0
    row = row.crossJoin(F.broadcast(quantiles(cells, {"vulnerability_score_median": (own, 0.5), "actual_threshold": (own, q)})))  # one row each
    return row.withColumns({
        "hex_id_is_unique": F.col("row_count") == F.col("hex_id_unique_count"),
        "threshold_matches_quantile": _true(F.abs(F.col("actual_threshold") - F.col("table_threshold")) <= tolerance + 1e-5 * F.abs("table_threshold")),
        "hidden_formula_ok": none("hidden_formula_mismatch_count"), "official_400m_formula_ok": none("official_400m_formula_mismatch_count"),
        "cost_monotonic_ok": none("cost_monotonic_violation_count"), "valid_required_null_ok": none("valid_required_null_count"), "numeric_inf_ok": none("numeric_inf_count"),
    })


def leading_by_type(cells: DataFrame, top: int = 20, kind: str = "vulnerability_type", suffix: str = "final", second: str = "registered_population") -> DataFrame:
    """The cells of the highest score, then of the greatest second key, then by id: overall ("all") and of each type, with their rank (a top-k report)."""
    score = f"vulnerability_m3_{suffix}"
    order = [F.desc_nulls_last(score), F.desc_nulls_last(second), F.col("hex_id")]
    typed = cells.where(F.col(kind).isNotNull())
    overall = typed.orderBy(*order).limit(top).withColumn("list", F.lit("all"))
    ranked = typed.withColumn("list", F.col(kind)).withColumn("_salt", F.pmod(F.xxhash64("hex_id"), F.lit(64)))
    # the best of each type are among the best of its parts, so no task sorts a whole type
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    parts = ranked.withColumn("_p", place("list", "_salt")).where(F.col("_p") <= top).drop("_p", "_salt")
    both = overall.select(*cells.columns, "list").union(parts.select(*cells.columns, "list"))
    return both.withColumn("rank", place("list")).where(F.col("rank") <= top)


def shortlist(cells: DataFrame, suffix: str = "final", limit: int | None = None) -> DataFrame:
    """Hidden cells by score, the worst first, with their rank (ties by id); a limit makes it a top-k report."""
    order = [F.col(f"vulnerability_m3_{suffix}").desc(), F.col("hex_id")]
    hidden = cells.where(_true(f"hidden_vulnerable_{suffix}"))
    from terrane.functions.ranking import running_total

    if limit is not None:
        hidden = hidden.orderBy(*order).limit(limit)
    return running_total(hidden, [-F.col(f"vulnerability_m3_{suffix}"), F.col("hex_id")], {"rank": F.lit(1)}).withColumn("rank", F.col("rank").cast("long"))
