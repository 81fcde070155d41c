"""Policy scenarios under one frozen baseline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import stats
from terrane.functions.cleaning import ratio
from terrane.functions.ranking import average_ranks
from terrane.functions.scaling import Fitted
from terrane.operators import routing


@dataclass(frozen=True)
class FrozenBaseline:
    """Limits of cost and demand and the threshold, fitted once and used for every scenario."""

    cost: Fitted
    demand: Fitted
    threshold: float | None

    @classmethod
    def fit(cls, cells: DataFrame, cost: str, demand: str, q: float = 0.8) -> FrozenBaseline:
        a, b = Fitted.of_all(cells, cost, demand)
        (limit,) = stats.quantile_values(cells, {"limit": (a.apply(cost) * b.apply(demand), q)})
        return cls(a, b, limit)

    def vulnerability(self, cost: Column | str, demand: Column | str) -> Column:
        return self.cost.apply(cost) * self.demand.apply(demand)

    def vulnerable(self, cost: Column | str, demand: Column | str) -> Column:
        return F.coalesce(self.vulnerability(cost, demand) >= F.lit(self.threshold).cast("double"), F.lit(False))


def compare(cells: DataFrame, baseline: FrozenBaseline, base: str, scenario: str, demand: str, official: str | None = None, scenario_demand: str | None = None) -> DataFrame:
    """A row per cell: costs, scores, ranks (worst is 1), flags and what changed."""
    near = F.coalesce(F.col(official), F.lit(False)) if official else F.lit(False)
    need = scenario_demand or demand
    a, b = F.col(base).cast("double"), F.col(scenario).cast("double")
    out = cells.select(
        "hex_id", a.alias("baseline_cost"), b.alias("scenario_cost"), (a - b).alias("delta_cost"), F.when(a > 0, ratio(a - b, a)).alias("delta_cost_pct"),
        baseline.vulnerability(base, demand).alias("baseline_vulnerability"), baseline.vulnerability(scenario, need).alias("scenario_vulnerability"),
        baseline.vulnerable(base, demand).alias("baseline_vulnerable"), baseline.vulnerable(scenario, need).alias("scenario_vulnerable"), near.alias("official_400m_ok"),
    )
    out = average_ranks(out, {"baseline_vulnerability": "baseline_rank_worst_1", "scenario_vulnerability": "scenario_rank_worst_1"}, descending=True)
    was, now, near = F.col("baseline_vulnerable"), F.col("scenario_vulnerable"), F.col("official_400m_ok")
    return out.withColumns({
        "delta_vulnerability": F.col("baseline_vulnerability") - F.col("scenario_vulnerability"),
        "delta_rank_improvement": F.col("scenario_rank_worst_1") - F.col("baseline_rank_worst_1"),
        "resolved_vulnerable": was & ~now, "new_vulnerable": ~was & now, "baseline_hidden": near & was, "scenario_hidden": near & now,
        "resolved_hidden": near & was & ~now, "new_hidden": near & ~was & now,
    })


def summarise(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """One row over what compare() gives: flags, changes, means; and whether the scenario changed nothing at all."""
    flags = ("baseline_vulnerable", "scenario_vulnerable", "resolved_vulnerable", "new_vulnerable", "baseline_hidden", "scenario_hidden", "resolved_hidden", "new_hidden")
    deltas = ("delta_cost", "delta_cost_pct", "delta_vulnerability", "delta_rank_improvement")
    weighted = [stats.positive_weighted_mean(c, weight).alias(f"weighted_{c}") for c in deltas[:2]] if weight else []
    sums = rows.agg(
        F.count("*").alias("hex_count"), *(F.count_if(f).alias(f"{f}_count") for f in flags), *(F.avg(c).alias(f"mean_{c}") for c in deltas),
        F.count_if(F.abs("delta_cost") > 1e-9).alias("changed_cost_count"), F.count_if(F.abs("delta_vulnerability") > 1e-12).alias("changed_vulnerability_count"), *weighted,
        F.coalesce(F.max(F.abs("delta_cost")) <= 1e-9, F.lit(True)).alias("is_no_op"),
    )
    parts = stats.quantiles(rows, {f"{n}_{c}": (c, q) for n, q in (("median", 0.5), ("p90", 0.9)) for c in deltas[:2]})
    return sums.crossJoin(F.broadcast(parts))  # one row each


def evaluate(cells: DataFrame, baseline: FrozenBaseline, base: str, scenario: str, demand: str, population: str, senior: str | None = None, name: str = "scenario", scenario_demand: str | None = None) -> dict[str, float | int | str | None]:
    """Thirteen figures of a scenario: reductions of means, 90th percentiles and vulnerable cells, changes of inequality."""
    senior, need = senior or population, scenario_demand or demand
    flagged = cells.withColumns({"_was": baseline.vulnerable(base, demand), "_now": baseline.vulnerable(scenario, need)})
    weights = {"": None, "population_weighted_": population, "senior_weighted_": senior}
    row = flagged.agg(
        F.count_if("_was").alias("was"), F.count_if("_now").alias("now"), stats.flagged_reduction("_was", "_now").alias("cells"),
        stats.flagged_reduction("_was", "_now", population).alias("people"), stats.flagged_reduction("_was", "_now", senior).alias("seniors"),
        *(stats.weighted_mean(c, w).alias(f"{p}{c}") for p, w in weights.items() for c in (base, scenario)),
    ).first()
    pairs = {f"{p}{c}": (c, w) for p, w in weights.items() if w for c in (base, scenario)}
    held = stats.inequality(cells, pairs, 90)
    plain = dict(zip((base, scenario), stats.quantile_values(cells, {"base": (base, 0.9), "scenario": (scenario, 0.9)}), strict=True))
    out: dict[str, float | int | str | None] = {"scenario_name": name, "baseline_vulnerable_count": row["was"], "scenario_vulnerable_count": row["now"]}
    for prefix, w in weights.items():
        out[f"{prefix}mean_cost_reduction"] = stats.reduction(row[f"{prefix}{base}"], row[f"{prefix}{scenario}"])
        out[f"{prefix}p90_cost_reduction"] = stats.reduction(*(held[f"{prefix}{c}"]["percentile"] if w else plain[c] for c in (base, scenario)))
    change = lambda f: (lambda x, y: None if x is None or y is None else y - x)(*(held[f"population_weighted_{c}"][f] for c in (base, scenario)))
    return out | {
        "vulnerable_hex_reduction": row["cells"], "vulnerable_population_reduction": row["people"], "senior_vulnerable_population_reduction": row["seniors"],
        "gini_change": change("gini"), "theil_change": change("theil"),
    }


def added_stops(access: DataFrame, edges: DataFrame, candidates: DataFrame, weight: str = "cost_m3", node: str = "origin_node_id") -> DataFrame:
    """Cells with scenario_cost: the lesser of today's access cost and that to the added destinations alone (nothing else is routed anew)."""
    found = routing.nearest_cost(edges, candidates, [weight]).select(F.col("node").alias(node), F.col(weight).alias("_added"))
    return access.join(found, node, "left").withColumn("scenario_cost", F.least(f"access_{weight}", "_added")).drop("_added")


def eased_slopes(access: DataFrame, edges: DataFrame, destinations: DataFrame, recosted: Column, steep_from: float = 30.0, weight: str = "cost_m3", node: str = "origin_node_id") -> tuple[DataFrame, DataFrame]:
    """Cells with scenario_cost after edges steeper than a limit take another cost; and the edges that changed."""
    steep = F.col("grade_abs_percent") > steep_from
    changed = edges.withColumn("_new", F.when(steep, recosted).otherwise(F.col(weight)))
    found = routing.nearest_cost(changed.select("u", "v", F.col("_new").alias(weight)), destinations, [weight]).select(F.col("node").alias(node), F.col(weight).alias("scenario_cost"))
    return access.join(found, node, "left"), changed.where(steep).select("u", "v", F.col(weight).alias("old_cost"), F.col("_new").alias("new_cost"))


def weather_off(access: DataFrame, edges: DataFrame, destinations: DataFrame, node: str = "origin_node_id") -> DataFrame:
    """Cells with scenario_cost: routed by slope alone."""
    found = routing.nearest_cost(edges, destinations, ["cost_m1"]).select(F.col("node").alias(node), F.col("cost_m1").alias("scenario_cost"))
    return access.join(found, node, "left")


def inferred_intensity(access: DataFrame, beta_weather: float = 0.03) -> DataFrame:
    """One row: the weather that the medians of m2 / m1 tell of."""
    median = stats.quantiles(access, {"median": (ratio("access_cost_m2", "access_cost_m1"), 0.5)})
    return median.select(((F.col("median") - 1) / beta_weather).alias("intensity"))


def registry(runs: DataFrame) -> DataFrame:
    """Runs (scenario_id, label, path_run, rows_hash) with claim_allowed: a counterfactual effect that was run and has a hash."""
    allowed = (F.col("label") == "counterfactual_effect") & F.col("path_run") & (F.coalesce("rows_hash", F.lit("")) != "")
    return runs.withColumn("claim_allowed", F.coalesce(allowed, F.lit(False)))
