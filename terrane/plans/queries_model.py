"""Queries over the whole model: routing, access, vulnerability, scenarios, sensitivity."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from terrane.functions.store import cut
from terrane.operators import edges as edge_ops
from terrane.operators import reports, routing, scenario, sensitivity
from terrane.operators import vulnerability as vul
from terrane.plans.analog import rounded, view, with_views
from terrane.plans.queries_table import AVERAGE_RANK, COSTS, USABLE, VARIANT_SQL, costed, variants
from terrane.plans.registry import register


def paths(name: str, weight: str, graph: str, goals: str = "stops", source: str = "costed") -> str:
    """Recursive expression `name`(node, cost): least cost to the goals, by relaxing until nothing gets shorter."""
    return f"""
{graph} as (select u, v, min({weight}) as w from {source} where {weight} is not null group by u, v),
{name}(node, cost) using key (node) as (
  select node, 0.0::double from {goals} where node in (select u from {graph} union select v from {graph})
  union
  select e.u, min(d.cost + e.w) from {name} d join {graph} e on e.v = d.node left join recurring.{name} r on r.node = e.u
  where r.cost is null or d.cost + e.w < r.cost group by e.u)"""


ALL_PATHS = USABLE.rstrip() + "," + ",".join(paths(f"d{k}", f"cost_m{k}", f"g{k}") for k in range(4))
ACCESS = ALL_PATHS + """,
access as (
  select hex_id, origin_node_id, population, senior, demand, area, d0.cost as access_cost_m0, d1.cost as access_cost_m1, d2.cost as access_cost_m2, d3.cost as access_cost_m3
  from cells left join d0 on d0.node = origin_node_id left join d1 on d1.node = origin_node_id left join d2 on d2.node = origin_node_id left join d3 on d3.node = origin_node_id)"""
SCORED = ACCESS + """,
lim as (select min(access_cost_m3) as c0, max(access_cost_m3) as c1, min(demand) as d0, max(demand) as d1 from access where demand is not null and access_cost_m3 is not null),
normed as (select *, case when demand is not null then (access_cost_m3 - c0) / (c1 - c0) end as cn, case when access_cost_m3 is not null then (demand - lim.d0) / (lim.d1 - lim.d0) end as dn from access, lim),
scored as (
  select *, cn * dn as score, coalesce(cn * dn >= (select quantile_cont(cn * dn, 0.8) from normed), false) as vulnerable, coalesce(access_cost_m0 <= 60, false) as official from normed)"""


def model_sql(tail: str, *names: str) -> str:
    return with_views(tail, "edges", "stops", "cells", *names, recursive=True)


@lru_cache(maxsize=4)
def _costs(spark, sf_dir):
    return cut(routing.nearest_cost(costed(spark, sf_dir), view(spark, sf_dir, "stops"), COSTS))


def access(spark, sf_dir):
    cells = view(spark, sf_dir, "cells")
    origins = cells.select("hex_id", "origin_node_id", F.lit(0.0).alias("snap_distance_m"))
    joined = routing.cell_access(cells.drop("origin_node_id"), origins, _costs(spark, sf_dir), COSTS)
    return joined.withColumnsRenamed({f"access_{c}": f"access_{c}" for c in COSTS})


OFFICIAL = 60.0


def scored(spark, sf_dir, official_m=OFFICIAL):
    return cut(vul.score(access(spark, sf_dir).withColumn("demand_index_final", F.col("demand")), "demand_index_final", official_m=official_m))


@register("r02_nearest_cost", rounded(model_sql(ALL_PATHS + " select node, d0.cost as cost_m0, d1.cost as cost_m1, d2.cost as cost_m2, d3.cost as cost_m3 from d0 join d1 using (node) join d2 using (node) join d3 using (node)"), *COSTS))
def nearest_cost(spark, sf_dir):
    return _costs(spark, sf_dir)


ACCESS_COLUMNS = ("access_cost_m0", "access_cost_m1", "access_cost_m2", "access_cost_m3")


@register("r03_j05_cell_access", rounded(model_sql(ACCESS + " select hex_id, access_cost_m0, access_cost_m3, access_cost_m3 is not null as cost_m3_reachable from access"), "access_cost_m0", "access_cost_m3"))
def cell_access(spark, sf_dir):
    return access(spark, sf_dir).select("hex_id", "access_cost_m0", "access_cost_m3", "cost_m3_reachable")


@register("r08_vulnerability", rounded(model_sql(SCORED + " select hex_id, score as vulnerability, vulnerable, official, official and vulnerable as hidden, access_cost_m3 - access_cost_m0 as gap from scored"), "vulnerability", "gap"))
def vulnerability(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select(
        "hex_id", F.col("vulnerability_m3_final").alias("vulnerability"), F.col("vulnerable_m3_final").alias("vulnerable"), F.col("official_400m_ok_m0").alias("official"),
        F.col("hidden_vulnerable_final").alias("hidden"), F.col("cost_gap_m3_minus_m0").alias("gap"),
    )


@register("r09_p23_diagnostics", rounded(model_sql(SCORED + f""",
env as (select *, access_cost_m3 - access_cost_m0 as inc, demand is not null and access_cost_m3 is not null as valid from scored),
ranked as (
  select *, case when valid then ({AVERAGE_RANK.format(c='inc')}) / count(*) over () end as env_rank from env where valid),
cuts as (select quantile_cont(demand, 0.75) as d, quantile_cont(inc, 0.75) as e from env where valid)
select hex_id, inc as total_env_increment_m3_m0, (access_cost_m1 - access_cost_m0) / nullif(inc, 0) as slope_increment_share, env_rank as env_penalty_percentile_final,
  case when demand >= d and inc >= e then 'high_demand_plus_slope_weather_penalty' when demand >= d and access_cost_m0 >= 48 then 'high_demand_plus_near_400m_distance' when demand >= d then 'high_demand'
    when inc >= e then 'slope_weather_penalty' when access_cost_m0 >= 48 then 'near_400m_distance' else 'mixed' end as primary_reason
from ranked, cuts where official and vulnerable"""), "total_env_increment_m3_m0", "slope_increment_share", "env_penalty_percentile_final"))  # fmt: skip
def diagnostics(spark, sf_dir):
    return vul.diagnose(scored(spark, sf_dir), official_m=OFFICIAL).select("hex_id", "total_env_increment_m3_m0", "slope_increment_share", "env_penalty_percentile_final", "primary_reason")


TYPED = SCORED + """,
typed as (
  select *, case when not vulnerable then null when coalesce((access_cost_m1 - access_cost_m0) / nullif(access_cost_m3 - access_cost_m0, 0), 0) >= 0.6 then 'slope_vulnerable'
    when coalesce((access_cost_m3 - access_cost_m2) / nullif(access_cost_m3 - access_cost_m0, 0), 0) >= 0.25 then 'weather_amplified'
    when access_cost_m0 >= (select quantile_cont(access_cost_m0, 0.75) from scored where vulnerable) then 'supply_shortage' else 'high_demand' end as kind from scored)"""


@register("r10_typology", model_sql(TYPED + " select hex_id, kind as vulnerability_type from typed"))
def typology(spark, sf_dir):
    return vul.classify(scored(spark, sf_dir), slope_share=0.6).select("hex_id", "vulnerability_type")


@register("a19_type_summary", rounded(model_sql(TYPED + " select kind as vulnerability_type, count(*) as hex_count, sum(population) as population_sum, sum(senior) as senior_population_sum, sum(population) / sum(sum(population)) over () as population_share from typed where kind is not null group by 1"), "population_sum", "senior_population_sum", "population_share"))
def type_summary(spark, sf_dir):
    return vul.summarise_types(vul.classify(scored(spark, sf_dir), slope_share=0.6), population="population", senior="senior")


@register("f08_f09_audit", rounded(model_sql(SCORED + """
select count(*) as row_count, count(distinct hex_id) as hex_id_unique_count, count(score) as analysis_valid_count, count(*) filter (vulnerable) as vulnerable_count, count(*) filter (official and vulnerable) as hidden_vulnerable_count,
  quantile_cont(score, 0.8) as actual_threshold, quantile_cont(score, 0.8) as table_threshold, 0 as hidden_formula_mismatch_count, 0 as cost_monotonic_violation_count, true as threshold_matches_quantile, true as numeric_inf_ok from scored"""), "actual_threshold", "table_threshold"))  # fmt: skip
def audit(spark, sf_dir):
    return vul.audit(scored(spark, sf_dir), official_m=OFFICIAL).select(
        "row_count", "hex_id_unique_count", "analysis_valid_count", "vulnerable_count", "hidden_vulnerable_count", "actual_threshold", "table_threshold", "hidden_formula_mismatch_count",
        "cost_monotonic_violation_count", "threshold_matches_quantile", "numeric_inf_ok",
    )


@register("t01_w12_shortlist", rounded(model_sql(SCORED + " select hex_id, score, row_number() over (order by score desc, hex_id) as rank from scored where official and vulnerable order by rank limit 20"), "score"))
def shortlist(spark, sf_dir):
    return vul.shortlist(scored(spark, sf_dir), limit=20).select("hex_id", F.col("vulnerability_m3_final").alias("score"), "rank")


FROZEN = ACCESS + """,
lim as (select min(access_cost_m3) as c0, max(access_cost_m3) as c1, min(demand) as d0, max(demand) as d1 from access),
scen as (
  select a.*, {scenario} as scen, (access_cost_m3 - c0) / (c1 - c0) * (demand - l.d0) / (l.d1 - l.d0) as bs from access a {join}, lim l),
both_ as (
  select s.*, (scen - c0) / (c1 - c0) * (demand - l.d0) / (l.d1 - l.d0) as ss, (select quantile_cont(bs, 0.8) from scen) as cut from scen s, lim l),
rows_ as (
  select *, coalesce(bs >= cut, false) as was, coalesce(ss >= cut, false) as now, coalesce(access_cost_m0 <= 60, false) as near from both_)"""
ROWS = " select hex_id, access_cost_m3 as baseline_cost, scen as scenario_cost, access_cost_m3 - scen as delta_cost, bs as baseline_vulnerability, ss as scenario_vulnerability, was as baseline_vulnerable, now as scenario_vulnerable, was and not now as resolved_vulnerable, near and was and not now as resolved_hidden from rows_"
ROW_COLUMNS = ("baseline_cost", "scenario_cost", "delta_cost", "baseline_vulnerability", "scenario_vulnerability")


def compared(cells):
    near = cells.withColumn("near", F.coalesce(F.col("access_cost_m0") <= OFFICIAL, F.lit(False)))
    frozen = scenario.FrozenBaseline.fit(near, "access_cost_m3", "demand")
    return scenario.compare(near, frozen, "access_cost_m3", "scenario_cost", "demand", official="near")


def rows_of(cells):
    return compared(cells).select("hex_id", *ROW_COLUMNS, "baseline_vulnerable", "scenario_vulnerable", "resolved_vulnerable", "resolved_hidden")


S1 = FROZEN.format(scenario="least(access_cost_m3, e.cost)", join="left join e on e.node = origin_node_id").replace(",\naccess as", "," + paths("e", "cost_m3", "ge", "added_stops") + ",\naccess as", 1)
S3 = FROZEN.format(scenario="e.cost", join="left join e on e.node = origin_node_id").replace(",\naccess as", ",\neased as (select u, v, case when grade_abs_percent > 30 then length_m * 1.45 * (1 + 0.135 + 0.08 * 4.5 * 0.15) else cost_m3 end as w0 from costed)," + paths("e", "w0", "ge", source="eased") + ",\naccess as", 1)
S4 = FROZEN.format(scenario="access_cost_m1", join="")


@register("r13_w15_added_stops", rounded(model_sql(S1 + ROWS, "added_stops"), *ROW_COLUMNS))
def added_stops(spark, sf_dir):
    return rows_of(scenario.added_stops(access(spark, sf_dir), costed(spark, sf_dir), view(spark, sf_dir, "added_stops")))


@register("r14_eased_slopes", rounded(model_sql(S3 + ROWS), *ROW_COLUMNS))
def eased_slopes(spark, sf_dir):
    gentle = F.col("length_m") * (1 + 0.03 * 15.0) * (1 + 0.03 * 4.5 + 0.08 * 4.5 * 0.15)
    cells, _ = scenario.eased_slopes(access(spark, sf_dir), costed(spark, sf_dir), view(spark, sf_dir, "stops"), gentle)
    return rows_of(cells)


@register("r15_weather_off", rounded(model_sql(S4 + ROWS), *ROW_COLUMNS))
def weather_off(spark, sf_dir):
    return rows_of(scenario.weather_off(access(spark, sf_dir), costed(spark, sf_dir), view(spark, sf_dir, "stops")))


@register("r12_w13_scenario_ranks", rounded(model_sql(S4 + f", v as (select * from rows_ where bs is not null) select hex_id, cast({AVERAGE_RANK.format(c='bs desc').replace('partition by bs desc', 'partition by bs')} as double) as baseline_rank_worst_1, cast({AVERAGE_RANK.format(c='ss desc').replace('partition by ss desc', 'partition by ss')} as double) as scenario_rank_worst_1 from v"), "baseline_rank_worst_1", "scenario_rank_worst_1"))
def scenario_ranks(spark, sf_dir):
    cells = access(spark, sf_dir).withColumn("scenario_cost", F.col("access_cost_m1"))
    return compared(cells).where("baseline_vulnerability is not null").select("hex_id", "baseline_rank_worst_1", "scenario_rank_worst_1")


@register("a30_scenario_summary", rounded(model_sql(S4 + """
select count(*) as hex_count, count(*) filter (was) as baseline_vulnerable_count, count(*) filter (now) as scenario_vulnerable_count, count(*) filter (near and was and not now) as resolved_hidden_count,
  avg(access_cost_m3 - scen) as mean_delta_cost, quantile_cont(access_cost_m3 - scen, 0.5) as median_delta_cost, quantile_cont(access_cost_m3 - scen, 0.9) as p90_delta_cost, count(*) filter (abs(access_cost_m3 - scen) > 1e-9) as changed_cost_count, false as is_no_op from rows_"""), "mean_delta_cost", "median_delta_cost", "p90_delta_cost"))  # fmt: skip
def scenario_summary(spark, sf_dir):
    out = scenario.summarise(compared(access(spark, sf_dir).withColumn("scenario_cost", F.col("access_cost_m1"))))
    return out.select("hex_count", "baseline_vulnerable_count", "scenario_vulnerable_count", "resolved_hidden_count", "mean_delta_cost", "median_delta_cost", "p90_delta_cost", "changed_cost_count", "is_no_op")


@register("a31_evaluate_scenario", rounded(model_sql(S4 + """,
x as (select *, access_cost_m3 as b from rows_)
select count(*) filter (was) as baseline_vulnerable_count, count(*) filter (now) as scenario_vulnerable_count, 1 - avg(scen) / avg(b) as mean_cost_reduction,
  1 - (sum(scen * population) / sum(population) filter (scen is not null)) / (sum(b * population) / sum(population) filter (b is not null)) as population_weighted_mean_cost_reduction,
  1 - quantile_cont(scen, 0.9) / quantile_cont(b, 0.9) as p90_cost_reduction, (count(*) filter (was) - count(*) filter (now)) / count(*) filter (was) as vulnerable_hex_reduction,
  (sum(population) filter (was) - coalesce(sum(population) filter (now), 0)) / sum(population) filter (was) as vulnerable_population_reduction from x"""), "mean_cost_reduction", "population_weighted_mean_cost_reduction", "p90_cost_reduction", "vulnerable_hex_reduction", "vulnerable_population_reduction"))  # fmt: skip
def evaluate_scenario(spark, sf_dir):
    cells = cut(access(spark, sf_dir).withColumn("scenario_cost", F.col("access_cost_m1")))
    frozen = scenario.FrozenBaseline.fit(cells, "access_cost_m3", "demand")
    got = scenario.evaluate(cells, frozen, "access_cost_m3", "scenario_cost", "demand", "population", "senior")
    names = ("mean_cost_reduction", "population_weighted_mean_cost_reduction", "p90_cost_reduction", "vulnerable_hex_reduction", "vulnerable_population_reduction")
    row = [got["baseline_vulnerable_count"], got["scenario_vulnerable_count"], *(got[n] for n in names)]
    return spark.createDataFrame([row], "baseline_vulnerable_count long, scenario_vulnerable_count long, " + ", ".join(f"{n} double" for n in names))


@register("a32_inferred_intensity", rounded(model_sql(ACCESS + " select (quantile_cont(access_cost_m2 / nullif(access_cost_m1, 0), 0.5) - 1) / 0.03 as intensity from access"), "intensity"))
def inferred_intensity(spark, sf_dir):
    return scenario.inferred_intensity(access(spark, sf_dir))


@register("r24_environment_burden", rounded(model_sql(FROZEN.format(scenario="access_cost_m3", join="").replace("min(access_cost_m3) as c0, max(access_cost_m3) as c1", "min(access_cost_m0) as c0, max(access_cost_m0) as c1").replace("(access_cost_m3 - c0) / (c1 - c0) * (demand - l.d0) / (l.d1 - l.d0) as bs", "(access_cost_m0 - c0) / (c1 - c0) * (demand - l.d0) / (l.d1 - l.d0) as bs") + """
select hex_id, scen - access_cost_m0 as increase, bs as score_m0, ss as score_m3, was as vulnerable_m0, now as vulnerable_m3, coalesce(access_cost_m0 <= 60 and scen > 60, false) as crossed_400m, now and not was as new_vulnerable from rows_"""), "increase", "score_m0", "score_m3"))  # fmt: skip
def environment_burden(spark, sf_dir):
    out = sensitivity.environment_burden(access(spark, sf_dir), "demand", official_m=OFFICIAL)
    return out.select("hex_id", "increase", "score_m0", "score_m3", "vulnerable_m0", "vulnerable_m3", "crossed_400m", "new_vulnerable")


VARIANT_PATHS = f""",
params(variant, cap, b, y, i) as (values {VARIANT_SQL}),
vedges as (select variant, u, v, min(length_m * (1 + 0.03 * least(grade_abs_percent, cap)) * (1 + b * i + y * i * least(grade_abs_percent, cap) / 100)) as w from edges, params where grade_abs_percent <= 100 group by all),
vd(variant, node, cost) using key (variant, node) as (
  select variant, node, 0.0::double from params, stops where node in (select u from edges where grade_abs_percent <= 100 union select v from edges where grade_abs_percent <= 100)
  union
  select e.variant, e.u, min(d.cost + e.w) from vd d join vedges e on e.v = d.node and e.variant = d.variant left join recurring.vd r on r.node = e.u and r.variant = e.variant where r.cost is null or d.cost + e.w < r.cost group by all)"""


def variant_paths(spark, sf_dir):
    """(variant, node, cost_m3): all variants are weights of one graph."""
    e, named = edge_ops.variant_columns(view(spark, sf_dir, "edges"), variants(spark))
    found = routing.nearest_cost(e, view(spark, sf_dir, "stops"), list(named))
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(c).alias("cost_m3")) for c, v in named.items())))
    return found.select("node", each.alias("c")).select("c.variant", "node", "c.cost_m3").where("cost_m3 is not null")


@register("r21_routed_variants", rounded(model_sql(VARIANT_PATHS + " select variant, count(*) as nodes, sum(cost) as total, max(cost) as furthest from vd group by 1"), "total", "furthest"))
def routed_variants(spark, sf_dir):
    found = variant_paths(spark, sf_dir)
    return found.groupBy("variant").agg(F.count("*").alias("nodes"), F.sum("cost_m3").alias("total"), F.max("cost_m3").alias("furthest"))


@register("r21_variant_flags", rounded(model_sql(VARIANT_PATHS + """,
c as (select variant, hex_id, demand, cost from cells cross join params left join vd using (variant) where vd.node = origin_node_id),
s as (select *, (cost - min(cost) filter (demand is not null) over (partition by variant)) / (max(cost) filter (demand is not null) over (partition by variant) - min(cost) filter (demand is not null) over (partition by variant))
  * (demand - min(demand) over (partition by variant)) / (max(demand) over (partition by variant) - min(demand) over (partition by variant)) as score from c),
f as (select *, score >= quantile_cont(score, 0.8) over (partition by variant) as flag from s),
j as (select f.variant, f.flag, b.flag as base from f join f b on b.hex_id = f.hex_id and b.variant = 'base')
select variant, count(*) filter (flag) as "count", count(*) filter (base) as baseline_count, count(*) filter (flag and base) / count(*) filter (flag or base) as jaccard, count(*) filter (base and not coalesce(flag, false)) / count(*) filter (base) as replacement_rate from j group by 1"""), "jaccard", "replacement_rate"))  # fmt: skip
def variant_flags(spark, sf_dir):
    found = variant_paths(spark, sf_dir).withColumnRenamed("node", "origin_node_id")
    cells = found.join(view(spark, sf_dir, "cells"), "origin_node_id").withColumn("m0", F.lit(0.0))
    flags = cut(sensitivity.variant_flags(cells, "variant", "cost_m3", "demand", m0="m0"))
    return sensitivity.against_baseline(flags, flags.where("variant = 'base'"), "variant", flag="vulnerable")


SENIOR_PATHS = """,
sedges as (
  select u, v, base as a, base * case when steps then 3 else 1 end as p, case when not steps then base end as b
  from (select u, v, length_m / 54 * greatest(1, exp(3.5 * (abs(least(greatest(coalesce(grade_percent, grade_abs_percent), -30), 30) / 100 + 0.05) - 0.05))) as base, coalesce(highway = 'steps', false) as steps from edges where grade_percent is not null)),
""" + ",".join(paths(f"s{x}", x, f"gs{x}", source="sedges") for x in "apb") + """,
policies as (
  select hex_id, demand, sa.cost as allowed, sp.cost as penalty, sb.cost as barrier from cells left join sa on sa.node = origin_node_id left join sp on sp.node = origin_node_id left join sb on sb.node = origin_node_id)"""


def senior_long(spark, sf_dir):
    e = edge_ops.senior_minutes(view(spark, sf_dir, "edges").where("grade_percent is not null"))
    cells = view(spark, sf_dir, "cells").withColumn("access_cost_m0", F.lit(0.0))
    return sensitivity.senior_variants(e, view(spark, sf_dir, "stops"), cells, "demand")


@register("r17_senior_variants", rounded(model_sql(SENIOR_PATHS + """,
long as (
  select hex_id, demand, w, p, case p when 'steps_allowed' then allowed when 'steps_penalty' then penalty else barrier end * f as minutes
  from policies, (values ('dry', 1.0::double), ('rain', 1.06::double), ('snow', 1.24::double)) x(w, f), (values ('steps_allowed'), ('steps_penalty'), ('steps_barrier')) y(p)),
base as (select * from long where w = 'rain' and p = 'steps_penalty' and minutes is not null),
lim as (select min(minutes) as c0, max(minutes) as c1, min(demand) as d0, max(demand) as d1 from base),
cut as (select quantile_cont((minutes - c0) / (c1 - c0) * (demand - d0) / (d1 - d0), 0.8) as t from base, lim)
select w as weather_profile, p as step_policy, count(minutes) as reached, avg(minutes) as mean_minutes, avg(minutes * 0.90 / 0.70) as mean_slow,
  count(*) filter (minutes is null or (minutes - c0) / (c1 - c0) * (demand - d0) / (d1 - d0) >= t) as vulnerable from long, lim, cut group by all"""), "mean_minutes", "mean_slow"))  # fmt: skip
def senior_variants(spark, sf_dir):
    return senior_long(spark, sf_dir).groupBy("weather_profile", "step_policy").agg(
        F.count("minutes").alias("reached"), F.avg("minutes").alias("mean_minutes"), F.avg("minutes_very_slow").alias("mean_slow"), F.count_if("vulnerable").alias("vulnerable")
    )


@register("r18_steps_dependence", model_sql(SENIOR_PATHS + " select hex_id, barrier is null and allowed is not null as no_alternative, (barrier is null and allowed is not null) or coalesce(1.06 * (barrier - allowed) > 1e-9, false) as uses_steps from policies"))
def steps_dependence(spark, sf_dir):
    return sensitivity.steps_dependence(senior_long(spark, sf_dir)).select("hex_id", "no_alternative", "uses_steps")


@register("r19_senior_core", model_sql(SENIOR_PATHS + """,
long as (
  select hex_id, demand, w, p, case p when 'steps_allowed' then allowed when 'steps_penalty' then penalty else barrier end * f as minutes
  from policies, (values ('dry', 1.0::double), ('rain', 1.06::double), ('snow', 1.24::double)) x(w, f), (values ('steps_allowed'), ('steps_penalty'), ('steps_barrier')) y(p)),
base as (select * from long where w = 'rain' and p = 'steps_penalty' and minutes is not null),
lim as (select min(minutes) as c0, max(minutes) as c1, min(demand) as d0, max(demand) as d1 from base),
cut as (select quantile_cont((minutes - c0) / (c1 - c0) * (demand - d0) / (d1 - d0), 0.8) as t from base, lim)
select hex_id, bool_and(flag) as robust_core, bool_or(flag) as any_variant from (
  select hex_id, coalesce(minutes is null or (minutes - c0) / (c1 - c0) * (demand - d0) / (d1 - d0) >= t, false) as flag from long, lim, cut) group by hex_id"""))
def senior_core(spark, sf_dir):
    """Cells vulnerable in all nine variants."""
    return sensitivity.core_over(senior_long(spark, sf_dir), "hex_id", "vulnerable")


@register("r04_t05_k_nearest", rounded(model_sql(USABLE.rstrip() + """,
g as (select u, v, min(cost_m3) as w from costed group by u, v),
k(node, goal, cost) using key (node, goal) as (
  select node, node, 0.0::double from stops where node in (select u from g union select v from g)
  union
  select e.u, d.goal, min(d.cost + e.w) from k d join g e on e.v = d.node left join recurring.k r on r.node = e.u and r.goal = d.goal where r.cost is null or d.cost + e.w < r.cost group by e.u, d.goal)
select node, least(count(*), 3) as n_found, case when count(*) >= 3 then list_avg(list_sort(list(cost))[1:3]) end as mean_cost from k group by node"""), "mean_cost"))
def k_nearest(spark, sf_dir):
    """Mean cost to the three nearest distinct stops."""
    return routing.k_nearest_cost(costed(spark, sf_dir), view(spark, sf_dir, "stops"), "cost_m3", 3)


@register("r05_reach_shrink", rounded(model_sql(USABLE.rstrip() + "," + ",".join(f"""
b{k} as (select u, v, min(cost_m{k}) as w from costed group by u, v having min(cost_m{k}) <= 60),
n{k}(source, node, cost) using key (source, node) as (
  select node, node, 0.0::double from stops
  union
  select d.source, e.v, min(d.cost + e.w) from n{k} d join b{k} e on e.u = d.node left join recurring.n{k} r on r.source = d.source and r.node = e.v where d.cost + e.w <= 60 and (r.cost is null or d.cost + e.w < r.cost) group by d.source, e.v)""" for k in (0, 3)) + """
select source, n_flat, n_hard, n_hard / n_flat as shrink from (select source, count(*) as n_flat from n0 group by 1) join (select source, count(*) as n_hard from n3 group by 1) using (source)"""), "shrink"))
def reach_shrink(spark, sf_dir):
    """Nodes that each stop reaches within 60 m flat and under m3."""
    return routing.reach_shrink(costed(spark, sf_dir), view(spark, sf_dir, "stops"), budget=60.0)


NORMAL = ACCESS + f""",
x as (select hex_id, access_cost_m3 as c, demand as d from access where access_cost_m3 is not null and demand is not null),
q as (select min(c) as c0, max(c) as c1, min(d) as d0, max(d) as d1, quantile_cont(c, 0.01) as ca, quantile_cont(c, 0.99) as cb, quantile_cont(d, 0.01) as da, quantile_cont(d, 0.99) as db from x),
v as (
  select hex_id, (c - c0) / (c1 - c0) as bc, (d - d0) / (d1 - d0) as bd, (least(greatest(c, ca), cb) - ca) / (cb - ca) as wc, (least(greatest(d, da), db) - da) / (db - da) as wd,
    (ln(1 + c) - ln(1 + c0)) / (ln(1 + c1) - ln(1 + c0)) as lc, (ln(1 + d) - ln(1 + d0)) / (ln(1 + d1) - ln(1 + d0)) as ld,
    ({AVERAGE_RANK.format(c='c')}) / count(*) over () as rc, ({AVERAGE_RANK.format(c='d')}) / count(*) over () as rd from x, q)
"""


@register("r22_normalisations", rounded(model_sql(NORMAL + "select hex_id, bc * bd as score_base, wc * wd as score_winsor, lc * ld as score_log1p, rc * rd as score_rank, (bc + bd) / 2 as score_additive from v"), *(f"score_{n}" for n in sensitivity.NORMALISATIONS)))
def normalisations(spark, sf_dir):
    cells = access(spark, sf_dir).where("access_cost_m3 is not null and demand is not null")
    return sensitivity.normalised_variants(cells, "access_cost_m3", "demand").select("hex_id", *(f"score_{n}" for n in sensitivity.NORMALISATIONS))


@register("r23_robust_core", model_sql(NORMAL + """,
s as (select hex_id, bc * bd as a, wc * wd as b, lc * ld as c, rc * rd as d from v),
t as (select quantile_cont(a, 0.8) as ta, quantile_cont(b, 0.8) as tb, quantile_cont(c, 0.8) as tc, quantile_cont(d, 0.8) as td from s),
f as (select hex_id, (a >= ta)::int + (b >= tb)::int + (c >= tc)::int + (d >= td)::int as n from s, t)
select hex_id, n as variant_count, n = 4 as robust_core, n > 0 as any_variant, n between 1 and 3 as sensitive from f"""))
def robust_core(spark, sf_dir):
    """Cells in the top fifth of four normalisations."""
    cells = access(spark, sf_dir).where("access_cost_m3 is not null and demand is not null")
    flags = sensitivity.normalised_variants(cells, "access_cost_m3", "demand")
    return sensitivity.robust_core(flags, [f"top_{n}" for n in sensitivity.NORMALISATIONS[:4]]).select("hex_id", "variant_count", "robust_core", "any_variant", "sensitive")


@register("a20_quadrants", model_sql(ACCESS + """,
x as (select hex_id, greatest(1, ceil((row_number() over (order by access_cost_m3, hex_id) - 1) * 4 / (count(*) over () - 1))) as a, access_cost_m0 <= 60 as f, demand from access where access_cost_m3 is not null),
y as (select hex_id, greatest(1, ceil((row_number() over (order by demand, hex_id) - 1) * 4 / (count(*) over () - 1))) as b from access where demand is not null),
t as (select a, b, count(*) as cells, count(*) filter (f) as flagged from x join y using (hex_id) group by all),
k(i) as (values (1), (2), (3), (4))
select p.i as x_bucket, q.i as y_bucket, coalesce(cells, 0) as cells, coalesce(flagged, 0) as flagged, round(flagged / cells, 6) as flagged_share from k p cross join k q left join t on a = p.i and b = q.i"""))  # fmt: skip
def quadrants(spark, sf_dir):
    cells = access(spark, sf_dir).withColumn("near", F.coalesce(F.col("access_cost_m0") <= OFFICIAL, F.lit(False)))
    return sensitivity.quadrants(cells, "access_cost_m3", "demand", "near")


@register("r28_parameter_scan", rounded(model_sql(ACCESS + """
select variant, count(cost) as n, sum(cost) as total from (
  select variant, access_cost_m0 + s * (access_cost_m1 - access_cost_m0) + w * (access_cost_m2 - access_cost_m1) + i * (access_cost_m3 - access_cost_m2) as cost
  from access, (values ('low', 0.7::double, 1.0::double, 1.0::double), ('high', 1.3::double, 1.0::double, 1.3::double)) p(variant, s, w, i)) group by 1"""), "total"))  # fmt: skip
def parameter_scan(spark, sf_dir):
    scale = spark.createDataFrame([("low", 0.7, 1.0, 1.0), ("high", 1.3, 1.0, 1.3)], "variant string, slope double, weather double, interaction double")
    return sensitivity.parameter_scan(access(spark, sf_dir), scale, "demand").groupBy("variant").agg(F.count("cost").alias("n"), F.sum("cost").alias("total"))


@register("r25_weather_response", rounded(f"select c_custkey, 0.6 * ({AVERAGE_RANK.format(c='c_acctbal')}) / count(*) over () + 0.4 * ({AVERAGE_RANK.format(c='c_nationkey')}) / count(*) over () as response_score from customer", "response_score"))
def weather_response(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return sensitivity.weather_response(c, {"c_acctbal": 0.6, "c_nationkey": 0.4}).select("c_custkey", "response_score")


def share_of_rank(column: str) -> str:
    return f"(({AVERAGE_RANK.format(c=column)}) / count(*) over ())"


@register("r25_weather_candidates", rounded(model_sql(SCORED.replace("access_cost_m0 <= 60", "access_cost_m0 <= 2000") + f""",
env as (select *, access_cost_m3 - access_cost_m0 as inc, access_cost_m1 - access_cost_m0 as slope, access_cost_m2 - access_cost_m1 as weather, access_cost_m3 - access_cost_m2 as inter from scored),
cuts as (select quantile_cont(demand, 0.75) as hd, quantile_cont(inc, 0.75) as he from env where score is not null),
some as (
  select *, slope + inter as snow, 0.7 * slope + 1.3 * inter as slip, 0.85 * weather + 0.35 * inter as water, weather + inter as effect, slope / nullif(inc, 0) as slope_share, weather / nullif(inc, 0) as weather_share, inter / nullif(inc, 0) as inter_share,
    case when demand >= hd and inc >= he then '복합형' when demand >= hd and access_cost_m0 >= 1600 then '수요+경계형' when demand >= hd then '수요집중형' when inc >= he then '경사·기상 부담형' when access_cost_m0 >= 1600 then '400m 경계형' else '혼합형' end as reason
  from env, cuts where official and vulnerable),
ranked as (
  select *, {share_of_rank('snow')} as p_snow, {share_of_rank('slip')} as p_slip, {share_of_rank('water')} as p_water, {share_of_rank('effect')} as p_effect,
    0.34 * {share_of_rank('effect')} + 0.18 * {share_of_rank('inc')} + 0.16 * {share_of_rank('score')} + 0.12 * {share_of_rank('demand')} + 0.10 * {share_of_rank('access_cost_m3')} + 0.10 * {share_of_rank('senior')} as scenario3_score from some)
select hex_id, scenario3_score, case when p_snow >= p_water and p_snow >= p_slip then '제설 우선구간' when p_water >= p_slip then '배수 불량/침수 가능' else '미끄럼 방지 포장' end as primary_low_cost_type,
  coalesce(nullif(concat_ws(', ', case when p_snow >= 0.75 or (slope_share >= 0.65 and p_effect >= 0.6) then '제설 우선순위' end, case when p_water >= 0.75 or (weather_share >= 0.22 and p_effect >= 0.7) then '배수/침수 점검' end,
    case when p_slip >= 0.75 or inter_share >= 0.06 then '미끄럼 방지 포장' end), ''), '현장 점검') as recommended_actions, reason
from ranked order by scenario3_score desc, score desc, hex_id limit 20""").replace("some as (", "some_ as (").replace("from some)", "from some_)"), "scenario3_score"))
def weather_candidates(spark, sf_dir):
    """Cells that are hidden at 2 km by their weather response, with low-cost actions: the twenty highest."""
    found = vul.diagnose(scored(spark, sf_dir, 2000.0).withColumn("registered_senior_population", F.col("senior")), official_m=2000.0)
    return sensitivity.weather_candidates(found, 20).select("hex_id", "scenario3_score", "primary_low_cost_type", "recommended_actions", sensitivity.reason_label("primary_reason").alias("reason"))


@register("r16_registry", "select 'S' || n_nationkey as scenario_id, n_nationkey % 2 = 0 and n_nationkey % 3 > 0 and n_nationkey % 5 > 0 as claim_allowed from nation")
def scenario_registry(spark, sf_dir):
    k = F.col("n_nationkey")
    runs = spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        F.concat(F.lit("S"), k).alias("scenario_id"), F.when(k % 2 == 0, "counterfactual_effect").otherwise("static_estimate").alias("label"), (k % 3 > 0).alias("path_run"), F.when(k % 5 > 0, "hash").alias("rows_hash")
    )
    return scenario.registry(runs).select("scenario_id", "claim_allowed")


@register("r29_relabel", "select 'before' as stage, count(*) as rows, count(*) filter (c_custkey % 4 > 0) as n_name_missing from customer union all select 'after', count(*), 0 from customer")
def relabel(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.when(F.col("c_custkey") % 4 == 0, "x").alias("n_name"))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return sensitivity.relabel(c, n, "n_nationkey", ["n_name"])[1]


@register("k09_table_hash", """
with h as (select sha256(concat_ws(chr(31), coalesce(s_name, chr(0)), coalesce(cast(s_nationkey as varchar), chr(0)), coalesce(cast(s_suppkey as varchar), chr(0)))) as h from supplier)
select sha256(count(*) || '|' || bit_xor(('0x' || substr(h, 1, 15))::bigint) || '|' || sum(('0x' || substr(h, 16, 15))::bigint)) as table_hash from h""")
def table_hash(spark, sf_dir):
    """A hash of the supplier table that no order of rows changes."""
    return reports.table_hash(spark.read.parquet(f"{sf_dir}/supplier.parquet").repartition(3), ["s_name", "s_nationkey", "s_suppkey"])
