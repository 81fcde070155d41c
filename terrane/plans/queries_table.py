"""Queries over edges, population, mobility and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import cleaning, costs, ranking, scaling, senior, stats
from terrane.operators import edges as edge_ops
from terrane.operators import population as pop
from terrane.operators import reports, sensitivity
from terrane.plans.analog import rounded, view, with_views
from terrane.plans.registry import register

USABLE = """, usable as (
  select *, least(grade_abs_percent, 30.0) as g, 4.5 as i from edges where length_m is not null and grade_abs_percent <= 100),
costed as (
  select *, length_m as cost_m0, length_m * (1 + 0.03 * g) as cost_m1, length_m * (1 + 0.03 * g) * (1 + 0.03 * i) as cost_m2,
    length_m * (1 + 0.03 * g) * (1 + 0.03 * i + 0.08 * i * g / 100) as cost_m3 from usable)
"""
COSTS = ("cost_m0", "cost_m1", "cost_m2", "cost_m3")


def costed(spark, sf_dir):
    """Rain 2 mm and snow 0.5 cm: intensity 4.5."""
    return edge_ops.with_costs(view(spark, sf_dir, "edges"), rain_mm=2.0, snow_cm=0.5)


@register("p01_p11_edge_costs", rounded(with_views(USABLE + "select osmid, key, u, v, cost_m0, cost_m1, cost_m2, cost_m3 from costed", "edges"), *COSTS))
def edge_costs(spark, sf_dir):
    return costed(spark, sf_dir).select("osmid", "key", "u", "v", *COSTS)


@register(
    "p12_p24_minutes_and_gaps",
    rounded(with_views(USABLE + "select osmid, key, cost_m3 / 67 as minutes_m3, cost_m3 - cost_m0 as gap, cost_m3 / nullif(cost_m0, 0) as gap_ratio, (cost_m1 - cost_m0) / nullif(cost_m3 - cost_m0, 0) as slope_share from costed", "edges"), "minutes_m3", "gap", "gap_ratio", "slope_share"),
)
def minutes_and_gaps(spark, sf_dir):
    c = costed(spark, sf_dir)
    return c.select(
        "osmid", "key", costs.minutes("cost_m3").alias("minutes_m3"), (F.col("cost_m3") - F.col("cost_m0")).alias("gap"), cleaning.ratio("cost_m3", "cost_m0").alias("gap_ratio"),
        cleaning.ratio(F.col("cost_m1") - F.col("cost_m0"), F.col("cost_m3") - F.col("cost_m0")).alias("slope_share"),
    )


VARIANTS = [("base", 30.0, 0.03, 0.08, 2.0), ("cap25", 25.0, 0.03, 0.08, 2.0), ("cap40", 40.0, 0.03, 0.08, 2.0), ("beta", 30.0, 0.02, 0.08, 2.0), ("gamma", 30.0, 0.03, 0.1, 2.0)]
VARIANT_SQL = ", ".join(f"('{n}', {a}::double, {b}::double, {c}::double, {d}::double)" for n, a, b, c, d in VARIANTS)


def variants(spark):
    return spark.createDataFrame(VARIANTS, "variant string, cap double, beta_weather double, interaction_beta double, intensity double")


@register(
    "p13_j19_variant_costs",
    rounded(with_views(f""", params(variant, cap, b, y, i) as (values {VARIANT_SQL})
select variant, count(*) as n, sum(length_m * (1 + 0.03 * least(grade_abs_percent, cap)) * (1 + b * i + y * i * least(grade_abs_percent, cap) / 100)) as total
from edges, params where grade_abs_percent <= 100 group by variant""", "edges"), "total"),
)
def variant_totals(spark, sf_dir):
    return edge_ops.variant_costs(view(spark, sf_dir, "edges"), variants(spark)).groupBy("variant").agg(F.count("*").alias("n"), F.sum("cost_m3").alias("total"))


@register(
    "p14_weather_friction",
    rounded("select o_orderkey, greatest(1.0, 1 + 0.03 * (1.0 * (o_orderkey % 9 - 2) + 5.0 * coalesce(case when o_orderkey % 4 = 0 then null else o_orderkey % 3 end, 0)))::double as friction from orders", "friction"),
)
def friction(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    snow = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 3)
    return o.select("o_orderkey", costs.friction(F.col("o_orderkey") % 9 - 2, snow).alias("friction"))


@register(
    "p15_p22_senior_minutes",
    rounded(with_views("""
select osmid, key, base * slope as allowed, base * slope * case when steps then 3 else 1 end as penalty, case when not steps then base * slope end as barrier,
  base * slope * 1.06 * 0.90 / 0.70 as slow_in_rain, band, steps
from (select osmid, key, length_m / 54 as base, greatest(1, exp(3.5 * (abs(least(greatest(grade_percent, -30), 30) / 100 + 0.05) - 0.05))) as slope, coalesce(highway = 'steps', false) as steps,
  case when grade_abs_percent <= 2 then 'near_flat' when grade_abs_percent <= 5 then 'mild' when grade_abs_percent <= 8.33 then 'ramp_like' when grade_abs_percent <= 12 then 'steep' when grade_abs_percent > 12 then 'very_steep' end as band
  from edges where grade_percent is not null)""", "edges"), "allowed", "penalty", "barrier", "slow_in_rain"),
)
def senior_minutes(spark, sf_dir):
    e = edge_ops.senior_minutes(view(spark, sf_dir, "edges").where("grade_percent is not null"))
    return e.select(
        "osmid", "key", F.col("minutes_steps_allowed").alias("allowed"), F.col("minutes_steps_penalty").alias("penalty"), F.col("minutes_steps_barrier").alias("barrier"),
        senior.rescaled(F.col("minutes_steps_allowed") * senior.weather_factor("rain"), "very_slow").alias("slow_in_rain"),
        senior.grade_band("grade_abs_percent").alias("band"), senior.is_steps("highway").alias("steps"),
    )


@register(
    "f10_slope_classes",
    with_views("""
select case when grade_abs_percent is null then 'slope_unavailable' when grade_abs_percent > 100 then 'over_100' when grade_abs_percent > 30 then 'capped_30_100' else 'usable' end as slope_class,
  count(*) as edges, count(*) filter (length_m is null or length_m <= 0) as without_length from edges group by 1""", "edges"),
)
def slope_classes(spark, sf_dir):
    return edge_ops.slope_classes(view(spark, sf_dir, "edges"))


@register("r01_a11_graph_edges", rounded(with_views(USABLE + "select u, v, min(cost_m0) as cost_m0, min(cost_m3) as cost_m3 from costed group by u, v", "edges"), "cost_m0", "cost_m3"))
def graph_edges(spark, sf_dir):
    return edge_ops.graph_edges(costed(spark, sf_dir), ["cost_m0", "cost_m3"])


@register("a23_u06_node_steepness", rounded(with_views(" select node, avg(g) as steepness from (select u as node, grade_abs_percent as g from edges union all select v, grade_abs_percent from edges) group by node", "edges"), "steepness"))
def node_steepness(spark, sf_dir):
    return edge_ops.node_steepness(view(spark, sf_dir, "edges"))


@register("a02_mean_by_hour", rounded(with_views(" select grid as grid_id, hr as hour, avg(coalesce(living, 0)) as mean_living_population from grid group by all", "grid"), "mean_living_population", digits=9), digits=9)
def mean_by_hour(spark, sf_dir):
    return pop.mean_by_hour(view(spark, sf_dir, "grid"), "grid", "hr", "living")


GRID_SQL = with_views("""
select grid as grid_id, count(*) as observed_rows, avg(living) as mean_living_population, max(living) as max_living_population, avg(old) as mean_senior_population, max(old) as max_senior_population,
  avg(living) filter (hr between 9 and 17) as daytime_mean_population, avg(living) filter (hr between 0 and 5 or hr between 20 and 23) as nighttime_mean_population,
  avg(living) filter (hr between 7 and 9 or hr between 18 and 20) as commute_mean_population, avg(old) / nullif(avg(living), 0) as senior_share_mean from grid group by grid""", "grid")
GRID_DOUBLES = ("mean_living_population", "max_living_population", "mean_senior_population", "max_senior_population", "daytime_mean_population", "nighttime_mean_population", "commute_mean_population", "senior_share_mean")


@register("a03_grid_summary", rounded(GRID_SQL, *GRID_DOUBLES, digits=9), digits=9)
def grid_summary(spark, sf_dir):
    return pop.summarise_grid(view(spark, sf_dir, "grid"), "grid", "hr", "living", ["old"])


@register("j03_grid_join", f"select 'g' || p_partkey as cell, observed_rows, grid_id is not null as livingpop_joined from part left join ({GRID_SQL}) on grid_id = 'g' || p_partkey")
def grid_join(spark, sf_dir):
    cells = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("g"), F.col("p_partkey")).alias("CELL_ID"))
    return pop.join_grid(cells, grid_summary(spark, sf_dir)).select(F.col("CELL_ID").alias("cell"), "observed_rows", "livingpop_joined")


TRIP_NAMES = {"month": "month", "weekday": "weekday", "hour": "hour", "origin": "origin", "destination": "destination", "sex": "sex", "age": "age", "trip_type": "trip_type", "move_pop": "move_pop", "masked_count": "masked_count", "avg_move_time_min": "time_min"}
MARKED = """, marked as (
  select *, origin in (select code from codes) as oi, destination in (select code from codes) as di, hour in (7, 8, 9, 17, 18, 19) as peak, trip_type in ('HW', 'WH') as work from trips where hour is not null)
"""


def trips(spark, sf_dir):
    return pop.prepare_trips(view(spark, sf_dir, "trips"), TRIP_NAMES)


@register(
    "a04_mobility_by_code",
    rounded(with_views(MARKED + """, o as (
  select origin as code, sum(move_pop) as departures, sum(move_pop) filter (origin = destination) as internal, sum(move_pop) filter (di) as so, sum(move_pop) filter (not di) as outb,
    sum(move_pop) filter (peak) as po, sum(move_pop) filter (work) as wo, sum(move_pop * time_min) filter (move_pop > 0) / nullif(sum(move_pop) filter (time_min is not null and move_pop > 0), 0) as ot from marked where oi group by 1),
d as (
  select destination as code, sum(move_pop) as arrivals, sum(move_pop) filter (oi) as sd, sum(move_pop) filter (not oi) as inb, sum(move_pop) filter (peak) as pd, sum(move_pop) filter (work) as wd,
    sum(move_pop * time_min) filter (move_pop > 0) / nullif(sum(move_pop) filter (time_min is not null and move_pop > 0), 0) as dt from marked where di group by 1)
select code as mobility_admin_code, coalesce(departures, 0) as mobility_departures, coalesce(arrivals, 0) as mobility_arrivals, coalesce(internal, 0) as mobility_internal_trips,
  coalesce(so, 0) as mobility_seoul_internal_departures, coalesce(sd, 0) as mobility_seoul_internal_arrivals, coalesce(outb, 0) as mobility_outbound_to_nonseoul, coalesce(inb, 0) as mobility_inbound_from_nonseoul,
  coalesce(po, 0) as mobility_peak_departures, coalesce(pd, 0) as mobility_peak_arrivals, coalesce(wo, 0) as mobility_home_work_departures, coalesce(wd, 0) as mobility_home_work_arrivals,
  ot as mobility_origin_avg_move_time_min, dt as mobility_destination_avg_move_time_min, coalesce(departures, 0) + coalesce(arrivals, 0) as mobility_total_trips,
  coalesce(po, 0) + coalesce(pd, 0) as mobility_peak_total_trips, coalesce(arrivals, 0) - coalesce(departures, 0) as mobility_net_inflow
from codes left join o using (code) left join d using (code)""", "trips", "codes"), "mobility_origin_avg_move_time_min", "mobility_destination_avg_move_time_min"),
)
def mobility(spark, sf_dir):
    return pop.mobility_by_code(trips(spark, sf_dir), view(spark, sf_dir, "codes"))


@register(
    "a05_mobility_quality",
    rounded(with_views(MARKED + """
select count(*) as used_row_count, count(*) filter (move_pop <= 0) as zero_or_negative_move_pop_count, sum(move_pop) as total_move_pop, sum(masked_count) as total_masked_count,
  (select string_agg(h, ',' order by h) from (select distinct cast(hour as varchar) as h from marked)) as hour_values,
  (select string_agg(t, ',' order by t) from (select distinct trip_type as t from marked)) as trip_type_values,
  (select count(*) from (select distinct origin, destination from marked where oi or di)) as od_pair_count from marked""", "trips", "codes"), "total_move_pop", "total_masked_count"),
)
def mobility_quality(spark, sf_dir):
    return pop.mobility_quality(trips(spark, sf_dir), view(spark, sf_dir, "codes"))


@register("f12_t03_unmatched_codes", with_views(" select origin as code, sum(move_pop) as move_pop from trips where hour is not null and origin like '11%' and origin not in (select code from codes) group by 1 order by 2 desc, 1 limit 10", "trips", "codes"))
def unmatched(spark, sf_dir):
    return pop.unmatched_codes(trips(spark, sf_dir), view(spark, sf_dir, "codes"))


@register(
    "a01_f01_f02_stops",
    rounded(with_views("""
select 'bus' as mode, cast(stop_id as varchar) as stop_id, stop_name, avg(lon) as lon, avg(lat) as lat, sum(coalesce(try_cast(passengers as double), 0)) as passengers_sum, count(*) as source_rows
from rides where lower(trim(location_matched)) in ('true', '1', 'yes', 'y') and lon between 126.70 and 127.25 and lat between 37.40 and 37.75 group by all""", "rides"), "lon", "lat"),
)
def stops(spark, sf_dir):
    return pop.stop_candidates(view(spark, sf_dir, "rides"), "bus", "stop_id", "stop_name")


@register(
    "p26_s13_weather_rows",
    rounded("select o_orderkey, coalesce(case when o_orderkey % 3 > 0 then (o_orderkey % 50) / 10.0 end, 0)::double as rain_mm, strftime(o_orderdate, '%Y-%m-%d') as day from orders", "rain_mm"),
)
def weather_rows(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    raw = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") % 50 / 10).cast("string")).otherwise("x").alias("강수량(mm)"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("일시"))
    return pop.normalised_weather(raw).select("o_orderkey", "rain_mm", F.date_format("observed_at", "yyyy-MM-dd").alias("day"))


@register("p27_x05_records", "select o_orderkey, case when o_orderkey % 4 = 0 then null else o_orderkey * 1000 end as counted, case when o_orderkey % 5 = 0 then o_orderstatus else o_orderpriority end as name, coalesce(case when o_orderkey % 7 > 0 then cast(o_orderkey as varchar) end, '') as code from orders")
def records(spark, sf_dir):
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k, F.when(k % 4 == 0, F.lit(" - ")).otherwise(F.format_number(k * 1000, 0)).alias("text"), F.when(k % 5 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("name"),
        F.col("o_orderstatus").alias("시설명"), F.when(k % 7 > 0, F.concat(k.cast("string"), F.lit(".0"))).alias("raw"),
    )
    return o.select(k, cleaning.counted("text").alias("counted"), cleaning.first_filled(o.columns, ["name", "시설명"]).alias("name"), cleaning.code("raw").alias("code"))


@register("a06_x08_names", "select n_regionkey, count(*) as n, string_agg(distinct n_name, ',' order by n_name) as names from nation group by 1")
def names(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").agg(F.count("*").alias("n"), cleaning.joined_names("n_name").alias("names"))


@register("a12_a14_a36_describe", rounded("""
select 'p_retailprice' as "column", count(p_retailprice) as n, min(p_retailprice) as min, quantile_cont(p_retailprice, 0.5) as median, avg(p_retailprice) as mean, max(p_retailprice) as max, stddev_samp(p_retailprice) as std,
  quantile_cont(p_retailprice, 0.1) as p10, quantile_cont(p_retailprice, 0.25) as p25, quantile_cont(p_retailprice, 0.75) as p75, quantile_cont(p_retailprice, 0.9) as p90 from part
union all select 'p_size', count(p_size), min(p_size), quantile_cont(p_size::double, 0.5), avg(p_size), max(p_size), stddev_samp(p_size), quantile_cont(p_size::double, 0.1), quantile_cont(p_size::double, 0.25), quantile_cont(p_size::double, 0.75), quantile_cont(p_size::double, 0.9) from part""",
    "min", "median", "mean", "max", "std", "p10", "p25", "p75", "p90"))
def describe(spark, sf_dir):
    return reports.described(spark.read.parquet(f"{sf_dir}/part.parquet"), ["p_retailprice", "p_size"])


@register("a13_weighted_mean", rounded("select c_mktsegment as segment, sum(c_acctbal * c_nationkey) / nullif(sum(c_nationkey), 0) as mean, sum(c_acctbal * c_nationkey) filter (c_nationkey > 0) / nullif(sum(c_nationkey) filter (c_nationkey > 0), 0) as positive from customer group by 1", "mean", "positive"))
def weighted_mean(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.groupBy(F.col("c_mktsegment").alias("segment")).agg(stats.weighted_mean("c_acctbal", "c_nationkey").alias("mean"), stats.positive_weighted_mean("c_acctbal", "c_nationkey").alias("positive"))


PW = "(select p_retailprice::double as x, p_size::double as w from part)"


@register("a15_weighted_percentile", rounded(f"select min(x) as value from (select x, sum(w) over (order by x) as c, sum(w) over () as t from {PW}) where c >= 0.9 * t", "value"))
def weighted_percentile(spark, sf_dir):
    return stats.weighted_percentile(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_retailprice", 90, "p_size")


@register("a16_gini", rounded(f"""
select 1 - sum((c - pc) * (l + pl)) as value from (select c, l, lag(c, 1, 0) over (order by x) as pc, lag(l, 1, 0) over (order by x) as pl
  from (select x, sum(w) over (order by x) / sum(w) over () as c, sum(x * w) over (order by x) / sum(x * w) over () as l from (select x, sum(w) as w from {PW} group by x)))""", "value"))  # fmt: skip
def gini(spark, sf_dir):
    return stats.gini(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_retailprice", "p_size")


@register("a17_theil", rounded(f"select sum(w * (x / m) * ln(x / m)) / sum(w) as value from {PW}, (select sum(x * w) / sum(w) as m from {PW}) where x > 0 and w > 0", "value"))
def theil(spark, sf_dir):
    return stats.theil(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_retailprice", "p_size")


AVERAGE_RANK = "rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0"


@register("a26_spearman", rounded(f"select corr(a, b) as value from (select {AVERAGE_RANK.format(c='c_acctbal')} as a, {AVERAGE_RANK.format(c='c_nationkey')} as b from customer)", "value"))
def spearman(spark, sf_dir):
    return stats.spearman(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_acctbal", "c_nationkey")


@register("a18_a27_a29_set_measures", rounded("""
select corr(c_acctbal, c_nationkey) as pearson, count(*) filter (a and b) / count(*) filter (a or b) as jaccard, count(*) filter (a and not b) / count(*) filter (a) as dropped,
  (sum(c_nationkey) filter (a) - sum(c_nationkey) filter (b)) / sum(c_nationkey) filter (a) as reduction from (select *, c_acctbal > 2000 as a, c_acctbal > 5000 or c_custkey % 10 = 0 as b from customer)""", "pearson", "jaccard", "dropped", "reduction"))  # fmt: skip
def set_measures(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("a", F.col("c_acctbal") > 2000).withColumn("b", (F.col("c_acctbal") > 5000) | (F.col("c_custkey") % 10 == 0))
    return c.agg(F.corr("c_acctbal", "c_nationkey").alias("pearson"), stats.jaccard("a", "b").alias("jaccard"), stats.dropped_share("a", "b").alias("dropped"), stats.flagged_reduction("a", "b", "c_nationkey").alias("reduction"))


@register("w01_w02_ranks", f"select c_custkey, cast({AVERAGE_RANK.format(c='c_nationkey')} as double) as up, cast({AVERAGE_RANK.format(c='c_nationkey desc').replace('partition by c_nationkey desc', 'partition by c_nationkey')} as double) as down, round(({AVERAGE_RANK.format(c='c_nationkey')}) / count(*) over (), 6) as share from customer")
def ranks(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    c = ranking.average_rank(ranking.average_rank(c, "c_nationkey", "up"), "c_nationkey", "down", descending=True)
    return ranking.percent_rank(c, "c_nationkey", "share").select("c_custkey", "up", "down", "share")


@register("w03_quantile_buckets", "select c_custkey, cast(greatest(1, ceil((row_number() over (order by c_nationkey, c_custkey) - 1) * 4 / (count(*) over () - 1))) as integer) as bucket from customer")
def buckets(spark, sf_dir):
    return ranking.quantile_bucket(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey", "bucket").select("c_custkey", "bucket")


@register("w04_w09_scaling", rounded("""
select c_custkey, (c_acctbal - lo) / (hi - lo) as scaled, (coalesce(x, 0) - xlo) / (xhi - xlo) as filled, least(greatest(c_acctbal, p01), p99) as held, coalesce(c_acctbal >= p80, false) as top
from (select *, case when c_custkey % 5 > 0 then c_acctbal + 2000 end as x from customer), (select min(c_acctbal) as lo, max(c_acctbal) as hi, quantile_cont(c_acctbal, 0.01) as p01, quantile_cont(c_acctbal, 0.99) as p99, quantile_cont(c_acctbal, 0.8) as p80,
  least(min(case when c_custkey % 5 > 0 then c_acctbal + 2000 end), 0) as xlo, greatest(max(case when c_custkey % 5 > 0 then c_acctbal + 2000 end), 0) as xhi from customer)""", "scaled", "filled", "held"))  # fmt: skip
def scaled(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal") + 2000).alias("x"))
    c = scaling.scaled(scaling.scaled(c, "c_acctbal", "scaled"), "x", "filled", missing_as_zero=True)
    c = scaling.top_share(scaling.winsorised(c, "c_acctbal", "held"), "c_acctbal", "top", 0.2)
    return c.select("c_custkey", "scaled", "filled", "held", "top")


@register("w10_partition_share", rounded("select c_custkey, c_acctbal / nullif(sum(c_acctbal) over (partition by c_nationkey), 0) as share from customer", "share"))
def partition_share(spark, sf_dir):
    return reports.share_over(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_nationkey", "c_acctbal", "share").select("c_custkey", "share")


@register("w14_w16_flags", """
select c_custkey, a::int + b::int + c::int as variant_count, a and b and c as robust_core, a or b or c as any_variant, (a or b or c) and not (a and b and c) as sensitive,
  case when x >= y and x >= z then 'x' when y >= z then 'y' else 'z' end as leading
from (select *, c_acctbal > 0 as a, c_acctbal > 3000 as b, c_nationkey > 12 as c, c_nationkey as x, c_custkey % 25 as y, 12 as z from customer)""")  # fmt: skip
def flags(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumns({"a": F.col("c_acctbal") > 0, "b": F.col("c_acctbal") > 3000, "c": F.col("c_nationkey") > 12})
    out = sensitivity.robust_core(c, ["a", "b", "c"])
    leading = sensitivity.greatest_name({"x": F.col("c_nationkey"), "y": F.col("c_custkey") % 25, "z": F.lit(12)})
    return out.select("c_custkey", "variant_count", "robust_core", "any_variant", "sensitive", leading.alias("leading"))


@register("f04_coordinate_issues", with_views(" select count(*) as rows, 0 as invalid, count(*) filter (not (lon between 126.70 and 127.25 and lat between 37.40 and 37.75)) as out_of_bounds from rides", "rides"))
def coordinates(spark, sf_dir):
    return reports.coordinate_issues(view(spark, sf_dir, "rides"))


@register("f05_range_issues", """
select 'l_tax' as "column", 0 as not_a_number, count(*) filter (l_tax < 0.02) as below, count(*) filter (l_tax > 0.06) as above from lineitem
union all select 'l_quantity', 0, count(*) filter (l_quantity < 5), 0 from lineitem""")  # fmt: skip
def ranges(spark, sf_dir):
    return reports.range_issues(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), {"l_tax": (0.02, 0.06), "l_quantity": (5, None)})


@register("a33_stage_figures", rounded("""
select 's_acctbal' as "column", count(s_acctbal) as n, sum(s_acctbal) as sum, avg(s_acctbal) as mean, min(s_acctbal) as min, max(s_acctbal) as max, quantile_cont(s_acctbal, 0.9) as p90, count(*) filter (s_acctbal <> 0) as nonzero from supplier""", "sum", "mean", "min", "max", "p90"))  # fmt: skip
def stage_figures(spark, sf_dir):
    return reports.stage_figures(spark.read.parquet(f"{sf_dir}/supplier.parquet"), ["s_acctbal"])


@register("a34_data_loss_ledger", with_views("""
select 0 as stage_order, 'grade' as stage, (select count(*) from edges) as input_rows, (select count(*) from edges where grade_abs_percent <= 100) as output_rows, (select count(*) from edges where grade_abs_percent is null or grade_abs_percent > 100) as lost_rows
union all select 1, 'trips', (select count(*) from trips), (select count(*) from trips where hour is not null), (select count(*) from trips where hour is null)""", "edges", "trips"))  # fmt: skip
def ledger(spark, sf_dir):
    return reports.ledger([("grade", view(spark, sf_dir, "edges"), costed(spark, sf_dir)), ("trips", view(spark, sf_dir, "trips"), trips(spark, sf_dir))])


@register("a24_t01_value_counts", "select p_brand, count(*) as count from part group by 1 order by 2 desc, 1 limit 15")
def value_counts(spark, sf_dir):
    return reports.value_counts(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_brand", 15)


@register("a25_label_counts", "select label, count(*) as count from (select distinct p_partkey, unnest(string_split(p_type || ' ' || p_name, ' ')) as label from part) where label <> '' group by 1")
def label_counts(spark, sf_dir):
    return reports.label_counts(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat_ws(" ", "p_type", "p_name").alias("l")), "l", " ")


@register("a35_repeated_names", "select p_partkey, p_name from part where p_name in (select p_name from part group by 1 having count(*) > 1)")
def repeated(spark, sf_dir):
    return reports.repeated(spark.read.parquet(f"{sf_dir}/part.parquet"), ["p_name"]).select("p_partkey", "p_name")


@register("a22_leading_value", """
select c_nationkey, sum(n) as rows, min(c_mktsegment) filter (n = best) as top_c_mktsegment, max(n) as top_count
from (select *, max(n) over (partition by c_nationkey) as best from (select c_nationkey, c_mktsegment, count(*) as n from customer group by all)) group by 1""")  # fmt: skip
def leading_value(spark, sf_dir):
    return sensitivity.leading_by_group(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_nationkey", "c_mktsegment")


@register("t04_j08_first_per_key", "select c_nationkey, c_acctbal, c_custkey from (select *, row_number() over (partition by c_nationkey order by c_acctbal, c_custkey) as r from customer) where r = 1")
def first_rows(spark, sf_dir):
    return reports.first_per_key(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_nationkey", "c_acctbal", "c_custkey"), "c_nationkey", ["c_acctbal", "c_custkey"])


@register("j18_u05_unmatched_keys", "select c_custkey as k, 'left' as only_in from customer where c_custkey not in (select o_custkey from orders) union all select distinct l_suppkey + 1000000, 'right' from lineitem")
def unmatched_keys(spark, sf_dir):
    """Customers without orders, and keys that only the other side has."""
    a = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k"))
    b = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("long").alias("k"))
    b = b.union(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_suppkey") + 1000000).cast("long")))
    return pop.unmatched_keys(a, b, ["k"])


@register("r26_r27_labels", """
select o_orderkey, case when o_orderkey % 9 = 0 then '자료 없음' when p < 10 then '0-10m' when p < 25 then '10-25m' when p < 50 then '25-50m' when p < 75 then '50-75m' when p < 100 then '75-100m' else '100m 이상' end as burden,
  case when p < 20 then 'low' when o_orderstatus = 'O' then 'open' else 'none' end as policy, case when p < 20 and o_orderstatus = 'O' then 'low, open' when p < 20 then 'low' when o_orderstatus = 'O' then 'open' else '현장 점검' end as actions
from (select *, o_orderkey % 130 as p from orders)""")  # fmt: skip
def labels(spark, sf_dir):
    p = F.col("o_orderkey") % 130
    tests = {"low": p < 20, "open": F.col("o_orderstatus") == "O"}
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", sensitivity.burden_class(F.when(F.col("o_orderkey") % 9 != 0, p)).alias("burden"), sensitivity.policy_label(tests).alias("policy"), sensitivity.actions(tests, "현장 점검").alias("actions"))


@register("v01_heat_table", 'select c_nationkey, count(*) filter (q = 1 and c_acctbal > 0) as "1", count(*) filter (q = 2 and c_acctbal > 0) as "2" from (select *, 1 + c_custkey % 2 as q from customer) group by 1')
def heat_table(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumns({"q": 1 + F.col("c_custkey") % 2, "f": F.col("c_acctbal") > 0})
    return reports.heat_table(c, "c_nationkey", "q", [1, 2], "f")


@register("a21_burden_by_area", rounded("""
select c_mktsegment, count(*) as hex_count, count(*) filter (c_acctbal > 0) as a_count, count(*) filter (c_nationkey > 12) as b_count, avg(c_acctbal) as mean_increase, quantile_cont(c_acctbal, 0.9) as p90_increase from customer group by 1""", "mean_increase", "p90_increase"))  # fmt: skip
def area_burden(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumns({"a": F.col("c_acctbal") > 0, "b": F.col("c_nationkey") > 12})
    return sensitivity.burden_by_area(c, "c_mktsegment", "c_acctbal", ["a", "b"])
