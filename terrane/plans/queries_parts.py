"""Queries over clean-up, names and codes, joins with checks, sets, and reports by type."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import cleaning, costs, scaling, stats
from terrane.operators import edges as edge_ops
from terrane.operators import population as pop
from terrane.operators import reports, routing, sensitivity, spatial
from terrane.operators import vulnerability as vul
from terrane.plans.analog import rounded, view, with_views
from terrane.plans.queries_model import SCORED, model_sql, scored
from terrane.plans.queries_table import trips
from terrane.plans.registry import register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- names, codes and numbers


DISTRICT_LIST = "[" + ", ".join(f"'{name}'" for name in pop.DISTRICTS.values()) + "]"


@register("x01_x02_x04_x06_x07_names", f"""
select c_custkey, replace(replace(c_mktsegment, ' ', ''), '·', '') || c_nationkey || '동' as standard, c_mktsegment || '1동' as dong, case when c_custkey % 3 = 0 then '' else cast(c_custkey as varchar) end as code,
  substr(cast(1106081000 + c_custkey as varchar), 1, 7) as prefix, {DISTRICT_LIST}[c_nationkey] as district from customer""")  # fmt: skip
def names(spark, sf_dir):
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").withColumn("admin_code", key + 1106081000).withColumn("prefix", pop.mobility_code("admin_code"))
    raw = F.when(key % 3 != 0, F.concat(key.cast("string"), F.lit(".0"))).otherwise("n/a")
    return c.select(
        "c_custkey", cleaning.standard_name(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ·"), F.col("c_nationkey").cast("string"), F.lit("ㆍ동 "))).alias("standard"),
        cleaning.dong_key(F.concat(F.col("c_mktsegment"), F.lit("제1동"))).alias("dong"), cleaning.code(raw).alias("code"),
        F.col("prefix"),
        pop.district_of(F.concat(F.lit("11"), F.lpad((F.col("c_nationkey") * 10).cast("string"), 3, "0"))).alias("district"),
    )


@register("x09_x11_h03_h09_values", """
select o_orderkey, case when o_orderkey % 5 > 0 then strftime(o_orderdate, '%Y-%m-%d') end as day, case when o_orderkey % 4 > 0 then o_orderkey * 1.5 end as value,
  least(greatest(o_orderkey % 50, 10), 40) as held, round(ln(1 + o_orderkey % 50), 6) as logged, o_orderkey % 4 > 0 as finite, case o_orderkey % 3 when 0 then 'a' when 1 then 'b' end as padded from orders""")  # fmt: skip
def values(spark, sf_dir):
    """Times and numbers that may not parse, clipping, logarithms, and a place beyond a list's end."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = F.when(k % 4 != 0, (k * 1.5).cast("string")).otherwise("NaN")
    when = F.when(k % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).otherwise("yesterday")
    number = cleaning.number(text)
    return o.select(
        k, F.date_format(F.try_to_timestamp(when), "yyyy-MM-dd").alias("day"), number.alias("value"), F.least(F.greatest(k % 50, F.lit(10)), F.lit(40)).alias("held"),
        F.log1p((k % 50).cast("double")).alias("logged"), number.isNotNull().alias("finite"), F.get(F.array(F.lit("a"), F.lit("b")), (k % 3).cast("int")).alias("padded"),
    )


@register("p28_u01_transit_rows", """
select 'bus' as mode, cast(s_suppkey as varchar) as stop_id, s_name as stop_name, '202501' as month, s_acctbal as passengers, 'Y' as location_matched from supplier where s_suppkey % 5 > 0
union all select 'bus', null, s_name, '202501', s_acctbal, 'Y' from supplier where s_suppkey % 5 = 0
union all select 'subway', c_mktsegment, c_mktsegment, '202502', null, null from customer""")  # fmt: skip
def transit_rows(spark, sf_dir):
    """Bus and subway rows, whose columns go by other names, under common ones."""
    s = table(spark, sf_dir, "supplier").select(
        F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey").cast("string")).otherwise("").alias("표준버스정류장ID"), F.col("s_name").alias("역명"), F.lit("202501").alias("사용년월"),
        F.col("s_acctbal").alias("passengers"), F.lit("Y").alias("location_matched"),
    )
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("지하철역"), F.lit("202502").alias("사용월"))
    names = ["mode", "stop_id", "stop_name", "month", "passengers", "location_matched"]
    both = pop.normalised_stops(s, "bus").unionByName(pop.normalised_stops(c, "subway"), allowMissingColumns=True)
    return both.select(*names)


@register("p29_p30_p31_p32_p33_columns", rounded("""
select p_partkey, case when p_partkey % 3 > 0 then p_name else p_brand end as label, case when p_partkey % 4 > 0 then p_size else 0 end as size, case when p_partkey % 4 > 0 then p_size * 0.125 else 0 end as share, true as only_known from part""", "share"))  # fmt: skip
def columns(spark, sf_dir):
    """The first alias that is there, zeros for missing numbers, rounding, known columns only, an alias renamed."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    rows = p.select(
        k, F.when(k % 3 != 0, F.col("p_name")).alias("title"), F.col("p_brand").alias("name"), F.when(k % 4 != 0, F.col("p_size")).alias("size"),
        F.when(k % 4 != 0, F.col("p_size") * 0.125 + 1e-9).alias("part_share"), F.lit("x").alias("other"),
    )
    rows = cleaning.rename_aliases(rows, {"part_share": "share", "absent": "size"})
    rows = rows.withColumn("label", cleaning.first_existing(rows.columns, ["absent", "title", "name"]))
    rows = cleaning.round_numeric(cleaning.fill_numeric(rows, without=("p_partkey",)), 4)
    kept = cleaning.select_existing(rows, ["p_partkey", "label", "size", "share", "absent"])
    return kept.withColumn("only_known", F.lit(kept.columns == ["p_partkey", "label", "size", "share"]))


@register("f03_h05_contract", "select * from (values ('lon', true), ('lat', false)) t(name, there) union all select 'require', not bool_and(n_name = '') from nation")
def contract(spark, sf_dir):
    """Required columns that a table lacks, as a report and as an error."""
    df = table(spark, sf_dir, "nation").withColumn("lon", F.lit(1.0))
    missing = reports.contract_issues(df, "poi")
    try:
        cleaning.require(df, ["lon", "lat"])
        raised = False
    except KeyError:
        raised = True
    return spark.createDataFrame([("lon", "lon" not in missing), ("lat", "lat" not in missing), ("require", raised)], "name string, there boolean")


@register("x13_labels", "select n_nationkey, case n_nationkey % 4 when 0 then '경사·기상 부담형' when 1 then '수요집중형' when 2 then 'odd' end as label from nation")
def labels(spark, sf_dir):
    """Names of an enumeration; unknown ones stay as they are."""
    k = F.col("n_nationkey") % 4
    code = F.when(k == 0, "slope_weather_penalty").when(k == 1, "high_demand").when(k == 2, "odd")
    return table(spark, sf_dir, "nation").select("n_nationkey", sensitivity.reason_label(code).alias("label"))


@register("p08_p09_p10_h04_models", rounded(with_views("""
, usable as (select length_m as l, least(grade_abs_percent, 25) as g from edges where grade_abs_percent <= 100)
select 'm0' as model, count(*) as n, sum(l) as total from usable union all select 'm1', count(*), sum(l * (1 + 0.05 * g)) from usable union all select 'm2', count(*), sum(l * (1 + 0.05 * g) * (1 + 0.03 * 4.5)) from usable
union all select 'm3', count(*), sum(l * (1 + 0.05 * g) * (1 + 0.03 * 4.5 + 0.08 * 4.5 * g / 100)) from usable union all select 'unknown', count(*), null from usable""", "edges"), "total", digits=3), digits=3)  # fmt: skip
def models(spark, sf_dir):
    """Costs by the models' names in any case, with coefficients of a mapping; other names are an error. The input rows stay as they are."""
    p = costs.CostParameters.of({"alpha": 0.05, "grade_cap": 25.0, "no_parameter": 1.0})
    intensity = costs.weather_intensity(F.lit(2.0), F.lit(0.5), p)
    e = view(spark, sf_dir, "edges")
    usable = edge_ops.with_costs(e, 2.0, 0.5, p)
    out = None
    for name in ("M0", "m1", "M2", "m3", "unknown"):
        try:
            value = F.sum(costs.cost(name, "length_m", "grade_abs_percent", intensity, p))
        except ValueError:
            value = F.lit(None).cast("double")
        row = usable.agg(F.lit(name.lower()).alias("model"), F.count("*").alias("n"), value.alias("total"))
        out = row if out is None else out.union(row)
    return out


# ---- joins and sets


@register("j02_inner_layers", rounded(with_views(" select hex_id, demand, (e - w) * (n - s) as surface from squares join cells using (hex_id)", "squares", "cells"), "demand", "surface"))
def inner_layers(spark, sf_dir):
    s = view(spark, sf_dir, "squares")
    return s.join(view(spark, sf_dir, "cells"), "hex_id").select("hex_id", "demand", ((F.col("e") - F.col("w")) * (F.col("n") - F.col("s"))).alias("surface"))


@register("j04_checked_join", rounded("""
select n_name || 'x동' as admin_name, n_nationkey * 100 + 500 as registered_population, n_nationkey * 10 as registered_senior_population, n_nationkey * 10 / (n_nationkey * 100 + 500) as registered_senior_share, 2 as refused from nation""", "registered_senior_share"))  # fmt: skip
def checked_join(spark, sf_dir):
    """Boundaries with the population of their names, one to one; names in two parts are summed, an alias is followed; doubled keys and missing ones are errors."""
    n = table(spark, sf_dir, "nation")
    k, code = F.col("n_nationkey"), F.concat(F.lit("11"), F.lpad((F.col("n_regionkey") * 10 + 10).cast("string"), 3, "0"), F.col("n_nationkey").cast("string"))
    district = pop.district_of(code)
    boundary = n.select(code.alias("code"), F.concat("n_name", F.lit("x동")).alias("admin_name"), district.alias("district_name"))
    one = n.select(F.concat("n_name", F.lit("x제1동")).alias("admin_name"), district.alias("district_name"), (k * 100).alias("registered_population"), (k * 10).alias("registered_senior_population"))
    two = n.select(F.concat(F.lit(" "), F.col("n_name"), F.lit("x·동")).alias("admin_name"), district.alias("district_name"), F.lit(500).cast("long").alias("registered_population"), F.lit(0).cast("long").alias("registered_senior_population"))
    aliases = n.select(district.alias("district_name"), F.concat(F.regexp_replace("n_name", " ", ""), F.lit("x1동")).alias("admin_key"), F.concat(F.regexp_replace("n_name", " ", ""), F.lit("x동")).alias("boundary_key"))
    refused = 0
    for left, right in ((boundary.union(boundary), one.union(two)), (boundary, two.limit(3))):
        try:
            pop.register_by_boundary(left, right, aliases)
        except ValueError:
            refused += 1
    found = pop.register_by_boundary(boundary, one.union(two), aliases)
    return found.select("admin_name", "registered_population", "registered_senior_population", "registered_senior_share", F.lit(refused).alias("refused"))


@register("j07_membership", "select c_custkey, c_custkey in (select o_custkey from orders) as ordered from customer")
def membership(spark, sf_dir):
    """Whether a key is in a set, as a column."""
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return c.join(o.withColumn("ordered", F.lit(True)), "c_custkey", "left").withColumn("ordered", F.col("ordered").isNotNull())


@register("j09_policy_merge", """
select c_custkey as hex_id, case when d then '계단·눈 대체경로 없음' when b then 'S4 기상 민감 후보' when a then 'S1 정류장·접근로 검토' when u then '계단 사용 경로' end as policy_review_type
from (select c_custkey, c_custkey % 2 = 0 and c_acctbal > 3000 as a, c_custkey % 3 = 0 and c_acctbal > 0 as b, c_custkey % 5 = 0 as d, c_custkey % 7 = 0 as u from customer) where a or b or d or u""")  # fmt: skip
def policy_merge(spark, sf_dir):
    """Flags of four tables, each with some of the cells, joined to all cells; cells that any marks, by the first policy."""
    c = table(spark, sf_dir, "customer").withColumn("hex_id", F.col("c_custkey"))
    k = F.col("hex_id")
    s1 = c.where(k % 2 == 0).select("hex_id", (F.col("c_acctbal") > 3000).alias("resolved_hidden"))
    s4 = c.where(k % 3 == 0).select("hex_id", (F.col("c_acctbal") > 0).alias("sensitive"))
    m4 = c.where((k % 5 == 0) | (k % 7 == 0)).select("hex_id", (k % 5 == 0).alias("no_alternative"), (k % 7 == 0).alias("uses_steps"))
    merged = sensitivity.merged_policies(c.select("hex_id"), {"s1_resolved_hidden": (s1, "resolved_hidden"), "s4_weather_sensitive": (s4, "sensitive"), "step_no_alt": (m4, "no_alternative"), "uses_steps": (m4, "uses_steps")})
    return sensitivity.policy_candidates(merged).select("hex_id", "policy_review_type")


@register("u02_partial_sums", "select l_returnflag, count(*) as n, sum(l_quantity) as total from lineitem group by 1")
def partial_sums(spark, sf_dir):
    """Sums of parts, each with columns of its own order, put one below the other and summed."""
    rows = table(spark, sf_dir, "lineitem")
    out = None
    for k in range(3):
        part = rows.where(F.pmod(F.hash("l_orderkey"), F.lit(3)) == k).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"))
        part = part.select("total", "n", "l_returnflag") if k % 2 else part
        out = part if out is None else out.unionByName(part)
    return out.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


SETS = "a as (select distinct c_nationkey as k from customer where c_acctbal > 9000), b as (select distinct s_nationkey as k from supplier where s_acctbal > 5000)"


@register("u03_u04_id_sets", f"with {SETS}, c as (select (select count(*) from (select * from a intersect select * from b)) as both_, (select count(*) from (select * from a except select * from b)) as only_a, (select count(*) from (select * from a union select * from b)) as either) select both_, only_a, either, only_a = 0 and either = both_ as same, true as same_as_itself from c")
def id_sets(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).distinct()
    b = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct()
    row = (a.intersect(b).count(), a.subtract(b).count(), a.union(b).distinct().count(), reports.same_rows(a, b), reports.same_rows(a, a.repartition(3)))
    return spark.createDataFrame([row], "both_ long, only_a long, either long, same boolean, same_as_itself boolean")


@register("f11_prefixes", with_views(" select code, substr(code, 1, 4) as head, count(*) as trips from (select origin as code from trips where hour is not null and origin like '11%') group by all", "trips"))
def prefixes(spark, sf_dir):
    t = trips(spark, sf_dir).where(F.col("origin").startswith("11"))
    return t.groupBy(F.col("origin").alias("code")).agg(F.count("*").alias("trips")).select("code", F.substring("code", 1, 4).alias("head"), "trips")


@register("h06_prepared_trips", rounded(with_views(" select month, weekday, hour, origin, destination, trip_type, move_pop, masked_count, time_min from trips where hour is not null", "trips"), "move_pop", "masked_count", "time_min"))
def prepared_trips(spark, sf_dir):
    return trips(spark, sf_dir)


@register("h02_first_there", "select c_nationkey, min(c_custkey) filter (c_custkey % 4 = 1) as first_there from customer group by 1")
def first_there(spark, sf_dir):
    """The first value that is there, by an order; NULL where there is none."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.when(F.col("c_custkey") % 4 == 1, F.col("c_custkey")).alias("x"), "c_custkey")
    return c.groupBy("c_nationkey").agg(F.min_by("x", F.when(F.col("x").isNotNull(), F.col("c_custkey"))).alias("first_there"))


@register("h07_zero_filled_scaling", rounded("select c_custkey, (coalesce(x, 0) - lo) / (hi - lo) as filled, 0.0::double as constant from (select c_custkey, case when c_custkey % 5 > 0 then c_acctbal end as x from customer), (select min(coalesce(x, 0)) as lo, max(coalesce(x, 0)) as hi from (select case when c_custkey % 5 > 0 then c_acctbal end as x from customer))", "filled", "constant"))
def zero_filled(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal")).alias("x"), F.lit(3.0).alias("same"))
    return scaling.scaled_all(c, {"filled": "x", "constant": "same"}, missing_as_zero=True).select("c_custkey", "filled", "constant")


@register("h10_valid_universe", model_sql(SCORED + " select hex_id, cast(origin_node_id as bigint) as node from scored where score is not null"))
def valid_universe(spark, sf_dir):
    """Cells with both axes and a typed node."""
    return scored(spark, sf_dir).where("analysis_valid_final").select("hex_id", cleaning.whole("origin_node_id").alias("node"))


@register("h11_t06_destinations", with_views("""
select distinct node_id as node from (select p.point_id, q.node_id, row_number() over (partition by p.point_id order by sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), q.node_id) as r, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) as d
  from points p join nodes q on abs(p.x - q.x) <= 400 and abs(p.y - q.y) <= 400) where r = 1 and d <= 400""", "points", "nodes"))  # fmt: skip
def destinations(spark, sf_dir):
    """Distinct nodes of the stops that snap within a distance."""
    found = spatial.snap(view(spark, sf_dir, "points"), view(spark, sf_dir, "nodes"), ["point_id"], 400.0, unique=True)
    return found.where("node_id is not null").select(F.col("node_id").alias("node")).distinct().orderBy("node")


@register("h12_network_loaders", with_views(" select count(*) as edges, count(distinct u) as heads, min(u) as least, max(v) as most from edges where key <> 3 and length_m is not null", "edges"))
def network_loaders(spark, sf_dir):
    """Edges whose ends are numbers, typed; the others are dropped."""
    e = view(spark, sf_dir, "edges").withColumn("u", F.when(F.col("key") == 3, "none").otherwise(F.concat(F.col("u").cast("string"), F.lit(".0"))))
    typed = e.withColumns({"u": cleaning.whole("u"), "v": cleaning.whole("v")}).dropna(subset=["u", "v", "length_m"])
    return typed.agg(F.count("*").alias("edges"), F.count_distinct("u").alias("heads"), F.min("u").alias("least"), F.max("v").alias("most"))


@register("h13_layer_loader", with_views(" select area_id, case when area_id % 4 > 0 then area_name end as area_name from areas where area_id % 6 > 0", "areas"))
def layer_loader(spark, sf_dir):
    """Rows with a geometry, and labels joined where there are some."""
    a = view(spark, sf_dir, "areas")
    rows = a.withColumn("ring", F.when(F.col("area_id") % 6 != 0, F.array("w", "s"))).where("ring is not null").select("area_id", F.lit("old").alias("area_name"))
    labels = a.where(F.col("area_id") % 4 != 0).select("area_id", "area_name")
    return sensitivity.relabel(rows, labels, "area_id", ["area_name"])[0].select("area_id", "area_name")


# ---- reports


@register("w11_district_rows", """
with rows_ as (
  select n_nationkey as pos, case when n_nationkey = 20 then '서울시' when n_nationkey % 6 = 0 then case n_nationkey // 6 when 0 then '종로구' when 1 then '중구' when 2 then '용산구' when 3 then '성동구' else '강동구' end else n_name end as name,
    case when n_nationkey % 7 = 3 then null else n_nationkey * 1000 end as p, n_nationkey as s from nation),
marked as (select *, case when name = '서울시' then '' when pos % 6 = 0 then name end as mark from rows_),
filled as (select *, last_value(mark ignore nulls) over (order by pos rows unbounded preceding) as district from marked)
select name as admin_name, nullif(district, '') as district_name, p as registered_population, s as registered_senior_population from filled where mark is null""")  # fmt: skip
def district_rows(spark, sf_dir):
    """Rows below a district's are its own, until the city's total closes it."""
    k = F.col("n_nationkey")
    names = F.array(*(F.lit(x) for x in ("종로구", "중구", "용산구", "성동구", "강동구")))
    name = F.when(k == 20, "서울시").when(k % 6 == 0, F.get(names, (k / 6).cast("int"))).otherwise(F.col("n_name"))
    sheet = table(spark, sf_dir, "nation").select(k.alias("row_idx"), name.alias("name"), F.when(k % 7 == 3, "-").otherwise(F.format_number(k * 1000, 0)).alias("population"), k.cast("string").alias("senior"))
    return pop.registered_rows(sheet).select("admin_name", "district_name", "registered_population", "registered_senior_population")


T02_SQL = """
, typed as (select hex_id, score, population, area as kind from scored where score is not null),
both_ as (select *, 'all' as list from typed union all select *, kind from typed)
select list, hex_id, score, rank from (select *, row_number() over (partition by list order by score desc, population desc, hex_id) as rank from both_) where rank <= 5"""


@register("t02_top_by_type", rounded(model_sql(SCORED + T02_SQL), "score"))
def top_by_type(spark, sf_dir):
    """The five highest overall and of each type, ties by population, then by id."""
    typed = scored(spark, sf_dir).where("vulnerability_m3_final is not null").withColumn("kind", F.col("area"))
    return vul.leading_by_type(typed, 5, "kind", second="population").select("list", "hex_id", F.col("vulnerability_m3_final").alias("score"), "rank")


@register("v01_axis_and_bars", rounded("""
select 'bound' as kind, null as p_brand, quantile_cont(p_retailprice, 0.995) as value, null as place from part
union all select 'bar', p_brand, total, row_number() over (order by total desc, p_brand) from (select p_brand, sum(p_size)::double as total from part group by 1)""", "value"))  # fmt: skip
def axis_and_bars(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    bound = reports.upper_bound(p, "p_retailprice").select(F.lit("bound").alias("kind"), F.lit(None).cast("string").alias("p_brand"), F.col("bound").alias("value"), F.lit(None).cast("int").alias("place"))
    bars = reports.sorted_bars(p, "p_brand", "p_size").select(F.lit("bar"), "p_brand", F.col("total").cast("double"), "place")
    return bound.union(bars)


@register("r20_reordering", rounded("""
with r as (select rank() over (order by c_acctbal) + (count(*) over (partition by c_acctbal) - 1) / 2.0 as a, rank() over (order by c_acctbal + c_custkey % 3) + (count(*) over (partition by c_acctbal + c_custkey % 3) - 1) / 2.0 as b,
  rank() over (order by c_nationkey) + (count(*) over (partition by c_nationkey) - 1) / 2.0 as c, c_acctbal > 5000 as x, c_acctbal > 5001 as y from customer)
select 'near' as pair, corr(a, b) as spearman, count(*) filter (x and y) / count(*) filter (x or y) as jaccard, case when corr(a, b) < 0.98 or count(*) filter (x and y) / count(*) filter (x or y) < 0.8 then 'reordered' else 'stable' end as verdict from r
union all select 'far', corr(a, c), count(*) filter (x and y) / count(*) filter (x or y), case when corr(a, c) < 0.98 or count(*) filter (x and y) / count(*) filter (x or y) < 0.8 then 'reordered' else 'stable' end from r""", "spearman", "jaccard"))  # fmt: skip
def reordering(spark, sf_dir):
    """Whether two rankings and their flagged sets tell the same."""
    c = table(spark, sf_dir, "customer").withColumns({"b": F.col("c_acctbal") + F.col("c_custkey") % 3, "x": F.col("c_acctbal") > 5000, "y": F.col("c_acctbal") > 5001})
    jaccard = c.agg(stats.jaccard("x", "y")).first()[0]
    rows = []
    for name, other in (("near", "b"), ("far", "c_nationkey")):
        rank = stats.spearman(c, "c_acctbal", other).first()[0]
        rows.append((name, rank, jaccard, sensitivity.reordering(rank, jaccard)))
    return spark.createDataFrame(rows, "pair string, spearman double, jaccard double, verdict string")


@register("r05_leading_stop", """
select source, n_flat, n_hard from (select * from (values (1, 150, 120, 9.0), (2, 150, 90, 8.0), (3, 100, 10, 7.0), (4, 400, 200, 6.0), (5, 130, 13, 1.0)) t(source, n_flat, n_hard, steepness) order by steepness desc, source limit 4)
where n_flat >= 120 order by n_hard / n_flat, steepness desc, source limit 1""")
def leading_stop(spark, sf_dir):
    """Of the four steepest sources with enough flat reach the one whose reach shrinks most."""
    rows = [(1, 150, 120, 9.0), (2, 150, 90, 8.0), (3, 100, 10, 7.0), (4, 400, 200, 6.0), (5, 130, 13, 1.0)]
    t = spark.createDataFrame([(a, b, c, s, c / b) for a, b, c, s in rows], "source long, n_flat int, n_hard int, steepness double, shrink double")
    got = routing.leading_stop(t.drop("steepness"), t.select(F.col("source").alias("node"), "steepness"), steepest=4)
    return got.select("source", "n_flat", "n_hard")
