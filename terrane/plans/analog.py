"""Domain inputs derived from the test tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Streets join as many nodes as there are parts.
NODES = "(select max(p_partkey) from {part})"

VIEWS = {
    "edges": f"""
        select l_partkey as u, 1 + (l_partkey * 7 + l_suppkey) % {NODES} as v, l_linenumber as key, l_orderkey as osmid,
            l_quantity * 10.0 as length_m,
            case when l_orderkey % 37 = 0 then null when l_orderkey % 41 = 0 then 684.6 else (l_discount - 0.05) * 900.0 end as grade_percent,
            abs(case when l_orderkey % 37 = 0 then null when l_orderkey % 41 = 0 then 684.6 else (l_discount - 0.05) * 900.0 end) as grade_abs_percent,
            case when l_returnflag = 'R' then 'steps' when l_returnflag = 'A' then 'footway' end as highway
        from {{lineitem}}""",
    "stops": f"select distinct 1 + s_suppkey * 37 % {NODES} as node from {{supplier}} where s_acctbal > 0",
    "added_stops": "select p_partkey as node from {part} where p_size = 7",
    "cells": """
        select p_partkey as hex_id, case when p_partkey % 29 = 0 then null else p_partkey end as origin_node_id, p_retailprice as population,
            cast(p_size as double) as senior, case when p_partkey % 31 = 0 then null else p_retailprice * (1 + p_size % 7) end as demand, p_brand as area
        from {part}""",
    "grid": "select 'g' || cast(user_id as varchar(9)) as grid, hour(ts) as hr, abs(value) as living, abs(value) * (user_id % 4) * 0.1 as old from {events}",
    "trips": """
        select '202501' as month, cast(o_orderkey % 7 as varchar(9)) as weekday, case when o_orderkey % 50 = 0 then null else o_orderkey % 24 end as hour,
            case when c_nationkey < 12 then '11' else '21' end || cast(100 + c_nationkey as varchar(9)) as origin,
            case when s_nationkey < 12 then '11' else '21' end || cast(100 + s_nationkey as varchar(9)) as destination, 'F' as sex, 40 as age,
            case o_orderkey % 5 when 0 then 'HW' when 1 then 'WH' when 2 then 'HE' else 'EH' end as trip_type,
            case when l_linenumber = 7 then 0.0 else l_quantity end as move_pop, l_tax as masked_count, case when l_partkey % 11 = 0 then null else l_extendedprice / 100 end as time_min
        from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey join {supplier} on l_suppkey = s_suppkey""",
    "codes": "select '11' || cast(100 + n_nationkey as varchar(9)) as code from {nation} where n_nationkey < 10 union all select '1199' as code",
    "rides": """
        select s_suppkey as stop_id, s_name as stop_name, 126.6 + (s_suppkey % 80) * 0.01 as lon, 37.35 + (s_suppkey % 45) * 0.01 as lat,
            case l_linestatus when 'O' then ' Yes' else 'no' end as location_matched, case when l_linenumber % 3 = 0 then 'bad' else cast(l_quantity as varchar(9)) end as passengers
        from {lineitem} join {supplier} on l_suppkey = s_suppkey""",
    "points": "select p_partkey as point_id, cast((p_partkey * 7919) % 10007 as double) as x, cast((p_partkey * 104729) % 10009 as double) as y from {part}",
    "nodes": "select s_suppkey as node_id, cast((s_suppkey * 6007) % 10007 as double) as x, cast((s_suppkey * 7001) % 10009 as double) as y from {supplier}",
    "squares": """
        select a.n_nationkey * 25 + b.n_nationkey as hex_id, a.n_nationkey * 400.0 as w, b.n_nationkey * 400.0 as s, a.n_nationkey * 400.0 + 400.0 as e, b.n_nationkey * 400.0 + 400.0 as n
        from {nation} a join {nation} b on b.n_nationkey >= 0""",
    "areas": """
        select s_suppkey as area_id, s_name as area_name, (s_suppkey * 977) % 9000 * 1.0 as w, (s_suppkey * 613) % 9000 * 1.0 as s,
            (s_suppkey * 977) % 9000 * 1.0 + 700.0 as e, (s_suppkey * 613) % 9000 * 1.0 + 500.0 as n, s_acctbal as pop, s_suppkey % 3 = 0 as joined
        from {supplier}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = [t for t in TABLES if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """The views as common table expressions before DuckDB SQL that begins with a select or with further expressions."""
    parts = [f"{n} as ({re.sub(r'[{}]', '', VIEWS[n])})" for n in names]
    return ("with recursive " if recursive else "with ") + ", ".join(parts) + sql


def rounded(sql: str, *columns: str, digits: int = 6) -> str:
    """Doubles of a DuckDB query rounded, as the Spark side does."""
    return f"select * replace ({', '.join(f'round({c}, {digits}) + 0.0 as {c}' for c in columns)}) from ({sql})"
