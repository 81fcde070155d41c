"""Queries over incremental figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.plans.analog import rounded, view
from terrane.plans.queries_files import shared
from terrane.plans.queries_table import GRID_DOUBLES, GRID_SQL
from terrane.plans.registry import register
from terrane.streaming import incremental


@register("h08_merged_partials", rounded(GRID_SQL, *GRID_DOUBLES, digits=9), digits=9)
def merged_partials(spark, sf_dir):
    """Grid figures from the partials of three batches."""
    rows = view(spark, sf_dir, "grid")
    parts = [incremental.grid_partials(rows.where(F.pmod(F.hash("living"), F.lit(3)) == k), "grid", "hr", "living", ["old"]) for k in range(3)]
    return incremental.merged_grid(parts[0].union(parts[1]).union(parts[2]))


@register("streaming_hourly", rounded("select date_trunc('hour', ts) as hour, event_type, count(*) as n, sum(value) as total, avg(value) as mean from events group by all", "total", "mean"))
def hourly(spark, sf_dir):
    """A stream over the events, taken as far as it has come."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    out, checkpoint = shared(spark, "hourly"), shared(spark, "hourly-state")
    incremental.run_hourly(spark, sf_dir, schema, out, checkpoint, "ts", "event_type", "value", files="events.parquet")
    return spark.read.parquet(out)


@register("event_time_hourly", rounded("select date_trunc('hour', ts) as hour, event_type, count(*) as n, sum(value) as total, avg(value) as mean from events group by all", "total", "mean"))
def event_time_hourly(spark, sf_dir):
    """The same figures by the batch form, whose watermark counts on streams only."""
    return incremental.hourly_by_event_time(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "event_type", "value")
