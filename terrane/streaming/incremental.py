"""Incremental aggregation of daily files.

The grid and mobility figures are sums, counts and maxima, so each new batch of
files is aggregated by itself and kept as partial rows; the figures are the
merged partials. `availableNow` takes what has come since the last run; the
checkpoint makes sure that each file counts once, also after a failure.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions.cleaning import number, ratio
from terrane.sources.files import charset

_TIMES = {"daytime": "hour between 9 and 17", "nighttime": "hour between 0 and 5 or hour between 20 and 23", "commute": "hour between 7 and 9 or hour between 18 and 20"}


def grid_partials(rows: DataFrame, grid: str, hour: str, living: str, seniors: Sequence[str] = ()) -> DataFrame:
    """Mergeable sums of each cell."""
    old = sum((F.coalesce(number(c), F.lit(0.0)) for c in seniors), F.lit(0.0))
    typed = rows.select(F.col(grid).alias("grid_id"), number(hour).alias("hour"), F.coalesce(number(living), F.lit(0.0)).alias("living"), old.alias("old"))
    return typed.groupBy("grid_id").agg(
        F.count("*").alias("n"), F.sum("living").alias("living_sum"), F.max("living").alias("living_max"), F.sum("old").alias("old_sum"), F.max("old").alias("old_max"),
        *(F.sum(F.when(F.expr(t), F.col("living"))).alias(f"{k}_sum") for k, t in _TIMES.items()), *(F.count_if(F.expr(t)).alias(f"{k}_n") for k, t in _TIMES.items()),
    )


def merged_grid(partials: DataFrame) -> DataFrame:
    """The figures of all partials: the same as over all rows at once."""
    total = lambda c: F.sum(c)
    out = partials.groupBy("grid_id").agg(
        total("n").alias("observed_rows"), ratio(total("living_sum"), total("n")).alias("mean_living_population"), F.max("living_max").alias("max_living_population"),
        ratio(total("old_sum"), total("n")).alias("mean_senior_population"), F.max("old_max").alias("max_senior_population"),
        *(ratio(total(f"{k}_sum"), total(f"{k}_n")).alias(f"{k}_mean_population") for k in _TIMES),
    )
    return out.withColumn("senior_share_mean", ratio("mean_senior_population", "mean_living_population"))


def ingest(spark: SparkSession, pattern: str, schema: T.StructType, partial: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, encoding: str | None = None) -> None:
    """Aggregate the CSV files that have come since the last run and append their partials, a folder for each batch."""

    def add(batch: DataFrame, number: int) -> None:
        partial(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("header", True).option("encoding", charset(encoding)).csv(pattern)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_hourly(spark: SparkSession, folder: str, schema: T.StructType, out: str, checkpoint: str, time: str, key: str, value: str, files: str = "*.parquet") -> None:
    """Hourly figures of the Parquet files that have come so far, kept in the query's state; each run takes new files and writes all figures anew."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)
    figures = stream.groupBy(F.window(time, "1 hour").alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    figures = figures.select(F.col("w.start").alias("hour"), key, "n", "total", "mean")
    writer = figures.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def hourly_by_event_time(events: DataFrame, time: str, key: str, value: str, late: str = "1 hour") -> DataFrame:
    """Hourly sums and means by event time; rows later than the watermark are passed over (works on a stream and on a table)."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select(F.col("w.start").alias("hour"), key, "n", "total", "mean")
