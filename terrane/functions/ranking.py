"""Ranks over a whole table without gathering it in one task.

Equal values are counted first. The distinct values are range-partitioned, each
partition is summed up, and its rows are placed after those of the partitions
before it; only one row for each partition meets in a single task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.store import cut


def running_total(df: DataFrame, order: Sequence[Column], values: dict[str, Column]) -> DataFrame:
    """Add columns name -> sum of the value over all rows before and including this one, by the order (must be total)."""
    names = list(values)
    keyed = df.withColumns({f"_v_{n}": v.cast("double") for n, v in values.items()} | {f"_o_{k}": o for k, o in enumerate(order)})
    order = [F.col(f"_o_{k}") for k in range(len(order))]
    # the partition of a row must not change between its two uses, so it is fixed by sampled bounds once
    parted = cut(keyed.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parted.groupBy("_part").agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names))
    sums = sums.select("_part", *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0.0)).alias(f"_b_{n}") for n in names))
    out = parted.withColumns({n: F.coalesce(F.sum(f"_v_{n}").over(within), F.lit(0.0)) for n in names}).join(F.broadcast(sums), "_part")
    return out.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in names}).select(*df.columns, *names)


def average_ranks(df: DataFrame, ranks: Mapping[str, str], descending: bool = False) -> DataFrame:
    """Add ranks (column: name) from 1, the mean of the places of equal values; NULL stays NULL.

    The distinct values of all columns are counted and placed in one pass; ranks
    come back by joins on the value, whose large keys Spark may deal out to
    several tasks (the ranked values are a written table).
    """
    sign = -1 if descending else 1  # a descending order ranks the negated value, as partitions are dealt out by one direction
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("_m"), (sign * F.col(c)).cast("double").alias("_x")) for k, c in enumerate(ranks))))
    counts = df.select(each.alias("_e")).select("_e.*").where("_x is not null").groupBy("_m", "_x").agg(F.count("*").alias("_tied"))
    placed = running_total(counts, [F.col("_m"), F.col("_x")], {"_upto": F.col("_tied")})
    sizes = placed.groupBy("_m").agg(F.sum("_tied").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each column
    placed = placed.join(F.broadcast(sizes.select("_m", earlier.alias("_earlier"))), "_m")
    placed = cut(placed.select("_m", "_x", (F.col("_upto") - F.col("_earlier") - (F.col("_tied") - 1) / 2).alias("_rank")))
    for k, (value, out) in enumerate(ranks.items()):
        own = placed.where(F.col("_m") == k).select(F.col("_x").alias("_key"), F.col("_rank").alias(out))
        df = df.join(own, (sign * F.col(value)).cast("double") == F.col("_key"), "left").drop("_key")
    return df


def average_rank(df: DataFrame, value: str, out: str, descending: bool = False) -> DataFrame:
    """The same for one column."""
    return average_ranks(df, {value: out}, descending)


def percent_ranks(df: DataFrame, ranks: Mapping[str, str]) -> DataFrame:
    """Add average ranks (column: name) over the number of values that are there."""
    counts = df.agg(*(F.count(c) for c in ranks)).first()
    ranked = average_ranks(df, ranks)
    return ranked.withColumns({out: F.col(out) / float(n) for out, n in zip(ranks.values(), counts, strict=True) if n})


def percent_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """The same for one column."""
    return percent_ranks(df, {value: out})


def quantile_bucket(df: DataFrame, value: str, key: str, out: str, k: int = 4) -> DataFrame:
    """Add buckets 1..k of equal frequency by rank (of equal values the lower key first); NULL stays NULL."""
    some = df.where(F.col(value).isNotNull()).select(F.col(key).alias("_key"), F.col(value).alias("_x"))
    n = some.count()
    if not n:
        return df.withColumn(out, F.lit(None).cast("int"))
    placed = running_total(some, [F.col("_x"), F.col("_key")], {"_place": F.lit(1)})
    bucket = F.greatest(F.lit(1), F.ceil((F.col("_place") - 1) * k / max(n - 1, 1))).cast("int")
    return df.join(placed.select("_key", bucket.alias(out)), F.col(key) == F.col("_key"), "left").drop("_key")
