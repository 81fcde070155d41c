"""Statistics of a column: exact, NULL-aware, weighted where a weight is given."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.cleaning import col, ratio
from terrane.functions.ranking import average_ranks, running_total


def quantile(value: Column | str, q: float) -> Column:
    """Aggregate: exact, linear between neighbours. It holds a group's distinct values in one buffer, so it is for groups that are known to be small; else quantiles()."""
    return F.percentile(col(value), F.lit(q))


#: Relative rank error of the sketches that bracket a quantile.
SKETCH = 10_000


def quantiles(df: DataFrame, wanted: Mapping[str, tuple[Column | str, float]], by: Sequence[str] = ()) -> DataFrame:
    """(by, names): exact quantiles, linear between neighbours, of a row for each group (one row without `by`); NULL where there are no values.

    A sketch of bounded size brackets each quantile. A second pass counts what
    lies below and above, and the distinct values within the bracket, a few
    ten-thousandths of all; only those are sorted. No task holds a column.
    """
    by, places = list(by), range(len(wanted))
    base = df.select(*by, *(col(v).cast("double").alias(f"_x{k}") for k, (v, _) in enumerate(wanted.values())))
    margin = 2.0 / SKETCH
    near = base.groupBy(*by).agg(*(
        F.percentile_approx(f"_x{k}", [max(q - margin, 0.0), min(q + margin, 1.0)], SKETCH).alias(f"_b{k}") for k, (_, q) in enumerate(wanted.values())
    ))
    joined = base.crossJoin(F.broadcast(near)) if not by else base.alias("x").join(near.alias("n"), [F.col(f"x.{c}").eqNullSafe(F.col(f"n.{c}")) for c in by]).select(*(f"x.{c}" for c in by), *(f"_{s}{k}" for s in "xb" for k in places))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("_m"), F.col(f"_x{k}").alias("_x"), F.col(f"_b{k}")[0].alias("_a"), F.col(f"_b{k}")[1].alias("_c")) for k in places)))
    long = joined.select(*by, each.alias("_e")).select(*by, "_e.*").where("_x is not null")
    zone = F.when(F.col("_x") < F.col("_a"), 0).when(F.col("_x") > F.col("_c"), 2).otherwise(1)
    long = long.select(*by, "_m", "_x", zone.alias("_zone")).withColumn("_v", F.when(F.col("_zone") == 1, F.col("_x")))
    counts = long.groupBy(*by, "_m", "_zone", "_v").agg(F.count("*").alias("_n"), F.max("_x").alias("_most"), F.min("_x").alias("_least"))
    group = Window.partitionBy(*by, "_m")
    before = F.coalesce(F.sum("_n").over(group.orderBy("_zone", "_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumns({"_before": before, "_total": F.sum("_n").over(group)})
    # of the values below the bracket only the greatest is known, of those above the least: a neighbour is never further out
    value = F.when(F.col("_zone") == 0, F.col("_most")).otherwise(F.col("_least"))
    last = F.col("_before") + F.col("_n") - 1
    low, high = F.when(F.col("_zone") == 0, last).otherwise(F.col("_before")), F.when(F.col("_zone") == 2, F.col("_before")).otherwise(last)
    picks = []
    for k, (_, q) in enumerate(wanted.values()):
        at = F.floor(F.lit(q) * (F.col("_total") - 1))
        own = F.col("_m") == k
        for n, place in enumerate((at, F.least(at + 1, F.col("_total") - 1))):
            picks.append(F.max(F.when(own & place.between(low, high), value)).alias(f"_{'lh'[n]}{k}"))
        picks.append(F.max(F.when(own, F.lit(q) * (F.col("_total") - 1) - at)).alias(f"_f{k}"))
    found = placed.groupBy(*by).agg(*picks)
    names = [(F.col(f"_l{k}") + F.col(f"_f{k}") * (F.col(f"_h{k}") - F.col(f"_l{k}"))).alias(n) for k, n in enumerate(wanted)]
    return found.select(*by, *names)


def quantile_values(df: DataFrame, wanted: Mapping[str, tuple[Column | str, float]]) -> tuple:
    """The same over a whole table, as figures."""
    return tuple(quantiles(df, wanted).first())


def weighted_mean(value: Column | str, weight: Column | str | None = None) -> Column:
    """Aggregate over rows where both are there; NULL where weights sum to 0."""
    if weight is None:
        return F.avg(col(value))
    both = col(value).isNotNull() & col(weight).isNotNull()
    return ratio(F.sum(F.when(both, col(value) * col(weight))), F.sum(F.when(both, col(weight))))


def positive_weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Aggregate over rows with a weight over 0."""
    some = F.when(col(value).isNotNull() & (col(weight) > 0), col(weight))
    return ratio(F.sum(col(value) * some), F.sum(some))


def score_stats(df: DataFrame, value: Column | str) -> DataFrame:
    """One row: min, median, max, mean."""
    sums = df.agg(F.min(col(value)).alias("min"), F.max(col(value)).alias("max"), F.avg(col(value)).alias("mean"))
    return sums.crossJoin(F.broadcast(quantiles(df, {"median": (value, 0.5)}))).select("min", "median", "max", "mean")  # one row each


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per column: n, min, median, mean, max, sample deviation and quantiles."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))).alias("e")).select("e.*")
    sums = long.groupBy("column").agg(F.count("x").alias("n"), F.min("x").alias("min"), F.avg("x").alias("mean"), F.max("x").alias("max"), F.stddev_samp("x").alias("std"))
    parts = {"median": 0.5, "p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9}
    found = sums.join(quantiles(long, {n: ("x", q) for n, q in parts.items()}, ["column"]), "column", "left")
    return found.select("column", "n", "min", "median", "mean", "max", "std", "p10", "p25", "p75", "p90")


def _pairs(df: DataFrame, value: str, weight: str | None) -> DataFrame:
    """Distinct values with the sum of their weights (1 each without a weight)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.select(F.col(value).cast("double").alias("x"), w.alias("w")).where("x is not null and w is not null").groupBy("x").agg(F.sum("w").alias("w"))


def weighted_percentile(df: DataFrame, value: str, percent: float, weight: str | None = None) -> DataFrame:
    """One row: the least value up to which weights reach the share (a step function); without a weight, the linear quantile."""
    if weight is None:
        return quantiles(df, {"value": (value, percent / 100)})
    some = _pairs(df, value, weight)
    total = some.agg(F.sum("w")).first()[0]
    if not total or total <= 0:
        return df.sparkSession.createDataFrame([(None,)], "value double")
    return running_total(some, [F.col("x")], {"upto": F.col("w")}).where(F.col("upto") >= percent / 100 * total).agg(F.min("x").alias("value"))


def gini(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """One row: 1 - 2 * area under the Lorenz curve by trapezoids; 0 where values sum to 0, NULL where weights do."""
    some = _pairs(df, value, weight)
    sums = some.agg(F.sum("w").alias("w"), F.sum(F.col("x") * F.col("w")).alias("xw")).first()
    if not sums["w"]:
        return df.sparkSession.createDataFrame([(None,)], "value double")
    if not sums["xw"]:
        return df.sparkSession.createDataFrame([(0.0,)], "value double")
    placed = running_total(some, [F.col("x")], {"cw": F.col("w"), "cxw": F.col("x") * F.col("w")})
    # each step: its share of weight times the mean height of the curve over it
    area = F.sum((F.col("w") / sums["w"]) * (2 * F.col("cxw") - F.col("x") * F.col("w")) / (2 * sums["xw"]))
    return placed.agg((1 - 2 * area).alias("value"))


def theil(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """One row, over rows with value and weight over 0."""
    some = _pairs(df, value, weight).where("x > 0 and w > 0")
    mean = some.agg(weighted_mean("x", "w")).first()[0]
    if mean is None:
        return df.sparkSession.createDataFrame([(None,)], "value double")
    r = F.col("x") / mean
    return some.agg(ratio(F.sum(F.col("w") * r * F.log(r)), F.sum("w")).alias("value"))


def inequality(df: DataFrame, pairs: Mapping[str, tuple[str, str]], percent: float) -> dict[str, dict[str, float | None]]:
    """For every pair (value, weight) the weighted percentile, Gini and Theil, as the functions above give them, with one running total for all.

    Pairs are numbered and placed one after another; what comes before a pair is taken off its sums.
    """
    names = list(pairs)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("m"), F.col(v).cast("double").alias("x"), F.col(w).cast("double").alias("w")) for k, (v, w) in enumerate(pairs.values()))))
    some = df.select(each.alias("e")).select("e.*").where("x is not null and w is not null").groupBy("m", "x").agg(F.sum("w").alias("w"))
    placed = running_total(some, [F.col("m"), F.col("x")], {"cw": F.col("w"), "cxw": F.col("x") * F.col("w")})
    x, w = F.col("x"), F.col("w")
    positive = (x > 0) & (w > 0)
    sums = placed.groupBy("m").agg(
        F.sum(w).alias("sw"), F.sum(x * w).alias("sxw"), F.sum(F.when(positive, w)).alias("pw"), F.sum(F.when(positive, x * w)).alias("pxw"), F.sum(F.when(positive, w * x * F.log(x))).alias("plog")
    )  # a row for each pair
    before = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"bw": F.coalesce(F.sum("sw").over(before), F.lit(0.0)), "bxw": F.coalesce(F.sum("sxw").over(before), F.lit(0.0))})
    met = placed.join(F.broadcast(sums), "m")
    area = F.sum((w / F.col("sw")) * (2 * (F.col("cxw") - F.col("bxw")) - x * w) / (2 * F.col("sxw")))
    found = met.groupBy("m").agg(
        F.min(F.when(F.col("cw") - F.col("bw") >= percent / 100 * F.col("sw"), x)).alias("percentile"), (1 - 2 * area).alias("gini"),
        *(F.first(c).alias(c) for c in ("sw", "sxw", "pw", "pxw", "plog")),
    )
    out = {n: {"percentile": None, "gini": None, "theil": None} for n in names}
    for r in found.collect():  # a row for each pair
        own = out[names[r["m"]]]
        if r["sw"] and r["sw"] > 0:
            own["percentile"] = r["percentile"]
        if r["sw"]:
            own["gini"] = r["gini"] if r["sxw"] else 0.0
        if r["pw"]:
            # the mean of r ln r for r = x / mean
            own["theil"] = r["plog"] / r["pxw"] - math.log(r["pxw"] / r["pw"])
    return out


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Pearson of average ranks; each column is ranked over its own values, rows with both count."""
    ranked = average_ranks(df.select(a, b), {a: "_ra", b: "_rb"})
    return ranked.where("_ra is not null and _rb is not null").agg(F.corr("_ra", "_rb").alias("value"))


def jaccard(a: Column | str, b: Column | str, empty: float | None = None) -> Column:
    """Aggregate of two flags: both over either; `empty` where no row has one (NULL for sets, 1.0 for masks)."""
    x, y = (F.coalesce(col(c), F.lit(False)) for c in (a, b))
    return F.coalesce(ratio(F.count_if(x & y), F.count_if(x | y)), F.lit(empty).cast("double"))


def dropped_share(base: Column | str, other: Column | str) -> Column:
    """Aggregate: flagged rows of the base that the other lost, over those of the base."""
    x, y = (F.coalesce(col(c), F.lit(False)) for c in (base, other))
    return ratio(F.count_if(x & ~y), F.count_if(x))


def flagged_reduction(base: Column | str, other: Column | str, weight: Column | str | None = None) -> Column:
    """Aggregate: (weight flagged in base - in other) / in base; rows count 1 without a weight."""
    w = F.lit(1.0) if weight is None else F.coalesce(col(weight).cast("double"), F.lit(0.0))
    total = lambda flag: F.sum(F.when(F.coalesce(col(flag), F.lit(False)), w).otherwise(0.0))
    return ratio(total(base) - total(other), total(base))


def reduction(base: float | None, other: float | None) -> float | None:
    """(base - other) / base of two figures."""
    return None if base is None or other is None or base == 0 else (base - other) / base
