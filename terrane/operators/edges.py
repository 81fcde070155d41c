"""Street edges: validity, costs by model, parameter variants, and node figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import costs, senior
from terrane.functions.cleaning import number


def with_costs(edges: DataFrame, rain_mm: float = 0.0, snow_cm: float = 0.0, p: costs.CostParameters = costs.DEFAULTS, length: str = "length_m", grade: str = "grade_abs_percent") -> DataFrame:
    """Usable edges (length known, grade known and within the limit) with cost_m0..cost_m3; raw columns stay as they are."""
    intensity = costs.weather_intensity(F.lit(rain_mm), F.lit(snow_cm), p)
    usable = edges.where(number(length).isNotNull() & costs.sane_grade(grade, p).isNotNull())
    return usable.withColumns({f"cost_{m}": build(length, grade, intensity, p) for m, build in costs.MODELS.items()})


def sample_costs(edges: DataFrame, rows: int, **kwargs) -> DataFrame:
    """The same over the first rows only."""
    return with_costs(edges.limit(rows), **kwargs)


def variant_costs(edges: DataFrame, variants: DataFrame, p: costs.CostParameters = costs.DEFAULTS, length: str = "length_m", grade: str = "grade_abs_percent") -> DataFrame:
    """Edges times a table of (variant, cap, beta_weather, interaction_beta, intensity): cost_m3 under each variant.

    The variants are a handful of rows that the caller states, so they are broadcast.
    """
    capped = F.least(F.abs(number(grade)), F.col("cap"))
    weather = 1.0 + F.col("beta_weather") * F.col("intensity") + F.col("interaction_beta") * F.col("intensity") * capped / 100.0
    usable = edges.where(number(length).isNotNull() & costs.sane_grade(grade, p).isNotNull())
    return usable.crossJoin(F.broadcast(variants)).withColumn("cost_m3", number(length) * (1.0 + p.alpha * capped) * weather)


def variant_columns(edges: DataFrame, variants: DataFrame, p: costs.CostParameters = costs.DEFAULTS, length: str = "length_m", grade: str = "grade_abs_percent") -> tuple[DataFrame, dict[str, str]]:
    """Usable edges once, with a cost_m3 column for each variant, and the variants by column: for routing, which takes all weights of an edge at once."""
    usable = edges.where(number(length).isNotNull() & costs.sane_grade(grade, p).isNotNull()).withColumns({"_length": number(length), "_grade": F.abs(number(grade))})
    named, made = {}, {}
    for k, v in enumerate(variants.orderBy("variant").collect()):
        capped = F.least("_grade", F.lit(v.cap))
        weather = 1.0 + F.lit(v.beta_weather) * F.lit(v.intensity) + F.lit(v.interaction_beta) * F.lit(v.intensity) * capped / 100.0
        named[f"cost_v{k}"], made[f"cost_v{k}"] = v.variant, F.col("_length") * (1.0 + p.alpha * capped) * weather
    return usable.withColumns(made).drop("_length", "_grade"), named


def senior_minutes(edges: DataFrame, policies: Sequence[str] = tuple(senior.STEPS), length: str = "length_m", signed: str = "grade_percent", absolute: str = "grade_abs_percent", highway: str = "highway") -> DataFrame:
    """Columns minutes_<policy> in dry weather; NULL where steps are a barrier."""
    return edges.withColumns({f"minutes_{x}": senior.edge_minutes(length, signed, highway, policy=x, absolute_grade=absolute) for x in policies})


def graph_edges(edges: DataFrame, weights: Sequence[str], u: str = "u", v: str = "v") -> DataFrame:
    """Directed edges (u, v, weights): parallel ones collapse to the least weight, missing and negative weights don't count."""
    valid = lambda w: F.min(F.when(number(w) >= 0, number(w))).alias(w)
    ends = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"), *weights).where("u is not null and v is not null")
    return ends.groupBy("u", "v").agg(*(valid(w) for w in weights)).where(F.coalesce(*weights).isNotNull())


def slope_class(grade: Column | str) -> Column:
    """Quality class of a raw grade."""
    size = F.abs(number(grade))
    return F.when(size.isNull(), "slope_unavailable").when(size > 100, "over_100").when(size > 30, "capped_30_100").otherwise("usable")


def slope_classes(edges: DataFrame, length: str = "length_m", grade: str = "grade_abs_percent") -> DataFrame:
    """Edges, and those without a positive length, by class."""
    return edges.groupBy(slope_class(grade).alias("slope_class")).agg(F.count("*").alias("edges"), F.count_if(F.coalesce(number(length) <= 0, F.lit(True))).alias("without_length"))


def node_steepness(edges: DataFrame, grade: str = "grade_abs_percent") -> DataFrame:
    """Mean grade over the edges that a node is an end of."""
    ends = edges.select(F.col("u").alias("node"), number(grade).alias("g")).union(edges.select("v", number(grade)))
    return ends.where("node is not null").groupBy("node").agg(F.avg("g").alias("steepness"))
