"""Walking cost of a street edge: slope, weather, and their interaction."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions.cleaning import col, number


@dataclass(frozen=True)
class CostParameters:
    alpha: float = 0.03
    beta_weather: float = 0.03
    interaction_beta: float = 0.08
    snow_weight: float = 5.0
    grade_cap: float = 30.0
    #: A steeper grade is an error of measurement.
    grade_limit: float = 100.0
    walking_m_per_min: float = 67.0

    @classmethod
    def of(cls, values: Mapping[str, float]) -> CostParameters:
        """From a mapping; names that are no parameters are passed over."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: float(v) for k, v in values.items() if k in known})


DEFAULTS = CostParameters()


def sane_grade(grade: Column | str, p: CostParameters = DEFAULTS) -> Column:
    """Absolute grade in percent, NULL where missing or over the limit."""
    size = F.abs(number(grade))
    return F.when(size <= p.grade_limit, size)


def capped_grade(grade: Column | str, p: CostParameters = DEFAULTS) -> Column:
    size = F.abs(number(grade))
    return F.when(size.isNotNull(), F.least(size, F.lit(p.grade_cap)))


def slope_factor(grade: Column | str, p: CostParameters = DEFAULTS) -> Column:
    return 1.0 + p.alpha * capped_grade(grade, p)


def weather_intensity(rain_mm: Column | str, snow_cm: Column | str, p: CostParameters = DEFAULTS) -> Column:
    """Rain plus weighted snow; missing and negative count as none."""
    part = lambda x: F.greatest(F.coalesce(number(x), F.lit(0.0)), F.lit(0.0))
    return part(rain_mm) + p.snow_weight * part(snow_cm)


def weather_factor(intensity: Column, p: CostParameters = DEFAULTS) -> Column:
    return 1.0 + p.beta_weather * intensity


def interaction_factor(grade: Column | str, intensity: Column, p: CostParameters = DEFAULTS) -> Column:
    return 1.0 + p.beta_weather * intensity + p.interaction_beta * intensity * capped_grade(grade, p) / 100.0


def m0(length: Column | str, grade: Column | str, intensity: Column, p: CostParameters = DEFAULTS) -> Column:
    """Length alone."""
    return number(length)


def m1(length: Column | str, grade: Column | str, intensity: Column, p: CostParameters = DEFAULTS) -> Column:
    """Length and slope."""
    return number(length) * slope_factor(grade, p)


def m2(length: Column | str, grade: Column | str, intensity: Column, p: CostParameters = DEFAULTS) -> Column:
    """Length, slope, weather."""
    return m1(length, grade, intensity, p) * weather_factor(intensity, p)


def m3(length: Column | str, grade: Column | str, intensity: Column, p: CostParameters = DEFAULTS) -> Column:
    """Length, slope, weather that weighs more on slopes."""
    return m1(length, grade, intensity, p) * interaction_factor(grade, intensity, p)


MODELS: dict[str, Callable[..., Column]] = {"m0": m0, "m1": m1, "m2": m2, "m3": m3}


def cost(model: str, length: Column | str, grade: Column | str, intensity: Column, p: CostParameters = DEFAULTS) -> Column:
    """Cost by the model's name, in any case."""
    try:
        return MODELS[model.lower()](length, grade, intensity, p)
    except KeyError:
        raise ValueError(f"unknown cost model: {model}") from None


def minutes(metres: Column | str, p: CostParameters = DEFAULTS) -> Column:
    return col(metres) / p.walking_m_per_min


def friction(rain_mm: Column | str, snow_cm: Column | str, beta: float = 0.03, rain_weight: float = 1.0, snow_weight: float = 5.0, missing_factor: float = 1.0) -> Column:
    """Impedance factor of weather, not under missing_factor."""
    part = lambda x: F.coalesce(number(x), F.lit(0.0))
    return F.greatest(F.lit(missing_factor), 1.0 + beta * (rain_weight * part(rain_mm) + snow_weight * part(snow_cm)))
