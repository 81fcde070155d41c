"""Walking time of older people: speed, signed slope, weather, steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions.cleaning import col, number

#: Speeds in m/s by profile; weather intensities, each adding 3 percent; factors of steps by policy (None: not passable).
SPEEDS = {"very_slow": 0.70, "slow": 0.80, "base": 0.90, "optimistic": 1.07}
INTENSITIES = {"dry": 0.0, "rain": 2.0, "snow": 8.0}
WEATHER = {profile: 1 + 0.03 * intensity for profile, intensity in INTENSITIES.items()}
STEPS = {"steps_allowed": 1.0, "steps_penalty": 3.0, "steps_barrier": None}
#: Upper grade (percent) and label of each band.
GRADE_BANDS = ((2.0, "near_flat"), (5.0, "mild"), (8.33, "ramp_like"), (12.0, "steep"))
STEEPEST_BAND = "very_steep"


def base_minutes(length: Column | str, speed: float = SPEEDS["base"]) -> Column:
    if speed <= 0:
        raise ValueError("speed must be positive")
    return number(length) / (speed * 60.0)


def slope_factor(signed_grade: Column | str, absolute_grade: Column | str | None = None) -> Column:
    """Tobler's function over that of level ground, never under 1; signed grade if known, within 30 percent."""
    grade = number(signed_grade)
    if absolute_grade is not None:
        grade = F.coalesce(grade, number(absolute_grade))
    slope = F.greatest(F.least(grade, F.lit(30.0)), F.lit(-30.0)) / 100.0
    return F.when(grade.isNotNull(), F.greatest(F.lit(1.0), F.exp(3.5 * (F.abs(slope + 0.05) - 0.05))))


def weather_factor(profile: str) -> Column:
    if profile not in WEATHER:
        raise ValueError(f"unknown weather profile: {profile}")
    return F.lit(WEATHER[profile])


def is_steps(highway: Column | str) -> Column:
    return F.coalesce(F.lower(col(highway).cast("string")).contains("steps"), F.lit(False))


def steps_factor(highway: Column | str, policy: str) -> Column:
    """1 on other ways; NULL where steps are a barrier."""
    if policy not in STEPS:
        raise ValueError(f"unknown steps policy: {policy}")
    return F.when(is_steps(highway), F.lit(STEPS[policy]).cast("double")).otherwise(F.lit(1.0))


def edge_minutes(length: Column | str, signed_grade: Column | str, highway: Column | str, weather: str = "dry", policy: str = "steps_allowed", speed: float = SPEEDS["base"], absolute_grade: Column | str | None = None) -> Column:
    """Minutes over an edge; NULL where steps are a barrier."""
    return base_minutes(length, speed) * slope_factor(signed_grade, absolute_grade) * weather_factor(weather) * steps_factor(highway, policy)


def rescaled(time: Column | str, profile: str, reference: str = "base") -> Column:
    """Time at another speed: walking time goes with 1 / speed, so nothing is routed anew."""
    return col(time) * (SPEEDS[reference] / SPEEDS[profile])


def grade_band(grade: Column | str) -> Column:
    """Label of the absolute grade's band, upper limits included; NULL where missing."""
    size = F.abs(number(grade))
    label = F.lit(STEEPEST_BAND)
    for limit, name in reversed(GRADE_BANDS):
        label = F.when(size <= limit, F.lit(name)).otherwise(label)
    return F.when(size.isNotNull(), label)
