"""Column clean-up: numbers, flags, names and codes. Missing is always NULL, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def number(value: Column | str) -> Column:
    """Double, or NULL where the value is no number or NaN."""
    cast = col(value).try_cast("double")
    return F.when(~F.isnan(cast), cast)


def whole(value: Column | str) -> Column:
    """Long from a number or its text ("1106081.0" included), NULL otherwise."""
    return number(value).try_cast("long")


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """NULL where the divisor is 0 or missing."""
    return F.try_divide(col(top).cast("double"), F.nullif(col(bottom).cast("double"), F.lit(0.0)))


def truthy(value: Column | str) -> Column:
    """true, 1, yes or y in any case; missing is false."""
    return F.coalesce(F.lower(F.trim(col(value).cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def in_box(lon: Column | str, lat: Column | str, box: tuple[float, float, float, float] = (126.70, 37.40, 127.25, 37.75)) -> Column:
    """Both inside the box (west, south, east, north), edges included; missing is false."""
    west, south, east, north = box
    return F.coalesce(number(lon).between(west, east) & number(lat).between(south, north), F.lit(False))


def first_existing(columns: Sequence[str], names: Sequence[str], kind: str = "string") -> Column:
    """First non-null of the named columns that the table has; typed NULL if it has none."""
    some = [F.col(f"`{n}`") for n in names if n in columns]
    return F.coalesce(*some) if some else F.lit(None).cast(kind)


def first_filled(columns: Sequence[str], names: Sequence[str]) -> Column:
    """First of the named columns whose text is neither NULL nor empty."""
    some = [F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names if n in columns]
    return F.coalesce(*some) if some else F.lit(None).cast("string")


def select_existing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{n}`") for n in names if n in df.columns])


def numeric_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC) and f.name not in without]


def fill_numeric(df: DataFrame, without: Sequence[str] = ("hex_id", "geometry")) -> DataFrame:
    """NULL to 0 in all numeric columns but the named."""
    names = numeric_columns(df, without)
    return df.fillna(0, subset=names) if names else df


def round_numeric(df: DataFrame, digits: int) -> DataFrame:
    """Floating columns rounded half to even."""
    return df.withColumns({f.name: F.bround(f.name, digits) for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))})


def require(df: DataFrame, names: Sequence[str]) -> None:
    """KeyError that lists the columns that are missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")


def rename_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in aliases.items() if a in df.columns and b not in df.columns})


def standard_name(value: Column | str) -> Column:
    """Without outer blanks, inner blanks and middle dots."""
    return F.translate(F.trim(col(value)), " ·ㆍ", "")


def dong_key(value: Column | str) -> Column:
    """Standard name without the ordinal mark before a number (제1동 as 1동)."""
    return F.regexp_replace(standard_name(value), "제(?=[0-9])", "")


def counted(value: Column | str) -> Column:
    """Whole number from text with thousands commas; "-" and blank are NULL."""
    text = F.trim(col(value).cast("string"))
    return F.when(~text.isin("-", ""), F.replace(text, F.lit(","), F.lit(""))).try_cast("double").try_cast("long")


def code(value: Column | str) -> Column:
    """Administrative code as text of a whole number; empty where missing."""
    return F.coalesce(whole(value).cast("string"), F.lit(""))


def joined_names(value: Column | str) -> Column:
    """Aggregate: distinct names in order, comma-joined."""
    return F.array_join(F.array_sort(F.collect_set(col(value))), ",")
