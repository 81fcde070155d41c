"""Normalisation: three min-max rules, fitted parameters, and variants."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.cleaning import col
from terrane.functions.stats import quantile_values


@dataclass(frozen=True)
class Fitted:
    """Limits of a column on the baseline; scenario values may leave 0..1."""

    low: float | None
    high: float | None

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Fitted:
        return cls.of_all(df, column)[0]

    @classmethod
    def of_all(cls, df: DataFrame, *columns: Column | str) -> tuple[Fitted, ...]:
        """The limits of several columns in one pass."""
        row = df.agg(*(f(col(c)).cast("double") for c in columns for f in (F.min, F.max))).first()
        return tuple(cls(*row[2 * k : 2 * k + 2]) for k in range(len(columns)))

    def apply(self, value: Column | str) -> Column:
        """Missing stays NULL; a constant baseline gives 0."""
        c = col(value).cast("double")
        if self.low is None:
            return F.lit(None).cast("double")
        if self.high == self.low:
            return F.when(c.isNotNull(), F.lit(0.0))
        return (c - self.low) / (self.high - self.low)


def scaled_all(df: DataFrame, columns: Mapping[str, Column | str], missing_as_zero: bool = False, constant: float | None = 0.0) -> DataFrame:
    """Add columns (name: source) with their sources min-max scaled over the table, all fitted in one pass.

    missing_as_zero: NULL counts as 0 (demand axes). constant: what a constant column gives (None: NULL).
    """
    values = [F.coalesce(col(c).cast("double"), F.lit(0.0)) if missing_as_zero else col(c).cast("double") for c in columns.values()]
    added = {}
    for name, value, fitted in zip(columns, values, Fitted.of_all(df, *values), strict=True):
        same = fitted.low is not None and fitted.low == fitted.high
        added[name] = F.when(value.isNotNull(), F.lit(constant).cast("double")) if same else fitted.apply(value)
    return df.withColumns(added)


def scaled(df: DataFrame, column: str, out: str, missing_as_zero: bool = False, constant: float | None = 0.0) -> DataFrame:
    """The same for one column."""
    return scaled_all(df, {out: column}, missing_as_zero, constant)


def winsorised(df: DataFrame, column: str, out: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values held within two quantiles."""
    a, b = quantile_values(df, {"a": (column, low), "b": (column, high)})
    return df.withColumn(out, F.when(F.col(column).isNotNull(), F.least(F.greatest(F.col(column), F.lit(a)), F.lit(b))))


def top_share(df: DataFrame, column: str, out: str, share: float) -> DataFrame:
    """Flag values at or over the quantile 1 - share; missing is false."""
    (limit,) = quantile_values(df, {"limit": (column, 1 - share)})
    return df.withColumn(out, F.coalesce(F.col(column) >= F.lit(limit), F.lit(False)))
