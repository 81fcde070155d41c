"""Quality reports: contracts, coordinates, ranges, stage figures, ledgers, hashes of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import stats
from terrane.functions.cleaning import in_box, number

#: Required columns of each source.
CONTRACTS: dict[str, tuple[str, ...]] = {
    "walking_edges": ("u", "v", "key", "osmid", "highway", "length_m", "elev_u_m", "elev_v_m", "elevation_diff_m", "grade_percent", "grade_abs_percent", "slope_available", "geometry_wkt"),
    "walking_nodes": ("node_id", "x", "y", "elevation_copernicus_m", "elevation_google_m", "geometry_wkt"),
    "bus_ridership": ("사용년월", "표준버스정류장ID", "버스정류장ARS번호", "역명", "hour", "ride_type", "passengers", "route_count", "lon", "lat", "coord_valid", "location_matched"),
    "subway_ridership": ("사용월", "호선명", "지하철역", "hour", "ride_type", "passengers", "lon", "lat", "location_matched"),
    "asos_weather": ("지점", "지점명", "일시", "기온(°C)", "강수량(mm)", "풍속(m/s)", "습도(%)", "적설(cm)"),
    "local_resident_250m": ("일자", "시간", "행정동코드", "250M격자", "생활인구합계"),
    "poi": ("lon", "lat"),
}


def contract_issues(df: DataFrame, contract: str) -> list[str]:
    """Required columns that the table lacks."""
    return [c for c in CONTRACTS[contract] if c not in df.columns]


def coordinate_issues(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One row: rows, coordinates that are no numbers, and those outside the box."""
    bad = number(lon).isNull() | number(lat).isNull()
    return df.agg(F.count("*").alias("rows"), F.count_if(bad).alias("invalid"), F.count_if(~bad & ~in_box(lon, lat)).alias("out_of_bounds"))


def range_issues(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """A row per column: values that are no numbers, below and above the range; missing and empty values don't count."""
    parts = []
    for name, (low, high) in ranges.items():
        there = F.col(name).isNotNull() & (F.trim(F.col(name).cast("string")) != "")
        x = number(name)
        parts += [F.count_if(there & x.isNull()).alias(f"{name}|not_a_number"), F.count_if(x < low if low is not None else F.lit(False)).alias(f"{name}|below"), F.count_if(x > high if high is not None else F.lit(False)).alias(f"{name}|above")]
    row = df.agg(*parts)
    return row.select(F.explode(F.array(*(
        F.struct(F.lit(n).alias("column"), *(F.col(f"`{n}|{k}`").alias(k) for k in ("not_a_number", "below", "above"))) for n in ranges
    ))).alias("r")).select("r.*")


def stage_figures(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per column: n, sum, mean, min, max, 90th percentile, values that are not 0."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))).alias("e")).select("e.*")
    sums = long.groupBy("column").agg(
        F.count("x").alias("n"), F.sum("x").alias("sum"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"), F.count_if(F.col("x") != 0).alias("nonzero")
    )
    found = sums.join(stats.quantiles(long, {"p90": ("x", 0.9)}, ["column"]), "column", "left")
    return found.select("column", "n", "sum", "mean", "min", "max", "p90", "nonzero")


def described(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per column with the figures of stats.describe()."""
    return stats.describe(df, columns)


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key stands more than once."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return df.join(counts.drop("_n"), list(keys), "left_semi")


def ledger(stages: Sequence[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """Rows in, out and lost of each stage (name, before, after)."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = None
    for order, (name, before, after) in enumerate(stages):
        row = count(before, "input_rows").crossJoin(F.broadcast(count(after, "output_rows"))).select(F.lit(order).alias("stage_order"), F.lit(name).alias("stage"), "input_rows", "output_rows")
        out = row if out is None else out.union(row)
    return out.withColumn("lost_rows", F.col("input_rows") - F.col("output_rows"))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Values by frequency, then value; a limit makes it a top-k report."""
    out = df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column)
    return out if top is None else out.limit(top)


def label_counts(df: DataFrame, column: str, separator: str = ", ") -> DataFrame:
    """How many rows carry each of the joined labels."""
    return value_counts(df.select(F.explode(F.array_distinct(F.split(column, separator))).alias("label")).where("label != ''"), "label")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, as often."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def table_hash(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: SHA-256 of row count, and of sum and xor of parts of the rows' SHA-256; the same for any order of rows and partitions.

    A row's text is its values, NULL as a mark of its own, joined by the unit separator.
    """
    values = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (columns or sorted(df.columns))]
    row = F.sha2(F.concat_ws("\x1f", *values), 256)
    part = lambda at: F.conv(F.substring(row, at, 15), 16, 10).cast("long")
    sums = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(part(1)), F.lit(0)).alias("x"), F.coalesce(F.sum(part(16).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("s"))
    return sums.select(F.sha2(F.concat_ws("|", "n", "x", "s"), 256).alias("table_hash"))


def upper_bound(df: DataFrame, column: str, q: float = 0.995) -> DataFrame:
    """One row: the quantile up to which a figure's axis goes."""
    return stats.quantiles(df, {"bound": (column, q)})


def sorted_bars(df: DataFrame, group: str, value: str, top: int | None = None) -> DataFrame:
    """Sums by group, the largest first (ties by name), with their place; a limit makes it a top-k report."""
    sums = df.groupBy(group).agg(F.sum(value).alias("total"))
    out = sums.orderBy(F.desc_nulls_last("total"), group)
    out = out if top is None else out.limit(top)
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("total"), group)))  # a row for each group


def heat_table(df: DataFrame, rows: str, columns: str, values: Sequence[int], flag: str) -> DataFrame:
    """Pivot of flagged counts."""
    return df.groupBy(rows).pivot(columns, list(values)).agg(F.count_if(flag)).fillna(0)


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key: the least by the order (must be total); pre-aggregated, no window."""
    rest = [c for c in df.columns if c not in (key, *order)]
    return df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_f")).select(key, "_f.*").select(*df.columns)


def share_over(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Rows with the value's share of its key's sum."""
    return df.withColumn(out, F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(key))))
