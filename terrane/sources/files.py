"""CSV, Parquet and JSON sources and sinks; head-n samples; a guard before anything is gathered on the driver."""

from __future__ import annotations

import codecs
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Larger inputs are not gathered on the driver unless forced.
EAGER_BYTES = 100 << 20


class LargeInputError(RuntimeError):
    pass


def charset(encoding: str | None) -> str:
    """UTF-8 by its usual names, others as they are (cp949 needs spark.sql.legacy.javaCharsets)."""
    name = (encoding or "utf-8").lower()
    return "UTF-8" if name in ("utf-8", "utf8", "utf-8-sig") else {"cp949": "x-windows-949", "euc-kr": "EUC-KR"}.get(name, encoding)


def scan_csv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, encoding: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """Lazy scan of one or many CSV files with a header; values that don't parse are NULL. Without a schema all columns are text."""
    reader = spark.read.option("header", True).option("encoding", charset(encoding)).option("mode", "PERMISSIVE")
    df = (reader.schema(schema) if schema is not None else reader).csv(path if isinstance(path, str) else list(path))
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


def _files(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """Paths and sizes that a pattern matches, sorted, in any file system that Spark knows."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted((x.getPath().toString(), x.getLen()) for x in found or [])


def sample_csv(spark: SparkSession, pattern: str, rows: int = 1000, **options) -> DataFrame:
    """First rows of the first file that matches."""
    found = _files(spark, pattern)
    if not found:
        raise FileNotFoundError(pattern)
    return scan_csv(spark, found[0][0], **options).limit(rows)


def eager_csv(spark: SparkSession, path: str, most_bytes: int = EAGER_BYTES, force: bool = False, **options):
    """The whole file as a pandas frame on the driver; LargeInputError beyond the limit unless forced."""
    size = sum(n for _, n in _files(spark, path))
    if size > most_bytes and not force:
        raise LargeInputError(f"{path}: {size} bytes, limit {most_bytes}")
    return scan_csv(spark, path, **options).toPandas()


def probe_csv(spark: SparkSession, path: str, encoding: str | None = None, rows: int = 50) -> dict[str, str]:
    """Names and types as guessed from the first rows."""
    lines = spark.read.option("encoding", charset(encoding)).text(path).limit(rows + 1)
    guessed = spark.read.option("header", True).option("inferSchema", True).csv(lines.rdd.map(lambda r: r[0]))
    return dict(guessed.dtypes)


def network_nodes(spark: SparkSession, path: str) -> DataFrame:
    """node_id, x, y of rows where all three are numbers."""
    from terrane.functions.cleaning import number, whole

    return scan_csv(spark, path, ["node_id", "x", "y"]).select(whole("node_id").alias("node_id"), number("x").alias("x"), number("y").alias("y")).dropna()


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


def write_parquet(df: DataFrame, path: str) -> int:
    """Write without a geometry column; the number of rows, counted as they pass."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation("rows")
    df.drop("geometry").observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return seen.get["n"]


def write_csv_bom(df: DataFrame, path: str) -> None:
    """One UTF-8 file with a byte order mark, for reports: rows are passed on one partition at a time."""
    with open(path, "wb") as out:
        out.write(codecs.BOM_UTF8)
        import csv
        import io

        text = io.TextIOWrapper(out, encoding="utf-8", newline="")
        writer = csv.writer(text)
        writer.writerow(df.columns)
        for row in df.toLocalIterator():
            writer.writerow(["" if x is None else x for x in row])
        text.flush()
        text.detach()


def read_report(path: str) -> dict:
    """A JSON report; {} where there is none."""
    file = Path(path)
    return json.loads(file.read_text(encoding="utf-8")) if file.exists() else {}


def write_report(report: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, ensure_ascii=False, indent=2, default=str), encoding="utf-8")


def report_of(df: DataFrame) -> dict:
    """A one-row frame as a report."""
    return df.first().asDict(recursive=True)


def markdown_table(df: DataFrame, rows: int = 100) -> str:
    """First rows as a Markdown table, for reports."""
    text = lambda x: "" if x is None else str(x).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(text, r)) + " |" for r in df.limit(rows).collect()])
