"""Tables between jobs, in the folder that the whole cluster shares; and a filter of fixed size before a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.store import run_dir, stored

__all__ = ["among", "dealt", "run_dir", "stored"]

#: Bits of the bitmap of among(); its size bounds the broadcast at 2 MB.
_BITS = 1 << 24


def among(rows: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """The rows whose key may be one of the keys: a bitmap of the keys' hashes (of a fixed size, broadcast) rules out most others before they are shuffled."""
    at = F.pmod(F.xxhash64(*names), F.lit(_BITS)) + 1
    bits = keys.select(at.alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias("_group")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_map"))
    marked = rows.withColumn("__bit", at).withColumn("__place", F.bitmap_bit_position("__bit"))
    byte = F.conv(F.hex(F.substring("_map", (F.col("__place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, (F.col("__place") % 8).cast("int")) == 1
    return marked.join(F.broadcast(bits), F.bitmap_bucket_number("__bit") == F.col("_group")).where(held).select(*rows.columns)


def dealt(rows: DataFrame, buckets: int, key: str = "bucket", most: int = 4) -> DataFrame:
    """Rows dealt out by bucket to so many partitions that one takes `most` buckets on average, where the session's number is too small for that."""
    wanted = -(-buckets // most)
    return rows.repartition(wanted, key) if wanted > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows
