"""Which series had samples on a day, as bitmaps: small tables that are made once a day and asked instead of the facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Series a bitmap has room for; a bucket should have about as many.
BITS = 32_768


def numbered_series(series: DataFrame, known: DataFrame | None = None, buckets: int = 16) -> DataFrame:
    """(series_id, bucket, number): dense numbers from 1 in each of some buckets by hash; known numbers stay, new series get the next ones.

    buckets must stay as it was for known; about series / BITS of them fill one bitmap each.
    """
    ids = series.select("series_id").distinct()
    fresh = ids if known is None else ids.join(known.select("series_id"), "series_id", "left_anti")
    fresh = fresh.withColumn("bucket", F.pmod(F.xxhash64("series_id"), F.lit(buckets)).cast("int"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("series_id"))
    if known is None:
        return fresh.select("series_id", "bucket", place.cast("long").alias("number"))
    upto = known.groupBy("bucket").agg(F.max("number").alias("_most"))
    new = fresh.join(upto, "bucket", "left").select("series_id", "bucket", (place + F.coalesce("_most", F.lit(0))).alias("number"))
    return known.select("series_id", "bucket", "number").unionByName(new)


def live_days(rows: DataFrame, numbers: DataFrame, ts: str = "ts") -> DataFrame:
    """(day, bucket, page, live): a bitmap of the numbers of the series that rows (series_id and a time) have on each day; other series have no bit."""
    seen = rows.select("series_id", F.to_date(ts).alias("day")).distinct().join(numbers, "series_id")
    return seen.groupBy("day", "bucket", F.bitmap_bucket_number("number").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("live"))


def _has(live: Column, number: Column) -> Column:
    """Whether a bitmap has the bit of a number."""
    at = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring(live, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1


def orphans_by_day(series: DataFrame, numbers: DataFrame, *days: DataFrame) -> DataFrame:
    """Series that no bitmap of the given tables of live_days() has: what orphan_series() finds, without reading samples or rollups."""
    whole = days[0]
    for d in days[1:]:
        whole = whole.unionByName(d)
    merged = whole.groupBy("bucket", "page").agg(F.bitmap_or_agg("live").alias("live"))
    placed = series.join(numbers, "series_id").withColumn("page", F.bitmap_bucket_number("number"))
    return placed.join(merged, ["bucket", "page"], "left").where(F.col("live").isNull() | ~_has(F.col("live"), F.col("number"))).select(*series.columns)
