"""Rollups: mergeable buckets of stored samples."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetmetrics.functions.order import newest
from fleetmetrics.functions.times import duration_ms, floor_ts

COLUMNS = ["series_id", "resolution", "bucket_ts", "sample_count", "sum_value", "min_value", "max_value", "last_value"]
RESOLUTIONS = ("1m", "5m", "1h")


def _nan_or(pick: Column, value: str) -> Column:
    """pick, but NaN if any value is: Spark's min passes NaN over."""
    return F.when(F.bool_or(F.isnan(value)), F.lit(float("nan"))).otherwise(pick)


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("series_id", "resolution", "bucket_ts").agg(
        F.count("*").alias("sample_count"),
        F.sum("value").alias("sum_value"),
        _nan_or(F.min("value"), "value").alias("min_value"),
        _nan_or(F.max("value"), "value").alias("max_value"),
        F.max_by("value", newest()).alias("last_value"),
    ).select(*COLUMNS)


def rollup(samples: DataFrame, resolution: str) -> DataFrame:
    """Count, sum, min, max and last of each series and bucket; last is of the greatest ts, then seq. Every aggregate is partial, so a hot series costs no more."""
    return _bucketed(samples.withColumn("resolution", F.lit(resolution)).withColumn("bucket_ts", floor_ts(F.col("ts"), resolution)))


def rollup_all(samples: DataFrame, resolutions: Iterable[str] = RESOLUTIONS) -> DataFrame:
    """All resolutions in one pass over the samples: the finest from raw, the others from its buckets, whose width divides theirs.

    Resolutions that the finest doesn't divide are each made from raw.
    """
    finest = min(resolutions, key=duration_ms)
    even = [r for r in resolutions if duration_ms(r) % duration_ms(finest) == 0]
    fine = rollup(samples, finest)
    buckets = F.array(*[F.struct(F.lit(r).alias("resolution"), floor_ts(F.col("fine_ts"), r).alias("bucket_ts")) for r in even])
    out = _merged(fine.drop("resolution").withColumnRenamed("bucket_ts", "fine_ts").select("*", F.inline(buckets))) if len(even) > 1 else fine
    for r in resolutions:
        out = out if r in even else out.unionByName(rollup(samples, r))
    return out


def bucket_mean(rollups: DataFrame) -> DataFrame:
    """rollups with mean_value, 0 for an empty bucket."""
    return rollups.withColumn("mean_value", F.when(F.col("sample_count") == 0, 0.0).otherwise(F.col("sum_value") / F.nullif(F.col("sample_count"), F.lit(0))))


def merge_rollups(rollups: DataFrame, from_res: str, to_res: str) -> DataFrame:
    """Buckets of a coarser resolution from a finer one's; a mean stays true, as sums and counts are merged."""
    if duration_ms(to_res) % duration_ms(from_res):
        raise ValueError(f"{to_res} isn't a multiple of {from_res}")
    fine = rollups.where(F.col("resolution") == from_res).withColumnRenamed("bucket_ts", "fine_ts")
    return _merged(fine.withColumn("resolution", F.lit(to_res)).withColumn("bucket_ts", floor_ts(F.col("fine_ts"), to_res)))


def _merged(fine: DataFrame) -> DataFrame:
    """Buckets from finer ones, whose start is fine_ts."""
    return fine.groupBy("series_id", "resolution", "bucket_ts").agg(
        F.sum("sample_count").alias("sample_count"),
        F.sum("sum_value").alias("sum_value"),
        _nan_or(F.min("min_value"), "min_value").alias("min_value"),
        _nan_or(F.max("max_value"), "max_value").alias("max_value"),
        F.max_by("last_value", "fine_ts").alias("last_value"),
    ).select(*COLUMNS)


def replace_rollup_range(current: DataFrame, new: DataFrame, resolution: str, from_ts: datetime, cutoff: datetime) -> DataFrame:
    """current with the buckets of one resolution in [from_ts, cutoff) replaced by new's; running it again changes nothing."""
    inside = (F.col("resolution") == resolution) & (F.col("bucket_ts") >= F.lit(from_ts)) & (F.col("bucket_ts") < F.lit(cutoff))
    return current.where(~inside).select(*COLUMNS).unionByName(new.where(inside).select(*COLUMNS))


def floor_instant(t: datetime, resolution: str) -> datetime:
    step, epoch = timedelta(milliseconds=duration_ms(resolution)), datetime(1970, 1, 1, tzinfo=t.tzinfo)
    return epoch + (t - epoch) // step * step


def _instant(one: DataFrame) -> datetime | None:
    us = one.first()[0]
    return None if us is None else datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)


def rollup_incremental(samples: DataFrame, rollups: DataFrame, watermarks: DataFrame, resolution: str, now: datetime, lag_s: int = 30) -> tuple[DataFrame, DataFrame]:
    """(rollups, watermarks) after sealing the buckets that ended lag_s or more before now, an instant with a time zone.

    Starts at the watermark, or at the oldest sample without one. Nothing changes if no bucket can be sealed.
    """
    cutoff = floor_instant(now - timedelta(seconds=lag_s), resolution)
    start = _instant(watermarks.where(F.col("resolution") == resolution).agg(F.max(F.unix_micros("processed_to"))))
    if start is None:
        oldest = _instant(samples.agg(F.min(F.unix_micros("ts"))))
        start = floor_instant(oldest, resolution) if oldest is not None else None
    if start is None or start >= cutoff:
        return rollups, watermarks
    part = samples.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(cutoff)))
    out = replace_rollup_range(rollups, rollup(part, resolution), resolution, start, cutoff)
    moved = watermarks.sparkSession.createDataFrame([(resolution, cutoff)], "resolution string, processed_to timestamp")
    return out, watermarks.where(F.col("resolution") != resolution).unionByName(moved)


def reconcile_rollups(samples: DataFrame, rollups: DataFrame, resolution: str, tolerance: float = 1e-9) -> DataFrame:
    """Buckets whose count, sum, min or max isn't that of the raw samples, or that one side lacks; the tolerance for sums is relative."""
    names = ["sample_count", "sum_value", "min_value", "max_value"]
    raw = rollup(samples, resolution).select("series_id", "bucket_ts", *[F.col(c).alias(f"raw_{c}") for c in names])
    have = rollups.where(F.col("resolution") == resolution).select("series_id", "bucket_ts", *names)
    both = raw.join(have, ["series_id", "bucket_ts"], "full_outer")
    near = F.abs(F.col("sum_value") - F.col("raw_sum_value")) <= tolerance * F.greatest(F.lit(1.0), F.abs("raw_sum_value"))
    same = F.col("sum_value").eqNullSafe(F.col("raw_sum_value")) | F.coalesce(near, F.lit(False))
    for c in ("sample_count", "min_value", "max_value"):
        same = same & F.col(c).eqNullSafe(F.col(f"raw_{c}"))
    return both.where(~same)
