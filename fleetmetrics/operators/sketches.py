"""Percentiles of long spans from summaries that are stored with the buckets and merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetmetrics.functions.times import floor_ts

COLUMNS = ["series_id", "resolution", "bucket_ts", "value_count", "sketch"]


def sketch_rollup(samples: DataFrame, resolution: str = "1h", k: int = 800) -> DataFrame:
    """(series_id, resolution, bucket_ts, value_count, sketch): a KLL summary of the values of each series and bucket.

    NaN has no rank and is left out; a bucket without any other value has no row. A summary of up to k values keeps them all; its rank
    error is about 2.3 / k of the values otherwise, 0.3 % for k = 800, with 99 % confidence, also after merging.
    """
    rows = samples.where(F.col("value").isNotNull() & ~F.isnan("value")).select("series_id", F.lit(resolution).alias("resolution"), floor_ts(F.col("ts"), resolution).alias("bucket_ts"), "value")
    return rows.groupBy("series_id", "resolution", "bucket_ts").agg(F.count("*").alias("value_count"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch")).select(*COLUMNS)


def _merged(k: int | None = None) -> Column:
    return F.kll_merge_agg_double("sketch") if k is None else F.kll_merge_agg_double("sketch", F.lit(k))


def merge_sketches(sketches: DataFrame, to_res: str, k: int = 800) -> DataFrame:
    """Summaries of coarser buckets from finer ones."""
    coarse = sketches.withColumn("resolution", F.lit(to_res)).withColumn("bucket_ts", floor_ts(F.col("bucket_ts"), to_res))
    return coarse.groupBy("series_id", "resolution", "bucket_ts").agg(F.sum("value_count").alias("value_count"), _merged(k).alias("sketch")).select(*COLUMNS)


def percentile_from_sketches(sketches: DataFrame, series: DataFrame, from_ts, to_ts, q: float, keys: Sequence[str] = ("org_id", "metric"), k: int = 800) -> DataFrame:
    """(keys, value): nearest rank of all values of the buckets that begin in [from_ts, to_ts), within the summaries' rank error; q is cut to 0..1.

    Summaries are merged in the tasks before they are shuffled, so a key costs a summary a task, however many buckets it has.
    """
    host = F.coalesce(F.try_element_at("tags", F.lit("host")), F.lit("")).alias("host")
    rows = sketches.where((F.col("bucket_ts") >= F.lit(from_ts)) & (F.col("bucket_ts") < F.lit(to_ts)))
    rows = rows.join(series.select("series_id", "org_id", "metric", host), "series_id")
    merged = rows.groupBy(*keys).agg(_merged(k).alias("sketch"))
    return merged.select(*keys, F.kll_sketch_get_quantile_double("sketch", F.lit(min(max(float(q), 0.0), 1.0))).alias("value"))
