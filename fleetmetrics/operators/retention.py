"""Retention: what is too old goes, and with it the series that nothing names any more."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetmetrics.operators.series import orphan_series


def retention(samples: DataFrame, rollups: DataFrame, series: DataFrame, now: datetime, raw_days: int = 15, rollup_days: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, rollups, series) without samples before now - raw_days, buckets before now - rollup_days, and orphans.

    A row exactly at a limit stays. On a table stored by day the filter leaves whole days out of the scan.
    """
    raw, old = now - timedelta(days=raw_days), now - timedelta(days=rollup_days)
    kept = samples.where(F.col("ts") >= F.lit(raw))
    if "day" in samples.columns:
        kept = kept.where(F.col("day") >= F.to_date(F.lit(raw)))
    buckets = rollups.where(F.col("bucket_ts") >= F.lit(old))
    gone = orphan_series(series, kept, buckets).select("series_id")
    return kept, buckets, series.join(gone, "series_id", "left_anti").select(*series.columns)
