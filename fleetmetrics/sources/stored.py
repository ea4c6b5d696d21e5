"""Rollups and retention of tables on disk: whole day partitions are written or dropped, and what is kept stays untouched."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetmetrics import schemas
from fleetmetrics.operators.rollup import COLUMNS, floor_instant, rollup


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    fs, p = _fs(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(p) else spark.createDataFrame([], schema)


def _replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Writes rows and so replaces the partitions that they are in, once all is written; other partitions stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


_ROLLUP = schemas.struct(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.ROLLUP.fields) + ", day date")


def stored_rollups(spark: SparkSession, path: str) -> DataFrame:
    """The buckets that seal_rollups has written below `path`, with their day."""
    return _read(spark, f"{path}/rollups", _ROLLUP)


def watermark(spark: SparkSession, path: str, resolution: str) -> datetime | None:
    """Up to where a resolution is sealed."""
    rows = _read(spark, f"{path}/watermarks", schemas.WATERMARK).where(F.col("resolution") == resolution)
    us = rows.agg(F.max(F.unix_micros("processed_to"))).first()[0]
    return None if us is None else datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)


def seal_rollups(samples: DataFrame, path: str, resolution: str, now: datetime, lag_s: int = 30) -> tuple[datetime, datetime] | None:
    """Adds the buckets that ended lag_s or more before now to the table below `path`; the range [from, to) that was sealed, None if there was none.

    The table is partitioned by resolution and day. The days of the range are written anew, from the range's buckets and what
    the table has of these days outside it, and take the place of the old ones when all is written; then the watermark moves. So a
    run that fails before the watermark has moved, or is repeated, leaves every bucket once. Only the range is read of samples.
    """
    spark = samples.sparkSession
    cutoff = floor_instant(now - timedelta(seconds=lag_s), resolution)
    start = watermark(spark, path, resolution)
    if start is None:
        us = samples.agg(F.min(F.unix_micros("ts"))).first()[0]
        start = None if us is None else floor_instant(datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us), resolution)
    if start is None or start >= cutoff:
        return None
    part = samples.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(cutoff)))
    if "day" in samples.columns:
        part = part.where(F.col("day").between(F.to_date(F.lit(start)), F.to_date(F.lit(cutoff))))
    have = stored_rollups(spark, path).where((F.col("resolution") == resolution) & F.col("day").between(F.to_date(F.lit(start)), F.to_date(F.lit(cutoff))))
    outside = have.where((F.col("bucket_ts") < F.lit(start)) | (F.col("bucket_ts") >= F.lit(cutoff)))
    days = outside.select(*COLUMNS).unionByName(rollup(part, resolution)).withColumn("day", F.to_date("bucket_ts")).persist()
    try:
        # a day of the range that is left without a bucket has none to replace it
        gone = [r[0] for r in have.select("day").distinct().join(days.select("day").distinct(), "day", "left_anti").collect()]
        _replace_partitions(days, f"{path}/rollups", ["resolution", "day"])
    finally:
        days.unpersist()
    for day in gone:
        fs, p = _fs(spark, f"{path}/rollups/resolution={resolution}/day={day}")
        fs.delete(p, True)
    _replace_partitions(spark.createDataFrame([(resolution, cutoff)], schemas.WATERMARK), f"{path}/watermarks", ["resolution"])
    return start, cutoff


def day_folders(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(day, folder) of each day partition of a table, directly below it or below one more partition column."""
    fs, p = _fs(spark, path)
    found = []
    for pattern in ("day=*", "*=*/day=*"):
        _, glob = _fs(spark, f"{path.rstrip('/')}/{pattern}")
        for status in fs.globStatus(glob) or []:
            folder = status.getPath().toString()
            found.append((re.search(r"/day=([0-9-]+)$", folder)[1], folder))
    return sorted(found)


def _finish_drafts(spark: SparkSession, path: str) -> None:
    """Puts folders that a run had written whole, but not moved, in their place; others go."""
    for pattern in (".day=*.kept", "*=*/.day=*.kept"):
        fs, glob = _fs(spark, f"{path.rstrip('/')}/{pattern}")
        for status in fs.globStatus(glob) or []:
            draft = status.getPath()
            _, own = _fs(spark, re.sub(r"/\.(day=[0-9-]+)\.kept$", r"/\1", draft.toString()))
            _, done = _fs(spark, f"{draft.toString()}/_SUCCESS")
            if not fs.exists(own) and fs.exists(done):
                fs.rename(draft, own)
            else:
                fs.delete(draft, True)


def drop_before(spark: SparkSession, path: str, column: str, limit: datetime) -> tuple[int, int]:
    """Removes the rows of a table by day whose `column` is before limit; (folders dropped, folders written anew).

    Days before the limit's are dropped as folders; only the limit's own day is read and written, each of its folders beside
    the old one, which it replaces then. Rows at the limit stay. A run that is repeated finds nothing more to do, and one that comes
    after a crash between dropping a folder and putting the new one in its place does that first. Days are those of the session's zone, which must be UTC.
    """
    _finish_drafts(spark, path)
    day, dropped, rewritten = limit.astimezone(timezone.utc).date().isoformat(), 0, 0
    for own, folder in day_folders(spark, path):
        fs, p = _fs(spark, folder)
        if own < day:
            fs.delete(p, True)
            dropped += 1
        elif own == day:
            rows = spark.read.parquet(folder)
            late = rows.agg(F.count_if(F.col(column) < F.lit(limit)).alias("old"), F.count_if(F.col(column) >= F.lit(limit)).alias("kept")).first()
            if not late.old:
                continue
            if late.kept:
                parent, name = folder.rsplit("/", 1)
                draft = f"{parent}/.{name}.kept"
                rows.where(F.col(column) >= F.lit(limit)).write.mode("overwrite").parquet(draft)
                fs.delete(p, True)
                fs.rename(_fs(spark, draft)[1], p)
                rewritten += 1
            else:
                fs.delete(p, True)
                dropped += 1
    return dropped, rewritten


def retain(spark: SparkSession, samples_path: str, rollups_path: str, now: datetime, raw_days: int = 15, rollup_days: int = 90) -> dict[str, tuple[int, int]]:
    """Removes samples of more than raw_days and buckets of more than rollup_days before now from tables by day."""
    return {
        "samples": drop_before(spark, samples_path, "ts", now - timedelta(days=raw_days)),
        "rollups": drop_before(spark, rollups_path, "bucket_ts", now - timedelta(days=rollup_days)),
    }
