"""Ingest: batches of metric points to stored samples, with refusals as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetmetrics import schemas
from fleetmetrics.functions.guards import BAD_TOKEN, CARDINALITY, MANY_POINTS, NO_BUDGET, NO_HOST, Limits, cardinality_reason, is_blank
from fleetmetrics.functions.tags import force_host_tag
from fleetmetrics.functions.times import to_event_time
from fleetmetrics.operators.series import with_series_key


def read_ingest_batches(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON batches, one a line; a missing list of points or processes is empty."""
    reader = spark.readStream if streaming else spark.read
    rows = reader.schema(schemas.INGEST_BATCH).json(path)
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(schemas.INGEST_BATCH[c].dataType))
    return rows.withColumn("metrics", empty("metrics")).withColumn("processes", empty("processes"))


def explode_points(batches: DataFrame) -> DataFrame:
    """(batch_id, pos, name, value, ts_ms, tags), with org_id and host where the batches have them."""
    more = [c for c in ("org_id", "host") if c in batches.columns]
    rows = batches.select("batch_id", *more, F.posexplode("metrics").alias("pos", "m"))
    return rows.select("batch_id", *more, "pos", "m.name", "m.value", F.col("m.ts").alias("ts_ms"), "m.tags")


def stamp_tenant(batches: DataFrame, credentials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batches with the org_id of their token, refused (batch_id, reason)). The payload has no say in the tenant.

    The credential table is joined as it is; adaptive execution broadcasts it while it is small.
    """
    known = credentials.dropDuplicates(["token"])
    refused = batches.join(known, "token", "left_anti").select("batch_id", F.lit(BAD_TOKEN).alias("reason"))
    return batches.drop("org_id").join(known, "token"), refused


def _point_reasons(limits: Limits) -> Column:
    return F.transform("metrics", lambda m: cardinality_reason(m["name"], force_host_tag(m["tags"], F.col("host")), limits))


def batch_reason(limits: Limits = Limits()) -> Column:
    """Why a batch is refused, null if it isn't: no host, too many points, or the first point that breaks a limit."""
    first = F.get(F.filter(_point_reasons(limits), lambda r: r.isNotNull()), F.lit(0))
    return (
        F.when(is_blank(F.col("host")), F.lit(NO_HOST))
        .when(F.size("metrics") > limits.max_points, F.lit(MANY_POINTS % limits.max_points))
        .when(first.isNotNull(), F.concat(F.lit(CARDINALITY), first))
    )


def reject_batches(batches: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(accepted batches, refused (batch_id, reason)); one bad point refuses its batch. All inside the rows: no shuffle."""
    judged = batches.withColumn("reason", batch_reason(limits))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").select("batch_id", "reason")


def points_as_samples(batches: DataFrame) -> DataFrame:
    """Logical samples with batch_id and pos of accepted batches that have an org_id; the host tag is the sender's."""
    p = explode_points(batches)
    return p.select(
        "batch_id", "pos", "org_id", F.col("name").alias("metric"), force_host_tag(F.col("tags"), F.col("host")).alias("tags"),
        "value", to_event_time(F.col("ts_ms")).alias("ts"), F.xxhash64("batch_id", "pos").alias("seq"),
    )


def series_budget(points: DataFrame, registry: DataFrame, max_series: int = 10_000) -> DataFrame:
    """points with series_key and reason: null, or that the tenant's budget has no room for its new series.

    Known series always pass. New ones are admitted by tenant in the order of (batch_id, pos) of their first point
    while known + rank <= max_series. Only different new keys are ranked, not points.
    """
    keyed = with_series_key(points)
    known = registry.groupBy("org_id").agg(F.count_distinct("series_key").alias("known"))
    first = F.min(F.struct("batch_id", "pos")).alias("first")
    new = keyed.groupBy("org_id", "series_key").agg(first).join(registry.select("series_key"), "series_key", "left_anti")
    rank = F.row_number().over(Window.partitionBy("org_id").orderBy("first", "series_key"))
    over = new.withColumn("rank", rank).join(known, "org_id", "left").where(F.coalesce("known", F.lit(0)) + F.col("rank") > max_series).select("series_key", F.lit(True).alias("over"))
    text = F.concat(F.lit(CARDINALITY + NO_BUDGET[0] % max_series), F.col("metric"), F.lit(NO_BUDGET[1]))
    return keyed.join(over, "series_key", "left").withColumn("reason", F.when(F.col("over"), text)).drop("over")


def atomic_reject(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points of batches without a reason, refused (batch_id, reason of the first such point))."""
    bad = points.where("reason is not null").groupBy("batch_id").agg(F.min_by("reason", "pos").alias("reason"))
    return points.join(bad.select("batch_id"), "batch_id", "left_anti").drop("reason"), bad


def reject_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("reason").agg(F.count("*").alias("n"))


def ingest(batches: DataFrame, credentials: DataFrame, registry: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(logical samples, refused (batch_id, reason)) of batches, through every check."""
    stamped, no_token = stamp_tenant(batches, credentials)
    fine, bad = reject_batches(stamped, limits)
    within, over = atomic_reject(series_budget(points_as_samples(fine), registry, limits.max_series))
    return within, no_token.unionByName(bad).unionByName(over)


def batch_snapshots(batches: DataFrame, captured_at=None) -> DataFrame:
    """Host snapshots of accepted batches with a process list, captured at the given time, or else at the batch's newest point or now."""
    newest = F.timestamp_millis(F.array_max(F.transform("metrics", lambda m: m["ts"])))
    when = F.coalesce(newest, F.current_timestamp()) if captured_at is None else F.lit(captured_at).cast("timestamp")
    rows = batches.where(F.size("processes") > 0)
    return rows.select("org_id", "host", when.alias("captured_at"), F.to_json("processes").alias("payload_json"))


def write_samples(df: DataFrame, path: str) -> None:
    """Appends stored samples, by day of ts; a day's rows are dealt over tasks by series, so one day is no single task."""
    df.withColumn("day", F.to_date("ts")).repartition("day", F.pmod(F.col("series_id"), F.lit(16))).write.mode("append").partitionBy("day").parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
