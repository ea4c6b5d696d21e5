"""Streaming twins of the batch jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetmetrics import schemas
from fleetmetrics.functions.guards import Limits
from fleetmetrics.functions.order import newest as newest_sample
from fleetmetrics.functions.tags import parse_tags
from fleetmetrics.functions.times import duration_ms
from fleetmetrics.operators import alerts
from fleetmetrics.operators.rollup import COLUMNS, _nan_or
from fleetmetrics.operators.series import resolve_series, with_series_key
from fleetmetrics.sources.ingest import batch_snapshots, ingest, read_ingest_batches, stamp_tenant
from fleetmetrics.streaming.epoch_table import EpochTable, newest


def rollup_stream(samples: DataFrame, resolution: str, lag: str = "30 seconds") -> DataFrame:
    """Sealed buckets of a stream of stored samples, each once, `lag` after its end in event time; later samples are not added."""
    width = f"{duration_ms(resolution)} milliseconds"
    out = samples.withWatermark("ts", lag).groupBy("series_id", F.window("ts", width).alias("w")).agg(
        F.count("*").alias("sample_count"),
        F.sum("value").alias("sum_value"),
        _nan_or(F.min("value"), "value").alias("min_value"),
        _nan_or(F.max("value"), "value").alias("max_value"),
        F.max_by("value", newest_sample()).alias("last_value"),
    )
    return out.withColumn("resolution", F.lit(resolution)).withColumn("bucket_ts", F.col("w.start")).select(*COLUMNS)


def _merged_series(rows: DataFrame) -> DataFrame:
    """One row a series, seen from its first to its last time; the tags are those of its key."""
    seen = rows.groupBy("series_key", "series_id", "org_id", "metric", "tags_text").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("epoch").alias("epoch"))
    return seen.withColumn("tags", parse_tags(F.col("tags_text")))


def _newest_snapshots(rows: DataFrame) -> DataFrame:
    """One snapshot a host: the last captured, of equal instants that of the last epoch."""
    order = Window.partitionBy("org_id", "host").orderBy(F.desc("captured_at"), F.desc("epoch"), F.desc("payload_json"))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def registry_table(spark: SparkSession, path: str) -> EpochTable:
    return EpochTable(spark, path, schemas.SERIES, _merged_series)


def registry_at(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The series registry that a stream has written, as it was before an epoch."""
    return registry_table(spark, path).read(before)


def _snapshot_table(spark: SparkSession, path: str) -> EpochTable:
    return EpochTable(spark, path, schemas.HOST_SNAPSHOT, _newest_snapshots)


def snapshots_at(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot of each host that a stream has written."""
    return _snapshot_table(spark, path).read()


def ingest_stream(spark: SparkSession, path: str, credentials: DataFrame, out: str, checkpoint: str, limits: Limits = Limits(), **trigger):
    """Starts the ingest of JSON batches from a folder to samples, refusals, host snapshots and the registry, below `out`.

    A micro-batch is a folder epoch=<n> of samples and refusals, which it overwrites, and sees the registry as it was before
    epoch n; so one that runs again leaves every row once. The registry and the snapshots are EpochTables: an epoch adds new
    and changed keys only, and what is read in a batch follows the number of keys, not of epochs. A
    snapshot is as old as its batch's newest point, or as its arrival if the batch has none.
    """

    registry, snapshots = registry_table(spark, f"{out}/registry"), _snapshot_table(spark, f"{out}/snapshots")

    def each(batch: DataFrame, epoch: int) -> None:
        held = [batch.persist()]
        try:
            before = registry.read(epoch)
            points, refused = ingest(batch, credentials, before, limits)
            held += [points.persist(), refused.persist()]
            stored, grown = resolve_series(points.select("org_id", "metric", "tags", "value", "ts", "seq"), before)
            days = stored.withColumn("day", F.to_date("ts")).repartition("day", F.pmod(F.col("series_id"), F.lit(16)))
            days.write.mode("overwrite").partitionBy("day").parquet(f"{out}/samples/epoch={epoch}")
            refused.write.mode("overwrite").parquet(f"{out}/rejects/epoch={epoch}")
            taken = stamp_tenant(batch, credentials)[0].join(refused.select("batch_id"), "batch_id", "left_anti")
            snapshots.write(epoch, batch_snapshots(taken))
            touched = with_series_key(points).select("series_key").distinct()
            registry.write(epoch, grown.join(touched, "series_key", "left_semi"))
        finally:
            for df in held:
                df.unpersist()

    source = read_ingest_batches(spark, path, streaming=True)
    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def alert_tables(spark: SparkSession, out: str) -> dict[str, EpochTable]:
    """The states of the machines and the episodes that alert_stream keeps below `out`."""
    return {
        "states": EpochTable(spark, f"{out}/states", schemas.ALERT_STATE, newest(*alerts.KEY)),
        "episodes": EpochTable(spark, f"{out}/episodes", schemas.EPISODE, newest("episode_key")),
    }


def alert_stream(decisions: DataFrame, rules: DataFrame, out: str, checkpoint: str, acks: Callable[[], DataFrame] | None = None, sender: str = alerts.SENDER, **trigger):
    """Starts the alerting of a stream of decisions: transitions, states, episodes and the outbox, below `out`.

    A micro-batch continues the machines from their states before its epoch, and writes transitions and outbox into a
    folder epoch=<n>, which it overwrites; states and episodes are EpochTables. So an epoch that runs again changes and
    sends nothing twice, and the rows of the outbox are one for each (episode_key, action). acks gives (episode_key,
    incident_id, incident_number) of the incidents that a sender has opened so far; an episode that resolves with an
    incident asks for its closing. Ticks of a key must come in order over the batches, as sweeps do; within one they are sorted.
    """
    spark = decisions.sparkSession
    tables = alert_tables(spark, out)

    def each(batch: DataFrame, epoch: int) -> None:
        path = f"{out}/transitions/epoch={epoch}"
        alerts.alert_transitions(batch, rules, tables["states"].read(epoch)).write.mode("overwrite").parquet(path)
        moved = spark.read.schema(schemas.TRANSITION).parquet(path)
        tables["states"].write(epoch, alerts.alert_state_at(moved))
        told = moved.where("transition is not null").withColumn("episode_key", alerts.episode_key(F.col("rule_key"), F.col("host"), F.col("transition_start")))
        known = tables["episodes"].read(epoch).join(told.select("episode_key").distinct(), "episode_key", "left_semi")
        if acks is not None:
            opened = acks().groupBy("episode_key").agg(F.max("incident_id").alias("_id"), F.max("incident_number").alias("_number"))
            known = known.join(opened, "episode_key", "left").withColumn("incident_id", F.coalesce("incident_id", "_id")).withColumn("incident_number", F.coalesce("incident_number", "_number"))
        changed = alerts.episodes(told, known.select(*alerts.EPISODE))
        seen = told.groupBy("episode_key").agg(F.max_by("observed", "tick").alias("observed"))
        alerts.incident_outbox(changed, rules, seen, sender).write.mode("overwrite").parquet(f"{out}/outbox/epoch={epoch}")
        tables["episodes"].write(epoch, changed)

    return decisions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
