"""Gauges and rates of hosts, and their process lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetmetrics.schemas import PROCESSES

# The names of the metrics.
CPU, MEM_PERCENT, MEM_BYTES, DISK = "system.cpu.load", "system.memory.used.percent", "system.memory.used.bytes", "system.disk.used.percent"
PROCESS_COUNT, THREAD_COUNT, UP = "system.process.count", "system.thread.count", "agent.up"
NET_IN, NET_OUT = "system.network.in.bytes_per_sec", "system.network.out.bytes_per_sec"


def derive_host_gauges(counters: DataFrame) -> DataFrame:
    """(host, metric, value, ts) of raw host counters; the disk gauge only where the disk has a size."""
    share = lambda part, whole: 100.0 * (1.0 - F.col(part) / F.nullif(F.col(whole), F.lit(0)))
    gauges = F.array(
        F.struct(F.lit(CPU).alias("metric"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cpu_load"))).alias("value")),
        F.struct(F.lit(MEM_PERCENT).alias("metric"), share("mem_available", "mem_total").alias("value")),
        F.struct(F.lit(MEM_BYTES).alias("metric"), (F.col("mem_total") - F.col("mem_available")).cast("double").alias("value")),
        F.struct(F.lit(DISK).alias("metric"), F.when(F.col("disk_total") > 0, share("disk_free", "disk_total")).alias("value")),
        F.struct(F.lit(PROCESS_COUNT).alias("metric"), F.col("process_count").cast("double").alias("value")),
        F.struct(F.lit(THREAD_COUNT).alias("metric"), F.col("thread_count").cast("double").alias("value")),
        F.struct(F.lit(UP).alias("metric"), F.lit(1.0).alias("value")),
    )
    kept = F.filter(gauges, lambda g: (g["metric"] != DISK) | g["value"].isNotNull())
    return counters.select("host", "ts", F.inline(kept)).select("host", "metric", "value", "ts")


def network_rates(counters: DataFrame) -> DataFrame:
    """(host, metric, value, ts): bytes per second since the host's snapshot before; none for the first or without time between, 0 if a counter fell."""
    # windows are by host and day, so a long history isn't one task; the last snapshot of the day before is one row a host and day
    rows = counters.select("host", "ts", "bytes_recv", "bytes_sent", F.to_date("ts").alias("_d"))
    seen = F.struct("ts", "bytes_recv", "bytes_sent")
    parts = ("ts", "bytes_recv", "bytes_sent")
    days = rows.groupBy("host", "_d").agg(*[F.max_by(c, "ts").alias(f"e_{c}") for c in parts])
    end = F.struct(*[F.col(f"e_{c}").alias(c) for c in parts])
    before = days.select("host", "_d", F.lag(end).over(Window.partitionBy("host").orderBy("_d")).alias("_p"))
    rows = rows.withColumn("_own", F.lag(seen).over(Window.partitionBy("host", "_d").orderBy("ts"))).join(before, ["host", "_d"])
    p = F.coalesce("_own", "_p")
    seconds = (F.unix_millis("ts") - F.unix_millis(p["ts"])) / 1000.0
    rows = rows.select("host", "ts", "bytes_recv", "bytes_sent", p["bytes_recv"].alias("p_bytes_recv"), p["bytes_sent"].alias("p_bytes_sent"), seconds.alias("s")).where("s > 0")
    rate = lambda n: F.greatest(F.lit(0.0), (F.col(n) - F.col(f"p_{n}")) / F.col("s"))
    both = F.array(*[F.struct(F.lit(m).alias("metric"), rate(n).alias("value")) for m, n in ((NET_IN, "bytes_recv"), (NET_OUT, "bytes_sent"))])
    return rows.select("host", "ts", F.inline(both)).select("host", "metric", "value", "ts")


def top_processes(processes: DataFrame, k: int = 10) -> DataFrame:
    """The k processes of each host with the most CPU (share of one, `cpu`), with cpuPercent to one decimal, half up, and rss in whole MiB."""
    w = Window.partitionBy("host").orderBy(F.desc("cpu"), "pid")
    top = processes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return top.select(
        "host", "pid", "command", "user",
        (F.floor(F.col("cpu") * 1000 + 0.5) / 10).alias("cpuPercent"),
        F.floor(F.col("rss_bytes") / 1048576).cast("long").alias("rssMb"),
    )


def explode_snapshot(snapshots: DataFrame) -> DataFrame:
    """(org_id, host, pid, command, user, cpuPercent, rssMb) of the JSON process lists; text that isn't one gives no row."""
    parsed = snapshots.select("org_id", "host", F.from_json("payload_json", PROCESSES).alias("p"))
    return parsed.select("org_id", "host", F.inline("p"))


def upsert_host_snapshot(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row for each (org_id, host), the newest; of equal instants the incoming one."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    newest = F.max_by(F.struct("captured_at", "payload_json"), F.struct("captured_at", "_new"))
    return both.groupBy("org_id", "host").agg(newest.alias("s")).select("org_id", "host", "s.captured_at", "s.payload_json")
