"""Monitoring data read from the event tables: samples, counters, batches, host counters, rules."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
NOON = START + timedelta(days=15, hours=12)
DAYS = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ts as an instant and k, the number in props."""
    rows = table(spark, sf_dir, "events")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def user_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many sparse series: a metric for each type of event, a host for each user, two tenants."""
    return events(spark, sf_dir).select(
        F.concat(F.lit("org-"), (F.col("user_id") % 2).cast("string")).alias("org_id"), F.col("event_type").alias("metric"),
        F.create_map(F.lit("host"), F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("tags"), "value", "ts", F.col("event_id").alias("seq"),
    )


def type_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few dense series: a host for each type of event, four shards."""
    return events(spark, sf_dir).select(
        F.lit("org-t").alias("org_id"), F.lit("events.value").alias("metric"), _type_tags().alias("tags"), "value", "ts", F.col("event_id").alias("seq"),
    )


def _type_tags():
    return F.create_map(F.lit("host"), F.col("event_type"), F.lit("shard"), (F.col("user_id") % 4).cast("string"))


def counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter for each of the dense series: events so far, from 0 again at each event with k < 5."""
    shard = (F.col("user_id") % 4).alias("shard")
    upto = Window.partitionBy("event_type", "shard").orderBy("ts", "event_id")
    rows = events(spark, sf_dir).select("*", shard).withColumn("life", F.sum((F.col("k") < 5).cast("int")).over(upto))
    count = F.row_number().over(Window.partitionBy("event_type", "shard", "life").orderBy("ts", "event_id")) - 1
    return rows.select(
        F.lit("org-t").alias("org_id"), F.lit("events.total").alias("metric"), _type_tags().alias("tags"),
        count.cast("double").alias("value"), "ts", F.col("event_id").alias("seq"),
    )


def ticks(spark: SparkSession, step_s: int, n: int, start: datetime = START) -> DataFrame:
    first = int(start.timestamp() * 1000)
    return spark.range(n).select(F.timestamp_millis(F.col("id") * (step_s * 1000) + first).alias("tick"))


def hourly(spark: SparkSession, every: int = 6) -> DataFrame:
    """A tick each `every` hours of the month."""
    return ticks(spark, 3600 * every, DAYS * 24 // every + 1)


def batches(spark: SparkSession, sf_dir: str, size: int = 50) -> DataFrame:
    """Ingest batches of `size` events in a row; some points break a limit, some hosts are blank, some tokens unknown."""
    k = F.col("k")
    name = F.when(k == 0, "").when(k == 1, F.repeat(F.lit("m"), 256)).otherwise(F.col("event_type"))
    tags = F.create_map(F.lit("host"), F.lit("spoofed"), F.lit("v"), F.when(k == 2, F.repeat(F.lit("x"), 129)).otherwise(F.lit("x")), F.when(k == 3, F.repeat(F.lit("t"), 65)).otherwise(F.lit("t")), F.lit("y"))
    rows = events(spark, sf_dir).withColumn("b", F.floor(F.col("event_id") / size))
    got = rows.groupBy("b").agg(F.sort_array(F.collect_list(F.struct(F.col("event_id").alias("o"), F.struct(name.alias("name"), F.col("value"), F.unix_millis("ts").alias("ts"), F.map_entries(tags).alias("tags")).alias("p")))).alias("m"))
    metrics = F.transform("m", lambda x: F.struct(x["p"]["name"].alias("name"), x["p"]["value"].alias("value"), x["p"]["ts"].alias("ts"), F.map_from_entries(x["p"]["tags"]).alias("tags")))
    b = F.col("b")
    return got.select(
        F.format_string("b%09d", b).alias("batch_id"), F.concat(F.lit("t"), (b % 4).cast("string")).alias("token"), F.lit("a").alias("agentId"),
        F.when(b % 17 == 5, " ").otherwise(F.concat(F.lit("h"), (b % 7).cast("string"))).alias("host"), metrics.alias("metrics"),
        F.array().cast("array<struct<pid:int,command:string,user:string,cpuPercent:double,rssMb:bigint>>").alias("processes"),
    )


def credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the batches but one in four."""
    b = events(spark, sf_dir).select((F.floor(F.col("event_id") / 50) % 4).alias("t")).distinct().where("t < 3")
    return b.select(F.concat(F.lit("t"), F.col("t").cast("string")).alias("token"), F.concat(F.lit("org-"), (F.col("t") % 2).cast("string")).alias("org_id"))


def host_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw counters of hosts, a snapshot for each event; bytes add up by user, so they never fall, but for those sent."""
    upto = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.col("k").cast("long")
    return events(spark, sf_dir).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("host"), "ts", (F.col("value") / 40 - 0.5).alias("cpu_load"),
        F.lit(1 << 30).cast("long").alias("mem_total"), ((k + 1) * (1 << 20)).alias("mem_available"), F.when(k % 10 == 0, 0).otherwise(1 << 40).cast("long").alias("disk_total"),
        (k * (1 << 30)).alias("disk_free"), F.sum(k).over(upto).alias("bytes_recv"), (k * 1000).alias("bytes_sent"), (k + 10).alias("process_count"), (k * 3).alias("thread_count"),
    )


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("event_type").alias("host"), F.col("event_id").cast("int").alias("pid"), F.concat(F.lit("cmd"), F.col("k").cast("string")).alias("command"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"), (F.col("value") / 100).alias("cpu"), (F.col("k") * F.lit(1_500_000).cast("long")).alias("rss_bytes"),
    )


def metric_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each metric and host of the sparse series: over the mean of its values. Every third user's are off."""
    mean = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 2).cast("string").alias("m"))
    host = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return mean.select(
        F.concat(F.lit("org-"), (F.col("user_id") % 2).cast("string")).alias("org_id"), F.concat("event_type", F.lit("-"), host).alias("rule_key"), F.concat(F.lit("Rule on "), host).alias("name"),
        F.concat(F.lit("sum("), F.col("event_type"), F.lit("{host='"), host, F.lit("'}) > "), F.col("m")).alias("expression"), F.lit("P3").alias("severity"), F.lit(60).alias("for_seconds"),
        F.lit(60).alias("resolve_seconds"), F.lit(0).alias("cooldown_seconds"), (F.col("user_id") % 3 != 0).alias("enabled"), F.lit(START).alias("created_at"), F.lit(START).alias("updated_at"),
    )


def work_dir(spark: SparkSession) -> str:
    """A new folder for what a streaming query reads and writes, below spark.checkpoint.dir; a temporary one only for a session in one process. It goes when the interpreter ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors share; master is {master}")
        root = f"file://{tempfile.gettempdir()}/spark-shared"
    path = f"{root.rstrip('/')}/fleet-{uuid.uuid4().hex}"
    _work.append((spark, path))
    return path


#: Folders of work_dir.
_work: list[tuple[SparkSession, str]] = []


@atexit.register
def _tidy() -> None:
    for spark, path in _work:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended; its local folders can still go
            if path.startswith("file:"):
                shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the tenant of the dense series; the threshold of each is the mean of the events' values."""
    mean = events(spark, sf_dir).agg(F.round(F.avg("value"), 2).cast("string").alias("m"))
    texts = {
        "shard-high": ("events.value{shard=\"1\"} > ", "", "P1"),
        "sum-high": ("sum(events.value) / count(events.value) > ", "", "P2"),
        "max-odd": ("max(events.value{shard=~\"1|3\"}) >= 1.5 * (", " + 1)", "P3"),
        "rate-up": ("sum(rate(events.total[1d])) * 86400 + 0 * ", " > 20", "P4"),
        "ambiguous": ("events.value < ", "", "P2"),
        "range-alone": ("events.total[1h] > ", "", "P2"),
        "minus-sum": ("-sum(events.value) < -2 * ", "", "P3"),
        "two-signs": ("(max(events.value) > ", ") + (count(events.value) > 2) >= 2", "P3"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("rule_key"), F.concat(F.lit(a), F.col("m"), F.lit(b)).alias("expression"), F.lit(p).alias("severity")) for k, (a, b, p) in texts.items()])
    return mean.select(F.inline(rows)).select(
        F.lit("org-t").alias("org_id"), "rule_key", F.concat(F.lit("Rule "), F.col("rule_key")).alias("name"), "expression", "severity", F.lit(43200).alias("for_seconds"),
        F.lit(21600).alias("resolve_seconds"), F.lit(86400).alias("cooldown_seconds"), F.lit(True).alias("enabled"), F.lit(START).alias("created_at"), F.lit(START).alias("updated_at"),
    )
