"""A query for each operator over the event tables, and the DuckDB SQL that it equals.

Times are epoch milliseconds and sums are rounded, so that both engines print the same.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetmetrics import schemas
from fleetmetrics.functions.guards import Limits, cardinality_reason
from fleetmetrics.functions.tags import force_host_tag, host_from_tags, match_labels, parse_tags
from fleetmetrics.functions.times import floor_ts, to_event_time
from fleetmetrics.operators import alerts, evaluate, gauges, presence, query, retention, rollup, rules, series, sketches
from fleetmetrics.plans import views as V
from fleetmetrics.sources import ingest
from fleetmetrics.sources import stored as sealed
from fleetmetrics.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

U = """u AS (SELECT 'org-' || (user_id % 2) AS org_id, event_type AS metric, 'u' || user_id AS host, 'host=u' || user_id AS tags_text,
 'org-' || (user_id % 2) || '|' || event_type || '|host=u' || user_id AS series_key, value, ts, event_id AS seq FROM events)"""
T = """t AS (SELECT 'org-t' AS org_id, 'events.value' AS metric, event_type AS host, (user_id % 4)::VARCHAR AS shard,
 'host=' || event_type || ',shard=' || (user_id % 4) AS tags_text, 'org-t|events.value|host=' || event_type || ',shard=' || (user_id % 4) AS series_key,
 value, ts, event_id AS seq FROM events)"""
E = "e AS (SELECT *, json_extract(props, '$.k')::INT AS k FROM events)"
C = f"""{E}, c0 AS (SELECT *, user_id % 4 AS shard, sum((k < 5)::INT) OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) AS life FROM e),
c AS (SELECT event_type AS host, shard::VARCHAR AS shard, 'org-t|events.total|host=' || event_type || ',shard=' || shard AS series_key, ts, event_id AS seq,
 (row_number() OVER (PARTITION BY event_type, shard, life ORDER BY ts, event_id) - 1)::DOUBLE AS value FROM c0)"""
START_MS = int(V.START.timestamp() * 1000)
NOON_MS = int(V.NOON.timestamp() * 1000)


def at(ms: int) -> str:
    return f"make_timestamp({ms} * 1000::BIGINT)"


def query_of(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def ms(c: str, name: str | None = None):
    return F.unix_millis(c).alias(name or c)


def _stored(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored samples, series) of logical samples."""
    keyed = series.with_series_key(samples)
    return keyed.select(series.series_id(F.col("series_key")).alias("series_id"), "ts", "value", "seq"), series.series_of(samples)


def _keyed(df: DataFrame, dimension: DataFrame) -> DataFrame:
    return df.join(dimension.select("series_id", "series_key"), "series_id")


# tags and identity


@query_of("p8_canonical_tags", f"WITH {T} SELECT tags_text, count(*) AS n FROM t GROUP BY 1")
def _(spark, d):
    return series.with_series_key(V.type_samples(spark, d)).groupBy("tags_text").agg(F.count("*").alias("n"))


@query_of("p9_series_key", f"WITH {U} SELECT series_key, count(*) AS n FROM u GROUP BY 1")
def _(spark, d):
    return series.with_series_key(V.user_samples(spark, d)).groupBy("series_key").agg(F.count("*").alias("n"))


@query_of("p10_parse_tags", f"WITH {T} SELECT seq, host, shard, 2 AS n_tags FROM t")
def _(spark, d):
    tags = parse_tags(F.concat(F.lit("junk,=x,host=old,"), F.col("tags_text")))
    rows = series.with_series_key(V.type_samples(spark, d)).withColumn("p", tags)
    return rows.select("seq", F.col("p")["host"].alias("host"), F.col("p")["shard"].alias("shard"), F.size("p").alias("n_tags"))


@query_of("p11_host_from_tags", f"WITH {T} SELECT DISTINCT tags_text, host FROM t")
def _(spark, d):
    return series.with_series_key(V.type_samples(spark, d)).select("tags_text", host_from_tags(F.col("tags_text")).alias("host")).distinct()


@query_of("p2_force_host_tag", "SELECT event_id, 'agent' AS host, event_type AS kind FROM events")
def _(spark, d):
    tags = force_host_tag(F.create_map(F.lit("host"), F.lit("spoof"), F.lit("kind"), F.col("event_type")), F.lit("agent"))
    return V.events(spark, d).select("event_id", tags.alias("t")).select("event_id", F.col("t")["host"].alias("host"), F.col("t")["kind"].alias("kind"))


@query_of("p3_event_time", "SELECT event_id, (epoch_us(ts) // 1000) AS ts_ms FROM events")
def _(spark, d):
    return V.events(spark, d).select("event_id", to_event_time(F.unix_millis("ts")).alias("t")).select("event_id", ms("t", "ts_ms"))


@query_of("p12_match_labels", f"WITH {T} SELECT series_key, count(*) AS n FROM t WHERE shard IN ('1', '2') AND host <> 'click' GROUP BY 1")
def _(spark, d):
    rows = series.with_series_key(V.type_samples(spark, d))
    hit = match_labels(F.col("tags"), [("shard", "=~", "[12]"), ("host", "!=", "click"), ("missing", "=", ""), ("shard", "!~", "1.+")])
    return rows.where(hit).groupBy("series_key").agg(F.count("*").alias("n"))


@query_of("p13_scope_host", f"WITH {U} SELECT series_key, seq FROM u WHERE host = 'u1'")
def _(spark, d):
    return query.scope_host(series.with_series_key(V.user_samples(spark, d)), "u1").select("series_key", "seq")


@query_of("p14_raw_between", f"SELECT event_id AS seq, value FROM events WHERE ts >= {at(START_MS + 86400000)} AND ts < {at(START_MS + 3 * 86400000)}")
def _(spark, d):
    stored, _s = _stored(V.user_samples(spark, d))
    return query.raw_between(stored, V.START + timedelta(days=1), V.START + timedelta(days=3)).select("seq", "value")


@query_of("p15_samples_for", f"WITH {U} SELECT seq, value FROM u WHERE metric = (SELECT min(metric) FROM u) AND org_id = 'org-1' AND ts BETWEEN {at(START_MS)} AND {at(NOON_MS)}")
def _(spark, d):
    stored, dim = _stored(V.user_samples(spark, d))
    first = dim.agg(F.min("metric").alias("metric"))
    return query.samples_for(stored, dim.where("org_id = 'org-1'").join(first, "metric", "left_semi"), V.START, V.NOON).select("seq", "value")


@query_of("p16_find_series", f"WITH {U} SELECT DISTINCT series_key FROM u WHERE org_id = 'org-0' AND metric = 'click'")
def _(spark, d):
    return series.find_series(_stored(V.user_samples(spark, d))[1], "org-0", "click").select("series_key")


# ingest

LIMITS = Limits(max_points=5000)
POINTS = f"""{E}, p AS (SELECT event_id, event_id // 50 AS b, event_id % 50 AS pos, value, ts,
 CASE WHEN k = 0 THEN '' WHEN k = 1 THEN repeat('m', 256) ELSE event_type END AS name,
 CASE WHEN k = 0 THEN 'metric name is required' WHEN k = 1 THEN 'metric name exceeds 255 chars'
  WHEN k = 3 THEN 'tag key ''' || repeat('t', 65) || ''' exceeds 64 chars' WHEN k = 2 THEN 'tag ''v'' value exceeds 128 chars' END AS why FROM e),
b AS (SELECT b, arg_min(why, event_id) FILTER (WHERE why IS NOT NULL) AS why FROM p GROUP BY b),
r AS (SELECT 'b' || lpad(b::VARCHAR, 9, '0') AS batch_id, b,
 CASE WHEN b % 4 = 3 THEN 'invalid or missing agent token' WHEN b % 17 = 5 THEN 'host is required' WHEN why IS NOT NULL THEN 'cardinality: ' || why END AS reason FROM b),
a AS (SELECT 'org-' || ((r.b % 4) % 2) AS org_id, p.name AS metric, 'h' || (r.b % 7) AS host, p.*, r.batch_id,
 'org-' || ((r.b % 4) % 2) || '|' || name || '|host=h' || (r.b % 7) || ',t=y,v=x' AS series_key FROM p JOIN r USING (b) WHERE reason IS NULL)"""


@query_of("p4_cardinality_reason", f"WITH {POINTS} SELECT event_id, why AS reason FROM p WHERE why IS NOT NULL")
def _(spark, d):
    p = ingest.explode_points(V.batches(spark, d))
    why = cardinality_reason(F.col("name"), force_host_tag(F.col("tags"), F.lit("h")), LIMITS)
    number = F.substring("batch_id", 2, 9).cast("long") * 50 + F.col("pos")
    return p.select(number.alias("event_id"), why.alias("reason")).where("reason is not null")


@query_of("p1_stamp_tenant", f"WITH {POINTS} SELECT batch_id, CASE WHEN b % 4 < 3 THEN 'org-' || ((b % 4) % 2) END AS org_id FROM r")
def _(spark, d):
    good, bad = ingest.stamp_tenant(V.batches(spark, d), V.credentials(spark, d))
    return good.select("batch_id", "org_id").unionByName(bad.select("batch_id", F.lit(None).cast("string").alias("org_id")))


@query_of("p6_p7_reject_batches", f"WITH {POINTS} SELECT batch_id, CASE WHEN b % 17 = 5 THEN 'host is required' WHEN why IS NOT NULL THEN 'cardinality: ' || why END AS reason FROM r JOIN b USING (b) WHERE b % 17 = 5 OR why IS NOT NULL")
def _(spark, d):
    return ingest.reject_batches(V.batches(spark, d), LIMITS)[1]


@query_of("p6_oversize_batches", f"WITH {POINTS} SELECT batch_id, 'batch exceeds 49 points' AS reason FROM r WHERE b % 17 <> 5 AND (SELECT count(*) FROM p WHERE p.b = r.b) > 49")
def _(spark, d):
    return ingest.reject_batches(V.batches(spark, d), Limits(max_points=49))[1].where("reason like 'batch exceeds%'")


BUDGET = f"""{POINTS}, f AS (SELECT org_id, series_key, min((batch_id, pos)) AS first FROM a GROUP BY 1, 2),
g AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY first, series_key) AS rk FROM f)"""


@query_of("p5_series_budget", f"WITH {BUDGET} SELECT a.batch_id, a.pos::INT AS pos, CASE WHEN rk > 10 THEN 'cardinality: active series budget reached (10) — refusing to create new series for ''' || metric || '''' END AS reason FROM a JOIN g USING (org_id, series_key)")
def _(spark, d):
    good, _bad = ingest.stamp_tenant(V.batches(spark, d), V.credentials(spark, d))
    fine, _bad = ingest.reject_batches(good, LIMITS)
    none = series.series_of(V.user_samples(spark, d)).where("false")
    return ingest.series_budget(ingest.points_as_samples(fine), none, 10).select("batch_id", "pos", "reason")


@query_of("s1_ingest_accepted", f"WITH {POINTS} SELECT batch_id, pos::INT AS pos, org_id, metric, host, value, (epoch_us(ts) // 1000) AS ts_ms FROM a")
def _(spark, d):
    none = series.series_of(V.user_samples(spark, d)).where("false")
    ok, _bad = ingest.ingest(V.batches(spark, d), V.credentials(spark, d), none, LIMITS)
    return ok.select("batch_id", "pos", "org_id", "metric", F.col("tags")["host"].alias("host"), "value", ms("ts", "ts_ms"))


@query_of("s1_read_batches", f"WITH {POINTS} SELECT 'b' || lpad(b::VARCHAR, 9, '0') AS batch_id, pos::INT AS pos, name, value, (epoch_us(ts) // 1000) AS ts_ms FROM p")
def _(spark, d):
    path = V.work_dir(spark)
    V.batches(spark, d).drop("processes").write.json(path)
    return ingest.explode_points(ingest.read_ingest_batches(spark, path)).select("batch_id", "pos", "name", "value", "ts_ms")


@query_of("s2_write_samples", f"WITH {U} SELECT series_key, seq, value, (epoch_us(ts) // 1000) AS ts_ms, strftime(ts, '%Y-%m-%d') AS day FROM u")
def _(spark, d):
    stored, dim = _stored(V.user_samples(spark, d))
    path = V.work_dir(spark)
    for part in (stored.where(F.col("ts") < F.lit(V.NOON)), stored.where(F.col("ts") >= F.lit(V.NOON))):
        ingest.write_samples(part, path)
    return _keyed(ingest.read_samples(spark, path), dim).select("series_key", "seq", "value", ms("ts", "ts_ms"), F.date_format("day", "yyyy-MM-dd").alias("day"))


@query_of("t3_ingest_stream", f"WITH {POINTS} SELECT series_key, value, (epoch_us(ts) // 1000) AS ts_ms FROM a")
def _(spark, d):
    path = V.work_dir(spark)
    V.batches(spark, d).write.json(f"{path}/in")
    jobs.ingest_stream(spark, f"{path}/in", V.credentials(spark, d), f"{path}/out", f"{path}/check", LIMITS).awaitTermination()
    return _keyed(ingest.read_samples(spark, f"{path}/out/samples"), jobs.registry_at(spark, f"{path}/out/registry")).select("series_key", "value", ms("ts", "ts_ms"))


@query_of("a14_reject_counts", f"WITH {POINTS} SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1")
def _(spark, d):
    none = series.series_of(V.user_samples(spark, d)).where("false")
    return ingest.reject_counts(ingest.ingest(V.batches(spark, d), V.credentials(spark, d), none, LIMITS)[1])


# gauges and processes


@query_of("p17_host_gauges", f"""WITH {E}, g AS (SELECT 'u' || user_id AS host, (epoch_us(ts) // 1000) AS ts_ms, k, value FROM e),
x AS (SELECT host, ts_ms, unnest([
 {{'metric': 'system.cpu.load', 'value': least(1.0, greatest(0.0, value / 40 - 0.5))}},
 {{'metric': 'system.memory.used.percent', 'value': 100.0 * (1.0 - (k + 1) * 1048576 / 1073741824::DOUBLE)}},
 {{'metric': 'system.memory.used.bytes', 'value': (1073741824 - (k + 1) * 1048576)::DOUBLE}},
 {{'metric': 'system.disk.used.percent', 'value': CASE WHEN k % 10 <> 0 THEN 100.0 * (1.0 - (k * 1073741824::BIGINT) / 1099511627776::DOUBLE) END}},
 {{'metric': 'system.process.count', 'value': (k + 10)::DOUBLE}}, {{'metric': 'system.thread.count', 'value': (k * 3)::DOUBLE}}, {{'metric': 'agent.up', 'value': 1::DOUBLE}}]) AS m FROM g)
SELECT host, ts_ms, m.metric AS metric, round(m.value, 6) AS value FROM x WHERE m.value IS NOT NULL""")
def _(spark, d):
    return gauges.derive_host_gauges(V.host_counters(spark, d)).select("host", ms("ts", "ts_ms"), "metric", F.round("value", 6).alias("value"))


@query_of("w3_network_rates", f"""WITH {E}, n AS (SELECT user_id, ts, event_id, k, sum(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS recv, k * 1000 AS sent FROM e),
p AS (SELECT *, lag(recv) OVER w AS pr, lag(sent) OVER w AS ps, ((epoch_us(ts) // 1000) - (epoch_us(lag(ts) OVER w) // 1000)) / 1000.0 AS s FROM n WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
q AS (SELECT 'u' || user_id AS host, (epoch_us(ts) // 1000) AS ts_ms, greatest(0.0, (recv - pr) / s) AS i, greatest(0.0, (sent - ps) / s) AS o FROM p WHERE s > 0)
SELECT host, ts_ms, 'system.network.in.bytes_per_sec' AS metric, round(i, 6) AS value FROM q UNION ALL SELECT host, ts_ms, 'system.network.out.bytes_per_sec', round(o, 6) FROM q""")
def _(spark, d):
    return gauges.network_rates(V.host_counters(spark, d)).select("host", ms("ts", "ts_ms"), "metric", F.round("value", 6).alias("value"))


@query_of("w4_top_processes", f"""WITH {E} SELECT host, pid, command, "user", cpuPercent, rssMb FROM (SELECT event_type AS host, event_id::INT AS pid, 'cmd' || k AS command, 'u' || user_id AS "user",
 floor(value / 100 * 1000 + 0.5) / 10 AS cpuPercent, (k * 1500000) // 1048576 AS rssMb, row_number() OVER (PARTITION BY event_type ORDER BY value / 100 DESC, event_id) AS r FROM e) WHERE r <= 10""")
def _(spark, d):
    return gauges.top_processes(V.processes(spark, d))


def _snapshots(spark, d):
    p = V.processes(spark, d).join(V.events(spark, d).select(F.col("event_id").cast("int").alias("pid"), "ts"), "pid")
    one = F.struct("pid", "command", "user", F.col("cpu").alias("cpuPercent"), F.lit(1).cast("long").alias("rssMb"))
    return p.select(F.lit("org-t").alias("org_id"), "host", F.col("ts").alias("captured_at"), F.to_json(F.array(one)).alias("payload_json"))


@query_of("s3_upsert_host_snapshot", "SELECT 'org-t' AS org_id, event_type AS host, max((epoch_us(ts) // 1000)) AS captured_ms FROM events GROUP BY 2")
def _(spark, d):
    s = _snapshots(spark, d)
    old = gauges.upsert_host_snapshot(s.where("false"), s.where(F.col("captured_at") < F.lit(V.NOON)))
    return gauges.upsert_host_snapshot(old, s.where(F.col("captured_at") >= F.lit(V.NOON))).select("org_id", "host", ms("captured_at", "captured_ms"))


@query_of("w6_explode_snapshot", f"WITH {E} SELECT event_type AS host, event_id::INT AS pid, 'cmd' || k AS command, round(value / 100, 6) AS cpuPercent FROM e")
def _(spark, d):
    return gauges.explode_snapshot(_snapshots(spark, d)).select("host", "pid", "command", F.round("cpuPercent", 6).alias("cpuPercent"))


# series


@query_of("s6_normalise_flat_samples", f"WITH {U} SELECT series_key, count(*) AS n, round(sum(value), 4) AS total, min((epoch_us(ts) // 1000)) AS first_ms, max((epoch_us(ts) // 1000)) AS last_ms FROM u GROUP BY 1")
def _(spark, d):
    flat = V.user_samples(spark, d).select("org_id", F.col("tags")["host"].alias("host"), "metric", F.col("value").alias("metric_value"), "ts")
    dim, stored = series.normalise_flat_samples(flat)
    return _keyed(stored, dim).groupBy("series_key").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.unix_millis(F.min("ts")).alias("first_ms"), F.unix_millis(F.max("ts")).alias("last_ms"))


@query_of("j1_samples_with_series", f"WITH {U} SELECT seq, series_key, metric, org_id FROM u")
def _(spark, d):
    stored, dim = _stored(V.user_samples(spark, d))
    return series.samples_with_series(stored, dim).select("seq", "series_key", "metric", "org_id")


def _halves(spark, d):
    s = V.user_samples(spark, d)
    return s.where(F.col("ts") < F.lit(V.NOON)), s.where(F.col("ts") >= F.lit(V.NOON))


@query_of("j2_resolve_series", f"WITH {U} SELECT series_key, min((epoch_us(ts) // 1000)) AS first_ms, max((epoch_us(ts) // 1000)) AS last_ms FROM u GROUP BY 1")
def _(spark, d):
    old, new = _halves(spark, d)
    _stored_rows, registry = series.resolve_series(new, series.series_of(old))
    return registry.select("series_key", ms("first_seen", "first_ms"), ms("last_seen", "last_ms"))


@query_of("a13_series_seen", f"WITH {U}, o AS (SELECT DISTINCT series_key FROM u WHERE ts < {at(NOON_MS)}) SELECT series_key, min((epoch_us(ts) // 1000)) AS first_ms, max((epoch_us(ts) // 1000)) AS last_ms FROM u JOIN o USING (series_key) GROUP BY 1")
def _(spark, d):
    old, new = _halves(spark, d)
    return series.series_seen(series.series_of(old), _stored(new)[0]).select("series_key", ms("first_seen", "first_ms"), ms("last_seen", "last_ms"))


@query_of("a12_active_hosts", f"WITH {U} SELECT DISTINCT org_id, host FROM (SELECT org_id, host, max(ts) AS m FROM u GROUP BY ALL) WHERE m >= {at(START_MS + 29 * 86400000)}")
def _(spark, d):
    return series.active_hosts(_stored(V.user_samples(spark, d))[1], V.START + timedelta(days=29))


@query_of("u1_distinct_hosts", f"WITH {U} SELECT DISTINCT org_id, host FROM u WHERE org_id = 'org-1'")
def _(spark, d):
    return series.active_hosts(_stored(V.user_samples(spark, d))[1], V.START - timedelta(days=1), "org-1")


@query_of("j5_u2_orphan_series", f"WITH {U} SELECT series_key FROM u GROUP BY 1 HAVING max(ts) < {at(START_MS + 28 * 86400000)} AND NOT bool_or(value > 75)")
def _(spark, d):
    stored, dim = _stored(V.user_samples(spark, d))
    return series.orphan_series(dim, stored.where(F.col("ts") >= F.lit(V.START + timedelta(days=28))), stored.where("value > 75")).select("series_key")


@query_of("j5_live_bitmaps", f"WITH {U} SELECT series_key FROM u GROUP BY 1 HAVING max(ts) < {at(START_MS + 28 * 86400000)} AND NOT bool_or(value > 75)")
def _(spark, d):
    stored, dim = _stored(V.user_samples(spark, d))
    numbers = presence.numbered_series(dim, presence.numbered_series(dim.where("org_id = 'org-0'")))
    samples = presence.live_days(stored, numbers).where(F.col("day") >= F.lit((V.START + timedelta(days=28)).date()))
    buckets = presence.live_days(rollup.rollup(stored.where("value > 75"), "1h"), numbers, "bucket_ts")
    return presence.orphans_by_day(dim, numbers, samples, buckets).select("series_key")


def _drained(stream: DataFrame, path: str) -> None:
    """Runs a stream over all that is there, to parquet below path."""
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()


# rollups


def rollup_sql(step_ms: int, res: str, src: str = "u", where: str = "true") -> str:
    return f"""SELECT series_key, '{res}' AS resolution, (epoch_us(ts) // 1000) // {step_ms} * {step_ms} AS bucket_ms, count(*) AS sample_count, round(sum(value), 4) AS sum_value,
 min(value) AS min_value, max(value) AS max_value, arg_max(value, (ts, seq)) AS last_value FROM {src} WHERE {where} GROUP BY 1, 3"""


def _shown(r: DataFrame, dim: DataFrame, *more: str) -> DataFrame:
    return _keyed(r, dim).select("series_key", "resolution", ms("bucket_ts", "bucket_ms"), "sample_count", F.round("sum_value", 4).alias("sum_value"), "min_value", "max_value", "last_value", *more)


@query_of("a1_floor_ts", "SELECT event_id, (epoch_us(ts) // 1000) // 300000 * 300000 AS b5, (epoch_us(ts) // 1000) // 86400000 * 86400000 AS b1d FROM events")
def _(spark, d):
    return V.events(spark, d).select("event_id", F.unix_millis(floor_ts(F.col("ts"), "5m")).alias("b5"), F.unix_millis(floor_ts(F.col("ts"), "1d")).alias("b1d"))


@query_of("a2_a4_rollup_1h", f"WITH {U}, r AS ({rollup_sql(3600000, '1h')}) SELECT *, round(sum_value / sample_count, 4) AS mean_value FROM r")
def rollup_1h(spark, d):
    stored, dim = _stored(V.user_samples(spark, d))
    out = rollup.bucket_mean(rollup.rollup(stored, "1h"))
    return _shown(out, dim, F.round(F.round("sum_value", 4) / F.col("sample_count"), 4).alias("mean_value"))


@query_of("a3_rollup_all", f"WITH {U} {rollup_sql(60000, '1m')} UNION ALL {rollup_sql(300000, '5m')} UNION ALL {rollup_sql(3600000, '1h')}")
def _(spark, d):
    stored, dim = _stored(V.user_samples(spark, d))
    return _shown(rollup.rollup_all(stored), dim)


@query_of("a5_merge_rollups", f"WITH {U} {rollup_sql(86400000, '1d')}")
def _(spark, d):
    stored, dim = _stored(V.user_samples(spark, d))
    return _shown(rollup.merge_rollups(rollup.rollup(stored, "1h"), "1h", "1d"), dim)


@query_of("s4_replace_rollup_range", f"WITH {U}, v AS (SELECT * REPLACE (CASE WHEN ts >= {at(NOON_MS)} THEN value * 2 ELSE value END AS value) FROM u) {rollup_sql(3600000, '1h', 'v')}")
def _(spark, d):
    stored, dim = _stored(V.user_samples(spark, d))
    end = V.START + timedelta(days=60)
    new = rollup.rollup(stored.withColumn("value", F.col("value") * 2), "1h")
    return _shown(rollup.replace_rollup_range(rollup.rollup(stored, "1h"), new, "1h", V.NOON, end), dim)


@query_of("t2_rollup_incremental", f"WITH {U} {rollup_sql(3600000, '1h', where=f'ts < {at(NOON_MS + 7200000)}')}")
def _(spark, d):
    stored, dim = _stored(V.user_samples(spark, d))
    none = rollup.rollup(stored, "1h").where("false")
    marks = spark.createDataFrame([], "resolution string, processed_to timestamp")
    first, marks = rollup.rollup_incremental(stored, none, marks, "1h", V.NOON)
    again, _marks = rollup.rollup_incremental(stored, first, marks, "1h", V.NOON + timedelta(hours=2, seconds=40))
    return _shown(again, dim)


@query_of("t2_seal_rollups", f"WITH {U} {rollup_sql(3600000, '1h', where=f'ts < {at(NOON_MS + 7200000)}')}")
def _(spark, d):
    stored, dim = _stored(V.user_samples(spark, d))
    path = V.work_dir(spark)
    for hours in (-30, 0, 0, 2):
        sealed.seal_rollups(stored, path, "1h", V.NOON + timedelta(hours=hours, seconds=40))
    return _shown(sealed.stored_rollups(spark, path), dim)


@query_of("t1_rollup_stream", f"WITH {U}, r AS ({rollup_sql(3600000, '1h')}) SELECT * FROM r WHERE bucket_ms + 3600000 <= (SELECT (epoch_us(max(ts)) // 1000) - 30000 FROM u)")
def _(spark, d):
    stored, dim = _stored(V.user_samples(spark, d))
    path = V.work_dir(spark)
    stored.write.parquet(f"{path}/in")
    buckets = jobs.rollup_stream(spark.readStream.schema(stored.schema).parquet(f"{path}/in"), "1h")
    _drained(buckets, path)
    return _shown(spark.read.schema(buckets.schema).parquet(f"{path}/out"), dim)


@query_of("j8_reconcile_rollups", f"WITH {U}, r AS ({rollup_sql(3600000, '1h')}) SELECT series_key, bucket_ms, sample_count AS raw_count, CASE WHEN sample_count <> 2 THEN sample_count + 1 END AS count FROM r WHERE sample_count > 1")
def _(spark, d):
    stored, dim = _stored(V.user_samples(spark, d))
    bad = rollup.rollup(stored, "1h").where("sample_count <> 2").withColumn("sample_count", F.when(F.col("sample_count") > 2, F.col("sample_count") + 1).otherwise(F.col("sample_count")))
    out = rollup.reconcile_rollups(stored, bad, "1h")
    return _keyed(out, dim).select("series_key", ms("bucket_ts", "bucket_ms"), F.col("raw_sample_count").alias("raw_count"), F.col("sample_count").alias("count"))


# questions


@query_of("a9_percentile", f"""WITH {U}, r AS (SELECT org_id, metric, value, row_number() OVER (PARTITION BY org_id, metric ORDER BY value) AS rk, count(*) OVER (PARTITION BY org_id, metric) AS n FROM u WHERE ts >= {at(NOON_MS)})
SELECT org_id, metric, value FROM r WHERE rk = ceil(0.95 * n)""")
def _(spark, d):
    stored, dim = _stored(V.user_samples(spark, d))
    return query.percentile(stored, dim, V.NOON, 0.95, ("org_id", "metric"))


@query_of("a10_percentile_sketch", f"""WITH {U}, r AS (SELECT series_key, value, row_number() OVER (PARTITION BY series_key ORDER BY value) AS rk, count(*) OVER (PARTITION BY series_key) AS n FROM u)
SELECT series_key, value FROM r WHERE rk = ceil(0.5 * n)""")
def _(spark, d):
    stored, dim = _stored(V.user_samples(spark, d))
    return _keyed(query.percentile_sketch(stored, ["series_id"], 0.5), dim).select("series_key", "value")


@query_of("a10_stored_sketches", f"""WITH {U}, r AS (SELECT org_id, metric, value, row_number() OVER (PARTITION BY org_id, metric ORDER BY value) AS rk, count(*) OVER (PARTITION BY org_id, metric) AS n FROM u WHERE ts >= {at(NOON_MS)} AND ts < {at(NOON_MS + 604800000)})
SELECT org_id, metric, value FROM r WHERE rk = ceil(0.95 * n)""")
def _(spark, d):
    stored, dim = _stored(V.user_samples(spark, d))
    exact = 65_535  # up to so many values a summary keeps all
    return sketches.percentile_from_sketches(sketches.sketch_rollup(stored, "1h", exact), dim, V.NOON, V.NOON + timedelta(days=7), 0.95, k=exact)


@query_of("a11_totals", f"WITH {U} SELECT count(*) AS total_samples, count(DISTINCT (series_key, (epoch_us(ts) // 1000) // 3600000)) AS total_rollups, count(DISTINCT series_key) AS series_count, (epoch_us(min(ts)) // 1000) AS oldest_ms, (epoch_us(max(ts)) // 1000) AS last_ms FROM u")
def _(spark, d):
    stored, dim = _stored(V.user_samples(spark, d))
    t = query.totals(stored, rollup.rollup(stored, "1h"), dim)
    return t.select("total_samples", "total_rollups", "series_count", ms("oldest_sample_at", "oldest_ms"), ms("last_sample_at", "last_ms"))


@query_of("w1_latest_sample", f"WITH {T} SELECT host, arg_max(series_key, (ts, -seq)) AS series_key, arg_max(value, (ts, -seq)) AS value, max((epoch_us(ts) // 1000)) AS ts_ms FROM t GROUP BY 1")
def _(spark, d):
    stored, dim = _stored(V.type_samples(spark, d))
    return query.latest_sample(stored, dim, "org-t", "events.value").select("host", "series_key", "value", ms("ts", "ts_ms"))


# evaluation

TICKS = f"k AS (SELECT {START_MS} + i * 21600000 AS tick_ms FROM range(121) x(i))"
ASOF = f"""{T}, {TICKS}, v AS (SELECT series_key, host, shard, tick_ms, arg_max(value, (ts, -seq)) AS value FROM t JOIN k ON ts <= make_timestamp(tick_ms * 1000) AND ts >= make_timestamp((tick_ms - 43200000) * 1000) GROUP BY ALL)"""
STEPS = f"""{C}, {TICKS}, s0 AS (SELECT *, lag(value) OVER w AS pv, lag(ts) OVER w AS prev_ts FROM c WINDOW w AS (PARTITION BY series_key ORDER BY ts, seq)),
s AS (SELECT *, CASE WHEN pv IS NULL THEN NULL WHEN value - pv >= 0 THEN value - pv ELSE value END AS step FROM s0),
i AS (SELECT series_key, host, shard, tick_ms, coalesce(sum(step) FILTER (WHERE prev_ts >= make_timestamp((tick_ms - 86400000) * 1000)), 0) AS value FROM s
 JOIN k ON ts <= make_timestamp(tick_ms * 1000) AND ts >= make_timestamp((tick_ms - 86400000) * 1000) GROUP BY ALL)"""


@query_of("j4_e1_asof_latest", f"WITH {ASOF} SELECT series_key, tick_ms, value FROM v")
def _(spark, d):
    stored, dim = _stored(V.type_samples(spark, d))
    return _keyed(evaluate.asof_latest(stored, V.hourly(spark), 43200, 21600), dim).select("series_key", ms("tick", "tick_ms"), "value")


@query_of("w2_counter_steps", f"WITH {STEPS} SELECT series_key, seq, step, (epoch_us(prev_ts) // 1000) AS prev_ms FROM s")
def _(spark, d):
    stored, dim = _stored(V.counter_samples(spark, d))
    return _keyed(evaluate.counter_steps(stored), dim).select("series_key", "seq", "step", ms("prev_ts", "prev_ms"))


@query_of("a7_e2_counter_increase", f"WITH {STEPS} SELECT series_key, tick_ms, value FROM i")
def _(spark, d):
    stored, dim = _stored(V.counter_samples(spark, d))
    return _keyed(evaluate.counter_increase(stored, V.hourly(spark), 86400, 21600), dim).select("series_key", ms("tick", "tick_ms"), "value")


WEEK = STEPS.replace("86400000", "604800000")


@query_of("a7_long_increase", f"WITH {WEEK} SELECT series_key, tick_ms, value FROM i")
def _(spark, d):
    stored, dim = _stored(V.counter_samples(spark, d))
    return _keyed(evaluate.counter_increase(stored, V.hourly(spark), 7 * 86400, 21600, long_range=20), dim).select("series_key", ms("tick", "tick_ms"), "value")


@query_of("a8_counter_rate", f"WITH {STEPS} SELECT series_key, tick_ms, round(value / 86400, 9) AS value FROM i")
def _(spark, d):
    stored, dim = _stored(V.counter_samples(spark, d))
    return _keyed(evaluate.counter_rate(stored, V.hourly(spark), 86400, 21600), dim).select("series_key", ms("tick", "tick_ms"), F.round("value", 9).alias("value"))


@query_of("a6_vector_agg", f"WITH {ASOF} SELECT host, tick_ms, round(sum(value), 4) AS s, round(avg(value), 4) AS a, min(value) AS lo, max(value) AS hi, count(*)::DOUBLE AS n FROM v GROUP BY 1, 2")
def _(spark, d):
    stored, dim = _stored(V.type_samples(spark, d))
    v = evaluate.asof_latest(stored, V.hourly(spark), 43200, 21600).join(dim.select("series_id", F.col("tags")["host"].alias("host")), "series_id")
    out = None
    for fn, name in (("sum", "s"), ("avg", "a"), ("min", "lo"), ("max", "hi"), ("count", "n")):
        one = evaluate.vector_agg(v, fn, ("host", "tick")).withColumnRenamed("value", name)
        out = one if out is None else out.join(one, ["host", "tick"])
    return out.select("host", ms("tick", "tick_ms"), F.round("s", 4).alias("s"), F.round("a", 4).alias("a"), "lo", "hi", "n")


@query_of("j7_combine_scalars", f"WITH {ASOF} SELECT host, tick_ms, max(value) FILTER (WHERE shard = '0') AS s0, max(value) FILTER (WHERE shard = '3') AS s3 FROM v GROUP BY 1, 2")
def _(spark, d):
    stored, dim = _stored(V.type_samples(spark, d))
    v = evaluate.asof_latest(stored, V.hourly(spark), 43200, 21600).join(dim, "series_id")
    leaf = v.select(F.lit("r").alias("rule_key"), F.col("tags")["host"].alias("host"), "tick", F.col("tags")["shard"].alias("leaf_id"), "value")
    got = evaluate.combine_scalars(leaf)
    return got.select("host", ms("tick", "tick_ms"), F.try_element_at("values", F.lit("0")).alias("s0"), F.try_element_at("values", F.lit("3")).alias("s3"))


@query_of("j3_rule_host_pairs", "SELECT 'org-t' AS org_id, r.rule_key, h.event_type AS host FROM (SELECT unnest(['shard-high', 'sum-high', 'max-odd', 'rate-up', 'ambiguous', 'range-alone', 'minus-sum', 'two-signs']) AS rule_key) r, (SELECT DISTINCT event_type FROM events) h")
def _(spark, d):
    hosts = series.active_hosts(_stored(V.type_samples(spark, d))[1], V.START)
    return evaluate.rule_host_pairs(V.rules(spark, d), hosts)


RULES = f"""{ASOF}, {STEPS.replace(", " + TICKS, "")}, m AS (SELECT round(avg(value), 2) AS m FROM events),
h AS (SELECT DISTINCT host, tick_ms FROM t JOIN k ON ts <= make_timestamp(tick_ms * 1000) AND ts >= make_timestamp((tick_ms - 172800000) * 1000)),
w AS (SELECT host, tick_ms, count(*) AS n, max(value) FILTER (WHERE shard = '1') AS s1, sum(value) / count(*) AS mean, max(value) FILTER (WHERE shard IN ('1', '3')) AS odd, max(value) AS one, sum(value) AS total FROM v GROUP BY 1, 2),
q AS (SELECT host, tick_ms, sum(value / 86400) * 86400 AS up FROM i GROUP BY 1, 2),
x AS (SELECT h.host, h.tick_ms, coalesce(w.n, 0) AS n, s1, mean, odd, one, total, up, m FROM h CROSS JOIN m LEFT JOIN w USING (host, tick_ms) LEFT JOIN q USING (host, tick_ms)),
d AS (SELECT 'shard-high' AS rule_key, host, tick_ms, s1 > m AS violating, s1 AS observed, NULL::VARCHAR AS error FROM x
 UNION ALL SELECT 'sum-high', host, tick_ms, mean > m, mean, NULL FROM x
 UNION ALL SELECT 'max-odd', host, tick_ms, odd >= 1.5 * (m + 1), odd, NULL FROM x
 UNION ALL SELECT 'rate-up', host, tick_ms, up > 20, up, NULL FROM x
 UNION ALL SELECT 'ambiguous', host, tick_ms, CASE WHEN n = 1 THEN one < m END, CASE WHEN n = 1 THEN one END,
  CASE WHEN n > 1 THEN 'expression yields ' || n || ' series; wrap it in sum(), avg(), min() or max() to get a single value' END FROM x
 UNION ALL SELECT 'minus-sum', host, tick_ms, -total < -2 * m, -total, NULL FROM x
 UNION ALL SELECT 'two-signs', host, tick_ms, CASE WHEN n > 0 THEN (one > m)::INT + (n > 2)::INT >= 2 END, CASE WHEN n > 0 THEN ((one > m)::INT + (n > 2)::INT)::DOUBLE END, NULL FROM x
 UNION ALL SELECT 'range-alone', host, tick_ms, NULL, NULL, 'a range selector must be wrapped in rate() or increase()' FROM x)"""


def decisions(spark: SparkSession, d: str) -> DataFrame:
    a, da = _stored(V.type_samples(spark, d))
    b, db = _stored(V.counter_samples(spark, d))
    return evaluate.evaluate_rules(V.rules(spark, d), a.unionByName(b), da.unionByName(db), V.hourly(spark), lookback_s=43200, active_s=172800, step_s=21600)


@query_of("r3_e1_e8_evaluate_rules", f"WITH {RULES} SELECT rule_key, host, tick_ms, violating, round(observed, 4) AS observed, error FROM d")
def _(spark, d):
    return decisions(spark, d).select("rule_key", "host", ms("tick", "tick_ms"), "violating", F.round("observed", 4).alias("observed"), "error")


# rules as data


@query_of("s5_load_rules", f"WITH {U} SELECT metric || '-' || host AS rule_key, org_id, round(avg(value), 2) AS threshold FROM u WHERE org_id = 'org-1' AND substr(host, 2)::BIGINT % 3 <> 0 GROUP BY ALL")
def _(spark, d):
    threshold = F.regexp_extract("expression", "> (.*)$", 1).cast("double").alias("threshold")
    return rules.load_rules(V.metric_rules(spark, d), "org-1", True).select("rule_key", "org_id", threshold)


@query_of("r1_validate_rules", """WITH r AS (SELECT event_id, event_id % 7 AS c FROM events)
SELECT event_id, CASE c WHEN 0 THEN 'ruleKey is required' WHEN 1 THEN 'name is required' WHEN 2 THEN 'severity must be one of P1, P2, P3, P4' WHEN 3 THEN 'for/resolve must be positive and cooldown non-negative'
 WHEN 4 THEN 'invalid expression: expected end of expression but found '')'' (at position 5)' END AS reason, CASE WHEN c = 5 THEN 'a range selector must be wrapped in rate() or increase()' END AS warning FROM r""")
def _(spark, d):
    c = F.col("event_id") % 7
    r = V.events(spark, d).select(
        "event_id", F.lit("o").alias("org_id"), F.when(c == 0, " ").otherwise("key").alias("rule_key"), F.when(c == 1, "").otherwise("name").alias("name"),
        F.when(c == 4, "x > 1)").when(c == 5, "x[5m] > 1").otherwise("sum(x) > 1").alias("expression"), F.when(c == 2, "P5").otherwise("P1").alias("severity"),
        F.when(c == 3, 0).otherwise(60).alias("for_seconds"), F.lit(60).alias("resolve_seconds"), F.lit(0).alias("cooldown_seconds"),
    )
    return rules.validate_rules(r).select("event_id", "reason", "warning")


@query_of("r2_apply_rule_patches", """WITH u AS (SELECT DISTINCT user_id FROM events)
SELECT 'r' || user_id AS rule_key, CASE WHEN user_id % 5 = 2 AND user_id % 3 <> 0 THEN 'patched' ELSE 'old' END AS name, CASE WHEN user_id % 5 = 2 AND user_id % 3 <> 0 THEN 90 ELSE 60 END AS for_seconds FROM u WHERE user_id % 3 <> 0 AND user_id % 5 <> 3
UNION ALL SELECT 'r' || user_id, 'new', 30 FROM u WHERE user_id % 3 = 0 AND user_id % 5 = 1""")
def _(spark, d):
    u = V.events(spark, d).select("user_id").distinct()
    op = F.element_at(F.array(F.lit("none"), F.lit("create"), F.lit("update"), F.lit("delete"), F.lit("none")), (F.col("user_id") % 5 + 1).cast("int"))

    def rule(name, seconds):
        return [F.lit("o").alias("org_id"), F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("rule_key"), name.alias("name"), F.lit("sum(x) > 1").alias("expression"), F.lit("P1").alias("severity"),
                seconds.cast("int").alias("for_seconds"), F.lit(60).alias("resolve_seconds"), F.lit(0).alias("cooldown_seconds"), F.lit(True).alias("enabled")]

    stamp = [F.lit(V.START).alias("created_at"), F.lit(V.START).alias("updated_at")]
    old = u.where("user_id % 3 <> 0").select(*rule(F.lit("old"), F.lit(60)), *stamp)
    patch = u.where("user_id % 5 in (1, 2, 3)").select(op.alias("op"), *rule(F.when(op == "create", "new").otherwise("patched"), F.when(op == "create", 30).otherwise(90)))
    return rules.apply_rule_patches(old, patch, V.NOON)[0].select("rule_key", "name", "for_seconds")


# alerts

MACHINE = RULES.replace("WITH ", "") + """,
o AS (SELECT rule_key, host, tick_ms, violating, observed, row_number() OVER (PARTITION BY rule_key, host ORDER BY tick_ms) AS rn FROM d WHERE violating IS NOT NULL),
z AS (
 SELECT rule_key, host, 0::BIGINT AS rn, 0::BIGINT AS tick_ms, 'OK' AS state, NULL::BIGINT AS vs, NULL::BIGINT AS rs, NULL::BIGINT AS es, NULL::BIGINT AS cu, NULL::VARCHAR AS tr, NULL::BIGINT AS ts0, NULL::BIGINT AS rec FROM (SELECT DISTINCT rule_key, host FROM o)
 UNION ALL
 SELECT o.rule_key, o.host, o.rn, o.tick_ms,
  CASE WHEN z.state = 'OK' AND violating AND (cu IS NULL OR o.tick_ms >= cu) THEN 'PENDING' WHEN z.state = 'OK' THEN 'OK'
   WHEN z.state = 'PENDING' AND NOT violating THEN 'OK' WHEN z.state = 'PENDING' AND o.tick_ms - vs >= 43200000 THEN 'FIRING' WHEN z.state = 'PENDING' THEN 'PENDING'
   WHEN violating THEN 'FIRING' WHEN o.tick_ms - coalesce(rs, o.tick_ms) >= 21600000 THEN 'OK' ELSE 'FIRING' END,
  CASE WHEN z.state = 'OK' AND violating AND (cu IS NULL OR o.tick_ms >= cu) THEN o.tick_ms WHEN z.state = 'OK' THEN vs
   WHEN z.state = 'PENDING' AND NOT violating THEN NULL WHEN z.state = 'FIRING' AND NOT violating AND o.tick_ms - coalesce(rs, o.tick_ms) >= 21600000 THEN NULL ELSE vs END,
  CASE WHEN z.state = 'FIRING' AND NOT violating AND o.tick_ms - coalesce(rs, o.tick_ms) < 21600000 THEN coalesce(rs, o.tick_ms) END,
  CASE WHEN z.state = 'PENDING' AND violating AND o.tick_ms - vs >= 43200000 THEN vs WHEN z.state = 'FIRING' AND NOT violating AND o.tick_ms - coalesce(rs, o.tick_ms) >= 21600000 THEN NULL ELSE es END,
  CASE WHEN z.state = 'FIRING' AND NOT violating AND o.tick_ms - coalesce(rs, o.tick_ms) >= 21600000 THEN o.tick_ms + 86400000 ELSE cu END,
  CASE WHEN z.state = 'PENDING' AND violating AND o.tick_ms - vs >= 43200000 THEN 'FIRED' WHEN z.state = 'FIRING' AND NOT violating AND o.tick_ms - coalesce(rs, o.tick_ms) >= 21600000 THEN 'RESOLVED' END,
  CASE WHEN z.state = 'PENDING' AND violating AND o.tick_ms - vs >= 43200000 THEN vs WHEN z.state = 'FIRING' AND NOT violating AND o.tick_ms - coalesce(rs, o.tick_ms) >= 21600000 THEN es END,
  CASE WHEN z.state = 'FIRING' AND NOT violating AND o.tick_ms - coalesce(rs, o.tick_ms) >= 21600000 THEN coalesce(rs, o.tick_ms) END
 FROM z JOIN o ON o.rule_key = z.rule_key AND o.host = z.host AND o.rn = z.rn + 1),
l AS (SELECT * FROM z WHERE rn > 0)"""
EPISODES = MACHINE + """,
y AS (SELECT rule_key || '|' || host || '|' || (f.ts0 // 1000) AS episode_key, rule_key, host, f.ts0 AS started_ms,
 (SELECT min(g.tick_ms) FROM l g WHERE g.rule_key = f.rule_key AND g.host = f.host AND g.tr = 'RESOLVED' AND g.ts0 = f.ts0) AS resolved_ms FROM l f WHERE tr = 'FIRED')"""


def transitions(spark: SparkSession, d: str) -> DataFrame:
    return alerts.alert_transitions(decisions(spark, d), V.rules(spark, d))


@query_of("l1_alert_transitions", f"WITH RECURSIVE {MACHINE} SELECT rule_key, host, tick_ms, state, tr AS transition, ts0 AS start_ms, rec AS recovered_ms FROM l")
def _(spark, d):
    return transitions(spark, d).select("rule_key", "host", ms("tick", "tick_ms"), "state", "transition", ms("transition_start", "start_ms"), ms("recovered_at", "recovered_ms"))


def alerted(spark: SparkSession, d: str) -> str:
    """The folder of a stream of alerts over all decisions, a third of the ticks after another."""
    path = V.work_dir(spark)
    decisions(spark, d).write.parquet(f"{path}/all")
    rows = spark.read.parquet(f"{path}/all")
    third = timedelta(days=V.DAYS // 3)
    for i in range(3):
        part = rows.where(F.col("tick") >= F.lit(V.START + i * third)) if i else rows
        part = part.where(F.col("tick") < F.lit(V.START + (i + 1) * third)) if i < 2 else part
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    jobs.alert_stream(stream, V.rules(spark, d), f"{path}/out", f"{path}/check").awaitTermination()
    return f"{path}/out"


@query_of("l6_alert_stream", f"WITH RECURSIVE {MACHINE} SELECT rule_key, host, tick_ms, state, tr AS transition FROM l")
def _(spark, d):
    moved = spark.read.schema(schemas.TRANSITION).parquet(f"{alerted(spark, d)}/transitions")
    return moved.select("rule_key", "host", ms("tick", "tick_ms"), "state", "transition")


@query_of("l2_alert_state_at", f"WITH RECURSIVE {MACHINE} SELECT rule_key, host, arg_max(state, tick_ms) AS state, max(cu) AS cooldown_ms FROM l GROUP BY 1, 2")
def _(spark, d):
    return alerts.alert_state_at(transitions(spark, d)).select("rule_key", "host", "state", ms("cooldown_until", "cooldown_ms"))


@query_of("l3_episodes", f"WITH RECURSIVE {EPISODES} SELECT episode_key, rule_key AS rule_id, host, CASE WHEN resolved_ms IS NULL THEN 'OPEN' ELSE 'RESOLVED' END AS state, started_ms, resolved_ms FROM y")
def _(spark, d):
    return alerts.episodes(transitions(spark, d)).select("episode_key", "rule_id", "host", "state", ms("started_at", "started_ms"), ms("resolved_at", "resolved_ms"))


@query_of("w5_recent_episodes", f"WITH RECURSIVE {EPISODES} SELECT episode_key FROM y ORDER BY started_ms DESC, episode_key LIMIT 10")
def _(spark, d):
    return alerts.recent_episodes(alerts.episodes(transitions(spark, d))).select("episode_key")


@query_of("j6_open_new_episodes", f"WITH RECURSIVE {EPISODES} SELECT episode_key, CASE WHEN started_ms < {NOON_MS} THEN 7 END AS incident_id FROM y")
def _(spark, d):
    all_ = alerts.episodes(transitions(spark, d))
    old = all_.where(F.col("started_at") < F.lit(V.NOON)).withColumn("incident_id", F.lit(7).cast("long"))
    return alerts.open_new_episodes(old, all_.unionByName(all_)).select("episode_key", "incident_id")


@query_of("l3_l6_episode_stream", f"""WITH RECURSIVE {EPISODES} SELECT episode_key, rule_key AS rule_id, host, CASE WHEN resolved_ms IS NULL THEN 'OPEN' ELSE 'RESOLVED' END AS state, started_ms, resolved_ms,
 (SELECT CASE WHEN resolved_ms IS NOT NULL AND least((resolved_ms - {START_MS}) // 864000000, 2) = least((g.tick_ms - {START_MS}) // 864000000, 2) THEN 0 ELSE 1 END FROM l g WHERE g.rule_key = y.rule_key AND g.host = y.host AND g.ts0 = y.started_ms AND g.tr = 'FIRED') AS requests FROM y""")
def _(spark, d):
    out = alerted(spark, d)
    sent = spark.read.schema("episode_key string, action string").parquet(f"{out}/outbox").groupBy("episode_key").agg(F.count("*").alias("requests"))
    rows = jobs.alert_tables(spark, out)["episodes"].read().join(sent, "episode_key", "left")
    return rows.select("episode_key", "rule_id", "host", "state", ms("started_at", "started_ms"), ms("resolved_at", "resolved_ms"), F.coalesce("requests", F.lit(0)).alias("requests"))


@query_of("l4_l5_incident_outbox", f"""WITH RECURSIVE {EPISODES}, j AS (SELECT y.*, o.observed, l.tick_ms AS fired_ms FROM y JOIN l ON l.rule_key = y.rule_key AND l.host = y.host AND l.ts0 = y.started_ms AND l.tr = 'FIRED' JOIN o ON o.rule_key = y.rule_key AND o.host = y.host AND o.tick_ms = l.tick_ms)
SELECT episode_key, 'create' AS action, '[MONITOR] Rule ' || rule_key || ' on ' || host AS title, 'Observed: ' || printf('%.4f', observed) AS said, 'Sustained: 43200s before firing' AS sustained FROM j WHERE resolved_ms IS NULL AND fired_ms >= {NOON_MS}
UNION ALL SELECT episode_key, 'resolve', NULL, printf('latest %.4f', observed), 'sustained 21600s' FROM j WHERE resolved_ms >= {NOON_MS} AND fired_ms < {NOON_MS}""")
def _(spark, d):
    t = transitions(spark, d)
    seen = t.where("transition = 'FIRED'").select(alerts.episode_key(F.col("rule_key"), F.col("host"), F.col("transition_start")).alias("episode_key"), "observed")
    # incidents have been opened at noon for all that was open then
    noon = alerts.episodes(t.where(F.col("tick") < F.lit(V.NOON))).withColumn("incident_id", F.when(F.col("state") == "OPEN", F.lit(7).cast("long")))
    out = alerts.incident_outbox(alerts.episodes(t.where(F.col("tick") >= F.lit(V.NOON)), noon), V.rules(spark, d), seen)
    line = lambda n: F.get(F.split("body", "\n"), F.lit(n))
    either = lambda create, resolve: F.when(F.col("action") == "create", create).otherwise(F.regexp_extract("body", resolve, 0))
    return out.select("episode_key", "action", "title", either(line(5), "latest [-0-9.]+").alias("said"), either(line(6), "sustained [0-9]+s").alias("sustained"))


# retention


@query_of("t4_retain_stored", f"""WITH {U} SELECT series_key, seq, value FROM u WHERE ts >= {at(NOON_MS)}""")
def _(spark, d):
    stored, dim = _stored(V.user_samples(spark, d))
    path = V.work_dir(spark)
    ingest.write_samples(stored, path)
    sealed.drop_before(spark, path, "ts", V.NOON)
    return _keyed(ingest.read_samples(spark, path), dim).select("series_key", "seq", "value")


@query_of("t4_retention", f"""WITH {U}, s AS (SELECT * FROM u WHERE ts >= {at(START_MS + 20 * 86400000)}), r AS (SELECT DISTINCT series_key FROM u WHERE ts >= {at(START_MS + 10 * 86400000)} AND value > 50)
SELECT (SELECT count(*) FROM s) AS samples, (SELECT count(DISTINCT series_key) FROM (SELECT series_key FROM s UNION SELECT series_key FROM r)) AS series""")
def _(spark, d):
    stored, dim = _stored(V.user_samples(spark, d))
    old = rollup.rollup(stored.where("value > 50"), "1m").withColumn("bucket_ts", F.expr("bucket_ts - interval 65 days"))
    kept, _buckets, left = retention.retention(stored, old, dim, V.START + timedelta(days=35))
    return kept.agg(F.count("*").alias("samples")).withColumn("g", F.lit(1)).join(left.agg(F.count("*").alias("series")).withColumn("g", F.lit(1)), "g").select("samples", "series")
