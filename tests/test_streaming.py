"""Streams equal their batch twins."""

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from fleetmetrics import schemas
from fleetmetrics.operators import alerts, rollup
from fleetmetrics.streaming import jobs
from fleetmetrics.streaming.epoch_table import EpochTable, newest

T0 = datetime(2026, 8, 2, 10, tzinfo=timezone.utc)


def drain(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_rollup_stream_equals_batch(spark, tmp_path):
    rows = [(s, T0 + timedelta(seconds=7 * i), float(i % 11), i) for i in range(120) for s in (1, 2)]
    src = spark.createDataFrame(rows, schemas.STORED_SAMPLE)
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = drain(jobs.rollup_stream(spark.readStream.schema(schemas.STORED_SAMPLE).parquet(str(tmp_path / "in")), "1m"), "rollups", tmp_path)
    last = max(r[1] for r in rows) - timedelta(seconds=30)
    want = rollup.rollup(src, "1m").where(F.col("bucket_ts") + F.expr("interval 1 minute") <= F.lit(last))
    assert got.count() > 10 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_alert_stream_equals_batch(spark, tmp_path):
    rule = spark.createDataFrame([("o", "r", "R", "x > 1", "P1", 60, 60, 120, True, T0, T0)], schemas.ALERT_RULE)
    pattern = [True, True, True, True, False, False, None, False, True, True] * 6
    rows = [("o", "r", h, T0 + timedelta(seconds=30 * i), v if h == "a" else (None if v is None else not v), 1.0, None) for i, v in enumerate(pattern) for h in ("a", "b")]
    out, check, acks = str(tmp_path / "out"), tmp_path / "check", []
    given = lambda: spark.createDataFrame(acks, "episode_key string, incident_id long, incident_number string")

    def sent():
        return sorted((r.episode_key, r.action) for r in spark.read.parquet(f"{out}/outbox").collect())

    def run():
        stream = spark.readStream.schema(schemas.DECISION).parquet(str(tmp_path / "d"))
        jobs.alert_stream(stream, rule, out, str(check), acks=given).awaitTermination()
        moved = sorted(map(str, spark.read.schema(schemas.TRANSITION).parquet(f"{out}/transitions").select(*schemas.TRANSITION.names).collect()))
        return moved, sorted(map(str, jobs.alert_tables(spark, out)["episodes"].read().collect())), sent()

    for part in range(6):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schemas.DECISION).coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
        got = run()
        # the epoch runs again, as after a crash before its commit
        (check / "commits" / str(part)).unlink()
        for crc in (check / "commits").glob(f".{part}.*"):
            crc.unlink()
        assert run() == got
        acks[:] = [(k, 5, "INC5") for k, action in sent() if action == "create" and part % 2 == 0]
    want = alerts.alert_transitions(spark.createDataFrame(rows, schemas.DECISION), rule)
    assert got[0] == sorted(map(str, want.collect())) and want.where("transition is not null").count() > 4
    assert len(set(got[2])) == len(got[2]) and {a for _, a in got[2]} == {"create", "resolve"}
    keys = {r.episode_key: r for r in jobs.alert_tables(spark, out)["episodes"].read().collect()}
    batch = {r.episode_key: r for r in alerts.episodes(want).collect()}
    assert set(keys) == set(batch) and all(keys[k].resolved_at == batch[k].resolved_at and (keys[k].state == "OPEN") == (batch[k].state == "OPEN") for k in keys)
    assert {k for k, a in got[2] if a == "resolve"} == {k for k, r in keys.items() if r.state == "RESOLVE_PENDING"}


def test_epoch_table(spark, tmp_path):
    """Many epochs: few files to read, every replay exact, nothing left that no list names."""
    schema = schemas.struct("k bigint, v bigint")
    t = EpochTable(spark, str(tmp_path / "t"), schema, newest("k"), fan=3)
    state: dict = {}
    for epoch in range(30):
        rows = {(epoch * 7 + i) % 40: epoch * 100 + i for i in range(5)}
        for _ in range(2 if epoch % 4 == 0 else 1):  # twice: the epoch is replayed
            t.write(epoch, spark.createDataFrame(list(rows.items()), schema).coalesce(1))
        state |= rows
        assert len(t.runs()) <= 2 * 4 and len(t.epochs()) <= t.keep
        if epoch % 5 == 0 or epoch == 29:
            assert {r.k: r.v for r in t.read().collect()} == state
    before = dict(state)
    assert {r.k: r.v for r in t.read(before=29).collect()} == {k: v for k, v in before.items() if v < 2900} | {r.k: r.v for r in t.read(29).collect() if r.k not in before or before[r.k] >= 2900}
    named = {r["name"] for e in t.epochs() for r in t.runs(e + 1)}
    assert {p.name for p in (tmp_path / "t" / "runs").iterdir()} == named
    assert EpochTable(spark, str(tmp_path / "none"), schema, newest("k")).read().count() == 0


def test_ingest_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    process = {"pid": 1, "command": "c", "user": "u", "cpuPercent": 1.0, "rssMb": 2}
    for i, host in enumerate(["h1", "h2", " "]):
        batch = {"batch_id": f"b{i}", "token": "t", "agentId": "a", "host": host, "metrics": [{"name": "m", "value": 1.5, "ts": 1000 * i, "tags": {"x": "1"}}], "processes": [process]}
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(batch))
    creds = spark.createDataFrame([("t", "o")], schemas.CREDENTIALS)
    out = str(tmp_path / "out")

    def run():
        jobs.ingest_stream(spark, str(tmp_path / "in"), creds, out, str(tmp_path / "check")).awaitTermination()
        keys = sorted((r.series_key, r.first_seen, r.last_seen) for r in jobs.registry_at(spark, f"{out}/registry").collect())
        samples = sorted((r.series_id, r.ts, r.value) for r in spark.read.parquet(f"{out}/samples").collect())
        shots = sorted((r.org_id, r.host) for r in jobs.snapshots_at(spark, f"{out}/snapshots").collect())
        return keys, samples, shots, [r.reason for r in spark.read.parquet(f"{out}/rejects").collect()]

    keys, samples, shots, refused = run()
    assert [k[0] for k in keys] == ["o|m|host=h1,x=1", "o|m|host=h2,x=1"] and len(samples) == 2
    assert shots == [("o", "h1"), ("o", "h2")] and refused == ["host is required"]
    # the same epoch again, as after a crash before its commit
    for commit in (tmp_path / "check" / "commits").iterdir():
        commit.unlink()
    assert run() == (keys, samples, shots, refused)
    # a later epoch adds to them
    batch = {"batch_id": "b9", "token": "t", "agentId": "a", "host": "h1", "metrics": [{"name": "m", "value": 2.5, "ts": 9000, "tags": {"x": "1"}}]}
    (tmp_path / "in" / "9.json").write_text(json.dumps(batch))
    again, more, _shots, _refused = run()
    assert len(again) == 2 and len(more) == 3 and again[0][2] > keys[0][2] and again[1] == keys[1]
