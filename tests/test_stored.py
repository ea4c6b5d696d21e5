"""Tables on disk: sealed once, dropped by day; summaries that merge."""

import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fleetmetrics import schemas
from fleetmetrics.operators import presence, rollup, series, sketches
from fleetmetrics.sources import ingest, stored

T0 = datetime(2024, 5, 1, tzinfo=timezone.utc)


def some(spark, n=900, step_s=600):
    return spark.createDataFrame([(s, T0 + timedelta(seconds=step_s * i), float(i % 17), i) for i in range(n) for s in (1, 2)], schemas.STORED_SAMPLE)


def shown(df):
    return sorted(map(str, df.select(*rollup.COLUMNS).collect()))


def files(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def test_sealing_leaves_one_copy(spark, tmp_path, monkeypatch):
    samples, path = some(spark), str(tmp_path / "t")
    seal = lambda hours: stored.seal_rollups(samples, path, "1h", T0 + timedelta(hours=hours, seconds=31))
    want = lambda hours: shown(rollup.rollup(samples.where(F.col("ts") < F.lit(T0 + timedelta(hours=hours))), "1h"))
    assert stored.seal_rollups(samples.where("false"), path, "1h", T0) is None
    assert seal(5) == (T0, T0 + timedelta(hours=5)) and shown(stored.stored_rollups(spark, path)) == want(5)
    assert seal(5) is None and seal(4) is None
    seal(50)
    early = {f for f in files(tmp_path / "t") if "day=2024-05-01" in f}
    # a crash after the buckets, before the watermark
    real, calls = stored._replace_partitions, []

    def broken(rows, to, by):
        calls.append(to)
        if to.endswith("watermarks"):
            raise OSError("lost")
        real(rows, to, by)

    monkeypatch.setattr(stored, "_replace_partitions", broken)
    with pytest.raises(OSError):
        seal(60)
    monkeypatch.setattr(stored, "_replace_partitions", real)
    assert len(calls) == 2 and stored.watermark(spark, path, "1h") == T0 + timedelta(hours=50)
    assert seal(70)[0] == T0 + timedelta(hours=50) and shown(stored.stored_rollups(spark, path)) == want(70)
    # other resolutions are their own, and days before the range keep their files
    stored.seal_rollups(samples, path, "1d", T0 + timedelta(days=9))
    assert shown(stored.stored_rollups(spark, path).where("resolution = '1h'")) == want(70)
    assert early <= files(tmp_path / "t")


def test_retention_keeps_files(spark, tmp_path):
    samples, path = some(spark), tmp_path / "s"
    ingest.write_samples(samples, str(path))
    before, limit = files(path), T0 + timedelta(days=3, hours=7)
    assert stored.drop_before(spark, str(path), "ts", limit) == (3, 1)
    assert sorted(map(str, spark.read.parquet(str(path)).drop("day").collect())) == sorted(map(str, samples.where(F.col("ts") >= F.lit(limit)).collect()))
    kept = {f for f in before if "day=2024-05-0" in f and f.split("day=2024-05-0")[1][0] in "567"}
    assert kept and kept <= files(path) and not any(f"day=2024-05-0{d}" in f for f in files(path) for d in (1, 2, 3))
    again = files(path)
    assert stored.drop_before(spark, str(path), "ts", limit) == (0, 0) and files(path) == again
    # a crash after the old folder went, and one before the new one was whole
    (path / "day=2024-05-04").rename(path / ".day=2024-05-04.kept")
    (path / ".day=2024-05-06.kept").mkdir()
    assert stored.drop_before(spark, str(path), "ts", limit) == (0, 0) and {f.split("/")[-1] for f in files(path)} == {f.split("/")[-1] for f in again} and not list(path.glob(".day*"))
    # the limit on a day's first instant, and past all
    assert stored.drop_before(spark, str(path), "ts", T0 + timedelta(days=5)) == (2, 0)
    assert stored.drop_before(spark, str(path), "ts", T0 + timedelta(days=50))[1] == 0 and stored.day_folders(spark, str(path)) == []


def test_retention_of_rollups(spark, tmp_path):
    samples = some(spark)
    stored.seal_rollups(samples, str(tmp_path), "1h", T0 + timedelta(days=6))
    stored.seal_rollups(samples, str(tmp_path), "1d", T0 + timedelta(days=6))
    ingest.write_samples(samples, str(tmp_path / "samples"))
    got = stored.retain(spark, str(tmp_path / "samples"), str(tmp_path / "rollups"), T0 + timedelta(days=17, hours=6), raw_days=15, rollup_days=15)
    assert got["samples"] == (2, 1) and got["rollups"] == (5, 1)
    left = stored.stored_rollups(spark, str(tmp_path)).agg(F.min("bucket_ts")).first()[0]
    assert left.replace(tzinfo=timezone.utc) == T0 + timedelta(days=2, hours=6)


def test_week_from_hours(spark):
    rng = random.Random(8)
    rows = [(s, T0 + timedelta(minutes=3 * i), rng.lognormvariate(0, 2) if i % 50 else float("nan"), i) for s in (1, 2, 3) for i in range(3360)]
    samples = spark.createDataFrame(rows, schemas.STORED_SAMPLE)
    dim = spark.createDataFrame([(s, "o", "m", {"host": f"h{s % 2}"}, "", str(s), T0, T0) for s in (1, 2, 3)], schemas.SERIES)
    for k, room in ((800, 0.003), (65_535, 0.0)):
        buckets = sketches.sketch_rollup(samples, "1h", k)
        assert buckets.count() == 3 * 168 and buckets.agg(F.sum("value_count")).first()[0] == sum(r[2] == r[2] for r in rows)
        for table in (buckets, sketches.merge_sketches(buckets, "1d", k)):
            for q in (0.0, 0.5, 0.95, 1.0):
                for r in sketches.percentile_from_sketches(table, dim, T0, T0 + timedelta(days=7), q, ("org_id", "host"), k).collect():
                    own = sorted(v for s, _, v, _ in rows if f"h{s % 2}" == r.host and v == v)
                    rank = max(1, math.ceil(q * len(own)))
                    lo, hi = own[max(0, math.floor(rank - 1 - room * len(own)))], own[min(len(own) - 1, math.ceil(rank - 1 + room * len(own)))]
                    assert lo <= r.value <= hi, (k, q, r)
    assert sketches.percentile_from_sketches(sketches.sketch_rollup(samples.where("false")), dim, T0, T0, 0.5).count() == 0


def test_bitmaps_find_the_orphans(spark):
    """More series than a bitmap has bits, in one bucket, some numbered later."""
    n = presence.BITS + 500
    dim = spark.range(n).select((F.col("id") * 7919 - 99).alias("series_id"), F.lit("o").alias("org_id"))
    rows = dim.where("series_id % 3 <> 0 or series_id < 0").select("series_id", F.timestamp_seconds(F.col("series_id") % 400_000 + 1_700_000_000).alias("ts"))
    sums = dim.where("series_id % 3 = 0 and series_id % 2 = 0").select("series_id", F.lit(T0).alias("bucket_ts"))
    for buckets in (1, 5):
        early = presence.numbered_series(dim.where("series_id < 1000000"), buckets=buckets)
        numbers = presence.numbered_series(dim, early, buckets)
        kept = numbers.join(early, ["series_id", "bucket", "number"])
        assert numbers.count() == n == numbers.select("bucket", "number").distinct().count() and kept.count() == early.count()
        live = presence.live_days(rows, numbers)
        got = presence.orphans_by_day(dim, numbers, live, presence.live_days(sums, numbers, "bucket_ts"))
        want = series.orphan_series(dim, rows, sums)
        assert sorted(r.series_id for r in got.collect()) == sorted(r.series_id for r in want.collect())
    assert presence.orphans_by_day(dim, numbers, live.where("false")).count() == n
