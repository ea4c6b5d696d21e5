"""Plans that must hold at any size: reads pruned by time, aggregates that hash."""

import random
import re
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fleetmetrics import schemas
from fleetmetrics.functions.order import newest, newest_first_seq
from fleetmetrics.operators import evaluate, gauges, query, rollup, series

DAY = datetime(2024, 3, 10, tzinfo=timezone.utc)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Ten days of samples of two series, stored by day."""
    path = str(tmp_path_factory.mktemp("stored") / "samples")
    rows = [(s, DAY + timedelta(minutes=4 * i), float(i % 50), i) for i in range(3600) for s in (1, 2)]
    spark.createDataFrame(rows, schemas.STORED_SAMPLE).withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(path)
    return path, rows


def one_tick(spark):
    return spark.createDataFrame([(DAY + timedelta(days=4, hours=12),)], "tick timestamp")


def rules_of(spark):
    t = ("o", "a", "A", "m > 1", "P1", 60, 60, 0, True, DAY, DAY)
    return spark.createDataFrame([t, (*t[:1], "b", "B", "sum(rate(m[10m])) > 0", *t[4:])], schemas.ALERT_RULE)


def dimension(spark):
    return spark.createDataFrame([(i, "o", "m", {"host": "h", "k": str(i)}, "", str(i), DAY, DAY) for i in (1, 2)], schemas.SERIES)


@pytest.mark.parametrize("read", [
    lambda s, t, _: evaluate.asof_latest(s, t), lambda s, t, _: evaluate.counter_increase(s, t, 600), lambda s, t, _: evaluate.counter_increase(s, t, 600, long_range=0),
    lambda s, t, d: evaluate.evaluate_rules(rules_of(s.sparkSession), s, d, t),
], ids=["asof", "increase", "running", "rules"])
def test_a_tick_reads_its_window(spark, stored, read):
    samples = spark.read.parquet(stored[0])
    got = read(samples, one_tick(spark), dimension(spark))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    scans = re.findall(r"\n\(\d+\) Scan parquet.*?\n\n", got._jdf.queryExecution().explainString(mode), re.S)
    assert scans
    for scan in scans:
        days, pushed = re.search(r"PartitionFilters: \[(.*?)\]\n", scan)[1], re.search(r"PushedFilters: \[(.*?)\]\n", scan)[1]
        assert ">= 2024-03-13" in days and "<= 2024-03-15" in days, scan
        assert "GreaterThanOrEqual(ts," in pushed and "LessThanOrEqual(ts," in pushed, scan
    whole = read(spark.createDataFrame(stored[1], schemas.STORED_SAMPLE), one_tick(spark), dimension(spark))
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect())) and whole.count() == 2


def test_aggregates_hash(spark, stored):
    samples = spark.read.parquet(stored[0]).drop("day")
    logical = spark.createDataFrame([("o", "m", {"host": "h"}, 1.0, DAY, 1)], schemas.SAMPLE)
    counters = spark.createDataFrame([("h", DAY, 0.5, 100, 50, 0, 0, 1, 1, 1, 1)], schemas.HOST_COUNTERS)
    empty, tick = spark.createDataFrame([], schemas.SERIES), one_tick(spark)
    rolled = rollup.rollup(samples, "1m")
    for df in (
        rolled, rollup.rollup_all(samples), rollup.merge_rollups(rolled, "1m", "1h"), rollup.reconcile_rollups(samples, rolled, "1m"), series.series_of(logical), series.resolve_series(logical, empty)[1],
        evaluate.asof_latest(samples, tick), evaluate.counter_steps(samples), query.latest_sample(samples, dimension(spark), "o"), gauges.network_rates(counters),
        series.normalise_flat_samples(spark.createDataFrame([("o", "h", "m", 1.0, DAY)], "org_id string, host string, metric string, metric_value double, ts timestamp"))[0],
    ):
        assert "SortAggregate" not in plan_of(df), plan_of(df)


def test_order_is_that_of_structs(spark):
    rng = random.Random(4)
    seqs = [None, 0, 1, -1, (1 << 63) - 1, -(1 << 63) + 1, 7]
    rows = [(DAY + timedelta(microseconds=rng.choice([0, 0, 1, -1, 10**12])) if rng.random() < 0.8 else datetime(1, 1, 2, tzinfo=timezone.utc), rng.choice(seqs), i) for i in range(400)]
    df = spark.createDataFrame(rows, "ts timestamp, seq long, i int").withColumn("g", F.col("i") % 60)
    got = df.groupBy("g").agg(*[F.max_by(F.struct("ts", "seq"), k).alias(n) for n, k in (("a", newest()), ("b", F.struct("ts", "seq")), ("c", newest_first_seq()), ("d", F.struct("ts", -F.col("seq"))))]).collect()
    assert all(r.a == r.b and r.c == r.d for r in got)


def test_all_resolutions_equal_each_alone(spark, stored):
    samples = spark.read.parquet(stored[0]).where("ts < '2024-03-11'")
    for names in (("1m", "5m", "1h"), ("2m", "5m", "1h"), ("1h",)):
        shown = lambda df: sorted((r.series_id, r.resolution, r.bucket_ts, r.sample_count, round(r.sum_value, 6), r.min_value, r.max_value, r.last_value) for r in df.collect())
        assert shown(rollup.rollup_all(samples, names)) == sorted(x for n in names for x in shown(rollup.rollup(samples, n)))


def test_many_shapes_are_one_plan(spark):
    """500 rules of 50 shapes: planned in seconds, no longer a plan than one rule has, and each right."""
    rows, want = [], {}
    for i in range(500):
        text, value, shape = "max(m)", 3.0, i % 50
        for b in range(6):
            op, c = "+-"[shape >> b & 1], (i + b) % 9 + 1
            text, value = f"({text} {op} {c})", value + c if op == "+" else value - c
        rows.append(("o", f"r{i}", f"{text} * 2 >= {i % 13}", True))
        want[f"r{i}"] = (value * 2 >= i % 13, value * 2)
    rules = spark.createDataFrame(rows, "org_id string, rule_key string, expression string, enabled boolean")
    dim = spark.createDataFrame([(i, "o", "m", {"host": "h", "k": str(i)}) for i in (1, 2)], "series_id long, org_id string, metric string, tags map<string,string>")
    samples = spark.createDataFrame([(i, DAY, float(i + 1), i) for i in (1, 2)], schemas.STORED_SAMPLE)
    ticks = spark.createDataFrame([(DAY,)], "tick timestamp")
    began = time.time()
    out = evaluate.evaluate_rules(rules, samples, dim, ticks)
    plan = plan_of(out)
    assert time.time() - began < 30  # with a job for the ticks and one for the ranges
    alone = plan_of(evaluate.evaluate_rules(rules.where("rule_key = 'r0'"), samples, dim, ticks))
    assert len(plan) < 1.1 * len(alone)
    assert {r.rule_key: (r.violating, r.observed) for r in out.collect()} == want
