"""Rules as DataFrame plans: one decision for each rule, active host and tick."""

from __future__ import annotations

import math
from collections.abc import Iterable
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetmetrics.functions.order import newest, newest_first_seq
from fleetmetrics.plans.rule_language import AGGREGATORS
from fleetmetrics.plans.rule_programs import programs

NAN = float("nan")
# Fixed value: the text of an evaluation error.
AMBIGUOUS = ("expression yields ", " series; wrap it in sum(), avg(), min() or max() to get a single value")


def nan() -> Column:
    return F.lit(NAN)


def tick_bounds(ticks: DataFrame) -> tuple[int, int] | None:
    """First and last tick in epoch microseconds; None without ticks."""
    lo, hi = ticks.agg(F.min(F.unix_micros("tick")), F.max(F.unix_micros("tick"))).first()
    return None if lo is None else (lo, hi)


def between_ticks(samples: DataFrame, bounds: tuple[int, int] | None, back_s: float) -> DataFrame:
    """Samples that some tick can see: from back_s before the first tick to the last one, as literals, so that a scan prunes by ts, and by day where the table has that column."""
    if bounds is None:
        return samples.where("false")
    start, end = (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us) for us in (bounds[0] - math.ceil(back_s * 1_000_000), bounds[1]))
    rows = samples.where((F.col("ts") >= F.lit(start)) & (F.col("ts") <= F.lit(end)))
    # a day partition is the date of ts in the session's zone, within 14 hours of the date in UTC
    day = lambda t, h: F.lit((t + timedelta(hours=h)).date())
    return rows.where(F.col("day").between(day(start, -14), day(end, 14))) if "day" in samples.columns else rows


def at_ticks(samples: DataFrame, ticks: DataFrame, back_s: float, step_s: int, bounds: tuple[int, int] | None = None) -> DataFrame:
    """samples once for each tick in [ts, ts + back_s], as tick_ms. Ticks lie on multiples of step_s seconds; bounds are tick_bounds(ticks).

    Each sample knows its ticks by arithmetic, so an as-of join is an equi-join: rows grow by back_s / step_s.
    """
    step, us = int(step_s * 1000), F.unix_micros("ts")
    first = F.ceil(us / (step * 1000)) * step
    last = F.floor((us + int(back_s * 1_000_000)) / (step * 1000)) * step
    bounds = bounds or tick_bounds(ticks)
    lo, hi = (b // 1000 for b in bounds or (0, -1000))
    rows = between_ticks(samples, bounds, back_s).withColumn("_a", F.greatest(first, F.lit(lo))).withColumn("_b", F.least(last, F.lit(hi))).where(F.col("_a") <= F.col("_b"))
    rows = rows.withColumn("tick_ms", F.explode(F.sequence(F.col("_a").cast("long"), F.col("_b").cast("long"), F.lit(step).cast("long")))).drop("_a", "_b")
    return rows.join(ticks.select(F.unix_millis("tick").alias("tick_ms")).distinct(), "tick_ms", "left_semi")


def asof_latest(samples: DataFrame, ticks: DataFrame, lookback_s: float = 90, step_s: int = 15) -> DataFrame:
    """(series_id, tick, value): the newest sample of each series in [tick - lookback, tick]; of equal instants the smallest seq's."""
    bounds = tick_bounds(ticks)
    rows = at_ticks(between_ticks(samples, bounds, lookback_s).select("series_id", "ts", "value", newest_first_seq().alias("_k")), ticks, lookback_s, step_s, bounds)
    found = rows.groupBy("series_id", "tick_ms").agg(F.max_by("value", "_k").alias("value"))
    return found.select("series_id", F.timestamp_millis("tick_ms").alias("tick"), "value")


def counter_steps(samples: DataFrame) -> DataFrame:
    """Stored samples with step and prev_ts: the rise since the series' sample before, or the value itself after a reset.

    A NaN difference counts as a reset. Windows are by series and day, so that a long series isn't one task; the last
    sample of the day before comes from a table of one row a series and day.
    """
    rows = samples.withColumn("_d", F.to_date("ts"))
    place = Window.partitionBy("series_id", "_d").orderBy("ts", "seq")
    last = F.struct("ts", "seq", "value")
    days = rows.groupBy("series_id", "_d").agg(*[F.max_by(c, newest()).alias(f"e_{c}") for c in ("ts", "seq", "value")])
    end = F.struct(*[F.col(f"e_{c}").alias(c) for c in ("ts", "seq", "value")])
    before = days.select("series_id", "_d", F.lag(end).over(Window.partitionBy("series_id").orderBy("_d")).alias("_p"))
    rows = rows.withColumn("_own", F.lag(last).over(place)).join(before, ["series_id", "_d"])
    prev = F.coalesce("_own", "_p")
    rise = F.col("value") - prev["value"]
    step = F.when(prev.isNull(), None).when((rise >= 0) & ~F.isnan(rise), rise).otherwise(F.col("value"))
    return rows.select(*samples.columns, step.alias("step"), prev["ts"].alias("prev_ts"))


#: Ticks in a range from which on running sums are cheaper than a row for each tick that a sample serves.
LONG_RANGE = 50


def counter_increase(samples: DataFrame, ticks: DataFrame, range_s: float, step_s: int = 15, long_range: int = LONG_RANGE) -> DataFrame:
    """(series_id, tick, value): the steps whose both ends lie in [tick - range, tick], summed; 0 for a single point.

    Ranges of more than `long_range` ticks are read from running sums, in rows of samples and ticks; others give each
    sample to the ticks that it serves. Samples that no tick's range can reach are left out first.
    """
    bounds = tick_bounds(ticks)
    samples = between_ticks(samples, bounds, range_s)
    if range_s / step_s > long_range:
        return _increase_by_running_sums(samples, ticks, range_s, step_s, bounds)
    rows = at_ticks(counter_steps(samples).select("series_id", "ts", "step", "prev_ts"), ticks, range_s, step_s, bounds)
    inside = F.unix_micros("prev_ts") >= F.col("tick_ms") * 1000 - int(range_s * 1_000_000)
    found = rows.groupBy("series_id", "tick_ms").agg(F.coalesce(F.sum(F.when(inside, F.col("step"))), F.lit(0.0)).alias("value"))
    return found.select("series_id", F.timestamp_millis("tick_ms").alias("tick"), "value")


#: Running amounts: finite steps summed; steps that are NaN, +inf and -inf counted, since a sum would not lose them again.
RUNNING = ("total", "nans", "ups", "downs")


def running_steps(samples: DataFrame) -> DataFrame:
    """(series_id, ts, seq, total, nans, ups, downs): the amounts of all steps of a series up to a sample, by day and then over days."""
    step = F.coalesce("step", F.lit(0.0))
    odd = [F.isnan(step), step == float("inf"), step == float("-inf")]
    amounts = [F.when(odd[0] | odd[1] | odd[2], 0.0).otherwise(step), *[o.cast("long") for o in odd]]
    rows = counter_steps(samples).select("series_id", "ts", "seq", F.to_date("ts").alias("_d"), *[c.alias(n) for n, c in zip(RUNNING, amounts)])
    days = rows.groupBy("series_id", "_d").agg(*[F.sum(n).alias(f"d_{n}") for n in RUNNING])
    earlier = Window.partitionBy("series_id").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select("series_id", "_d", *[F.coalesce(F.sum(f"d_{n}").over(earlier), F.lit(0)).alias(f"b_{n}") for n in RUNNING])
    upto = Window.partitionBy("series_id", "_d").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("series_id", "ts", "seq", "_d", *[F.sum(n).over(upto).alias(n) for n in RUNNING]).join(before, ["series_id", "_d"])
    return rows.select("series_id", "ts", "seq", *[(F.col(n) + F.col(f"b_{n}")).alias(n) for n in RUNNING])


def _increase_by_running_sums(samples: DataFrame, ticks: DataFrame, range_s: float, step_s: int, ends: tuple[int, int] | None) -> DataFrame:
    """The amount at the last sample up to a tick, less that at the first sample in the range before it.

    Both are found on the grid of ticks: a sample is the last one for the first tick at or after it, unless a later one
    is, and the first one for the last tick whose range reaches it. Gaps are filled over the ticks of a series.
    """
    us, step, back = F.unix_micros("ts"), int(step_s * 1_000_000), int(range_s * 1_000_000)
    own = F.struct("ts", "seq", *RUNNING)
    sums = running_steps(samples).select("series_id", own.alias("s"), F.ceil(us / step).cast("long").alias("up"), F.floor((us + back) / step).cast("long").alias("down"))
    none = F.lit(None).cast(sums.schema["s"].dataType)
    last = sums.groupBy("series_id", F.col("up").alias("k")).agg(F.max("s").alias("hi")).withColumn("lo", none)
    first = sums.groupBy("series_id", F.col("down").alias("k")).agg(F.min("s").alias("lo")).withColumn("hi", none)
    if ends is None:
        return sums.select("series_id", F.lit(None).cast("timestamp").alias("tick"), F.lit(0.0).alias("value")).where("false")
    lives = sums.groupBy("series_id").agg(F.greatest(F.min("up"), F.lit(-(-ends[0] // step))).alias("a"), F.least(F.max("down"), F.lit(ends[1] // step)).alias("b")).where("a <= b")
    grid = lives.select("series_id", F.explode(F.sequence("a", "b")).alias("k")).select("series_id", "k", none.alias("hi"), none.alias("lo"))
    rows = last.unionByName(first).unionByName(grid).groupBy("series_id", "k").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    by = Window.partitionBy("series_id").orderBy("k")
    hi = F.last("hi", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    lo = F.first("lo", ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    at = rows.select("series_id", F.timestamp_micros(F.col("k") * step).alias("tick"), hi.alias("hi"), lo.alias("lo"))
    at = at.where((F.unix_micros("hi.ts") >= F.unix_micros("tick") - back) & F.col("lo").isNotNull())
    at = at.join(ticks.select("tick").distinct(), "tick", "left_semi")
    grown = {n: F.col(f"hi.{n}") - F.col(f"lo.{n}") for n in RUNNING}
    value = F.when((grown["nans"] > 0) | ((grown["ups"] > 0) & (grown["downs"] > 0)), nan()).when(grown["ups"] > 0, float("inf")).when(grown["downs"] > 0, float("-inf")).otherwise(grown["total"])
    return at.select("series_id", "tick", value.alias("value"))


def counter_rate(samples: DataFrame, ticks: DataFrame, range_s: float, step_s: int = 15) -> DataFrame:
    """counter_increase per second of the whole range; no extrapolation."""
    return counter_increase(samples, ticks, range_s, step_s).withColumn("value", F.col("value") / float(range_s))


def aggregates(value: Column, present: Column) -> dict[str, Column]:
    """Partial aggregates of the values where present: sum, avg, min, max, count, and one of them. NaN in gives NaN out."""
    v = F.when(present, value)
    bad = F.bool_or(F.when(present, F.isnan(value)))
    guard = lambda c: F.when(bad, nan()).otherwise(c)
    return {"sum": F.sum(v), "avg": F.avg(v), "min": guard(F.min(v)), "max": guard(F.max(v)), "count": F.count(v), "one": F.first(v, ignorenulls=True)}


def vector_agg(vector: DataFrame, fn: str, keys: Iterable[str] = ("rule_key", "host", "tick")) -> DataFrame:
    """(keys, value): sum, avg, min, max or count over the series of each key."""
    picked = aggregates(F.col("value"), F.lit(True))[fn]
    return vector.groupBy(*keys).agg(picked.cast("double").alias("value"))


def combine_scalars(leaf_values: DataFrame) -> DataFrame:
    """One row for each (rule_key, host, tick) with `values`, a map of leaf_id to value: every operand in one aggregation."""
    entries = F.collect_list(F.struct("leaf_id", "value"))
    return leaf_values.groupBy("rule_key", "host", "tick").agg(F.map_from_entries(entries).alias("values"))


#: The single value of an operator: v is null for no data, e is null unless the evaluation failed.
_VALUE = "struct<v: double, e: string>"


def _operator(done: Column, node: Column, leaves: Column) -> Column:
    """The value of an operator, from those done before it and the leaves of its rule that have data."""
    of = lambda v, e=None: F.struct(v.cast("double").alias("v"), (F.lit(None).cast("string") if e is None else e).alias("e"))
    left, right, none = F.get(done, node["left"]), F.get(done, node["right"]), F.lit(None).cast("double")
    leaf = F.get(F.filter(leaves, lambda x: x["slot"] == node["leaf"]), F.lit(0))
    a, b, op = left["v"], right["v"], node["op"]
    n = F.coalesce(leaf["count"], F.lit(0))
    many = F.concat(F.lit(AMBIGUOUS[0]), n.cast("string"), F.lit(AMBIGUOUS[1]))
    said = F.coalesce(left["e"], right["e"])
    out = F.when(op == "number", of(node["number"])).when(op == "one", of(F.when(n == 1, leaf["one"]), F.when(n > 1, many)))
    for fn in AGGREGATORS:
        out = out.when(op == fn, of(F.when(n == 0, nan()).otherwise(leaf[fn].cast("double"))))
    out = out.when(op == "same", left).when(op == "unit", of(F.lit(1.0), left["e"])).when(op == "fails", of(none, node["text"]))
    done_ = {"+": a + b, "-": a - b, "*": a * b, "/": F.when(b == 0, nan()).otherwise(a / F.nullif(b, F.lit(0.0)))}
    for sign, value in done_.items():
        out = out.when(op == sign, of(F.when(a.isNull() | b.isNull(), nan()).otherwise(value), said))
    known = said.isNull() & a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    for sign, hit in {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b, "==": a == b, "!=": a != b}.items():
        out = out.when(op == sign, of(F.when(known, hit.cast("double")).otherwise(nan()), said))
    return out


def run_programs(nodes: Column, leaves: Column) -> Column:
    """Values of a rule's operators in turn, each read from those before it: one expression for rules of every shape."""
    none = F.array().cast(f"array<{_VALUE}>")
    return F.aggregate(nodes, none, lambda done, node: F.concat(done, F.array(_operator(done, node, leaves).cast(_VALUE))))


def rule_host_pairs(rules: DataFrame, hosts: DataFrame) -> DataFrame:
    """(org_id, rule_key, host): every enabled rule with every host of its tenant."""
    return rules.where("enabled").select("org_id", "rule_key").join(hosts.select("org_id", "host").distinct(), "org_id")


def _host_ticks(samples: DataFrame, series: DataFrame, ticks: DataFrame, active_s: float | None, step_s: int) -> DataFrame:
    """(org_id, host, tick) of hosts heard of in the active_s seconds before a tick; all hosts at all ticks for None."""
    named = series.select("series_id", "org_id", F.try_element_at("tags", F.lit("host")).alias("host")).where("host <> ''")
    if active_s is None:
        every = [r[0] for r in ticks.select(F.unix_millis("tick")).distinct().collect()]
        return named.select("org_id", "host").distinct().select("org_id", "host", F.explode(F.lit(every)).alias("ms")).select("org_id", "host", F.timestamp_millis("ms").alias("tick"))
    # newest instants first by day and series, so a busy series adds few rows
    step, bounds = int(step_s * 1000), tick_bounds(ticks)
    sparse = between_ticks(samples, bounds, active_s).groupBy("series_id", F.floor(F.unix_millis("ts") / step).alias("_b")).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    ends = sparse.select("series_id", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("ts"))
    seen = at_ticks(ends.join(named, "series_id").select("org_id", "host", "ts"), ticks, active_s, step_s, bounds)
    return seen.select("org_id", "host", F.timestamp_millis("tick_ms").alias("tick")).distinct()


def evaluate_rules(
    rules: DataFrame, samples: DataFrame, series: DataFrame, ticks: DataFrame, lookback_s: float = 90, active_s: float | None = 300, step_s: int = 15
) -> DataFrame:
    """(org_id, rule_key, host, tick, violating, observed, error) of each enabled rule, active host of its tenant, and tick.

    violating is null for no decision: no data, NaN, or an error, which is a text and stops no other row. Rules are read
    in tasks to rows of operators and leaves. All leaves of all rules are one pass over the samples for instants and one
    for each different range; the operators of a rule are folded over the leaves' values. So the plan is the same for
    one rule and for very many, of whatever shapes; only the different ranges come to the driver.
    """
    live = rules.where("enabled")
    read = programs(live)
    read = read.select("expression", F.coalesce("problem", "regex").alias("broken"), *[F.when(F.coalesce("problem", "regex").isNull(), F.col(c)).alias(c) for c in ("leaves", "nodes")])
    slots = read.select("expression", F.posexplode("leaves").alias("slot", "leaf"))
    values = _leaf_values(slots.select("leaf").distinct(), samples, series, ticks, lookback_s, step_s)
    hosts = _host_ticks(samples, series, ticks, active_s, step_s)
    by = ["org_id", "host", "tick", "expression"]
    named = ("sum", "avg", "min", "max", "count", "one")
    told = values.join(slots, "leaf").groupBy(*by).agg(F.collect_list(F.struct("slot", *named)).alias("found"))
    rows = hosts.join(live.select("org_id", "rule_key", "expression"), "org_id")
    rows = rows.join(read.select(F.col("expression").alias("_e"), "broken", "nodes"), F.col("expression").eqNullSafe(F.col("_e"))).drop("_e").join(told, by, "left")
    found = F.coalesce("found", F.array().cast(dict(told.dtypes)["found"]))
    rows = rows.withColumn("_v", run_programs(F.coalesce("nodes", F.array().cast(dict(read.dtypes)["nodes"])), found))
    top = F.element_at("nodes", -1)
    root, left = F.get("_v", F.size("_v") - 1), F.get("_v", top["left"])["v"]
    hit = F.when(F.col("broken").isNull() & root["e"].isNull() & ~F.isnan(root["v"]), root["v"] == 1)
    observed = F.when(F.col("broken").isNull() & root["e"].isNull() & ~F.isnan(left), left)
    return rows.select("org_id", "rule_key", "host", "tick", hit.alias("violating"), observed.alias("observed"), F.coalesce("broken", root["e"]).alias("error"))


def _leaf_values(leaves: DataFrame, samples: DataFrame, series: DataFrame, ticks: DataFrame, lookback_s: float, step_s: int) -> DataFrame:
    """(org_id, host, tick, leaf, sum, avg, min, max, count, one): each leaf over the host's series. Leaves are rows, not columns."""

    def fits(m: Column) -> Column:
        actual = F.coalesce(F.try_element_at("tags", m["label"]), F.lit(""))
        hit = F.when(m["op"].contains("~"), F.rlike(actual, m["value"])).otherwise(actual == m["value"])
        return hit != m["op"].startswith("!")

    host = F.try_element_at("tags", F.lit("host")).alias("host")
    # the leaves are as few as the rules' selectors, and join the series only
    chosen = series.select("series_id", "org_id", "metric", "tags", host).where("host is not null")
    chosen = chosen.join(leaves.select("leaf", F.col("leaf.metric").alias("metric"), F.col("leaf.matchers").alias("matchers")), "metric").where(F.forall("matchers", fits))
    ranges = [r[0] for r in leaves.select("leaf.range_ms").distinct().collect()]
    parts = []
    for range_ms in ranges or [None]:
        own = chosen.where(F.col("leaf.range_ms").eqNullSafe(F.lit(range_ms))).select("series_id", "org_id", "host", "leaf")
        used = samples.join(own.select("series_id").distinct(), "series_id", "left_semi")
        values = asof_latest(used, ticks, lookback_s, step_s) if range_ms is None else counter_increase(used, ticks, range_ms / 1000, step_s)
        value = F.when(F.col("leaf.per_s"), F.col("value") / ((range_ms or 1000) / 1000)).otherwise(F.col("value"))
        parts.append(values.join(own, "series_id").select("org_id", "host", "tick", "leaf", value.alias("value")))
    cols = [c.alias(n) for n, c in aggregates(F.col("value"), F.lit(True)).items()]
    return reduce(DataFrame.unionByName, parts).groupBy("org_id", "host", "tick", "leaf").agg(*cols)
