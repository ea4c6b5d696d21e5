"""Questions about stored samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetmetrics.functions.order import newest_first_seq


def host_column():
    return F.coalesce(F.try_element_at("tags", F.lit("host")), F.lit(""))


def scope_host(df: DataFrame, host: str | None = None) -> DataFrame:
    """Rows whose host tag is exactly `host`; None means every host."""
    return df if host is None else df.where(F.try_element_at("tags", F.lit("host")) == host)


def raw_between(samples: DataFrame, from_ts, to_ts) -> DataFrame:
    """Samples in [from_ts, to_ts). Where the table is stored by day, whole days are pruned by the day column."""
    rows = samples.where((F.col("ts") >= F.lit(from_ts)) & (F.col("ts") < F.lit(to_ts)))
    if "day" in samples.columns:
        rows = rows.where(F.col("day").between(F.to_date(F.lit(from_ts)), F.to_date(F.lit(to_ts))))
    return rows


def samples_for(samples: DataFrame, series: DataFrame, from_ts, to_ts) -> DataFrame:
    """Samples of the given series in [from_ts, to_ts]; no series, no samples."""
    rows = samples.where(F.col("ts").between(F.lit(from_ts), F.lit(to_ts)))
    return rows.join(series.select("series_id").distinct(), "series_id", "left_semi").select(*samples.columns)


def latest_sample(samples: DataFrame, series: DataFrame, org_id: str, metric: str | None = None, host: str | None = None) -> DataFrame:
    """The newest sample of each (org_id, metric, host) asked for, with its full tags; of equal instants the smallest seq's."""
    wanted = scope_host(series.where(F.col("org_id") == org_id), host)
    if metric is not None:
        wanted = wanted.where(F.col("metric") == metric)
    rows = samples.join(wanted.select("series_id", "org_id", "metric", host_column().alias("host")), "series_id").withColumn("_k", newest_first_seq())
    newest = rows.groupBy("org_id", "metric", "host").agg(*[F.max_by(c, "_k").alias(c) for c in ("series_id", "value", "ts")])
    return newest.join(wanted.select("series_id", "series_key", "tags"), "series_id").select("org_id", "metric", "host", "series_key", "tags", "value", "ts")


def percentile(samples: DataFrame, series: DataFrame, since, q: float, keys: Sequence[str] = ("org_id", "metric", "host"), near: int = 1000) -> DataFrame:
    """(keys, value): nearest rank of the values of all series of a key from `since` on: rank ceil(q * n), at least 1, at most n.

    A mergeable summary brackets the rank first, by 2 / near of the key's rows on either side. Rows below the bracket are
    only counted, and just those inside are ranked, so a key with a third of all rows is no single task. Where the
    bracket misses the rank, as NaN values can make it, all rows of the key are ranked.
    """
    rows = samples.where(F.col("ts") >= F.lit(since)).join(series.select("series_id", "org_id", "metric", host_column().alias("host")), "series_id").select(*keys, "value")
    finite = F.when(~F.isnan("value"), F.col("value"))
    cuts = F.percentile_approx(finite, [min(max(q + s * 2 / near, 0.0), 1.0) for s in (-1, 1)], near)
    ends = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("n"), cuts.alias("cuts")).select("*", F.get("cuts", F.lit(0)).alias("lo"), F.get("cuts", F.lit(1)).alias("hi")).drop("cuts")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    inside = F.col("value").between(F.col("lo"), F.col("hi"))
    own = [F.col(f"_{k}") for k in keys]
    held = rows.join(ends, same).groupBy(*own, "n", "lo", "hi").agg(F.count_if(F.col("value") < F.col("lo")).alias("below"), F.count_if(inside).alias("held"))
    rank = F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.lit(float(q)) * F.col("n"))))
    fits = F.coalesce((F.col("below") < rank) & (rank <= F.col("below") + F.col("held")), F.lit(False))
    plan = held.select(*own, "lo", "hi", "n", fits.alias("fits"), F.when(fits, F.col("below")).otherwise(0).alias("below"))
    counts = rows.join(plan, same).where(~F.col("fits") | inside).groupBy(*own, "n", "below", "value").agg(F.count("*").alias("c"))
    ranked = counts.withColumn("upto", F.col("below") + F.sum("c").over(Window.partitionBy(*own).orderBy("value")))
    return ranked.where((F.col("upto") >= rank) & (F.col("upto") - F.col("c") < rank)).select(*[F.col(f"_{k}").alias(k) for k in keys], "value")


def percentile_sketch(samples: DataFrame, keys: Sequence[str], q: float, accuracy: int = 10_000) -> DataFrame:
    """(keys, value), approximate: mergeable summaries with a rank error of 1 / accuracy; partial, so no key is a bottleneck."""
    return samples.groupBy(*keys).agg(F.percentile_approx("value", min(max(q, 0.0), 1.0), accuracy).alias("value"))


def totals(samples: DataFrame, rollups: DataFrame, series: DataFrame) -> DataFrame:
    """One row: counts of samples, rollups and series, and the first and last instant."""
    none, ts = F.lit(0).cast("long"), F.lit(None).cast("timestamp")
    parts = [
        samples.agg(F.count("*").alias("a"), none.alias("b"), none.alias("c"), F.min("ts").alias("lo"), F.max("ts").alias("hi")),
        rollups.agg(none.alias("a"), F.count("*").alias("b"), none.alias("c"), ts.alias("lo"), ts.alias("hi")),
        series.agg(none.alias("a"), none.alias("b"), F.count("*").alias("c"), ts.alias("lo"), ts.alias("hi")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.agg(
        F.sum("a").alias("total_samples"), F.sum("b").alias("total_rollups"), F.sum("c").alias("series_count"),
        F.min("lo").alias("oldest_sample_at"), F.max("hi").alias("last_sample_at"),
    )
