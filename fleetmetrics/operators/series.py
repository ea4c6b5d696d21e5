"""Series: the dimension of metric, tenant and tags that samples belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetmetrics.functions.tags import canonical_tags, parse_tags, series_id, series_key

COLUMNS = ["series_id", "org_id", "metric", "tags", "tags_text", "series_key", "first_seen", "last_seen"]


def with_series_key(samples: DataFrame) -> DataFrame:
    """samples with tags_text and series_key."""
    text = canonical_tags(F.col("tags"))
    return samples.withColumn("tags_text", text).withColumn("series_key", series_key(F.col("org_id"), F.col("metric"), F.col("tags_text")))


def series_of(samples: DataFrame) -> DataFrame:
    """One row for each series of (org_id, metric, tags, ts), with its first and last event time.

    A series is known by its key, so its tags are those that the key's text gives back; only times are aggregated.
    """
    keyed = with_series_key(samples)
    seen = keyed.groupBy("series_key", "org_id", "metric", "tags_text").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return seen.withColumn("tags", parse_tags(F.col("tags_text"))).withColumn("series_id", series_id(F.col("series_key"))).select(*COLUMNS)


def series_seen(registry: DataFrame, samples: DataFrame) -> DataFrame:
    """The registry with first_seen and last_seen widened by stored samples (series_id, ts); other samples are ignored."""
    seen = samples.groupBy("series_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    both = registry.join(seen, "series_id", "left")
    return both.withColumn("first_seen", F.least("first_seen", "lo")).withColumn("last_seen", F.greatest("last_seen", "hi")).select(*registry.columns)


def resolve_series(samples: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored samples, grown registry) of logical samples.

    Ids are hashes of the series key, so neither side needs the other to be numbered; the join below only finds
    which keys are new. Reading the registry raises if two of its keys have one id.
    """
    keyed = with_series_key(samples).withColumn("series_id", series_id(F.col("series_key")))
    stored = keyed.select("series_id", "ts", "value", "seq")
    found = series_of(samples)
    grown = found.join(registry.select("series_key"), "series_key", "left_anti").select(*COLUMNS)
    known = registry.join(found.select("series_key", F.col("first_seen").alias("lo"), F.col("last_seen").alias("hi")), "series_key", "left")
    known = known.withColumn("first_seen", F.least("first_seen", "lo")).withColumn("last_seen", F.greatest("last_seen", "hi")).select(*COLUMNS)
    return stored, _with_own_ids(known.unionByName(grown))


def _with_own_ids(registry: DataFrame) -> DataFrame:
    """The registry, whose rows raise where an id has two of them."""
    text = F.concat(F.lit("two series share the id of "), F.col("series_key"))
    own = registry.groupBy("series_id").agg(F.count("*").alias("_n"))
    alone = F.when(F.col("_n") > 1, F.raise_error(text).cast("boolean")).otherwise(F.lit(True))
    return registry.join(own, "series_id").where(alone).select(*registry.columns)


def id_collisions(registry: DataFrame) -> DataFrame:
    """Ids that stand for more than one key; empty unless 64 bits were not enough."""
    return registry.groupBy("series_id").agg(F.count_distinct("series_key").alias("keys")).where("keys > 1")


def normalise_flat_samples(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(series, stored samples) of flat (org_id, host, metric, metric_value, ts); the host becomes the one tag."""
    samples = flat.where("org_id is not null and metric is not null and host is not null").select(
        "org_id", "metric", F.create_map(F.lit("host"), F.col("host")).alias("tags"), F.col("metric_value").alias("value"), "ts",
        (F.col("seq") if "seq" in flat.columns else F.lit(None).cast("long")).alias("seq"),
    )
    keyed = with_series_key(samples)
    return series_of(samples), keyed.select(series_id(F.col("series_key")).alias("series_id"), "ts", "value", "seq")


def samples_with_series(samples: DataFrame, series: DataFrame) -> DataFrame:
    """Stored samples with the columns of their series; samples of unknown series go. Adaptive execution broadcasts a small dimension."""
    return samples.join(series, "series_id")


def find_series(series: DataFrame, org_id: str, metric: str) -> DataFrame:
    return series.where((F.col("org_id") == org_id) & (F.col("metric") == metric))


def active_hosts(series: DataFrame, since, org_id: str | None = None, metric: str | None = None) -> DataFrame:
    """Distinct (org_id, host) of series seen at or after `since`, empty hosts left out."""
    rows = series.where(F.col("last_seen") >= F.lit(since))
    if org_id is not None:
        rows = rows.where(F.col("org_id") == org_id)
    if metric is not None:
        rows = rows.where(F.col("metric") == metric)
    return rows.select("org_id", F.try_element_at("tags", F.lit("host")).alias("host")).where("host <> ''").distinct()


def orphan_series(series: DataFrame, samples: DataFrame, rollups: DataFrame) -> DataFrame:
    """Series that neither a sample nor a rollup names."""
    used = samples.select("series_id").distinct().unionByName(rollups.select("series_id").distinct())
    return series.join(used, "series_id", "left_anti").select(*series.columns)
