"""Limits on what a batch may bring, as columns that hold the reason of a refusal or null."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Defaults of the operating limits."""

    max_points: int = 5_000
    max_name: int = 255
    max_tag_keys: int = 10
    max_tag_key: int = 64
    max_tag_value: int = 128
    max_series: int = 10_000


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.regexp_replace(c, r"\p{javaWhitespace}+", "") == "")


# The texts of refusals.
NO_NAME = "metric name is required"
LONG_NAME = "metric name exceeds %d chars"
MANY_TAGS = ("metric '", "' has ", " tags, limit is ")
BLANK_KEY = ("empty tag key on metric '", "'")
LONG_KEY = ("tag key '", "' exceeds %d chars")
NULL_VALUE = ("tag '", "' has a null value")
LONG_VALUE = ("tag '", "' value exceeds %d chars")
NO_BUDGET = ("active series budget reached (%d) — refusing to create new series for '", "'")
NO_HOST = "host is required"
BAD_TOKEN = "invalid or missing agent token"
MANY_POINTS = "batch exceeds %d points"
CARDINALITY = "cardinality: "


def cardinality_reason(metric: Column, tags: Column, limits: Limits = Limits()) -> Column:
    """The first limit that a point breaks, null if none. Tags are looked at by ascending key."""
    entries = F.array_sort(F.map_entries(tags))

    def of_tag(e: Column) -> Column:
        key, value = e["key"], e["value"]
        return (
            F.when(is_blank(key), F.concat(F.lit(BLANK_KEY[0]), metric, F.lit(BLANK_KEY[1])))
            .when(F.length(key) > limits.max_tag_key, F.concat(F.lit(LONG_KEY[0]), key, F.lit(LONG_KEY[1] % limits.max_tag_key)))
            .when(value.isNull(), F.concat(F.lit(NULL_VALUE[0]), key, F.lit(NULL_VALUE[1])))
            .when(F.length(value) > limits.max_tag_value, F.concat(F.lit(LONG_VALUE[0]), key, F.lit(LONG_VALUE[1] % limits.max_tag_value)))
        )

    many = F.concat(F.lit(MANY_TAGS[0]), metric, F.lit(MANY_TAGS[1]), F.size(tags).cast("string"), F.lit(f"{MANY_TAGS[2]}{limits.max_tag_keys}"))
    return (
        F.when(is_blank(metric), F.lit(NO_NAME))
        .when(F.length(metric) > limits.max_name, F.lit(LONG_NAME % limits.max_name))
        .when(F.size(tags) > limits.max_tag_keys, many)
        .otherwise(F.get(F.filter(F.transform(entries, of_tag), lambda r: r.isNotNull()), F.lit(0)))
    )
