"""Instants, durations and buckets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_MS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def duration_ms(text: str) -> int:
    """Milliseconds of a duration such as 5m; a fractional amount is cut to a whole one."""
    m = re.fullmatch(r"([0-9.]+)(ms|[smhdw])", text)
    if not m:
        raise ValueError(f"unknown duration '{text}'")
    return int(float(m[1])) * UNIT_MS[m[2]]


def to_event_time(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def floor_ts(ts: Column, resolution: str) -> Column:
    """Start of the bucket that holds ts, before 1970 too."""
    ms, step = F.unix_millis(ts), duration_ms(resolution)
    return F.timestamp_millis(ms - F.pmod(ms, F.lit(step)))
