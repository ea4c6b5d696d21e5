"""Arrival order of samples as one fixed-width value, so that aggregates by it are hashed and not sorted."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Above every difference of two seqs, so that an instant outweighs any seq.
_INSTANT = Decimal(2 * 10**19)
_LEAST = -(1 << 63)


def _long(c: Column) -> Column:
    return c.cast("decimal(19, 0)")


def newest(ts: str | Column = "ts", seq: str | Column = "seq") -> Column:
    """Orders by ts, then by seq, null first: a decimal(38). Instants may lie 150,000 years from 1970."""
    return _long(F.unix_micros(ts)) * F.lit(_INSTANT) + _long(F.coalesce(seq, F.lit(_LEAST)))


def newest_first_seq(ts: str | Column = "ts", seq: str | Column = "seq") -> Column:
    """Orders by ts, then by seq downwards, null first: the largest is the first arrival of the last instant."""
    return _long(F.unix_micros(ts)) * F.lit(_INSTANT) - F.coalesce(_long(F.col(seq) if isinstance(seq, str) else seq), F.lit(Decimal(1 << 63)))
