"""Folds over an array that give a row for each element, for long arrays too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows that are appended at a time: a long result isn't copied for each row.
RUN = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Callable[[Column], Column]]], state: str, row: str) -> Column:
    """The rows of a fold. step(state, item) gives the row's struct, and how the next state is read from the row.

    state and row are the fields of the two structs. Rows are gathered 64 at a time and then joined, so n rows cost n * n / 64 copied references.
    """
    held, rows = f"struct<m: struct<{state}>, rows: array<struct<{row}>>>", f"array<struct<{row}>>"
    pack = lambda m, out: F.struct(m.cast(f"struct<{state}>").alias("m"), out.alias("rows")).cast(held)
    none = F.array().cast(rows)

    def one(acc: Column, x: Column) -> Column:
        made, after = step(acc["m"], x)
        return let(made.cast(f"struct<{row}>"), lambda r: pack(after(r), F.concat(acc["rows"], F.array(r))))

    def some(acc: Column, i: Column) -> Column:
        return let(F.aggregate(F.slice(items, i * RUN + 1, F.lit(RUN)), pack(acc["m"], none), one), lambda part: pack(part["m"], F.concat(acc["rows"], part["rows"])))

    parts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(parts, pack(start, none), some)["rows"]
