"""Small helpers for expressions over arrays inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def prefix_sums(xs: Column) -> Column:
    """Inclusive running sums of an array, in two levels so that long arrays stay cheap."""

    def within(starts_and_values: Column) -> Column:
        starts, values = starts_and_values["starts"], starts_and_values["values"]
        return F.transform(
            values,
            lambda _, i: F.get(starts, F.floor(i / BLOCK).cast("int"))
            + total(F.slice(values, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1)),
        )

    def two_levels(values: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: total(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))
        starts = bind(sums, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))
        return bind(F.struct(starts.alias("starts"), values.alias("values")), within)

    return F.when(F.size(xs) > 0, bind(xs, two_levels)).otherwise(F.array().cast("array<bigint>"))
