"""Array expressions: a value bound to a name, and running sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(lens: Column, first: Column) -> Column:
    """Sums of the earlier entries, from ``first`` on."""
    start = F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("o"))
    return F.aggregate(lens, start, lambda s, x: F.struct(
        (s["at"] + x).alias("at"), F.concat(s["o"], F.array(s["at"])).alias("o")), lambda s: s["o"])


def starts(lens: Column) -> Column:
    """Sum of the earlier entries of an array of int (of one entry at least):
    running sums inside blocks of ``BLOCK``, then over the blocks, so a long
    array is not copied for each of its entries."""
    def summed(v):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")),
                            lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        return bind(parts, lambda p: F.flatten(F.zip_with(
            p, _running(F.transform(p, lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + y)), F.lit(0)), _running)))

    return bind(lens, summed)
