"""Even ranges of a column's values, so that one task never orders all rows of a frequent key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def part_of(rows: DataFrame, column: str, parts: int = 64) -> Column:
    """The number of the range that a row's value lies in; greater values never lie in a lower range, null in range 0.

    The cuts come from a fixed number of rows drawn at random, so outliers and frequent
    values leave the ranges even. What is computed from ranges does not depend on where
    the cuts are.
    """
    drawn = rows.select(F.col(column).alias("v")).filter("v IS NOT NULL").orderBy(F.xxhash64(F.monotonically_increasing_id())).limit(32 * parts)
    values = [r["v"] for r in drawn.distinct().orderBy("v").collect()]
    cuts = values[:: max(1, len(values) // parts)][1:]
    kind = rows.select(column).schema[0].dataType.simpleString()
    return F.size(F.filter(F.coalesce(F.array(*map(F.lit, cuts)).cast(f"array<{kind}>"), F.array().cast(f"array<{kind}>")), lambda cut: cut <= F.col(column)))
