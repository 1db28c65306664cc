"""Array expressions that keep work inside the row, so no shuffle is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SLICE = 256


def _prefix(values: Column) -> Column:
    """[0, v1, v1+v2, ...]: one element longer than the input."""
    return F.aggregate(
        values,
        F.array(F.lit(0).cast("bigint")),
        lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)),
    )


def with_starts(rows: DataFrame, pieces: str, out: str) -> DataFrame:
    """Add the offset of each text piece: exclusive prefix sums of the lengths.

    Sums run inside slices of the array and over the slice totals, so a long array costs
    little more than a short one.
    """
    slices = F.sequence(
        F.lit(0), F.greatest(F.lit(0), F.floor((F.size(pieces) - 1) / _SLICE)).cast("int")
    )

    def inside(k: Column) -> Column:
        part = F.slice(pieces, k * _SLICE + 1, F.lit(_SLICE))
        return _prefix(F.transform(part, lambda x: F.length(x).cast("bigint")))

    local = rows.withColumn("__local", F.transform(slices, inside))
    base = F.slice(_prefix(F.transform("__local", lambda p: F.element_at(p, -1))), F.lit(1), F.size("__local"))

    def shifted(p: Column, b: Column) -> Column:
        return F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda v: v + b)

    # beside the slices, so that it is not computed again for every element
    return local.withColumn(out, F.flatten(F.zip_with("__local", base, shifted))).drop("__local")
