"""Running sums and last values in order, also where one key has most of the rows.

A window gives each key to one task.  Here the order is cut into slices, at quantiles of a
number that follows the order, and a window runs within a key's slice; what the slices
before it bring (a sum, the last value) is one row for each key and slice, and is added by
a join.  Equal numbers stay in one slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key that one task takes, and slices at most.
ROWS, SLICES = 5_000_000, 256


def spread(rows: DataFrame, keys: list[str], each: int = ROWS, most: int = SLICES) -> int:
    """Slices that the largest key needs, for at most ``each`` rows or so in a task."""
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else rows.agg(F.count(F.lit(1)).alias("n"))
    largest = per.agg(F.max("n")).first()[0] or 0
    return min(most, max(1, -(-largest // each)))


def _sliced(rows: DataFrame, by: Column, slices: int) -> Column:
    """The number of cut points below ``by``; a null comes first in the order."""
    cuts = rows.agg(F.percentile_approx(by, [k / slices for k in range(1, slices)], F.lit(100 * slices))).first()[0] or []
    points = sorted({float(c) for c in cuts})

    def place(low: int, high: int) -> Column:
        # the points from low to high are open
        if low == high:
            return F.lit(low)
        half = (low + high) // 2
        return F.when(by > points[half], place(half + 1, high)).otherwise(place(low, half))

    return F.when(by.isNull(), 0).otherwise(place(0, len(points)))


def running(rows: DataFrame, keys: list[str], order: list, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, slices: int = 1, by: Column | None = None) -> DataFrame:
    """``rows`` with sums, and last values that are not null, up to and with each row.

    ``by`` is a number that does not fall in the order; the first column of the order if
    it is not given.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    sums, lasts = sums or {}, lasts or {}
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if slices <= 1:
        w = so_far(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumns({c: F.sum(v).over(w) for c, v in sums.items()} | {c: F.last(v, ignorenulls=True).over(w) for c, v in lasts.items()})
    by = (order[0] if by is None else by).cast("double")
    cut = rows.withColumn("_slice", _sliced(rows, by, slices))
    w = so_far(Window.partitionBy(*keys, "_slice").orderBy(*order))
    inner = cut.withColumns({f"_in_{c}": F.sum(v).over(w) for c, v in sums.items()} | {f"_in_{c}": F.last(v, ignorenulls=True).over(w) for c, v in lasts.items()})
    place = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])
    ends = cut.groupBy(*keys, "_slice").agg(*[F.sum(v).alias(f"_of_{c}") for c, v in sums.items()], *[F.max_by(v, F.when(v.isNotNull(), place)).alias(f"_of_{c}") for c, v in lasts.items()])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # SLICES rows for a key
    brought = ends.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col("_slice").alias("_key_slice"),
        *[F.coalesce(F.sum(f"_of_{c}").over(before), F.lit(0)).alias(f"_by_{c}") for c in sums],
        *[F.last(f"_of_{c}", ignorenulls=True).over(before).alias(f"_by_{c}") for c in lasts],
    )
    on = F.col("_slice") == F.col("_key_slice")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    met = inner.join(brought, on)
    return met.select(*rows.columns, *[(F.col(f"_in_{c}") + F.col(f"_by_{c}")).alias(c) for c in sums], *[F.coalesce(f"_in_{c}", f"_by_{c}").alias(c) for c in lasts])
