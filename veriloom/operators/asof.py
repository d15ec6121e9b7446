"""As-of and later-existence joins of claims with runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.operators.ordered import running


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], order: str, tie: Column | str, value: list[str], into: str, slices: int = 1) -> DataFrame:
    """``left`` with a struct ``into`` of the last ``right`` row at or before it.

    Both sides go through one shuffle on the keys: their rows are put in one order
    (right rows first at the same place), and the last right value so far is kept.  With
    ``slices`` a key of many rows is cut along a numeric ``order``, see ``ordered``.
    """
    tie = F.col(tie) if isinstance(tie, str) else tie
    lefts = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(order).alias("_at"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_tie"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(F.struct(*value).alias("x")).schema["x"].dataType).alias("_value"))
    rights = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(order).alias("_at"), F.lit(0).alias("_side"), tie.cast("long").alias("_tie"), F.lit(None).cast(lefts.schema["_row"].dataType).alias("_row"), F.struct(*value).alias("_value"))
    met = running(lefts.unionByName(rights), [f"_k{i}" for i in range(len(keys))], ["_at", "_side", "_tie"], lasts={"_last": F.col("_value")}, slices=slices).where("_side = 1")
    return met.select("_row.*", F.col("_last").alias(into))
