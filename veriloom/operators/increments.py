"""What is new in a batch: rows not seen, lines beyond a high-water mark, facts merged by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unseen(rows: DataFrame, seen: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` that no row of ``seen`` equals in all of ``by``."""
    return rows.join(seen.select(*by), by, "left_anti")


def beyond(rows: DataFrame, last: DataFrame, stored: DataFrame, key: str = "session_id", part: str = "file", seq: str = "seq") -> DataFrame:
    """``rows`` later than what is stored of their key, and than what parts before theirs bring.

    ``last`` has the last line (own) of each key and part, ``stored`` that of each key that
    is stored.  A part is a file; a session has few of them.
    """
    earlier = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    low = F.lit(-1).cast("long")
    through = F.greatest(F.coalesce("stored", low), F.coalesce(F.max("own").over(earlier), low))
    marks = last.join(stored, key, "left").select(key, part, through.alias("through"))
    return rows.join(marks, [key, part]).where(F.col(seq) > F.col("through")).drop("through")


def coalesced(old: DataFrame, new: DataFrame, key: str, first: tuple[str, ...] = (), fill: tuple[str, ...] = ()) -> DataFrame:
    """One row per key of either table: of ``first`` the old value stays, of ``fill`` it
    stays where the new one is null, and any other column takes the new row's value."""
    met = old.select(key, F.struct(*old.columns).alias("_old")).join(new.select(key, F.struct(*new.columns).alias("_new")), key, "full")
    was, has = F.col("_old").isNotNull(), F.col("_new").isNotNull()

    def value(c: str):
        if c in first:
            return F.when(was, F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}"))
        if c in fill:
            return F.coalesce(f"_new.{c}", f"_old.{c}")
        return F.when(has, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))

    return met.select(key, *[value(c).alias(c) for c in old.columns if c != key])
