"""One hash chain over all events, as stores of version 2 have it: verification only.

Rows are checked in parallel within ranges of ids, and ranges by one row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.operators.chain import GENESIS, link

RANGE = 1 << 16


def line_breaks(rows: DataFrame) -> DataFrame:
    """id, seq, expected, found of every row that does not follow from the one before it."""
    rows = rows.select("id", "seq", "payload", "prev_hash", "hash", F.floor(F.col("id") / RANGE).alias("range"))
    last = rows.groupBy("range").agg(F.max_by("hash", "id").alias("last"))
    # one row per RANGE events
    ends = last.select("range", F.coalesce(F.lag("last").over(Window.orderBy("range")), F.lit(GENESIS)).alias("entry"))
    met = rows.withColumn("before", F.lag("hash").over(Window.partitionBy("range").orderBy("id"))).join(F.broadcast(ends), "range")
    before, made = F.coalesce("before", "entry"), link(F.col("prev_hash"), F.col("payload"))
    wrong = F.when(F.col("prev_hash") != before, F.struct(before.alias("expected"), F.col("prev_hash").alias("found"))).when(made != F.col("hash"), F.struct(made.alias("expected"), F.col("hash").alias("found")))
    return met.select("id", "seq", wrong.alias("w")).where("w is not null").select("id", "seq", "w.expected", "w.found")


def verify_line(rows: DataFrame, count: int, head: str) -> dict:
    """ok, or the first break; the line must end where it is said to end."""
    first = line_breaks(rows).orderBy("id").first()
    if first is not None:
        return {"ok": False, "broken_at": first["seq"], "expected": first["expected"], "found": first["found"]}
    end = rows.agg(F.count(F.lit(1)).alias("n"), F.max_by("hash", "id").alias("head")).first()
    if (end["n"], end["head"]) != (count, head):
        return {"ok": False, "broken_at": None, "expected": head, "found": end["head"]}
    return {"ok": True}
