"""The shortest trailing path parts that tell paths apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_labels(paths: DataFrame, col: str) -> DataFrame:
    """Each distinct path with ``label``.

    Every suffix of every path is a row; a suffix is unique if one path alone has it.
    A path takes its shortest unique suffix, else all of it.  A path of fewer parts
    counts with all its parts at greater depths too, so its whole suffix is compared
    once more below its own depth; equal strings of different depth can't arise.
    """
    parts = F.filter(F.split(col, "/"), lambda s: s != "")
    own = paths.select(col).distinct().select(col, parts.alias("parts"))
    depth = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("parts"))))
    each = own.select(col, F.size("parts").alias("n"), "parts", depth.alias("depth")).withColumn("suffix", F.when(F.col("n") == 0, "").otherwise(F.array_join(F.expr("slice(parts, greatest(1, n - depth + 1), n)"), "/")))
    shared = each.groupBy("suffix").agg(F.count(F.lit(1)).alias("k"))
    fit = each.join(shared, "suffix").where((F.col("k") == 1) | (F.col("depth") >= F.col("n")))
    label = F.min_by("suffix", "depth")
    return fit.groupBy(col).agg(label.alias("label")).select(col, F.when(F.col("label") != "", F.col("label")).when(F.col(col) != "", F.col(col)).otherwise("unknown").alias("label"))
