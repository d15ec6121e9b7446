"""Very many equal rows in the operators that deal rows to buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriloom.llm import mixing


def hot(spark):
    """100,000 equal rows without id, 200 others of their source, and 300 of another source."""
    rows = spark.range(100_500).select(
        F.when(F.col("id") >= 100_000, F.col("id")).alias("doc_id"),
        F.when(F.col("id") < 100_000, F.lit("three equal words")).otherwise(F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 9 + 1).cast("int")), " ")).alias("text"),
        F.when(F.col("id") < 100_200, "a").otherwise("b").alias("source"),
    )
    return rows


def test_numbered(spark):
    made = spark.createDataFrame([("a", 1, 5, 1), ("a", None, 3, 2 * mixing.CHUNK + 7), (None, 2, 0, mixing.CHUNK)], "source string, doc_id long, size long, n long")
    got = mixing.numbered(made).groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.count_distinct("no").alias("d"), F.min("no").alias("low"), F.max("no").alias("high")).collect()
    assert {(r["source"], r["doc_id"]): (r["n"], r["d"], r["low"], r["high"]) for r in got} == {(s, d): (n, n, 0, n - 1) for s, d, n in [("a", 1, 1), ("a", None, 2 * mixing.CHUNK + 7), (None, 2, mixing.CHUNK)]}
    assert mixing.numbered(made.limit(0)).count() == 0


def test_buckets_of_equal_rows(spark):
    sizes = mixing.counted(mixing.sized(hot(spark)))
    known = mixing.numbered(sizes).withColumns({"sized": F.lit(100_200), "p": F.lit(0.5), "k": F.lit(0)})
    dealt = mixing.dealt(known.where("source = 'a'"), 17)
    assert dealt.groupBy("bucket").count().agg(F.max("count")).first()[0] < 2 * mixing.FAN


def test_mix_of_equal_rows(spark):
    got = mixing.mix(hot(spark)).groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert {r["source"]: r["n"] for r in got} == {"a": 100_200, "b": 300}
    for r in got:
        assert abs(r["taken"] - r["target"]) < 10 and r["over"] <= 0
    one, two = (mixing.mix(rows).groupBy("doc_id", "copies").count() for rows in (hot(spark), hot(spark).repartition(7)))
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, two.collect()), key=repr)
