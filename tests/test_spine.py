"""One chain over the events of all sessions."""

import hashlib

from pyspark.sql import functions as F

from veriloom.operators import chain
from veriloom.plans import oracles, queries

N = 700


def test_spine(spark):
    """Cut into ranges it is the chain that a fold makes; breaks are found at ranges' starts as elsewhere."""
    told = [((k * 37) % N, None if k % 50 == 0 else f"é {k}") for k in range(N)]
    at, want = chain.GENESIS, []
    for k, text in sorted(told):
        before, at = at, hashlib.sha256(f"{at}\n{text or ''}".encode()).hexdigest()
        want.append((k, len(want) + 1, before, at))
    ranges = chain.ranged(spark.createDataFrame(told, "seq long, payload string").repartition(5), ["seq"], 100)
    assert ranges.select("part").distinct().count() > 3
    assert chain.entries(ranges, ["seq"])[-1] == (-1, N, at)
    links = chain.spine(ranges, ["seq"]).cache()
    assert sorted(tuple(r) for r in links.select("seq", "id", "prev_hash", "hash").collect()) == want
    found = lambda df: sorted(r["id"] for r in chain.spine_breaks(df).collect())
    assert found(links) == []
    starts = [r["low"] for r in links.groupBy("part").agg(F.min("id").alias("low")).collect()]
    edge = max(starts)
    assert found(links.where(F.col("id") != edge)) == [edge + 1]
    assert found(links.withColumn("payload", F.when(F.col("id").isin(1, edge), "x").otherwise(F.col("payload")))) == [1, edge]


def test_no_events(spark):
    ranges = chain.ranged(spark.createDataFrame([], "seq long, payload string"), ["seq"])
    assert chain.entries(ranges, ["seq"]) == [(-1, 0, chain.GENESIS)]
    assert chain.spine(ranges, ["seq"]).count() == 0


def test_query_is_one_chain(spark, tmp_path):
    """A row for the whole table, of which each head depends on every event before it."""
    rows = spark.range(300).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"), F.concat(F.lit("p"), "id").alias("props"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    at = chain.GENESIS
    for k in range(300):
        at = hashlib.sha256(f"{at}\nview p{k}".encode()).hexdigest()
    assert [tuple(r) for r in queries.chain_build(spark, str(tmp_path)).collect()] == [(300, at)]
    assert sorted(r["id"] for r in queries.chain_breaks(spark, str(tmp_path)).collect()) == [4, 9]
    assert "stretch" not in oracles.SQL["chain_build"] + oracles.SQL["chain_breaks"]
