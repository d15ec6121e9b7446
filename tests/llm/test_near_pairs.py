"""Candidates of near-dedup: texts that share many buckets meet once."""

from pyspark.sql import functions as F

from veriloom.llm.near_dedup import _pairs


def test_pairs_meet_once(spark):
    rows = [(b, n, n // 10, (n + b) % 3 == 0) for b in range(12) for n in range(30) if (n * 7 + b) % 5]
    df = spark.createDataFrame(rows, "bucket long, k int, family int, is_hub boolean")
    node = lambda c: F.col(c).cast("string").cast("binary")
    members = df.select("bucket", node("k").alias("node"), node("family").alias("root"), F.lit(50).alias("n"), F.lit(50).alias("most"), F.lit(30).alias("size"), "is_hub")
    want = {frozenset((a, b)) for at, a, f, _ in rows for to, b, g, hub in rows if hub and at == to and f != g}
    for once, most in ((True, 2 * len(want)), (False, None)):
        got = [frozenset((int(r["a"].decode()), int(r["b"].decode()))) for r in _pairs(members, 0.8, once).select("a", "b").collect()]
        assert set(got) == want
        if most:
            assert len(got) <= most  # once with either as the hub
    both = members.where("is_hub")
    got = [frozenset((bytes(r["a"]), bytes(r["b"]))) for r in _pairs(both, 0.8, False).where("a_root <> b_root").select("a", "b").collect()]
    assert len(got) == sum(1 for at, a, f, h in rows for to, b, g, k in rows if h and k and at == to and f != g and a < b)  # was twice that
