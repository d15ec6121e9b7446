"""Hard negatives against brute force, and the bounds that choose windows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import DATA
from veriloom.llm import negatives as N
from veriloom.llm import queries

VECTORS = "vec_id long, embedding array<double>, label int, norm string, ask string, shard string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, g, "a", "b", "c", "d") for i, v, g in rows], VECTORS)


def brute(rows, k=5, scale=256, near=80):
    use = [(i, [math.floor(scale * x) for x in v], g) for i, v, g in rows if None not in (i, v, g) and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {(i, tuple(v), g) for i, v, g in use if i % 100 == 0}
    out = Counter()
    for i, v, g in anchors:
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, h) for j, w, h in use if j != i and len(w) == len(v)]
        positives = sorted(x[:2] for x in scored if x[2] == g)[:k]
        for p, pid in positives:
            found = sorted(x[:2] for x in scored if x[2] != g and near * -p <= 100 * -x[0] <= 100 * -p)[:k]
            for rank, (n, j) in enumerate(found):
                out[i, pid, rank + 1, j, -p, -n] += 1
    return out


def found(spark, rows, **how):
    return Counter(tuple(r) for r in N.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0, **how).collect())


def cloud(n, dim, seed, groups=7, labels=4):
    """Vectors around some centres, of several lengths; labels partly follow the centres."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    out = []
    for k in range(n):
        g = int(r.integers(groups))
        v = (centres[g] + r.normal(size=dim) * 0.3) * r.choice([0.1, 1.0, 3.0])
        out.append((k, v.tolist(), int(g % labels if r.random() < 0.7 else r.integers(labels))))
    return out


@pytest.mark.parametrize(("dim", "shard_rows"), [(3, 300), (16, 5000)])
def test_brute_force(spark, dim, shard_rows):
    rows = cloud(1500, dim, dim)
    got = found(spark, rows, shard_rows=shard_rows)
    assert got == brute(rows) and sum(got.values()) > 100


def test_ties_and_copies(spark):
    """Copies of one vector, repeated rows and repeated anchors, equal scores, one label alone."""
    one = [0.5, 0.25, -0.125]
    rows = [(k, one, k % 2) for k in range(90, 320)] + [(100, one, 0), (100, one, 1), (200, [0.5, 0.5, 0.5], 0), (7, one, 0), (7, one, 0), (1000, [9.0, 0.0, 0.0], 77)]
    got = found(spark, rows, shard_rows=50)
    assert got == brute(rows) and sum(got.values()) > 20


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.9, 0.0], 2), (None, [1.0, 0.0], 2), (3, None, 2), (4, [1.0, 0.0], None), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (8, [None, 1.0], 2), (9, [1.0], 2), (10, [], 2), (100, [], 2), (11, [0.0, 0.0], 2), (200, [0.0, 0.0], 1), (300, [-1.0, 0.0], 5), (12, [1.0, 0.0], 5), (13, [-1.0, -1.0], 1)]
    assert found(spark, rows) == brute(rows)
    assert N.hard_negatives(table(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    big = [(0, [2.0**30, 1.0], 1), (1, [2.0**10, 1.0], 1), (2, [2.0**10, 1.0], 2), (3, [2.0**10, 0.5], 2), (4, [2.0**10 * 0.9, 3.0], 2)]
    assert found(spark, big) == brute(big)
    with pytest.raises(Exception, match="64 bits"):
        found(spark, [(0, [1e17, 1.0], 1), (1, [1e17, 2e17], 1)])


def test_bounds_hold_and_prune():
    """Every score is within its window's bounds, and on vectors in clusters most windows are passed over."""
    rows = cloud(4000, 12, 5, groups=40, labels=1)
    m = np.floor(256 * np.array([v for _, v, _ in rows]))
    units = m / np.linalg.norm(m, axis=1)[:, None]
    angles = np.arccos(np.clip(units @ units[:16].T, -1, 1))
    norms = np.linalg.norm(m, axis=1)
    shard = N.Shard(np.arange(4000), np.zeros(4000, int), m, norms, angles)
    low, high = shard.bounds(norms[:50], angles[:50])
    score = m[:50] @ shard.m.T
    of = np.arange(4000) // N.WINDOW
    assert (score >= low[:, of]).all() and (score <= high[:, of]).all()
    tenth = np.sort(score, 1)[:, -10]
    assert (high < tenth[:, None]).mean() > 0.5


def test_query(spark):
    got = queries.op12_negatives(spark, DATA)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = db.execute(queries.oracle_sql()["op12_negatives"]).fetchall()
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_search_does_not_saturate(spark):
    """Components beyond 64 bits are an error in the top-k search as well, not a wrong first place."""
    from veriloom.llm import topk

    vectors = spark.createDataFrame([(0, [1 / 1024, -1 / 1024]), (1, [1e17, 2e17])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(vectors, F.col("vec_id") % 100 == 0).collect()
