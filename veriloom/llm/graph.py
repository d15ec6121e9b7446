"""Connected components of links by alternating stars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import discarded, sized, written


#: Links that a task joins at once.
HELD = 300_000


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins a task's links, some at a time: each node with the smallest one it is linked to there."""
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    def stars() -> pa.RecordBatch:
        out = [(x, find(x)) for x in list(root)]
        root.clear()
        out = [x for x in out if x[0] != x[1]]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            low, high = sorted((find(a), find(b)))
            root[high] = low
        if len(root) > HELD:
            yield stars()
    yield stars()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for the nodes of ``links`` (a, b: binary).

    Links that lie in one task are joined there first.
    Large stars hand the larger neighbours of a node to its smallest one, small
    stars the smaller neighbours; after some rounds each node is linked to its root
    alone.  Each round is a table in the shared folder and takes the place of the
    one before.  Links with a null end are passed over; repeated links and loops do
    no harm; without links the result is empty; other columns do not matter.
    """
    edges = links.where("a <> b").select("a", "b").mapInArrow(_stars, "a binary, b binary").distinct()
    edges, before = written(edges, "edges"), None
    while (now := _state(edges)) != before:
        parts = sized(now[0])
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large", parts=parts)
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        old, edges, before = edges, written(small.distinct(), "edges", parts=parts), now
        discarded(old, large)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
