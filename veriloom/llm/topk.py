"""Exact top-k search by integer inner product, in tiles.

Candidates are dealt evenly to shards of at most about SHARD vectors.  Queries go
in blocks to every shard.  A task holds one shard as a matrix; a block of queries
times that matrix is a tile, from which each query's k best are selected, and
per-query lists merge in a tree of FAN lists each.

Components become floor(scale * x).  Sums stay exact: products are taken in
double precision where no sum can reach 2**53, and else in Python integers; a
score beyond 64 bits is an error.

Results in the odd cases: a vector that is null, or holds a null or non-finite
component, takes no part; an empty vector has score 0 with another empty one;
vectors of different length do not meet; rows with a null id take no part; ties
go to the smaller id; a query's own row is every row with its id; rows that
repeat a candidate count each, and a query that repeats is asked once for each
different vector; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import written

SHARD = 8192
BLOCK = 1024
FAN = 16
FOUND = "query_id long, vec_id long, score long, shard long"


def floors(x: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as doubles; from 2**52 on a double is whole already, and floor() would stop at 64 bits."""
    return F.transform(x, lambda e: F.when(F.abs(e * scale) < 2.0**52, F.floor(e * scale).cast("double")).otherwise(e * scale))


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, v: the whole numbers floor(scale * x), for usable rows."""
    x = F.col(vector_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), floors(x, scale).alias("v"))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1)


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k best of one tile: query ids, candidate ids, scores."""
    bound = np.abs(q).sum(1).max(initial=0) * np.abs(m).max(initial=0)
    if bound < 2.0**53:
        score = q @ m.T
    else:
        whole = [[int(x) for x in row] for row in q], [[int(x) for x in row] for row in m]
        score = np.array([[0 if j == i else sum(a * b for a, b in zip(x, y, strict=True)) for j, y in zip(ids, whole[1], strict=True)] for i, x in zip(q_ids, whole[0], strict=True)], object)
        if score.size and abs(score).max() >= 2**63:
            raise ValueError("an inner product exceeds 64 bits")
    for i in range(len(q)):
        row, other = score[i], ids != q_ids[i]
        row, own = row[other], ids[other]
        if len(row) > k:
            least = np.sort(row)[len(row) - k] if row.dtype == object else np.partition(row, len(row) - k)[len(row) - k]
            near = np.flatnonzero(row >= least)
        else:
            near = np.arange(len(row))
        best = row[near].astype(np.int64)
        order = np.lexsort((own[near], -best))[:k]
        yield np.full(len(order), q_ids[i]), own[near][order], best[order]


def _tiles(k: int, shard_rows: int):
    def search(ids: np.ndarray, m: np.ndarray, batch: pa.RecordBatch) -> Iterator[tuple]:
        q_ids, q = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), batch.num_rows)
        for at in range(0, len(ids), shard_rows):
            yield from _best(q_ids, q, ids[at : at + shard_rows], m[at : at + shard_rows], k)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows, ready = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column("dim").to_numpy(), batch.column("shard").to_numpy(), batch.column("asks").to_numpy()], 1)
            edges = np.flatnonzero(np.any(keys[1:] != keys[:-1], 1)) + 1
            for a, b in zip([0, *edges], [*edges, len(keys)], strict=True):
                part, (dim, shard, asks) = batch.slice(a, b - a), keys[a]
                if key != (dim, shard):
                    key, ids, rows, ready = (dim, shard), [], [], None
                if not asks:
                    ids.append(part.column("vec_id").to_numpy())
                    rows.append(_matrix(part.column("v"), part.num_rows))
                    continue
                if not ids:
                    continue
                if ready is None:
                    ready = np.concatenate(ids), np.concatenate(rows)
                for at in range(0, part.num_rows, BLOCK):
                    found = [np.concatenate(x) for x in zip(*search(*ready, part.slice(at, BLOCK)), strict=True)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, found), pa.array(np.full(len(found[0]), shard))], names=["query_id", "vec_id", "score", "shard"])

    return run


def top_k(vectors: DataFrame, asked: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shard_rows: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for every row where ``asked`` holds.

    ``asked`` is a condition on the id column of ``vectors``.
    """
    usable = written(quantized(vectors, id_col, vector_col, scale), "vectors").withColumn("dim", F.size("v"))
    shards = max(1, -(-usable.count() // shard_rows))
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))
    candidates = usable.select("vec_id", "v", "dim", dealt.alias("shard"), F.lit(0).alias("asks"))
    queries = usable.withColumnRenamed("vec_id", id_col).where(asked).withColumnRenamed(id_col, "vec_id").distinct()
    asks = queries.select("vec_id", "v", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("asks"))
    met = candidates.unionByName(asks).repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "asks")
    found = met.mapInArrow(_tiles(k, shard_rows), FOUND)
    while True:
        found = found.withColumn("shard", F.floor(F.col("shard") / FAN))
        best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("score"), "vec_id"))), 1, k)
        merged = found.groupBy("query_id", "shard").agg(best.alias("best"))
        shards = -(-shards // FAN)
        if shards == 1:
            ranked = merged.select("query_id", F.posexplode("best").alias("pos", "b"))
            return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.score")).alias("score"))
        found = merged.select("query_id", "shard", F.explode("best").alias("b")).select("query_id", "b.vec_id", (-F.col("b.score")).alias("score"), "shard")
