"""Hard-negative mining by angular triangle filtering.

Each vector is stored with its norm and its angles to REFERENCES directions, chosen
from a bounded sample of vectors (SAMPLE, farthest first).  If a vector is at angle x
to a direction and an anchor at y, the angle between them is at least |x - y| and at most
min(x + y, 2 pi - x - y).  Over all directions this bounds the cosine, and the norms
turn it into bounds of the inner product, widened by what rounding may add.

Candidates are dealt to shards.  A shard is sorted by label, nearest direction and angle
to it, and cut into windows of WINDOW rows, whose ranges of angles, norms and labels
give bounds for the whole window.  An anchor asks for the best scores within some
intervals; a window gets integer scores only for anchors one of whose intervals it
overlaps.  First each interval's most promising window is scored; what that finds
raises the interval's lower end for the others.  Lists of shards merge in a tree.

Two searches: the best rows of the anchor's label (its positives), in one interval
without ends; then, for each positive, the best rows of other labels that score from
``near`` percent of its score to all of it.  The sample and the windows decide what is
scored, never what is found.

Results in the odd cases: rows with a null id, a null label, a null vector, or a null or
non-finite component take no part; vectors of different length do not meet; ties go
to the smaller id; an anchor's own row is every row with its id; rows that repeat a
candidate count each; an anchor that repeats is asked once for each different vector
and label; positives of score below 0 have no negatives, for their interval is empty; an
anchor without positives has no rows; other columns do not matter; an empty table
gives an empty result; a score beyond 64 bits in a result is an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import discarded, few, written
from veriloom.llm.topk import FAN, floors

REFERENCES = 16
#: Vectors from which the directions are chosen.
SAMPLE = 1024
SHARD = 8192
WINDOW = 64
#: Anchors that meet a shard at once.
BLOCK = 256
#: Radians that an angle's rounding may add.
SLACK = 1e-6
LEAST, MOST = -(2**63), 2**63 - 1
STORED = "vec_id long, label long, v array<double>, norm double, angles array<double>"
FOUND = "ask long, want int, vec_id long, score long, shard long"


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, label, v of the rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    own = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & whole)
    return own.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), floors(x, scale).alias("v"))


def _norms(m: np.ndarray) -> np.ndarray:
    top = np.abs(m).max(1, initial=0)
    return top * np.sqrt(((m / np.where(top > 0, top, 1)[:, None]) ** 2).sum(1))


def _unit(m: np.ndarray) -> np.ndarray:
    norms = _norms(m)
    return m / np.where(norms > 0, norms, 1)[:, None]


def directions(vectors: DataFrame, count: int = REFERENCES, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Unit vectors for each dimension of the sample, each as far from those before it as any."""
    rows = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").select("v").limit(sample).collect()  # a bounded sample
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for dim, own in by_dim.items():
        units = _unit(np.array(own, np.float64).reshape(len(own), dim))
        picked, nearest = [0], units @ units[0]
        while len(picked) < min(count, len(units)):
            picked.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, units @ units[picked[-1]])
        out[dim] = units[picked]
    return out


def _stored(refs: dict[int, np.ndarray]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms, angles = [], []
            for v in batch.column("v").to_pylist():
                m = np.array(v, np.float64).reshape(1, -1)
                norms.append(float(_norms(m)[0]))
                angles.append(np.arccos(np.clip(_unit(m) @ refs[len(v)].T, -1, 1))[0].tolist() if len(v) in refs else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norms, pa.float64()), pa.array(angles, pa.list_(pa.float64()))], names=[*batch.schema.names, "norm", "angles"])

    return run


class Shard:
    """Candidates of one shard in windows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, m: np.ndarray, norms: np.ndarray, angles: np.ndarray) -> None:
        home = angles.argmin(1) if angles.shape[1] else np.zeros(len(ids), int)
        own = angles[np.arange(len(ids)), home] if angles.shape[1] else norms
        order = np.lexsort((own, home, labels))
        self.ids, self.labels, self.m = ids[order], labels[order], m[order]
        self.starts = np.arange(0, len(ids), WINDOW)
        ends = lambda x: (np.minimum.reduceat(x[order], self.starts), np.maximum.reduceat(x[order], self.starts))
        self.label, self.norm, self.angle = ends(labels), ends(norms), ends(angles)
        self.largest = np.abs(m).max(initial=0)

    def bounds(self, norms: np.ndarray, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and most that anchors (rows) may score with a row of a window (columns)."""
        shape = (len(norms), len(self.starts))
        low, high = np.zeros(shape), np.full(shape, np.pi)
        for r in range(angles.shape[1]):
            x, a, b = angles[:, r, None], self.angle[0][None, :, r], self.angle[1][None, :, r]
            np.maximum(low, np.maximum(a - x, x - b), out=low)
            np.minimum(high, np.minimum(x + b, 2 * np.pi - x - a), out=high)
        near, far = np.cos(np.maximum(low - SLACK, 0)), np.cos(np.minimum(high + SLACK, np.pi))
        least, most = self.norm[0][None], self.norm[1][None]
        slack = 1e-9 * norms[:, None] * most + 1
        return norms[:, None] * np.where(far >= 0, far * least, far * most) - slack, norms[:, None] * np.where(near >= 0, near * most, near * least) + slack


def _scores(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; as Python integers where doubles might round."""
    if not exact:
        return a @ b.T
    whole = [[int(x) for x in row] for row in b]
    return np.array([[sum(int(x) * y for x, y in zip(row, other, strict=True)) for other in whole] for row in a], object).reshape(len(a), len(b))


def search(shard: Shard, asks: dict, same: bool, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(ask, want, vec_id, score): the k best rows within each interval of each anchor."""
    q, labels, n = asks["v"], asks["label"], len(asks["ask"])
    exact = np.abs(q).sum(1).max(initial=0) * shard.largest >= 2.0**53
    least, most = shard.bounds(asks["norm"], asks["angles"])
    lows, highs = asks["lows"], asks["highs"]  # anchors x intervals; absent ones are empty
    label = labels[:, None]
    fit = (label >= shard.label[0]) & (label <= shard.label[1]) if same else ~((shard.label[0] == label) & (shard.label[1] == label))
    wanted = range(lows.shape[1])
    over = [fit & ~((most < lows[:, j, None]) | (least > highs[:, j, None]) | (lows[:, j] > highs[:, j])[:, None]) for j in wanted]
    score: np.ndarray = np.zeros((n, len(shard.ids)), object if exact else float)
    known = np.zeros((n, len(shard.starts)), bool)

    def scored(need: np.ndarray) -> None:
        for w in np.flatnonzero(need.any(0)):
            who, at = np.flatnonzero(need[:, w]), slice(shard.starts[w], shard.starts[w] + WINDOW)
            score[who, at] = _scores(q[who], shard.m[at], exact)
        known[need] = True

    def best(i: int, j: int) -> np.ndarray:
        """Places of the best of what has been scored."""
        of = np.flatnonzero(np.repeat(known[i], WINDOW)[: len(shard.ids)])
        of = of[((shard.labels[of] == labels[i]) == same) & (shard.ids[of] != asks["anchor_id"][i])]
        s = score[i, of]
        ends = (_end(asks["exact_lows"][i][j]), _end(asks["exact_highs"][i][j])) if exact else (lows[i, j], highs[i, j])
        inside = ((s >= ends[0]) & (s <= ends[1])).astype(bool)
        of, s = of[inside], s[inside]
        if exact:
            return of[sorted(range(len(of)), key=lambda x: (-s[x], shard.ids[of[x]]))[:k]]
        if len(s) > k:
            near = s >= np.partition(s, len(s) - k)[len(s) - k]
            of, s = of[near], s[near]
        return of[np.lexsort((shard.ids[of], -s))[:k]]

    first = np.zeros_like(known)
    for j in wanted:
        promise = np.where(over[j], np.minimum(most, highs[:, j, None]), -np.inf)
        first[np.arange(n), promise.argmax(1)] |= over[j].any(1)
    scored(first)
    more = np.zeros_like(known)
    for j in wanted:
        raised = lows[:, j].astype(float)
        for i in np.flatnonzero(over[j].any(1)):
            own = best(i, j)
            if len(own) == k:
                raised[i] = max(raised[i], float(score[i, own[-1]]))
        more |= over[j] & ~(most < raised[:, None])
    scored(more & ~known)
    for j in wanted:
        for i in np.flatnonzero(over[j].any(1)):
            for at in best(i, j):
                s = int(score[i, at])
                if not LEAST <= s <= MOST:
                    raise ValueError("an inner product exceeds 64 bits")
                yield int(asks["ask"][i]), j, int(shard.ids[at]), s


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _end(n: int) -> float:
    """An end of an interval; the least and the largest number stand for none."""
    return -np.inf if n == LEAST else np.inf if n == MOST else n


def _intervals(column: list[list[int]], absent: int) -> np.ndarray:
    width = max(map(len, column), default=0)
    return np.array([[*map(_end, x), *[absent] * (width - len(x))] for x in column], float).reshape(len(column), width)


def _tiles(same: bool, k: int):
    """Rows come sorted: of each dimension and shard first the candidates, then the anchors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, shard = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "shard", "asks")], 1)
            edges = (np.flatnonzero(np.any(keys[1:] != keys[:-1], 1)) + 1).tolist()
            for a, b in zip([0, *edges], [*edges, len(keys)], strict=True):
                part, (dim, number, asks) = batch.slice(a, b - a), keys[a].tolist()
                if key != (dim, number):
                    key, parts, shard = (dim, number), [], None
                columns = [part.column("vec_id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("v"), len(part)), part.column("norm").to_numpy(), _matrix(part.column("angles"), len(part))]
                if not asks:
                    parts.append(columns)
                elif parts:
                    shard = shard or Shard(*map(np.concatenate, zip(*parts, strict=True)))
                    rows = list(_asked(part, columns, shard, same, k))
                    cols = list(zip(*rows, strict=True)) or [()] * 4
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], pa.array([number] * len(rows), pa.int64())], names=["ask", "want", "vec_id", "score", "shard"])

    return run


def _asked(part: pa.RecordBatch, columns: list[np.ndarray], shard: Shard, same: bool, k: int) -> Iterator[tuple]:
    ids, labels, v, norms, angles = columns
    ask, lows, highs = part.column("ask").to_numpy(), part.column("lows").to_pylist(), part.column("highs").to_pylist()
    for at in range(0, len(ids), BLOCK):
        s = slice(at, at + BLOCK)
        yield from search(shard, {"ask": ask[s], "anchor_id": ids[s], "label": labels[s], "v": v[s], "norm": norms[s], "angles": angles[s], "exact_lows": lows[s], "exact_highs": highs[s], "lows": _intervals(lows[s], 1), "highs": _intervals(highs[s], 0)}, same, k)


def _found(stored: DataFrame, asks: DataFrame, same: bool, k: int, shards: int) -> DataFrame:
    """ask, want, best: array of (score, vec_id) with scores negated, so in order."""
    none = F.array().cast("array<long>")
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))
    candidates = stored.withColumns({"dim": F.size("v"), "shard": dealt, "asks": F.lit(0), "ask": F.lit(0).cast("long"), "lows": none, "highs": none})
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    anchors = asks.withColumnRenamed("anchor_id", "vec_id").withColumns({"dim": F.size("v"), "shard": every, "asks": F.lit(1)})
    met = candidates.unionByName(anchors).repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "asks")
    found = met.mapInArrow(_tiles(same, k), FOUND)
    while True:
        best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("score"), "vec_id"))), 1, k)
        merged = found.withColumn("shard", F.floor(F.col("shard") / FAN)).groupBy("ask", "want", "shard").agg(best.alias("best"))
        shards = -(-shards // FAN)
        if shards == 1:
            return merged.select("ask", "want", "best")
        found = merged.select("ask", "want", "shard", F.explode("best").alias("b")).select("ask", "want", "b.vec_id", (-F.col("b.score")).alias("score"), "shard")


def hard_negatives(rows: DataFrame, asked: Column, positives: int = 5, negatives: int = 5, near: int = 80, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256, shard_rows: int = SHARD) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``asked`` is a condition on the id column that marks the anchors; a negative scores at
    least ``near`` percent of its positive, and no more than it.
    """
    own = usable(rows, id_col, label_col, vector_col, scale)
    stored = written(own.mapInArrow(_stored(directions(own)), STORED), "vectors")
    shards = max(1, -(-stored.count() // shard_rows))
    anchors = stored.withColumnRenamed("vec_id", id_col).where(asked).withColumnRenamed(id_col, "anchor_id").distinct()
    anchors = written(anchors.withColumn("ask", F.monotonically_increasing_id()), "anchors")
    ends = lambda n: F.array(F.lit(n).cast("long"))
    best = _found(stored, anchors.withColumns({"lows": ends(LEAST), "highs": ends(MOST)}), True, positives, shards)
    best = written(best.select("ask", F.transform("best", lambda b: F.struct((-b["score"]).alias("score"), b["vec_id"].alias("vec_id"))).alias("positives")), "positives")
    asks = anchors.join(few(best), "ask")
    lowest = F.transform("positives", lambda p: F.ceil(p["score"].cast("decimal(38,0)") * near / 100).cast("long"))
    found = _found(stored, asks.withColumns({"lows": lowest, "highs": F.transform("positives", lambda p: p["score"])}).drop("positives"), False, negatives, shards)
    told = found.join(few(anchors.select("ask", "anchor_id")), "ask").join(few(best), "ask")
    each = told.select("anchor_id", F.get("positives", F.col("want")).alias("p"), F.posexplode("best").alias("pos", "b"))
    out = each.select("anchor_id", F.col("p.vec_id").alias("positive_id"), (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), (-F.col("b.score")).alias("negative_score"))
    out = written(out, "negatives")
    discarded(stored, anchors, best)
    return out
