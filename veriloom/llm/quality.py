"""Quality classification by votes of nearest labelled neighbours.

Texts become TF-IDF vectors of hashed features: byte n-grams, n-grams of the
text's shape (letters and digits mapped to their kind), and repeated words.  The
document frequencies are counted over all documents.  A bounded sample of
labelled rows (SAMPLE for each label) gives the latent-semantic space, a
truncated singular value decomposition, and the labelled vectors in it; both are
broadcast, and their size follows from SAMPLE and RANK alone.  Every document is
projected whole, its cosines with all labelled vectors are computed in blocks,
and its NEAREST neighbours vote with weights that grow with their similarity.

Results in the odd cases: null text counts as empty and, like any text without
features, gets the share of label 1 in the sample; with labels of one kind only
the score is that label, without labels 0.5; a null id is not held out and has no
label; rows that repeat an id share its label (the smaller, if they differ); an
empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import crc_mod, releasing, written
from veriloom.llm.ngrams import counts

#: Labelled rows of each label that are learned from.
SAMPLE = 1500
RANK = 48
NEAREST = 15
GRAM_BITS, SHAPE_BITS = 12, 11
WIDTH = (1 << GRAM_BITS) + (1 << SHAPE_BITS) + 8
THRESHOLD = 0.3
#: Lower case, upper case, digits and bytes of other letters by kind; the rest as they are.
SHAPE = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))


class Space(NamedTuple):
    idf: np.ndarray
    axes: np.ndarray  # feature x rank
    vectors: np.ndarray  # labelled x rank, unit length
    labels: np.ndarray
    share: float  # of label 1


def features(raw: bytes) -> np.ndarray:
    words = raw.split()
    again = sum(map(bytes.__eq__, words, words[1:]))
    kinds = np.zeros(8)
    # the share of words that repeat the one before, as one of seven steps
    if again:
        kinds[min(7, int(8 * again / len(words)))] = again
    return np.concatenate([counts(raw, (2, 3), GRAM_BITS), counts(raw.translate(SHAPE), (2, 4), SHAPE_BITS), kinds])


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _present(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of the task each feature occurs."""
    df, n = np.zeros(WIDTH, np.int64), 0
    for batch in batches:
        for text in _texts(batch):
            df += features(text) > 0
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH + 1)), pa.array(np.append(df, n))], names=["feature", "df"])


def document_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The inverse document frequency of each feature over all documents."""
    per = docs.select(F.col(text_col).alias("text")).mapInArrow(_present, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df"))
    df = np.zeros(WIDTH + 1)
    for row in per.collect():  # WIDTH + 1 rows at any size of the input
        df[row["feature"]] = row["df"]
    return np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1


def weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.sqrt(rows) * idf
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _vectors(idf: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [weighted(features(x)[None], idf)[0].astype(np.float16).tobytes() for x in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], names=["doc_id", "label", "v"])

    return run


def fit(docs: DataFrame, labels: DataFrame, idf: np.ndarray, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Space:
    """The latent space of at most ``sample`` labelled documents of each label."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).cast("int").alias("label")).join(ids, "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("label = 0").orderBy(*order).limit(sample).unionByName(known.where("label = 1").orderBy(*order).limit(sample))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    got = texts.select("doc_id", "label", "text").mapInArrow(_vectors(idf), "doc_id long, label int, v binary").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    if not got:
        return Space(idf, np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    rows, y = np.stack([np.frombuffer(r["v"], np.float16) for r in got]), np.array([r["label"] for r in got], float)
    rank = min(RANK, len(rows))
    # randomised range finder with two power steps
    a = rows.astype(np.float32)
    span = a @ np.random.default_rng(3).standard_normal((WIDTH, rank + 10)).astype(np.float32)
    for _ in range(2):
        span = a @ (a.T @ np.linalg.qr(span)[0])
    base = np.linalg.qr(span)[0]
    axes = np.linalg.svd(base.T @ a, full_matrices=False)[2][:rank].T
    vectors = a @ axes
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Space(idf, np.ascontiguousarray(axes), vectors, y, float(y.mean()))


def votes(space: Space, rows: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """The share of label 1 among the nearest neighbours, weighted by similarity."""
    out = np.full(len(rows), space.share)
    at = rows @ space.axes
    size = np.linalg.norm(at, axis=1)
    if not len(space.vectors):
        return out
    cosine = (at / np.maximum(size, 1e-12)[:, None]) @ space.vectors.T
    k = min(nearest, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, 1), 0.0).astype(float) ** 8 + 1e-12
    vote = (weight * space.labels[near]).sum(1) / weight.sum(1)
    return np.where(size > 1e-9, np.clip(vote, 0.0, 1.0), out)


def _score(space: Space):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = weighted(np.stack([features(x) for x in _texts(part)]), space.idf)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(votes(space, rows), pa.float64())], names=["doc_id", "score"])

    return run


def held_out(id_col: str = "doc_id", divisor: int = 5, rest: int = 0) -> Column:
    return F.coalesce(crc_mod(id_col, divisor) == rest, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out rows are not learned from."""
    space = fit(docs, labels.where(~held_out(id_col)), document_frequencies(docs, text_col), id_col=id_col, text_col=text_col, label_col=label_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = written(rows.mapInArrow(releasing(_score(space)), "doc_id long, score double"), "scores")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
