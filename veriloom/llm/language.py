"""Language identification with error-correcting output codes.

Every language gets a codeword of bits.  For each bit one binary classifier over
hashed character n-grams learns to tell the languages whose codeword has a 1
there from the others: its weights are log-odds of n-gram counts, which Spark
sums over all labelled documents (one row of counts per language leaves the
cluster).  A text's margins, one for each bit, are decoded to the codeword with
the least loss, each bit weighted by how well its classifier did on the sums.

Results in the odd cases: null text, or text without a letter, is ``und`` with
score 0; a null language is not learned from; without any labelled document all
texts are ``und``; one language alone is predicted with score 1; null ids are
not held out; repeated rows count each; an empty table gives an empty result;
other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import crc_mod, releasing, written
from veriloom.llm.ngrams import counts

BITS = 13
SIZES = (1, 2, 3)
UNKNOWN = "und"


class Model(NamedTuple):
    names: list[str]
    codes: np.ndarray  # language x bit, -1 or 1
    weights: np.ndarray  # bucket x bit
    trust: np.ndarray  # of each bit


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n codewords, far apart: all columns for few languages, else random ones."""
    if n <= 5:
        # every way to part the languages in two, once
        return np.array([[1 if k == 0 or not (c >> (k - 1)) & 1 else -1 for c in range(1, 1 << max(0, n - 1))] for k in range(n)]).reshape(n, -1)
    length, draw, best, far = max(15, int(np.ceil(10 * np.log2(n)))), np.random.default_rng(seed), None, -1
    for _ in range(64):
        codes = draw.choice([-1, 1], (n, length))
        apart = (length - codes @ codes.T) // 2 + length * np.eye(n, dtype=int)
        halves = (np.abs(codes.sum(0)) < n).all()
        if halves and apart.min() > far:
            best, far = codes, apart.min()
    return best


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of n-gram counts per language and task."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            n = counts(_plain(text), SIZES, BITS)
            # each document weighs by the root of its length, so long ones do not rule
            n = n / np.sqrt(max(1, n.sum()))
            sums[lang] = sums[lang] + n if lang in sums else n
    bucket = np.arange(1 << BITS)
    for lang, n in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(bucket), pa.array(n)], names=["lang", "bucket", "n"])


def _plain(text: bytes) -> bytes:
    return text.decode("utf-8", "replace").lower().encode()


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model from all rows with a text and a language."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sums = rows.mapInArrow(releasing(_summed), "lang string, bucket long, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    per = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "n"))), lambda x: x["n"]).alias("n"))
    # one row of 2 ** BITS counts for each language; languages do not grow with the documents
    got = {r["lang"]: np.array(r["n"]) for r in per.toLocalIterator()}
    names = sorted(got)
    if len(names) < 2:
        return Model(names, np.ones((len(names), 0)), np.zeros((1 << BITS, 0)), np.ones(0))
    # each language as a distribution, so frequent ones do not rule a bit
    share = np.stack([(got[x] + 0.01) / (got[x] + 0.01).sum() for x in names])
    codes = codewords(len(names))
    sides = [np.stack([share[codes[:, b] == side].mean(0) for b in range(codes.shape[1])], 1) for side in (1, -1)]
    weights = np.log(sides[0]) - np.log(sides[1])
    margins = share @ weights
    # a bit is worth what its least margin over the languages is
    trust = np.maximum((margins * codes).min(0), 1e-6)
    return Model(names, codes, weights / np.abs(margins).mean(0), trust / trust.sum())


def decode(model: Model, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number, score and ambiguity of each row of n-gram counts."""
    margins = (n @ model.weights) / np.maximum(n.sum(1, keepdims=True), 1)
    # the loss of each language: exp(-margin * bit), weighted by trust
    loss = np.stack([(np.exp(np.clip(-margins * code, -20, 20)) * model.trust).sum(1) for code in model.codes], 1)
    likely = np.exp(-4 * loss)
    likely = likely / np.maximum(likely.sum(1, keepdims=True), 1e-300)
    best = likely.argmax(1)
    ranked = np.sort(likely, 1)
    return best, ranked[:, -1], ranked[:, -1] - ranked[:, -2] < 0.05


def _predict(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text")
                letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                known = letters & (len(model.names) > 0)
                n = np.stack([counts(_plain(x or b"") if ok else b"", SIZES, BITS) for x, ok in zip(texts.cast(pa.binary()).to_pylist(), known, strict=True)])
                if len(model.names) > 1:
                    best, score, close = decode(model, n)
                else:
                    best, score, close = np.zeros(len(n), int), np.ones(len(n)), np.zeros(len(n), bool)
                names = [model.names[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)]
                own = [c for k, c in enumerate(part.columns) if part.schema.names[k] != "text"]
                yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, close, True))], names=[*[x for x in part.schema.names if x != "text"], "lang_pred", "score", "ambiguous"])

    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with lang_pred, score and ambiguous."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("text"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return written(rows.mapInArrow(releasing(_predict(model)), f"{kinds}, lang_pred string, score double, ambiguous boolean"), "languages")


def held_out(id_col: str = "doc_id", divisor: int = 4, rest: int = 2) -> Column:
    return F.coalesce(crc_mod(id_col, divisor) == rest, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; held-out rows are not learned from."""
    model = fit(docs.where(~held_out(id_col)), text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return predict(rows, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
