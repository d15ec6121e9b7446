"""Best-fit packing of token sequences under several capacities.

Each document becomes ids and an end id; one longer than a sequence is cut into
pieces of a whole sequence, of which the first may be shorter.  A sequence has
capacities for tokens, documents and attention cost (the sum of squared piece
lengths).  Pieces are dealt by hash to blocks of about BLOCK; a block takes them
from long to short, and each goes to the open sequence that has room under every
capacity and scores best: the least norm of what would remain (``rule="norm"``)
or the largest weighted dot product of the piece and what remains (``"dot"``).
Sequences that end under ``reopen`` of the token capacity give their pieces back
for a second round over fewer, fuller blocks.

Results in the odd cases: null text counts as empty, which packs its end id
alone; null and repeated ids are rows like any other; an empty table gives an
empty result; other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import releasing, written
from veriloom.llm.tokens import HELD, encoder, slices

#: Pieces of one packing task.
BLOCK = 12_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Capacity(NamedTuple):
    """What one sequence holds, and the weights of its dimensions in the score.

    The defaults for documents and attention follow from 2048 tokens, so they
    bind only when made smaller.
    """

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2)
    rule: str = "norm"


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    first = n % most or most
    return [(0, first), *((at, most) for at in range(first, n, most))]


def _pieces(path: str, end: int, most: int, held: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = encoder(path, held), np.array([end], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), own.encode(part.column("text")), strict=True):
                    ids = memoryview(ids + last)
                    for k, (start, n) in enumerate(cut(len(ids) // 4, most)):
                        rows.append((doc_id, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, longest pieces first."""
    scale = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weights = np.array(capacity.weights) / np.sum(capacity.weights)
    items = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], 1) / scale
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    # the open sequences, side by side: their number, what remains, and the exact tokens of it
    names, room, tokens = np.empty(len(lengths), np.int64), np.empty((3, len(lengths))), np.empty(len(lengths), np.int64)
    used = m = 0
    least = int(lengths.min()) if len(lengths) else 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length, item = lengths[i], items[i][:, None]
        if length == capacity.tokens:  # fits an empty sequence only, and fills it
            where[i], offset[i] = used, 0
            used += 1
            continue
        left = room[:, :m] - item
        fits = (tokens[:m] >= length) & (left.min(0, initial=0.0) > -1e-9)
        if capacity.rule == "dot":
            score = -((weights[:, None] * item).T @ room[:, :m])[0]
        else:
            score = weights @ (left * left)
        score[~fits] = np.inf
        k = int(score.argmin()) if m else -1
        if k < 0 or score[k] == np.inf:
            k, m = m, m + 1
            names[k], room[:, k], tokens[k] = used, 1.0, capacity.tokens
            used += 1
        where[i], offset[i] = names[k], capacity.tokens - tokens[k]
        room[:, k] -= items[i]
        tokens[k] -= length
        if tokens[k] < least:  # full: the last open one takes its place
            m -= 1
            names[k], room[:, k], tokens[k] = names[m], room[:, m], tokens[m]
    return where, offset


def _block(capacity: Capacity, level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        where, offset = best_fit(pdf["length"].to_numpy(), capacity)
        filled = np.bincount(where, pdf["length"].to_numpy(), minlength=1)
        sequence = (pdf["block"].to_numpy() << 24 | where) << 2 | level
        return pdf.assign(sequence_id=sequence, offset=offset, filled=filled[where].astype(np.int64)).drop(columns="block")

    return run


def packed(pieces: DataFrame, capacity: Capacity = Capacity(), block: int = BLOCK, reopen: float = 0.97) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    columns, out = PIECE.replace(" long", "").replace(" int", "").split(", "), None
    for level in range(2):
        n = max(1, -(-pieces.count() // block))
        # equal pieces are dealt by a draw of their own
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64(F.rand(level), *columns), F.lit(n)))
        done = written(dealt.groupBy("block").applyInPandas(_block(capacity, level), f"{PIECE}, sequence_id long, offset long, filled long"), "packed")
        full = F.col("filled") >= reopen * capacity.tokens if level == 0 else F.lit(True)
        settled = done.where(full).drop("filled")
        out = settled if out is None else out.unionByName(settled)
        pieces = done.where(~full).select(*columns)
    return out


def pack(docs: DataFrame, path: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text", capacity: Capacity = Capacity(), block: int = BLOCK, held: int = HELD) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``held`` bounds the memory of pieces of text that come again (see ``tokens``).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return packed(written(rows.mapInArrow(releasing(_pieces(path, end, capacity.tokens, held)), PIECE), "pieces"), capacity, block)
