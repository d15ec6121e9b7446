"""Substring dedup by fixed-block anchors: words covered by a window that occurs twice go.

A window has ``window`` words, a block the half of that, rounded up, so each window
holds a whole block of its document's blocks, which lie end to end from the first word.
Three passes over the texts:

1. The blocks are the index; every rolling run of a block's length probes it.  A block
   is hit if its words also start at another place, in any document.
2. Hits are extended: a window can only repeat if the block in it is hit, and so is the
   block in each of its copies.  Of these windows it is asked if their words occur again.
3. Windows that do, and overlap or touch, make maximal repeats; their words go.

Extending each hit against all others of its block would visit all pairs of a group of
copies.  Instead documents are dealt to units of some MB.  A unit asks about each of
its hashes once, however often it has it, in sorted lists, one for each bucket of hashes.  A bucket
merges the lists of all units, so it holds a hash at most once for each unit, and
answers each list: the blocks that are hit, or one bit for each window.  Units and
buckets grow with the root of the corpus (at 100 TB about 400 MB of text and 25 million
hashes), so that lists stay long.

Hashes: 64 bits for a word; 32 bits and the bucket for a block, where a false hit only
makes a window be asked about; 96 bits and the bucket for a window.

Results in the odd cases: null text counts as empty, has no words and keeps the empty
text; words are runs of anything but the six ASCII white-space characters, compared as
they are; texts shorter than a window keep all; null and repeated ids and repeated rows
are documents of their own, whose equal windows repeat; an empty table gives an empty
result; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import discarded, releasing, written

WINDOW = 35
#: Bytes of text of a unit at least; a bucket has the hashes of a quarter of that.
UNIT = 8 << 20
#: Hashes that a unit's list for one bucket has on average, at least.
LISTED = 64
UNITS = "unit long, doc_id long, text string"
ASKS = "bucket long, unit long, high binary, low binary, twice binary, blocks binary"
ANSWERS = "unit long, bucket long, hits binary, again binary"
FOUND = "doc_id long, n_words long, spans array<struct<start:long, end:long>>, kept string"
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


#: Bytes of text that are hashed at once.
SLICE = 1 << 18
LETTERS = np.random.default_rng(5).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and of its inverse, modulo 2**64."""
    out = []
    for x in (int(ODD[0]), pow(int(ODD[0]), -1, 1 << 64)):
        steps = np.full(SLICE, x, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


class Texts:
    """The words of some texts: where each is in one buffer, and a 64-bit hash of it."""

    def __init__(self, texts: Iterable[bytes | None]) -> None:
        held = [t or b"" for t in texts]
        self.buffer = np.frombuffer(b"\n".join([*held, b""]), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in held])]).astype(np.int64)
        self.letter = ~BLANK[self.buffer]
        edges = np.flatnonzero(self.letter[1:] != self.letter[:-1]) + 1
        edges = np.concatenate([[0], edges]) if len(self.letter) and self.letter[0] else edges
        self.starts, self.ends = edges[::2], edges[1::2]  # a text ends in white space here
        #: Place of each text's first word, and of the first word after the last text.
        self.first = np.searchsorted(self.starts, self.offsets)
        self.code = self._hashed()
        #: Words from each word to its text's end.
        self.left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.starts))

    def _hashed(self) -> np.ndarray:
        import xxhash

        power, inverse = _powers()
        code, at = np.empty(len(self.starts), np.uint64), 0
        while at < len(code):
            a = self.starts[at]
            to = int(np.searchsorted(self.ends, a + SLICE, "right"))
            if to == at:  # a word longer than a slice
                code[at] = xxhash.xxh64_intdigest(self.buffer[a : self.ends[at]].tobytes())
                at += 1
                continue
            sums = np.zeros(self.ends[to - 1] - a + 1, np.uint64)
            np.cumsum(LETTERS[self.buffer[a : self.ends[to - 1]]] * power[: len(sums) - 1], out=sums[1:])
            start, end = self.starts[at:to] - a, self.ends[at:to] - a
            code[at:to] = (sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * ODD[3]
            at = to
        code ^= code >> np.uint64(32)
        code *= ODD[2]
        return code ^ (code >> np.uint64(29))

    def places(self, block: int) -> np.ndarray:
        """Where the blocks start."""
        behind = np.arange(len(self.starts)) - np.repeat(self.first[:-1], np.diff(self.first))
        return np.flatnonzero((behind % block == 0) & (self.left >= block))

    def kept(self, k: int, spans: list[tuple[int, int]]) -> str:
        """The words of a text but for spans of them, joined by one space."""
        a, b, first = self.offsets[k], self.offsets[k + 1], self.first[k]
        own = slice(first, self.first[k + 1])
        text, keep = self.buffer[a:b].copy(), self.letter[a:b].copy()
        text[self.ends[own] - a], keep[self.ends[own] - a] = 0x20, True
        for x, y in spans:
            keep[self.starts[first + x] - a : self.ends[first + y - 1] - a + 1] = False
        return text[keep][:-1].tobytes().decode("utf-8", "replace")


def _mixed(a: np.ndarray, b: np.ndarray, odd: np.uint64) -> np.ndarray:
    x = a * ODD[0]
    x += b ^ odd
    x ^= x >> np.uint64(31)
    x *= odd
    x ^= x >> np.uint64(29)
    return x


def _joined(a: np.ndarray, b: np.ndarray, shift: int, odd: np.uint64) -> np.ndarray:
    """Hashes of runs made of a run of ``a`` and the run of ``b`` that starts ``shift`` later."""
    n = max(0, min(len(a), len(b) - shift))
    return _mixed(a[:n], b[shift : shift + n], odd)


def runs(code: np.ndarray, n: int, odd: np.uint64 = ODD[1]) -> np.ndarray:
    """A hash of each run of ``n`` codes, by doubling; empty if there are fewer."""
    out, have, power, size = None, 0, code, 1
    while n:
        if n & 1:
            out = power if out is None else _joined(out, power, have, odd)
            have += size
        n >>= 1
        if n:
            power, size = _joined(power, power, size, odd), size * 2
    return out


def runs_at(code: np.ndarray, places: np.ndarray, n: int, odd: np.uint64 = ODD[1]) -> np.ndarray:
    """The same for some places only."""
    if 6 * len(places) > len(code):
        return runs(code, n, odd)[places]
    out, have = None, 0
    for size in (1 << k for k in range(n.bit_length()) if n >> k & 1):
        part = [code[places + k] for k in range(have, have + size)]
        while len(part) > 1:
            part = [_mixed(a, b, odd) for a, b in zip(part[::2], part[1::2], strict=True)]
        out = part[0] if out is None else _mixed(out, part[0], odd)
        have += size
    return out


def keyed(code: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of hashes, as one number."""
    return (code >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | code & np.uint64(0xFFFFFFFF)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """If each value is in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _batch(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=list(names))


def _asks(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(rows, ("bucket", "unit", "high", "low", "twice", "blocks"), (pa.int64(), pa.int64(), *[pa.binary()] * 4))


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal numbers in a sorted array."""
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield int(bucket[a]), slice(a, b)


def _dealt(size: int):
    """Gives rows their units: runs of rows of a task with about ``size`` bytes of text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ends = held + np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
            held = int(ends[-1]) if len(ends) else held
            yield pa.RecordBatch.from_arrays([pa.array(first + ends // size), *batch.columns], names=["unit", *batch.schema.names])

    return run


def _probes(block: int, buckets: int):
    """The asks of pass 1: every rolling run of a block's length, and which of them are blocks."""

    def asked(unit: int, texts: list) -> Iterator[pa.RecordBatch]:
        own = Texts(texts)
        code = runs(own.code, block)
        code = keyed(code, buckets)
        keys, times = np.unique(code[own.left[: len(code)] >= block], return_counts=True)
        is_block = np.zeros(len(keys), bool)
        is_block[np.searchsorted(keys, code[own.places(block)])] = True
        low = keys.astype(np.uint32)
        rows = [(b, unit, None, low[at].tobytes(), np.packbits(times[at] > 1).tobytes(), np.packbits(is_block[at]).tobytes()) for b, at in _slices(keys >> np.uint64(32))]
        for k in range(0, len(rows), 4096):
            yield _asks(rows[k : k + 4096])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, texts = None, []
        for batch in batches:
            for u, text in zip(batch.column("unit").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if u != unit:
                    if texts:
                        yield from asked(unit, texts)
                    unit, texts = u, []
                texts.append(text)
        if texts:
            yield from asked(unit, texts)

    return run


def _hits(table: pa.Table) -> pa.Table:
    """The answers of a bucket in pass 1: for each list its blocks that start elsewhere too."""
    lists = [np.frombuffer(x, np.uint32) for x in table.column("low").to_pylist()]
    every = np.sort(np.concatenate(lists))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    rows = []
    bits = lambda c, k: np.unpackbits(np.frombuffer(c, np.uint8), count=k).astype(bool)
    for unit, bucket, own, twice, blocks in zip(table.column("unit").to_pylist(), table.column("bucket").to_pylist(), lists, table.column("twice").to_pylist(), table.column("blocks").to_pylist(), strict=True):
        hit = own[bits(blocks, len(own)) & (bits(twice, len(own)) | _among(own, shared))]
        if len(hit):
            rows.append((unit, bucket, hit.tobytes(), None))
    return _answers(rows)


def _answers(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, ("unit", "bucket", "hits", "again"), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))])


class Unit(Texts):
    """A unit's windows that may repeat: where they start, and their distinct hashes in order."""

    def __init__(self, texts: pa.ChunkedArray, answers: pa.Table, window: int, buckets: int) -> None:
        super().__init__(texts.cast(pa.binary()).to_pylist())
        block = (window + 1) // 2
        known = [np.frombuffer(h, np.uint32).astype(np.uint64) | np.uint64(b << 32) for b, h in zip(answers.column("bucket").to_pylist(), answers.column("hits").to_pylist(), strict=True) if h is not None]
        self.at = np.empty(0, np.int64)
        if known:
            places = self.places(block)
            hit = places[_among(keyed(runs_at(self.code, places, block), buckets), np.sort(np.concatenate(known)))]
            # a block is the first in the windows that start at it or up to block - 1 words before, in its text
            last = np.full(len(self.code), -1, np.int64)
            last[hit] = hit
            ahead = np.minimum.accumulate(np.where(last < 0, len(self.code), last)[::-1])[::-1]
            self.at = np.flatnonzero((ahead - np.arange(len(ahead)) < block) & (self.left >= window))
        high, low = (runs_at(self.code, self.at, window, odd) if len(self.at) else np.empty(0, np.uint64) for odd in ODD[2:])
        bucket = (low >> np.uint64(32)) % np.uint64(buckets)
        low = low.astype(np.uint32)
        order = np.lexsort((low, high, bucket))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(bucket[order]) != 0) | (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)
        self.bucket, self.high, self.low = (x[order][new] for x in (bucket, high, low))
        place = np.cumsum(new) - 1
        #: Of each window the place of its hash.
        self.of = np.empty(len(order), np.int64)
        self.of[order] = place
        self.twice = np.bincount(place, minlength=len(self.high)) > 1 if len(order) else np.empty(0, bool)


def _windows(window: int, buckets: int):
    """The asks of pass 2."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        u = Unit(texts.column("text"), answers, window, buckets)
        unit = texts.column("unit")[0].as_py() if texts.num_rows else None
        rows = [(b, unit, u.high[at].tobytes(), u.low[at].tobytes(), np.packbits(u.twice[at]).tobytes(), None) for b, at in _slices(u.bucket)]
        return pa.Table.from_batches([_asks(rows)])

    return run


def _again(table: pa.Table) -> pa.Table:
    """The answers of a bucket in pass 2: for each list a bit for each window, if it occurs again."""
    highs = [np.frombuffer(x, np.uint64) for x in table.column("high").to_pylist()]
    high, low = np.concatenate(highs), np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("low").to_pylist()])
    again = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(h)) for t, h in zip(table.column("twice").to_pylist(), highs, strict=True)]).astype(bool)
    order = np.lexsort((low, high))
    same = (np.diff(high[order]) == 0) & (np.diff(low[order]) == 0)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    rows, at = [], 0
    for unit, bucket, own in zip(table.column("unit").to_pylist(), table.column("bucket").to_pylist(), highs, strict=True):
        bits = again[at : at + len(own)]
        at += len(own)
        if bits.any():
            rows.append((unit, bucket, None, np.packbits(bits).tobytes()))
    return _answers(rows)


def _cut(window: int, buckets: int):
    """Pass 3: the texts without their repeats."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        u = Unit(texts.column("text"), answers, window, buckets)
        told = {b: a for b, a in zip(answers.column("bucket").to_pylist(), answers.column("again").to_pylist(), strict=True) if a is not None}
        again = np.zeros(len(u.high), bool)
        for b, at in _slices(u.bucket):
            if b in told:
                again[at] = np.unpackbits(np.frombuffer(told[b], np.uint8), count=at.stop - at.start)
        starts, rows = u.at[again[u.of]], []
        own = np.searchsorted(starts, u.first)
        for k, doc_id in enumerate(texts.column("doc_id").to_pylist()):
            spans: list[tuple[int, int]] = []
            if (at := starts[own[k] : own[k + 1]] - u.first[k]).size:
                lead = np.flatnonzero(np.diff(at, prepend=-window - 1) > window)  # after a gap between windows
                spans = list(zip(at[lead].tolist(), (at[np.append(lead[1:], len(at)) - 1] + window).tolist(), strict=True))
            rows.append((doc_id, int(u.first[k + 1] - u.first[k]), [{"start": a, "end": b} for a, b in spans], u.kept(k, spans)))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.Table.from_batches([_batch(rows, ("doc_id", "n_words", "spans", "kept"), (pa.int64(), pa.int64(), span, pa.string()))])

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """One row per document: doc_id, n_words, spans (of words that go: start, end), kept (the text of the others).

    Spans are maximal: they neither overlap nor touch.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    size = max(unit, math.isqrt(24 * LISTED * total))
    buckets = max(1, -(-4 * total // size))
    block = (window + 1) // 2
    units = written(rows.mapInArrow(_dealt(size), UNITS), "units")
    asks = units.select("unit", "text").mapInArrow(releasing(_probes(block, buckets)), ASKS)
    hits = written(asks.groupBy("bucket").applyInArrow(_hits, ANSWERS), "hits")
    asks = units.groupBy("unit").cogroup(hits.groupBy("unit")).applyInArrow(_windows(window, buckets), ASKS)
    again = written(asks.groupBy("bucket").applyInArrow(_again, ANSWERS), "again")
    found = units.groupBy("unit").cogroup(hits.unionByName(again).groupBy("unit")).applyInArrow(_cut(window, buckets), FOUND)
    found = written(found, "kept")
    discarded(units, hits, again)
    return found
