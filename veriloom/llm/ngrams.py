"""Hashed character n-grams of whole texts, counted with numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes that are handled at a time; longer texts are taken in several steps.
STEP = 1 << 20


def hashed(raw: bytes, sizes: Sequence[int], bits: int) -> Iterator[np.ndarray]:
    """Bucket numbers of all byte n-grams of the given sizes, step by step."""
    for at in range(0, max(1, len(raw)), STEP):
        part = np.frombuffer(raw[at : at + STEP + max(sizes) - 1], np.uint8).astype(np.uint32)
        code, n = np.zeros(len(part), np.uint32), 0
        for size in sorted(sizes):
            while n < size:
                code = code[: max(0, len(part) - n)] * np.uint32(257) + part[n:] + np.uint32(1)
                n += 1
            # n-grams that begin in this step
            own = code[:STEP]
            yield (own * np.uint32(2654435761)) >> np.uint32(32 - bits)


def counts(raw: bytes, sizes: Sequence[int], bits: int) -> np.ndarray:
    out = np.zeros(1 << bits, np.int64)
    for codes in hashed(raw, sizes, bits):
        out += np.bincount(codes, minlength=1 << bits)
    return out
