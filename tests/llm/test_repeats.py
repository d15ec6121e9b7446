"""Substring dedup against brute force over all windows."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from tests.llm.test_llm import DATA, ODD, table
from veriloom.llm import queries
from veriloom.llm.repeats import WINDOW, runs, without_repeats


def brute(texts, window=WINDOW):
    """(words, kept text) of each text."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[s : s + window]) for w in split for s in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] > 1:
                gone.update(range(s, s + window))
        out.append((len(w), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def found(spark, rows, **how):
    got = without_repeats(table(spark, rows), **how).collect()
    for r in got:
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert r["n_words"] - sum(b - a for a, b in spans) == len(r["kept"].encode().split())
    return sorted(((r["doc_id"], r["n_words"], r["kept"]) for r in got), key=str)


def expected(rows, window=WINDOW):
    return sorted(((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], window), strict=True)), key=str)


@pytest.mark.parametrize(("window", "unit"), [(1, 1 << 20), (2, 100), (5, 60), (6, 1), (9, 1000)])
def test_small_alphabet(spark, window, unit):
    """Few different words, so windows repeat within and across documents, units and blocks."""
    r = random.Random(window)
    rows = [(k, r.choice([" ", "\n", "\t "]).join(r.choice("abc") if k % 3 else r.choice("abcdefghij") for _ in range(r.randint(0, 60))), "en", "s") for k in range(60)]
    assert found(spark, rows, window=window, unit=unit) == expected(rows, window)


def test_passages(spark):
    """Passages shared at any offset, copies, a text that repeats itself, and one word over and over."""
    r = random.Random(3)
    some = lambda n: [f"w{r.randint(0, 5000)}" for _ in range(n)]
    shared = [some(n) for n in (34, 35, 36, 60, 200)]
    rows = [(k, " ".join(some(r.randint(0, 90)) + shared[k % 5] + some(r.randint(0, 90))), "en", "s") for k in range(80)]
    rows += [(1000 + k, " ".join(some(300) if k < 2 else shared[4]), "en", "s") for k in range(30)]
    twice = some(50)
    rows += [(2000, " ".join(twice + some(10) + twice), "en", "s"), (2001, "la " * 500, "en", "s"), (2002, " ".join(some(40000)), "en", "s")]
    assert found(spark, rows, unit=4000) == expected(rows)


def test_odd_rows(spark):
    rows = ODD + [(None, "x " * 40, None, None)] * 2 + [(8, " ".join("ab" * 50), "en", "s")]
    assert found(spark, rows) == expected(rows)
    assert without_repeats(table(spark, [])).count() == 0


def test_runs():
    """Equal runs have equal hashes, wherever they start, and others differ."""
    import numpy as np

    code = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4], np.uint64)
    for n in (1, 2, 3, 4, 5):
        hashes = runs(code, n).tolist()
        assert len(hashes) == len(code) - n + 1
        same = {(i, j) for i in range(len(hashes)) for j in range(len(hashes)) if code[i : i + n].tolist() == code[j : j + n].tolist()}
        assert same == {(i, j) for i in range(len(hashes)) for j in range(len(hashes)) if hashes[i] == hashes[j]}
    assert len(runs(code, 10)) == 0


def test_query(spark):
    import hashlib

    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = {(d["doc_id"], n, n - len(k.split()), hashlib.sha256(k.encode()).hexdigest()) for d, (n, k) in zip(docs, brute([d["text"] for d in docs]), strict=True)}
    got = queries.op11_substrings(spark, DATA)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and {tuple(r) for r in got.collect()} == want
    assert any(w[2] for w in want)
