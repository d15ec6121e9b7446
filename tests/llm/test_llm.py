"""The training-data operators on small fixtures: odd cases, brute force, round trips."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriloom.llm import bitplanes, chat, common, exact_dedup, language, licenses, mixing, near_dedup, packing, quality, tokens, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, score string"
DATA = "/root/testdata/sf0.001"


def table(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), "x", "y", "z") for i, t, g, s in rows], DOCS)


def words(n, seed, kind=""):
    r = random.Random(seed)
    return " ".join(kind + "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))


LONG = words(30_000, 1)
ODD = [(1, "a b", "en", "s"), (2, "a  b", "en", "s"), (3, None, None, None), (4, "", "en", "t"), (None, "a\tb", "fr", "s"), (5, LONG, "en", None), (5, LONG, "en", None), (6, "\n \n", "xx", "t"), (7, "ünïcode   text, 1.5!", "fr", "t"), (7, "other", "fr", "t")]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[squeezed(t)].append(i)
    out = []
    for i, t, *_ in rows:
        own = groups[squeezed(t)]
        low = min((x for x in own if x is not None), default=None)
        out.append((i, low, len(own), i == low, hashlib.sha256(squeezed(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("budget", [128 << 20, 3000])
def test_exact_dedup(spark, odd, empty, budget):
    rows = ODD + [(100 + k, words(40, k % 60), "en", "s") for k in range(180)]
    got = sorted(map(tuple, exact_dedup.exact_dedup(table(spark, rows), budget=budget).collect()), key=str)
    assert got == brute_exact(rows)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_trie_sheds_at_any_depth():
    """Subtrees leave below a shared start too; the size stays near the budget, and no string is lost."""
    r, trie, budget, back, peak = random.Random(4), exact_dedup.Trie(), 60_000, [], 0
    keys = [(b"http://" if r.random() < 0.5 else b"https://") + bytes(r.choice(b"abcdef") for _ in range(r.randint(1, 200))) for _ in range(4000)]
    for k, key in enumerate(keys):
        if name := trie.insert(key, str(k), k, 1):
            back.append((name, key))
        elif trie.size > budget:
            back += [(name, word) for name, before, top in trie.shed(budget // 2) for word, _ in trie.terminals(top, before)]
        peak = max(peak, trie.size)
    kept = [word for word, _ in trie.terminals()]
    assert peak <= budget + 1000 and trie.size == sum(len(n.label) + 200 for n in exact_dedup._nodes(trie.root)) - 200
    assert set(kept) | {k for _, k in back} == set(keys) and not set(kept) & {k for _, k in back}
    one = exact_dedup.Trie()
    one.insert(b"x" * 9000, "s", 1, 1)
    assert list(one.shed(100)) == []


def test_squeeze():
    r = random.Random(2)
    for _ in range(2000):
        text = "".join(r.choice("ab \t\n\x0b\x0c\r \x1c") for _ in range(r.randint(0, 9)))
        assert exact_dedup.squeeze(text.encode()).decode() == squeezed(text)


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, total = {s: 0.0 for s in names}, sum(sizes.values())
    full, left = set(), float(total)
    while left > 1e-9 and len(full) < len(names):
        free = [s for s in names if s not in full]
        share = left / sum(w[s] for s in free)
        over = [s for s in free if w[s] * share >= most * sizes[s]]
        for s in over:
            target[s] = float(most * sizes[s])
            full.add(s)
        if not over:
            for s in free:
                target[s] = w[s] * share
            break
        left = total - sum(target[s] for s in full)
    return target


def test_mixing(spark, odd, empty):
    rows = [(k, words(1 + k % 50, k), "en", "abcd"[min(3, k % 11)] if k % 17 else None) for k in range(1500)] + ODD
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for i, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
    want = brute_targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]])
    for s in "abcd":
        assert taken[s] == pytest.approx(want[s], rel=0.02, abs=20)
    again = mixing.mix(table(spark, rows[::-1]).repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.mix(empty).count() == 0
    assert {r["taken"] for r in mixing.mix(table(spark, [(1, None, "en", "s"), (2, " ", "en", None)])).collect()} == {0}


def test_mixing_means(spark):
    """Over many seeds a document is taken as often as its rate says."""
    rows = table(spark, [(k, words(5 + k, k), "en", "ab"[k % 2]) for k in range(12)])
    sums, n = Counter(), 12
    for seed in range(n):
        for r in mixing.mix(rows, seed=1000 * seed).collect():
            sums[r["source"]] += r["copies"]
    rate = {r["source"]: r["target"] / r["source_size"] for r in mixing.mix(rows).collect()}
    for s in "ab":
        assert sums[s] / n / 6 == pytest.approx(rate[s], rel=0.25)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(name):
    own, r = tokens.Encoder(tokens.vocabulary(name)), random.Random(4)
    parts = ["a", "Be", " ", "  ", "\n", "\t", "1", "'s", ".", ",", "é", "b. ", "c,\n", "..", " ", "́", "<|endoftext|>", "\x1c", "\x85", "\r", "Σ", "中", "½", "\x01"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    for at in range(0, len(texts), 100):
        assert own.encode(texts[at : at + 100]) == own.library(texts[at : at + 100])


def check_packing(spark, rows, got, most=2048):
    own, docs = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json")), Counter()
    for i, t, *_ in rows:
        ids = own.library([t or ""])[0] + b"\0\0\0\0"
        for k, (a, n) in enumerate(packing.cut(len(ids) // 4, most)):
            docs[i, k, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == docs
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own_places in places.values():
        end = 0
        for offset, n in sorted(own_places):
            assert offset == end
            end += n
        assert end <= most
    return places


def test_packing(spark, odd, empty):
    path = tokens.vocabulary("byte_bpe_50k.json")
    rows = ODD + [(100 + k, words(20 + 37 * k % 400, k), "en", "s") for k in range(300)]
    got = packing.pack(table(spark, rows), path).collect()
    places = check_packing(spark, rows, got)
    assert len(places) <= 1.02 * sum(r["length"] for r in got) / 2048 + 1
    assert packing.pack(empty, path).count() == 0


def test_packing_capacities():
    r = np.random.default_rng(3)
    lengths = r.integers(1, 100, 400)
    for rule in ("norm", "dot"):
        capacity = packing.Capacity(100, 3, 5200, (1.0, 0.5, 0.5), rule)
        fit = lengths[lengths.astype(int) ** 2 <= 5200]
        where, offset = packing.best_fit(fit, capacity)
        for b in set(where):
            own = fit[where == b]
            assert own.sum() <= 100 and len(own) <= 3 and (own**2).sum() <= 5200
            assert sorted(offset[where == b]) == [0, *np.cumsum(own[np.argsort(offset[where == b])])[:-1]]


def test_planes():
    r = np.random.default_rng(1)
    for ids in (r.integers(0, 49_000, 70_000), np.array([], int), np.array([2**32 - 1, 0, 7]), np.zeros(5, int)):
        ids = ids.astype("<u4")
        for unit in ("bit", "byte"):
            assert (bitplanes.restored(bitplanes.shuffled(ids, unit), len(ids), unit) == ids).all()


def test_crc_joined():
    for a, b in ((b"", b"x"), (b"abc", b""), (b"abc" * 50, b"defg" * 999)):
        assert bitplanes.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_bitplanes(spark, odd, empty, tmp_path, unit):
    path = tokens.vocabulary("word_bpe_49k.json")
    out = f"file://{tmp_path}/ids"
    bitplanes.write_ids(odd, path, out, 1, chunk=5000, unit=unit, parts=3)
    got = bitplanes.read_crcs(spark, out).collect()
    own, at, want = tokens.Encoder(path), 0, []
    for i, t, *_ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = own.library([t or ""])[0] + b"\1\0\0\0"
        want.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bitplanes.round_trip(empty, path, 1).count() == 0
    again = bitplanes.round_trip(odd, path, 1, chunk=777, unit=unit).collect()
    assert sorted(map(tuple, again), key=str) == sorted(want, key=str)
    some = spark.createDataFrame([(5,), (7,), (7,), (999,)], "doc_id long")
    ids = bitplanes.read_ids(spark, out, some).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in ids) == Counter((i, (*np.frombuffer(own.library([t])[0], "<u4").tolist(), 1)) for i, t, *_ in ODD if i in (5, 7))


def test_bitplanes_of_one_id(spark, tmp_path):
    """Rows of one id are dealt to several parts and keep their places."""
    path, out = tokens.vocabulary("word_bpe_49k.json"), f"file://{tmp_path}/ids"
    rows = table(spark, [(None, words(3, k % 5), "en", "s") for k in range(4000)])
    bitplanes.write_ids(rows, path, out, 1, parts=4)
    got = bitplanes.read_crcs(spark, out).collect()
    assert len(got) == 4000
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    parts = bitplanes.read_documents(spark, out).groupBy("part").count().collect()
    assert len(parts) >= 3 and max(p["count"] for p in parts) < 2500


def brute_near(rows, alike=0.8):
    grams, parent = {}, {}
    for k, (_, t, *_) in enumerate(rows):
        w = (t or "").lower().split()
        grams[k] = (Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter(), tuple(w))
        parent[k] = k

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in grams:
        for b in grams:
            if a < b:
                x, y = grams[a][0], grams[b][0]
                both = sum((x & y).values())
                if grams[a][1] == grams[b][1] or both and both / (sum(x.values()) + sum(y.values()) - both) >= alike:
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    return {rows[k][0]: root(k) for k in grams}


def test_near_dedup(spark, odd, empty):
    r, rows = random.Random(5), []
    for family in range(12):
        base = words(60 + 40 * family, family).split()
        for copy in range(9):
            own = list(base)
            for _ in range(r.randint(0, 1 + family // 2)):
                own[r.randrange(len(own))] = "changed" + str(r.random())[2:6]
            rows.append((len(rows), " ".join(own), "en", "s"))
    shared = words(55, 99)
    rows += [(len(rows) + k, words(70, 500 + k) + " " + shared, "en", "s") for k in range(60)]
    rows += [(9000 + k, words(k, 7), "en", "s") for k in range(8)]
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.near_dedup(table(spark, rows)).collect()}
    want = brute_near(rows)
    assert len(got) == len(rows)
    by_want, by_got = defaultdict(set), defaultdict(set)
    for i in want:
        by_want[want[i]].add(i)
        by_got[got[i]].add(i)
    assert sorted(map(sorted, by_got.values())) == sorted(map(sorted, by_want.values()))
    assert all(c == min(own) for c, own in by_got.items())
    assert near_dedup.near_dedup(odd).count() == len(ODD)
    assert near_dedup.near_dedup(empty).count() == 0


def grouped(of):
    out = defaultdict(set)
    for i, c in of.items():
        out[c].add(i)
    return sorted(map(sorted, out.values()))


def test_near_dedup_crowded_bucket(spark):
    """All alike pairs of one bucket are found, however many members are alike to none or one."""
    rows = []
    for k in range(60):
        base = words(80, 3000 + k)
        for t in (base, base + " more"):
            code = near_dedup.Words()(t.split())
            rows.append((k, f"{k:03}{t[-4:]}".encode(), len(near_dedup.kmers(code)), [1], bytearray(code.tobytes())))
    df = spark.createDataFrame(rows, "doc_id long, node binary, n int, buckets array<long>, words binary")
    roots = near_dedup.classes(df)
    got = defaultdict(set)
    for r in roots.collect():
        got[bytes(r["root"])].add(bytes(r["node"])[:3])
    assert len(got) == 60 and all(len(own) == 1 for own in got.values())


def test_near_dedup_chained(spark):
    """A family whose members are mostly under the threshold to each other, against brute force."""
    r, rows = random.Random(8), []
    texts = [words(100, 4000).split()]
    for k in range(1, 300):
        own = list(texts[r.randrange(max(0, k - 60), k)])
        for _ in range(r.randint(1, 5)):
            own[r.randrange(len(own))] = "changed" + str(k)
        texts.append(own)
    rows = [(k, " ".join(t), "en", "s") for k, t in enumerate(texts)]
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.near_dedup(table(spark, rows)).collect()}
    assert grouped(got) == grouped(brute_near(rows))


def test_near_dedup_large_family(spark):
    """1,500 changed copies of one text, most under the threshold to each other; no link between them is lost."""
    r = random.Random(12)
    base, drawn = words(110, 5000).split(), words(25, 5001).split()
    rows = []
    for k in range(1500):
        own = list(base)
        for _ in range(r.randint(0, 14)):
            own[r.randrange(len(own))] = r.choice(drawn)
        rows.append((k, " ".join(own), "en", "s"))
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.near_dedup(table(spark, rows)).collect()}
    codes = [near_dedup.kmers(near_dedup.Words()(t.split())) for _, t, *_ in rows]
    held, lost = [set(c.tolist()) for c in codes], 0
    for a in range(len(rows)):
        for b in range(a):
            if got[a] != got[b] and 1.8 * len(held[a] & held[b]) >= 0.8 * (len(held[a]) + len(held[b])):
                lost += 1
    sizes = Counter(got.values())
    assert lost == 0 and max(sizes.values()) > 300 and len(sizes) > 300


def test_rare_bound_loses_no_pair(spark):
    """Pairs that the bound passes over share too little, and those with rare k-mers in common are listed."""
    texts = [words(60, 6000).split() for _ in range(40)]
    r = random.Random(3)
    for t in texts:
        for _ in range(r.randint(0, 12)):
            t[r.randrange(60)] = "w" + str(r.randrange(30))
    texts = [list(t) for t in {tuple(t) for t in texts}]
    codes = [near_dedup.kmers(near_dedup.Words()(t)) for t in texts]
    rows = [(7, f"{k:02}".encode(), len(c), len(c), f"{k:02}".encode(), len(texts)) for k, c in enumerate(codes)]
    members = spark.createDataFrame(rows, "bucket long, node binary, n int, most int, root binary, size long")
    held = spark.createDataFrame([(f"{k:02}".encode(), bytearray(near_dedup.Words()(t).tobytes())) for k, t in enumerate(texts)], "node binary, words binary")
    left, more = near_dedup._bounded(members, held, 0.8)
    pairs = near_dedup._pairs(left, left, 0.8).select("a", "b").unionByName(more.select("a", "b")).distinct().collect()
    told = {frozenset((bytes(p["a"]), bytes(p["b"]))) for p in pairs}
    alike = {frozenset((f"{a:02}".encode(), f"{b:02}".encode())) for a in range(len(texts)) for b in range(a) if 1.8 * len(set(codes[a].tolist()) & set(codes[b].tolist())) >= 0.8 * (len(codes[a]) + len(codes[b]))}
    assert alike and alike <= told and len(told) < len(texts) * (len(texts) - 1) / 2


def test_chain_keeps_order():
    a = near_dedup.kmers(near_dedup.Words()(words(200, 1).split()))
    assert near_dedup.chain(a, a) == 1.0
    turned = np.concatenate([a[100:], a[:100]])
    assert near_dedup.chain(a, turned) == 0.0


def brute_chain(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for k, y in enumerate(b):
            row.append(before[k] + 1 if x == y else max(before[k + 1], row[k]))
    return row[-1] / (len(a) + len(b) - row[-1])


def test_chain_of_repeats(spark):
    """Repeated passages may match any of their occurrences."""
    code = lambda t: near_dedup.shingles(near_dedup.Words()(t.split()))
    r, u, x = words(24, 11), words(80, 12), words(80, 13)
    a, b = " ".join([r, u, r, x]), " ".join([u, r, x])
    assert near_dedup.chain(code(a), code(b)) == pytest.approx(brute_chain(code(a), code(b))) and brute_chain(code(a), code(b)) > 0.88
    assert len({d["class_id"] for d in near_dedup.near_dedup(table(spark, [(1, a, "en", "s"), (2, b, "en", "s")])).collect()}) == 1
    draw = random.Random(9)
    for _ in range(400):
        one = [draw.randrange(draw.choice((3, 40))) for _ in range(draw.randint(1, 90))]
        two = [v for v in one if draw.random() > 0.1]
        two.insert(draw.randint(0, len(two)), draw.randrange(50))
        want = brute_chain(one, two)
        assert near_dedup.chain(np.array(one, np.uint64), np.array(two, np.uint64)) == pytest.approx(want if want >= 0.8 else 0.0)


def brute_top(rows, k):
    usable = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in usable if i % 100 == 0}:
        found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i and len(v) == len(q))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:k])]
    return sorted(out)


def test_topk(spark):
    r = np.random.default_rng(6)
    rows = [(k, [float(x) for x in r.integers(-2, 3, 6) / 4]) for k in range(450)]
    rows += [(500, None), (501, [None] * 6), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (600, [1.0, 2.0]), (601, [3.0, 4.0]), (None, [0.0] * 6), (700, [1e12] * 6), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0, 10, shard_rows=16).collect()))
    assert got == brute_top(rows, 10)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_language(spark, odd, empty):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(spark.read.parquet(f"{DATA}/documents.parquet").select((F.col("doc_id") + 10_000).alias("doc_id"), F.upper("text").alias("text"), "lang", "source", "n_chars"))
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)
    out = language.identify(odd).collect()
    assert len(out) == len(ODD)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (3, 4, 6)} == {"und"}
    assert language.identify(empty).count() == 0
    one = language.identify(table(spark, [(1, "abc", "en", "s"), (2, "x", "en", "s"), (3, "12", "en", "s")])).collect()
    assert {r["lang_pred"] for r in one} <= {"en", "und"}


def test_codewords():
    for n in (2, 3, 4, 5, 9, 40):
        codes = language.codewords(n)
        apart = min((codes[a] != codes[b]).sum() for a in range(n) for b in range(a))
        assert apart >= (1 if n == 2 else 2) and len(codes) == n


def test_quality(spark, odd, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (99, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(odd, some).count() == len(ODD)
    assert {r["score"] for r in quality.classify(odd, some.limit(0)).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0


def test_licenses(spark, odd, empty):
    rows = [
        (1, "a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
        (2, "a/b/x.txt", "some words\nmore"),
        (3, "a/b/y.txt", "Licensed under the Apache License, Version 2.0.\n" + words(400, 3)),
        (4, "c/z.txt", words(50, 4)),
        (5, "a/b/c/LICENSE", "All rights reserved."),
        (6, "a/b/c/d/w.txt", "w"),
        (7, None, None),
        (8, "a/top.txt", ""),
        (8, "a/top.txt", ""),
        (9, "ab/q.txt", "q"),
    ]
    df = spark.createDataFrame([(i, p, t, "x") for i, p, t in rows], "doc_id long, path string, text string, score string")
    got = {r["doc_id"]: (r["license"], r["origin"], r["inherited_from"]) for r in licenses.scan(df).collect()}
    assert got == {1: ("MIT", "file", None), 2: ("MIT", "inherited", "a"), 3: ("Apache-2.0", "header", None), 4: (None, "none", None), 5: ("Proprietary", "file", None), 6: ("Proprietary", "inherited", "a/b/c"), 7: (None, "none", None), 8: ("MIT", "inherited", "a"), 9: (None, "none", None)}
    assert licenses.scan(df).count() == len(rows)
    assert licenses.scan(df.limit(0)).count() == 0


def test_licenses_of_roots(spark):
    """Relative and absolute roots hand their licences to their own folders only."""
    mit, isc = "Released under the MIT License.", licenses.TEMPLATES["ISC"][0]
    rows = [(1, "LICENSE", mit), (2, "src/a.py", "x"), (3, "src/deep/er/b.py", "y"), (4, "c.py", "z"), (5, "/LICENSE", isc), (6, "/src/a.py", "x"), (7, "/c.py", "w")]
    got = {r["doc_id"]: (r["license"], r["inherited_from"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", None), 2: ("MIT", ""), 3: ("MIT", ""), 4: ("MIT", ""), 5: ("ISC", None), 6: ("ISC", "/"), 7: ("ISC", "/")}
    relative = licenses.scan(spark.createDataFrame(rows[4:] + rows[1:2], "doc_id long, path string, text string")).where("doc_id = 2").first()
    assert relative["license"] is None


def test_licenses_wrapped_and_full(spark):
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:\n"
    gpl = " * This program is free software: you can redistribute it\n * and/or modify it under the terms of the GNU General\n * Public License as published by the Free Software\n * Foundation.\n"
    rows = [(1, "a/x.py", "# file\n" + bsd + words(300, 21)), (2, "b/y.c", "/*\n" + gpl + " */\n" + words(300, 22)), (3, "c/z.txt", words(80, 23))]
    rows += [(10 + k, f"d{k}/LICENSE", "Copyright 2020 A. Person\n\n" + text) for k, text in enumerate(licenses.FULL.values())]
    rows += [(100 + k, None, words(60, 800 + k)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.scan(df).collect()}
    assert got[1] == ("BSD-3-Clause", "header") and got[2] == ("GPL-3.0", "header") and got[3] == (None, "none")
    assert [got[10 + k] for k in range(len(licenses.FULL))] == [(name, "file") for name in licenses.FULL]


def test_license_anchors_lose_nothing(spark):
    """Lines that anchors pass over are under the threshold."""
    docs = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    df = Counter({"": len(docs)})
    for t in docs:
        df.update(set(licenses.WORD.findall(t.lower())) & set(licenses.VOCABULARY))
    own = licenses.Matcher(df, licenses.ALIKE)
    for t in docs:
        best = max([own.best(licenses.WORD.findall(line)) for line in t.lower().split("\n")], key=lambda x: x[1])
        assert (own.scan(t)[0] is None) == (best[0] is None and own.best(licenses.WORD.findall(t.lower()))[0] is None)


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (2, 0, None, "x"), (None, None, "a<b", "y"), (3, 0, "system", "alone"), (1, 2000, "bob", "late"), (1, 2000, "bob", "late")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    got = chat.rotate(df).collect()
    told = defaultdict(list)
    for r in sorted(got, key=lambda r: r["pos"]):
        told[r["conv_id"], r["perspective"]].append(r)
    assert set(told) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "a b")}
    ann = told[1, "ann"]
    whole = "".join(r["rendered"] for r in ann)
    assert whole.startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n")
    assert [r["pos"] for r in ann] == list(range(6))
    trained = [whole[r["mask_start"] : r["mask_end"]] for r in ann if r["mask_start"] is not None]
    assert trained == ["hi<|im_end|>", "bye<|im_end|>"]
    assert all(whole[r["char_start"] : r["char_end"]] == r["rendered"] for r in ann)
    assert chat.rotate(df.limit(0)).count() == 0


def test_split_hot(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id")).alias("k"), "id")
    per = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    got = common.split_hot(rows, ["k"], per, "n", 1000, 10)
    assert got.where("top >= id").count() == 1000 and got.columns == ["k", "id", "n", "top"]
