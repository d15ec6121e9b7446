"""Near-duplicate detection by Order MinHash.

A text's k-mers are its shingles of five lower-cased words.  For the sketch each is
labelled with how often it came before, so all of a text differ.  For each of BANDS hash
functions the k-mers with the LENGTH smallest values are taken in text order;
texts that agree on such a tuple share a bucket.  Texts of few words use shorter
tuples.  Candidates are verified by alignment: the longest chain of common k-mers,
without labels, that keeps their order in both texts (a longest common subsequence;
one that reaches a similarity of 0.8 can't leave the band of diagonals that this
allows).  The similarity is chain / (a + b - chain).

Equal texts are one node.  The members of a bucket meet its hubs (members drawn by
hash) in rounds, each with more hubs than the one before.  After a round, linked
nodes form classes; members of one class don't meet again, and a hub, which has met
all, leaves its bucket.  A bucket ends when its members are of one class, so any two
members of different classes have met, unless their lengths rule out a likeness.
After the first round so may the k-mers that few of the texts still open have: in a
large family whose members differ, each in places of its own, few pairs are left.

Results in the odd cases: null text counts as empty; texts without words are one
class; texts with fewer than three k-mers are alike only if equal in their words;
null and repeated ids are rows like any other, and a class takes the smallest
non-null id of its rows; an empty table gives an empty result; other columns do
not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import discarded, few, releasing, sized, split_hot, written
from veriloom.llm.graph import components

PAIR = "a binary, b binary, a_root binary, b_root binary, similarity double"
WORDS = 5
ALIKE = 0.8
BANDS = 32
#: k-mers in a tuple: of texts with at least LONG k-mers, and of those with at most BRIEF.
LENGTH, BRIEF_LENGTH = 6, 3
LONG, BRIEF = 40, 50
#: Hubs of a bucket in the first, second and so on, and in all further rounds.
HUBS = (2, 32, 512)
#: A k-mer that at most so many open texts have is rare.
RARE = 8
#: K-mers that a task verifying pairs remembers.
HELD = 1_000_000
#: Digests of texts that a task sketching them remembers.
SEEN = 1_000_000
#: Bytes of words that may be broadcast; beyond that texts are joined by shuffle.
SMALL = 8 << 20


ODD = np.random.default_rng(11).integers(1 << 32, 1 << 63, (BANDS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX[0]
    return x ^ (x >> np.uint64(29))


class Words:
    """32-bit hashes of words; a bounded memory of those seen."""

    def __init__(self, held: int = 200_000) -> None:
        self.known: dict[str, int] = {}
        self.held = held

    def __call__(self, words: list[str]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.held:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), np.uint32, len(words))


def shingles(words: np.ndarray) -> np.ndarray:
    """The k-mers of a text in order, as 64-bit hashes; equal ones repeat."""
    w, n = words.astype(np.uint64), max(1, len(words) - WORDS + 1) if len(words) else 0
    code = np.zeros(n, np.uint64)
    for k in range(WORDS):
        part = w[k : k + n]
        code[: len(part)] = spread(code[: len(part)] + part * MIX[k])
    return code


def kmers(words: np.ndarray) -> np.ndarray:
    """The occurrence-labelled k-mers of a text in order, as 64-bit hashes."""
    code = shingles(words)
    order = np.argsort(code, kind="stable")
    same = np.concatenate([[False], code[order][1:] == code[order][:-1]])
    place = np.arange(len(code))
    first = np.maximum.accumulate(np.where(same, 0, place))
    seen = np.empty(len(code), np.uint64)
    seen[order] = (place - first).astype(np.uint64)
    return spread(code + seen * MIX[2])


def sketch(code: np.ndarray) -> list[int]:
    """A bucket number for each band and, for some texts, tuple length."""
    out: list[int] = []
    n = len(code)
    lengths = [BRIEF_LENGTH] * (BRIEF_LENGTH <= n <= BRIEF) + [LENGTH] * (n >= LONG)
    if not lengths:
        return out
    value = code * ODD
    value ^= value >> np.uint64(32)
    for length in lengths:
        least = np.argpartition(value, length - 1, axis=1)[:, :length] if n > length else np.tile(np.arange(n), (BANDS, 1))
        tuples, key = code[np.sort(least, 1)], np.arange(BANDS, dtype=np.uint64) + np.uint64(1000 * length)
        for k in range(length):
            key = spread(key * MIX[3] + tuples[:, k])
        out += key.view(np.int64).tolist()
    return out


def chain(a: np.ndarray, b: np.ndarray, alike: float = ALIKE) -> float:
    """Similarity by alignment, or 0 if it is under ``alike``."""
    both = len(a) + len(b)
    least = int(np.ceil(alike * both / (1 + alike) - 1e-9))
    if min(len(a), len(b)) < least or not both:
        return 0.0
    # a common start and end belong to some longest common subsequence
    ends = 0
    for step in (1, -1):
        n = min(len(a), len(b))
        same = a[::step][:n] == b[::step][:n]
        lead = n if same.all() else int(same.argmin())
        a, b, ends = (a[lead:], b[lead:], ends + lead) if step == 1 else (a[: len(a) - lead], b[: len(b) - lead], ends + lead)
    size = ends + _common(a, b, least - ends)
    return size / (both - size) if size >= least else 0.0


def _common(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Length of the longest common subsequence, or less than ``least`` if that is out of reach."""
    from bisect import bisect_left

    codes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    in_a, in_b = np.bincount(at[: len(a)], minlength=len(codes)), np.bincount(at[len(a) :], minlength=len(codes))
    shared = np.minimum(in_a, in_b)
    if shared.sum() < least or not shared.any():
        return 0
    x, y = at[: len(a)], at[len(a) :]
    x, y = x[shared[x] > 0], y[shared[y] > 0]
    if len(x) == len(y) == shared.sum() and shared.max() == 1:
        place = np.empty(len(codes), np.int64)
        place[y] = np.arange(len(y))
        tails: list[int] = []
        for p in place[x].tolist():
            k = bisect_left(tails, p)
            tails[k : k + 1] = [p]
        return len(tails)
    return _bits(x, y)


def _bits(x: np.ndarray, y: np.ndarray, few: int = 64) -> int:
    """The same, for repeated codes: a row of the alignment is one integer of ``len(y)`` bits."""
    order = np.argsort(y, kind="stable")
    cuts = np.flatnonzero(np.diff(y[order])) + 1
    places = {int(y[p[0]]): p.tolist() for p in np.split(order, cuts)}
    held: dict[int, int] = {}  # rows of frequent codes; there are at most len(y) / few of them
    full = (1 << len(y)) - 1
    row = full
    for code in x.tolist():
        match = held.get(code)
        if match is None:
            match = sum(1 << p for p in places[code])
            if len(places[code]) >= few:
                held[code] = match
        kept = row & match
        row = ((row + kept) | (row - kept)) & full
    return len(y) - row.bit_count()


def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its text's digest; each distinct text of a task with its sketch and words."""
    own, seen = Words(), set()
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = (text or "").lower().split()
            digest = hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if digest in seen:
                rows.append((doc_id, digest, None, None, None))
                continue
            if len(seen) > SEEN:
                seen.clear()
            seen.add(digest)
            hashes = own(words)
            code = kmers(hashes)
            rows.append((doc_id, digest, len(code), sketch(code), hashes.tobytes()))
            if len(rows) >= 512:
                yield _rows(rows)
                rows = []
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary())
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "node", "n", "buckets", "words"])


def _verified(alike: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        held = 0

        def code(words: bytes) -> np.ndarray:
            nonlocal held
            if (out := known.get(words)) is None:
                if held > HELD:
                    known.clear()
                    held = 0
                known[words] = out = shingles(np.frombuffer(words, np.uint32))
                held += len(out)
            return out

        for batch in batches:
            score = [chain(code(a), code(b), alike) for a, b in zip(batch.column("a_words").to_pylist(), batch.column("b_words").to_pylist(), strict=True)]
            kept = ["a", "b", "a_root", "b_root"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(score, pa.float64())], names=[*kept, "similarity"])

    return run


def classes(rows: DataFrame, alike: float = ALIKE) -> DataFrame | None:
    """node, root of the nodes that are linked to others, or None if none is.

    In each round the members of a bucket meet those of its hubs that are of another
    class, if what the two may share allows a likeness; new links join classes, and
    the classes, not their members, go into the next round.  Hubs leave, and buckets
    of one class are done; the search ends when no bucket is left.
    """
    first = rows.where("words is not null and size(buckets) > 0").select("node", "n", "buckets").dropDuplicates(["node"])
    each = first.select(F.explode("buckets").alias("bucket"), "node", "n")
    crowded = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(each.join(crowded, "bucket").select("bucket", "node", "n", F.col("n").alias("most"), F.col("node").alias("root"), "size"), "members")
    words = written(_needed(rows.where("words is not null").select("node", "words"), members), "words")
    roots, more, met, level, left = None, None, [], 0, members.count()
    while left or more is not None:
        share = F.pmod(F.xxhash64(F.lit(level), "node"), F.lit(1 << 30)) / float(1 << 30)
        is_hub = share * F.col("size") < HUBS[min(level, len(HUBS) - 1)]
        pairs = _pairs(members.withColumn("is_hub", is_hub), alike, level > 0)
        verified = _met(pairs if more is None else pairs.unionByName(more), words, met, alike)
        links = verified.where("similarity > 0").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        stay = members.where(~is_hub)
        if not links.isEmpty():
            joined = components(links)
            roots = joined if roots is None else _followed(roots, joined)
            stay = stay.join(few(joined).select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").withColumn("root", F.coalesce("to", "root"))
        met.append(verified)
        before, members, more = members, written(_open(stay), "members", parts=sized(left)), None
        left = members.count()
        if level == 0 and left:
            shared = written(_needed(words, members), "words")
            discarded(before, words)
            before, words = members, shared
            members, more = _bounded(members, shared, alike)
            left = members.count()
        discarded(before)
        level += 1
    discarded(members, words, *met)
    return roots


def _needed(words: DataFrame, members: DataFrame) -> DataFrame:
    """The words of the members, one row for each node."""
    nodes = written(members.select("node").distinct(), "needed")
    return words.join(few(nodes), "node", "left_semi").dropDuplicates(["node"])


def _may(most: Column, n: Column, alike: float) -> Column:
    """If texts of ``n`` k-mers together that share at most ``most`` may be alike."""
    return most * (1 + alike) >= alike * n - 1e-6


def _pairs(members: DataFrame, alike: float, once: bool) -> DataFrame:
    """Members with hubs of another class in their bucket that they may be alike to.

    Of two hubs of a bucket one meets the other.  ``once``: a member meets a hub in the
    smallest of the buckets alone in which it could, not in each that they share; for that
    each row carries its node's open buckets, so the first round, in which most rows are of
    buckets that it will close, does without.
    """
    if once:
        each = members.groupBy("node", "n", "most", "root").agg(F.collect_list(F.struct("bucket", "is_hub")).alias("open"))
        members = each.select("node", "n", "most", "root", F.col("open.bucket").alias("own"), F.filter("open", lambda x: x["is_hub"])["bucket"].alias("led"), F.explode("open").alias("at")).select("*", "at.*").drop("at")
    hubs = members.where("is_hub").select("bucket", *[F.col(c).alias(f"hub_{c}") for c in ("node", "n", "most", "root", *["led"] * once)])
    may = _may(F.least("most", "hub_most"), F.col("n") + F.col("hub_n"), alike) & (~F.col("is_hub") | (F.col("node") > F.col("hub_node")))
    if once:
        may &= F.array_min(F.array_intersect("own", "hub_led")) == F.col("bucket")
    met = members.join(hubs, "bucket").where((F.col("root") != F.col("hub_root")) & may)
    own = F.col("node") > F.col("hub_node")
    order = lambda one, other: F.when(own, F.col(one)).otherwise(F.col(other))
    return met.select(order("node", "hub_node").alias("a"), order("hub_node", "node").alias("b"), order("root", "hub_root").alias("a_root"), order("hub_root", "root").alias("b_root"))


def _met(pairs: DataFrame, words: DataFrame, met: list[DataFrame], alike: float) -> DataFrame:
    """The pairs that did not meet before, with their similarity."""
    had = F.lit(None).cast("binary")
    every = pairs.withColumn("had", F.lit(False))
    for earlier in met:
        every = every.unionByName(earlier.select("a", "b", had.alias("a_root"), had.alias("b_root"), F.lit(True).alias("had")))
    pairs = every.groupBy("a", "b").agg(F.max("a_root").alias("a_root"), F.max("b_root").alias("b_root"), F.max("had").alias("had")).where("not had").drop("had")
    first, second = words.select(F.col("node").alias("a"), F.col("words").alias("a_words")), words.select(F.col("node").alias("b"), F.col("words").alias("b_words"))
    if (words.agg(F.sum(F.length("words") + 64)).first()[0] or 0) <= SMALL:
        first, second = F.broadcast(first), F.broadcast(second)
    scored = pairs.join(second, "b").join(first, "a").sortWithinPartitions("a")
    return written(scored.mapInArrow(releasing(_verified(alike)), PAIR), "met", rows=256)  # a row holds two whole texts


def _followed(roots: DataFrame, joined: DataFrame) -> DataFrame:
    """``roots`` after its roots, and nodes of no class so far, went into ``joined``."""
    to = written(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "joined")
    moved = roots.join(few(to), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    fresh = to.join(few(roots.select("node")), F.col("root") == F.col("node"), "left_anti").select(F.col("root").alias("node"), F.col("to").alias("root"))
    out = written(moved.unionByName(fresh), "roots")
    discarded(roots, to)
    return out


def _bounded(members: DataFrame, words: DataFrame, alike: float) -> tuple[DataFrame, DataFrame]:
    """Open members with a bound of what they share with others, and the pairs that the bound leaves out.

    ``most`` counts the labelled k-mers that occur in more than RARE open texts.  Two
    texts without a rarer one in common share at most the lesser of their ``most``;
    those with some are listed by joining the rare k-mers, each with RARE texts at
    most, and may share these besides.
    """
    codes = words.mapInArrow(_labelled, "node binary, code long")
    rare = codes.groupBy("code").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= RARE)
    rare = written(codes.join(rare, "code").select("code", "node", "k"), "rare")
    own = rare.groupBy("node").agg(F.count(F.lit(1)).alias("rare"))
    most = (F.col("n") - F.coalesce("rare", F.lit(0))).cast("int")
    bounded = members.join(own, "node", "left").withColumn("most", most).drop("rare")
    nodes = written(bounded.select("node", "n", "most", "root").distinct(), "bounds")
    held = rare.where("k > 1")
    common = held.select("code", F.col("node").alias("a")).join(held.select("code", F.col("node").alias("b")), "code").where("a > b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    of = lambda end: few(nodes.select(*[F.col(c).alias(f"{end}_{c}") for c in nodes.columns]))
    met = common.join(of("a"), F.col("a") == F.col("a_node")).join(of("b"), F.col("b") == F.col("b_node"))
    may = _may(F.col("common") + F.least("a_most", "b_most"), F.col("a_n") + F.col("b_n"), alike)
    more = written(met.where(may & (F.col("a_root") != F.col("b_root"))).select("a", "b", "a_root", "b_root"), "more")
    out = written(_open(bounded.where(_may(F.col("most"), F.col("n") + F.col("most"), alike))), "members")
    discarded(rare, nodes)
    return out, more


def _labelled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, words in zip(batch.column("node").to_pylist(), batch.column("words").to_pylist(), strict=True):
            code = kmers(np.frombuffer(words, np.uint32)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([node] * len(code), pa.binary()), pa.array(code)], names=["node", "code"])


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets in which several classes meet, with the number of its members."""
    ends = members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high").select("bucket", "size")
    return members.drop("size").join(ends, "bucket").select("bucket", "node", "n", "most", "root", "size")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alike: float = ALIKE) -> DataFrame:
    """One row per input row: doc_id, class_id, class_size, kept.

    ``class_id`` is the smallest id of the class, ``kept`` marks the row that stays.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(rows.mapInArrow(releasing(_sketches), "doc_id long, node binary, n int, buckets array<long>, words binary"), "sketches")
    roots = classes(rows, alike)
    ids = written(rows.select("doc_id", "node"), "ids")
    discarded(rows)
    per = ids.groupBy("node").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    per = per.withColumn("root", F.col("node")) if roots is None else per.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per = written(per, "nodes")
    groups = per.groupBy("root").agg(F.min("low").alias("class_id"), F.sum("copies").alias("class_size")).where("class_size > 1")
    known = written(per.join(groups, "root").select("node", "copies", "class_id", "class_size"), "known")
    met = split_hot(ids, ["node"], known, "copies", ids.count())
    alone = F.col("class_size").isNull()
    return met.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"),
    )
