"""Exact deduplication by Patricia-trie owners.

Texts are compared after every run of ASCII white space became one space.  Each
map task sends a distinct text once, with the smallest id and the number of its
rows, to the partition of its length and content hash.  There a compressed
radix trie takes the full byte strings; equal strings, and only they, end in the
same node, which keeps the smallest identifier.  A trie that outgrows its budget
gives up its largest subtrees, at any depth: their strings go back to the shared
folder and are dealt out anew, by length, hash and round, in a further round.

Results in the odd cases: null text counts as empty and equals an empty one; a
null id sorts last, so it owns a group only when all ids of the group are null;
rows that repeat an id are counted each; an empty table gives an empty result.
Input columns other than the id and the text do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import releasing, split_hot, written

OWNER = "sha string, len long, keep_id long, group_size long, spill string, norm binary"
#: Distinct digests that a map task holds before it hands their counts on.
HELD = 200_000


def squeeze(raw: bytes) -> bytes:
    """Every run of [\\x20\\x09-\\x0D] as one space."""
    words = raw.split()
    if not words:
        return b" " if raw else b""
    out = b" ".join(words)
    if raw[:1].isspace():
        out = b" " + out
    return out + b" " if raw[-1:].isspace() else out


def least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class Node:
    __slots__ = ("label", "kids", "owner", "count", "sha", "gone")

    def __init__(self, label: bytes, gone: str = ""):
        #: ``gone`` names a subtree that left: a node that stands for it
        self.label, self.kids, self.owner, self.count, self.sha, self.gone = label, None, None, 0, "", gone


class Trie:
    """A Patricia trie over byte strings; ``size`` is the bytes of its labels."""

    def __init__(self) -> None:
        self.root, self.size = Node(b""), 0

    def insert(self, key: bytes, sha: str, owner: int | None, count: int) -> str:
        """The empty string, or the name of the subtree that ``key`` belongs to, if that left."""
        node, at = self.root, 0
        while at < len(key):
            if node.kids is None:
                node.kids = {}
            kid = node.kids.get(key[at])
            if kid is None:
                kid = Node(key[at:])
                node.kids[key[at]] = kid
                self.size += len(kid.label) + 200
                node, at = kid, len(key)
                break
            if kid.gone:
                return kid.gone
            label = kid.label
            if key.startswith(label, at):
                node, at = kid, at + len(label)
                continue
            n = common(label, key[at : at + len(label)])
            upper = Node(label[:n])
            upper.kids = {label[n]: kid}
            kid.label = label[n:]
            node.kids[key[at]] = upper
            self.size += 200
            node, at = upper, at + n
        node.owner = least(node.owner, owner) if node.count else owner
        node.count += count
        node.sha = sha
        return ""

    def terminals(self, top: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, Node]]:
        stack = [(prefix, top or self.root)]
        while stack:
            before, node = stack.pop()
            word = before + node.label
            if node.count:
                yield word, node
            stack += [(word, kid) for kid in (node.kids or {}).values()]

    def shed(self, goal: int) -> Iterator[tuple[str, bytes, Node]]:
        """Cuts off subtrees, the heaviest at any depth, until ``size`` is at most ``goal``.

        Gives the name of each, the bytes before it and its top node.  One string stays
        in any case, so each round settles some.
        """
        weight: dict[int, int] = {}
        ends: dict[int, int] = {}
        order = list(_nodes(self.root))
        for node in reversed(order):
            kids = (node.kids or {}).values()
            weight[id(node)] = len(node.label) + 200 + sum(weight[id(k)] for k in kids)
            ends[id(node)] = (node.count > 0) + sum(ends[id(k)] for k in kids)
        while self.size > goal:
            node, before, path = self.root, b"", [self.root]
            while True:
                left = [(weight[id(k)], c, k) for c, k in (node.kids or {}).items() if not k.gone]
                if not left:
                    return
                heavy, first, kid = max(left, key=lambda x: x[:2])
                rest = ends[id(self.root)] - ends[id(kid)]
                if any(not k.gone for k in (kid.kids or {}).values()) and (not rest or heavy > self.size - goal):
                    node, before = kid, before + kid.label
                    path.append(kid)
                    continue
                break
            if not rest:
                return
            name = _name(before, first)
            mark = node.kids[first] = Node(b"", name)
            weight[id(mark)], ends[id(mark)] = 200, 0
            for upper in path:
                weight[id(upper)] -= heavy - 200
                ends[id(upper)] -= ends[id(kid)]
            self.size -= heavy - 200
            yield name, before, kid


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct text of a task once; later copies add to the counts only."""
    held: dict[bytes, list] = {}

    def counts():
        rows = [(k.hex(), v[0], v[1], v[2], None) for k, v in held.items() if v[2]]
        held.clear()
        return _batch(rows)

    for batch in batches:
        out = []
        for doc_id, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
            norm = squeeze(text or b"")
            sha = hashlib.sha256(norm).digest()
            if (had := held.get(sha)) is None:
                held[sha] = [len(norm), None, 0]
                out.append((sha.hex(), len(norm), doc_id, 1, norm))
            else:
                had[1], had[2] = least(had[1], doc_id) if had[2] else doc_id, had[2] + 1
        yield _batch(out)
        if len(held) > HELD:
            yield counts()
    yield counts()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["sha", "len", "min_id", "n", "norm"])


def _tries(budget: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, spilled, late = Trie(), {}, {}
        for batch in batches:
            back = []
            for sha, n, low, count, norm, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if norm is None:
                    a = late.get((sha, n))
                    late[sha, n] = (least(a[0], low) if a else low, (a[1] if a else 0) + count)
                    continue
                if name := trie.insert(norm, sha, low, count):
                    back.append((sha, n, low, count, name, norm))
                    spilled[sha, n] = name
                elif trie.size > budget:
                    for name, before, top in trie.shed(budget // 2):
                        for word, end in trie.terminals(top, before):
                            back.append((end.sha, len(word), end.owner, end.count, name, word))
                            spilled[end.sha, len(word)] = name
            yield _owned(back)
        done, seen = [], set()
        for word, end in trie.terminals():
            key = (end.sha, len(word))
            if key in seen:
                raise ValueError("two different texts have the same SHA-256")
            seen.add(key)
            low, more = late.pop(key, (None, 0))
            done.append((end.sha, len(word), least(end.owner, low) if more else end.owner, end.count + more, None, None))
            if len(done) >= 5000:
                yield _owned(done)
                done = []
        for (sha, n), (low, more) in late.items():
            done.append((sha, n, low, more, spilled[sha, n], None))
        yield _owned(done)

    return run


def _nodes(top: Node) -> Iterator[Node]:
    stack = [top]
    while stack:
        node = stack.pop()
        yield node
        stack += (node.kids or {}).values()


def _name(before: bytes, first: int) -> str:
    return hashlib.md5(before + bytes([first])).hexdigest()


def _owned(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["sha", "len", "keep_id", "group_size", "spill", "norm"])


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 128 << 20) -> DataFrame:
    """One row per distinct text: sha, len, keep_id (its smallest id), group_size.

    ``budget`` bounds the bytes of one trie; what exceeds it leaves by subtree and
    is inserted in a further round.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    todo = rows.mapInArrow(releasing(_distinct), "sha string, len long, min_id long, n long, norm binary")
    todo = todo.withColumn("part", F.xxhash64("len", "sha"))
    done, level = None, 0
    while True:
        level += 1
        made = written(todo.repartition("part").mapInArrow(releasing(_tries(budget)), OWNER), "owners")
        settled = made.where("spill is null").select("sha", "len", "keep_id", "group_size")
        done = settled if done is None else done.unionByName(settled)
        rest = made.where("spill is not null")
        if rest.isEmpty():
            return done
        todo = rest.select("sha", "len", F.col("keep_id").alias("min_id"), F.col("group_size").alias("n"), "norm", F.xxhash64("len", "sha", F.lit(level)).alias("part"))


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        norms = [squeeze(x or b"") for x in batch[1].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch[0], pa.array([hashlib.sha256(x).hexdigest() for x in norms], pa.string()), pa.array([len(x) for x in norms], pa.int64())], names=["doc_id", "sha", "len"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 128 << 20) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``kept`` marks the row of the group's smallest id; if rows repeat that id,
    each of them is marked.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    own = owners(docs, id_col, text_col, budget)
    copied = own.where("group_size > 1")
    total = docs.count()
    ids = written(rows.mapInArrow(releasing(_digests), "doc_id long, sha string, len long"), "digests")
    met = split_hot(ids, ["sha", "len"], copied, "group_size", total)
    return met.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
