"""A prefix trie of conversations, built from adaptive radix trees.

A turn's id is a 16-byte digest of its role and text, and a conversation the ids of its turns
in big-endian order, one after the other.  Conversations come sorted, in ranges of ids.  A
task inserts its conversations into adaptive radix trees: inner nodes of 4, 16, 48 or 256
children that grow as needed, and paths of bytes without branches in one node.  Only
byte depths that are a whole number of turns emit nodes.  A node of the trie is named by the
chained digest of its turns, so that the nodes of all tasks can be summed by name.

What regards subtrees needs no levels.  A node belongs to its smallest member; as that
can only grow with depth, the nodes of a conversation are the lower end of its path.
Above, the path runs through the nodes of other conversations, one stretch each.  What a
conversation adds to its ancestors is noted once for each stretch, where the stretch
ends, and a running sum from the deepest node up gives every node its subtree.

Bounds: a task's trees are emitted and dropped at BUDGET bytes of keys; of a longer
conversation they hold SEGMENT turns at a time, each stretch in a tree of its own under
its prefix's digest.  The ids that end at a node come as sorted runs in order of ids and
are hashed as a stream.

Results in the odd cases: null role and text count as empty; rows with a null conv_id take
no part; turns are ordered by turn (null first), then role, then text, and repeated rows are
turns of their own; conversations without turns are members of the root; an empty table
gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.llm.common import discarded, releasing, written

WIDTH = 16
ROOT = bytes(WIDTH)
#: Turns of one conversation that a tree holds.
SEGMENT = 4096
#: Bytes of keys in a task's trees.
BUDGET = 8 << 20
NODE, PATH, ENDS = 0, 1, 2
PARTS = "kind int, node binary, depth long, n long, low long, bytes long, data binary"


class Sorted:
    """Up to 4 or 16 children in order of their bytes."""

    __slots__ = ("room", "keys", "kids")

    def __init__(self, room: int = 4) -> None:
        self.room, self.keys, self.kids = room, bytearray(), []

    def get(self, byte: int) -> Node | None:
        at = self.keys.find(byte)
        return None if at < 0 else self.kids[at]

    def put(self, byte: int, kid: Node) -> Layout:
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.kids[at] = kid
            return self
        if len(self.keys) == self.room:
            wider = Sorted(16) if self.room == 4 else Indexed()
            for k, v in zip(self.keys, self.kids, strict=True):
                wider.put(k, v)
            return wider.put(byte, kid)
        self.keys.insert(at, byte)
        self.kids.insert(at, kid)
        return self

    def __iter__(self) -> Iterator[Node]:
        return iter(self.kids)


class Indexed:
    """Up to 48 children, found by a table of 256 places."""

    __slots__ = ("places", "kids")
    NONE = 255

    def __init__(self) -> None:
        self.places, self.kids = bytearray([self.NONE] * 256), []

    def get(self, byte: int) -> Node | None:
        at = self.places[byte]
        return None if at == self.NONE else self.kids[at]

    def put(self, byte: int, kid: Node) -> Layout:
        at = self.places[byte]
        if at != self.NONE:
            self.kids[at] = kid
        elif len(self.kids) == 48:
            wider = Full()
            for b, place in enumerate(self.places):
                if place != self.NONE:
                    wider.put(b, self.kids[place])
            return wider.put(byte, kid)
        else:
            self.places[byte] = len(self.kids)
            self.kids.append(kid)
        return self

    def __iter__(self) -> Iterator[Node]:
        return (self.kids[at] for at in self.places if at != self.NONE)


class Full:
    """A place for each of 256 children."""

    __slots__ = ("kids",)

    def __init__(self) -> None:
        self.kids: list[Node | None] = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> Layout:
        self.kids[byte] = kid
        return self

    def __iter__(self) -> Iterator[Node]:
        return (k for k in self.kids if k is not None)


Layout = Sorted | Indexed | Full


class Node:
    """The end of a path of bytes: members that pass, the smallest, those that end, those that go on in another tree."""

    __slots__ = ("path", "kids", "n", "low", "ends", "stops")

    def __init__(self, path: bytes, n: int = 0, low: int | None = None) -> None:
        self.path, self.n, self.low = path, n, low
        self.kids: Layout = Sorted()
        self.ends: list[int] = []
        self.stops: list[int] = []


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common start of ``a`` and ``b[at:]``."""
    if b.startswith(a, at):
        return len(a)
    k = 0
    while k < len(a) and at + k < len(b) and a[k] == b[at + k]:
        k += 1
    return k


class Tree:
    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, key: bytes, member: int, final: bool = True) -> None:
        node, at = self.root, 0
        while True:
            node.n += 1
            node.low = member if node.low is None or member < node.low else node.low
            if at == len(key):
                (node.ends if final else node.stops).append(member)
                return
            kid = node.kids.get(key[at])
            if kid is None:
                kid = Node(key[at:])
                node.kids = node.kids.put(key[at], kid)
            elif (common := _shared(kid.path, key, at)) < len(kid.path):
                upper = Node(kid.path[:common], kid.n, kid.low)
                kid.path = kid.path[common:]
                upper.kids = upper.kids.put(kid.path[0], kid)
                node.kids = node.kids.put(key[at], upper)
                kid = upper
            at += len(kid.path)
            node = kid

    def emit(self, digest: bytes, depth: int, sizes: dict[bytes, int]) -> Iterator[tuple]:
        """Rows of PARTS for the turn-aligned depths below a prefix of this digest and depth; for the empty prefix too."""
        stack, trail, top = [(self.root, b"", digest, depth)], [], depth
        while stack:
            node, held, digest, depth = stack.pop()
            del trail[depth - top :]
            if node is self.root and not top:
                yield NODE, digest, 0, node.n, node.low, 0, None
            held += node.path
            for at in range(0, len(held) - WIDTH + 1, WIDTH):
                turn = held[at : at + WIDTH]
                digest, depth = chained(digest, turn), depth + 1
                trail.append(digest)
                yield NODE, digest, depth, node.n, node.low, sizes[turn], None
            held = held[len(held) - len(held) % WIDTH :]
            ids = np.sort(np.array(node.ends, np.int64))
            if len(ids):
                yield ENDS, digest, depth, None, int(ids[0]), None, ids.tobytes()
            # who owns no node down here owns none above; one that goes on may own some below
            for member in [*node.stops, *([node.low] if len(ids) and ids[0] == node.low else [])]:
                yield PATH, None, top, None, member, None, b"".join(trail)
            stack.extend((kid, held, digest, depth) for kid in node.kids)


def chained(digest: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(digest + turn, digest_size=WIDTH).digest()


def turn_id(role: bytes, text: bytes) -> bytes:
    return hashlib.blake2b(len(role).to_bytes(8, "big") + role + text, digest_size=WIDTH).digest()


class Forest:
    """A task's trees, by the digest and depth of the prefix that they stand under."""

    def __init__(self, segment: int) -> None:
        self.segment, self.trees, self.sizes, self.held = segment, {}, {}, 0
        self.start(None, [])

    def start(self, member: int | None, lead: list[bytes]) -> None:
        self.member, self.digest, self.depth, self.ids = member, ROOT, 0, bytearray()
        for turn in lead:
            self.add(turn)

    def add(self, turn: bytes) -> None:
        if len(self.ids) == self.segment * WIDTH:
            self._insert(False)
            for at in range(0, len(self.ids), WIDTH):
                self.digest = chained(self.digest, bytes(self.ids[at : at + WIDTH]))
            self.depth += self.segment
            self.ids.clear()
        self.ids += turn

    def end(self) -> None:
        if self.member is not None:
            self._insert(True)
            self.member = None

    def _insert(self, final: bool) -> None:
        self.trees.setdefault((self.digest, self.depth), Tree()).insert(bytes(self.ids), self.member, final)
        self.held += len(self.ids) + WIDTH

    def emptied(self) -> Iterator[tuple]:
        """What all trees emit.  A conversation that is still open goes on in a tree of its own."""
        for (digest, depth), tree in self.trees.items():
            yield from tree.emit(digest, depth, self.sizes)
        kept = {bytes(self.ids[at : at + WIDTH]) for at in range(0, len(self.ids), WIDTH)}
        self.trees, self.sizes, self.held = {}, {k: v for k, v in self.sizes.items() if k in kept}, 0


def shared_turns(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % 9


def _parts(segment: int, budget: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, base, conv, lead, lead_sizes, skip = Forest(segment), None, None, [], [], 0
        for batch in batches:
            rows = zip(batch.column("base").to_pylist(), batch.column("conv_id").to_pylist(), *[batch.column(c).cast(pa.binary()).to_pylist() for c in ("role", "text")], strict=True)
            for b, c, role, text in rows:
                if c != conv:
                    forest.end()
                    # runs of ids that end at a node must be in order; among negative ids the base comes out of turn
                    if forest.held > budget and (b != base or b >= 0):
                        yield from _batches(forest.emptied())
                    if b != base:
                        base, lead, lead_sizes = b, [], []
                    conv, skip = c, 0 if c == b else shared_turns(c)
                    forest.sizes.update(zip(lead, lead_sizes, strict=True))
                    forest.start(c, lead[:skip])
                if skip:
                    skip -= 1
                    continue
                turn = turn_id(role, text)
                forest.sizes[turn] = len(text)
                if c == b and len(lead) < 8:
                    lead.append(turn)
                    lead_sizes.append(len(text))
                forest.add(turn)
                if forest.held > budget and b >= 0:
                    yield from _batches(forest.emptied())
        forest.end()
        yield from _batches(forest.emptied())

    return run


def _batches(rows: Iterator[tuple], each: int = 8192) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = [c.split()[0] for c in PARTS.split(", ")]
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == each:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids; rows come by node, in order of ids."""
    node, digest = None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])

    for batch in batches:
        for name, data in zip(batch.column("node").to_pylist(), batch.column("data").to_pylist(), strict=True):
            text = ",".join(map(str, np.frombuffer(data, np.int64).tolist())).encode()
            if name != node:
                if node is not None:
                    yield told()
                node, digest = name, hashlib.sha256(text)
            else:
                digest.update(b"," + text)
    if node is not None:
        yield told()


def rebuilt(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """base, conv_id, turn, role, text of all turns, in ranges of bases, in order."""
    conv, empty = F.col(conv_col).cast("long"), F.lit("")
    rows = conversations.where(conv.isNotNull()).select((conv - conv % 5).alias("base"), conv.alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), empty).alias("role"), F.coalesce(F.col(text_col).cast("string"), empty).alias("text"))
    own_first: Column = F.col("conv_id") != F.col("base")
    return rows.repartitionByRange("base").sortWithinPartitions("base", own_first, "conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT, budget: int = BUDGET) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, node (its digest)."""
    turns = rebuilt(conversations, conv_col, turn_col, role_col, text_col).select("base", "conv_id", "role", "text")
    parts = written(turns.mapInArrow(releasing(_parts(segment, budget)), PARTS), "parts")
    nodes = written(parts.where(F.col("kind") == NODE).groupBy("node").agg(F.min("low").alias("owner"), F.sum("n").alias("n"), F.max("bytes").alias("bytes")), "nodes")
    top = nodes.where(F.col("node") == F.lit(ROOT)).select("owner", "n").first()
    paths = parts.where(F.col("kind") == PATH).select(F.col("low").alias("conv_id"), F.col("depth").alias("above"), "data")
    at = F.explode(F.sequence(F.lit(1), (F.length("data") / WIDTH).cast("int")))
    steps = paths.where(F.length("data") > 0).select("conv_id", "above", "data", at.alias("at"))
    steps = steps.select("conv_id", (F.col("above") + F.col("at")).alias("depth"), F.substring(F.col("data"), (F.col("at") - 1) * WIDTH + 1, F.lit(WIDTH)).alias("node")).join(nodes, "node")
    owner, n = (F.lit(x).cast("long") for x in (top["owner"], top["n"])) if top else (F.lit(None).cast("long"),) * 2
    roots = paths.where("above = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("node"), owner.alias("owner"), n.alias("n"), F.lit(0).cast("long").alias("bytes"))
    out = _summed(steps.select(*roots.columns).unionByName(roots))
    ended = parts.where(F.col("kind") == ENDS).select("node", "low", "data").repartition("node").sortWithinPartitions("node", "low")
    ended = written(ended.mapInArrow(_ends, "node binary, ends_sha256 string"), "ends")
    none = hashlib.sha256(b"").hexdigest()
    out = out.join(ended, "node", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), "node")
    out = written(out, "trie")
    discarded(parts, nodes, ended)
    return out


def _summed(steps: DataFrame) -> DataFrame:
    """Nodes with what their subtrees hold, from the paths of conversations with each node's owner."""
    whole = Window.partitionBy("conv_id")
    down, up = whole.orderBy("depth"), whole.orderBy(F.col("depth").desc())
    own = F.col("owner") == F.col("conv_id")
    saved = (F.col("n") - 1) * F.col("bytes")
    placed = steps.withColumns({"before": F.lag("owner").over(down), "after": F.lead("owner").over(down), "owns": F.bool_or(own).over(whole), "saved": F.sum(F.when(own, saved)).over(whole)})
    placed = written(placed.where("owns"), "placed")
    above = placed.where(~own & (F.col("after") != F.col("owner"))).select("conv_id", F.col("owner").alias("p"), F.col("depth").alias("a"), "saved", (F.col("after") == F.col("conv_id")).alias("direct"))
    chain = placed.where(own)
    at = (F.col("conv_id") == F.col("p")) & (F.col("depth") == F.col("a"))
    parents = above.where("direct").select("p", "a").distinct()
    leaf = chain.where("after is null").join(parents, at, "left").select(F.col("conv_id").alias("c"), F.col("p").isNull().cast("long").alias("leaf"))
    below = above.join(leaf, F.col("conv_id") == F.col("c")).groupBy("p", "a").agg(F.sum("saved").alias("more"), F.sum("leaf").alias("leaves"), F.count_if("direct").alias("kids"))
    met = chain.drop("saved").join(below, at, "left")
    zero = F.lit(0).cast("long")
    kids = F.coalesce("kids", zero)
    ends_here = (F.col("after").isNull() & (kids == 0)).cast("long")
    total = lambda x: F.sum(x).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = met.select(
        "node", "conv_id", "depth", F.col("before").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        (kids + F.col("after").isNotNull().cast("long")).alias("n_children"),
        total(ends_here + F.coalesce("leaves", zero)).alias("n_leaves"),
        total(saved + F.coalesce("more", zero)).alias("saved_tokens"),
    )
    out = written(out, "sums")
    discarded(placed)
    return out
