"""Hash chains of sessions under a Merkle tree.

A session's events are cut into stretches of SPAN lines, and each stretch has a chain of
its own: a link's hash is SHA-256 of the hash before it, a line end and the payload, and
the first one follows the stretch's seed, a hash of its names.  So chains are built and
checked in parallel, a session of any length too, and a batch goes on from the heads of
the stretches that it touches.

The heads are leaves of a tree.  A leaf stands at the digest of its names; a node of
level k has the leaves whose digests start with the same 2 k hexadecimal digits, and its
hash is taken over its children's places and hashes.  The root tells if any payload, head
or number of events has changed, or if a stretch is missing.  A proof that one stretch is
in the tree holds the children of the nodes above it, some 256 a level at most.

One chain over all events, whatever their sessions, is there as well (``ranged``, ``spine``,
``spine_breaks``).  Each of its links needs the one before, so it takes time in the number
of events, but not the memory of a task: events are sorted into ranges in parallel, then
a short job for each range in turn finds the hash at its end, of which the driver holds one
a range, and with these all ranges are linked, and checked, in parallel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.sources.scratch import scratch

GENESIS = "0" * 64
#: Lines of a session that one chain may have.
SPAN = 4096
#: Digits of a place that a level adds, and the leaves that a lowest node has on average at most.
DIGITS, FULL = 2, 256
#: Events that a step of one chain over all events links, and rows of a range in which links are compared.
STEP, RANGE = 1 << 19, 1 << 16
KEY = ["session_id", "stretch"]
HEADS = "session_id string, stretch long, events long, head string, high long"
TREE = "level int, place string, hash string, leaves long, events long"


def stretch(seq: Column | str) -> Column:
    return F.floor((F.col(seq) if isinstance(seq, str) else seq) / SPAN).cast("long")


def seed() -> Column:
    """What the first link of a stretch follows; also its place in the tree."""
    return F.sha2(F.concat(F.coalesce("session_id", F.lit("")), F.lit("\n"), F.col("stretch").cast("string")), 256)


def link(prev: Column, payload: Column) -> Column:
    return F.sha2(F.concat(prev, F.lit("\n"), payload), 256)


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links sorted rows; each stretch starts from the head and number that its rows carry."""
    key, prev, number = None, GENESIS, 0
    for batch in batches:
        ids, before, after = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("session_id", "stretch", "payload", "_head", "_events")]
        for session, part, text, head, events in zip(*columns, strict=True):
            if (session, part) != key:
                key, prev, number = (session, part), head, events
            number += 1
            ids.append(number)
            before.append(prev)
            prev = hashlib.sha256(f"{prev}\n{text or ''}".encode("utf-8", "surrogatepass")).hexdigest()
            after.append(prev)
        own = [c for c in batch.schema.names if c not in ("_head", "_events")]
        yield pa.RecordBatch.from_arrays([*map(batch.column, own), pa.array(ids, pa.int64()), pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*own, "id", "prev_hash", "hash"])


def extend(events: DataFrame, order: list, heads: DataFrame | None = None) -> DataFrame:
    """``events`` (session_id, seq, payload, ...) with stretch, id, prev_hash and hash.

    ``order`` orders the events of a session; ``id`` counts those of a stretch, from 1 or
    from what ``heads`` (of HEADS) says of stretches that have events already.
    """
    keyed = events.withColumn("stretch", stretch("seq"))
    if heads is None:
        known = keyed.withColumns({"_head": F.lit(None).cast("string"), "_events": F.lit(0).cast("long")})
    else:
        old = heads.select(*[F.col(c).alias(f"_{c}") for c in (*KEY, "head", "events")])
        met = keyed.join(old, F.col("session_id").eqNullSafe(F.col("_session_id")) & (F.col("stretch") == F.col("_stretch")), "left")
        known = met.withColumn("_events", F.coalesce("_events", F.lit(0).cast("long"))).drop("_session_id", "_stretch")
    out = T.StructType([*keyed.schema.fields, T.StructField("id", T.LongType()), T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType())])
    dealt = known.repartition(*KEY).sortWithinPartitions(*KEY, *order)
    return dealt.withColumn("_head", F.coalesce("_head", seed())).mapInArrow(_fold, out)


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last link of each stretch that has rows besides its head; sorted rows, a stretch's head first."""
    key, prev, number, high, grown, out = None, GENESIS, 0, None, False, []

    def rows() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["session_id", "stretch", "events", "head", "high"])
        out.clear()
        return made

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("session_id", "stretch", "_late", "payload", "_high", "_head", "_events")]
        for session, part, late, text, at, head, events in zip(*columns, strict=True):
            if (session, part) != key:
                if grown:
                    out.append((*key, number, prev, high))
                key, number, high, grown = (session, part), 0, None, False
                prev = hashlib.sha256(f"{session or ''}\n{part}".encode("utf-8", "surrogatepass")).hexdigest()
            high = at if high is None else high if at is None else max(high, at)
            if late:
                prev, number, grown = hashlib.sha256(f"{prev}\n{text or ''}".encode("utf-8", "surrogatepass")).hexdigest(), number + 1, True
            else:
                prev, number = head.hex(), events
        yield rows()
    if grown:
        out.append((*key, number, prev, high))
    yield rows()


def ends(events: DataFrame, order: list[str], heads: DataFrame | None = None) -> DataFrame:
    """Heads, as ``heads`` gives them after ``extend``, of the stretches that ``events`` are of.

    The links are not made into rows, and a head that a stretch goes on from is one row of
    it, so the events are shuffled once and without hashes.
    """
    own = [c for c in order if c not in (*KEY, "payload")]
    rows = events.withColumn("stretch", stretch("seq")).select(*KEY, *own, "payload", F.col("seq").cast("long").alias("_high"), F.lit(True).alias("_late"), F.lit(None).cast("binary").alias("_head"), F.lit(0).cast("long").alias("_events"))
    if heads is not None:
        before = heads.select(*KEY, "high", F.lit(False).alias("_late"), F.unhex("head").alias("_head"), F.col("events").cast("long").alias("_events")).withColumnRenamed("high", "_high")
        rows = rows.unionByName(before, allowMissingColumns=True)
    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "_late", *order).mapInArrow(_ends, HEADS)


def heads(chain: DataFrame) -> DataFrame:
    """The head of each stretch, the number of its events and its last line."""
    return chain.groupBy(*KEY).agg(F.count(F.lit(1)).alias("events"), F.max_by("hash", "id").alias("head"), F.max("seq").cast("long").alias("high"))


def breaks(chain: DataFrame) -> DataFrame:
    """session_id, stretch, id, expected, found of every row that does not follow from the one before it."""
    within = Window.partitionBy(*KEY).orderBy("id")  # SPAN lines at most
    rows = chain.withColumn("before", F.coalesce(F.lag("hash").over(within), seed()))
    made = link(F.col("prev_hash"), F.coalesce("payload", F.lit("")))
    wrong = F.when(F.col("prev_hash") != F.col("before"), F.struct(F.col("before").alias("expected"), F.col("prev_hash").alias("found"))).when(made != F.col("hash"), F.struct(made.alias("expected"), F.col("hash").alias("found")))
    return rows.select(*KEY, "id", "seq", wrong.alias("w")).where("w is not null").select(*KEY, "id", "seq", "w.expected", "w.found")


def ranged(events: DataFrame, order: list[str], step: int = STEP) -> DataFrame:
    """``events`` as a table in ranges of a total order, of some ``step`` rows each, numbered by ``part``."""
    n = max(1, -(-events.count() // step))
    at = scratch(events.sparkSession, "ranges")
    events.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(at)
    return events.sparkSession.read.schema(T.StructType([*events.schema.fields, T.StructField("part", T.IntegerType())])).parquet(at)


def _passed(number: int, prev: str) -> Callable:
    """Folds sorted rows into the number and hash of the last."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, at = number, prev
        for batch in batches:
            for text in batch.column("payload").to_pylist():
                at = hashlib.sha256(f"{at}\n{text or ''}".encode("utf-8", "surrogatepass")).hexdigest()
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([at], pa.string())], names=["n", "at"])

    return run


def entries(ranges: DataFrame, order: list[str]) -> list[tuple[int, int, str]]:
    """(part, events before it, hash it follows) for each range, and a last one of part -1 for the end of the chain."""
    parts = sorted(r["part"] for r in ranges.select("part").distinct().collect())  # one row per STEP events
    out, number, prev = [], 0, GENESIS
    for part in parts:
        out.append((part, number, prev))
        own = ranges.where(F.col("part") == part).select(*order, "payload").coalesce(1).sortWithinPartitions(*order)
        number, prev = own.mapInArrow(_passed(number, prev), "n long, at string").first()
    return [*out, (-1, number, prev)]


def spine(ranges: DataFrame, order: list[str]) -> DataFrame:
    """The rows of ``ranges`` with id (from 1), prev_hash and hash in one chain over all."""
    found = {part: (number, prev) for part, number, prev in entries(ranges, order)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, prev, number = None, GENESIS, 0
        for batch in batches:
            ids, before, after = [], [], []
            for part, text in zip(batch.column("part").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if part != key:
                    key, (number, prev) = part, found[part]
                number += 1
                ids.append(number)
                before.append(prev)
                prev = hashlib.sha256(f"{prev}\n{text or ''}".encode("utf-8", "surrogatepass")).hexdigest()
                after.append(prev)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64()), pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*batch.schema.names, "id", "prev_hash", "hash"])

    out = T.StructType([*ranges.schema.fields, T.StructField("id", T.LongType()), T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType())])
    # every part has a partition of its own or shares one with few others
    return ranges.repartition(max(1, len(found) - 1), "part").sortWithinPartitions("part", *order).mapInArrow(run, out)


def spine_breaks(links: DataFrame) -> DataFrame:
    """id, expected, found of every row of one chain that does not follow from the one before it; ``links`` are read twice."""
    made = link(F.col("prev_hash"), F.coalesce("payload", F.lit("")))
    rows = links.select("id", "prev_hash", "hash", F.when(made != F.col("hash"), made).alias("made"), F.floor(F.col("id") / RANGE).alias("range"))
    last = rows.groupBy("range").agg(F.max(F.struct("id", "hash"))["hash"].alias("last"))
    # one row per RANGE events
    starts = last.select("range", F.coalesce(F.lag("last").over(Window.orderBy("range")), F.lit(GENESIS)).alias("entry"))
    within = Window.partitionBy("range").orderBy("id")  # RANGE rows at most
    met = rows.withColumn("before", F.lag("hash").over(within)).join(F.broadcast(starts), "range")
    before = F.coalesce("before", "entry")
    wrong = F.when(F.col("prev_hash") != before, F.struct(before.alias("expected"), F.col("prev_hash").alias("found"))).when(F.col("made").isNotNull(), F.struct(F.col("made").alias("expected"), F.col("hash").alias("found")))
    return met.select("id", wrong.alias("w")).where("w is not null").select("id", "w.expected", "w.found")


def leaves(heads_: DataFrame, depth: int) -> DataFrame:
    """Rows of TREE for heads."""
    said = F.concat_ws("\n", F.lit("leaf"), seed(), F.col("events").cast("string"), F.col("head"))
    return heads_.select(F.lit(depth + 1).alias("level"), seed().alias("place"), F.sha2(said, 256).alias("hash"), F.lit(1).cast("long").alias("leaves"), F.col("events").cast("long").alias("events"))


def _kid(*more: Column) -> Column:
    """A child among those of a node; in bytes, which sort as their digits do."""
    return F.struct(F.unhex("place").alias("place"), *more, F.unhex("hash").alias("hash"))


def _told(kids: Column) -> Column:
    """The hash of a node with these children, in order."""
    digits = lambda c: F.lower(F.hex(c))
    return F.sha2(F.array_join(F.transform(kids, lambda k: F.concat_ws(" ", digits(k["place"]), digits(k["hash"]))), "\n"), 256)


def above(children: DataFrame, level: int) -> DataFrame:
    """The nodes of a level, from all children of each.  A node has 256 children, or FULL leaves or so."""
    kids = F.array_sort(F.collect_list(_kid()))
    grouped = children.groupBy(F.substring("place", 1, DIGITS * level).alias("place")).agg(kids.alias("kids"), F.sum("leaves").alias("leaves"), F.sum("events").alias("events"))
    return grouped.select(F.lit(level).alias("level"), "place", _told(F.col("kids")).alias("hash"), "leaves", "events")


def depth_of(leaves_: int) -> int:
    """Levels below the root that inner nodes take."""
    depth = 0
    while leaves_ > FULL << (4 * DIGITS * depth):
        depth += 1
    return depth


def tree(heads_: DataFrame, depth: int) -> DataFrame:
    """All nodes of the tree, leaves included."""
    level = leaves(heads_, depth)
    out = level
    for k in range(depth, -1, -1):
        level = above(level, k)
        out = out.unionByName(level)
    return out


#: A level of at most so many digits has few enough nodes to be broadcast.
NARROW = 4


def changed(old: DataFrame, fresh: DataFrame, depth: int, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """The nodes of a tree that new leaves make: these, and what stands above them.

    ``old`` is the tree so far; of it only the children of nodes above new leaves are needed.
    ``keep`` makes a table of a level, which is read several times.
    """
    level = leaves(fresh, depth)
    out = level
    for k in range(depth, -1, -1):
        place = F.substring("place", 1, DIGITS * k)
        touched = level.select(place.alias("touched")).distinct()
        stale = old.where(F.col("level") == k + 1).join(F.broadcast(touched) if DIGITS * k <= NARROW else touched, place == F.col("touched"), "left_semi")
        both = stale.select(*level.columns, F.lit(True).alias("stale")).unionByName(level.withColumn("stale", F.lit(False)))
        kids = both.groupBy(place.alias("place")).agg(F.array_sort(F.collect_list(_kid(F.col("stale").alias("stale"), F.col("leaves").alias("leaves"), F.col("events").alias("events")))).alias("kids"))
        # of a child's two rows the fresh one is first
        kids = kids.withColumn("kids", F.filter("kids", lambda x, i: (i == 0) | (F.get("kids", i - 1)["place"] != x["place"])))
        total = lambda name: F.aggregate("kids", F.lit(0).cast("long"), lambda n, x: n + x[name])  # noqa: B023, E731
        level = keep(kids.select(F.lit(k).alias("level"), "place", _told(F.col("kids")).alias("hash"), total("leaves").alias("leaves"), total("events").alias("events")), f"level{k}")
        out = out.unionByName(level)
    return out


def root(tree_: DataFrame) -> str:
    top = tree_.where("level = 0").first()
    return top["hash"] if top else GENESIS


def chained(before: str, root_: str) -> str:
    """The head of a history of roots."""
    return hashlib.sha256(f"{before}\n{root_}".encode()).hexdigest()


def proof(spark: SparkSession, tree_: DataFrame, depth: int, session: str, part: int) -> list[list[tuple[str, str]]]:
    """From the leaf up, the children (place, hash) of each node above one stretch.

    Filters on level and place reach the scan, so other sessions' rows are passed over.
    """
    place = hashlib.sha256(f"{session}\n{part}".encode()).hexdigest()
    steps = []
    for k in range(depth, -1, -1):
        own = tree_.where((F.col("level") == k + 1) & F.col("place").startswith(place[: DIGITS * k]))
        steps.append(sorted(tuple(r) for r in own.select("place", "hash").collect()))  # FULL rows or so
    return steps


def proven(steps: list[list[tuple[str, str]]], session: str, part: int, events: int, head: str, root_: str) -> bool:
    """If a proof shows that the stretch has this head under this root."""
    place = hashlib.sha256(f"{session}\n{part}".encode()).hexdigest()
    own = hashlib.sha256(f"leaf\n{place}\n{events}\n{head}".encode()).hexdigest()
    for k, step in zip(range(len(steps) - 1, -1, -1), steps, strict=True):
        if (place, own) not in step:
            return False
        place, own = place[: DIGITS * k], hashlib.sha256("\n".join(f"{p} {h}" for p, h in step).encode()).hexdigest()
    return own == root_


def verify(chain: DataFrame, root_: str | None = None, depth: int = 0) -> dict:
    """ok, events and root; or the first break (session_id, broken_at, expected, found).

    With the root that a tree of this depth had, missing ends and whole stretches are found too.
    """
    first = breaks(chain).orderBy("session_id", "stretch", "id").first()
    if first is not None:
        return {"ok": False, "session": first["session_id"], "broken_at": first["seq"], "expected": first["expected"], "found": first["found"]}
    top = tree(heads(chain), depth).where("level = 0").first()
    found, events = (top["hash"], top["events"]) if top else (GENESIS, 0)
    if root_ not in (None, found):
        return {"ok": False, "session": None, "broken_at": None, "expected": root_, "found": found}
    return {"ok": True, "events": events, "root": found}
