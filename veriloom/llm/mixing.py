"""Mixing sources to target weights by pivotal dependent rounding.

A source's target gives each of its documents the same rate of copies.  The
whole part of the rate is certain; the fraction is a probability, and pivotal
rounding settles it: two documents meet, words move at random between their
probabilities (keeping the sum of expected words) until one of them is 0 or 1,
and the other goes on to the next meeting.  Documents are dealt by hash to
buckets of about FAN; each bucket folds to one open document, and the open ones
of FAN buckets meet at the next level, up to one document for a source, which is
drawn by its probability.  Four settled documents at most, of about the size of
what that leaves short or over, then change their draws; these are not random.
So a source's words miss its target by less than a document.  Rows of one id, source and size
are counted first and then numbered, and the number goes into the hash, so any number of
equal rows is spread over buckets like other documents.  All of it is built-in DataFrame
functions; no Python runs on rows.

Results in the odd cases: null text has size 0, takes no part in the rounding
and is taken 0 times; a null source is a source of its own, last in the order;
repeated rows, null ids included, are documents of their own; a source without
words has target 0; an empty table gives an empty result.  Other columns of the
input do not matter.  Draws are hashes of ids and ``seed``, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.llm.common import written

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: Documents that one bucket folds.
FAN = 64
#: Equal rows that one task numbers at a time.
CHUNK = 1 << 16
SCHEMA = "array<struct<k:int, doc_id:bigint, size:bigint, copies:int>>"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    words = F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(words, F.lit(0)).cast("long").alias("size"))


def counted(sizes: DataFrame) -> DataFrame:
    """``sizes`` with the number ``n`` of rows that are equal in all of it."""
    return sizes.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))


def numbered(groups: DataFrame) -> DataFrame:
    """``n`` rows of each group, with ``no`` from 0; a group of very many rows is numbered by many tasks."""
    few = groups.where(F.col("n") <= CHUNK).withColumn("low", F.lit(0).cast("long"))
    starts = groups.where(F.col("n") > CHUNK).withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    rows = few.unionByName(starts.repartition("source", "doc_id", "size", "low"))
    last = F.least(F.col("low") + CHUNK, F.col("n")) - 1
    return rows.withColumn("no", F.explode(F.sequence(F.col("low"), last))).drop("n", "low")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per source: source, source_size, target, rate, sized.  ``sizes`` are ``counted``.

    The level L with sum(min(most * size, weight * L)) = sum(size) shares the whole
    by weight and passes on what a capped source can't take.  Sources fill in order
    of most * size / weight, so running sums give the level.  The windows hold one
    row per source, not per document.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("double").alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("sized"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # the first source in that order whose cap is not below the level, given that all before it are capped
    levelled = capped.withColumn("level", level)
    fits = F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.col("level"))
    shared = levelled.withColumn("shared", F.max(fits).over(everything))
    target = F.least("cap", F.coalesce(F.col("weight") * F.col("shared"), F.col("cap")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    return shared.withColumn("target", target).select("source", F.col("source_size").cast("long").alias("source_size"), "target", rate.alias("rate"), "sized")


def bounded(per_source: DataFrame, rows: int = 10_000) -> DataFrame:
    """Broadcast if it has few rows; beyond that Spark joins by shuffle and splits skew."""
    return F.broadcast(per_source) if per_source.limit(rows + 1).count() <= rows else per_source


def draw(seed: int, *of: Column) -> Column:
    """A number in [0, 1) that depends on ``of`` alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _meet(seed: int):
    """One meeting: the open document of the fold so far with the next one."""

    def step(acc: Column, x: Column) -> Column:
        a, ta, tb = acc["open"], acc["open"]["p"] * acc["open"]["size"], x["p"] * x["size"]
        # words that can move from one to the other before a probability reaches 0 or 1
        to_a = F.least((F.lit(1.0) - a["p"]) * a["size"], tb)
        to_b = F.least((F.lit(1.0) - x["p"]) * x["size"], ta)
        up = draw(seed, F.col("bucket"), a["doc_id"], x["doc_id"], a["k"], x["k"], F.size(acc["done"])) * (to_a + to_b) < to_b
        pa = F.when(up, a["p"] + to_a / a["size"]).otherwise(a["p"] - to_b / a["size"])
        pb = F.when(up, x["p"] - to_a / x["size"]).otherwise(x["p"] + to_b / x["size"])
        eps = 1e-9
        whole = lambda p: (p < eps) | (p > 1 - eps)
        put = lambda d, p: F.struct(d["doc_id"].alias("doc_id"), d["size"].alias("size"), p.alias("p"), d["k"].alias("k"))
        out = lambda d, p: F.array(F.struct(d["k"].alias("k"), d["doc_id"].alias("doc_id"), d["size"].alias("size"), F.when(p > 0.5, 1).otherwise(0).alias("copies")))
        first = F.isnull(a["size"])
        both = whole(pa) & whole(pb)
        nothing = F.lit(None).cast("struct<doc_id:bigint, size:bigint, p:double, k:int>")
        done = F.when(first, acc["done"]).when(both, F.concat(acc["done"], out(a, pa), out(x, pb))).when(whole(pa), F.concat(acc["done"], out(a, pa))).otherwise(F.concat(acc["done"], out(x, pb)))
        left = F.when(first, x).when(both, nothing).when(whole(pa), put(x, pb)).otherwise(put(a, pa))
        return F.struct(left.alias("open"), done.alias("done"))

    return step


def _fold(rows: DataFrame, seed: int) -> DataFrame:
    """Per (source, bucket) the settled documents and the one still open."""
    start = F.expr(f"named_struct('open', cast(null as struct<doc_id:bigint, size:bigint, p:double, k:int>), 'done', cast(array() as {SCHEMA}))")
    grouped = rows.groupBy("source", "bucket").agg(F.array_sort(F.collect_list(F.struct("size", "doc_id", "p", "k"))).alias("docs"))
    docs = F.transform("docs", lambda d: F.struct(d["doc_id"].alias("doc_id"), d["size"].alias("size"), d["p"].alias("p"), d["k"].alias("k")))
    return grouped.select("source", "bucket", F.aggregate(docs, start, _meet(seed)).alias("at"))


def _exchanged(done: DataFrame, short: DataFrame, rounds: int = 4) -> DataFrame:
    """Makes up for what the last document of a source leaves short or over.

    In each round one settled document whose size is nearest to that number of
    words changes its draw, if that brings the source nearer to its target.
    """
    done = done.withColumn("copies", F.col("copies").cast("int"))
    short, picks = short.withColumnRenamed("source", "s"), None
    for _ in range(rounds):
        free = done.join(bounded(short), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        if picks is not None:
            free = free.join(bounded(picks), _same("picked"), "left_anti")
        right = F.when(F.col("short") > 0, F.col("copies") == 0).otherwise(F.col("copies") == 1)
        off = F.abs(F.abs("short") - F.col("size"))
        at = F.min(F.struct(off.alias("off"), "bucket", "pos", "size", "copies")).alias("at")
        best = free.where(right & (off < F.abs("short"))).groupBy("source").agg(at).select("source", "at.*")
        best = written(best.select(F.struct("source", "bucket", "pos").alias("picked"), F.when(F.col("copies") == 0, F.col("size")).otherwise(-F.col("size")).alias("added")), "picks")
        picks = best if picks is None else picks.unionByName(best)
        short = short.join(bounded(best), F.col("s").eqNullSafe(F.col("picked.source")), "left").select("s", (F.col("short") - F.coalesce("added", F.lit(0))).alias("short"))
    copies = F.when(F.col("picked").isNotNull(), 1 - F.col("copies")).otherwise(F.col("copies"))
    return done.join(bounded(picks), _same("picked"), "left").select("source", "doc_id", "size", (F.col("k") + copies).alias("copies"))


def _same(other: str) -> Column:
    return F.col("source").eqNullSafe(F.col(f"{other}.source")) & (F.col("bucket") == F.col(f"{other}.bucket")) & (F.col("pos") == F.col(f"{other}.pos"))


def dealt(rows: DataFrame, seed: int) -> DataFrame:
    """Documents whose draw is open, with the bucket of each."""
    buckets = F.greatest(F.lit(1), F.ceil(F.col("sized") / FAN)).cast("long")
    return rows.select("source", "doc_id", "size", "p", "k", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "no"), buckets).alias("bucket"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    sizes = written(counted(sized(docs, id_col, text_col, source_col)), "sizes")
    goal = written(targets(sizes, weights, most), "targets")
    known = sizes.alias("d").join(bounded(goal), F.col("d.source").eqNullSafe(goal["source"])).select("d.*", "source_size", "target", "rate", "sized")
    base = F.floor(F.col("rate") + 1e-12)
    part = F.greatest(F.lit(0.0), F.col("rate") - base)
    known = known.withColumn("k", base.cast("int")).withColumn("p", part)
    sure = (F.col("size") == 0) | (F.col("p") < 1e-9)
    known = numbered(known)
    settled = known.where(sure).select("source", "doc_id", "size", F.when(F.col("size") > 0, F.col("k")).otherwise(0).alias("copies"))
    open_ = dealt(known.where(~sure), seed)
    levels, most_docs = 1, goal.agg(F.max("sized")).first()[0] or 0
    while FAN**levels < most_docs:
        levels += 1
    first = None
    for level in range(levels):
        folded = written(_fold(open_, seed + level), "fold")
        done = folded.select("source", "bucket", F.posexplode("at.done").alias("pos", "d")).select("source", "bucket", "pos", "d.*")
        if first is None:
            first = done
        else:
            settled = settled.unionByName(done.select("source", "doc_id", "size", (F.col("k") + F.col("copies")).alias("copies")))
        left = folded.where("at.open is not null").select("source", "at.open.*", "bucket")
        open_ = left.withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long"))
    last = left.withColumn("copies", (draw(seed + levels, F.col("doc_id"), F.col("size")) < F.col("p")).cast("int")).withColumn("short", (F.col("p") - F.col("copies")) * F.col("size"))
    settled = settled.unionByName(last.select("source", "doc_id", "size", (F.col("k") + F.col("copies")).alias("copies")))
    settled = settled.unionByName(_exchanged(first, last.select("source", "short")))
    return (
        settled.alias("d")
        .join(bounded(goal), F.col("d.source").eqNullSafe(goal["source"]))
        .select("d.doc_id", "d.source", "d.size", "source_size", "target", F.col("d.copies").cast("int").alias("copies"), (F.col("d.copies") * F.col("d.size")).cast("long").alias("taken"))
    )
