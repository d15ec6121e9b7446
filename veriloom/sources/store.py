"""An append-only evidence store of Parquet tables.

``events`` is a table of batches, each written once.  What is known of sessions, of
their chains' heads, of the Merkle tree over these, and their verdicts, are logs: an
ingest adds a small table with the rows it touched, the newest row of a key counts, and
logs of more than COMPACT tables are merged.  A manifest names the tables in force;
the next manifest is created only if no other writer has made it, so a batch is in
force as a whole or not at all, and what a failed ingest wrote is removed.

With each table of events or sessions the manifest holds a Bloom filter of its session
ids, and the range of lines, so looking for one session opens only tables that
may have it.  The interface has no update or delete of events.  Each manifest's head
follows from the one before it and the tree's root, and shows changes made behind it.
Older stores are read as they are and brought forward by the next ingest.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions.json_text import canonical_json
from veriloom.functions.redact import merged, redacted, redacted_short
from veriloom.operators import chain
from veriloom.operators.increments import beyond, coalesced, unseen
from veriloom.operators.line import verify_line
from veriloom.plans.reconcile import Evidence, extract_claims, observed_runs, reconcile
from veriloom.sources import transcripts as T

SCHEMA_VERSION = 3
EVENTS = "session_id string, seq long, ts string, kind string, payload string, stretch long, id long, prev_hash string, hash string"
SESSIONS = "session_id string, source_file string, source_size long, source_mtime string, cwd string, git_branch string, agent_version string, models array<string>, started_at string, ended_at string, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, opaque_executors array<string>, unparsed_lines long, ingested_at string"
EXEC = "toolUseId string, command string, description string, exitCode long, outcome string, backgrounded boolean, stdout string, stderr string"
KINDS = ("exec", "edit", "claim", "run")
#: Tables of a log before they are merged.
COMPACT = 8
#: Sessions that are looked up by name; beyond that all tables are read.
NAMED = 10_000
#: Bits of a filter at most, and for each session.
BITS, BITS_EACH = 1 << 19, 16
#: Events of a store of version 2 have one chain for all; their leaves stand at this stretch.
LEGACY = -1


def _second(manifest: dict) -> dict:
    """Version 1 lacks columns only, which read as null."""
    return {**manifest, "schema_version": 2}


def _third(manifest: dict) -> dict:
    """Version 2 has one chain over all events, a whole table of sessions, and no logs."""
    entry = lambda name: {"name": name, "filter": None}
    logs = {"sessions": [entry(manifest["sessions"])] if manifest["sessions"] else [], "heads": [], "tree": [], "reports": [], "findings": []}
    old = {"legacy": {"count": manifest["count"], "head": manifest["head"]}} if manifest["count"] else {}
    return {**manifest, "schema_version": 3, "events": [entry(n) for n in manifest["events"]], **logs, **old, "root": None, "depth": 0}


#: How a manifest of each older version becomes one of the next.
UPGRADES: dict[int, Callable[[dict], dict]] = {1: _second, 2: _third}


def upgraded(manifest: dict) -> dict:
    while manifest["schema_version"] < SCHEMA_VERSION:
        manifest = UPGRADES[manifest["schema_version"]](manifest)
    if manifest["schema_version"] > SCHEMA_VERSION:
        raise ValueError(f"the store is of version {manifest['schema_version']}, newer than this code")
    return manifest


class Filter:
    """A Bloom filter of session ids: four bits for each, from one 64-bit hash."""

    @staticmethod
    def made(ids: DataFrame) -> str:
        """The filter of a column ``session_id``, in base64; its size is bounded by BITS."""
        ids = ids.select("session_id").distinct()
        bits = 64
        while bits < min(BITS, BITS_EACH * ids.count()):
            bits *= 2
        h = F.xxhash64("session_id")
        low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
        at = F.explode(F.array(*[(low + high * k).bitwiseAND(F.lit(bits - 1)) for k in range(4)])).alias("at")
        each = ids.select(at).groupBy(F.shiftright("at", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(at & 7 as int))")).alias("mask"))
        out = bytearray(bits // 8)
        for r in each.collect():  # BITS / 8 rows at most
            out[r["byte"]] = r["mask"]
        return base64.b64encode(bytes(out)).decode()

    @staticmethod
    def may_hold(told: str | None, session: str) -> bool:
        if told is None:
            return True
        import xxhash

        bits = base64.b64decode(told)
        h = xxhash.xxh64_intdigest(session.encode("utf-8", "surrogatepass"), seed=42)
        at = [((h & 0xFFFFFFFF) + ((h >> 32) | 1) * k) & (len(bits) * 8 - 1) for k in range(4)]
        return all(bits[a >> 3] >> (a & 7) & 1 for a in at)


class Ingested(NamedTuple):
    head: str
    events: int
    fresh: int
    grown: int
    unchanged: int
    redactions: dict
    sessions: list


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        found = self._fs.globStatus(self._path(f"{self.path}/manifest-*.json"))
        return sorted(x.getPath().toString() for x in found or [])

    def exists(self) -> bool:
        return bool(self._manifests())

    def manifest(self) -> dict:
        names = self._manifests()
        if not names:
            return {"version": 0, "schema_version": SCHEMA_VERSION, "events": [], "sessions": [], "heads": [], "tree": [], "reports": [], "findings": [], "depth": 0, "root": None, "head": chain.GENESIS, "count": 0}
        return upgraded(json.loads(self.spark.read.text(names[-1], wholetext=True).first()[0]))

    def _commit(self, manifest: dict) -> None:
        out = self._fs.create(self._path(f"{self.path}/manifest-{manifest['version']:08d}.json"), False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    def _table(self, entries: list[dict], schema: str | None) -> DataFrame:
        # columns that an older batch lacks are null
        paths = [f"{self.path}/{x['name']}" for x in entries]
        read = self.spark.read if schema is None else self.spark.read.schema(schema)
        return read.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _log(self, entries: list[dict], schema: str | None, *keys: str) -> DataFrame:
        """The newest row of each key."""
        if len(entries) < 2:
            return self._table(entries, schema)
        every = None
        for k, entry in enumerate(entries):
            part = self._table([entry], schema).withColumn("_at", F.lit(k))
            every = part if every is None else every.unionByName(part)
        own = [c for c in every.columns if c != "_at"]
        return every.groupBy(*keys).agg(F.max_by(F.struct(*own), "_at").alias("r")).select("r.*")

    def _holding(self, entries: list[dict], ids: list[str] | None) -> list[dict]:
        """The tables that may have one of the sessions."""
        return entries if ids is None else [x for x in entries if any(Filter.may_hold(x["filter"], i) for i in ids)]

    def events(self, ids: list[str] | None = None, manifest: dict | None = None) -> DataFrame:
        """All events, or those of some sessions; only batches that may have these are opened."""
        rows = self._table(self._holding((manifest or self.manifest())["events"], ids), EVENTS)
        return rows if ids is None else rows.where(F.col("session_id").isin(ids))

    def sessions(self, manifest: dict | None = None) -> DataFrame:
        return self._log((manifest or self.manifest())["sessions"], SESSIONS, "session_id")

    def has(self, session: str) -> bool:
        """If the session is stored; opens only tables whose filter may have it."""
        found = self._holding(self.manifest()["sessions"], [session])
        return bool(found) and not self._table(found, SESSIONS).where(F.col("session_id") == session).isEmpty()

    def heads(self, manifest: dict | None = None) -> DataFrame:
        """The head, events and last line of each session's stretches."""
        manifest = manifest or self.manifest()
        kept = self._log(manifest["heads"], chain.HEADS, *chain.KEY)
        return kept if manifest["heads"] or not manifest.get("legacy") else self._legacy(manifest)

    def _legacy(self, manifest: dict) -> DataFrame:
        rows = self.events(manifest=manifest).where("stretch is null").groupBy("session_id")
        return rows.agg(F.lit(LEGACY).cast("long").alias("stretch"), F.count(F.lit(1)).alias("events"), F.lit(manifest["legacy"]["head"]).alias("head"), F.max("seq").alias("high"))

    def tree(self, manifest: dict | None = None) -> DataFrame:
        return self._log((manifest or self.manifest())["tree"], chain.TREE, "level", "place")

    def proof(self, session: str, stretch: int) -> list:
        """What shows, with ``chain.proven``, that a stretch of a session is under the root."""
        manifest = self.manifest()
        return chain.proof(self.spark, self.tree(manifest), manifest["depth"], session, stretch)

    def verify(self) -> dict:
        """Every chain, the tree over their heads, and the manifests' own chain."""
        told = self.manifest()
        rows = self.events(manifest=told)
        first = chain.breaks(rows.where("stretch is not null")).orderBy("session_id", "stretch", "id").first()
        if first is not None:
            return {"ok": False, "session": first["session_id"], "broken_at": first["seq"], "expected": first["expected"], "found": first["found"]}
        broken = lambda expected, found: {"ok": False, "session": None, "broken_at": None, "expected": expected, "found": found}
        if told.get("legacy"):
            state = verify_line(rows.where("stretch is null"), told["legacy"]["count"], told["legacy"]["head"])
            if not state["ok"]:
                return {"session": None, **state}
        if told["root"] is None:
            return {"ok": True, "events": told["count"], "head": told["head"]}
        found = chain.heads(rows.where("stretch is not null"))
        found = found.unionByName(self._legacy(told)) if told.get("legacy") else found
        top = chain.tree(found, told["depth"]).where("level = 0").first()
        root, events = (top["hash"], top["events"]) if top else (chain.GENESIS, 0)
        if (root, events) != (told["root"], told["count"]):
            return broken(told["root"], root)
        at = chain.GENESIS
        for name in self._manifests():
            kept = upgraded(json.loads(self.spark.read.text(name, wholetext=True).first()[0]))
            at = chain.chained(at, kept["root"]) if kept["root"] else kept["head"]
            if kept["head"] != at:
                return broken(at, kept["head"])
        return {"ok": True, "events": events, "head": at}

    def unseen(self, texts: DataFrame) -> DataFrame:
        """Scanned files (file, file_size, file_mtime) that are not stored as they are now."""
        old = self.sessions().select(F.col("source_file").alias("file"), F.col("source_size").alias("file_size"), F.col("source_mtime").alias("m"))
        return unseen(texts.withColumn("m", F.col("file_mtime").cast("string")), old, ["file", "file_size", "m"]).drop("m")

    def ingest(self, files: list[str], repo: str | None = None) -> Ingested:
        """Appends what is new in the transcripts; those of unchanged size and time are not read."""
        fresh = [r["file"] for r in self.unseen(T.stat(self.spark, files)).select("file").collect()]  # names of files that changed
        if not fresh:
            return Ingested(self.manifest()["head"], 0, 0, 0, len(files), {}, [])
        return self.add(T.scan(self.spark, fresh), repo, len(files))

    def add(self, scanned: T.Scanned, repo: str | None = None, files: int = 0) -> Ingested:
        """Appends what is new in scanned transcripts, which are read once."""
        stem, made = uuid.uuid4().hex, []

        def kept(df: DataFrame, name: str) -> DataFrame:
            made.append(f"{name}-{stem}")
            df.write.option("parquet.bloom.filter.enabled#session_id", "true").parquet(f"{self.path}/{made[-1]}")
            return self.spark.read.schema(df.schema).parquet(f"{self.path}/{made[-1]}")

        try:
            t = T.normalize(scanned, kept(T.records(scanned.lines), "lines"))
            return self._added(t, repo, files, stem, kept)
        except BaseException:
            for name in made:
                self._fs.delete(self._path(f"{self.path}/{name}"), True)
            raise
        finally:
            for name in ("lines", "staged", "own"):
                self._fs.delete(self._path(f"{self.path}/{name}-{stem}"), True)

    def _added(self, t: T.Transcripts, repo: str | None, files: int, stem: str, kept: Callable) -> Ingested:
        before = self.manifest()
        own = t.sessions if repo is None else t.sessions.where(F.col("cwd").isNull() | F.col("cwd").startswith(repo))
        own = kept(own, "own")
        made = kept(self._candidates(t, own), "staged")
        touched = own.select("session_id").distinct()
        old = self.heads(before).join(touched, "session_id", "left_semi")
        of_file = made.groupBy("session_id", "file").agg(F.max("seq").alias("own"))
        new = beyond(made, of_file, old.groupBy("session_id").agg(F.max("high").alias("stored")))
        rows = new.select("file", "kind_ord", "ord", "session_id", "seq", "ts", "kind", "payload")
        chained = chain.extend(rows, ["seq", "file", "kind_ord", "ord"], old)
        batch = kept(chained.select("session_id", "seq", "ts", "kind", "payload", "stretch", "id", "prev_hash", "hash"), "events/batch")
        known = self.sessions(before).join(touched, "session_id", "left_semi")
        per = batch.groupBy("session_id").agg(F.count(F.lit(1)).alias("events"))
        result = own.select("session_id", "file").join(per, "session_id", "left").join(known.select("session_id", F.lit(True).alias("known")), "session_id", "left")
        result = [(r["file"], r["session_id"], r["events"] or 0, bool(r["known"])) for r in result.orderBy("file").collect()]  # what the ingest reports
        ends = batch.agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high")).first()
        entry = lambda name, **more: {"name": f"{name}-{stem}", "filter": None, **more}
        after = {**before, "version": before["version"] + 1, "count": before["count"] + ends["n"]}
        after["events"] = [*before["events"], entry("events/batch", events=ends["n"], low=ends["low"], high=ends["high"]) | {"filter": Filter.made(batch)}]
        merge = lambda log, whole, *order: self._merged(after, log, whole, order, stem, kept)
        kept(self._upsert(own, known).orderBy("session_id"), "sessions")
        after["sessions"] = [*before["sessions"], entry("sessions") | {"filter": Filter.made(own)}]
        heads = kept(self._new_heads(before, batch), "heads")
        after["heads"] = [*before["heads"], entry("heads")]
        depth = max(before["depth"], chain.depth_of(self.heads(after).count()))
        same = depth == before["depth"] and bool(before["tree"])
        nodes = kept((chain.changed(self.tree(before), heads, depth) if same else chain.tree(self.heads(after), depth)).orderBy("level", "place"), "tree")
        after |= {"depth": depth, "tree": [*(before["tree"] if same else []), entry("tree")]}
        after["root"] = chain.root(nodes) if ends["n"] or before["root"] is None else before["root"]
        after["head"] = chain.chained(before["head"], after["root"])
        ids = [s for _, s, _, _ in result] if len(result) <= NAMED else None
        e = self._reconciled(self.sessions(after).join(touched, "session_id", "left_semi"), self.events(ids, after))
        for name, view in (("reports", e.reports), ("findings", e.findings)):
            kept(view.withColumn("version", F.lit(after["version"])), name)
            after[name] = [*before[name], entry(name)]
        merge("sessions", self.sessions, "session_id")
        merge("heads", self.heads, *chain.KEY)
        merge("tree", self.tree, "level", "place")
        merge("findings", self._findings, "session_id")
        merge("reports", self._reports, "session_id")
        counts = {r["kind"]: r["n"] for r in merged(made, "counts").collect()}  # a row per kind of secret
        self._commit(after)
        new_n, grown_n = sum(1 for r in result if r[2] and not r[3]), sum(1 for r in result if r[2] and r[3])
        return Ingested(after["head"], ends["n"], new_n, grown_n, max(0, files - new_n - grown_n), counts, result)

    def _merged(self, manifest: dict, log: str, whole: Callable[[dict], DataFrame], order: tuple, stem: str, kept: Callable) -> None:
        """Merges a log that has grown long."""
        if len(manifest[log]) > COMPACT:
            table = kept(whole(manifest).orderBy(*order), f"{log}-merged")
            manifest[log] = [{"name": f"{log}-merged-{stem}", "filter": Filter.made(table) if log == "sessions" else None}]

    def _new_heads(self, before: dict, batch: DataFrame) -> DataFrame:
        """Heads after the batch, of the stretches in it; of a store of one chain, those of its sessions as well."""
        new = batch.groupBy(*chain.KEY).agg(F.max("id").alias("events"), F.max_by("hash", "id").alias("head"), F.max("seq").alias("high"))
        return new.unionByName(self._legacy(before)) if before.get("legacy") and not before["heads"] else new

    def _reports(self, manifest: dict) -> DataFrame:
        return self._log(manifest["reports"], None, "session_id")

    def _findings(self, manifest: dict) -> DataFrame:
        """Findings of the ingest that made their session's report."""
        return self._table(manifest["findings"], None).join(self._reports(manifest).select("session_id", "version"), ["session_id", "version"], "left_semi")

    def maintained(self) -> tuple[DataFrame, DataFrame]:
        """Reports and findings as the ingests left them: each reconciled only the sessions that it touched."""
        manifest = self.manifest()
        if not manifest["reports"] or manifest.get("legacy"):  # sessions of an older store were not kept so
            e = self.read()
            return e.reports, e.findings
        return self._reports(manifest).drop("version"), self._findings(manifest).drop("version")

    def _candidates(self, t: T.Transcripts, own: DataFrame) -> DataFrame:
        """All events of the sessions: file, session_id, kind, kind_ord, ord, seq, ts, payload, counts."""
        keys = own.select("file", "session_id")
        keyed = lambda df: df.join(keys, "file")
        none = F.create_map().cast("map<string,bigint>")
        total = lambda *m: F.array(*[x["counts"] for x in m])
        json_ = lambda **c: canonical_json(F.to_json(F.struct(*[v.alias(k) for k, v in sorted(c.items())]), {"ignoreNullFields": "false"}))

        def event(df, kind, seq, ts, ord_, payload, counts):
            return df.select("file", "session_id", F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("kind_ord"), ord_.alias("ord"), F.col(seq).cast("long").alias("seq"), ts.alias("ts"), payload.alias("payload"), counts.alias("maps"))

        no_ts, no_counts = F.lit(None).cast("string"), F.array(none)
        place = lambda *c: F.struct(*[(F.col(x) if isinstance(x, str) else x).cast("long").alias(f"o{i}") for i, x in enumerate(c)])
        ran = keyed(t.execs).withColumns({"c": redacted("command"), "d": redacted("description"), "o": redacted_short("stdout"), "e": redacted_short("stderr")})
        col = F.col
        execs = event(ran, "exec", "seq", col("ts"), place("ord.use_seq", "ord.result_seq", "ord.block", F.lit(0)), json_(toolUseId=col("tool_use_id"), command=col("c.text"), description=col("d.text"), exitCode=col("exit_code"), outcome=col("outcome"), backgrounded=col("backgrounded"), stdout=col("o.text"), stderr=col("e.text"), stdoutTruncated=col("o.truncated"), stderrTruncated=col("e.truncated")), total(col("c"), col("o"), col("e")))
        edits = event(keyed(t.edits), "edit", "seq", no_ts, place("seq", "block", F.lit(0), F.lit(0)), json_(path=col("path"), kind=col("kind")), no_counts)
        told = extract_claims(keyed(t.utterances).withColumn("id", col("session_id")).withColumn("session_id", col("file"))).withColumnRenamed("session_id", "file")
        told = keyed(told).withColumn("s", redacted("sentence"))
        claims = event(told, "claim", "seq", col("ts"), place("claim_ord.seq", "claim_ord.block", "claim_ord.spos", "claim_ord.ppos"), json_(activity=col("activity"), assertion=col("assertion"), sentence=col("s.text")), total(col("s")))
        runs = observed_runs(t.execs.withColumn("session_id", col("file"))).withColumnRenamed("session_id", "file")
        runs = keyed(runs).withColumn("c", redacted("command"))
        seen = event(runs, "run", "seq", col("ts"), place("ord.use_seq", "ord.result_seq", "ord.block", "run_ord"), json_(activity=col("activity"), outcome=col("outcome"), basis=col("basis"), exitCode=col("exit_code"), command=col("c.text")), no_counts)
        every = execs.unionByName(edits).unionByName(claims).unionByName(seen)
        # counts of several fields as one map: kinds of secrets are few
        kinds = F.array_distinct(F.flatten(F.transform("maps", lambda m: F.map_keys(m))))
        summed = F.transform(kinds, lambda k: F.struct(k, F.aggregate(F.col("maps"), F.lit(0).cast("long"), lambda a, m: a + F.coalesce(m[k], F.lit(0)))))
        return every.withColumn("counts", F.map_from_entries(summed)).drop("maps")

    def _upsert(self, own: DataFrame, known: DataFrame) -> DataFrame:
        """The sessions' rows: first file, folder, start and ingest time stay; branch and version stay if there is no newer one."""
        new = own.groupBy("session_id").agg(F.min_by(F.struct(*[c for c in own.columns if c != "session_id"]), "file").alias("n")).select("session_id", "n.*")
        stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        new = new.withColumnsRenamed({"file": "source_file", "file_size": "source_size"}).withColumn("source_mtime", F.col("file_mtime").cast("string")).drop("file_mtime").withColumn("ingested_at", stamp)
        names = [c.split()[0] for c in SESSIONS.split(", ")]
        return coalesced(known, new.select(*names), "session_id", first=("source_file", "cwd", "started_at", "ingested_at"), fill=("git_branch", "agent_version"))

    def read(self, repo: str | None = None, branch: str | None = None, session: str | None = None, limit: int | None = None) -> Evidence:
        """Stored sessions reconciled anew: runs come from stored executions, claims as recorded."""
        manifest = self.manifest()
        own = self.sessions(manifest)
        if repo is not None:
            own = own.where(F.col("cwd") == repo)
        if branch is not None:
            own = own.where(F.col("git_branch") == branch)
        if session is not None:
            own = own.where(F.col("session_id").ilike(f"{session}%"))
        if limit is not None:
            own = own.orderBy("started_at", "session_id").limit(limit)
        narrow = (repo, branch, session, limit) != (None,) * 4
        ids = [r[0] for r in own.select("session_id").limit(NAMED + 1).collect()] if narrow else None
        return self._reconciled(own, self.events(ids if ids is not None and len(ids) <= NAMED else None, manifest))

    def _reconciled(self, own: DataFrame, events: DataFrame) -> Evidence:
        blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
        own = own.withColumns({c: blank(c) for c in ("cwd", "git_branch", "agent_version", "started_at", "ended_at")})
        rows = events.join(own.select("session_id"), "session_id", "left_semi")
        place = F.struct(F.col("seq").alias("seq"), F.col("id").alias("id"))
        text = lambda c: F.coalesce(c, F.lit("")).alias(c.rsplit(".", 1)[-1])
        execs = rows.where("kind = 'exec'").withColumn("p", F.from_json("payload", EXEC)).select("session_id", place.alias("ord"), "seq", F.col("p.toolUseId").alias("tool_use_id"), text("p.command"), F.col("p.description").alias("description"), "ts", text("p.stdout"), text("p.stderr"), F.col("p.exitCode").alias("exit_code"), F.when(F.col("p.outcome").isin("passed", "failed", "interrupted", "denied"), F.col("p.outcome")).otherwise("unknown").alias("outcome"), F.coalesce("p.backgrounded", F.lit(False)).alias("backgrounded"))
        edits = rows.where("kind = 'edit'").withColumn("p", F.from_json("payload", "path string, kind string")).select("session_id", "seq", text("p.path"), F.when(F.col("p.kind").isin("write", "notebook"), F.col("p.kind")).otherwise("edit").alias("kind"))
        claims = rows.where("kind = 'claim'").withColumn("p", F.from_json("payload", "activity string, assertion string, sentence string")).where(F.col("p.activity").isin("test", "build", "typecheck", "lint"))
        order = F.struct(F.col("seq").alias("seq"), F.lit(0).alias("block"), F.col("id").alias("spos"), F.lit(0).alias("ppos"))
        claims = claims.select("session_id", "seq", "ts", order.alias("claim_ord"), "p.activity", F.when(F.col("p.assertion") == "ran", "ran").otherwise("pass").alias("assertion"), text("p.sentence"))
        return reconcile(own, execs, edits, claims)
