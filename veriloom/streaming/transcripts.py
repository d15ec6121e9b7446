"""Verdicts over transcripts as they grow, from raw lines.

Two stateful steps with built-in expressions around them.  The first, by file, numbers the
lines and pairs each tool result with the last use of its id.  Commands, outputs and prose
are then read by the expressions that batches use.  The second, by file, keeps the last run of
each activity, what was denied or hidden, and each claim with the run that it rests on; a
claim is emitted when its verdict or reason is new or has changed, for both can change
with what comes later.  So the last row of each claim is the row that a batch over the
same lines gives, wherever the lines were cut into batches.

State goes ``idle_ms`` after it was last written: a result that comes later than that
after its use finds none, and a claim no longer changes.  A file that has become shorter
starts anew.  Both steps hold a file's rows of one batch in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veriloom.functions import patterns as P
from veriloom.functions.json_text import parsed, typed
from veriloom.functions.prose import with_claims
from veriloom.functions.regex import matches, trimmed
from veriloom.plans.reconcile import run_found, with_activities
from veriloom.sources.lines import Lines
from veriloom.sources.transcripts import classified

#: What the session needs: the state of these steps is kept in RocksDB.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
PAIRED = "file string, kind string, seq long, result_seq long, block int, tool string, command string, stdout string, stderr string, exit_code long, outcome string, text string"
OUT = "file string, seq long, activity string, assertion string, sentence string, verdict string, reason string, claim string"


def blocks(lines: DataFrame) -> DataFrame:
    """One row for each block of a line's content, and one for a line without any: file, start, n, block, kind, ..."""
    v, checked, strict = parsed(F.col("line"))
    rows = lines.where("error is null").select("file", "start", "n", trimmed(F.col("line")).alias("line"))
    rows = rows.withColumn("_v", v).withColumn("_checked", checked).select("file", "start", "n", strict.alias("v"))
    content = F.try_variant_get("v", "$.message.content", "array<variant>")
    each = rows.select("file", "start", "n", "v", F.posexplode_outer(content).alias("block", "b"))
    b, v = F.col("b"), F.col("v")
    text, name, kind = typed(b, "$.text", "STRING"), F.coalesce(typed(b, "$.name", "STRING"), F.lit("")), typed(b, "$.type", "STRING")
    said = (kind == "text") & (typed(v, "$.type", "STRING") == "assistant") & (trimmed(text) != "")
    result = F.when(kind == "tool_result", classified(v, b))
    each = each.withColumn("r", result)
    return each.select(
        "file", "start", "n", "block",
        F.when(said, "said").when(kind == "tool_use", "use").when(kind == "tool_result", "result").alias("kind"),
        F.coalesce(typed(b, "$.id", "STRING"), typed(b, "$.tool_use_id", "STRING")).alias("tool_use_id"),
        name.alias("tool"), matches(name, (P.OPAQUE, "i")).alias("hides"), typed(b, "$.input.command", "STRING").alias("command"),
        "r.stdout", "r.stderr", "r.exit_code", "r.outcome", F.when(said, text).alias("text"),
    )


def _none(x) -> bool:
    return x is None or x != x


class Pairing(StatefulProcessor):
    """Numbers a file's lines and pairs its results with uses; rows of PAIRED."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getValueState("lines", "lines long")
        self.uses = handle.getMapState("uses", "id string", "seq long, tool string, command string", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = sorted((r for pdf in rows for r in pdf.itertuples(index=False)), key=lambda r: (r.start, r.n, -1 if _none(r.block) else r.block))
        base = self.lines.get()[0] if self.lines.exists() else 0
        if held and held[0].start == 0 and base:
            base = 0
            self.uses.clear()
        out, start, last = [], None, 0
        for r in held:
            if start is not None and r.start != start:
                base, last = base + last, 0
            start, last = r.start, int(r.n)
            seq, block = base + last, None if _none(r.block) else int(r.block)
            row = lambda kind, at, tool=None, command=None: (key[0], kind, at, seq, block, tool, command, r.stdout, r.stderr, None if _none(r.exit_code) else int(r.exit_code), r.outcome, r.text)  # noqa: B023, E731
            if r.kind == "said":
                out.append(row("said", seq))
            elif r.kind == "use":
                if r.hides:
                    out.append(row("hidden", seq, r.tool))
                if not _none(r.tool_use_id):
                    self.uses.updateValue((r.tool_use_id,), (seq, r.tool, None if _none(r.command) else r.command))
            elif r.kind == "result" and not _none(r.tool_use_id) and self.uses.containsKey((r.tool_use_id,)):
                at, tool, command = self.uses.getValue((r.tool_use_id,))
                if tool == "Bash" and command:
                    out.append(row("exec", at, tool, command))
        self.lines.update((base + last,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PAIRED.split(", ")]).astype({"exit_code": "Int64", "block": "Int32"})

    def close(self) -> None:
        pass


def _steps(paired: DataFrame) -> DataFrame:
    """Each execution, hidden tool, run and claim as a row, with its place in the file."""
    rows = with_claims(with_activities(paired), "text")
    runs = F.transform("acts", lambda a, i: F.struct(F.lit("run").alias("step"), i.alias("x"), F.lit(0).alias("y"), a.alias("activity"), F.lit("").alias("assertion"), F.lit("").alias("sentence")))
    claims = F.transform(F.coalesce("claims", F.array().cast("array<struct<spos:int,ppos:int,activity:string,assertion:string,sentence:string>>")), lambda c: F.struct(F.lit("claim").alias("step"), c["spos"].alias("x"), c["ppos"].alias("y"), c["activity"].alias("activity"), c["assertion"].alias("assertion"), c["sentence"].alias("sentence")))
    own = F.array(F.struct(F.col("kind").alias("step"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit("").alias("activity"), F.lit("").alias("assertion"), F.lit("").alias("sentence")))
    each = rows.withColumn("s", F.explode(F.concat(own, runs, claims))).select("*", "s.*").where("step <> 'said'")
    found = F.when(F.col("step") == "run", run_found())
    return each.withColumn("found", found).select("file", "step", "seq", "result_seq", "block", "x", "y", "activity", "assertion", "sentence", "tool", "exit_code", F.col("outcome").alias("ended"), "found.outcome", "found.basis")


def judged(claim: dict, run: tuple | None, later: bool, execs: int, denied: bool, tools: str) -> tuple[str, str]:
    """Verdict and reason of a claim that rests on ``run`` (outcome, basis, exit code), or on none."""
    label, ran = P.LABELS[claim["activity"]], claim["assertion"] == "ran"
    if run is None:
        if later:
            return "UNKNOWN", f"{label} ran only after this statement — cannot tell what it referred to"
        if not execs:
            return "UNKNOWN", "no shell activity recorded in this transcript — evidence may be incomplete"
        if tools:
            return "UNKNOWN", f"no {label} command observed, but {tools} can execute code we cannot inspect"
        if denied:
            return "UNKNOWN", f"no {label} command observed, and at least one command was denied before it could run"
        return "UNSUPPORTED", f"claimed {label} — no {label} command was run in {execs} shell invocations"
    outcome, basis, code = run
    if outcome == "failed":
        return "CONTRADICTED", f"claimed {label} passed — the last observed {label} run failed" + ("" if code is None else f" (exit {code})")
    if outcome == "passed":
        return "VERIFIED", f"{label} did run and succeeded" if ran else f"{label} observed passing via {'exit status 0' if basis == 'exit-status' else 'runner summary'}"
    if ran:
        return "VERIFIED", f"{label} did run; outcome not determinable"
    return "UNKNOWN", f"{label} ran but its outcome is not recoverable from the transcript (output piped or suppressed)"


RUN = "seq long, result_seq long, block int, place int, outcome string, basis string, exit_code long"
CLAIM = f"seq long, activity string, assertion string, sentence string, verdict string, reason string, {RUN.replace('seq long, result_seq', 'run_seq long, result_seq')}"


class Judging(StatefulProcessor):
    """Rows of OUT for claims whose verdict or reason is new."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.facts = handle.getValueState("facts", "execs long, denied boolean, tools string", self.idle_ms)
        self.last = handle.getMapState("last", "activity string", RUN, self.idle_ms)
        self.claims = handle.getMapState("claims", "claim string", CLAIM, self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = sorted((r for pdf in rows for r in pdf.itertuples(index=False)), key=lambda r: (r.result_seq, -1 if _none(r.block) else r.block, r.x))
        execs, denied, tools = self.facts.get() if self.facts.exists() else (0, False, "")
        runs: dict[str, list[tuple]] = {}
        fresh = []
        for r in held:
            if r.step == "exec":
                execs, denied = execs + 1, denied or r.ended == "denied"
            elif r.step == "hidden":
                tools = tools if r.tool in tools.split(", ") else f"{tools}, {r.tool}" if tools else r.tool
            elif r.step == "run":
                runs.setdefault(r.activity, []).append((int(r.seq), int(r.result_seq), int(r.block), int(r.x), r.outcome, r.basis, None if _none(r.exit_code) else int(r.exit_code)))
            elif r.step == "claim":
                fresh.append((f"{r.seq}/{r.block}/{r.x}/{r.y}/{r.activity}", (int(r.seq), r.activity, r.assertion, r.sentence, None, None)))
        best = lambda known, seq: max((x for x in known if x and x[0] <= seq), key=lambda x: x[:4], default=None)
        before = {a: self.last.getValue((a,)) if self.last.containsKey((a,)) else None for a in P.CLAIMABLE}
        known = [(k[0], tuple(v)) for k, v in self.claims.iterator()]
        rests = [(k, v[:6], best([v[6:] if v[6] is not None else None, *runs.get(v[1], [])], v[0])) for k, v in known]
        rests += [(k, v, best([tuple(before[v[1]]) if before[v[1]] else None, *runs.get(v[1], [])], v[0])) for k, v in fresh]
        out = []
        for name, (seq, activity, assertion, sentence, *told), run in rests:
            later = run is None and bool(before[activity] or runs.get(activity))
            now = judged({"activity": activity, "assertion": assertion}, run and run[4:], later, execs, denied, tools)
            if [*now] != told:
                out.append((key[0], seq, activity, assertion, sentence, *now, name))
            if [*now] != told or runs.get(activity):
                self.claims.updateValue((name,), (seq, activity, assertion, sentence, *now, *(run or (None,) * 7)))
        for activity, own in runs.items():
            if activity in before:
                self.last.updateValue((activity,), max([*([tuple(before[activity])] if before[activity] else []), *own], key=lambda x: x[:4]))
        self.facts.update((execs, denied, tools))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def verdicts(lines: DataFrame, idle_ms: int = 86_400_000) -> DataFrame:
    """Rows of OUT over a stream of raw lines (file, start, n, line, error), in append mode."""
    paired = blocks(lines).groupBy("file").transformWithStateInPandas(Pairing(idle_ms), PAIRED, "Append", "ProcessingTime")
    return _steps(paired).groupBy("file").transformWithStateInPandas(Judging(idle_ms), OUT, "Append", "ProcessingTime")


def growing(spark: SparkSession, root: str, **options) -> DataFrame:
    """The lines that transcripts in the folders of ``root`` gain, as a stream."""
    spark.dataSource.register(Lines)
    return spark.readStream.format("transcript_lines").option("path", root).options(**options).load()
