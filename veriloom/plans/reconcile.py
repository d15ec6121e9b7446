"""From normalized sessions to runs, claims, verdicts, badges and branch rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import patterns as P
from veriloom.functions.prose import with_claims
from veriloom.functions.shell import analyze, outcome, output_verdict
from veriloom.functions.text import strip_ansi
from veriloom.operators.asof import asof_join
from veriloom.operators.labels import unique_labels
from veriloom.operators.ordered import running

# Verdicts from worst to best, and what a gate fails on.
VERDICTS = ("CONTRADICTED", "UNSUPPORTED", "UNKNOWN", "VERIFIED")
POLICIES = {"contradicted": VERDICTS[:1], "unsupported": VERDICTS[:2], "unknown": VERDICTS[:3], "never": ()}


class Evidence(NamedTuple):
    """What one reconciliation gives; all but branches are keyed by session_id."""

    sessions: DataFrame
    runs: DataFrame
    findings: DataFrame
    reports: DataFrame


def rank(verdict: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), verdict) - 1


# Lists are exploded in the outer form and empty ones dropped after it: else a filter on the
# list is inferred below, and the whole expression that makes the list is run in it again.


def with_activities(execs: DataFrame) -> DataFrame:
    """``execs`` with ``segments`` that do something known, and ``acts``, their distinct activities.

    Denied commands, and rows without one, do nothing.
    """
    ran = F.when(F.coalesce(F.col("outcome") != "denied", F.lit(False)), F.col("command"))
    known = execs.withColumn("segments", F.filter(analyze(ran), lambda s: s["activity"] != "other"))
    return known.withColumn("acts", F.coalesce(F.array_distinct(F.transform("segments", lambda s: s["activity"])), F.array().cast("array<string>")))


def run_found() -> Column:
    """outcome and basis of a run, from its activity and what ``with_activities`` gave its command."""
    first = F.filter("segments", lambda s: s["activity"] == F.col("activity"))[0]
    shown = output_verdict(F.concat_ws("\n", "stdout", "stderr"), F.col("activity"))
    return outcome(F.col("outcome"), F.col("exit_code"), first["status_masked"], F.size("acts") > 1, shown)


def observed_runs(execs: DataFrame) -> DataFrame:
    """session_id, ord, seq, run_ord, activity, outcome, basis, exit_code, command, ts.

    One run per activity of a command, of its first segment; denied commands ran nothing.
    """
    each = with_activities(execs).select("*", F.posexplode_outer("acts").alias("run_ord", "activity")).where("activity is not null")
    return each.withColumn("found", run_found()).select("session_id", "ord", "seq", "run_ord", "activity", F.col("found.outcome").alias("outcome"), F.col("found.basis").alias("basis"), "exit_code", "command", "ts")


def extract_claims(utterances: DataFrame) -> DataFrame:
    """session_id, seq, ts, claim_ord, activity, assertion, sentence."""
    each = with_claims(utterances.select("session_id", "seq", "block", "ts", "text"), "text").select("session_id", "seq", "block", "ts", F.explode_outer("claims").alias("c")).where("c is not null")
    order = F.struct("seq", "block", F.col("c.spos").alias("spos"), F.col("c.ppos").alias("ppos"))
    return each.select("session_id", "seq", "ts", order.alias("claim_ord"), "c.activity", "c.assertion", "c.sentence")


def _label(activity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in P.LABELS.items() for x in pair]), activity)


def judge(claims: DataFrame, runs: DataFrame, sessions: DataFrame, execs: DataFrame, slices: int = 1) -> DataFrame:
    """``claims`` with verdict, reason and evidence (array of runs, three at most).

    With ``slices`` a session of very many runs is cut along its lines, see ``ordered``.
    """
    run = ["activity", "outcome", "basis", "exit_code", "command", "seq", "ts"]
    ranked = running(runs, ["session_id", "activity"], ["seq", "ord", "run_ord"], sums={"run_no": F.lit(1)}, slices=slices)
    met = asof_join(claims, ranked, ["session_id", "activity"], "seq", "run_no", run, "latest", slices)
    firsts = ranked.where("run_no <= 3").groupBy("session_id", "activity").agg(F.array_sort(F.collect_list(F.struct("run_no", F.struct(*run).alias("run")))).alias("firsts"))
    per_exec = execs.groupBy("session_id").agg(F.count(F.lit(1)).alias("execs"), F.bool_or(F.col("outcome") == "denied").alias("denied"))
    facts = sessions.select("session_id", "opaque_executors").join(per_exec, "session_id", "left")
    met = met.join(firsts, ["session_id", "activity"], "left").join(facts, "session_id", "left")
    label, last, ran = _label(F.col("activity")), F.col("latest"), F.col("assertion") == "ran"
    execs_, tools = F.coalesce("execs", F.lit(0)), F.array_join(F.coalesce("opaque_executors", F.array().cast("array<string>")), ", ")
    none = last.isNull()
    say = lambda verdict, *parts: F.struct(F.lit(verdict).alias("verdict"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("reason"))
    code = F.when(last["exit_code"].isNull(), "").otherwise(F.concat(F.lit(" (exit "), last["exit_code"].cast("string"), F.lit(")")))
    found = (
        F.when(none & F.col("firsts").isNotNull(), say("UNKNOWN", label, " ran only after this statement — cannot tell what it referred to"))
        .when(none & (execs_ == 0), say("UNKNOWN", "no shell activity recorded in this transcript — evidence may be incomplete"))
        .when(none & (tools != ""), say("UNKNOWN", "no ", label, " command observed, but ", tools, " can execute code we cannot inspect"))
        .when(none & F.coalesce("denied", F.lit(False)), say("UNKNOWN", "no ", label, " command observed, and at least one command was denied before it could run"))
        .when(none, say("UNSUPPORTED", "claimed ", label, " — no ", label, " command was run in ", execs_.cast("string"), " shell invocations"))
        .when(last["outcome"] == "failed", say("CONTRADICTED", "claimed ", label, " passed — the last observed ", label, " run failed", code))
        .when((last["outcome"] == "passed") & ran, say("VERIFIED", label, " did run and succeeded"))
        .when(last["outcome"] == "passed", say("VERIFIED", label, " observed passing via ", F.when(last["basis"] == "exit-status", "exit status 0").otherwise("runner summary")))
        .when(ran, say("VERIFIED", label, " did run; outcome not determinable"))
        .otherwise(say("UNKNOWN", label, " ran but its outcome is not recoverable from the transcript (output piped or suppressed)"))
    )
    evidence = F.when(~none, F.array(last)).when(F.col("firsts").isNotNull(), F.transform("firsts", lambda x: x["run"])).otherwise(F.array().cast(met.select(F.array("latest").alias("x")).schema["x"].dataType))
    return met.withColumn("found", found).select(*claims.columns, "found.verdict", "found.reason", evidence.alias("evidence"))


def reports(sessions: DataFrame, execs: DataFrame, edits: DataFrame, runs: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per session: its facts with verdict, summary (the badge), risk, observed
    activities, counts of claims per verdict, of executions, edits and runs."""
    worst = F.min(F.struct(rank(F.col("verdict")).alias("rank"), "claim_ord", "verdict", "activity"))
    tally = [F.count_if(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS]
    per_claim = findings.groupBy("session_id").agg(worst.alias("worst"), F.count(F.lit(1)).alias("claims"), *tally)
    seen = F.transform(F.array_sort(F.collect_list(F.struct("seq", "ord", "run_ord", "activity"))), lambda x: x["activity"])
    per_run = runs.groupBy("session_id").agg(F.array_distinct(seen).alias("observed_activities"), F.count(F.lit(1)).alias("runs"))
    per_exec = execs.groupBy("session_id").agg(F.count(F.lit(1)).alias("execs"))
    per_edit = edits.groupBy("session_id").agg(F.count(F.lit(1)).alias("edits"))
    out = sessions
    for part in (per_claim, per_run, per_exec, per_edit):
        out = out.join(part, "session_id", "left")
    zero = F.lit(0).cast("long")
    out = out.withColumns({c: F.coalesce(c, zero) for c in ("claims", "runs", "execs", "edits", *[v.lower() for v in VERDICTS])})
    out = out.withColumn("observed_activities", F.coalesce("observed_activities", F.array().cast("array<string>")))
    tested = F.array_contains("observed_activities", "test")
    verdict = F.coalesce("worst.verdict", F.when(tested, "VERIFIED").otherwise("UNKNOWN"))
    hits = F.coalesce(*[F.when(verdict == v, F.col(v.lower())) for v in VERDICTS])
    extra = F.when(F.col("claims") > 1, F.concat(F.lit(" ("), hits.cast("string"), F.lit(" of "), F.col("claims").cast("string"), F.lit(" claims)"))).otherwise("")
    said = F.when(verdict == "CONTRADICTED", " claimed passing, observed failing").when(verdict == "UNSUPPORTED", " claimed, never observed").when(verdict == "UNKNOWN", " claim not verifiable").otherwise(" claimed and observed")
    summary = F.when(F.col("claims") > 0, F.concat(_label(F.col("worst.activity")), said, extra)).when(tested, "tests observed, none claimed").otherwise("no execution claims made")
    risk = F.when(F.col("contradicted") + F.col("unsupported") > 0, "high").when(F.col("unknown") > 0, "medium").otherwise("low")
    return out.withColumn("verdict", verdict).withColumn("summary", summary).withColumn("risk", risk).drop("worst")


def reconcile(sessions: DataFrame, execs: DataFrame, edits: DataFrame, claims: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df, slices: int = 1) -> Evidence:
    """All keyed by session_id; ``claims`` are extracted, or read from a store.

    ``sessions`` also has ``id``, the id to show, if that is another one.  ``keep`` may
    write runs, claims and findings, which several parts read, and read them back.
    """
    if "id" not in sessions.columns:
        sessions = sessions.withColumn("id", F.col("session_id"))
    runs, claims = keep(observed_runs(execs), "runs"), keep(claims, "claims")
    findings = keep(judge(claims, runs, sessions, execs, slices), "findings")
    return Evidence(sessions, runs, findings, reports(sessions, execs, edits, runs, findings))


def from_transcripts(t, sessions: DataFrame) -> Evidence:
    """Reconciles the given sessions of a live scan; a file is a session, whatever its id."""
    sessions = sessions.withColumn("id", F.col("session_id")).withColumn("session_id", F.col("file"))
    own = sessions.select("file", "session_id")
    keyed = lambda df: df.join(own, "file")
    return reconcile(sessions, keyed(t.execs), keyed(t.edits), extract_claims(keyed(t.utterances)))


def branch_rows(reports_: DataFrame) -> DataFrame:
    """One row per branch (and folder, if there are several folders), worst first.

    label, branch, cwd, verdict, summary, needs_attention, sessions (ids in order),
    execs, edits, tokens, row_ord: the place of its first session.
    """
    order = F.struct(F.coalesce("started_at", F.lit("")).alias("at"), "session_id")
    rows = reports_.withColumn("name", strip_ansi(F.coalesce("git_branch", F.lit("(no branch)")))).withColumn("folder", F.coalesce("cwd", F.lit(""))).withColumn("o", order)
    folders = rows.select("folder").distinct()
    labels = unique_labels(folders, "folder")
    # the number of folders decides if branches of one name are told apart
    several = folders.agg(F.count(F.lit(1)).alias("n")).select((F.col("n") > 1).alias("several"))
    rows = rows.join(F.broadcast(several), F.lit(True)).join(labels, "folder")
    key = F.when(F.col("several"), F.col("folder")).otherwise("")
    worst = F.min(F.struct(rank(F.col("verdict")).alias("rank"), "o", "verdict", "summary"))
    first = F.min(F.struct("o", F.coalesce("git_branch", F.lit("(no branch)")).alias("branch"), "cwd", "label", "several"))
    per = rows.groupBy(key.alias("key"), "name").agg(
        worst.alias("worst"),
        first.alias("first"),
        F.transform(F.array_sort(F.collect_list(F.struct("o", "id"))), lambda x: x["id"]).alias("sessions"),
        F.sum("execs").alias("execs"),
        F.sum("edits").alias("edits"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
    )
    label = F.when(F.col("first.several"), F.concat_ws("/", "first.label", "name")).otherwise(F.col("name"))
    return per.select(
        label.alias("label"), "first.branch", "first.cwd", "worst.verdict", "worst.summary", F.col("worst.verdict").isin(*VERDICTS[:2]).alias("needs_attention"),
        "sessions", "execs", "edits", "tokens", F.col("first.o").alias("row_ord"),
    ).orderBy(rank(F.col("verdict")), F.col("execs").desc(), "row_ord")


def digest(findings: DataFrame, by: str = "session_id") -> DataFrame:
    """Findings of one verdict, sentence and evidence as one, with all their activities, worst first."""
    commands = F.array_join(F.transform("evidence", lambda e: e["command"]), "\x01")
    acts = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("claim_ord", "activity"))), lambda x: x["activity"]))
    first = F.min_by(F.struct("reason", "evidence"), "claim_ord")
    per = findings.groupBy(by, "verdict", "sentence", commands.alias("commands")).agg(acts.alias("activities"), first.alias("first"), F.min("claim_ord").alias("claim_ord"))
    return per.select(by, "verdict", "sentence", "activities", "first.reason", "first.evidence", "claim_ord").orderBy(by, rank(F.col("verdict")), "claim_ord")


def headline(rows: DataFrame, reports_: DataFrame, findings: DataFrame) -> DataFrame:
    """label, verdict, activity, sentence, reason, evidence: the worst finding of the first
    branch that needs attention, the earliest of equally bad ones; no row if no branch does."""
    first = rows.where("needs_attention").orderBy(rank(F.col("verdict")), F.col("execs").desc(), "row_ord").limit(1)
    own = first.select("label", F.posexplode("sessions").alias("no", "id")).join(reports_.select("id", "session_id"), "id")
    found = own.join(findings.select("session_id", "claim_ord", "verdict", "activity", "sentence", "reason", "evidence"), "session_id")
    return found.orderBy(rank(F.col("verdict")), "no", "claim_ord").limit(1).drop("session_id", "id", "no", "claim_ord")


def violations(rows: DataFrame, policy: str) -> DataFrame:
    fails = POLICIES[policy]
    return rows.where(F.col("verdict").isin(*fails) if fails else F.lit(False)).select("label", "verdict", "summary")


def tally(findings: DataFrame) -> DataFrame:
    """One row: the number of claims of each verdict."""
    return findings.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
