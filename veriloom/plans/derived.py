"""Sessions derived from the given tables, which hold no transcripts of their own.

Each user of ``events`` is a session and each event, in order of time, a step of
it: what the step ran or said follows from the event's type and its id modulo 4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.operators.ordered import running, spread
from veriloom.plans.reconcile import Evidence, extract_claims, reconcile
from veriloom.sources.scratch import scratch
from veriloom.sources.transcripts import Scanned

# Fixed values: (type, id modulo 4) of an event -> command, output, exit code.
RAN = {
    ("error", 0): ("ruff check src", "Found 1 error.", 1),
    ("error", 1): ("ruff check src", "All checks passed!", 0),
    ("error", 2): ("ruff check src | tail -1", "Found 2 errors.", 0),
    ("error", 3): ("ruff check src 2>&1 | tail -1", "", 0),
    ("view", 0): ("npm test", "Tests: 4 passed, 4 total", 0),
    ("view", 1): ("CI=1 npm run test:unit", "Tests: 1 failed, 3 passed", 1),
    ("view", 2): ("cargo test 2>&1 | tail -2", "test result: FAILED. 1 passed", 0),
    ("view", 3): ("pytest -q | tail -1", "", 0),
    ("click", 0): ("git status", "clean", 0),
    ("click", 1): ("npm run build", "Compiled successfully", 0),
    ("click", 2): ("tsc --noEmit && npm run build", "Found 0 errors", 0),
    ("click", 3): ('echo "run the tests; make test" | cat', "", 0),
}
# What the step said.
SAID = {
    ("purchase", 0): "All tests pass.",
    ("purchase", 1): "The build compiles cleanly.",
    ("purchase", 2): "Next step: make the tests pass. I ran the tests.",
    ("purchase", 3): "Typecheck passes. All tests pass.",
    ("signup", 0): "Lint clean.",
    ("signup", 1): "Lint clean, and the suite passes.",
    ("signup", 2): "The tests are failing.",
    ("signup", 3): "Should the tests pass?",
}


def _lookup(table: dict, field: int | None) -> Column:
    out = None
    for (kind, k), value in table.items():
        here = (F.col("event_type") == kind) & (F.col("event_id") % 4 == k)
        value = value if field is None else value[field]
        out = F.when(here, F.lit(value)) if out is None else out.when(here, F.lit(value))
    return out


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, seq, last_line, event_id, command, stdout, exit_code, said, ts, cwd, git_branch."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = {"seq": F.lit(1), "last_line": F.when(_lookup(SAID, None).isNotNull(), 1).otherwise(2)}
    # a user may have most of the events
    events = running(events, ["user_id"], ["ts", "event_id"], sums=lines, slices=spread(events, ["user_id"]), by=F.unix_micros("ts"))
    user = F.col("user_id")
    return events.select(
        user.cast("string").alias("session_id"),
        F.col("seq").cast("long").alias("seq"),
        # a step that says something is one line of a transcript, any other two
        "last_line",
        "event_id",
        _lookup(RAN, 0).alias("command"),
        _lookup(RAN, 1).alias("stdout"),
        _lookup(RAN, 2).cast("long").alias("exit_code"),
        _lookup(SAID, None).alias("said"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        F.when(user % 3 == 0, "/work/client/app").when(user % 3 == 1, "/work/server/app").otherwise("/srv/data").alias("cwd"),
        F.concat(F.lit("topic-"), (user % 5).cast("string")).alias("git_branch"),
    )


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of this job, computed once."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def evidence(spark: SparkSession, sf_dir: str) -> Evidence:
    """The derived sessions, reconciled; the events are read once."""
    rows = kept(steps(spark, sf_dir), "steps")
    zero, none = F.lit(0).cast("long"), F.array().cast("array<string>")
    sessions = rows.groupBy("session_id").agg(F.first("cwd").alias("cwd"), F.first("git_branch").alias("git_branch"), F.min("ts").alias("started_at"), F.sum(F.col("event_id") % 100).alias("input_tokens"), F.sum(F.col("event_id") % 10).alias("output_tokens"))
    sessions = sessions.withColumn("opaque_executors", none)
    execs = rows.where("command is not null").select("session_id", F.struct("seq").alias("ord"), "seq", "command", "stdout", F.lit("").alias("stderr"), "exit_code", F.when(F.col("exit_code") == 0, "passed").otherwise("failed").alias("outcome"), "ts")
    edits = rows.where("event_id % 7 = 0").select("session_id", "seq")
    claims = extract_claims(rows.where("said is not null").select("session_id", "seq", F.lit(0).alias("block"), "ts", F.col("said").alias("text")))
    return reconcile(sessions.withColumn("unparsed_lines", zero), execs, edits, claims, kept, spread(rows, ["session_id"]))


def transcripts(spark: SparkSession, sf_dir: str) -> Scanned:
    """The derived sessions as scanned transcripts.

    A step that runs something is two lines, a use and its result; ids of uses repeat
    within a session (the event's id modulo 5), so results must find the last use.
    """
    rows = steps(spark, sf_dir)
    common = [F.col("session_id").alias("sessionId"), F.col("ts").alias("timestamp"), "cwd", F.col("git_branch").alias("gitBranch")]
    usage = F.struct((F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 10).alias("output_tokens"))
    use_id = F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string"))
    said = F.to_json(F.struct(F.lit("assistant").alias("type"), *common, F.struct(usage.alias("usage"), F.array(F.struct(F.lit("text").alias("type"), F.col("said").alias("text"))).alias("content")).alias("message")))
    use = F.to_json(F.struct(F.lit("assistant").alias("type"), *common, F.struct(usage.alias("usage"), F.array(F.struct(F.lit("tool_use").alias("type"), use_id.alias("id"), F.lit("Bash").alias("name"), F.struct("command").alias("input"))).alias("content")).alias("message")))
    text = F.when(F.col("exit_code") == 0, F.col("stdout")).otherwise(F.concat(F.lit("Exit code "), F.col("exit_code").cast("string"), F.lit("\n"), F.col("stdout")))
    result = F.to_json(F.struct(F.lit("user").alias("type"), *common, F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), use_id.alias("tool_use_id"), text.alias("content"), (F.col("exit_code") != 0).alias("is_error"))).alias("content")).alias("message")))
    file = F.concat(F.lit("/s/"), "session_id", F.lit(".jsonl"))
    each = rows.select(file.alias("file"), "last_line", F.when(F.col("said").isNotNull(), F.array(said)).otherwise(F.array(use, result)).alias("told"))
    lines = each.select("file", (F.col("last_line") - F.size("told") + 1).alias("first"), F.posexplode_outer("told").alias("pos", "line"))
    lines = lines.where("pos is not null").select("file", (F.col("first") + F.col("pos")).alias("seq"), "line")
    files = lines.groupBy("file").agg(F.sum(F.length("line") + 1).alias("file_size")).withColumn("file_mtime", F.lit(None).cast("timestamp"))
    return Scanned(files, lines)
