"""Session transcripts: discovery, scan and normalization of JSON lines.

Files are read in ranges of bytes (see ``lines``), with physical line numbers; everything
after that is DataFrame operations keyed by file.  A file that can't be read, is cut short
or is gone gives the session of the lines that were read, and a row in ``errors``.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriloom.functions import patterns as P
from veriloom.functions.json_text import parsed, typed
from veriloom.functions.regex import flagged, matches, trimmed
from veriloom.functions.shell import classify_result
from veriloom.sources.lines import RANGE, numbered

FILES = "file string, file_size long, file_mtime timestamp"


class Scanned(NamedTuple):
    """files: file, file_size, file_mtime; lines: file, seq, line; errors: file, error."""

    files: DataFrame
    lines: DataFrame
    errors: DataFrame | None = None


class Transcripts(NamedTuple):
    """Normalized records; all but ``sessions`` are keyed by file."""

    sessions: DataFrame
    execs: DataFrame
    utterances: DataFrame
    edits: DataFrame


def project_folder(repo: str) -> str:
    """The folder name under which sessions of a repository are stored."""
    return re.sub(r"[^a-zA-Z0-9]", "-", repo)


def named(path: str) -> str:
    """A file's one name: local ones start with file:///."""
    return re.sub("^file:/+", "file:///", path)


def _listed(spark: SparkSession, glob: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(named(x.getPath().toString()) for x in found or [] if x.isFile() or not glob.endswith(".jsonl"))


def locate(spark: SparkSession, root: str, repo: str | None = None, limit: int | None = None) -> list[str]:
    """Transcript files below ``root``: those in the folders of ``repo`` and of its
    subfolders if there are any, else all.  ``limit`` counts files before any filter."""
    found = []
    if repo is not None:
        name = project_folder(repo)
        folders = [x for x in _listed(spark, f"{root}/*") if (last := x.rsplit("/", 1)[1]) == name or last.startswith(f"{name}-")]
        found = [f for d in folders for f in _listed(spark, f"{d}/*.jsonl")]
        if folders:
            return found[:limit] if limit is not None else found
    found = _listed(spark, f"{root}/*/*.jsonl")
    return found[:limit] if limit is not None else found


def stat(spark: SparkSession, files: list[str]) -> DataFrame:
    """file, file_size, file_mtime of the transcripts that are there, without reading them."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    folders = [d for d in sorted({f.rsplit("/", 1)[0] for f in files}) if (p := path(d)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)]
    if not folders:
        return spark.createDataFrame([], FILES)
    meta = F.col("_metadata")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("ignoreMissingFiles", "true").load(folders)
    found = found.select(F.regexp_replace(meta["file_path"], "^file:/+", "file:///").alias("file"), meta["file_size"].alias("file_size"), meta["file_modification_time"].alias("file_mtime"))
    return found.join(spark.createDataFrame([(f,) for f in files], "file string"), "file", "left_semi")


def scan(spark: SparkSession, files: list[str], size: int = RANGE) -> Scanned:
    """The lines of transcripts; a file is cut into ranges of ``size`` bytes."""
    there = [tuple(r) for r in stat(spark, files).collect()]  # names and sizes of files, which are listed here anyway
    gone = sorted(set(files) - {f for f, _, _ in there})
    lines, errors = numbered(spark, [(f, n) for f, n, _ in there], size)
    missing = spark.createDataFrame([(f, "gone") for f in gone], "file string, error string")
    return Scanned(spark.createDataFrame(there + [(f, 0, None) for f in gone], FILES), lines, errors.unionByName(missing).distinct())


def records(lines: DataFrame) -> DataFrame:
    """file, seq (1-based physical line), v: a variant, null where the line is no JSON."""
    kept = lines.select("file", "seq", trimmed(F.col("line")).alias("line")).where("line <> ''")
    v, checked, strict = parsed(F.col("line"))
    return kept.withColumn("_v", v).withColumn("_checked", checked).select("file", "seq", strict.alias("v"))


def problems(s: Scanned) -> DataFrame:
    """file, seq, problem: files that could not be read whole (no seq), and lines that are no JSON."""
    lines = records(s.lines).where("v is null").select("file", "seq", F.lit("no JSON").alias("problem"))
    return lines if s.errors is None else lines.unionByName(s.errors.select("file", F.lit(None).cast("long").alias("seq"), F.col("error").alias("problem")))


def _text(path: str) -> Column:
    return typed(F.col("v"), path, "STRING")


def _blocks(rows: DataFrame) -> DataFrame:
    """The blocks of each message's content."""
    content = F.try_variant_get("v", "$.message.content", "array<variant>")
    return rows.select("file", "seq", "v", F.posexplode_outer(content).alias("block", "b")).where("block is not null")


def as_text(value: Column) -> Column:
    """A string as it is; of an array the text fields, a line each; else empty."""
    parts = F.try_variant_get(value, "$", "array<variant>")
    texts = F.array_compact(F.transform(parts, lambda x: typed(x, "$.text", "STRING")))
    return F.coalesce(typed(value, "$", "STRING"), F.array_join(texts, "\n"), F.lit(""))


def paired(blocks: DataFrame) -> DataFrame:
    """file, seq, block, tool_use_id, result, use: each tool result with the last use of its
    id before it in the file.  Only what is made of a block goes through the shuffle."""
    b = F.col("b")
    kind = typed(b, "$.type", "STRING")
    use, result = kind == "tool_use", kind == "tool_result"
    key = F.when(use, typed(b, "$.id", "STRING")).when(result, typed(b, "$.tool_use_id", "STRING"))
    made = F.struct(
        F.col("seq").alias("seq"),
        F.coalesce(typed(b, "$.name", "STRING"), F.lit("")).alias("name"),
        typed(b, "$.input.command", "STRING").alias("command"),
        typed(b, "$.input.description", "STRING").alias("description"),
        _text("$.timestamp").alias("ts"),
    )
    both = blocks.where(key.isNotNull()).select("file", "seq", "block", key.alias("tool_use_id"), F.when(result, classified(F.col("v"), b)).alias("result"), F.when(use, made).alias("use"))
    before = Window.partitionBy("file", "tool_use_id").orderBy("seq", "block").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("use", F.last("use", ignorenulls=True).over(before)).where(F.col("result").isNotNull() & F.col("use").isNotNull())


def classified(v: Column, b: Column) -> Column:
    """stdout, stderr, exit_code, outcome, backgrounded of a block ``b`` of record ``v`` that is a tool result."""
    result = lambda k, t: typed(v, f"$.toolUseResult.{k}", t)
    text = as_text(F.try_variant_get(b, "$.content", "variant"))
    background = result("backgroundTaskId", "STRING").isNotNull()
    what = classify_result(
        F.rlike(trimmed(text), F.lit(flagged(P.DENIAL, "i"))),
        F.coalesce(result("interrupted", "BOOLEAN"), F.lit(False)),
        background,
        F.coalesce(typed(b, "$.is_error", "BOOLEAN"), F.lit(False)),
        text,
        result("stdout", "STRING"),
        result("stderr", "STRING"),
    )
    return what.withField("backgrounded", background)


def executions(blocks: DataFrame) -> DataFrame:
    """file, ord, seq, tool_use_id, command, description, ts, stdout, stderr, exit_code, outcome, backgrounded."""
    rows = paired(blocks).where((F.col("use.name") == "Bash") & (F.col("use.command") != ""))
    own = [f"result.{c}" for c in ("stdout", "stderr", "exit_code", "outcome", "backgrounded")]
    place = F.struct(F.col("use.seq").alias("use_seq"), F.col("seq").alias("result_seq"), F.col("block").alias("block"))
    return rows.select("file", place.alias("ord"), "use.seq", "tool_use_id", "use.command", "use.description", "use.ts", *own)


def _first_seen(value: str) -> Column:
    """Distinct values in order of (seq, block)."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct("seq", "block", value)))), lambda x: x[value]))


def sessions(files: DataFrame, rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per file with the session's own facts."""
    usage = lambda k: F.sum(F.coalesce(typed(F.col("v"), f"$.message.usage.{k}", "NUMBER"), F.lit(0.0))).cast("long")
    seq = F.col("seq")
    some = lambda path: F.when(_text(path) != "", _text(path))
    model = F.when(_text("$.message.model") != "<synthetic>", _text("$.message.model"))
    rows = rows.withColumn("model", model).withColumn("block", F.lit(0))
    facts = rows.groupBy("file").agg(
        F.min_by(some("$.sessionId"), F.when(some("$.sessionId").isNotNull(), seq)).alias("own_id"),
        F.min_by(_text("$.cwd"), F.when(_text("$.cwd").isNotNull(), seq)).alias("cwd"),
        F.max_by(some("$.gitBranch"), F.when(some("$.gitBranch").isNotNull(), seq)).alias("git_branch"),
        F.max_by(_text("$.version"), F.when(_text("$.version").isNotNull(), seq)).alias("agent_version"),
        F.min(_text("$.timestamp")).alias("started_at"),
        F.max(_text("$.timestamp")).alias("ended_at"),
        _first_seen("model").alias("models"),
        usage("input_tokens").alias("input_tokens"),
        usage("output_tokens").alias("output_tokens"),
        usage("cache_read_input_tokens").alias("cache_read_tokens"),
        usage("cache_creation_input_tokens").alias("cache_creation_tokens"),
        F.count_if(F.col("v").isNull()).alias("unparsed_lines"),
    )
    name = F.coalesce(typed(F.col("b"), "$.name", "STRING"), F.lit(""))
    hidden = blocks.where((typed(F.col("b"), "$.type", "STRING") == "tool_use") & matches(name, (P.OPAQUE, "i"))).withColumn("tool", name)
    opaque = hidden.groupBy("file").agg(_first_seen("tool").alias("opaque_executors"))
    out = files.select("file", "file_size", "file_mtime").join(facts, "file", "left").join(opaque, "file", "left")
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    return out.select(
        F.coalesce("own_id", "file").alias("session_id"), "file", "file_size", "file_mtime", "cwd", "git_branch", "agent_version", "started_at", "ended_at",
        F.coalesce("models", none).alias("models"), F.coalesce("opaque_executors", none).alias("opaque_executors"),
        *[F.coalesce(c, zero).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "unparsed_lines")],
    )


def normalize(s: Scanned, rows: DataFrame | None = None) -> Transcripts:
    """Sessions, shell executions, prose and edits of scanned transcripts.

    ``rows`` are their records, if these are kept: each part reads them, and without that
    each part reads the files.
    """
    rows = records(s.lines) if rows is None else rows
    blocks = _blocks(rows)
    b = F.col("b")
    kind, name = typed(b, "$.type", "STRING"), typed(b, "$.name", "STRING")
    text = typed(b, "$.text", "STRING")
    said = blocks.where((kind == "text") & (_text("$.type") == "assistant") & (trimmed(text) != "")).select("file", "seq", "block", _text("$.timestamp").alias("ts"), text.alias("text"))
    of_file, of_notebook = typed(b, "$.input.file_path", "STRING"), typed(b, "$.input.notebook_path", "STRING")
    what = F.when((name == "Write") & of_file.isNotNull(), "write").when((name == "Edit") & of_file.isNotNull(), "edit").when((name == "NotebookEdit") & of_notebook.isNotNull(), "notebook")
    edits = blocks.where((kind == "tool_use") & what.isNotNull()).select("file", "seq", "block", F.when(what == "notebook", of_notebook).otherwise(of_file).alias("path"), what.alias("kind"))
    return Transcripts(sessions(s.files, rows, blocks), executions(blocks), said, edits)


def in_scope(t: Transcripts, repo: str | None = None, branch: str | None = None, session: str | None = None) -> DataFrame:
    """Sessions of a live scan: below ``repo`` (or without a folder), of the branch,
    with the id prefix, and with at least one execution or utterance."""
    out = t.sessions
    if repo is not None:
        out = out.where(F.col("cwd").isNull() | F.col("cwd").startswith(repo))
    if branch is not None:
        out = out.where(F.col("git_branch") == branch)
    if session is not None:
        out = out.where(F.col("session_id").startswith(session))
    return out.join(t.execs.select("file").unionByName(t.utterances.select("file")).distinct(), "file", "left_semi")
