"""Shell commands: segments, activities, and outcomes read from output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriloom.functions import patterns as P
from veriloom.functions.regex import flagged, matches, portable, trimmed

#: Noncharacters that stand for the ends of pipelines and of their stages.
_END, _PIPE = "\ufdd0", "\ufdd1"
# a quoted part runs to a quote of its kind that no backslash precedes, or to the end
_QUOTED = r""""(?:[^"]|(?<=\\)")*+(?:"|\z)|'(?:[^']|(?<=\\)')*+(?:'|\z)"""
# an ampersand of a redirection (after < or >, before >) is text
_AND = r"(?!&&)(?:(?<=[<>])&|&(?=>))"
_TOKEN = rf"""{_QUOTED}|&&|\|\||\|&|\||;|\n|(?<![<>])&(?!>)|(?:[^'"&|;\n]|{_AND})+|&"""


def split_segments(command: Column) -> Column:
    """array<struct<text, pipe_index, last_in_pipe>> of a command line."""
    tokens = F.regexp_extract_all(command, F.lit(_TOKEN), F.lit(0))
    marked = F.transform(tokens, lambda t: F.when(t.isin("&&", "||", ";", "\n", "&"), _END).when(t.isin("|", "|&"), _PIPE).otherwise(t))
    pipelines = F.split(F.array_join(marked, ""), _END)

    def stages(pipeline: Column) -> Column:
        parts = F.transform(F.split(pipeline, _PIPE), lambda s, i: F.struct(trimmed(s).alias("text"), i.alias("pipe_index")))
        full = F.filter(parts, lambda s: s["text"] != "")
        return F.transform(full, lambda s, i: F.struct(s["text"].alias("text"), s["pipe_index"].alias("pipe_index"), (i == F.size(full) - 1).alias("last_in_pipe")))

    return F.flatten(F.transform(pipelines, stages))


def strip_prefix(segment: Column) -> Column:
    return trimmed(F.regexp_replace(segment, portable(P.PREFIX_NOISE), ""))


def activity(segment: Column) -> Column:
    """The activity of a segment without prefix noise; the first in order of precedence."""
    out = None
    for name, starts in P.ACTIVITIES.items():
        found = matches(segment, *[(p, "") for p in starts])
        out = F.when(found, name) if out is None else out.when(found, name)
    return out.otherwise("other")


def analyze(command: Column) -> Column:
    """array<struct<text, activity, pipe_index, status_masked>>."""
    stripped = F.transform(split_segments(command), lambda s: F.struct(strip_prefix(s["text"]).alias("text"), s["pipe_index"].alias("pipe_index"), s["last_in_pipe"].alias("last")))
    known = F.transform(stripped, lambda s: F.struct(s["text"].alias("text"), activity(s["text"]).alias("activity"), s["pipe_index"].alias("pipe_index"), s["last"].alias("last")))
    return F.transform(known, lambda s: F.struct(s["text"].alias("text"), s["activity"].alias("activity"), s["pipe_index"].alias("pipe_index"), ((s["activity"] != "other") & ~s["last"]).alias("status_masked")))


def output_verdict(output: Column, of: Column) -> Column:
    """passed, failed or none, by the signs of the activity; failure outweighs success."""
    out = F.when(trimmed(output) == "", "none")
    for name in P.FAILED:
        out = out.when((of == name) & matches(output, *P.FAILED[name]), "failed").when((of == name) & matches(output, *P.PASSED[name]), "passed")
    return out.otherwise("none")


def outcome(exec_outcome: Column, exit_code: Column, masked: Column, several: Column, from_output: Column) -> Column:
    """struct<outcome, basis> of one run of an activity."""
    pair = lambda a, b: F.struct(F.lit(a).alias("outcome") if isinstance(a, str) else a.alias("outcome"), F.lit(b).alias("basis"))
    by_status = ~masked & ~several & exit_code.isNotNull()
    return (
        F.when(exec_outcome.isin("denied", "interrupted"), pair("indeterminate", "none"))
        .when(by_status & (exit_code == 0) & (from_output == "failed"), pair("failed", "output-summary"))
        .when(by_status, pair(F.when(exit_code == 0, "passed").otherwise("failed"), "exit-status"))
        .when(from_output != "none", pair(from_output, "output-summary"))
        .otherwise(pair("indeterminate", "none"))
    )


def classify_result(denied: Column, interrupted: Column, background: Column, is_error: Column, text: Column, stdout: Column, stderr: Column) -> Column:
    """struct<exit_code, outcome, stdout, stderr> of one tool result; null streams count as empty."""
    none = F.lit(None).cast("long")
    code = F.regexp_extract(text, flagged(P.EXIT_CODE), 1)
    out, err, empty = F.coalesce(stdout, F.lit("")), F.coalesce(stderr, F.lit("")), F.lit("")
    shown = F.when(out == "", text).otherwise(out)
    row = lambda e, o, a, b: F.struct(e.alias("exit_code"), F.lit(o).alias("outcome"), a.alias("stdout"), b.alias("stderr"))
    return (
        F.when(denied, row(none, "denied", empty, empty))
        .when(interrupted, row(none, "interrupted", out, err))
        .when(background, row(none, "unknown", out, err))
        .when(is_error, row(F.when(code != "", code.try_cast("long")), "failed", shown, err))
        .otherwise(row(F.lit(0).cast("long"), "passed", shown, err))
    )
