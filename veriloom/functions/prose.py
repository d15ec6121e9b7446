"""Claims of execution in prose, as expressions over a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import patterns as P
from veriloom.functions.regex import matches, portable, trimmed


def strip_non_prose(text: Column) -> Column:
    """The text without fenced and indented code and table rows."""
    start = F.expr("named_struct('fenced', false, 'kept', cast(array() as array<string>))")

    def step(acc: Column, line: Column) -> Column:
        fence = matches(line, (r"^\s*(?:```|~~~)", ""))
        out = fence | acc["fenced"] | matches(line, (r"^\s{4,}\S", ""), (r"^\s*\|", ""))
        return F.struct(F.when(fence, ~acc["fenced"]).otherwise(acc["fenced"]).alias("fenced"), F.when(out, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(line))).alias("kept"))

    return F.aggregate(F.split(text, "\n"), start, step, lambda acc: F.array_join(acc["kept"], "\n"))


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, portable(r"(?<=[.!?:])\s+|\n+")), trimmed)
    return F.filter(parts, lambda s: s != "")


def units(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def may_claim(sentence: Column) -> Column:
    no = sentence.endswith("?") | sentence.endswith(":") | matches(sentence, (P.INSTRUCTION, "i")) | matches(sentence, (P.INTENT, "i")) | matches(sentence, (P.NEGATIVE, "i"))
    return ~no & (units(sentence) <= P.LONGEST)


def clipped(sentence: Column) -> Column:
    return F.when(units(sentence) > P.QUOTED, F.concat(F.substring(sentence, 1, P.QUOTED - 3), F.lit("…"))).otherwise(sentence)


def _claim(hits: Column, name: str, own: list[tuple]) -> Column:
    """The claim of one activity from the sentences that match it, or null."""
    first = F.get(hits, F.lit(0))
    place = F.coalesce(*[F.when(matches(first["text"], p), k) for k, _, p in own])
    passes = F.exists(hits, lambda s: matches(s["text"], *[p for _, a, p in own if a == "pass"]))
    claim = F.struct(first["spos"].alias("spos"), place.alias("ppos"), F.lit(name).alias("activity"), F.when(passes, "pass").otherwise("ran").alias("assertion"), clipped(first["text"]).alias("sentence"))
    return F.when(F.size(hits) > 0, claim)


def with_claims(df: DataFrame, text: str, into: str = "claims") -> DataFrame:
    """``df`` with an array<struct<spos, ppos, activity, assertion, sentence>>, one per
    activity, in order of first match.

    The first matching sentence is quoted; a pass asserted by any sentence counts.
    The steps are columns of their own, so each sentence is matched once.
    """
    own = {name: [(k, a, (p, "i")) for k, (n, a, p) in enumerate(P.CLAIMS) if n == name] for name in P.CLAIMABLE}
    all_ = F.transform(sentences(strip_non_prose(F.col(text))), lambda s, i: F.struct(i.alias("spos"), s.alias("text")))
    # sentences about an activity are few, so that is asked before the long lists of words
    every = [p for name in own for _, _, p in own[name]]
    df = df.withColumn("_said", F.filter(all_, lambda s: matches(s["text"], *every) & may_claim(s["text"])))
    hits = {f"_{name}": F.filter("_said", lambda s: matches(s["text"], *[p for _, _, p in own[name]])) for name in own}  # noqa: B023
    df = df.withColumns(hits)
    found = F.array_sort(F.array_compact(F.array(*[_claim(F.col(f"_{name}"), name, own[name]) for name in own])))
    return df.withColumn(into, found).drop("_said", *hits)
