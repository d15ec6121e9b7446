"""Redaction of secrets, as an Arrow UDF over text.

The rules apply one after the other, each to what the one before it left, and the
value rules look at a value's shape, so this is a sequential text function; the
UDF sees batches, and the texts are bounded by the outputs of single commands.  A text
meets only the rules whose literals it has (see ``literals``), most texts none; once
a mark has been set, which is text too, all rules that follow are tried.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.functions import patterns as P
from veriloom.functions.literals import Prefilter, needed
from veriloom.functions.regex import EDGE, portable

HELD_BYTES, HEAD_SHARE = 8192, 0.4
RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("counts", T.MapType(T.StringType(), T.LongType())), T.StructField("truncated", T.BooleanType())])


def _compiled(pattern: str, flags: str = "") -> re.Pattern:
    # with re.ASCII, Python's own word boundary has the meaning wanted here
    return re.compile(portable(pattern).replace(EDGE, r"\b"), re.ASCII | (re.IGNORECASE if "i" in flags else 0))


RULES = [(kind, _compiled(pattern, flags), group) for kind, pattern, flags, group in P.SECRETS]
SENSITIVE, ASSIGNED = _compiled(P.SENSITIVE_KEY, "i"), _compiled(P.ASSIGNED_VALUE)
NO_SECRET, HASH_KEY, HASH_VALUE, PATH_VALUE = _compiled(P.NO_SECRET, "i"), _compiled(P.HASH_KEY, "i"), _compiled(P.HASH_VALUE, "i"), _compiled(P.PATH_VALUE)


MAY = Prefilter([needed(rule.pattern, rule.flags) for rule in (*[r for _, r, _ in RULES], SENSITIVE, ASSIGNED)])


def entropy(text: str) -> float:
    """Bits of the characters' shares, which are over the length in UTF-16 units."""
    n = len(text.encode("utf-16-le", "surrogatepass")) // 2
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values()) if n else 0.0


def _plain_value(key: str, value: str) -> bool:
    """Hashes and paths, which are long and mixed but no secrets."""
    return bool(HASH_KEY.search(key) or HASH_VALUE.search(value) or PATH_VALUE.search(value))


def redact(text: str) -> tuple[str, Counter]:
    counts: Counter = Counter()

    def mark(whole: str, secret: str | None, kind: str) -> str:
        if not secret:
            return whole
        counts[kind] += 1
        return whole.replace(secret, f"«redacted:{kind}»", 1)

    def assigned(m: re.Match) -> tuple[str, str | None]:
        value = next((x for x in m.groups()[1:] if x is not None), None)
        return m[1], None if value is None or value.startswith("«redacted:") else value

    def by_key(m: re.Match) -> str:
        _, value = assigned(m)
        return m[0] if value is None or NO_SECRET.search(value) else mark(m[0], value, "sensitive-key")

    def by_entropy(m: re.Match) -> str:
        key, value = assigned(m)
        keep = value is None or _plain_value(key, value) or entropy(value) < P.ENTROPY
        return m[0] if keep else mark(m[0], value, "high-entropy")

    may = MAY(text)
    steps = [(rule, lambda m, kind=kind, group=group: mark(m[0], m[group], kind)) for kind, rule, group in RULES] if may else []
    for k, (rule, step) in enumerate([*steps, (SENSITIVE, by_key), (ASSIGNED, by_entropy)] if may else []):
        if counts or may >> k & 1:
            text = rule.sub(step, text)
    return text, counts


def shortened(text: str, most: int = HELD_BYTES) -> tuple[str, bool]:
    """Head and tail of a text of more than ``most`` UTF-8 bytes, with what is left out named."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= most:
        return text, False
    head = math.floor(most * HEAD_SHARE)
    show = lambda b: b.decode("utf-8", "replace")
    return f"{show(raw[:head])}\n…[{len(raw) - most} bytes elided]…\n{show(raw[len(raw) - (most - head) :])}", True


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["text", "counts", "truncated"])


@F.pandas_udf(RESULT)
def redacted(text: pd.Series) -> pd.DataFrame:
    """struct<text, counts, truncated>; null text stays null, with no counts."""
    return _frame([(None, {}, False) if x is None else (*(lambda r: (r[0], dict(r[1])))(redact(x)), False) for x in text])


@F.pandas_udf(RESULT)
def redacted_short(text: pd.Series) -> pd.DataFrame:
    """Redacted, then cut to HELD_BYTES, so that no secret outlives the cut in part."""
    rows = []
    for x in text:
        if x is None:
            rows.append((None, {}, False))
            continue
        out, counts = redact(x)
        short, cut = shortened(out)
        rows.append((short, dict(counts), cut))
    return _frame(rows)


def merged(df, *maps: str):
    """kind, n: redaction counts summed over the given map columns and all rows."""
    each = None
    for name in maps:
        part = df.select(F.explode(name).alias("kind", "n"))
        each = part if each is None else each.unionByName(part)
    return each.groupBy("kind").agg(F.sum("n").alias("n"))
