"""JSON where Spark's own functions are laxer, or write other bytes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _refused(word: str):
    raise ValueError(word)


def _checked(text: str | None, again: bool) -> str | None:
    try:
        value = json.loads(text or "", parse_constant=_refused)
    except (ValueError, RecursionError):
        return None
    return json.dumps(value) if again else ""


@F.pandas_udf(T.StringType())
def checked_json(text: pd.Series, again: pd.Series) -> pd.Series:
    """Null unless the text is strict JSON: no trailing text, no NaN; if ``again``, it is
    written once more, of repeated keys only the last, else the result is empty."""
    return pd.Series([_checked(x, bool(a)) for x, a in zip(text, again, strict=True)], dtype=object)


def parsed(text: Column) -> tuple[Column, Column, Column]:
    """Three steps, each a column over the one before it (named _v, _checked): a variant, the
    check of the text, and the variant of strict JSON, null for other text."""
    checked = checked_json(text, F.col("_v").isNull())
    return F.try_parse_json(text), checked, F.when(F.col("_checked") == "", F.col("_v")).when(F.col("_checked").isNotNull(), F.try_parse_json("_checked"))


def canonical(value) -> str:
    """JSON with sorted keys and no blanks, the bytes that are hashed."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else canonical(json.loads(x)))


def typed(value: Column, path: str, kind: str) -> Column:
    """A variant's field if it has this type: STRING, BOOLEAN or a number (BIGINT)."""
    found = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    if kind == "NUMBER":
        return F.when(found.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, path, "double"))
    return F.when(found == kind, F.try_variant_get(value, path, {"STRING": "string", "BOOLEAN": "boolean"}[kind]))
