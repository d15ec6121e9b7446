"""Escapes and small text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def html_escape(text: Column) -> Column:
    return replaced(text, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def json_script(json: Column) -> Column:
    """JSON that can stand inside a script element."""
    return replaced(json, ("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"))


def workflow_property(text: Column) -> Column:
    return replaced(text, ("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), (":", "%3A"), (",", "%2C"))


def workflow_data(text: Column) -> Column:
    return replaced(text, ("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), ("::", "%3A%3A"))


def encode_path(path: Column) -> Column:
    return F.regexp_replace(path, "[^a-zA-Z0-9]", "-")


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\\x1b\\[[0-9;]*[a-zA-Z]", "")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits: counts of code points over the length in UTF-16 units."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    n = F.octet_length(F.encode(text, "UTF-16BE")) / 2
    shares = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(text == "", 0.0).otherwise(F.aggregate(shares, F.lit(0.0), lambda h, p: h - p * F.log2(p)))
