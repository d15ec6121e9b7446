"""Regular expressions with one meaning on the JVM and in Python.

The tables of patterns are written for ECMAScript's rules: word boundaries, digits
and word characters are ASCII, white space is Unicode's, ``.`` is all but LF, CR, LS
and PS, ``^`` in line mode follows these, and ``$`` is the end of the text.  ``java`` and ``python``
rewrite a pattern so that Spark's and Python's engines keep to these rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space: code points, and ranges of them.
SPACE = ["\t", "\n", "\v", "\f", "\r", " ", "\u00a0", "\u1680", ("\u2000", "\u200a"), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\ufeff"]
#: The idiom for any character; a negated class can't stand in a class in Python.
ANY = r"[\s\S]"
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _spaces() -> str:
    code = lambda c: f"\\u{ord(c):04x}"
    return "".join(code(x) if isinstance(x, str) else f"{code(x[0])}-{code(x[1])}" for x in SPACE)


def portable(pattern: str, lines: bool = False) -> str:
    """``pattern`` for either engine; ``lines`` is the m flag."""
    spaces, out, at, within = _spaces(), [], 0, False
    while at < len(pattern):
        if pattern.startswith(ANY, at):
            out.append("(?s:.)")
            at += len(ANY)
            continue
        two = pattern[at : at + 2]
        if two[0] == "\\" and len(two) == 2:
            out.append({"\\s": spaces if within else f"[{spaces}]", "\\S": f"[^{spaces}]", "\\b": "\\x08" if within else EDGE, "\\d": "0-9" if within else "[0-9]", "\\w": "A-Za-z0-9_" if within else "[A-Za-z0-9_]"}.get(two, two))
            at += 2
            continue
        c = two[0]
        if within:
            within = c != "]"
        elif c == "[":
            within = True
        elif c == ".":
            c = "[^\\n\\r\\u2028\\u2029]"
        elif c == "^" and lines:
            c = "(?<![^\\n\\r\\u2028\\u2029])"
        elif c == "$":
            c = "(?!(?:.|[\\r\\n\\u0085\\u2028\\u2029]))"
        out.append(c)
        at += 1
    return "".join(out)


def flagged(pattern: str, flags: str = "") -> str:
    return ("(?i)" if "i" in flags else "") + portable(pattern, "m" in flags)


def matches(column: Column, *patterns: tuple[str, str]) -> Column:
    """True where any of the (pattern, flags) is found in the text."""
    return F.rlike(column, F.lit("|".join(("(?i:" if "i" in f else "(?:") + portable(p, "m" in f) + ")" for p, f in patterns)))


def trimmed(column: Column) -> Column:
    """Without white space at both ends; a regular expression would try each blank of the text."""
    blanks = (c if isinstance(c, str) else "".join(map(chr, range(ord(c[0]), ord(c[1]) + 1))) for c in SPACE)
    return F.btrim(column, F.lit("".join(blanks)))
