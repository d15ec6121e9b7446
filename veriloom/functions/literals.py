"""Which of many patterns a text may match, by one pass of an Aho-Corasick automaton.

From each pattern's own syntax tree follows a set of literals of which any match holds
one, whatever else it holds.  The automaton looks for all of them at once, in lower
case; a text then meets only the patterns of the literals that it has.
"""

from __future__ import annotations

from re import _parser  # the parser behind re.compile

#: Literals that a set may have, and alternatives while it is made.
WIDEST = 64


def _exact(op: tuple) -> set[str] | None:
    """All texts that a part of a pattern matches, if these are few; a condition on what stands around matches no text of its own."""
    kind, arg = str(op[0]), op[1]
    if kind == "LITERAL":
        return {chr(arg).lower()}
    if kind in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}
    if kind == "IN":
        if any(str(k) not in ("LITERAL",) for k, _ in arg):
            return None
        return {chr(c).lower() for _, c in arg} if len(arg) <= 8 else None
    if kind == "SUBPATTERN":
        return _all(arg[-1])
    if kind == "BRANCH":
        parts = [_all(b) for b in arg[1]]
        return None if None in parts else _few(set().union(*parts))
    if kind in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 1:
        inner = _all(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _few(texts: set[str]) -> set[str] | None:
    return texts if len(texts) <= WIDEST else None


def _all(parts) -> set[str] | None:
    out: set[str] | None = {""}
    for op in parts:
        own = _exact(op)
        out = None if own is None or out is None else _few({a + b for a in out for b in own})
        if out is None:
            return None
    return out


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The set whose shortest literal is longer."""
    weigh = lambda s: (min(map(len, s)), -len(s)) if s else (0, 0)
    return a if weigh(a) >= weigh(b) else b


def _needed(parts) -> set[str] | None:
    best, run = None, {""}
    for op in parts:
        kind, arg, own = str(op[0]), op[1], _exact(op)
        longer = None if own is None else _few({a + b for a in run for b in own})
        if longer is not None:
            run = longer
            continue
        best, run = _better(best, run), own or {""}
        inner = None
        if kind == "SUBPATTERN":
            inner = _needed(arg[-1])
        elif kind == "BRANCH":
            sets = [_needed(b) for b in arg[1]]
            inner = None if None in sets else _few(set().union(*sets))
        elif kind in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            inner = _needed(arg[2])
        best = _better(best, inner)
    best = _better(best, run)
    return None if not best or "" in best else best


def needed(pattern: str, flags: int = 0) -> set[str] | None:
    """Lower-case literals of which each match of the pattern holds one; None if there are none."""
    return _needed(_parser.parse(pattern, flags))


class Prefilter:
    """Tells, as a set of bits, which patterns a text may match."""

    def __init__(self, sets: list[set[str] | None]) -> None:
        import ahocorasick

        self.always, words = 0, {}
        for k, literals in enumerate(sets):
            if literals is None:
                self.always |= 1 << k
            for word in literals or ():
                words[word] = words.get(word, 0) | 1 << k
        #: Single characters are frequent, and looked for one by one.
        self.single = {w: bits for w, bits in words.items() if len(w) == 1}
        self.found = ahocorasick.Automaton()
        for word, bits in words.items():
            if len(word) > 1:
                self.found.add_word(word, bits)
        self.found.make_automaton()
        self.all = (1 << len(sets)) - 1

    def __call__(self, text: str) -> int:
        bits, low = self.always, text.lower()
        for word, own in self.single.items():
            if word in low:
                bits |= own
        if len(self.found):
            for _, own in self.found.iter(low):
                bits |= own
                if bits == self.all:
                    break
        return bits
