"""The prefix trie against brute force over all prefixes, and the radix trees on their own."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tests.llm.test_llm import DATA
from veriloom.llm import prefixes as P
from veriloom.llm import queries

TURNS = "conv_id long, turn long, role string, text string, node string, base string, depth string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS)


def truncated(c):
    return c - (abs(c) % 5) * (1 if c >= 0 else -1)


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(truncated(c), [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in sorted(whole.items()):
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    ends = lambda k: ",".join(str(c) for c in members[k] if len(whole[c]) == len(k))
    return sorted(((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends(k).encode()).hexdigest()) for k, m in members.items()), key=str)


def found(spark, rows, **how):
    return sorted((tuple(r)[:8] for r in P.prefix_trie(table(spark, rows), **how).collect()), key=str)


def talk(n, seed, ids=None, longest=12):
    """Conversations that share starts, and whole ones."""
    r = random.Random(seed)
    out = []
    for c in ids or range(n):
        start = r.randint(0, 3)
        out += [(c, k, "user" if k % 2 else "assistant", f"t{start}-{k}" if k < r.randint(0, 9) else f"é{r.randint(0, 3)}") for k in range(r.randint(0, longest))]
    return out


@pytest.mark.parametrize(("segment", "budget"), [(P.SEGMENT, P.BUDGET), (1, 50), (3, 1000), (5, 0)])
def test_brute_force(spark, segment, budget):
    """Whole trees, trees dropped often, and conversations cut into short stretches."""
    rows = talk(400, segment)
    assert found(spark, rows, segment=segment, budget=budget) == brute(rows)


def test_one_very_common_conversation(spark):
    rows = [(c, k, "user", f"x{k}") for c in range(0, 3000, 2) for k in range(12)] + talk(300, 8, range(1, 900, 3))
    assert found(spark, rows, budget=20_000) == brute(rows)


def test_long_conversations(spark):
    """One conversation of most rows, one that leaves it after many turns, one that is its start."""
    rows = [(c, k, "user", "a" if k < 700 or c == 1000 else "b") for c, n in ((1000, 3000), (2000, 1500), (3005, 700)) for k in range(n)]
    got = {(r[0], r[1]): r for r in found(spark, rows, segment=64, budget=4000)}
    want = {(r[0], r[1]): r for r in brute_long(rows)}
    assert got == want


def brute_long(rows):
    """As ``brute``, by digests, for conversations too long for tuples of prefixes."""
    own = defaultdict(list)
    for c, _, role, text in rows:
        own[c].append((role, text))
    names, members, kids = {}, defaultdict(list), Counter()
    for c, t in sorted(own.items()):
        key = ()
        members[key].append(c)
        for d, turn in enumerate(t):
            above, key = key, names.setdefault((key, turn), (d + 1, len(names)))
            if key not in members:
                kids[above] += 1
            members[key].append(c)
    up = {k: (a, t) for (a, t), k in names.items()}
    leaves, saved = Counter(), Counter()
    for k in sorted(members, reverse=True):
        leaves[k] += not kids[k]
        if k:
            above, turn = up[k]
            saved[k] += (len(members[k]) - 1) * len(turn[1].encode())
            leaves[above] += leaves[k]
            saved[above] += saved[k]
    ends = lambda k: ",".join(str(c) for c in members[k] if len(own[c]) == (k[0] if k else 0))
    return [(m[0], k[0] if k else 0, members[up[k][0]][0] if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends(k).encode()).hexdigest()) for k, m in members.items()]


def test_odd_rows(spark):
    rows = [(0, None, None, None), (0, 1, "user", "a"), (0, 1, "user", "a"), (0, 1, "bot", "b"), (None, 1, "user", "a"), (5, 2, "", ""), (5, None, "user", None), (7, 1, "user", "x" * 50_000), (-3, 1, "user", "a"), (-9, 1, "user", "a"), (-5, 4, "u", "b"), (-6, 1, "u", "b"), (4, 1, None, "q")]
    rows += talk(0, 4, range(-40, 40), 10)
    assert found(spark, rows, budget=100) == brute(rows)
    assert P.prefix_trie(table(spark, [])).count() == 0
    assert found(spark, [(None, 1, "user", "a")]) == []


def test_trees_keep_every_key():
    """Layouts grow from 4 to 256 children, paths split, and members, ends and prefixes are right."""
    r, tree, keys = random.Random(1), P.Tree(), []
    layouts = set()
    for k in range(4000):
        turns = [bytes([r.choice([r.randint(0, 255), 7])]) + bytes(15) if r.random() < 0.7 else r.randbytes(2) + bytes(14) for _ in range(r.randint(0, 5))]
        keys.append(b"".join(turns))
        tree.insert(keys[-1], k)
    stack = [tree.root]
    while stack:
        node = stack.pop()
        layouts.add((type(node.kids).__name__, getattr(node.kids, "room", 0)))
        assert [x.path[0] for x in node.kids] == sorted(x.path[0] for x in node.kids)
        stack.extend(node.kids)
    assert layouts == {("Sorted", 4), ("Sorted", 16), ("Indexed", 0), ("Full", 0)}
    sizes = {k[at : at + 16]: 1 for k in keys for at in range(0, len(k), 16)}
    emitted = list(tree.emit(P.ROOT, 0, sizes))
    want = Counter(k[:at] for k in keys for at in range(0, len(k) + 1, 16))
    assert sorted(x[3] for x in emitted if x[0] == P.NODE) == sorted(want.values())
    assert sorted(len(x[6]) // 8 for x in emitted if x[0] == P.ENDS) == sorted(Counter(keys).values())


def test_query(spark):
    got = queries.op13_prefixes(spark, DATA)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    want = db.execute(queries.oracle_sql()["op13_prefixes"]).fetchall()
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want
