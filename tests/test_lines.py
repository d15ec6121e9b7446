"""The line source: breaks at any place, bad files, and files that grow."""

import io
import json
import os
import random
import re

import pytest

from tests.transcripts import ran, said, write
from veriloom.plans import reconcile as R
from veriloom.sources import lines as L
from veriloom.sources import transcripts as T


def brute(text):
    """(line number, line) of all lines; what follows the last break is none if it is empty."""
    parts = re.split(r"\r\n|\n|\r", text)
    return list(enumerate(parts[:-1] if parts[-1] == "" else parts, 1))


@pytest.mark.parametrize("seed", range(6))
def test_ranges_hold_each_line_once(seed, monkeypatch):
    r = random.Random(seed)
    monkeypatch.setattr(L, "CHUNK", r.choice([1, 2, 3, 7, 1000]))
    for _ in range(150):
        text = "".join(r.choice(["a", "bc", "\n", "\r", "\r\n", "é", ""]) for _ in range(r.randint(0, 25)))
        raw, size = text.encode(), r.randint(1, 9)
        found, base = [], 0
        for a in range(0, max(len(raw), 1), size):
            own = [x.decode() for x in L.lines_between(io.BytesIO(raw), a, min(a + size, len(raw)))]
            found += [(base + k, x) for k, x in enumerate(own, 1)]
            base += len(own)
        assert found == brute(text)


def test_numbers_across_ranges(spark, tmp_path):
    """One file over many tasks keeps its physical line numbers."""
    r = random.Random(4)
    texts = {f"f{k}.jsonl": "".join("x" * r.randint(0, 90) + r.choice(["\n", "\r\n", "\r", "\n\n"]) for _ in range(r.choice([0, 3, 400]))) for k in range(9)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    files = [(f"file://{tmp_path}/{n}", len(t)) for n, t in texts.items()]
    lines, errors = L.numbered(spark, files, 500)
    got = {}
    for x in lines.collect():
        got.setdefault(x["file"].rsplit("/", 1)[1], []).append((x["seq"], x["line"]))
    assert {n: sorted(g) for n, g in got.items()} == {n: brute(t) for n, t in texts.items() if brute(t)}
    assert errors.count() == 0 and lines.rdd.getNumPartitions() >= 1


def test_tasks_share_a_large_file():
    assert len(L.packed(L.cut([("f", 100 << 20)], 8 << 20), 8 << 20)) == 13
    small = L.packed(L.cut([(f"f{k}", 10) for k in range(100)], 8 << 20), 8 << 20)
    assert len(small) == 13 and sum(len(p.parts) for p in small) == 100


SCRIPT = [ran("npm test", "Tests: 4 passed"), said("All 4 tests pass."), ran("ruff check src", "Found 1 error.", 1), said("Lint clean, all green.")]


def test_bad_files_give_what_was_read(spark, tmp_path):
    """Unreadable, cut short, gone, and half a line: each session has what came before, and no other suffers."""
    root = write(tmp_path / "root", {n: SCRIPT for n in ("good", "short", "gone", "half")})
    folder = root / "-work-alpha"
    (folder / "closed.jsonl").mkdir()
    (folder / "binary.jsonl").write_bytes(b"\xff\xfe\x00 no json\n" + (folder / "good.jsonl").read_bytes())
    files = T.locate(spark, f"file://{root}")
    listed = T.stat(spark, files)
    sizes = {r["file"].rsplit("/", 1)[1]: r["file_size"] for r in listed.collect()}
    (folder / "short.jsonl").write_bytes((folder / "short.jsonl").read_bytes()[:900])
    (folder / "gone.jsonl").unlink()
    (folder / "half.jsonl").write_bytes((folder / "half.jsonl").read_bytes()[:-40])
    names = [(f"file://{folder}/{n}", s) for n, s in sizes.items() if n != "half.jsonl"] + [(f"file://{folder}/half.jsonl", sizes["half.jsonl"] - 40), (f"file://{folder}/closed.jsonl", 10)]
    lines, errors = L.numbered(spark, names, 400)
    scanned = T.Scanned(spark.createDataFrame([(f, n, None) for f, n in names], T.FILES), lines, errors)
    got = {r["file"].rsplit("/", 1)[1]: r["error"] for r in errors.distinct().collect()}
    assert set(got) == {"short.jsonl", "gone.jsonl", "closed.jsonl"} and "cut short" in got["short.jsonl"]
    own = {r["file"].rsplit("/", 1)[1]: r for r in T.normalize(scanned).sessions.collect()}
    assert len(own) == 6 and own["good.jsonl"]["session_id"] == own["short.jsonl"].session_id.replace("short", "good") == "good"
    assert own["gone.jsonl"]["session_id"].endswith("gone.jsonl") and own["closed.jsonl"]["models"] == []
    assert {n: own[n]["unparsed_lines"] for n in own} == {"good.jsonl": 0, "short.jsonl": 1, "gone.jsonl": 0, "closed.jsonl": 0, "half.jsonl": 1, "binary.jsonl": 1}
    told = [(r["file"].rsplit("/", 1)[1], r["seq"], r["problem"]) for r in T.problems(scanned).collect()]
    assert ("binary.jsonl", 1, "no JSON") in told and ("half.jsonl", 6, "no JSON") in told and len({t[0] for t in told}) == 5


def test_scan_of_vanished_files(spark, tmp_path):
    root = write(tmp_path / "root", {"a": SCRIPT, "b": SCRIPT})
    files = T.locate(spark, f"file://{root}")
    (root / "-work-alpha/b.jsonl").unlink()
    scanned = T.scan(spark, [*files, f"file://{tmp_path}/nowhere/c.jsonl"])
    assert sorted(r["error"] for r in scanned.errors.collect()) == ["gone", "gone"]
    own = R.from_transcripts(t := T.normalize(scanned), T.in_scope(t))
    assert [r["id"] for r in own.reports.collect()] == ["a"] and t.sessions.count() == 3


def test_strict_json(spark):
    """Repeated keys count once, the last; NaN, trailing text and bare words are no JSON."""
    rows = ['{"sessionId": "a", "sessionId": "b"}', '{"a": NaN}', '{"a": 1} x', "{'a': 1}", "[1]", " {\"a\": 1}]", '"\\ud800"', "1e400", ""]
    lines = spark.createDataFrame([("f", k, x) for k, x in enumerate(rows, 1)], "file string, seq long, line string")
    got = {r["seq"]: r["v"] for r in T.records(lines).selectExpr("seq", "to_json(v) as v").collect()}
    assert json.loads(got[1]) == {"sessionId": "b"} and got[5] == "[1]"
    assert [k for k, v in sorted(got.items()) if v is None and k <= 6] == [2, 3, 4, 6] and 9 not in got


def test_growth_reader(tmp_path):
    """Only whole lines, from each file's old end; a file that became shorter from its start; settled ends."""
    folder = tmp_path / "p"
    folder.mkdir()
    (folder / "a.jsonl").write_bytes(b"1\n2\npart")
    (folder / "skip.txt").write_bytes(b"x\n")
    (tmp_path / "top.jsonl").write_bytes(b"x\n")
    reader = L.GrowthReader({"path": f"file://{tmp_path}", "settled": "1000"})
    name = f"file://{folder}/a.jsonl"
    read = lambda a, b: [(r["file"], r["n"], r["line"]) for p in reader.partitions(a, b) for batch in reader.read(p) for r in batch.to_pylist()]
    first = reader.latestOffset()
    assert first == {name: 4} and read({}, first) == [(name, 1, "1"), (name, 2, "2")]
    with open(folder / "a.jsonl", "ab") as f:
        f.write(b"ial\r\n\r\nend")
    second = reader.latestOffset()
    assert second == {name: 15} and read(first, second) == [(name, 1, "partial"), (name, 2, "")]
    assert read(second, second) == []
    os.utime(folder / "a.jsonl", (1, 1))
    third = reader.latestOffset()
    assert read(second, third) == [(name, 1, "end")]
    (folder / "a.jsonl").write_bytes(b"new\n")
    assert read(third, reader.latestOffset()) == [(name, 1, "new")]
    assert L.GrowthReader({"path": f"{tmp_path}/none"}).latestOffset() == {}
