"""The decision table, end to end from transcripts."""

import pytest
from pyspark.sql import functions as F

from tests.transcripts import ran, said, tool, write
from veriloom.plans import reconcile as R
from veriloom.sources import transcripts as T

ALL_PASS = "All 4 tests pass."
CASES = {
    "unsupported": ([ran("git status --short"), ran("ls src"), said("All 42 tests pass.")], "UNSUPPORTED", "2 shell invocations"),
    "contradicted": ([ran("npm test", "Tests: 3 failed, 1 passed", 1), said("All tests pass.")], "CONTRADICTED", "(exit 1)"),
    "verified": ([ran("npm test", "Tests: 4 passed, 4 total"), said(ALL_PASS)], "VERIFIED", "exit status 0"),
    "superseded": ([ran("npm test", "Tests: 1 failed", 1), ran("npm test", "Tests: 4 passed"), said("The suite passes now.")], "VERIFIED", "exit status 0"),
    "masked": ([ran("cargo test --workspace 2>&1 | tail -20", "test result: FAILED. 1 passed"), said(ALL_PASS)], "CONTRADICTED", "failed"),
    "abstain": ([ran("pytest -q 2>&1 | tail -1"), said("The tests pass.")], "UNKNOWN", "not recoverable"),
    "denied": ([ran("npm test", denied=True), said(ALL_PASS)], "UNKNOWN", "denied"),
    "opaque": ([ran("git diff"), tool("mcp__sandbox__preview_eval", code="x"), said(ALL_PASS)], "UNKNOWN", "cannot inspect"),
    "early": ([said("The tests pass."), ran("npm test", "ok")], "UNKNOWN", "only after this statement"),
    "swallowed": ([ran("npm test || true", "Tests: 2 failed, 0 passed"), said(ALL_PASS)], "CONTRADICTED", "failed"),
    "no_shell": ([said(ALL_PASS)], "UNKNOWN", "evidence may be incomplete"),
    "ran": ([ran("pytest -q 2>&1 | tail -1"), said("I ran the tests.")], "VERIFIED", "outcome not determinable"),
    "background": ([ran("pytest -q", "started", backgroundTaskId="b1"), said("The tests pass.")], "UNKNOWN", "not recoverable"),
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    root = write(tmp_path_factory.mktemp("root"), {k: v[0] for k, v in CASES.items()})
    s = T.scan(spark, T.locate(spark, str(root)))
    t = T.normalize(s, T.records(s.lines).persist())
    e = R.from_transcripts(t, T.in_scope(t, "/work"))
    names = e.sessions.select("session_id", "id")
    rows = e.findings.join(names, "session_id").collect()
    return {r["id"]: r for r in rows}, {r["id"]: r for r in e.reports.collect()}


@pytest.mark.parametrize("case", CASES)
def test_verdict(found, case):
    _, verdict, reason = CASES[case]
    row = found[0][case]
    assert (row["activity"], row["verdict"]) == ("test", verdict)
    assert reason in row["reason"]


def test_badges(found):
    reports = found[1]
    assert reports["verified"]["summary"] == "tests claimed and observed"
    assert reports["contradicted"]["risk"] == "high"
    assert reports["early"]["risk"] == "medium"
    assert reports["verified"]["observed_activities"] == ["test"]
    assert reports["verified"]["input_tokens"] == 100


def _one(spark, tmp_path, scripts):
    root = write(tmp_path, scripts)
    s = T.scan(spark, T.locate(spark, str(root)))
    t = T.normalize(s, T.records(s.lines).persist())
    return R.from_transcripts(t, T.in_scope(t))


def test_several_claims(spark, tmp_path):
    script = [ran("npm test", "Tests: 3 failed, 1 passed", 1), said("All tests pass."), ran("npm run build 2>&1 | tail -5", "done"), said("The build compiles cleanly.")]
    e = _one(spark, tmp_path, {"a": script, "b": [ran("tsc --noEmit"), said("Typecheck passes. All tests pass.")], "c": [ran("ruff check src", "Found 1 error.", 1), said("Lint clean, all green.")]})
    reports = {r["id"]: r for r in e.reports.collect()}
    assert (reports["a"]["verdict"], reports["a"]["summary"]) == ("CONTRADICTED", "tests claimed passing, observed failing (1 of 2 claims)")
    got = {(r["activity"], r["verdict"]) for r in e.findings.where(F.col("session_id").contains("/b.jsonl")).collect()}
    assert got == {("typecheck", "VERIFIED"), ("test", "UNSUPPORTED")}
    assert reports["c"]["verdict"] == "CONTRADICTED" and reports["c"]["claims"] == 1


def test_branches_of_several_folders(spark, tmp_path):
    talk = [said("Hello.")]
    e = _one(spark, tmp_path, {"a": (talk, "/w/one", "main"), "b": (talk, "/w/one", "main"), "c": (talk, "/w/one", "feature"), "d": (talk, "/w/two", "\x1b[32mmain\x1b[0m")})
    rows = {r["label"]: r["sessions"] for r in R.branch_rows(e.reports).collect()}
    assert rows == {"one/main": ["a", "b"], "one/feature": ["c"], "two/main": ["d"]}


def test_odd_lines(spark, tmp_path):
    script = [{"raw": ""}, {"raw": "{broken"}, {"raw": '{"a": 1} x'}, {"raw": "null"}, {"raw": '{"type":"assistant","message":"text"}'}, tool("Write", file_path="/a"), tool("NotebookEdit", notebook_path="/n"), said("Lint is clean.")]
    e = _one(spark, tmp_path, {"odd": script})
    row = e.reports.first()
    assert row["unparsed_lines"] == 2
    assert row["edits"] == 2
    assert row["opaque_executors"] == ["NotebookEdit"]
    assert e.findings.first()["seq"] == 8


def test_discovery(spark, tmp_path):
    write(tmp_path, {"a": ([said("x")], "/work/my.app", "m"), "b": ([said("x")], "/work/my.app/sub", "m"), "c": ([said("x")], "/work/other", "m")})
    names = lambda **k: [f.rsplit("/", 1)[1] for f in T.locate(spark, str(tmp_path), **k)]
    assert sorted(names(repo="/work/my.app")) == ["a.jsonl", "b.jsonl"]
    assert len(names(repo="/none")) == 3
    assert len(names(limit=2)) == 2
