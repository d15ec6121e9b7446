"""The driver's contract, and the functions behind the queries by example."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veriloom.functions import prose, shell
from veriloom.operators.labels import unique_labels


def test_names():
    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and len(found) >= 30


def test_entry(spark):
    got = entry.entry(spark)
    assert got.count() > 0 and "verdict" in got.columns


COMMANDS = {
    "npm test && echo ok | tee x": [("npm test", 0, True), ("echo ok", 0, False), ("tee x", 1, True)],
    "cargo test 2>&1 | tail -2; a &> b & c": [("cargo test 2>&1", 0, False), ("tail -2", 1, True), ("a &> b", 0, True), ("c", 0, True)],
    "grep \"a|b\\\"c;\" x || | y": [("grep \"a|b\\\"c;\" x", 0, True), ("y", 1, True)],
    "echo 'open | never closed": [("echo 'open | never closed", 0, True)],
    "a |& b\n\nc": [("a", 0, False), ("b", 1, True), ("c", 0, True)],
    "": [],
}


@pytest.mark.parametrize("command", COMMANDS)
def test_segments(spark, command):
    df = spark.createDataFrame([(command,)], "c string")
    got = df.select(shell.split_segments(F.col("c")).alias("s")).first()["s"]
    assert [tuple(x) for x in got] == COMMANDS[command]


PROSE = {
    "All tests pass.": [("test", "pass", "All tests pass.")],
    "I ran the tests. They are green. The test suite passes.": [("test", "pass", "I ran the tests.")],
    "We have just run the specs.": [("test", "ran", "We have just run the specs.")],
    "Now verify the build passes": [],
    "Do the tests pass?": [],
    "```\nAll tests pass.\n```\nThe build compiles cleanly.": [("build", "pass", "The build compiles cleanly.")],
    "    All tests pass.\n| tests pass |": [],
    "2 tests failed, 3 tests pass.": [],
    "Lint and mypy are clean, all tests green.": [("test", "pass", "Lint and mypy are clean, all tests green."), ("typecheck", "pass", "Lint and mypy are clean, all tests green."), ("lint", "pass", "Lint and mypy are clean, all tests green.")],
    "The étests pass " + "x" * 300: [],
}


def test_claims(spark):
    df = spark.createDataFrame([(t,) for t in PROSE], "t string")
    got = {r["t"]: [(c["activity"], c["assertion"], c["sentence"]) for c in r["c"]] for r in prose.with_claims(df, "t", "c").collect()}
    long = "The étests pass " + "x" * 300
    assert got.pop(long) == [("test", "pass", long[:217] + "…")]  # a word boundary follows é, as it is no ASCII letter
    assert got == {k: v for k, v in PROSE.items() if k != long}


@pytest.mark.parametrize(
    ("paths", "labels"),
    [
        (["/home/me/alpha", "/home/me/beta"], ["alpha", "beta"]),
        (["/work/client/app", "/work/server/app"], ["client/app", "server/app"]),
        (["/a/x/app", "/b/x/app", "/c/y/app"], ["a/x/app", "b/x/app", "y/app"]),
        (["", "/"], ["unknown", "/"]),
    ],
)
def test_labels(spark, paths, labels):
    got = {r["p"]: r["label"] for r in unique_labels(spark.createDataFrame([(p,) for p in paths], "p string"), "p").collect()}
    assert [got[p] for p in paths] == labels
