"""Incremental ingest and verdicts over streams."""

import json
import random

from pyspark.sql import functions as F

from tests.transcripts import lines, ran, said, tool, write
from veriloom.sources.store import Store
from veriloom.streaming.follow import follow
from veriloom.streaming.verdicts import STEP, streamed_verdicts, verdict


def test_follow(spark, tmp_path):
    script = [ran("npm test", "Tests: 4 passed"), said("All 4 tests pass.")]
    store, root = Store(spark, f"file://{tmp_path}/store"), tmp_path / "root"
    write(root, {"a": script})
    run = lambda: follow(spark, f"file://{root}", store, f"file://{tmp_path}/cp", availableNow=True).awaitTermination(120)
    run()
    assert store.events().count() == 3
    write(root, {"b": script})
    run()
    run()
    assert store.events().count() == 6 and store.verify()["ok"]
    write(root, {"a": [*script, ran("ruff check src", "Found 1 error.", 1), said("Lint clean, all green.")]})
    run()
    assert store.events().count() == 9 and store.verify()["ok"]  # a known file that has grown


def test_verdicts_change(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()

    def feed(n, *rows):
        (src / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("session_id", "seq", "kind", "activity", "assertion", "outcome"), r, strict=True))) for r in rows))

    def run():
        steps = spark.readStream.schema(STEP).json(str(src))
        q = streamed_verdicts(steps).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)

    feed(1, ("s", 1, "exec", None, None, "passed"), ("s", 2, "claim", "test", "pass", None), ("t", 1, "exec", "lint", None, "failed"), ("t", 2, "claim", "lint", "pass", None))
    run()
    feed(2, ("s", 5, "exec", "test", None, "passed"), ("s", 6, "claim", "test", "pass", None))
    run()
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == [("s", 2, "test", "UNKNOWN"), ("s", 2, "test", "UNSUPPORTED"), ("s", 6, "test", "VERIFIED"), ("t", 2, "lint", "CONTRADICTED")]


def test_runs_of_one_place():
    """Runs of one step count in the order of ord, and at one place the worst, however they come."""
    claim = {"seq": 4, "activity": "test", "assertion": "pass"}
    runs = [(3, "test", "failed", 0), (3, "test", "passed", 1)]
    assert {verdict(claim, rs, 1, False) for rs in (runs, runs[::-1])} == {"VERIFIED"}
    runs = [(3, "test", "failed", 0), (3, "test", "passed", 0), (3, "test", "indeterminate", 0)]
    assert {verdict(claim, rs, 1, False) for rs in (runs, runs[::-1])} == {"CONTRADICTED"}


LONG = [
    said("All tests pass."),
    tool("mcp__py_exec", code="1"),
    ran("npm test", "Tests: 4 passed, 4 total"),
    said("All 4 tests pass. The build compiles cleanly."),
    {"raw": "no json"},
    {"raw": ""},
    ran("ruff check src | tail -1", "Found 2 errors."),
    said("Lint clean, and the suite passes."),
    ran("tsc --noEmit && npm run build", "Found 0 errors"),
    ran("pytest -q", "1 failed", 1),
    said("I ran the tests. Typecheck passes. Lint clean."),
    ran("pytest -q", "x", 0, denied=True),
    said("All tests pass."),
    ran("pytest -q | tail -1", ""),
    said("The tests pass."),
]


def late(script, session):
    """The transcript's lines, its results moved behind what is said after them."""
    own = lines(script, session)
    for k in range(len(own) - 1):
        if '"tool_result"' in own[k] and '"type": "text"' in own[k + 1]:
            own[k], own[k + 1] = own[k + 1], own[k]
    return own


def test_verdicts_of_growing_files(spark, tmp_path):
    """Raw lines, however they are cut into batches, end in the verdicts and reasons of a batch; a restart adds nothing."""
    from veriloom.plans import reconcile as R
    from veriloom.sources import transcripts as T
    from veriloom.streaming import transcripts as S

    for k, v in S.STATE_STORE.items():
        spark.conf.set(k, v)
    r, root = random.Random(7), tmp_path / "root"
    (root / "p").mkdir(parents=True)
    scripts = {"a": LONG, "b": LONG[:1], "c": [said("All tests pass."), ran("git status", "clean"), said("Lint clean.")], "d": LONG[3:9], "e": [ran("x", denied=True), said("All tests pass.")]}
    texts = {f"{n}.jsonl": ("\r\n" if n == "a" else "\n").join(late(s, n) if n in "ad" else lines(s, n)) + "\n" for n, s in scripts.items()}

    def run():
        q = S.verdicts(S.growing(spark, f"file://{root}", settled="100000", range="700")).writeStream.outputMode("append").foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(300)

    done = {n: 0 for n in texts}
    while any(done[n] < len(t) for n, t in texts.items()):
        for n, text in texts.items():
            done[n] = min(len(text), done[n] + r.choice([500, 1500, 6000]))
            (root / "p" / n).write_bytes(text.encode()[: done[n]])
        run()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(rows)
    last = {}
    for x in sorted(rows, key=lambda x: x["batch"]):
        last[x["file"].rsplit("/", 1)[1], x["claim"]] = (x["seq"], x["activity"], x["assertion"], x["sentence"], x["verdict"], x["reason"])
    scanned = T.scan(spark, T.locate(spark, f"file://{root}"))
    t = T.normalize(scanned)
    e = R.from_transcripts(t, t.sessions)
    want = sorted((f["session_id"].rsplit("/", 1)[1], f["seq"], f["activity"], f["assertion"], f["sentence"], f["verdict"], f["reason"]) for f in e.findings.collect())
    assert sorted((k[0], *v) for k, v in last.items()) == want
    assert {w[5] for w in want} == {"CONTRADICTED", "UNSUPPORTED", "UNKNOWN", "VERIFIED"} and len(rows) > len(want)
