"""Verdicts over a stream of executions and claims, with state per session.

Verdicts are not monotone: a claim without evidence becomes undeterminable when a
run comes later.  So the query is in update mode, and a row is emitted whenever a
claim's verdict is new or has changed.  The state of a session is its runs, its
claims with their last verdict, and whether anything ran; it goes after ``idle_ms`` of
no input.  Rows may come in any order within and between batches: runs are ordered by
``seq``, then by ``ord``, their place in the step; of runs at one place the worst counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STEP = "session_id string, seq long, kind string, activity string, assertion string, outcome string, ord long"
OUT = "session_id string, seq long, activity string, verdict string"


def verdict(claim: dict, runs: list, execs: int, hidden: bool) -> str:
    """``hidden``: a command was denied, or a tool ran code that can't be seen."""
    own = [r for r in runs if r[1] == claim["activity"]]
    before = [r for r in own if r[0] <= claim["seq"]]
    if not before:
        return "UNKNOWN" if own or not execs or hidden else "UNSUPPORTED"
    last = max(before, key=lambda r: (r[0], r[3], r[2] == "failed", r[2] != "passed"))[2]
    if last == "failed":
        return "CONTRADICTED"
    return "VERIFIED" if last == "passed" or claim["assertion"] == "ran" else "UNKNOWN"


def _judge(idle_ms: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        runs, claims, execs, hidden = json.loads(state.get[0]) if state.exists else ([], [], 0, False)
        for pdf in frames:
            for r in pdf.itertuples():
                if r.kind == "claim":
                    claims.append({"seq": int(r.seq), "activity": r.activity, "assertion": r.assertion, "told": None})
                    continue
                execs += r.kind == "exec"
                hidden = hidden or r.outcome == "denied" or r.kind == "opaque"
                if r.kind == "exec" and r.activity and r.outcome != "denied":
                    place = getattr(r, "ord", None)
                    runs.append((int(r.seq), r.activity, r.outcome, 0 if pd.isna(place) else int(place)))
        changed = []
        for c in claims:
            now = verdict(c, runs, execs, hidden)
            if now != c["told"]:
                c["told"] = now
                changed.append((key[0], c["seq"], c["activity"], now))
        state.update((json.dumps([runs, claims, execs, hidden]),))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(changed, columns=["session_id", "seq", "activity", "verdict"])

    return step


def streamed_verdicts(steps: DataFrame, idle_ms: int = 86_400_000) -> DataFrame:
    """session_id, seq, activity, verdict of claims, again when a verdict changes.

    ``steps`` has the columns of STEP; kind is exec (activity null if none), claim or opaque;
    ``ord`` may be absent or null, which is 0.
    """
    return steps.groupBy("session_id").applyInPandasWithState(_judge(idle_ms), OUT, "held string", "update", GroupStateTimeout.ProcessingTimeTimeout)
