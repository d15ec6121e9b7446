"""Synthetic transcripts for tests: scripts of what an agent ran and said."""

from __future__ import annotations

import json
import re
from pathlib import Path

REFUSED = "The user doesn't want to proceed with this tool use."


def ran(command, stdout="", code=0, stderr="", denied=False, **result):
    return {"ran": command, "stdout": stdout, "code": code, "stderr": stderr, "denied": denied, "result": result}


def said(text):
    return {"said": text}


def tool(name, **given):
    return {"tool": name, "input": given}


def lines(script, session="s-1", cwd="/work/alpha", branch="main"):
    out, clock = [], 0

    def record(kind, message, **more):
        nonlocal clock
        out.append(json.dumps({"type": kind, "sessionId": session, "timestamp": f"2026-08-01T00:{clock:02d}:00.000Z", "cwd": cwd, "gitBranch": branch, "version": "1.0", "message": message, **more}))
        clock += 1

    for k, step in enumerate(script):
        spent = {"input_tokens": 100, "output_tokens": 50}
        if "raw" in step:
            out.append(step["raw"])
        elif "said" in step:
            record("assistant", {"model": "model-a", "usage": spent, "content": [{"type": "text", "text": step["said"]}]})
        elif "tool" in step:
            record("assistant", {"model": "model-a", "content": [{"type": "tool_use", "id": f"t{k}", "name": step["tool"], "input": step["input"]}]})
        else:
            record("assistant", {"model": "model-a", "content": [{"type": "tool_use", "id": f"t{k}", "name": "Bash", "input": {"command": step["ran"], "description": "d"}}]})
            ok, more = step["code"] == 0, {}
            text = REFUSED if step["denied"] else step["stdout"] if ok else f"Exit code {step['code']}\n{step['stdout']}{step['stderr']}"
            if step["denied"]:
                more = {"toolUseResult": "Error: refused"}
            elif ok:
                more = {"toolUseResult": {"stdout": step["stdout"], "stderr": step["stderr"], "interrupted": False, **step["result"]}}
            record("user", {"content": [{"type": "tool_result", "tool_use_id": f"t{k}", "content": text, "is_error": step["denied"] or not ok}]}, **more)
    return out


def write(root: Path, scripts: dict) -> Path:
    """``scripts``: session id -> (script, cwd, branch) or a script."""
    for session, given in scripts.items():
        script, cwd, branch = given if isinstance(given, tuple) else (given, "/work/alpha", "main")
        folder = root / re.sub(r"[^a-zA-Z0-9]", "-", cwd)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{session}.jsonl").write_text("\n".join(lines(script, session, cwd, branch)) + "\n")
    return root
