"""The command line over a file of episode documents."""

import json

import pytest

from tracemill.__main__ import main


@pytest.fixture
def file(spark, tmp_path):
    e = {"id": "ep_1", "created_at": "2024", "agent": "codex", "intent": "Make the whole test suite of the parser pass again", "stats": dict(file_edits=1), "outcome": dict(status="merged"), "steps": [dict(index=0, tool="Edit", type="file_edit", observation="ok", input='{"file_path": "a.py"}')], "tests": [{"framework": "pytest", "command": "pytest", "passed": 2, "failed": 0, "total": 2, "ok": True}]}
    rows = [e, {**e, "id": "ep_2", "outcome": {"status": "failed"}, "intent": "No"}]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, rows)))
    return str(tmp_path / "e.jsonl")


def lines(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines()]


def test_commands(file, capsys, tmp_path):
    assert main(["list", file]) == 0
    assert [r["id"] for r in lines(capsys)] == ["ep_1", "ep_2"]
    assert main(["summary", file, "--id", "ep_1"]) == 0
    assert lines(capsys)[0]["suggested_pr_title"].startswith("Make the whole")
    assert main(["audit", file]) == 0
    assert {(r["name"], r["n"]) for r in lines(capsys) if r["kind"] == "trust"} == {("high", 1), ("low", 1)}
    assert main(["export", file, "--format", "sft"]) == 0
    assert [r["episode_id"] for r in lines(capsys)] == ["ep_1"]
    assert main(["export", file, "--out", str(tmp_path / "out"), "--format", "jsonl"]) == 0
    assert main(["loop", file]) == 0 and main(["show", file]) == 0
    assert main(["validate", file]) == 0
