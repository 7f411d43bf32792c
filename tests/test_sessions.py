"""Order-sensitive operators over session events, telemetry, and their streaming forms."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracemill.operators import rollouts, sessions
from tracemill.sources import logs, store
from tracemill.streaming import ingest

T0 = datetime(2024, 1, 1)
EV = "session_id string, seq bigint, ts timestamp, type string, prompt string, command string, output string, exit_code int, file_path string, approved boolean"


def events(spark, *rows):
    return spark.createDataFrame([(r.get("s", "s"), i, T0 + timedelta(seconds=i), r["type"], r.get("prompt"), r.get("command"), r.get("output"), r.get("exit_code"), r.get("file"), r.get("approved", True)) for i, r in enumerate(rows)], EV)


LONG = "now write the documentation of the whole module"


def test_segments(spark):
    ev = events(spark, {"type": "file_read"}, {"type": "user_prompt", "prompt": "go"}, {"type": "file_edit"}, {"type": "user_prompt", "prompt": "push"}, {"type": "user_prompt", "prompt": LONG}, {"type": "user_prompt", "prompt": "also, " + LONG}, {"type": "shell_command"})
    assert [r.segment for r in sessions.segmented(ev).orderBy("seq").collect()] == [0, 1, 1, 1, 2, 2, 2]
    both = sessions.with_prelude(events(spark, {"type": "session_start"}, {"type": "user_prompt", "prompt": "a"}, {"type": "user_prompt", "prompt": LONG}))
    assert sorted((r.seq, r.segment) for r in both.collect()) == [(0, 0), (0, 1), (1, 0), (2, 1)]


def test_feedback_goes_to_the_segment_that_had_started(spark):
    seg = spark.createDataFrame([("s", 0, T0), ("s", 1, T0 + timedelta(minutes=10))], "session_id string, segment bigint, start timestamp")
    fb = spark.createDataFrame([("s", T0 - timedelta(minutes=1), "a"), ("s", T0 + timedelta(seconds=2), "b"), ("s", T0 + timedelta(minutes=10), "c"), ("s", None, "d")], "session_id string, ts timestamp, label string")
    assert {r.label: r.segment for r in sessions.feedback_segments(fb, seg).collect()} == {"a": 0, "b": 0, "c": 1, "d": 1}


REC = "session_id string, ord bigint, command string, is_error boolean, exit_code int, output string"


def test_exit_codes_by_ordinal(spark):
    ev = spark.createDataFrame([("s", 1, "a", None), ("s", 2, "a", 0), ("s", 3, "b", None)], "session_id string, seq bigint, command string, exit_code int")
    rec = spark.createDataFrame([("s", 1, "a", 2), ("s", 2, "a", 3), ("s", 3, "b", 4), ("s", 4, "b", 5)], "session_id string, ord bigint, command string, exit_code int")
    assert [r.exit_code for r in sessions.ordinal_backfill(ev, rec).orderBy("seq").collect()] == [2, 0, None]


def test_failed_commands_come_back(spark):
    pre = [("s", 2 * i, c, "tool_pre") for i, c in enumerate("aab")]
    ev = spark.createDataFrame([*pre, ("s", 3, "a", "shell_command")], "session_id string, seq bigint, command string, type string")
    rec = spark.createDataFrame([("s", 0, "a", True, 1, "boom"), ("s", 1, "a", False, 0, ""), ("s", 2, "b", True, 1, "x"), ("s", 3, "b", True, 1, "y")], REC)
    assert [(r.seq, r.command, r.output) for r in sessions.reconstructed_failures(ev, rec).collect()] == [(0, "a", "boom")]


def test_mined_feedback_is_added_once(spark):
    s = "session_id string, ord bigint, label string, evidence_step_index int"
    own, mined = spark.createDataFrame([("s", 1, "wrong", 2), ("s", 2, "wrong", 2)], s), spark.createDataFrame([("s", 3, "wrong", 2), ("s", 4, "useful", None), ("s", 5, "useful", None)], s)
    assert sorted(r.ord for r in sessions.merged_feedback(own, mined).collect()) == [1, 2, 4]


def test_built_session(spark):
    ev = events(spark, {"type": "user_prompt", "prompt": "do"}, {"type": "file_edit", "file": "b"}, {"type": "file_write", "file": "b"}, {"type": "shell_command", "command": "pytest", "output": "2 passed", "exit_code": 0}, {"type": "shell_command", "command": "fly deploy --prod", "exit_code": 1}, {"type": "denial", "approved": False}, {"type": "note"})
    e = sessions.built(ev).first()
    assert e.intent == "do" and [s.type for s in e.steps] == ["user_prompt", "file_edit", "file_write", "shell_command", "shell_command", "denial"] and [s["index"] for s in e.steps] == list(range(6))
    assert [(d.file, d.status) for d in e.diffs] == [("b", "added")] and e.tests[0].passed == 2 and e.deployments[0].verified is False and e.deployments[0].target_env == "prod"
    assert (e.stats.tool_calls, e.stats.denials, e.stats.duration_ms) == (4, 1, 6000) and e.id.startswith("ep_")


def body(session, *points, on_point=True):
    attr = lambda k, v: {"key": k, "value": {"stringValue": v}}
    metrics = [{"name": n, kind: {"dataPoints": [{**value, "attributes": [attr("type", t)] + ([attr("session.id", session)] if on_point else [])}]}} for n, kind, t, value in points]
    resource = dict(attributes=[attr("session.id", "res" if on_point else session)])
    return json.dumps(dict(resourceMetrics=[dict(scopeMetrics=[dict(metrics=metrics)], resource=resource)]))


TOK, COST = logs.TOKEN_METRIC, logs.COST_METRIC
BODIES = [body("s1", (TOK, "sum", "input", {"asInt": "1000"}), (TOK, "gauge", "output", {"asDouble": 500.9}), (COST, "sum", "x", {"asDouble": 0.42}), ("other", "sum", "x", {"asInt": "7"})), body("s2", (TOK, "sum", "input", {"asInt": "5"}), on_point=False), "{}", "not json"]


def test_usage(spark):
    u = {r.session_id: (r.input_tokens, r.output_tokens, r.cost_usd) for r in logs.usage(logs.usage_points(spark.createDataFrame([(b,) for b in BODIES], "body string"))).collect()}
    assert u == {"s1": (1000, 500, 0.42), "s2": (5, 0, 0.0)}


def test_usage_streams_to_the_same_totals(spark, tmp_path):
    for i, b in enumerate(BODIES):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{i}.json").write_text(json.dumps({"body": b}))
    q = ingest.start_usage(ingest.read_stream(spark, str(tmp_path / "in"), "body string", 1), str(tmp_path / "usage"), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert {r.session_id: r.input_tokens for r in ingest.usage_now(spark, str(tmp_path / "usage")).collect()} == {"s1": 1000, "s2": 5}


def hook(kind, session="s", **k):
    return json.dumps({"session_id": session, "hook_event_name": kind, **k})


def test_hooks(spark):
    rows = [hook("UserPromptSubmit", prompt="hi"), hook("PostToolUse", tool_name="Bash", tool_input={"command": "ls"}, tool_response={"stdout": "a", "stderr": "warn", "exit_code": " 3 "}), hook("PostToolUse", tool_name="Edit", tool_input={"file_path": "x"}, tool_response="ok"), hook("PostToolUse", tool_name="Bash", tool_response="Permission denied"), hook("PostToolUse", tool_name="Odd", tool_response={"interrupted": True}), hook("Stop"), hook("PostToolUse", tool_name="Bash", tool_response={"exit_code": True, "interrupted": True, "text": "y" * 7000})]
    got = logs.events_of_hooks(spark.createDataFrame([(p, i) for i, p in enumerate(rows)], "payload string, seq bigint")).orderBy("seq").collect()
    assert [r.type for r in got] == ["user_prompt", "shell_command", "file_edit", "denial", "tool_post", "note", "shell_command"]
    assert (got[1].command, got[1].exit_code, got[1].response) == ("ls", 3, "a\nwarn") and got[2].file_path == "x" and got[3].approved is False
    assert got[6].exit_code == 130 and got[6].response.endswith("[truncated 1000 chars]")


def test_rollouts_of_recordings(spark):
    rows = [{"type": "function_call", "call_id": "1", "name": "shell", "arguments": json.dumps({"command": ["ls", "-l"]})}, {"type": "function_call_output", "call_id": "1", "output": json.dumps({"output": "x", "metadata": {"exit_code": 2}})}, dict(type="function_call", call_id="2", name="exec", arguments=json.dumps(dict(cmd="pwd"))), {"type": "function_call_output", "call_id": "2", "output": "old"}, {"type": "function_call_output", "call_id": "2", "output": "Process exited with code 7\nOutput:\n/w"}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "ord bigint, payload string")
    assert [(r.command, r.output, r.exit_code) for r in logs.rollout_calls(df).orderBy("ord").collect()] == [("ls -l", "x", 2), ("pwd", "/w", 7)]


def test_transcripts(spark):
    use = lambda i, c: dict(id=i, name="Bash", type="tool_use", input=dict(command=c))
    res = lambda i, e, t: {"type": "tool_result", "tool_use_id": i, "is_error": e, "content": t}
    lines = [[use("1", "a"), use("2", "a")], [res("1", True, "Exit code: 2\nx"), res("2", False, "fine")], [use("3", "b")], [res("3", True, "boom")]]
    df = spark.createDataFrame([(i, json.dumps({"message": {"content": c}})) for i, c in enumerate(lines)], "ord bigint, value string")
    assert sorted((r.command, r.k, r.exit_code) for r in logs.transcript_commands(df).collect()) == [("a", 1, 2), ("a", 2, 0), ("b", 1, 1)]


def test_finalising_stream_equals_batch(spark, tmp_path):
    rows = [[{"s": "a", "type": "user_prompt", "prompt": "x"}, {"s": "b", "type": "user_prompt", "prompt": "y"}], [{"s": "a", "type": "file_edit", "file": "f"}, {"s": "a", "type": "note", "hook": "Stop"}], [{"s": "a", "type": "file_edit", "file": "g"}, {"s": "a", "type": "note", "hook": "SessionEnd"}]]
    seq, schema = 0, EV + ", hook string"
    (tmp_path / "in").mkdir()
    q = ingest.start_finalising(ingest.read_stream(spark, str(tmp_path / "in"), schema, 1), str(tmp_path / "store"), str(tmp_path / "c"))
    for i, batch in enumerate(rows):
        out = []
        for r in batch:
            out.append({"session_id": r["s"], "seq": seq, "ts": (T0 + timedelta(seconds=seq)).isoformat(), "type": r["type"], "prompt": r.get("prompt"), "file_path": r.get("file"), "approved": True, "hook": r.get("hook")})
            seq += 1
        (tmp_path / f"in/{i}.json").write_text("\n".join(map(json.dumps, out)))
        q.processAllAvailable()
    q.stop()
    e = ingest.finalised(spark, str(tmp_path / "store")).collect()
    assert len(e) == 1 and e[0].session_id == "a" and [d.file for d in e[0].diffs] == ["f", "g"] and len(e[0].steps) == 3


def test_upsert_keeps_content(spark):
    old = spark.createDataFrame([("a", [1], 1), ("b", [1], 1)], "id string, steps array<int>, version int")
    new = spark.createDataFrame([("a", [], 2), ("b", [2], 2)], "id string, steps array<int>, version int")
    assert {r.id: r.version for r in store.upserted(old, new).collect()} == {"a": 1, "b": 2}


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\nbad\n')
    assert sorted(r.a for r in logs.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int", tolerant=True).collect()) == [1, 2]
    with pytest.raises(Exception):
        logs.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()


def test_closed_loop(spark):
    s = spark.createDataFrame([("e", i, "do", f"a{i}", f"o{i}") for i in range(4)], "episode_id string, turn_index int, intent string, action string, target_observation string")
    out = lambda f, **k: [r.predicted for r in rollouts.rollout(s, f, **k).orderBy("turn_index").collect()]
    assert out(rollouts.named("oracle")) == ["o0", "o1", "o2", "o3"] and out(rollouts.named("prefix"), max_turns=2) == ["", ""]
    assert out(lambda x: str(x["history"].count("ACTION"))) == ["0", "1", "2", "3"]


def test_turns(spark):
    st = sessions.steps(events(spark, {"type": "file_read"}, {"type": "user_prompt", "prompt": "  a\n b "}, {"type": "file_edit", "file": "x"}, {"type": "denial"}, {"type": "user_prompt", "prompt": "c"}))
    assert sessions.rendered_turns(sessions.turns(st)).first().text == "[#1] USER: a b\n    agent: 1 edit(s), 1 denial(s)\n[#4] USER: c"
    assert st.where(F.col("type") == "user_prompt").orderBy("seq").first().intent == "a"
