"""The store, links, reports and built episodes on hand-made rows."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tracemill.operators import analytics, datasets, library, review, sessions
from tracemill.sources import logs, sinks

EV = "session_id string, seq bigint, ts string, type string, tool_name string, tool_input string, cwd string, prompt string, command string, response string, exit_code int, file_path string, approved boolean"


def events(spark, *rows):
    full = [("s", i, f"2024-01-01T00:00:{i:02d}", *(r.get(k) for k in "type tool_name tool_input cwd prompt command response exit_code file_path approved".split())) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, EV)


SESSION = (
    {"type": "session_start", "cwd": "/w/app"},
    {"type": "user_prompt", "prompt": "\u00a0\n  Mend the parser\u00a0\nplease"},
    {"type": "file_read", "tool_name": "Read", "tool_input": '{"file_path": "/w/app/a.py"}', "file_path": "/w/app/a.py", "response": "x" * 700, "approved": True},
    {"type": "file_edit", "tool_name": "Edit", "file_path": "/w/app/b.py"},
    {"type": "file_write", "tool_name": "Write", "file_path": "/w/app/b.py"},
    {"type": "file_delete", "file_path": "/elsewhere/c.py"},
    {"type": "shell_command", "tool_name": "Bash", "command": "cd /w/app && pytest -q", "response": "3 passed in 0.1s", "exit_code": 0},
    {"type": "shell_command", "tool_name": "Bash", "command": "fly deploy --prod", "exit_code": 0},
    {"type": "denial", "tool_name": "Bash", "approved": False},
    {"type": "tool_post", "tool_name": "Grep"},
    {"type": "note"},
)


def meta(spark, **k):
    return spark.read.json(spark.sparkContext.parallelize([json.dumps({"session_id": "s", **k})]))


def test_a_built_episode_has_the_whole_schema(spark):
    m = meta(spark, agent="codex", repo_state={"root": "/w/app", "branch": "main"}, labels=["z"], usage={"input_tokens": 5, "output_tokens": 2, "cost_usd": 0.5}, human_feedback=[{"label": "useful", "ts": "2025", "source": "mined"}])
    e = sessions.built(events(spark, *SESSION), m).first()
    assert (e.agent, e.intent.strip("\u00a0\n ")[:15], e.repo_state.branch, e.diff_source) == ("codex", "Mend the parser", "main", "events")
    assert [s["index"] for s in e.steps] == list(range(9)) and [s.type for s in e.steps][-1] == "tool_post"
    assert e.steps[0].intent == "Mend the parser" and json.loads(e.steps[0].input)["prompt"].startswith("\u00a0") and e.steps[1].observation == "x" * 600
    assert [s.intent for s in e.steps[-2:]] == ["denied Bash", "Grep"] and e.steps[1].approved and e.steps[2].approved is None
    assert [(d.file, d.status, d.additions, d.unified) for d in e.diffs] == [("/elsewhere/c.py", "deleted", 0, None), ("b.py", "added", 0, None)]
    assert [(c.command, c.is_test, c.exit_code, c.reconstructed) for c in e.commands] == [("cd . && pytest -q", True, 0, False), ("fly deploy --prod", False, 0, False)]
    assert [(t.command, t.passed, t.ok, t.output_excerpt) for t in e.tests] == [("cd . && pytest -q", 3, True, "3 passed in 0.1s")]
    assert (e.stats.tests_run, e.stats.input_tokens, e.stats.cost_usd, e.stats.duration_ms, e.stats.started_at) == (1, 5, 0.5, 10_000, "2024-01-01T00:00:00")
    assert e.labels == ["mined_feedback", "useful", "z"] and e.outcome.status == "open"


def test_a_session_without_meta_data(spark):
    e = sessions.built(events(spark, *SESSION)).first()
    assert (e.agent, e.created_at) == ("unknown", "2024-01-01T00:00:00") and [d.file for d in e.diffs] == ["/elsewhere/c.py", "b.py"]
    assert e.commands[0].command == "cd /w/app && pytest -q" and e.labels == []


def test_scores_of_a_built_episode(spark):
    m = meta(spark, outcome={"status": "merged"})
    e = sessions.with_scores(sessions.built(events(spark, *SESSION), m)).first()
    assert e.deployments[0].verified and e.reward_vector.test_pass == 1 and e.reward_vector.outcome == 1 and e.validity.trust in ("high", "medium")
    blocked = events(spark, {"type": "shell_command", "command": "pytest", "response": "2 errors in 0.1s", "exit_code": 2})
    assert "blocked_on_env" in sessions.with_scores(sessions.built(blocked)).first().labels


def test_working_diffs_are_scoped(spark):
    patch = "".join(f"diff --git a/{f} b/{f}\n--- a/{f}\n+++ b/{f}\n@@ -1 +1 @@\n-a\n+b\n" for f in ("b.py", "other.py"))
    of = lambda d, *rows: sessions.built(events(spark, *rows), meta(spark, working_diff=d, cwd="/w/app")).first()
    e = of(patch, *SESSION)
    assert [(d.file, d.additions) for d in e.diffs] == [("b.py", 1)] and e.diff_source == "git-working-tree"
    assert [d.file for d in of(patch, {"type": "note"}).diffs] == ["b.py", "other.py"]
    e = of(patch, {"type": "file_edit", "file_path": "/w/app/q.py"})
    assert [d.file for d in e.diffs] == ["q.py"] and e.diff_source == "events"


def test_relative_paths(spark):
    cases = [("/a/b/c", "/a/b", "c"), ("/a/b", "/a/b/", "."), ("/a/bc", "/a/b", "/a/bc"), ("x", "/a", "x"), ("/a", "", "/a"), ("/a", None, "/a"), (None, "/a", None), ("/a.b/c", "/a.b", "c")]
    df = spark.createDataFrame([c[:2] for c in cases], "p string, b string")
    assert [r.r for r in df.select(sessions.relative_path(F.col("p"), F.col("b")).alias("r")).collect()] == [c[2] for c in cases]


def test_answers_as_text(spark):
    cases = {
        '{"stdout": {"a": 1}, "output": "x", "stderr": "e"}': "x\ne", '{"stdout": 5}': '{"stdout": 5}', '["a", {"text": "b"}, null, ["c", true]]': "a\nb\n\nc\nTrue", '"q"': "q", "null": "", "true": "True", "7": "7", "not json": "not json",
        '{"text": "t", "stderr": "\u00a0 "}': "t",
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "raw string")
    assert [r.t for r in df.select(logs.response_text(F.col("raw")).alias("t")).collect()] == [*cases.values(), ""]
    paths = spark.createDataFrame([('{"file_path": 3, "path": "p"}',), ('{"path": null}',), (None,)], "i string")
    assert [r.p for r in paths.select(logs.file_path(F.col("i")).alias("p")).collect()] == ["p", None, None]


def test_failed_patches(spark):
    p = "*** Begin Patch\n*** Add File: a\n+x\n*** End Patch"
    df = spark.createDataFrame([(1, p, 0), (2, p, 1), (3, p, None)], "id int, patch string, exit_code int")
    assert [r.tool for r in logs.patch_parts(df).orderBy("id").collect()] == ["Write", "ApplyPatch", "Write"]


def test_feedback_with_columns_of_any_type(spark):
    segments = spark.createDataFrame([("s", 0, 10), ("s", 1, 20), ("t", 0, 5)], "session_id string, segment int, start int")
    fb = spark.createDataFrame([("s", 5, {"a": 1}), ("s", 10, None), ("s", 25, {}), ("s", None, {"b": 2}), ("u", 1, None)], "session_id string, ts int, m map<string,int>")
    got = sessions.feedback_segments(fb, segments).collect()
    assert sorted(((r.ts, r.segment) for r in got), key=str) == sorted([(5, 0), (10, 0), (25, 1), (None, 1)], key=str) and got[0].asDict().keys() == {"session_id", "ts", "m", "segment"}


def test_regressions(spark):
    outcome = "struct<status:string,caused_regression:boolean,regression_commits:array<string>>"
    e = spark.createDataFrame([("a", ("open", None, ["old"]), []), ("b", ("open", None, None), ["x"]), ("c", ("open", None, None), [])], f"id string, outcome {outcome}, labels array<string>")
    hits = spark.createDataFrame([("a", "commit", "blamed"), ("b", "file", None)], "id string, via string, commit string")
    rows = {r.id: r for r in review.with_regressions(e, hits, "fix").collect()}
    assert rows["a"].outcome.regression_commits == ["fix", "old"] and rows["a"].labels == ["regression"] and not rows["b"].outcome.caused_regression and rows["c"].labels == []
    assert review.with_regressions(e, hits, "fix", fuzzy=True).where("id = 'b'").first().labels == ["regression", "x"]


def test_running_baseline_with_gaps(spark):
    rows = [(i * 997, "k" if i % 5 == 0 else f"u{i}", float(i)) for i in range(60)]
    got = {r.n: r.baseline for r in analytics.running_baseline(spark.createDataFrame(rows, "n bigint, key string, reward double"), "key", "n", "reward").collect()}
    for i, (n, key, _) in enumerate(rows):
        own = [r for _, k, r in rows[:i] if k == key][-8:] or [r for *_, r in rows[:i]][-8:]
        assert got[n] == pytest.approx(sum(own) / len(own) if own else 0)


def test_long_trajectories(spark):
    import random

    r = random.Random(1)
    n = 1000
    a, v, m = [r.random() for _ in range(n)], [r.random() for _ in range(n)], [r.randrange(2) for _ in range(n)]
    want, run, following = [0.0] * n, 0.0, 0.0
    for i in range(n - 1, -1, -1):
        if m[i]:
            run = a[i] + 0.9 * following - v[i] + 0.9 * 0.8 * run
            want[i], following = run, v[i]
    df = spark.createDataFrame([(a, v, m), ([], [], []), (None, None, None)], "a array<double>, v array<double>, m array<int>")
    got = [x.g for x in df.select(analytics.gae(F.col("a"), F.col("v"), F.col("m"), 0.9, 0.8).alias("g")).collect()]
    assert got[0] == pytest.approx(want) and got[1:] == [[], None]


def test_router_on_the_cluster_takes_the_same_steps(spark):
    rows = spark.range(40).selectExpr("array(id % 7, id % 3, id % 2, id * 0.1, 1.0) as f", "cast(id % 7 > 3 as double) as y").selectExpr("cast(f as array<double>) as f", "y")
    one, two = analytics.learn_router(rows, epochs=6), analytics.learn_router(rows, epochs=6, in_memory=0)
    assert two["weights"] == pytest.approx(one["weights"]) and two["bias"] == pytest.approx(one["bias"]) and not one["fallback"]


def test_verifier_falls_back_to_commands(spark):
    test, command = "struct<command:string,framework:string,passed:bigint,failed:bigint,total:bigint,ok:boolean>", "struct<command:string,is_test:boolean,exit_code:int,cwd:string>"
    rows = [("a", [("t", "go", 1, 0, 1, True)], [("c", True, 0, "x")]), ("b", [("t", "go", 0, 1, 1, False)], [("no", False, 0, None), ("bad", True, 1, None), ("none", True, None, None), ("c", True, 0, "/w")]), ("c", [], [])]
    df = spark.createDataFrame(rows, f"id string, tests array<{test}>, commands array<{command}>")
    got = {r.id: r.v for r in df.select("id", datasets.verifier().alias("v")).collect()}
    assert (got["a"].command, got["b"].command, got["b"].framework, got["b"].passed, got["c"]) == ("t", "c", "unknown", None, None)
    assert {r.id: r.w for r in df.select("id", library.command_cwd(F.lit("c")).alias("w")).collect()} == {"a": "x", "b": "/w", "c": None}


def test_scrubbing_goes_deep(spark):
    nan = float("nan")
    df = spark.createDataFrame([([(nan, 1)], {"k": math.inf}, 1.5)], "a array<struct<x:double,y:int>>, m map<string,double>, z double")
    r = sinks.finite_or_null(df).first()
    assert r.a[0].x is None and r.a[0].y == 1 and r.m == {"k": None} and r.z == 1.5


def test_manifest_ids_in_order(spark):
    df = spark.createDataFrame([(1, "b", "a"), (2, "a", None), (3, "c", "b")], "n int, one string, two string")
    assert [r.id for r in sinks.manifest_ids(df, "n", "one", "two").orderBy("ordinal").collect()] == ["b", "a", "c"]
    m = sinks.manifest(df, "one", "two").first()
    assert (m.rows, m.episodes) == (3, 3) and m.dataset_hash == sinks.manifest(df.orderBy(F.desc("n")), "one", "two").first().dataset_hash


def test_standard_output_is_refused_for_folders(spark):
    with pytest.raises(ValueError):
        sinks.export(spark.range(1), "parquet", "-")


def test_reports_of_known_predictors(spark):
    rows = [(f"e{i}", t, "do", f"act {t}", f"error: file {i}{t} not found") for i in range(30) for t in range(3)]
    s = spark.createDataFrame(rows, "episode_id string, turn_index int, intent string, action string, target_observation string")
    r = {x.predictor: x for x in library.report(s, max_turns=2).collect()}
    assert r["oracle"].mean_composite == 1 and r["oracle"].accuracy == 0.5 and r["oracle"].indistinguishability == 1
    assert r["empty"].turns == r["oracle"].turns == 2 * r["oracle"].episodes and r["empty"].mean_composite < 1


def test_limits_of_numbers():
    assert library.generations({}, 10) == (2, 2) and library.generations({"num_generations": 4, "batch_size": 3, "grad_accum": 2}, 100, 1) == (4, 12) and library.generations({"batch_size": 8}, 0) == (4, 8)
    for bad in (0, True, 2.5):
        with pytest.raises(ValueError):
            library.generations({"num_generations": bad}, 1)
    assert library.checked_number({"a": 2.0}, "a", 1, whole=True) == 2 and library.checked_number({}, "a", 0.5, 0, 1) == 0.5
    for bad in (True, "x", math.nan, math.inf, -1, 2, 0.5):
        with pytest.raises(ValueError):
            library.checked_number({"a": bad}, "a", 0, 0, 1, whole=True)


def test_validity_prompt(spark):
    e = sessions.with_scores(sessions.built(events(spark, *SESSION), meta(spark, human_feedback=[{"label": "wrong", "ts": "2025", "confidence": 0.5}])))
    text = e.select(library.validity_prompt().alias("p")).first().p.split("\n")
    at = next(i for i, line in enumerate(text) if line.startswith("STEPS"))
    assert text[at : at + 3] == ["STEPS: 9  DIFFS: /elsewhere/c.py, b.py", "TESTS: pytest ok=True passed=3 failed=0 errors=0", "HUMAN_FEEDBACK: wrong(0.5)"]
    assert text[at + 3] == "OUTCOME: status=open hint=None deploys=[None]" and text[at + 4].startswith("RECORDED_REWARD: composite=")
