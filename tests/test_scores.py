"""Rewards, rubric, validity and datasets on hand-made episodes."""

import pytest
from pyspark.sql import functions as F

from tracemill import schema
from tracemill.functions import score
from tracemill.operators import analytics, datasets, worldmodel
from tracemill.sources import sinks, store


def run(passed=0, failed=0, errors=0, total=-1):
    counts = dict(errors=errors, skipped=0, failed=failed, passed=passed)
    return counts | dict(command="pytest", framework="pytest", ok=failed == errors == 0, total=sum(counts.values()) if total == -1 else total)


def episode(id_="e", **k):
    return {"id": id_, "created_at": "2024-01-01T00:00:00", "agent": "codex", "intent": "Please make the parser faster and add a test for it", "stats": {}, "outcome": {"status": "open"}, **k}


def frame(spark, *episodes):
    df = schema.normalised(spark.createDataFrame([{k: e.get(k) for k in schema.EPISODE} for e in episodes], schema.DDL))
    order = F.create_map(*(x for i, e in enumerate(episodes) for x in (F.lit(e["id"]), F.lit(i))))
    return df.withColumn("ord", order[F.col("id")])


def step(i, kind, observation="ok", **k):
    return {"index": i, "type": kind, "tool": k.get("tool", {"shell_command": "Bash", "file_edit": "Edit"}.get(kind)), "input": k.get("input", "{}"), "observation": observation, "cwd": k.get("cwd")}


GOOD = episode("good", steps=[step(0, "user_prompt", input='{"prompt": "go"}'), step(1, "file_edit"), step(2, "shell_command", input='{"command": "pytest -q"}')], tests=[run(3)], human_feedback=[{"ts": "2", "label": "useful"}], outcome={"status": "merged"}, stats=dict(shell_commands=1, file_reads=2, file_edits=1), diffs=[dict(file="a.py", status="modified", additions=2, deletions=1, unified="+x")])
BAD = episode("bad", tests=[run(1, 2)], human_feedback=[{"ts": "2", "label": "wrong"}], outcome={"status": "reverted"}, stats=dict(shell_commands=2, file_reads=9, file_edits=1), diffs=[dict(file="a.py", status="modified", additions=1, deletions=0)])


@pytest.mark.parametrize(
    "tests, want",
    [
        ([run(0, 3), run(0, 3), run(3)], (1.0, True, False)), ([run(3), run(5, 5)], (0.25, True, False)), ([run(0, 10), run(8, 2)], (0.8, True, False)), ([], (0.0, False, False)), ([run(3, total=0), run(3, total=None)], (0.0, False, False)), ([run(0, 0, 2)], (0.0, True, True)),
    ],
)
def test_terminal_signal(spark, tests, want):
    assert tuple(score.with_test_signal(frame(spark, episode(tests=tests))).first()._t) == want


def test_canonical_pair(spark):
    rows = {r.id: r.reward_vector for r in score.with_reward(frame(spark, GOOD, BAD)).collect()}
    g, b = rows["good"], rows["bad"]
    assert (g.test_pass, g.edit_focus, g.composite) == (1.0, 0.25, pytest.approx(0.879, abs=2e-3))
    assert (b.test_pass, b.edit_focus, b.rubric) == (0.3333, 0.0833, pytest.approx(0.7778, abs=1e-4))
    assert b.composite == pytest.approx(0.2826, abs=1e-4)


def test_outcome_sources(spark):
    prod = {"ts": "1", "target_env": "prod", "exit_code": 0}
    cases = [
        (episode("a", deployments=[{**prod, "verified": False}], outcome_hint=dict(confidence=1.0, success="yes")), (-1, "deploy")), (episode("b", outcome_hint={"success": "partial", "confidence": 0.5}), (0.15, "mined")), (episode("c"), (0, "none")),
        (episode("d", outcome={"status": "accepted"}, deployments=[{**prod, "verified": False}]), (0.7, "authoritative")), (episode("e", outcome={"status": "merged", "caused_regression": True}), (-1, "authoritative")), (episode("f", deployments=[{**prod, "verified": None}]), (0, "none")),
    ]
    got = {r.id: r._o for r in score.with_outcome(frame(spark, *(e for e, _ in cases))).collect()}
    for e, (value, source) in cases:
        assert (got[e["id"]].score, got[e["id"]].source) == (pytest.approx(value), source)


def test_deployments_verify_by_what_follows(spark):
    dep = [{"ts": "2024-01-02", "exit_code": 0}, {"ts": "2024-01-02", "exit_code": 1, "verified": False}]
    fb = lambda label, ts: {"label": label, "ts": ts}
    cases = [([fb("useful", "2024-01-03")], True), ([fb("useful", "2024-01-01")], None), ([fb("useful", "2024-01-03"), fb("wrong", "2024-01-04")], None), ([], None)]
    rows = frame(spark, *(episode(str(i), deployments=dep, human_feedback=f) for i, (f, _) in enumerate(cases))).select("id", score.verified_deployments().alias("d")).collect()
    for r in rows:
        assert [d.verified for d in r.d] == [cases[int(r.id)][1], False]


def test_hard_violations_halve_and_judges_count(spark):
    e = frame(spark, episode("x", stats={"denials": 2}), {**GOOD, "id": "y"}).withColumn("j", F.lit(0.0))
    rows = {r.id: r._r for r in score.with_rubric(score.with_test_signal(e), {"explanation_quality": "j"}).collect()}
    assert rows["x"].hard_violations == ["has_test_evidence"] and rows["x"].score == pytest.approx(rows["x"].base / 2)
    assert rows["x"].base == pytest.approx(0.5 / 5)
    assert rows["y"].hard_pass and rows["y"].score < 0.8636


def test_flags(spark):
    e = [
        episode("fp", tests=[run(3)], human_feedback=[{"label": "wrong", "evidence_step_index": 5}]), episode("fn", tests=[run(0, 1)], outcome={"status": "accepted"}), episode("clean", tests=[run(3)], outcome={"status": "merged"}),
        episode("short", intent="fix it", tests=[run(3)], outcome={"status": "merged"}), episode("rescued", intent=" fix ", human_feedback=[{"label": "needed_human_rescue"}]), episode("early", steps=[step(i, "note") for i in range(9)], human_feedback=[{"label": "wrong", "evidence_step_index": 3}]),
    ]
    v = {r.id: r.validity for r in score.with_validity(score.with_reward(frame(spark, *e))).collect()}
    codes = {k: {f.code for f in x.flags} for k, x in v.items()}
    assert "test_reward_false_positive" in codes["fp"] and v["fp"].trust == "low" and "misleading_early_correction" not in codes["fp"]
    assert "test_reward_false_negative" in codes["fn"] and v["fn"].trust == "low"
    assert v["clean"].trust == "high" and not v["clean"].flags and v["clean"].severity is None
    assert codes["short"] == {"underspecified_intent"} and v["short"].trust == "medium"
    assert [f.severity for f in v["rescued"].flags if f.code == "underspecified_intent"] == ["high"]
    assert "misleading_early_correction" in codes["early"]


def test_validity_merge(spark):
    verdict = "struct<trust:string,severity:string,categories:array<string>,flags:array<string>,source:string>"
    df = spark.createDataFrame([(("high", None, ["a"], ["f"], "rules"), ("low", "high", ["b", "a"], ["f", "g"], "llm")), (None, ("medium", None, [], [], "llm"))], f"a {verdict}, b {verdict}")
    one, two = (r.m for r in df.select(score.merged_validity(F.col("a"), F.col("b")).alias("m")).collect())
    assert (one.trust, one.severity, one.categories, one.flags, one.source) == ("low", "high", ["a", "b"], ["f", "g"], "llm+rules")
    assert two.trust == "medium"


def scored(spark, *e):
    return store.materialised(score.with_validity(score.with_reward(frame(spark, *e))))


def test_pairs_and_ties(spark):
    twin = {**GOOD, "id": "twin"}
    e = scored(spark, GOOD, twin, BAD, {**BAD, "id": "alone", "intent": "Another task that nobody else has been given so far"})
    pairs = {r.key: (r.chosen_id, r.rejected_id) for r in datasets.dpo_pairs(e).collect()}
    assert pairs[GOOD["intent"].lower()] == ("good", "bad") and len(pairs) == 1
    texts = datasets.with_trajectories(datasets.dpo_pairs(e), e).first()
    assert texts.chosen.splitlines()[:3] == ["USER: " + GOOD["intent"], "ACTION user_prompt(go)", "OBS: ok"]
    equal = scored(spark, GOOD, twin)
    assert datasets.preference_pairs(equal).count() == 0 and datasets.dpo_pairs(equal).count() == 1


def test_self_pair_is_kept_unless_strict(spark):
    both = {**GOOD, "id": "both", "tests": [run(3)], "human_feedback": [{"label": "useful", "ts": "1"}, {"label": "wrong", "ts": "1", "confidence": 0.01}]}
    e = frame(spark, both).withColumn("reward_vector", F.struct(F.lit(0.9).alias("composite"))).withColumn("validity", F.struct(F.lit("high").alias("trust")))
    assert datasets.dpo_pairs(e).count() == 1 and datasets.dpo_pairs(e, strict=True).count() == 0


def test_sft_and_history_budget(spark):
    rows = sorted(datasets.sft_segments(scored(spark, GOOD)).collect(), key=lambda r: r.step_index)
    assert len(rows) == 2 and rows[1].user.endswith("ACTION Edit({})\nOBS: ok")
    long = [(("e", i, "x" * (i % 7 + 1) * 5)) for i in range(60)]
    df = spark.createDataFrame(long, "episode_id string, index int, block string")
    for budget in (1, 17, 40, 100):
        for r in datasets.tail_context(df, F.col("block"), budget).collect():
            assert r.context == "\n".join(b for _, i, b in long if i < r["index"])[-budget:]


def test_world_model_samples(spark):
    steps = spark.createDataFrame([("e", 0, "do", "first"), ("e", 1, "do", "  "), ("e", 2, "do", "third")], "episode_id string, index int, intent string, observation string")
    rows = sorted(worldmodel.samples(steps, F.lit("act")).collect(), key=lambda r: r["index"])
    assert [(r["index"], r.prev_observation) for r in rows] == [(0, ""), (2, "  ")]
    assert rows[0].history == "INTENT: do\nACTION: act\nOBSERVATION:" and "OBSERVATION: first\nACTION: act\nOBSERVATION:   " in rows[1].history
    picks = worldmodel.one_per_trajectory(spark.createDataFrame([(e, i) for e in "abc" for i in range(4)], "episode_id string, index int"))
    assert sorted(r.episode_id for r in picks.collect()) == ["a", "b", "c"]


def test_correlations(spark):
    df = spark.createDataFrame([(float(i), float(i**3), 1.0, -float(i)) for i in range(1, 8)], "x double, y double, c double, z double")
    pick = lambda a, b, d=None: df.agg(analytics.pearson(a, b, d).alias("r")).first().r
    assert pick("x", "z") == pytest.approx(-1) and pick("x", "c") is None and pick("x", "c", 0.0) == 0 and pick("x", "y") < 1
    ranked = analytics.with_ranks(df, "x", "y").agg(analytics.pearson("rank_x", "rank_y").alias("r")).first().r
    assert ranked == pytest.approx(1)
    ties = analytics.with_ranks(spark.createDataFrame([(5,), (5,), (1,), (9,)], "v int"), "v").collect()
    assert sorted((r.v, r.rank_v) for r in ties) == [(1, 1.0), (5, 2.5), (5, 2.5), (9, 4.0)]


def test_promotion(spark):
    p = lambda rows, margin=0.0: analytics.promotion(spark.createDataFrame(rows, "candidate double, base double"), margin).first().decision
    assert p([(0.5, 0.4), (None, 1.0)]) == "promote" and p([(0.5, 0.4)], 0.2) == "keep_base" and p([(float("nan"), 0.1)]) == "keep_base"


def test_router(spark):
    rows = [([float(i % 2), 0.0, 0.0, 0.0, 0.0], float(i % 2)) for i in range(30)]
    df = spark.createDataFrame(rows, "f array<double>, y double")
    model = analytics.learn_router(df)
    p = {r.f[0]: r.p for r in df.select("f", analytics.probability(F.col("f"), model).alias("p")).distinct().collect()}
    assert p[1.0] > 0.9 > 0.1 > p[0.0]
    assert analytics.learn_router(df.limit(2))["fallback"]


def test_reward_model_fits_what_is_linear(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(9)], "x double, y double").select(F.array("x", F.lit(1.0), F.lit(1.0)).alias("f"), "y")
    m = analytics.fit_reward_model(df, F.col("f"), F.col("y"))
    assert m["weights"] == pytest.approx([2.0, 0.5, 0.5]) and m["r2"] == 1.0
    assert analytics.fit_reward_model(df.limit(1), F.col("f"), F.col("y"))["weights"] == [0.0, 0.0, 0.0]


def test_running_baseline(spark):
    rows = spark.createDataFrame([(i, "p" if i % 2 else f"q{i}", float(i)) for i in range(12)], "i bigint, k string, r double")
    got = {r.i: r.baseline for r in analytics.running_baseline(rows, "k", "i", "r").collect()}
    assert got[0] == 0 and got[3] == 1.0 and got[2] == 0.5 and got[5] == 2.0


def test_exports(spark, tmp_path):
    good = {**GOOD, "repo_state": {"root": "/w", "remote_url": "https://x/y.git", "base_commit": "abc"}, "intent": 'Quote " and \\ and\nnew line, which is long enough to pass'}
    e = scored(spark, good, BAD)
    sinks.export(e, "harbor", str(tmp_path / "h"))
    task = (tmp_path / "h/good/task.toml").read_text()
    assert 'instruction = "Quote \\" and \\\\ and\\nnew line' in task and not (tmp_path / "h/bad").exists()
    assert "RUN git clone https://x/y.git ." in (tmp_path / "h/good/environment/Dockerfile").read_text()
    import tomllib

    assert tomllib.loads(task)["instruction"] == good["intent"]
    for fmt in "molt wm rlds parquet jsonl sft dpo reward".split():
        sinks.export(e, fmt, str(tmp_path / fmt))
    assert spark.read.json(str(tmp_path / "molt")).first().episode_id == "good"
    with pytest.raises(ValueError):
        sinks.exported(e, "csv")


def test_validation(spark):
    rows = {r.id: r.e for r in frame(spark, episode("ok"), {**episode("bent", human_feedback=[{"label": "meh"}]), "outcome": {"status": "lost"}, "intent": None}).select("id", schema.validation_errors().alias("e")).collect()}
    assert rows["ok"] == [] and len(rows["bent"]) == 3


def test_scores_read_arrays_once(spark):
    """Steps, runs and diffs aren't carried beyond the step that reads them, and a score alone is computed without the others."""
    e = score.with_scores(frame(spark, GOOD, BAD)).select("id", "reward_vector.composite", "validity.trust")
    levels = [line for line in e._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Project" in line]
    assert sum("steps#" in line for line in levels) <= 3 and sum("tests#" in line for line in levels) <= 3
    assert not any("AS normalized" in line or "AS criteria" in line for line in levels)
    both = score.with_validity(score.with_reward(frame(spark, GOOD, BAD)))
    assert score.with_scores(frame(spark, GOOD, BAD)).select(both.columns).collect() == both.collect()


def test_filters_of_exploded_scores_compute_nothing_again(spark):
    from tracemill import registry

    for name in ("rubric_criteria", "validity_flags"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("get_json_object") <= 1


def test_test_runs_written_with_escapes_count(spark):
    """A runner's name may hide behind codes of its letters in JSON text; other text is told without parsing it."""
    e = episode("e", tests=[run(3)], steps=[step(0, "shell_command", input='{"command": "py\\u0074es\\u0074 -q"}'), step(1, "file_edit")])
    other = episode("o", tests=[run(3)], steps=[step(0, "shell_command", input='{"command": "ls src"}'), step(1, "file_edit")])
    rows = score.with_rubric(score.with_test_signal(frame(spark, e, other))).select("id", F.expr("filter(_r.criteria, c -> c.id = 'reproduce_before_fix')[0].satisfied").alias("s"))
    assert dict(rows.collect()) == {"e": 1.0, "o": None}
