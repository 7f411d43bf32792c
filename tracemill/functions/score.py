"""Scores of an episode as column expressions: tests, feedback, outcome, reward, rubric, validity, difficulty.

Each function reads columns of the episode schema by name and gives a column; nothing runs in Python."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.commands import framework_in, may_run_tests

LABEL_SCORES = dict(accepted_as_is=1.0, useful=1.0, accepted_after_edits=0.5, too_slow=-0.3, too_broad=-0.3, needed_human_rescue=-0.6, wrong=-1.0)
OUTCOME_SCORES = dict(reverted=-1.0, failed=-1.0, abandoned=-0.5, open=0.0, accepted=0.7, merged=1.0)
HINT_SCORES = dict(no=-1.0, unclear=0.0, partial=0.3, yes=1.0)
WEIGHTS = dict(test_pass=0.25, outcome=0.25, rubric=0.20, human_label=0.15, edit_focus=0.075, cost_efficiency=0.075)
POSITIVE, NEGATIVE = ("accepted_as_is", "accepted_after_edits", "useful"), ("wrong", "needed_human_rescue", "too_broad")
GOOD_LABELS, GOOD_STATUSES, BAD_STATUSES = ("useful", "accepted_as_is", "accepted_after_edits"), ("accepted", "merged"), ("failed", "reverted")


def lookup(key: Column, values: dict, default: float | None = 0.0) -> Column:
    """A chain of comparisons, which stays inside generated code as a map would not."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Between two bounds; null stays null, which the least and the greatest of several would pass over."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def n(x: Column) -> Column:
    return F.coalesce(x, F.lit(0)).cast("double")


def r4(x: Column) -> Column:
    """Four digits. A billionth is added first, so that a tie that binary numbers miss by a hair goes up everywhere."""
    return F.round(x + 1e-9, 4)


def executed(tests: str = "tests") -> Column:
    """Runs that executed anything; a run without a total counts as none."""
    return F.filter(tests, lambda t: F.coalesce(t["total"], F.lit(0)) > 0)


def has_label(*labels: str) -> Column:
    return F.coalesce(F.exists("human_feedback", lambda f: F.coalesce(f["label"].isin(*labels), F.lit(False))), F.lit(False))


def added(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Those of the columns that ``df`` hasn't yet."""
    return df.withColumns({k: c for k, c in columns.items() if k not in df.columns})


def run_facts() -> dict[str, Column]:
    """Of executed runs, to rows with ``_runs``."""
    ok = lambda t: F.coalesce(t["ok"], F.lit(False))
    last = F.try_element_at("_runs", F.lit(-1))
    return {"_last": F.when(last.isNotNull(), F.struct(*(last[k].alias(k) for k in ("passed", "failed", "errors", "ok")))), "_green": F.exists("_runs", ok), "_red": F.exists("_runs", lambda t: ~ok(t)), "_ran": F.size("_runs")}


def with_runs(df: DataFrame) -> DataFrame:
    return df if "_last" in df.columns else added(added(df, {"_runs": executed()}), run_facts()).drop("_runs")


def feedback_facts() -> dict[str, Column]:
    """Of feedback: the sums that its mean is made of."""
    return {"_s": F.aggregate("human_feedback", F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("w")), lambda s, f: F.struct((s["a"] + lookup(f["label"], LABEL_SCORES) * F.coalesce(f["confidence"], F.lit(1.0))).alias("a"), (s["w"] + F.coalesce(f["confidence"], F.lit(1.0))).alias("w")))}


def step_facts() -> dict[str, Column]:
    """Of steps and diffs: the first edit, read and test run, and how many files are named."""
    files = F.size(F.array_distinct(F.filter(F.transform("diffs", lambda d: F.nullif(d["file"], F.lit(""))), lambda x: x.isNotNull())))
    return {"_edit": first_index("file_edit", "file_write"), "_read": first_index("file_read"), "_run": first_index("shell_command", test_only=True), "_files": files}


def flag_facts() -> dict[str, Column]:
    """Of labels, deployments, diffs and early corrections."""
    early = lambda f: (f["label"] == "wrong") & f["evidence_step_index"].isNotNull() & (f["evidence_step_index"] <= F.greatest(F.lit(1), F.floor(F.size("steps") / 3)))
    return {
        "_praised": has_label(*POSITIVE), "_blamed": has_label(*NEGATIVE), "_rescued": has_label("needed_human_rescue", "wrong"), "_early": F.exists("human_feedback", early),
        "_verified": F.exists("deployments", lambda d: d["verified"].eqNullSafe(True)), "_broken": F.exists("deployments", lambda d: d["verified"].eqNullSafe(False)),
        "_source": F.exists("diffs", lambda d: ~F.coalesce(d["file"], F.lit("")).rlike(r"\.(md|txt|rst)\z")), "_touched": F.exists("diffs", lambda d: F.lower(F.coalesce(d["file"], F.lit(""))).contains("test")),
    }


FACTS = "_last _green _red _ran _s _d _edit _read _run _files _praised _blamed _rescued _early _verified _broken _source _touched".split()


def with_facts(df: DataFrame, flags: bool = False) -> DataFrame:
    """Adds all that the scores ask of an episode's arrays. It is computed in one step right upon the arrays: carried on and
    asked again for each part of a score, they'd cost many times what the scores do. With ``flags`` what the rules of
    validity ask too."""
    of = {**run_facts(), **feedback_facts(), "_d": deploy_signal(), **step_facts(), **(flag_facts() if flags else {})}
    return added(added(df, {"_runs": executed()}), of).drop("_runs")


def with_test_signal(df: DataFrame) -> DataFrame:
    """A4: adds ``_t``, struct(score, has_tests, blocked) of the last executed run; half credit for a failing rate once it
    was green. Built column by column: within one expression, functions over arrays would be computed at every mention."""
    had = [c for c in FACTS if c in df.columns]
    return _test_signal(with_runs(df)).drop(*(c for c in FACTS if c not in had))


def _test_signal(df: DataFrame) -> DataFrame:
    last, ok = F.col("_last"), F.coalesce(F.col("_last.ok"), F.lit(False))
    count = n(last["passed"]) + n(last["failed"]) + n(last["errors"])
    rate = F.when(count == 0, F.when(ok, 1.0).otherwise(0.0)).otherwise(n(last["passed"]) / count)
    score = F.when(last.isNull(), 0.0).when(ok, 1.0).otherwise(F.when(F.col("_green"), rate * 0.5).otherwise(rate))
    blocked = last.isNotNull() & ~ok & (n(last["errors"]) > 0) & (n(last["passed"]) == 0) & (n(last["failed"]) == 0)
    return df.withColumn("_t", F.struct(r4(score).alias("score"), last.isNotNull().alias("has_tests"), blocked.alias("blocked")))


def with_human_label(df: DataFrame) -> DataFrame:
    """A5: adds ``_h``, the confidence-weighted mean of label scores; 0 without feedback or weight."""
    df = df if "_s" in df.columns else df.withColumns(feedback_facts())
    return df.withColumn("_h", F.when(F.coalesce("_s.w", F.lit(0.0)) == 0, 0.0).otherwise(F.col("_s.a") / F.col("_s.w"))).drop("_s")


def deploy_signal() -> Column:
    """R2: production deployments only: -1 if one is known to have failed, 1 if one is verified, else null."""
    known = lambda v: F.exists("deployments", lambda d: (d["target_env"] == "prod") & d["verified"].eqNullSafe(v))
    return F.when(known(False), -1.0).when(known(True), 1.0)


def with_outcome(df: DataFrame) -> DataFrame:
    """Adds ``_o``, struct(score, source): an authoritative status, else the deployments, else a mined hint."""
    status, hint, deploy = F.col("outcome.status"), F.col("outcome_hint"), F.col("_d")
    regressed = F.coalesce(F.col("outcome.caused_regression"), F.lit(False))
    known = F.coalesce(hint["success"].isin(*HINT_SCORES), F.lit(False))
    mined = lookup(hint["success"], HINT_SCORES) * clamp(F.coalesce(hint["confidence"], F.lit(0.0)))
    base = F.when(status != "open", lookup(status, OUTCOME_SCORES)).when(deploy.isNotNull(), deploy).when(known, mined).otherwise(0.0)
    source = F.when(status != "open", "authoritative").when(deploy.isNotNull(), "deploy").when(known, "mined").otherwise("none")
    return added(df, {"_d": deploy_signal()}).withColumn("_o", F.struct(F.when(regressed, F.least(base, F.lit(-1.0))).otherwise(base).alias("score"), source.alias("source"))).drop("_d")


def cost_efficiency() -> Column:
    """Null without a cost."""
    cost, edits = F.coalesce(F.col("stats.cost_usd"), F.lit(0.0)), F.greatest(F.lit(1.0), n(F.col("stats.file_edits")))
    return F.when(cost > 0, clamp(edits / (edits + cost * 10.0)))


def edit_focus() -> Column:
    """R4."""
    edits, others = n(F.col("stats.file_edits")), n(F.col("stats.file_reads")) + n(F.col("stats.shell_commands"))
    return F.when(edits + others == 0, 0.0).otherwise(clamp(edits / (edits + others)))


def first_index(*types: str, test_only: bool = False) -> Column:
    """The least index of a step of these types (of those that run a test command)."""
    wanted = lambda s: s["type"].isin(*types) & (may_run_tests(s["input"]) & framework_in(F.get_json_object(s["input"], "$.command")).isNotNull() if test_only else F.lit(True))
    return F.array_min(F.transform(F.filter("steps", wanted), lambda s: s["index"]))


def with_rubric(df: DataFrame, judge_scores: dict[str, str] | None = None) -> DataFrame:
    """Adds ``_r``, struct(score, base, hard_pass, hard_violations, criteria) of weighted criteria, to rows with
    ``_t``; a criterion that is null doesn't apply. ``judge_scores`` maps a judged criterion to the column of its score."""
    had = [c for c in FACTS if c in df.columns]
    df = _rubric(added(df, step_facts()), judge_scores)
    return df.withColumn("_r", F.struct("_r.*", F.col("_criteria").alias("criteria"))).drop("_criteria", *(c for c in FACTS if c not in had))


def _rubric(df: DataFrame, judge_scores: dict[str, str] | None = None) -> DataFrame:
    """Adds ``_r`` without the criteria, and these as ``_criteria``."""
    test, edit, run, read, files = (F.col(c) for c in ("_t", "_edit", "_run", "_read", "_files"))
    judged = lambda k: F.col((judge_scores or {})[k]).cast("double") if k in (judge_scores or {}) else F.lit(None).cast("double")
    rows = [
        ("has_test_evidence", "hard", 2, F.when(test["has_tests"], 1.0).otherwise(0.0)),
        ("not_blocked_on_env", "hard", 2, F.when(test["has_tests"], F.when(test["blocked"], 0.0).otherwise(1.0))),
        ("tests_end_green", "principle", 3, F.when(test["has_tests"], test["score"])),
        ("reproduce_before_fix", "principle", 1, F.when(edit.isNotNull() & run.isNotNull(), F.when(run < edit, 1.0).otherwise(0.2))),
        ("explored_before_edit", "principle", 1, F.when(edit.isNotNull(), F.when(read < edit, 1.0).otherwise(0.3))),
        ("change_is_scoped", "principle", 1, F.when(files > 0, F.when(files <= 3, 1.0).when(files <= 8, 0.6).otherwise(0.3))),
        ("low_denials", "principle", 1, F.greatest(F.lit(0.0), 1.0 - 0.25 * n(F.col("stats.denials")))),
        ("explanation_quality", "principle", 2, judged("explanation_quality")),
        ("correct_beyond_tests", "principle", 2, judged("correct_beyond_tests")),
    ]
    df = df.withColumns({f"_c{k}": s.cast("double") for k, (*_, s) in enumerate(rows)})
    of = [(i, kind, float(w), F.col(f"_c{k}")) for k, (i, kind, w, _) in enumerate(rows)]
    total = lambda v: sum((F.when(s.isNotNull(), v(w, s)).otherwise(0.0) for _, _, w, s in of), F.lit(0.0))
    df = df.withColumns({"_base": total(lambda w, s: F.lit(w) * s) / total(lambda w, s: F.lit(w)), "_violated": several((s < 1.0, F.lit(i)) for i, kind, _, s in of if kind == "hard")})
    base, violated = F.col("_base"), F.col("_violated")
    r = F.struct(r4(F.when(F.size(violated) > 0, base * 0.5).otherwise(base)).alias("score"), r4(base).alias("base"), (F.size(violated) == 0).alias("hard_pass"), violated.alias("hard_violations"))
    criteria = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(kind).alias("kind"), F.lit(w).alias("weight"), s.alias("satisfied")) for i, kind, w, s in of))
    return df.withColumns({"_r": r, "_criteria": criteria}).drop("_base", "_violated", *(f"_c{k}" for k in range(len(rows))))


def several(choices: Iterable[tuple[Column, Column]]) -> Column:
    """An array of the values whose condition holds. The filter also keeps steps of a score apart: Spark would join steps
    without functions over arrays into one method, which grows too long for the virtual machine to compile."""
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), v) for c, v in choices)), lambda x: x.isNotNull())


def with_reward(episodes: DataFrame, judge_scores: dict[str, str] | None = None) -> DataFrame:
    """Adds ``reward_vector``, built in steps so that no part is computed twice."""
    return _vector(_reward(with_facts(episodes), judge_scores))


def _reward(episodes: DataFrame, judge_scores: dict[str, str] | None = None) -> DataFrame:
    """Adds the parts of the vector as columns; their rounding costs more than they do, so only what is read is rounded."""
    e = with_outcome(with_human_label(_rubric(_test_signal(episodes), judge_scores))).withColumns({"_c": cost_efficiency(), "_f": edit_focus(), "_feedback": F.coalesce(F.size("human_feedback") > 0, F.lit(False))})
    composite = sum((F.lit(WEIGHTS[k]) * v for k, v in normalized(WEIGHTS).items()), F.lit(0.0))
    return e.withColumns({"_composite": r4(composite), "_label": r4(F.col("_h"))})


def normalized(order: Iterable[str]) -> dict[str, Column]:
    parts = {
        "test_pass": F.when(F.col("_t.has_tests"), F.col("_t.score")).otherwise(0.5),
        "outcome": (F.col("_o.score") + 1) / 2,
        "rubric": F.coalesce("_r.score", F.lit(0.5)),
        "human_label": F.when(F.col("_feedback"), (F.col("_h") + 1) / 2).otherwise(0.5),
        "edit_focus": F.col("_f"),
        "cost_efficiency": F.coalesce("_c", F.lit(0.5)),
    }
    return {k: parts[k] for k in order}


def _vector(e: DataFrame) -> DataFrame:
    r, parts = r4, normalized("test_pass outcome rubric human_label edit_focus cost_efficiency".split())
    vector = F.struct(
        F.col("_t.score").alias("test_pass"), F.col("_label").alias("human_label"), r(F.col("_o.score")).alias("outcome"), r(F.coalesce("_c", F.lit(0.0))).alias("cost_efficiency"),
        r(F.col("_f")).alias("edit_focus"), F.coalesce("_r.score", F.lit(0.5)).alias("rubric"), F.col("_composite").alias("composite"),
        F.struct(F.struct(*(r(v).alias(k) for k, v in parts.items())).alias("normalized"), F.col("_t.has_tests").alias("has_tests"), F.col("_feedback").alias("has_feedback"), F.col("_c").isNotNull().alias("has_cost"), F.col("_o.source").alias("outcome_source"), F.col("_r").alias("rubric")).alias("components"),
    )
    return e.withColumn("reward_vector", vector).drop("_t", "_h", "_o", "_c", "_f", "_r", "_criteria", "_feedback", "_composite", "_label", *FACTS)


def positive_human(praised: Column | None = None, label: Column | None = None) -> Column:
    return (has_label(*POSITIVE) if praised is None else praised) | F.coalesce(F.col("outcome_hint.success") == "yes", F.lit(False)) | F.coalesce(F.col("outcome.status").isin(*GOOD_STATUSES), F.lit(False)) | (F.coalesce(F.col("reward_vector.human_label") if label is None else label, F.lit(0.0)) > 0.1)


def negative_human(blamed: Column | None = None, label: Column | None = None) -> Column:
    return (has_label(*NEGATIVE) if blamed is None else blamed) | F.coalesce(F.col("outcome_hint.success") == "no", F.lit(False)) | F.coalesce(F.col("outcome.status").isin("reverted", "failed"), F.lit(False)) | (F.coalesce(F.col("reward_vector.human_label") if label is None else label, F.lit(0.0)) < -0.1)


def with_scores(episodes: DataFrame) -> DataFrame:
    """Adds ``reward_vector`` and ``validity``; the arrays are read once for both."""
    return _vector(_validity(_reward(with_facts(episodes, flags=True)), F.col("_composite"), F.col("_label")))


def with_flags(episodes: DataFrame) -> DataFrame:
    """Q1: adds ``_flags``, array of struct(code, category, severity) by the nine rules, to episodes with their reward."""
    facts = {**run_facts(), **flag_facts()}
    e = added(added(episodes, {"_runs": executed()}), facts).drop("_runs")
    return _flagged(e).drop(*FACTS)


def _flagged(e: DataFrame, composite: Column | None = None, label: Column | None = None) -> DataFrame:
    """The nine rules over facts. Columns of rewards may stand for those of the vector."""
    composite = F.col("reward_vector.composite") if composite is None else composite
    e = e.withColumns({"_pos": positive_human(F.col("_praised"), label), "_neg": negative_human(F.col("_blamed"), label)})
    last, ok, bad, verified, broken = (F.col(c) for c in ("_last", "_green", "_red", "_verified", "_broken"))
    pos, neg = F.col("_pos"), F.col("_neg")
    none, high = F.col("_ran") == 0, F.coalesce(composite, F.lit(0.0)) >= 0.5
    blocked = last.isNotNull() & ~F.coalesce(last["ok"], F.lit(False)) & (n(last["errors"]) > 0) & (n(last["passed"]) == 0) & (n(last["failed"]) == 0)
    short = F.length(F.regexp_replace(F.coalesce("intent", F.lit("")), r"^\s+|\s+$", "")) < 40
    flag = lambda code, category, severity: F.struct(F.lit(code).alias("code"), F.lit(category).alias("category"), severity.alias("severity"))
    lit = F.lit
    rules = [
        (ok & neg, flag("test_reward_false_positive", "low_coverage_tests", lit("high"))),
        (bad & pos, flag("test_reward_false_negative", "overly_strict_tests", lit("high"))),
        (pos & broken, flag("outcome_contradiction", "reward_contradiction", lit("high"))),
        (neg & verified, flag("outcome_contradiction", "reward_contradiction", lit("high"))),
        (blocked, flag("env_blocked", "low_coverage_tests", lit("medium"))),
        (high & none & ~verified & ~pos, flag("unverified_success", "low_coverage_tests", lit("medium"))),
        (F.col("_source") & ~F.col("_touched") & none & high, flag("low_coverage_proxy", "low_coverage_tests", lit("medium"))),
        (short, flag("underspecified_intent", "underspecified_intent", F.when(F.col("_rescued"), "high").otherwise("medium"))),
        (F.col("_early"), flag("misleading_early_correction", "misleading_intent", lit("medium"))),
    ]
    return e.withColumn("_flags", several(rules)).drop("_pos", "_neg")


def with_validity(episodes: DataFrame) -> DataFrame:
    """Q2-Q5: adds ``validity``: trust tier, worst severity, categories and flags."""
    facts = {**run_facts(), **flag_facts()}
    return _validity(added(added(episodes, {"_runs": executed()}), facts).drop("_runs")).drop(*FACTS)


def _validity(e: DataFrame, composite: Column | None = None, label: Column | None = None) -> DataFrame:
    e = _flagged(e, composite, label)
    high = F.exists("_flags", lambda f: f["severity"] == "high")
    some = F.size("_flags") > 0
    return e.withColumn("validity", F.struct(F.when(high, "low").when(some, "medium").otherwise("high").alias("trust"), F.when(high, "high").when(some, "medium").alias("severity"), F.array_sort(F.array_distinct(F.transform("_flags", lambda f: f["category"]))).alias("categories"), F.col("_flags").alias("flags"), F.lit("rules").alias("source"))).drop("_flags")


def merged_validity(a: Column, b: Column) -> Column:
    """Two verdicts as one: the lesser trust, the worse severity, categories and flags of both."""
    rank = dict(low=0, medium=1, high=2)
    trust = F.when(lookup(a["trust"], rank, 9) <= lookup(b["trust"], rank, 9), a["trust"]).otherwise(b["trust"])
    severity = F.when(F.coalesce(lookup(a["severity"], rank, -1), F.lit(-1)) >= F.coalesce(lookup(b["severity"], rank, -1), F.lit(-1)), a["severity"]).otherwise(b["severity"])
    source = F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(a["source"], b["source"]), lambda x: x.isNotNull()))), "+")
    both = F.struct(trust.alias("trust"), severity.alias("severity"), F.array_sort(F.array_union(a["categories"], b["categories"])).alias("categories"), F.array_union(a["flags"], b["flags"]).alias("flags"), source.alias("source"))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def trusted() -> Column:
    """an absent or empty verdict counts as trusted."""
    return F.coalesce(F.nullif("validity.trust", F.lit("")), F.lit("high")) != "low"


def is_good() -> Column:
    """F2."""
    return trusted() & ((F.coalesce("reward_vector.composite", F.lit(0.0)) >= 0.5) | F.coalesce(F.col("outcome.status").isin(*GOOD_STATUSES), F.lit(False)) | has_label(*GOOD_LABELS))


def is_bad() -> Column:
    """not the negation of good."""
    return F.coalesce(F.col("outcome.status").isin(*BAD_STATUSES), F.lit(False)) | F.coalesce("outcome.caused_regression", F.lit(False)) | has_label("wrong")


def quality_kept(minimum: float = 0.5) -> Column:
    """disregards trust."""
    return (F.coalesce("reward_vector.composite", F.lit(0.0)) >= minimum) & ~is_bad()


def finite(c: Column | str) -> Column:
    """F16."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def difficulty() -> Column:
    """C25."""
    composite = F.col("reward_vector.composite")
    base = F.when(composite.isNull(), 0.5).otherwise(1.0 - clamp(composite))
    trust = F.when(F.col("validity.trust") == "low", 0.25).when(F.col("validity.trust") == "medium", 0.1).otherwise(0.0)
    hard = F.when(F.size("reward_vector.components.rubric.hard_violations") > 0, 0.15).otherwise(0.0)
    return clamp(base + trust + hard + F.least(F.lit(0.15), 0.05 * n(F.col("stats.denials"))))


def reward_features() -> Column:
    """Seven features; the last is constant."""
    s = lambda k, d: F.least(n(F.col(f"stats.{k}")) / d, F.lit(1.0))
    return F.array(F.coalesce("reward_vector.test_pass", F.lit(0.0)), F.coalesce("reward_vector.edit_focus", F.lit(0.0)), s("file_edits", 10.0), s("tests_run", 5.0), F.when(F.size("human_feedback") > 0, 1.0).otherwise(0.0), s("file_reads", 20.0), F.lit(1.0))


def verified_deployments() -> Column:
    """Clean deployments are verified by a positive signal after them and none against; time stamps compare as texts."""
    positive = F.coalesce(F.col("outcome.status").isin(*GOOD_STATUSES), F.lit(False))

    def after(d: Column, labels: tuple) -> Column:
        return F.exists("human_feedback", lambda f: F.coalesce(f["label"].isin(*labels) & (f["ts"] != "") & (f["ts"] > d["ts"]), F.lit(False)))

    return F.transform("deployments", lambda d: d.withField("verified", F.when((d["exit_code"] == 0) & (positive | after(d, POSITIVE)) & ~after(d, NEGATIVE), F.lit(True)).otherwise(d["verified"])))
