"""Queries by name: each is a function of (session, folder of tables)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tracemill import schema
from tracemill.functions import commands, fidelity, hashing, score, summary
from tracemill.operators import analytics, datasets, library, review, rollouts, sessions, worldmodel
from tracemill.sources import logs, sinks, store, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


PARTS = ("steps", "tests", "diffs")


def deployed(spark: SparkSession, sf_dir: str, *whole: str) -> DataFrame:
    """Episodes with verified deployments; of their steps, runs and diffs only what scores read, but for those named."""
    return tables.episodes(spark, sf_dir, tuple(p for p in PARTS if p not in whole)).withColumn("deployments", score.verified_deployments())


def rewarded(spark: SparkSession, sf_dir: str, *whole: str) -> DataFrame:
    """And with rewards."""
    return score.with_reward(deployed(spark, sf_dir, *whole))


def judged(spark: SparkSession, sf_dir: str, *whole: str) -> DataFrame:
    """And with validity. Not to be filtered by a score before it is written: see ``store.materialised``."""
    return score.with_scores(deployed(spark, sf_dir, *whole))


#: What good, bad and kept episodes are told by, and what pairs are made of.
JUDGED = ("id", "ord", "intent", "reward_vector.composite", "outcome.status", "outcome.caused_regression", "human_feedback.label")
PAIRED = (*JUDGED, "validity.trust")


TASK = ("tests", "commands", "repo_state")


def narrow(e: DataFrame, *keep: str) -> DataFrame:
    """Written with the named columns and fields only, and read back, as predicates read scores. What isn't named isn't computed either."""
    parts: dict[str, list[str]] = {}
    for path in keep:
        name, _, field = path.partition(".")
        parts.setdefault(name, []).append(field)

    def part(name: str, fields: list[str]) -> Column:
        if "" in fields:
            return F.col(name)
        own = lambda c: F.struct(*(c[f].alias(f) for f in fields))
        return (F.transform(name, own) if isinstance(e.schema[name].dataType, ArrayType) else own(F.col(name))).alias(name)

    return store.materialised(e.select(*(part(*p) for p in parts.items())))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pairs and splits read of scored episodes, written."""
    return narrow(judged(spark, sf_dir), *PAIRED)


def conversation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.steps(spark, sf_dir)
    return s.withColumn("intent", F.first(F.when(F.col("role") == "user", F.col("observation")), ignorenulls=True).over(Window.partitionBy("episode_id").orderBy("index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


# scores


@query
def terminal_test_signal(spark, sf_dir):
    return score.with_test_signal(tables.episodes(spark, sf_dir)).select("id", "_t.score", "_t.has_tests", "_t.blocked")


@query
def human_label_score(spark, sf_dir):
    return score.with_human_label(tables.episodes(spark, sf_dir)).select("id", score.r4(F.col("_h")).alias("human_label"))


@query
def outcome_score(spark, sf_dir):
    e = tables.episodes(spark, sf_dir).withColumn("deployments", score.verified_deployments())
    return score.with_outcome(e).select("id", score.r4(F.col("_o.score")).alias("score"), "_o.source")


@query
def cost_and_focus(spark, sf_dir):
    return tables.episodes(spark, sf_dir).select("id", score.r4(score.cost_efficiency()).alias("cost_efficiency"), score.r4(score.edit_focus()).alias("edit_focus"))


@query
def deploy_verify(spark, sf_dir):
    d = tables.episodes(spark, sf_dir).select("id", F.explode(score.verified_deployments()).alias("d"))
    return d.select("id", "d.target_env", "d.exit_code", "d.verified")


@query
def rubric_score(spark, sf_dir):
    r = score.with_rubric(score.with_test_signal(tables.episodes(spark, sf_dir))).select("id", F.col("_r").alias("r"))
    return r.select("id", "r.score", "r.base", "r.hard_pass", F.array_join("r.hard_violations", ",").alias("hard_violations"))


@query
def rubric_criteria(spark, sf_dir):
    r = score.with_rubric(score.with_test_signal(tables.episodes(spark, sf_dir))).select("id", F.explode_outer("_r.criteria").alias("c"))  # never empty; of the inner kind a filter on all the scores would follow
    return r.where("c.satisfied is not null").select("id", F.col("c.id").alias("criterion"), "c.kind", "c.weight", "c.satisfied")


@query
def reward_vector(spark, sf_dir):
    r = rewarded(spark, sf_dir).select("id", "reward_vector")
    return r.select("id", *(F.col(f"reward_vector.{k}").alias(k) for k in ("test_pass", "human_label", "outcome", "cost_efficiency", "edit_focus", "rubric", "composite")), F.col("reward_vector.components.outcome_source").alias("outcome_source"))


@query
def validity_flags(spark, sf_dir):
    # not the inner kind, which filters by the flags' number and computes them again for it
    f = judged(spark, sf_dir).select("id", F.explode_outer("validity.flags").alias("f")).where("f is not null")
    return f.select("id", "f.code", "f.category", "f.severity")


@query
def trust_tiers(spark, sf_dir):
    return judged(spark, sf_dir).select("id", "validity.trust", "validity.severity", F.array_join("validity.categories", ",").alias("categories"))


@query
def audit_report(spark, sf_dir):
    return analytics.audit(narrow(judged(spark, sf_dir), "validity.trust", "validity.categories"))


@query
def good_and_bad(spark, sf_dir):
    return judged(spark, sf_dir).select("id", score.trusted().alias("trusted"), score.is_good().alias("good"), score.is_bad().alias("bad"))


@query
def quality_filter(spark, sf_dir):
    return narrow(rewarded(spark, sf_dir), *JUDGED).where(score.quality_kept()).select("id", F.col("reward_vector.composite").alias("composite"))


@query
def quality_stats(spark, sf_dir):
    return analytics.quality_stats(narrow(rewarded(spark, sf_dir), *JUDGED))


@query
def episode_difficulty(spark, sf_dir):
    return judged(spark, sf_dir).select("id", score.r4(score.difficulty()).alias("difficulty"))


@query
def reward_features(spark, sf_dir):
    f = rewarded(spark, sf_dir).select("id", score.reward_features().alias("f"))
    return f.select("id", *(F.round(F.col("f")[i], 6).alias(f"f{i}") for i in range(7)))


@query
def reward_model_eval(spark, sf_dir):
    """The model is fitted on the sums of products and evaluated on the rows it was fitted on."""
    e = store.materialised(rewarded(spark, sf_dir).select(score.reward_features().alias("f"), F.col("reward_vector.composite").alias("y")), "features")
    model = analytics.fit_reward_model(e, F.col("f"), F.col("y"))
    return analytics.evaluation(e.select("y", analytics.predicted(F.col("f"), model["weights"] or [0.0] * 7).alias("p")), "p", "y").withColumn("r2", F.lit(model["r2"]))


@query
def feature_correlation(spark, sf_dir):
    e = rewarded(spark, sf_dir)
    return e.agg(F.count("*").alias("n"), F.round(analytics.pearson("reward_vector.edit_focus", "reward_vector.composite", 0.0), 6).alias("pearson"), F.round(F.avg(F.abs(F.col("reward_vector.edit_focus") - F.col("reward_vector.composite"))), 6).alias("mae"))


@query
def validation_errors(spark, sf_dir):
    e = tables.episodes(spark, sf_dir)
    bent = e.withColumn("outcome", F.col("outcome").withField("status", F.when(F.col("ord") % 10 == 0, "lost").otherwise(F.col("outcome.status")))).withColumn("intent", F.when(F.col("ord") % 15 != 0, F.col("intent")))
    return bent.select("id", F.explode(schema.validation_errors()).alias("error"))


# datasets


@query
def dpo_pairs(spark, sf_dir):
    return datasets.dpo_pairs(scored(spark, sf_dir))


@query
def dpo_pairs_strict(spark, sf_dir):
    return datasets.dpo_pairs(scored(spark, sf_dir), strict=True)


@query
def dpo_texts(spark, sf_dir):
    e = scored(spark, sf_dir)
    p = datasets.with_trajectories(datasets.dpo_pairs(e), tables.episodes(spark, sf_dir))
    return p.select("chosen_id", "rejected_id", "prompt", F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"))


@query
def preference_pairs(spark, sf_dir):
    return datasets.preference_pairs(scored(spark, sf_dir))


@query
def trajectory_text(spark, sf_dir):
    return tables.episodes(spark, sf_dir).select("id", datasets.trajectory().alias("trajectory"))


@query
def reward_rows(spark, sf_dir):
    return datasets.reward_rows(rewarded(spark, sf_dir, "steps")).select("episode_id", "prompt", F.length("trajectory").alias("trajectory_chars"), "scalar_reward")


@query
def sft_segments(spark, sf_dir):
    return datasets.sft_segments(narrow(judged(spark, sf_dir, "steps"), *PAIRED, "steps"))


@query
def flat_parquet(spark, sf_dir):
    return datasets.flat_rows(rewarded(spark, sf_dir, *PARTS))


@query
def index_rows(spark, sf_dir):
    """P4/SNK3: rows written twice; the later version of each stays."""
    e = rewarded(spark, sf_dir)
    i = datasets.index_rows(e).withColumn("version", F.lit(1))
    again = i.where(F.substring("id", -1, 1) == "3").withColumn("version", F.lit(2)).withColumn("intent", F.concat(F.lit("again: "), F.col("intent")))
    return datasets.latest(i.unionByName(again), "id", "version").select("id", "created_at", "agent", "intent", "branch", "outcome", "composite_reward", "tests_run", "file_edits", "version")


@query
def rl_transitions(spark, sf_dir):
    """Conversation turns as transitions."""
    t = datasets.transitions(tables.steps(spark, sf_dir), F.lit(1.0))
    return t.select("episode_id", "step_index", "prev_observation", "type", "next_observation", "is_first", "done", "reward", "discount")


@query
def rlds_steps(spark, sf_dir):
    r = datasets.rlds(tables.steps(spark, sf_dir), F.lit(0.5))
    return r.select("episode_id", F.size("steps").alias("n_steps"), F.aggregate("steps", F.lit(0.0), lambda a, s: a + s["reward"]).alias("total_reward"), F.array_join(F.transform("steps", lambda s: s["type"]), ",").alias("types"), F.length(F.array_join(F.transform("steps", lambda s: s["prev_observation"]), "")).alias("prev_chars"))


@query
def unique_prompts(spark, sf_dir):
    c = tables.table(spark, sf_dir, "conversations").where("role = 'user'")
    return datasets.unique_prompts(c, "text", "conv_id", "turn").select("conv_id", "turn", "text")


@query
def task_eligibility(spark, sf_dir):
    return judged(spark, sf_dir, "tests").select("id", datasets.skip_reason().alias("skip"), datasets.skip_reason(True).alias("skip_remote"))


@query
def captured_verifier(spark, sf_dir):
    v = tables.episodes(spark, sf_dir).select("id", datasets.verifier().alias("v")).where("v is not null")
    return v.select("id", "v.command", "v.framework", "v.passed", "v.failed", "v.total", datasets.base_image(F.col("v.framework"), F.col("v.command")).alias("image"), datasets.portable(F.col("v.command")).alias("portable"))


@query
def summaries(spark, sf_dir):
    s = summary.summarised(tables.episodes(spark, sf_dir))
    j = lambda c: F.array_join(c, "; ").alias(c)
    return s.select("episode_id", j("what_changed"), j("tests_missing"), j("risky_edits"), "suggested_pr_title", j("follow_up_todos"))


@query
def summary_text(spark, sf_dir):
    return summary.summarised(tables.episodes(spark, sf_dir)).select("episode_id", F.length(summary.description()).alias("chars"))


# world model


def turn_samples(spark, sf_dir, budget: int = 4000) -> DataFrame:
    s = conversation_steps(spark, sf_dir)
    return worldmodel.samples(s, F.concat(F.coalesce("tool", "type"), F.lit(": "), F.substring("observation", 1, 200)), budget)


@query
def wm_samples(spark, sf_dir):
    return turn_samples(spark, sf_dir).select("episode_id", F.col("index").alias("turn_index"), "action", "history", "prev_observation", "target_observation")


@query
def wm_one_per_trajectory(spark, sf_dir):
    return worldmodel.one_per_trajectory(turn_samples(spark, sf_dir)).select("episode_id", F.col("index").alias("turn_index"), "action")


@query
def wm_messages(spark, sf_dir):
    m = turn_samples(spark, sf_dir).select("episode_id", F.col("index").alias("turn_index"), F.posexplode(worldmodel.messages()).alias("place", "m"))
    return m.select("episode_id", "turn_index", "place", "m.role", F.md5("m.content").alias("content_md5"))


@query
def wm_source_keys(spark, sf_dir):
    return tables.episodes(spark, sf_dir).select("id", worldmodel.source_key().alias("source"))


@query
def ood_split(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", "source", worldmodel.ood_split(F.col("source")).alias("split"))


def observations(spark, sf_dir) -> DataFrame:
    """Documents as real observations; a prediction is a bent copy of one."""
    d = tables.table(spark, sf_dir, "documents")
    real = F.concat(F.when(F.col("doc_id") % 5 == 0, "2024-01-02 03:04:05 pid=77 took 12ms ").when(F.col("doc_id") % 7 == 0, "error: not found ").otherwise(""), F.col("text"))
    fake = F.when(F.col("doc_id") % 4 == 0, real).when(F.col("doc_id") % 4 == 1, F.substring(real, 1, 150)).when(F.col("doc_id") % 4 == 2, "").otherwise(F.concat(F.lit("2024-09-09 09:09:09 "), F.substring(real, 20, 200), F.lit("\nmore")))
    return d.select("doc_id", F.col("source"), F.col("lang").alias("domain"), real.alias("real"), fake.alias("fake"))


@query
def fidelity_score(spark, sf_dir):
    return fidelity.scored(observations(spark, sf_dir), "fake", "real").select("doc_id", "score.*")


@query
def bench_grouping(spark, sf_dir):
    return worldmodel.bench(fidelity.scored(observations(spark, sf_dir), "fake", "real").select("domain", "source", "score"))


@query
def trajectory_scores(spark, sf_dir):
    """Mean, last value and drift of a source's scores in the order of documents."""
    s = fidelity.scored(observations(spark, sf_dir), "fake", "real").select("source", "doc_id", F.col("score.composite").alias("c"))
    return s.groupBy("source").agg(F.count("*").alias("n"), score.r4(F.avg("c")).alias("mean_composite"), F.max_by("c", "doc_id").alias("final_composite"), score.r4(F.min_by("c", "doc_id") - F.max_by("c", "doc_id")).alias("drift"))


@query
def blended_scores(spark, sf_dir):
    o = fidelity.scored(observations(spark, sf_dir), "fake", "real", "rule").withColumn("judge", F.struct(*((F.when(F.col("doc_id") % 3 == i % 3, (F.col("doc_id") % 10) / 10)).alias(k) for i, k in enumerate(fidelity.WEIGHTS))))
    return o.select("doc_id", fidelity.blend(F.col("rule"), F.col("judge"))["composite"].alias("composite"))


@query
def mask_runtime(spark, sf_dir):
    return observations(spark, sf_dir).select("doc_id", fidelity.mask_runtime(F.col("real")).alias("masked"))


@query
def classify_content(spark, sf_dir):
    return observations(spark, sf_dir).select("doc_id", fidelity.classify(F.col("real")).alias("c")).select("doc_id", "c.*")


@query
def text_features(spark, sf_dir):
    f = tables.table(spark, sf_dir, "documents").select("doc_id", fidelity.text_features(F.col("text")).alias("f"))
    return f.select("doc_id", *(F.round(f"f.{k}", 6).alias(k) for k in analytics.NAMES))


@query
def turing_test(spark, sf_dir):
    o = observations(spark, sf_dir)
    return worldmodel.turing(o, fidelity.realness(F.col("real")), fidelity.realness(F.col("fake")), F.col("doc_id").cast("string"))


@query
def router_probability(spark, sf_dir):
    """Junk of labelled documents told from text features."""
    d = tables.table(spark, sf_dir, "documents").join(tables.table(spark, sf_dir, "labels"), "doc_id")
    names = analytics.NAMES
    rows = d.select("doc_id", fidelity.text_features(F.col("text")).alias("t"), (1.0 - F.col("quality")).alias("y")).select("doc_id", F.array(*(F.col(f"t.{k}") for k in names)).alias("f"), "y")
    model = analytics.learn_router(rows)
    return rows.select("doc_id", F.round(analytics.probability(F.col("f"), model), 4).alias("probability"))


# sessions


@query
def session_stats(spark, sf_dir):
    return sessions.stats(tables.session_events(spark, sf_dir))


@query
def session_steps(spark, sf_dir):
    return sessions.steps(tables.session_events(spark, sf_dir)).select("session_id", "seq", "index", "type", "intent")


@query
def touched_files(spark, sf_dir):
    return sessions.touched_files(tables.session_events(spark, sf_dir))


@query
def session_segments(spark, sf_dir):
    return sessions.segmented(tables.session_events(spark, sf_dir)).select("session_id", "seq", "segment")


@query
def feedback_asof(spark, sf_dir):
    ev = tables.session_events(spark, sf_dir)
    starts = sessions.segmented(ev).groupBy("session_id", "segment").agg(F.min("ts").alias("start"))
    fb = ev.where("type = 'denial'").select("session_id", "seq", F.when(F.col("seq") % 9 != 0, F.col("ts") - F.expr("interval 3 hours")).alias("ts"))
    return sessions.feedback_segments(fb, starts).select("session_id", "seq", "segment")


@query
def feedback_turns(spark, sf_dir):
    st = sessions.steps(tables.session_events(spark, sf_dir))
    return sessions.turns(st).select("session_id", "turn", "index", "prompt", "edits", "commands", "reads", "denials")


@query
def rendered_turns(spark, sf_dir):
    return sessions.rendered_turns(sessions.turns(sessions.steps(tables.session_events(spark, sf_dir))))


@query
def command_classes(spark, sf_dir):
    s = sessions.shell(tables.session_events(spark, sf_dir))
    return s.select("session_id", "seq", commands.test_framework(F.col("command")).alias("framework"), "deploy.method", "is_test", "verified")


@query
def target_environments(spark, sf_dir):
    """C10-C11 need look-around expressions, which the oracle's dialect lacks."""
    s = sessions.shell(tables.session_events(spark, sf_dir)).where("deploy is not null")
    return s.groupBy("command", "deploy.method", "deploy.target_env").agg(F.count("*").alias("n"))


@query
def test_runs(spark, sf_dir):
    s = sessions.shell(tables.session_events(spark, sf_dir)).where("run is not null")
    return s.select("session_id", "seq", "run.framework", "run.passed", "run.failed", "run.skipped", "run.errors", "run.total", "run.ok")


@query
def ordinal_backfill(spark, sf_dir):
    ev = tables.session_events(spark, sf_dir).where("type = 'shell_command'")
    records = ev.where("seq % 101 <> 0").select("session_id", F.col("seq").alias("ord"), "command", (F.col("seq") % 3).cast("int").alias("exit_code"))
    return sessions.ordinal_backfill(ev.select("session_id", "seq", "command", "exit_code"), records)


@query
def reconstructed_failures(spark, sf_dir):
    ev = tables.session_events(spark, sf_dir).where("type = 'shell_command'")
    failed = F.col("seq") % 4 == 1
    pre = ev.select("session_id", (F.col("seq") * 2).alias("seq"), "command", F.lit("tool_pre").alias("type"))
    post = ev.where(~failed | (F.col("seq") % 29 == 0)).select("session_id", (F.col("seq") * 2 + 1).alias("seq"), "command", F.lit("shell_command").alias("type"))
    records = ev.select("session_id", F.col("seq").alias("ord"), "command", failed.alias("is_error"), F.lit(1).alias("exit_code"), "output")
    return sessions.reconstructed_failures(pre.union(post), records)


@query
def merged_feedback(spark, sf_dir):
    ev = tables.session_events(spark, sf_dir)
    f = lambda kind: ev.where(f"source_type = '{kind}'").select("session_id", F.col("seq").alias("ord"), F.concat(F.lit("label"), (F.col("k") % 4).cast("string")).alias("label"), F.when(F.col("k") % 5 != 0, F.col("k") % 3).alias("evidence_step_index"))
    return sessions.merged_feedback(f("signup"), f("error"))


@query
def resolved_intents(spark, sf_dir):
    ev = tables.hooked_events(spark, sf_dir)
    meta = ev.where("session_id % 3 = 0").select("session_id").distinct().withColumn("intent", F.when(F.col("session_id") % 2 == 0, F.concat(F.lit("task "), F.col("session_id").cast("string"))).otherwise(""))
    return sessions.resolved(ev, meta)


@query
def built_episodes(spark, sf_dir):
    """Sizes of the parts of each session's episode."""
    b = sessions.built(tables.session_events(spark, sf_dir))
    return b.select("session_id", "id", "intent", F.size("steps").alias("n_steps"), F.coalesce(F.size("commands"), F.lit(0)).alias("n_commands"), F.coalesce(F.size("tests"), F.lit(0)).alias("n_tests"), F.coalesce(F.size("deployments"), F.lit(0)).alias("n_deployments"), F.coalesce(F.size("diffs"), F.lit(0)).alias("n_diffs"), F.col("stats.tool_calls").alias("tool_calls"))


# telemetry

TOKENS, COST = logs.TOKEN_METRIC, logs.COST_METRIC


def otlp_bodies(spark, sf_dir) -> DataFrame:
    """Events as OTLP bodies: clicks and views as tokens, purchases as cost; sessions on points or on resources."""
    ev = tables.table(spark, sf_dir, "events")
    sid = F.concat(F.lit("s"), F.col("user_id").cast("string"))
    attr = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    own = F.when(F.col("event_id") % 2 == 0, F.array(attr("session.id", sid), attr("type", F.when(F.col("event_type") == "click", "input").otherwise("output")))).otherwise(F.array(attr("type", F.when(F.col("event_type") == "click", "input").otherwise("output"))))
    res = F.when(F.col("event_id") % 2 == 1, F.array(attr("session.id", sid))).otherwise(F.array(attr("session.id", F.lit("other"))))
    point = F.struct(F.when(F.col("event_type") != "purchase", F.floor("value").cast("string")).alias("asInt"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("asDouble"), own.alias("attributes"))
    name = F.when(F.col("event_type").isin("click", "view"), TOKENS).when(F.col("event_type") == "purchase", COST).otherwise("other.metric")
    sum_ = F.when(F.col("event_id") % 3 != 0, F.struct(F.array(point).alias("dataPoints")))
    gauge = F.when(F.col("event_id") % 3 == 0, F.struct(F.array(point).alias("dataPoints")))
    metric = F.struct(name.alias("name"), sum_.alias("sum"), gauge.alias("gauge"))
    body = F.struct(F.array(F.struct(F.struct(res.alias("attributes")).alias("resource"), F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))
    return ev.select(F.to_json(body).alias("body"))


@query
def usage_aggregate(spark, sf_dir):
    u = logs.usage(logs.usage_points(otlp_bodies(spark, sf_dir)))
    return u.select("session_id", "input_tokens", "output_tokens", F.round("cost_usd", 4).alias("cost_usd"))


@query
def usage_merge(spark, sf_dir):
    u = logs.usage(logs.usage_points(otlp_bodies(spark, sf_dir)))
    old = u.where("input_tokens % 2 = 0").select("session_id", F.lit(10).cast("bigint").alias("input_tokens"), F.lit(5).cast("bigint").alias("output_tokens"), F.lit(0.5).alias("cost_usd"))
    m = logs.merged_usage(old, u)
    return m.select("session_id", "input_tokens", "output_tokens", F.round("cost_usd", 4).alias("cost_usd"))


@query
def hook_events(spark, sf_dir):
    ev = tables.table(spark, sf_dir, "events")
    tool = F.element_at(F.array(*map(F.lit, "Bash Edit Write Read DeleteFile Grep".split())), (F.col("event_id") % 6).cast("int") + 1)
    hook = F.when(F.col("event_type") == "signup", "UserPromptSubmit").when(F.col("event_type") == "view", "PreToolUse").when(F.col("event_type") == "error", "Stop").otherwise("PostToolUse")
    answer = F.struct(F.when(F.col("event_id") % 11 == 0, "Permission denied").otherwise(F.concat(F.lit("ran "), F.col("event_id").cast("string"))).alias("stdout"), F.when(F.col("event_id") % 4 == 0, "warn").otherwise("").alias("stderr"), F.when(F.col("event_id") % 5 == 0, "x").otherwise((F.col("event_id") % 3).cast("string")).alias("exit_code"), (F.col("event_id") % 10 == 0).alias("interrupted"))
    payload = F.to_json(F.struct(F.col("user_id").cast("string").alias("session_id"), hook.alias("hook_event_name"), tool.alias("tool_name"), F.struct(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), F.lit("make all").alias("command")).alias("tool_input"), answer.alias("tool_response"), F.lit("do it").alias("prompt")))
    h = logs.events_of_hooks(ev.select(payload.alias("payload"), F.col("event_id").alias("seq")))
    return h.select("session_id", "seq", "type", "tool_name", "prompt", "response", "approved", "command", "exit_code", "file_path")


# splits, decisions, regressions


@query
def hash_split(spark, sf_dir):
    return tables.episodes(spark, sf_dir).select("id", F.when(hashing.held_out(F.col("id")), "holdout").otherwise("train").alias("split"))


@query
def loop_partition(spark, sf_dir):
    return analytics.partition(scored(spark, sf_dir)).select("id", "split")


@query
def ranked_holdout(spark, sf_dir):
    p = analytics.partition(narrow(judged(spark, sf_dir), *PAIRED, "reward_vector.edit_focus")).where("split = 'holdout'")
    return analytics.ranked_holdout(p.select("id", F.when(F.col("ord") % 3 != 0, F.col("reward_vector.edit_focus")).alias("score"))).select("id", "score")


@query
def promote_decision(spark, sf_dir):
    e = narrow(rewarded(spark, sf_dir), "id", "ord", "reward_vector.composite", "reward_vector.rubric").where(hashing.held_out(F.col("id")))
    return analytics.promotion(e.select(F.when(F.col("ord") % 7 != 0, F.col("reward_vector.composite")).alias("candidate"), F.col("reward_vector.rubric").alias("base")))


@query
def correlate(spark, sf_dir):
    e = narrow(rewarded(spark, sf_dir), "id", "ord", "reward_vector.composite", "reward_vector.edit_focus")
    a = e.select("id", F.when(F.col("ord") % 11 != 0, F.col("reward_vector.edit_focus")).alias("x"))
    return analytics.correlate(a, e.where("ord % 5 <> 0").select("id", F.col("reward_vector.composite").alias("y")))


@query
def average_ranks(spark, sf_dir):
    return analytics.with_ranks(tables.table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size")


@query
def stratified_split(spark, sf_dir):
    e = tables.episodes(spark, sf_dir)
    return analytics.stratified_split(e.select("id", F.concat("outcome.status", F.lit("-"), "repo_state.branch").alias("class")), per_class=5)


@query
def lift_rollup(spark, sf_dir):
    e = narrow(rewarded(spark, sf_dir), "outcome.status", "reward_vector.composite", "reward_vector.rubric")
    return analytics.lift(e.select(F.col("outcome.status").alias("class"), (F.col("reward_vector.rubric") >= 0.6).alias("base"), (F.col("reward_vector.composite") >= 0.5).alias("tuned")))


@query
def regression_map(spark, sf_dir):
    e = tables.episodes(spark, sf_dir)
    blame = e.where("ord % 40 = 1").select(F.col("outcome.commit").alias("sha"), F.lit("x").alias("path"), (F.col("ord") % 13 + 1).alias("blamed_lines"))
    files = spark.range(0, 50, 10).select(F.concat(F.lit("src/m"), F.col("id").cast("string"), F.lit(".py")).alias("file"))
    return analytics.implicated(e, analytics.culprits(blame.union(blame.where("blamed_lines > 5"))), files)


@query
def should_refresh(spark, sf_dir):
    return tables.episodes(spark, sf_dir).select("id", analytics.should_refresh().alias("refresh"))


@query
def pull_request_outcomes(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    checks = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, F.array(F.lit("SUCCESS"), F.lit("SUCCESS"))).when(k % 5 == 2, F.array(F.lit("SUCCESS"), F.lit("FAILURE"))).when(k % 5 == 3, F.array(F.lit("SUCCESS"), F.lit(None).cast("string")))
    p = o.select(k.alias("o_orderkey"), F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("CLOSED").alias("state"), F.when(F.col("o_orderstatus") == "F", True).alias("merged"), F.lit(None).cast("string").alias("merged_at"), checks.alias("checks"), F.lit("u").alias("url"), k.alias("number"))
    return p.select("o_orderkey", analytics.outcome_of_pull_request().alias("x")).select("o_orderkey", "x.status", "x.merged", "x.pr_state", "x.ci_status")


@query
def running_baseline(spark, sf_dir):
    ev = tables.table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return analytics.running_baseline(ev, "user_id", "event_id", "value").select("event_id", F.round("baseline", 6).alias("baseline"))


def order_lines(spark, sf_dir) -> DataFrame:
    """Arrays of line values by order, in a fixed order."""
    li = tables.table(spark, sf_dir, "lineitem")
    x = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_returnflag")))
    return li.groupBy("l_orderkey").agg(x.alias("x"))


@query
def gae_advantages(spark, sf_dir):
    o = order_lines(spark, sf_dir)
    part = lambda f: F.transform("x", f)
    a = analytics.gae(part(lambda v: v["l_discount"]), part(lambda v: v["l_tax"]), part(lambda v: F.when(v["l_returnflag"] == "N", 0).otherwise(1)), 1.0, 1.0)
    return o.select("l_orderkey", F.posexplode(a).alias("pos", "advantage")).select("l_orderkey", "pos", F.round("advantage", 6).alias("advantage"))


@query
def dis_masks(spark, sf_dir):
    o = order_lines(spark, sf_dir)
    part = lambda f: F.transform("x", f)
    m = analytics.dis_mask(part(lambda v: v["l_discount"]), part(lambda v: v["l_quantity"] / 100), part(lambda v: F.lit(0.2)))
    return o.select("l_orderkey", m.alias("m")).select("l_orderkey", "m.masked", F.round(F.aggregate("m.kept", F.lit(0.0), lambda a, v: a + v), 6).alias("kept_sum"))


@query
def jaccard_overlap(spark, sf_dir):
    files = F.array_distinct(F.transform("diffs", lambda d: d["file"]))
    edited = F.array_distinct(F.filter(F.transform("steps", lambda s: F.get_json_object(s["input"], "$.file_path")), lambda x: x.isNotNull()))
    e = score.with_test_signal(tables.episodes(spark, sf_dir)).withColumns({"files": files, "edited": edited}).withColumn("j", analytics.jaccard(F.col("files"), F.col("edited")))
    return e.select("id", F.round("j", 6).alias("jaccard"), analytics.replay_score(F.col("_t.score"), F.col("j")).alias("replay"))


@query
def action_formats(spark, sf_dir):
    s = datasets.exploded_steps(tables.episodes(spark, sf_dir))
    line = datasets.action_line(F.col("type"), F.col("tool"), F.col("input"), F.col("cwd"))
    return s.select("episode_id", F.col("index").alias("step_index"), line.alias("line"), F.round(analytics.action_format(line), 4).alias("reward"))


@query
def feedback_labels(spark, sf_dir):
    """Labels of an episode, its feedback and its outcome, as one sorted set."""
    e = tables.episodes(spark, sf_dir)
    labels = F.array_sort(F.array_distinct(F.concat("labels", F.transform("human_feedback", lambda f: f["label"]), F.when(F.coalesce("outcome.caused_regression", F.lit(False)), F.array(F.lit("regression"))).otherwise(F.array().cast("array<string>")))))
    return e.select("id", F.array_join(labels, ",").alias("labels"))


@query
def patch_parts(spark, sf_dir):
    p = tables.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("*** Begin Patch\n*** Add File: a/"), "p_name", F.lit("\n+x\n*** Delete File: b\n*** Update File: c\n-y\n+z\n*** End Patch")).alias("patch"))
    return logs.patch_parts(p).select("p_partkey", "op", "path", "body", "tool")


@query
def diff_files(spark, sf_dir):
    p = tables.table(spark, sf_dir, "part")
    patch = F.concat(F.lit("diff --git a/f"), F.col("p_size").cast("string"), F.lit(" b/f\n--- a/f\n+++ b/f\n@@ -1,2 +1,3 @@\n-old\n+new\n+"), F.col("p_name"), F.lit("\ndiff --git a/g b/g\nnew file mode 100644\n--- /dev/null\n+++ b/g\n@@ -0,0 +1 @@\n+x\n"))
    d = p.select("p_partkey", F.explode(logs.diff_files(patch)).alias("d"), F.size(logs.old_ranges(patch)).alias("n_ranges"))
    return d.select("p_partkey", "d.file", "d.status", F.col("d.additions").cast("int").alias("additions"), F.col("d.deletions").cast("int").alias("deletions"), "n_ranges")


@query
def first_json_objects(spark, sf_dir):
    ev = tables.table(spark, sf_dir, "events")
    return ev.select("event_id", logs.first_json_object(F.concat(F.lit("answer: {bad} "), F.col("props"), F.lit(" end}"))).alias("object"))


# exports and rollouts


@query
def task_bundles(spark, sf_dir):
    return sinks.task_files(narrow(judged(spark, sf_dir, "diffs", "tests"), *PAIRED, *TASK, "diffs.unified")).select("path", F.md5("content").alias("content_md5"))


@query
def prompt_rows(spark, sf_dir):
    return sinks.prompt_rows(narrow(judged(spark, sf_dir, "tests"), *PAIRED, *TASK)).select("episode_id", "composite_reward", "portable", F.get_json_object("label", "$.test_command").alias("test_command"), F.get_json_object("label", "$.base_commit").alias("base_commit"))


@query
def dataset_manifest(spark, sf_dir):
    return sinks.manifest(datasets.dpo_pairs(scored(spark, sf_dir)), "chosen_id", "rejected_id").select("rows", "episodes")


@query
def rollout_scores(spark, sf_dir):
    """Rollouts of the predictor that repeats what it said, scored turn by turn."""
    s = turn_samples(spark, sf_dir).select("episode_id", F.col("index").alias("turn_index"), "intent", "action", "target_observation")
    r = rollouts.rollout(s, rollouts.named("prefix"), max_turns=5)
    scored_ = fidelity.scored(r, "predicted", "target").select("episode_id", F.col("score.composite").alias("composite"))
    return scored_.groupBy("episode_id").agg(F.count("*").alias("n"), F.round(F.avg("composite"), 4).alias("mean_composite"))


@query
def flat_export(spark, sf_dir):
    """SNK6: written as Parquet and read back."""
    path = f"{store.shared_folder(spark)}/export-{uuid.uuid4().hex}"
    sinks.export(rewarded(spark, sf_dir, *PARTS), "parquet", path)
    return spark.read.parquet(path)


# reviews


@query
def verdict_majority(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem")
    cats = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("misleading_intent"), F.lit("other"))).otherwise(F.array(F.lit("low_coverage_tests"), F.lit("misleading_intent")))
    votes = li.select(F.col("l_orderkey").alias("id"), (F.col("l_returnflag") != "R").alias("trustworthy"), cats.alias("categories"), F.col("l_discount").alias("confidence"))
    return review.verdict_majority(votes)


@query
def train_valid_split(spark, sf_dir):
    return review.batches(review.train_valid(tables.table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", "p_partkey"), 8)


@query
def gate_report(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    runner = F.explode(F.array(*(F.struct(F.lit(n).alias("runner"), c.alias("ok"), s.alias("score")) for n, c, s in (("oracle", F.col("o_orderkey") % 5 != 0, F.lit(1.0)), ("empty", F.col("o_orderkey") % 7 == 0, (F.col("o_orderkey") % 3) / 2), ("broken", F.col("o_orderkey") % 11 == 0, F.lit(0.1))))))
    return review.gate(o.select(F.col("o_orderkey").alias("task"), runner.alias("r")).select("task", "r.*"))


@query
def clipped_texts(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.md5(review.clipped(F.col("text"), 400)).alias("clipped_md5"))


@query
def file_kinds(spark, sf_dir):
    d = tables.episodes(spark, sf_dir).select(F.explode("diffs").alias("d")).select(F.col("d.file").alias("file")).distinct()
    return d.select("file", review.noise_path(F.col("file")).alias("noise"), review.verifier_file(F.col("file")).alias("verifier"), summary.is_test_file(F.col("file")).alias("test"), summary.is_source_file(F.col("file")).alias("source"))


@query
def replay_ids(spark, sf_dir):
    return tables.episodes(spark, sf_dir).select("id", review.replay_id(F.col("id")).alias("replay_id"))


@query
def escalations(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", review.escalates(F.col("text"), F.col("doc_id") % 10 == 0, 3000).alias("escalate"))


@query
def applied_regressions(spark, sf_dir):
    e = tables.episodes(spark, sf_dir).withColumn("outcome", F.col("outcome").withField("regression_commits", F.when(F.col("ord") % 17 == 0, F.array(F.lit("zz")))))
    hits = e.where("ord % 12 = 0").select("id", F.concat(F.lit("c"), (F.col("ord") % 5).cast("string")).alias("commit"))
    r = review.with_regressions(e, hits)
    return r.select("id", F.col("outcome.caused_regression").alias("caused_regression"), F.array_join("outcome.regression_commits", ",").alias("commits"), F.array_join("labels", ",").alias("labels"))


@query
def turn_notices(spark, sf_dir):
    ev = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "turn-start").when(F.col("event_type") == "error", "turn-complete").otherwise("other").alias("kind"), F.when(F.col("event_id") % 2 == 0, "go").alias("prompt"))
    return review.notifications(ev)


# the store, links, reports


def built_hooked(spark, sf_dir) -> DataFrame:
    return sessions.built(tables.hooked_events(spark, sf_dir), tables.session_meta(spark, sf_dir))


@query
def built_heads(spark, sf_dir):
    """What an episode takes of its session's meta data, and its counts."""
    b = built_hooked(spark, sf_dir)
    return b.select("session_id", "id", "agent", "intent", "created_at", F.col("repo_state.branch").alias("branch"), F.array_join("labels", ",").alias("labels"), "diff_source", F.col("outcome.status").alias("status"), *(F.col(f"stats.{k}").alias(k) for k in ("tool_calls", "file_reads", "file_edits", "shell_commands", "tests_run", "approvals", "denials", "input_tokens", "output_tokens", "cost_usd")))


@query
def built_steps(spark, sf_dir):
    """The steps of sessions' episodes with all they hold."""
    s = built_hooked(spark, sf_dir).select("session_id", F.explode("steps").alias("s"))
    return s.select("session_id", *(F.col(f"s.{k}").alias(k) for k in ("index", "type", "tool", "intent", "input", "observation", "approved", "cwd")))


@query
def built_commands(spark, sf_dir):
    """Commands with folder and excerpt, relative to the repository."""
    c = built_hooked(spark, sf_dir).select("session_id", F.posexplode("commands").alias("place", "c"))
    return c.select("session_id", "place", *(F.col(f"c.{k}").alias(k) for k in ("command", "cwd", "exit_code", "output_excerpt", "is_test", "reconstructed")))


@query
def built_files(spark, sf_dir):
    """Changed files relative to the repository, else to the session's folder."""
    return built_hooked(spark, sf_dir).select("session_id", F.explode("diffs").alias("d")).select("session_id", "d.file", "d.status", "d.additions")


@query
def session_rewards(spark, sf_dir):
    """E1/R5/Q5 on captured sessions."""
    e = store.materialised(sessions.with_scores(built_hooked(spark, sf_dir)))
    return e.select("id", F.col("reward_vector.composite").alias("composite"), F.col("reward_vector.test_pass").alias("test_pass"), F.col("reward_vector.rubric").alias("rubric"), "validity.trust", F.array_join("labels", ",").alias("labels"))


@query
def session_sft(spark, sf_dir):
    """E8 on captured sessions."""
    return datasets.sft_segments(store.materialised(sessions.with_scores(built_hooked(spark, sf_dir))))


@query
def session_summaries(spark, sf_dir):
    """U1 on captured sessions."""
    s = summary.summarised(built_hooked(spark, sf_dir))
    return s.select("episode_id", F.array_join("what_changed", "; ").alias("what_changed"), "suggested_pr_title")


@query
def session_listing(spark, sf_dir):
    return library.listed(tables.hooked_events(spark, sf_dir), tables.session_meta(spark, sf_dir))


@query
def meta_patches(spark, sf_dir):
    ev = tables.session_events(spark, sf_dir)
    patch = F.concat(F.lit('{"k'), (F.col("seq") % 3).cast("string"), F.lit('": "'), F.col("k").cast("string"), F.lit('"}'))
    return library.merged_meta(ev.select("session_id", F.col("seq").alias("ord"), patch.alias("patch")))


@query
def index_fallback(spark, sf_dir):
    """SRC7: an index without rows is made up for by the episodes."""
    e = rewarded(spark, sf_dir)
    return library.listing(datasets.index_rows(e).where("id is null"), e).select("id", "created_at", "agent", "outcome", "composite_reward")


@query
def renormalised_episodes(spark, sf_dir):
    """Rebuilt sessions in place of older versions; those that the rebuild lacks stay."""
    ev = tables.hooked_events(spark, sf_dir)
    old = sessions.with_scores(sessions.built(ev.where("session_id % 5 < 2"))).withColumn("version", F.lit(0))
    r = library.renormalised(ev.where("session_id % 5 > 0"), tables.session_meta(spark, sf_dir), old)
    return r.select("session_id", "id", "version", F.size("steps").alias("n_steps"))


@query
def validity_prompts(spark, sf_dir):
    return rewarded(spark, sf_dir, *PARTS).select("id", library.validity_prompt().alias("prompt"))


@query
def command_folders(spark, sf_dir):
    return tables.episodes(spark, sf_dir).select("id", library.command_cwd(F.lit("make test")).alias("cwd"))


@query
def low_trust_list(spark, sf_dir):
    return library.low_trust(narrow(judged(spark, sf_dir), "id", "validity"))


@query
def culprit_order(spark, sf_dir):
    e = tables.episodes(spark, sf_dir)
    return library.ranked_culprits(e.where("ord % 4 = 1").select((F.col("ord") % 50).cast("string").alias("sha"), F.lit("x").alias("path"), (F.col("ord") % 13 + 1).alias("blamed_lines")))


@query
def limited_rows(spark, sf_dir):
    return library.limited(tables.table(spark, sf_dir, "part").select("p_partkey", "p_size"), 50, "p_size", "p_partkey")


@query
def linked_outcomes(spark, sf_dir):
    """SRC23/O3: pull requests out of JSON snapshots; a third of the episodes has none."""
    e = tables.episodes(spark, sf_dir)
    checks = F.when(F.col("ord") % 4 == 1, F.array(F.struct(F.lit("").alias("conclusion"), F.lit("SUCCESS").alias("state")))).when(F.col("ord") % 4 == 2, F.array(F.struct(F.lit("FAILURE").alias("conclusion"), F.lit("x").alias("state")))).otherwise(F.array().cast("array<struct<conclusion:string,state:string>>"))
    snap = F.struct(F.col("outcome.pr_state").alias("state"), F.when(F.col("ord") % 2 == 0, "2024-01-01").alias("mergedAt"), F.col("ord").alias("number"), F.lit("u").alias("url"), F.lit("topic").alias("headRefName"), F.lit("h").alias("headRefOid"), F.struct(F.lit("m").alias("oid")).alias("mergeCommit"), checks.alias("statusCheckRollup"))
    rows = e.where("ord % 3 > 0").select("id", F.when(F.col("ord") % 31 == 0, "not json").otherwise(F.to_json(snap)).alias("snapshot"))
    history = e.where("ord % 5 = 0").select("id", (F.col("ord") % 2).alias("commits_after"), (F.col("ord") % 4).alias("reverts"))
    return library.linked(e, library.snapshots(rows), history)


@query
def pipeline_sft(spark, sf_dir):
    r = library.pipeline_sft(narrow(rewarded(spark, sf_dir, "steps"), *JUDGED, "steps"))
    return r.select("episode_id", F.col("messages")[0]["content"].alias("prompt"), F.md5(F.col("messages")[1]["content"]).alias("answer_md5"), "reward")


@query
def reward_pairs(spark, sf_dir):
    return library.reward_pairs(datasets.reward_rows(rewarded(spark, sf_dir, "steps")))


@query
def minted_sft(spark, sf_dir):
    return library.minted_sft(tables.episodes(spark, sf_dir)).select("id", F.md5("user").alias("user_md5"), F.md5("assistant").alias("assistant_md5"))


@query
def stage_files(spark, sf_dir):
    """SNK15: the six outputs written, with how many rows each has."""
    e = narrow(judged(spark, sf_dir, "steps"), *PAIRED, "steps", "stats", "reward_vector.test_pass", "reward_vector.edit_focus")
    paths = library.write_stages(e, f"{store.shared_folder(spark)}/stages-{uuid.uuid4().hex}")
    rows = None
    for name, path in paths.items():
        n = spark.read.text(path).agg(F.count("*").alias("rows")).select(F.lit(name).alias("stage"), "rows")
        rows = n if rows is None else rows.union(n)
    return rows


@query
def rollout_turing(spark, sf_dir):
    s = turn_samples(spark, sf_dir).select("episode_id", F.col("index").alias("turn_index"), "intent", "action", "target_observation")
    return library.turing_of_rollouts(rollouts.rollout(s, rollouts.named("prefix"), max_turns=5))


@query
def wm_report(spark, sf_dir):
    s = turn_samples(spark, sf_dir).select("episode_id", F.col("index").alias("turn_index"), "intent", "action", "target_observation")
    return library.report(store.materialised(s, "samples"))


@query
def run_summary(spark, sf_dir):
    ev = tables.table(spark, sf_dir, "events")
    r = library.run_summary(ev.select(F.col("event_id").alias("step"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("reward_mean"), ((F.col("event_id") % 10) / 10).alias("clip_fraction"), (F.col("event_type") == "click").alias("updated")))
    return r.select("steps", "updates", F.round("mean_reward", 6).alias("mean_reward"), F.round("clip_fraction", 6).alias("clip_fraction"))


# small functions


@query
def response_texts(spark, sf_dir):
    """Answers as plain text, objects, lists and texts too long."""
    k = F.col("event_id")
    n = k.cast("string")
    raw = F.when(k % 8 == 0, F.concat(F.lit('{"stdout": {"a": 1}, "output": "out '), n, F.lit('", "stderr": "bad"}'))).when(k % 8 == 1, F.concat(F.lit('["a", {"text": "b'), n, F.lit('"}, ["c", 7], null]'))).when(k % 8 == 2, F.concat(F.lit('"said '), n, F.lit('"'))).when(k % 8 == 3, F.concat(F.lit('{"count": '), n, F.lit("}"))).when(k % 8 == 4, F.lit("null")).when(k % 8 == 5, F.concat(F.lit("plain "), n)).when(k % 8 == 6, F.concat(F.lit('{"stdout": 5, "message": "m", "stderr": " "}'))).otherwise(F.to_json(F.struct(F.repeat(F.lit("x"), 6010).alias("result"))))
    return tables.table(spark, sf_dir, "events").select("event_id", logs.response_text(raw).alias("text"))


@query
def relative_commands(spark, sf_dir):
    """N7."""
    s = tables.session_events(spark, sf_dir).where("type = 'shell_command'")
    c = F.concat(F.lit("cd /w/a.b/src && ls /w/a.b; cat /w/a.bc/"), F.col("seq").cast("string"))
    return s.select("session_id", "seq", commands.relativize(c, F.lit("/w/a.b/")).alias("command"))


@query
def first_prompts(spark, sf_dir):
    """P20."""
    c = tables.table(spark, sf_dir, "conversations")
    m = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("m"))
    return m.select("conv_id", review.first_prompt(F.col("m")).alias("prompt"))


@query
def terminal_rewards(spark, sf_dir):
    """W11."""
    r = tables.table(spark, sf_dir, "orders").select("o_orderkey", review.terminal_rewards(F.col("o_totalprice"), (F.col("o_orderkey") % 5).cast("int")).alias("r"))
    return r.select("o_orderkey", F.size("r").alias("n"), F.coalesce(F.try_element_at("r", F.lit(-1)), F.lit(0.0)).alias("last"), F.aggregate("r", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query
def verdict_scores(spark, sf_dir):
    """C30/C32."""
    k = F.col("event_id")
    answer = F.concat(F.lit("fine.\n"), F.when(k % 4 == 0, F.concat(F.lit("Score: "), (k % 30 / 10).cast("string"))).when(k % 4 == 1, "SCORE:.5").when(k % 4 == 2, "score: none").otherwise(""))
    return tables.table(spark, sf_dir, "events").select("event_id", review.verdict_score(answer).alias("score"))


@query
def fenced_diffs(spark, sf_dir):
    """C33."""
    k = F.col("p_partkey")
    n = F.col("p_name")
    answer = F.when(k % 4 == 0, F.concat(F.lit("so:\n```diff\n+"), n, F.lit("\n```\nand\n```diff\n-x\n```"))).when(k % 4 == 1, F.concat(F.lit("```\ndiff --git a b\n+"), n, F.lit("\n```"))).when(k % 4 == 2, F.concat(F.lit("```patch\n"), n, F.lit("\n```"))).otherwise(n)
    return tables.table(spark, sf_dir, "part").select("p_partkey", review.fenced_diff(answer).alias("diff"))


@query
def refreshed_verdicts(spark, sf_dir):
    """Q6: a model's downgrade outlasts the rules."""
    e = judged(spark, sf_dir)
    prior = F.struct(F.lit("high").alias("trust"), F.when(F.col("ord") % 6 == 0, False).when(F.col("ord") % 6 == 1, True).alias("llm_trustworthy"))
    return e.select("id", review.refreshed_validity(prior, F.col("validity")).alias("trust"))


@query
def refreshed_outcomes(spark, sf_dir):
    """O2."""
    e = tables.episodes(spark, sf_dir).withColumn("outcome", F.col("outcome").withField("regression_commits", F.array(F.lit("r"))).withField("manual_edits_after_agent", F.col("ord") % 2 == 0).withField("reverted", F.lit(False)))
    new = F.struct(F.lit("merged").alias("status"), F.lit(True).alias("merged"))
    return e.select("id", review.refreshed_outcome(F.col("outcome"), new).alias("o")).select("id", "o.status", "o.merged", "o.caused_regression", "o.manual_edits_after_agent", F.array_join("o.regression_commits", ",").alias("commits"))
