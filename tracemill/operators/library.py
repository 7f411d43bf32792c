"""The episode store's lists and updates, links to pull requests, datasets out of rows, reports and their limits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import fidelity, score
from tracemill.functions.hashing import held_out
from tracemill.operators import analytics, datasets, rollouts, sessions, worldmodel
from tracemill.sources.store import upserted


def listed(events: DataFrame, meta: DataFrame) -> DataFrame:
    """SRC4: the sessions that have events or meta data, with how many events, in the order of their ids."""
    n = events.groupBy("session_id").agg(F.count("*").alias("n_events"))
    m = meta.select("session_id").distinct().withColumn("has_meta", F.lit(True))
    return n.join(m, "session_id", "full_outer").select("session_id", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("has_meta", F.lit(False)).alias("has_meta")).orderBy("session_id")


def merged_meta(patches: DataFrame) -> DataFrame:
    """SNK4: ``(session_id, key, value)``: of each key the value of its last patch, as JSON text. ``patches(session_id, ord,
    patch)`` of JSON objects; a null takes a value back to null, a key is never removed."""
    each = patches.select("session_id", "ord", F.explode(F.from_json("patch", "map<string,string>")).alias("key", "value"))
    return each.groupBy("session_id", "key").agg(F.max_by(F.struct("value"), "ord").alias("v")).select("session_id", "key", "v.value")


def listing(index: DataFrame, episodes: DataFrame) -> DataFrame:
    """SRC7/T1: the index's rows by time of creation; where there are none, rows made of the episodes by id."""
    return index.orderBy(F.coalesce("created_at", F.lit("")), "id") if not index.isEmpty() else datasets.index_rows(episodes).orderBy("id")


def renormalised(events: DataFrame, meta: DataFrame | None, old: DataFrame | None = None, prior: DataFrame | None = None, version: int = 1) -> DataFrame:
    """All sessions built and scored anew; an episode with content is never replaced by one without."""
    new = sessions.with_scores(sessions.built(events, meta), prior).withColumn("version", F.lit(version))
    return upserted(old, new)


def command_cwd(command: Column) -> Column:
    """The folder of the first recorded command that is the given one."""
    return F.get(F.filter("commands", lambda c: c["command"] == command), F.lit(0))["cwd"]


def validity_prompt() -> Column:
    """An episode's signals on one screen."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    truth = lambda c: F.coalesce(F.initcap(c.cast("string")), F.lit("None"))
    listed_ = lambda items, sep: F.coalesce(F.nullif(F.array_join(items, sep), F.lit("")), F.lit("none"))
    tests = F.transform(F.filter("tests", lambda t: F.coalesce(t["total"], F.lit(0)) > 0), lambda t: F.concat(text(t["framework"]), F.lit(" ok="), truth(t["ok"]), F.lit(" passed="), text(t["passed"]), F.lit(" failed="), text(t["failed"]), F.lit(" errors="), text(t["errors"])))
    feedback = F.transform("human_feedback", lambda f: F.concat(text(f["label"]), F.lit("("), text(f["confidence"]), F.lit(")")))
    files = F.transform(F.slice("diffs", 1, 12), lambda d: F.coalesce(F.nullif(d["file"], F.lit("")), F.lit("?")))
    deployed = F.concat(F.lit("["), F.array_join(F.transform("deployments", lambda d: truth(d["verified"])), ", "), F.lit("]"))
    rv = lambda k: text(F.col(f"reward_vector.{k}"))
    return F.concat(
        F.lit("INTENT: "), F.substring(F.coalesce("intent", F.lit("")), 1, 300), F.lit("\nSTEPS: "), F.size("steps").cast("string"), F.lit("  DIFFS: "), listed_(files, ", "), F.lit("\nTESTS: "), F.coalesce(F.nullif(F.array_join(tests, "; "), F.lit("")), F.lit("none executed")),
        F.lit("\nHUMAN_FEEDBACK: "), listed_(feedback, "; "), F.lit("\nOUTCOME: status="), text(F.col("outcome.status")), F.lit(" hint="), text(F.col("outcome_hint.success")), F.lit(" deploys="), deployed,
        F.lit("\nRECORDED_REWARD: composite="), rv("composite"), F.lit(" test_pass="), rv("test_pass"), F.lit(" human_label="), rv("human_label"), F.lit(" outcome_src="), rv("components.outcome_source"),
    )


def low_trust(episodes: DataFrame, order: str = "id", limit: int = 15) -> DataFrame:
    """The first episodes that aren't trusted, with severity, categories and flags."""
    low = episodes.where("validity.trust = 'low'").orderBy(order).limit(limit)
    return low.select("id", "validity.severity", F.array_join("validity.categories", ",").alias("categories"), F.array_join(F.transform("validity.flags", lambda f: f["code"]), ",").alias("codes"))


def ranked_culprits(blame: DataFrame) -> DataFrame:
    """Blamed commits, the most lines first; ties by commit."""
    return analytics.culprits(blame).orderBy(F.col("blamed_lines").desc(), "sha")


def limited(rows: DataFrame, limit: int | None, *order: str) -> DataFrame:
    """The first rows in an order; all of them without a limit."""
    return rows if limit is None else rows.orderBy(*order).limit(limit)


SNAPSHOT = "id string, state string, mergedAt string, merged boolean, number bigint, url string, headRefName string, headRefOid string, mergeCommit struct<oid:string>, statusCheckRollup array<struct<state:string,conclusion:string>>, reviewDecision string"


def snapshots(rows: DataFrame) -> DataFrame:
    """SRC23: pull requests out of ``rows(id, snapshot)`` of JSON, as the columns that ``outcome_of_pull_request`` reads; what isn't JSON is passed over."""
    s = rows.select("id", F.from_json("snapshot", SNAPSHOT.partition(", ")[2]).alias("s")).where("s.state is not null")
    checks = F.transform("s.statusCheckRollup", lambda c: F.coalesce(F.nullif(c["conclusion"], F.lit("")), c["state"]))
    return s.select("id", "s.state", F.col("s.merged").alias("merged"), F.col("s.mergedAt").alias("merged_at"), checks.alias("checks"), "s.url", "s.number", F.col("s.headRefName").alias("branch"), F.col("s.headRefOid").alias("commit"), F.col("s.mergeCommit.oid").alias("merge_commit"), F.col("s.reviewDecision").alias("review_decision"))


def linked(episodes: DataFrame, pulls: DataFrame, history: DataFrame) -> DataFrame:
    """O3: each episode's outcome by its pull request, else an open one at its base; ``history(id, commits_after, reverts)``
    of its repository, where that is known, tells of manual edits and reverts."""
    e = episodes.select("id", "repo_state").join(pulls.select("id", analytics.outcome_of_pull_request().alias("pr"), F.col("commit").alias("head"), F.col("branch").alias("head_branch"), "merge_commit", "review_decision"), "id", "left").join(history, "id", "left")
    pr = F.col("pr").isNotNull()
    known = F.col("commits_after").isNotNull() & (F.coalesce("repo_state.base_commit", F.lit("")) != "")
    return e.select(
        "id", F.when(pr, F.col("pr.status")).otherwise("open").alias("status"), F.coalesce("pr.merged", F.lit(False)).alias("merged"), F.when(pr, F.coalesce("head", "repo_state.base_commit")).otherwise(F.col("repo_state.base_commit")).alias("commit"),
        F.when(pr, F.coalesce("head_branch", "repo_state.branch")).otherwise(F.col("repo_state.branch")).alias("branch"), "merge_commit", F.col("pr.pr_state").alias("pr_state"), F.col("pr.ci_status").alias("ci_status"), "review_decision", F.col("pr.pr_number").alias("pr_number"),
        F.when(known, F.col("commits_after") > 0).otherwise(False).alias("manual_edits_after_agent"), F.when(known, F.coalesce(F.col("reverts") > 0, F.lit(False))).otherwise(False).alias("reverted"),
    )


def pipeline_sft(episodes: DataFrame) -> DataFrame:
    """A row for each episode that the quality filter keeps: its intent, and its trajectory as the answer."""
    m = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return episodes.where(score.quality_kept()).select(F.col("id").alias("episode_id"), F.array(m("user", F.coalesce("intent", F.lit(""))), m("assistant", datasets.trajectory())).alias("messages"), F.coalesce("reward_vector.composite", F.lit(0.0)).alias("reward"))


def reward_pairs(rows: DataFrame) -> DataFrame:
    """Prompt and target of the reward rows that have both."""
    return rows.where("prompt <> '' and scalar_reward is not null").select("prompt", F.col("scalar_reward").cast("double").alias("target"))


def minted_sft(episodes: DataFrame, instruction: str = "\n\nAnswer with a unified diff in a ```diff block.") -> DataFrame:
    """The intent with an instruction, answered by the episode's own diff."""
    diff = F.array_join(F.transform(F.filter("diffs", lambda d: F.coalesce(d["unified"], F.lit("")) != ""), lambda d: F.concat(F.regexp_replace(d["unified"], r"\s+$", ""), F.lit("\n"))), "")
    return episodes.select("id", F.concat(F.coalesce("intent", F.lit("")), F.lit(instruction)).alias("user"), F.concat(F.lit("```diff\n"), diff, F.lit("```")).alias("assistant"))


def write_stages(episodes: DataFrame, folder: str) -> dict[str, str]:
    """SNK15: the six outputs of the reward pipeline below a folder, out of scored episodes; returns their paths."""
    features = episodes.select("id", score.reward_features().alias("f"), F.col("reward_vector.composite").alias("y"))
    model = analytics.fit_reward_model(features, F.col("f"), F.col("y"))
    predicted = features.select("y", analytics.predicted(F.col("f"), model["weights"] or [0.0] * 7).alias("p"))
    spark = episodes.sparkSession
    weights = spark.createDataFrame([([float(w) for w in model["weights"]], float(model["r2"]), int(model["n"]))], "weights array<double>, r2 double, n bigint")
    stages = {
        "quality": analytics.quality_stats(episodes), "sft": pipeline_sft(episodes), "preference_pairs": datasets.preference_pairs(episodes), "reward_model": weights,
        "rl_batches": datasets.transitions(datasets.exploded_steps(episodes, "reward_vector"), F.coalesce("reward_vector.composite", F.lit(0.0))), "eval": analytics.evaluation(predicted, "p", "y"),
    }
    for name, df in stages.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
    return {name: f"{folder}/{name}" for name in stages}


def turing_of_rollouts(turns: DataFrame, seed: int = 0) -> DataFrame:
    """The Turing test on whole trajectories: ``turns(episode_id, turn_index, action, target, predicted)``. Episodes
    without turns aren't there; equal trajectories count half."""
    line = lambda c: F.concat(F.lit("ACTION: "), F.coalesce("action", F.lit("")), F.lit("\nOBSERVATION: "), F.coalesce(c, F.lit("")))
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", line(c).alias("x")))), lambda r: r["x"]), "\n")
    pairs = turns.groupBy("episode_id").agg(join("target").alias("real"), join("predicted").alias("fake"))
    return worldmodel.turing(pairs, fidelity.realness(F.col("real")), fidelity.realness(F.col("fake")), F.col("episode_id").cast("string"), seed)


def report(samples: DataFrame, max_turns: int | None = None, share: float = 0.2, seed: int = 0, predictors: tuple[str, ...] = ("oracle", "prefix", "empty")) -> DataFrame:
    """Fidelity of the named predictors over the episodes that are held out, one row each: turns, mean composite, and
    how well the rollouts are told from what happened. ``samples(episode_id, turn_index, intent, action, target_observation)``."""
    held = samples.where(held_out(F.col("episode_id").cast("string"), share, seed))
    out = None
    for name in predictors:
        turns = rollouts.rollout(held, rollouts.named(name), max_turns=max_turns)
        scored = fidelity.scored(turns, "predicted", "target").select("episode_id", F.col("score.composite").alias("c"))
        means = scored.groupBy("episode_id").agg(F.count("*").alias("n"), F.avg("c").alias("c")).agg(F.count("*").alias("episodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("turns"), F.round(F.avg("c"), 4).alias("mean_composite"))
        row = means.crossJoin(turing_of_rollouts(turns, seed).select("accuracy", "indistinguishability")).select(F.lit(name).alias("predictor"), "*")
        out = row if out is None else out.union(row)
    return out


def run_summary(history: DataFrame) -> DataFrame:
    """Means over a training run's steps ``(step, reward_mean, clip_fraction, updated)``; null where no step has one."""
    return history.agg(F.count("*").alias("steps"), F.count_if(F.coalesce("updated", F.lit(False))).alias("updates"), F.avg("reward_mean").alias("mean_reward"), F.avg("clip_fraction").alias("clip_fraction"))


def generations(config: dict, rows: int, processes: int = 1) -> tuple[int, int]:
    """Completions for each prompt and in each batch of them: as many as fit, two at least, in whole device batches."""
    wanted = config.get("num_generations", 4)
    if type(wanted) is not int or wanted < 1:
        raise ValueError(f"num_generations must be a positive integer, not {wanted!r}")
    device = max(1, config.get("batch_size", 1) * processes)
    room = max(1, config.get("batch_size", 1) * processes * config.get("grad_accum", 1))
    n = max(2, min(wanted, max(1, min(room, rows) if rows else room)))
    return n, math.lcm(device, n)


def checked_number(config: dict, key: str, default: float, low: float | None = None, high: float | None = None, whole: bool = False) -> float | int:
    """A finite number of a configuration within its bounds; anything else is an error."""
    v = config.get(key, default)
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise ValueError(f"{key}: {v!r} is no number")
    if not math.isfinite(v):
        raise ValueError(f"{key}: {v!r} is not finite")
    if whole and v != int(v):
        raise ValueError(f"{key}: {v!r} is no whole number")
    if (low is not None and v < low) or (high is not None and v > high):
        raise ValueError(f"{key}: {v!r} is not between {low} and {high}")
    return int(v) if whole else v
