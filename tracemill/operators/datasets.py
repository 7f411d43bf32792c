"""Training datasets out of episodes and steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import score
from tracemill.sources.store import materialised

ACTIONS = "shell_command tool_post file_read file_edit file_write file_delete".split()


def text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def action_line(kind: Column, tool: Column, rendered_input: Column, cwd: Column) -> Column:
    """P5: what a step did, in one line; ``rendered_input`` is JSON text in the order it was recorded."""
    name = F.coalesce(F.nullif(tool, F.lit("")), F.nullif(kind, F.lit("")), F.lit("unknown"))
    place = F.when(F.coalesce(cwd, F.lit("")) != "", F.concat(F.lit(" @ "), cwd)).otherwise("")
    prompt = F.substring(F.coalesce(F.get_json_object(rendered_input, "$.prompt"), F.lit("")), 1, 120)
    return F.when(kind == "user_prompt", F.concat(F.lit("ACTION user_prompt("), prompt, F.lit(")"))).otherwise(F.concat(F.lit("ACTION "), name, F.lit("("), F.substring(F.coalesce(rendered_input, F.lit("{}")), 1, 120), F.lit(")"), place))


def observation_line(observation: Column) -> Column:
    """P6."""
    return F.concat(F.lit("OBS: "), F.substring(F.coalesce(observation, F.lit("")), 1, 200))


def trajectory() -> Column:
    """The whole episode as text."""
    each = F.transform("steps", lambda s: F.concat(action_line(s["type"], s["tool"], s["input"], s["cwd"]), F.lit("\n"), observation_line(s["observation"])))
    return F.array_join(F.concat(F.array(F.concat(F.lit("USER: "), text("intent"))), each), "\n")


def exploded_steps(episodes: DataFrame, *keep: str) -> DataFrame:
    s = episodes.select(F.col("id").alias("episode_id"), "intent", *keep, F.explode("steps").alias("s"))
    return s.select("episode_id", "intent", *keep, F.col("s").dropFields("intent").alias("s")).select("episode_id", "intent", *keep, "s.*")


def tail_context(steps: DataFrame, block: Column, budget: int, by: str = "episode_id") -> DataFrame:
    """Adds ``context``, the last ``budget`` characters of the blocks before each step, joined by line ends.

    The frame holds the blocks that begin within the budget, and one more value gives the block that reaches into it from
    before, so a long episode costs its length times the budget and never its square."""
    w = Window.partitionBy(by).orderBy("index")
    s = steps.withColumn("__block", block).withColumn("__at", F.coalesce(F.sum(F.length("__block") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))
    r = Window.partitionBy(by).orderBy("__at")
    near = F.collect_list("__block").over(r.rangeBetween(-budget, -1))
    far = F.last("__block").over(r.rangeBetween(Window.unboundedPreceding, -budget - 1))
    joined = F.array_join(F.concat(F.filter(F.array(far), lambda x: x.isNotNull()), near), "\n")
    return s.withColumn("context", F.when(F.length(joined) > budget, F.substring(joined, -budget, budget)).otherwise(joined)).drop("__block", "__at")


def sft_segments(episodes: DataFrame, budget: int = 4000, intent_budget: int = 600) -> DataFrame:
    """A row for each action of a good episode: user content (intent and recent history) and the action."""
    s = exploded_steps(episodes.where(score.is_good()), "reward_vector")
    line = action_line(F.col("type"), F.col("tool"), F.col("input"), F.col("cwd"))
    acts = F.col("type").isin(*ACTIONS)
    s = tail_context(s, F.when(acts, F.concat(line, F.lit("\n"), observation_line(F.col("observation")))).otherwise(line), budget).where(acts)
    user = F.concat(F.lit("USER: "), F.substring(text("intent"), 1, intent_budget), F.when(F.col("context") != "", F.concat(F.lit("\n"), F.col("context"))).otherwise(""))
    return s.select("episode_id", F.col("index").alias("step_index"), user.alias("user"), line.alias("assistant"), F.col("reward_vector.composite").alias("reward"))


def norm_intent() -> Column:
    """P12."""
    return F.regexp_replace(F.lower(text("intent")), r"(?U)^\s+|\s+$", "")


def _extreme(condition: Column, descending: bool) -> Column:
    """The first episode by ``ord`` among those with the extreme composite."""
    key = F.struct((-F.col("composite") if descending else F.col("composite")).alias("k"), F.col("ord").alias("o"))
    return F.min_by(F.struct("id", "composite", "ord"), F.when(condition, key))


def _pairs(episodes: DataFrame, chosen: Column, rejected: Column, keep: Column) -> DataFrame:
    e = episodes.select("ord", "id", "intent", norm_intent().alias("key"), F.coalesce("reward_vector.composite", F.lit(0.0)).alias("composite"), score.is_good().alias("good"), score.is_bad().alias("bad"))
    g = e.groupBy("key").agg(F.count("*").alias("n"), _extreme(F.col("good"), True).alias("best"), _extreme(F.col("bad"), False).alias("worst"), _extreme(~F.col("good"), False).alias("worst_other"), _extreme(F.lit(True), False).alias("lowest"), F.max_by(F.struct("id", "composite", "ord"), F.struct("composite", "ord")).alias("highest"))
    return g.where(keep).select("key", chosen.alias("chosen"), rejected.alias("rejected")).select("key", F.col("chosen.id").alias("chosen_id"), F.col("rejected.id").alias("rejected_id"), F.col("chosen.composite").alias("chosen_reward"), F.col("rejected.composite").alias("rejected_reward"))


def dpo_pairs(episodes: DataFrame, strict: bool = False) -> DataFrame:
    """A10: for each intent the best good episode against the worst bad one, else the worst that isn't good, else the extremes.

    Good and bad overlap, so a pair may be an episode with itself; ``strict`` leaves those out."""
    best, worst, other = F.col("best"), F.col("worst"), F.col("worst_other")
    chosen = F.when(worst.isNull() & other.isNull(), F.col("highest")).otherwise(best)
    rejected = F.coalesce(worst, other, F.col("lowest"))
    pairs = _pairs(episodes, chosen, rejected, best.isNotNull() & (worst.isNotNull() | other.isNotNull() | (F.col("n") >= 2)))
    return pairs.where("chosen_id <> rejected_id") if strict else pairs


def preference_pairs(episodes: DataFrame) -> DataFrame:
    """Groups of two at least; the extremes where the group isn't both good and bad, unless they are equal."""
    both = F.col("best").isNotNull() & F.col("worst").isNotNull()
    return _pairs(episodes, F.when(both, F.col("best")).otherwise(F.col("highest")), F.when(both, F.col("worst")).otherwise(F.col("lowest")), (F.col("n") >= 2) & (both | (F.col("highest.composite") != F.col("lowest.composite"))))


def with_trajectories(pairs: DataFrame, episodes: DataFrame) -> DataFrame:
    """Pairs with prompt and texts, which are rendered once, and for the chosen rows only."""
    pairs = materialised(pairs, "pairs")
    wanted = pairs.select(F.col("chosen_id").alias("id")).union(pairs.select("rejected_id")).distinct()
    texts = materialised(episodes.select("id", "intent", "steps").join(wanted, "id", "left_semi").select("id", "intent", trajectory().alias("text")), "texts")
    one, two = texts.select(F.col("id").alias("chosen_id"), F.col("intent").alias("prompt"), F.col("text").alias("chosen")), texts.select(F.col("id").alias("rejected_id"), F.col("text").alias("rejected"))
    return pairs.join(one, "chosen_id").join(two, "rejected_id")


def reward_rows(episodes: DataFrame) -> DataFrame:
    """All episodes with their text and scalar reward."""
    return episodes.select(F.col("id").alias("episode_id"), F.col("intent").alias("prompt"), trajectory().alias("trajectory"), F.coalesce("reward_vector.composite", F.lit(0.0)).alias("scalar_reward"))


def flat_rows(episodes: DataFrame) -> DataFrame:
    """Eleven columns for analysis."""
    total = lambda f: F.aggregate("diffs", F.lit(0).cast("bigint"), lambda a, d: a + F.coalesce(d[f], F.lit(0)))
    return episodes.select("id", "intent", "agent", F.col("repo_state.branch").alias("branch"), F.col("outcome.status").alias("outcome_status"), F.col("reward_vector.composite").alias("composite"), F.col("reward_vector.test_pass").alias("test_pass"), F.col("stats.file_edits").alias("file_edits"), F.col("stats.tests_run").alias("tests_run"), total("additions").alias("additions"), total("deletions").alias("deletions"))


def index_rows(episodes: DataFrame) -> DataFrame:
    """P4."""
    return episodes.select("id", "created_at", "agent", F.substring(text("intent"), 1, 140).alias("intent"), F.col("repo_state.branch").alias("branch"), F.col("outcome.status").alias("outcome"), F.col("reward_vector.composite").alias("composite_reward"), F.col("stats.tests_run").alias("tests_run"), F.col("stats.file_edits").alias("file_edits"), "labels")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """SNK3/A34: the last row of each key."""
    w = Window.partitionBy(key).orderBy(*(F.col(o).desc() for o in order))
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def transitions(steps: DataFrame, reward: Column) -> DataFrame:
    """The previous observation is the state; the reward comes with the last step, whose discount is 0."""
    w = Window.partitionBy("episode_id").orderBy("index")
    last = F.lead("index").over(w).isNull()
    return steps.select("episode_id", F.col("index").alias("step_index"), F.coalesce(F.lag("observation").over(w), F.lit("")).alias("prev_observation"), "type", "tool", F.coalesce("observation", F.lit("")).alias("next_observation"), F.lag("index").over(w).isNull().alias("is_first"), last.alias("done"), F.when(last, reward).otherwise(0.0).alias("reward"), F.when(last, 0.0).otherwise(1.0).alias("discount"))


def rlds(steps: DataFrame, reward: Column) -> DataFrame:
    """One row for each episode with its steps in order."""
    t = transitions(steps, reward)
    step = F.struct("step_index", "prev_observation", "type", "tool", "next_observation", "is_first", "done", "reward", "discount")
    return t.groupBy("episode_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))


def unique_prompts(rows: DataFrame, content: str, *order: str) -> DataFrame:
    """The first row of each content; blank ones are passed over."""
    w = Window.partitionBy(content).orderBy(*order)
    return rows.where(F.regexp_replace(F.coalesce(content, F.lit("")), r"(?U)\s+", "") != "").withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def verifier() -> Column:
    """F8: the first successful test run's command, else the first successful test command's."""
    test = F.get(F.filter("tests", lambda t: F.coalesce(t["ok"], F.lit(False)) & (F.coalesce(t["command"], F.lit("")) != "")), F.lit(0))
    run = F.get(F.filter("commands", lambda c: F.coalesce(c["is_test"], F.lit(False)) & (F.coalesce(c["command"], F.lit("")) != "") & F.coalesce(c["exit_code"] == 0, F.lit(False))), F.lit(0))
    none = F.lit(None).cast("bigint")
    tested = F.struct(test["command"].alias("command"), F.coalesce(test["framework"], F.lit("unknown")).alias("framework"), test["passed"].alias("passed"), test["failed"].alias("failed"), test["total"].alias("total"))
    return F.when(test.isNotNull(), tested).when(run.isNotNull(), F.struct(run["command"].alias("command"), F.lit("unknown").alias("framework"), none.alias("passed"), none.alias("failed"), none.alias("total")))


def skip_reason(needs_remote: bool = False) -> Column:
    """why an episode gives no task; null if it does."""
    reason = F.when(~score.trusted(), "low_trust").when(score.is_bad(), "bad_outcome").when(verifier().isNull(), "no_verifier")
    return reason.when(F.trim(F.coalesce("repo_state.remote_url", F.lit(""))) == "", "no_remote") if needs_remote else reason


PYTHON, NODE, GO, RUST = "python:3.12-slim", "node:20-slim", "golang:1.22", "rust:1-slim"
IMAGES = dict(pytest=PYTHON, unittest=PYTHON, jest=NODE, mocha=NODE, vitest=NODE, go=GO, cargo=RUST)


def base_image(framework: Column, command: Column) -> Column:
    """By the framework's name, else by the command's first word."""
    out = None
    for k, v in IMAGES.items():
        out = F.when(framework == k, v) if out is None else out.when(framework == k, v)
    head = F.get(F.split(F.trim(F.coalesce(command, F.lit(""))), r"\s+"), F.lit(0))
    return out.when(head.isin("node", "npm", "npx", "pnpm", "yarn"), NODE).when(head == "go", GO).when(head == "cargo", RUST).otherwise(PYTHON)


def portable(command: Column) -> Column:
    """No absolute path in a command."""
    return ~F.coalesce(command, F.lit("")).rlike(r"(^|\s)/")
