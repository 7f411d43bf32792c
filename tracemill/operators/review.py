"""Verdicts, splits, gates and the small text functions around judging and replaying episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import score
from tracemill.operators.ordering import numbered

CATEGORIES = ("overly_strict_tests", "underspecified_intent", "low_coverage_tests", "misleading_intent", "reward_contradiction")


def verdict_majority(votes: DataFrame, key: str = "id") -> DataFrame:
    """One verdict out of each key's votes(trustworthy, categories, confidence): broken if most say so, with the
    categories that most name; how far they agree, and whether that asks for another look."""
    each = votes.groupBy(key).agg(F.count("*").alias("passes"), F.count_if(F.coalesce(F.col("trustworthy"), F.lit(True)) == False).alias("broken"), F.avg("confidence").alias("confidence"))  # noqa: E712
    named = votes.select(key, F.explode(F.array_distinct("categories")).alias("c")).where(F.col("c").isin(*CATEGORIES)).groupBy(key, "c").agg(F.count("*").alias("n"))
    majority = F.floor(F.col("passes") / 2) + 1
    cats = named.join(each.select(key, "passes"), key).where(F.col("n") >= majority).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("c")), ",").alias("categories"))
    agreement = F.greatest("broken", F.col("passes") - F.col("broken")) / F.col("passes")
    out = each.join(cats, key, "left").withColumn("trustworthy", F.col("broken") < majority)
    return out.select(key, "passes", "trustworthy", F.coalesce("categories", F.lit("")).alias("categories"), F.when(F.col("trustworthy"), "medium").otherwise("high").alias("severity"), F.round(F.col("confidence") + 1e-9, 3).alias("confidence"), F.round(agreement + 1e-9, 3).alias("agreement"), (agreement < 1).alias("escalate"))


def refreshed_validity(prior: Column, fresh: Column) -> Column:
    """Q6: rules anew; a model's downgrade stays. ``prior`` has trust and llm_trustworthy."""
    low = prior["llm_trustworthy"].eqNullSafe(False)
    return F.when(low, F.lit("low")).otherwise(fresh["trust"])


def cached(rows: DataFrame, cache: DataFrame, key: str, compute) -> DataFrame:
    """Q7: rows whose key the cache has take their value from it; the rest go through ``compute`` (rows to rows with value)."""
    hit = rows.join(cache.select(key, "value"), key)
    return hit.unionByName(compute(rows.join(cache, key, "left_anti")).select(hit.columns))


def train_valid(df: DataFrame, *order: str, share: float = 0.1) -> DataFrame:
    """Adds ``valid`` for the first max(1, round(n share)) rows; a single row is both (``train`` stays true)."""
    rows = numbered(df, *order)
    n = df.agg(F.count("*").alias("__n"))
    k = F.greatest(F.lit(1), F.bround(F.col("__n") * share).cast("bigint"))
    return rows.crossJoin(F.broadcast(n)).withColumn("valid", F.col("rn") <= k).withColumn("train", (F.col("rn") > k) | (F.col("__n") == 1)).drop("__n")


def batches(rows: DataFrame, size: int) -> DataFrame:
    """Adds ``batch`` to numbered rows."""
    return rows.withColumn("batch", F.floor((F.col("rn") - 1) / size))


def gate(scores: DataFrame) -> DataFrame:
    """``scores(task, runner, ok, score)``: a task is clean if the oracle passes, the empty and broken runs don't, and
    the scores are in that order."""
    p = scores.groupBy("task").pivot("runner", ["oracle", "empty", "broken"]).agg(F.first("ok").alias("ok"), F.first("score").alias("score"))
    clean = F.col("oracle_ok") & ~F.col("empty_ok") & ~F.col("broken_ok") & (F.col("oracle_score") > F.col("empty_score")) & (F.col("oracle_score") > F.col("broken_score"))
    return p.select("task", F.coalesce(clean, F.lit(False)).alias("clean"))


def clipped(text: Column, limit: int = 4000, mark: str = "\n...[trajectory truncated]...\n") -> Column:
    """A third of what fits from the head, the rest from the tail."""
    room = limit - len(mark)
    head = room // 3
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(mark), F.substring(text, -(room - head), room - head)))


def verdict_score(answer: Column) -> Column:
    """What follows "SCORE:", between 0 and 1; 0 without one."""
    return F.coalesce(score.clamp(F.nullif(F.regexp_extract(answer, r"(?i)SCORE:\s*([0-9]*\.?[0-9]+)", 1), F.lit("")).cast("double")), F.lit(0.0))


def fenced_diff(answer: Column) -> Column:
    """The first fenced diff or patch, else the first fenced text that begins as a git diff, else the text itself."""
    named, git = F.regexp_extract(answer, r"(?s)```(?:diff|patch)\s*\n(.*?)```", 1), F.regexp_extract(answer, r"(?s)```\w*\s*\n(diff --git .*?)```", 1)
    return F.when(named != "", named).when(git != "", git).otherwise(answer)


def noise_path(path: Column) -> Column:
    """build folders anywhere, and binary suffixes."""
    return path.rlike(r"(^|/)(__pycache__|node_modules|\.git|\.pytest_cache|dist|build|\.venv|target)(/|$)") | path.rlike(r"\.(pyc|pyo|so|o|class)$")


def verifier_file(path: Column) -> Column:
    """files that decide whether tests pass."""
    return path.rlike(r"(?:^|/)(?:__tests__|specs?|tests?)/|(?:^|/)(?:conftest\.py|test_[^/]*\.py|[^/]*(?:_test\.(?:py|go)|_spec\.rb|\.(?:spec|test)\.[jt]sx?))$")


def replay_id(episode_id: Column) -> Column:
    """P21."""
    suffix = F.regexp_replace(F.regexp_replace(episode_id, "^ep_", ""), r"[^\w-]", "_")
    return F.concat(F.lit("rp_"), suffix, F.lit("_"), F.substring(F.sha2(episode_id, 256), 1, 8))


def escalates(text: Column, flag: Column, limit: int = 8000, probability: Column | None = None, threshold: float = 0.5) -> Column:
    """By an explicit flag, by length, or by a learned probability."""
    out = F.coalesce(flag, F.lit(False)) | (F.length(text) > limit)
    return out if probability is None else out | (probability >= threshold)


def first_prompt(messages: Column) -> Column:
    """P20: of chat messages, the first user's content, else the first, else empty."""
    users = F.filter(messages, lambda m: m["role"] == "user")
    return F.coalesce(F.get(users, F.lit(0))["content"], F.get(messages, F.lit(0))["content"], F.lit(""))


def with_regressions(episodes: DataFrame, hits: DataFrame, fix_commit: str | None = None, fuzzy: bool = False) -> DataFrame:
    """Marks episodes that ``hits(id, via, commit)`` implicate: the flag, the fix's commit among their regression
    commits (S6; without one, the commits of the hits), and a label. Hits by file alone count only if ``fuzzy``. Rewards that
    the episodes have are computed anew where marked, verdicts are not."""
    if "via" in hits.columns and not fuzzy:
        hits = hits.where("via <> 'file'")
    by = hits.groupBy("id").agg(F.collect_set(F.lit(fix_commit) if fix_commit else F.col("commit")).alias("__commits"))
    e = episodes.join(by, "id", "left")
    found = F.col("__commits").isNotNull()
    known = F.coalesce("outcome.regression_commits", F.array().cast("array<string>"))
    outcome = F.col("outcome").withField("caused_regression", found | F.coalesce("outcome.caused_regression", F.lit(False))).withField("regression_commits", F.array_sort(F.array_union(known, F.coalesce("__commits", F.array().cast("array<string>")))))
    e = e.withColumn("outcome", outcome).withColumn("labels", F.when(found, F.array_sort(F.array_union("labels", F.array(F.lit("regression"))))).otherwise(F.col("labels"))).drop("__commits")
    if "reward_vector" not in e.columns:
        return e
    e = score.with_reward(e.withColumnRenamed("reward_vector", "__old"))
    return e.withColumn("reward_vector", F.when(F.array_contains("labels", "regression"), F.col("reward_vector")).otherwise(F.col("__old"))).drop("__old")


def refreshed_outcome(old: Column, new: Column) -> Column:
    """O2: the new outcome with what only we know carried over."""
    for f in ("caused_regression", "regression_commits", "manual_edits_after_agent", "reverted"):
        new = new.withField(f, old[f])
    return new


def terminal_rewards(reward: Column, length: Column) -> Column:
    """The reward at the last place, zeros before."""
    return F.when(length <= 0, F.array().cast("array<double>")).otherwise(F.concat(F.array_repeat(F.lit(0.0), length - 1), F.array(reward.cast("double"))))


def notifications(rows: DataFrame) -> DataFrame:
    """SRC19: ``rows(session_id, seq, kind, prompt)`` of turn notices as hooks: a start submits, a completion submits and stops."""
    submit = F.struct(F.lit("UserPromptSubmit").alias("hook"), F.col("prompt").alias("prompt"))
    stop = F.struct(F.lit("Stop").alias("hook"), F.lit(None).cast("string").alias("prompt"))
    hooks = F.when(F.col("kind") == "turn-start", F.array(submit)).when(F.col("kind") == "turn-complete", F.when(F.col("prompt").isNotNull(), F.array(submit, stop)).otherwise(F.array(stop)))
    return rows.select("session_id", "seq", F.posexplode(hooks).alias("part", "h")).select("session_id", "seq", "part", "h.hook", "h.prompt")
