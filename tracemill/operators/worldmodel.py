"""World-model samples, splits and observation-fidelity benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import score
from tracemill.functions.fidelity import WEIGHTS
from tracemill.functions.hashing import fraction, pick
from tracemill.operators.datasets import tail_context, text

SYSTEM = "You predict what the environment of a coding agent answers to its next action, given what happened so far. Answer with the observation only."


def action_repr(kind: Column, tool: Column, rendered_input: Column, cwd: Column) -> Column:
    """P9."""
    name = F.coalesce(F.nullif(tool, F.lit("")), F.nullif(kind, F.lit("")), F.lit("unknown"))
    prompt = F.get_json_object(rendered_input, "$.prompt")
    place = F.when(F.coalesce(cwd, F.lit("")) != "", F.concat(F.lit(" @ "), cwd)).otherwise("")
    return F.when(prompt.isNotNull(), F.concat(name, F.lit(": "), F.substring(prompt, 1, 200))).otherwise(F.concat(name, F.lit("("), F.substring(F.coalesce(rendered_input, F.lit("{}")), 1, 200), F.lit(")"), place))


def source_key() -> Column:
    """P10: the first that isn't empty of repository, remote and first label."""
    return F.coalesce(F.nullif("repo_state.repo", F.lit("")), F.nullif("repo_state.remote_url", F.lit("")), F.nullif(F.get("labels", F.lit(0)), F.lit("")), F.lit("unknown"))


def samples(steps: DataFrame, action: Column, budget: int = 4000) -> DataFrame:
    """W4-W6/F11 over ``steps(episode_id, index, intent, observation, ...)``: adds action, history, prev_observation and
    target_observation to steps with an observation that isn't blank. The previous step counts even if it is blank."""
    s = steps.withColumn("action", action)
    block = F.concat(F.lit("ACTION: "), F.col("action"), F.lit("\nOBSERVATION: "), F.substring(text("observation"), 1, 400))
    s = tail_context(s.withColumn("prev_observation", F.coalesce(F.lag("observation").over(Window.partitionBy("episode_id").orderBy("index")), F.lit(""))), block, budget)
    head = F.concat(F.lit("INTENT: "), text("intent"))
    history = F.concat_ws("\n", head, F.nullif("context", F.lit("")), F.concat(F.lit("ACTION: "), F.col("action")), F.lit("OBSERVATION:"))
    return s.where(F.regexp_replace(text("observation"), r"(?U)\s+", "") != "").withColumn("history", history).withColumn("target_observation", F.col("observation")).drop("context", "observation")


def one_per_trajectory(samples_: DataFrame, seed: int = 0) -> DataFrame:
    """A sample of each episode, picked by a hash."""
    w = Window.partitionBy("episode_id")
    rows = samples_.withColumn("__k", F.row_number().over(w.orderBy("index")) - 1).withColumn("__n", F.count("*").over(w))
    return rows.where(F.col("__k") == pick(F.concat_ws(":", F.lit(seed), "episode_id"), F.col("__n"))).drop("__k", "__n")


def messages() -> Column:
    """A sample as chat messages."""
    m = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(m("system", F.lit(SYSTEM)), m("user", F.col("history")), m("assistant", F.col("target_observation")))


def ood_split(source: Column, holdout: float = 0.3, seed: int = 0) -> Column:
    """Whole sources are held out; the key is source:seed."""
    return F.when(fraction(F.concat_ws(":", source, F.lit(seed))) < holdout, "holdout").otherwise("train")


def predicted(name: str) -> Column:
    """The named predictors: they know the target, nothing, the action, or the previous observation."""
    return {"oracle": F.col("target_observation"), "empty": F.lit(""), "echo": F.col("action"), "prefix": F.col("prev_observation")}[name]


DIMENSIONS = (*WEIGHTS, "composite")


def bench(scored: DataFrame) -> DataFrame:
    """Means over everything, by domain and by source, in one pass by grouping sets. ``scored(domain, source, score)``."""
    flat = scored.select("domain", "source", *(F.col(f"score.{d}").alias(d) for d in DIMENSIONS), F.col("score.exact").cast("double").alias("exact_rate"))
    sets = flat.groupingSets([[], ["domain"], ["source"]], "domain", "source")
    level = F.when(F.grouping("domain") == 0, "domain").when(F.grouping("source") == 0, "source").otherwise("overall")
    return sets.agg(level.alias("level"), F.count("*").alias("n"), *(score.r4(F.avg(d)).alias(d) for d in (*DIMENSIONS, "exact_rate"))).select("level", F.coalesce("domain", "source", F.lit("")).alias("name"), "n", *DIMENSIONS, "exact_rate")


def turing(pairs: DataFrame, realness_real: Column, realness_fake: Column, sample_id: Column, seed: int = 0) -> DataFrame:
    """How well a rule tells the real from the predicted observation; equal ones count half."""
    at = pick(F.concat(F.lit(f"{seed}:"), sample_id), F.lit(2))
    first_wins = F.when(at == 0, realness_real >= realness_fake).otherwise(realness_fake >= realness_real)
    right = F.when(F.col("real") == F.col("fake"), 0.5).when((at == 0) == first_wins, 1.0).otherwise(0.0)
    a = pairs.agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"))
    return a.select("n", F.round("accuracy", 4).alias("accuracy"), F.round(1 - F.abs(F.col("accuracy") - 0.5) * 2, 4).alias("indistinguishability"))
