"""Closed-loop rollouts (W14): each prediction becomes part of what the next one sees.

The dependency is sequential, so an episode's turns run in order inside one Arrow group; episodes run in parallel."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLIP = 400


def named(name: str) -> Callable[[dict], str]:
    """Predictors by name; ``prefix`` repeats the last prediction, which is empty at first."""
    return {"oracle": lambda s: s["target"], "empty": lambda s: "", "echo": lambda s: s["action"], "prefix": lambda s: s["prev"]}[name]


def rollout(samples: DataFrame, predict: Callable[[dict], str], max_turns: int | None = None, budget: int = 4000) -> DataFrame:
    """``(episode_id, turn_index, action, predicted, target)`` over ``samples(episode_id, turn_index, intent, action, target_observation)``."""
    rows = samples.select(F.col("episode_id").cast("string").alias("episode_id"), F.col("turn_index").cast("bigint").alias("turn_index"), "intent", "action", "target_observation")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        history, prev, out = "", "", []
        for r in group.sort_values("turn_index").head(max_turns or len(group)).itertuples():
            prev = predict({"intent": r.intent, "history": history[-budget:], "action": r.action, "prev": prev, "target": r.target_observation}) or ""
            history += f"ACTION: {r.action}\nOBSERVATION: {prev[:CLIP]}\n"
            out.append((r.episode_id, r.turn_index, r.action, prev, r.target_observation))
        return pd.DataFrame(out, columns=["episode_id", "turn_index", "action", "predicted", "target"])

    return rows.groupBy("episode_id").applyInPandas(run, "episode_id string, turn_index bigint, action string, predicted string, target string")
