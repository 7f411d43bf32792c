"""Chat formatting into training windows of a token budget.

Prefix sums of the turns' tokens choose spans of whole turns: each window starts with the conversation's system turns,
repeats the turns just before its new ones as far as a history budget goes, and takes as many new turns as then fit. Only
assistant turns are targets, and each in one window only: where it is repeated as history, it is masked. Tokens are
byte-pair tokens, counted as ``token_counts`` counts them, unless a column of lengths is named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import groups, partitions, table
from tracemill.llm.token_counts import count_tokens

BUDGET, HISTORY, OVERHEAD = 256, 64, 3
SCHEMA = "conv_id bigint, window int, first_turn bigint, last_turn bigint, n_tokens bigint, n_target_tokens bigint, turns array<bigint>, roles array<string>, texts array<string>, is_target array<boolean>, over_budget boolean"


def plan(tokens: np.ndarray, budget: int, history: int) -> list[tuple[int, int, int]]:
    """(history start, first new, end) of each window over the turns that aren't system turns; budget: what those leave."""
    upto = np.concatenate([[0], np.cumsum(tokens)])
    out, first = [], 0
    while first < len(tokens):
        past = first
        if first:  # as many turns as the history budget holds, but the next new turn must fit as well
            room = min(history, budget - int(tokens[first]))
            past = int(np.searchsorted(upto, upto[first] - max(0, room), side="left"))
            past = min(past, first)
        end = max(first + 1, int(np.searchsorted(upto, upto[past] + budget, side="right")) - 1)
        out.append((past, first, end))
        first = end
    return out


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, length: str | None = None) -> DataFrame:
    """Windows of ``turns(conv_id, turn, role, text)``, one row each: the fields of ``SCHEMA``.

    ``turns`` lists a window's turn numbers (system turns, history, new turns), with roles, texts and whether each is
    trained on. A turn's tokens are its text's byte-pair tokens, or the column ``length`` names (null or negative: 0), and
    ``OVERHEAD`` for the template. Turns are never cut: one that doesn't fit with the system turns is a window of its own,
    marked ``over_budget``. A conversation of system turns only gives one window without targets. A turn with a null
    conv_id is a conversation of its own; null turn numbers come first; a null role is no target; a null
    text counts as an empty one and stays null. Equal repeated rows count once; turns of one number keep an order by role
    and text. An empty table gives no rows. Other columns are left out, whatever their names."""
    parts = partitions(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("bigint").alias("doc_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), *([] if length is None else [F.col(length).cast("bigint").alias("n_tokens")]))
    if length is None:
        rows = count_tokens(rows.withColumn("content", F.col("text")), frequent=0, keep=("turn", "role", "content")).withColumnRenamed("content", "text")
    rows = rows.select(F.col("doc_id").alias("conv_id"), "turn", "role", "text", (F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)) + OVERHEAD).alias("n"))
    rows = rows.select(F.col("conv_id").isNull().alias("null_id"), F.coalesce("conv_id", F.xxhash64("turn", "role", "text")).alias("key"), "*")
    rows = rows.repartition(parts, "null_id", "key").sortWithinPartitions("null_id", "key", "turn", "role", "text")
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        for t in groups(batches, ["null_id", "key"]):
            every = list(zip(t["turn"].to_pylist(), t["role"].to_pylist(), t["text"].to_pylist(), t["n"].to_pylist()))
            every = [r for i, r in enumerate(every) if i == 0 or r != every[i - 1]]
            system, rest = [r for r in every if r[1] == "system"], [r for r in every if r[1] != "system"]
            head = sum(r[3] for r in system)
            spans = plan(np.array([r[3] for r in rest], np.int64), max(0, budget - head), history) or [(0, 0, 0)]
            for k, (past, first, end) in enumerate(spans):
                used = system + rest[past:end]
                targets = [False] * (len(system) + first - past) + [r[1] == "assistant" for r in rest[first:end]]
                n = sum(r[3] for r in used)
                new = rest[first:end] or system
                row = (t["conv_id"][0].as_py(), k, new[0][0], new[-1][0], n, sum(r[3] for r, x in zip(used, targets) if x), [r[0] for r in used], [r[1] for r in used], [r[2] for r in used], targets, n > budget)
                for o, v in zip(out, row):
                    o.append(v)
            if len(out[0]) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names)
                out = [[] for _ in names]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names)

    i64 = pa.int64()
    kinds = [i64, pa.int32(), i64, i64, i64, i64, pa.list_(i64), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.bool_()]
    return rows.mapInArrow(run, SCHEMA)


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(table(spark, sf_dir, "conversations"))
