"""The episode schema, a normaliser for episode documents, and validation as a column of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGENTS = tuple("claude-code codex unknown".split())
FEEDBACK_LABELS = ("useful", "accepted_as_is", "accepted_after_edits", "too_broad", "too_slow", "needed_human_rescue", "wrong")
OUTCOMES = ("merged", "accepted", "open", "abandoned", "failed", "reverted")

STEP = "struct<index:int, ts:string, type:string, tool:string, intent:string, input:string, observation:string, approved:boolean, cwd:string, duration_ms:bigint>"
DIFF = "struct<file:string, status:string, additions:bigint, deletions:bigint, unified:string>"
COMMAND = "struct<ts:string, command:string, cwd:string, exit_code:int, output_excerpt:string, is_test:boolean, reconstructed:boolean>"
TEST = "struct<ts:string, framework:string, command:string, passed:bigint, failed:bigint, skipped:bigint, errors:bigint, total:bigint, ok:boolean, output_excerpt:string, reconstructed:boolean>"
FEEDBACK = "struct<ts:string, label:string, note:string, source:string, confidence:double, evidence_step_index:int, model:string>"
OUTCOME = "struct<status:string, commit:string, branch:string, pr_url:string, pr_number:bigint, pr_state:string, ci_status:string, review_decision:string, merged:boolean, reverted:boolean, manual_edits_after_agent:boolean, merge_commit:string, caused_regression:boolean, regression_commits:array<string>, linked_at:string>"
STATS = "struct<started_at:string, ended_at:string, duration_ms:bigint, tool_calls:bigint, file_reads:bigint, file_edits:bigint, shell_commands:bigint, tests_run:bigint, approvals:bigint, denials:bigint, input_tokens:bigint, output_tokens:bigint, cost_usd:double>"
DEPLOYMENT = "struct<ts:string, command:string, method:string, target_env:string, exit_code:int, verified:boolean, reconstructed:boolean>"
REPO = "struct<root:string, repo:string, remote_url:string, branch:string, base_commit:string, dirty:boolean>"
HINT = "struct<success:string, confidence:double, rationale:string, source:string, model:string>"
FLAG = "struct<code:string, category:string, severity:string, evidence:string>"

#: Columns of an episode document, in order.
EPISODE = {
    "id": "string", "schema_version": "string", "created_at": "string", "agent": "string", "intent": "string", "repo_state": REPO,
    "steps": f"array<{STEP}>", "diffs": f"array<{DIFF}>", "commands": f"array<{COMMAND}>", "tests": f"array<{TEST}>",
    "human_feedback": f"array<{FEEDBACK}>", "outcome": OUTCOME, "stats": STATS, "labels": "array<string>", "diff_source": "string",
    "parent_id": "string", "segment_index": "int", "outcome_hint": HINT, "deployments": f"array<{DEPLOYMENT}>",
}
DDL = ", ".join(f"`{k}` {v}" for k, v in EPISODE.items())


def normalised(episodes: DataFrame) -> DataFrame:
    """All columns of the schema: absent ones as nulls, null arrays as empty ones; other columns stay behind them."""
    out = []
    for name, kind in EPISODE.items():
        c = F.col(name).cast(kind) if name in episodes.columns else F.lit(None).cast(kind)
        out.append((F.coalesce(c, F.array().cast(kind)) if kind.startswith("array") else c).alias(name))
    return episodes.select(*out, *(c for c in episodes.columns if c not in EPISODE))


def validation_errors() -> Column:
    """V1: messages on what is missing or outside its enumeration; empty for a valid episode."""

    def unknown(c: Column, allowed: tuple, name: str) -> Column:
        return F.when(c.isNull() | ~c.isin(*allowed), F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit("null")), F.lit(" not allowed")))

    required = [F.when(F.col(c).isNull(), F.lit(f"{c}: required")) for c in ("id", "created_at", "intent", "outcome", "stats")]
    labels = F.transform(F.filter("human_feedback", lambda f: ~f["label"].isin(*FEEDBACK_LABELS)), lambda f: F.concat(F.lit("human_feedback.label: "), f["label"], F.lit(" not allowed")))
    fixed = F.array(*required, unknown(F.col("outcome.status"), OUTCOMES, "outcome.status"))
    return F.concat(F.filter(fixed, lambda m: m.isNotNull()), labels)
