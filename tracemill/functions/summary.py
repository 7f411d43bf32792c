"""Session summaries (U1-U9) as column expressions over an episode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE = r"\.(py|js|ts|tsx|jsx|go|rs|java|rb|php|c|cc|cpp|h|hpp|cs|swift|kt|scala|sh|m|mm)$"
TEST = r"(?i)test|spec"
RISKS = (
    (r"(?i)(jwt|oauth|credential|token|secret|password|login|auth)", "touches authentication or secrets"), (r"(^|/)\.env", "modifies environment / secret config"), (r"(?i)(migration|migrate)", "changes database migrations"),
    (r"(?i)(dockerfile|docker-compose)", "changes container build"), (r"(?i)jenkinsfile|circleci|\.gitlab-ci|\.github/workflows", "changes CI configuration"),
    (r"(?i)(go\.sum|(cargo|poetry|yarn)\.lock|pnpm-lock\.yaml|package-lock\.json)", "changes dependency lockfile"), (r"(?i)k8s|helm|kubernetes|\.(tfvars|tf)$", "changes infrastructure definitions"),
)


def is_test_file(path: Column) -> Column:
    """F14."""
    return path.rlike(TEST)


def is_source_file(path: Column) -> Column:
    return F.lower(path).rlike(SOURCE) & ~is_test_file(path)


def what_changed() -> Column:
    """U2."""
    churn = lambda d: F.when(F.coalesce(d["unified"], F.lit("")) != "", F.concat(F.lit("+"), d["additions"].cast("string"), F.lit("/-"), d["deletions"].cast("string"))).otherwise("")
    return F.transform("diffs", lambda d: F.trim(F.concat(d["status"], F.lit(": "), d["file"], F.lit(" "), churn(d))))


def risky_edits(large: int = 250) -> Column:
    """Changed files with the reasons that make them risky."""

    def one(d: Column) -> Column:
        lines = d["additions"] + d["deletions"]
        reasons = [F.when(d["file"].rlike(p), F.lit(label)) for p, label in RISKS]
        reasons += [F.when(d["status"] == "deleted", F.lit("deletes a file")), F.when(lines >= large, F.concat(F.lit("large change ("), lines.cast("string"), F.lit(" lines)")))]
        return F.struct(d["file"].alias("file"), F.filter(F.array(*reasons), lambda r: r.isNotNull()).alias("why"))

    return F.transform(F.filter(F.transform("diffs", one), lambda r: F.size(r["why"]) > 0), lambda r: F.concat(r["file"], F.lit(" — "), F.array_join(r["why"], ", ")))


def tests_run() -> Column:
    """U8."""
    s = lambda c: c.cast("string")
    return F.transform("tests", lambda t: F.concat(t["framework"], F.lit(": "), s(t["passed"]), F.lit(" passed / "), s(t["failed"]), F.lit(" failed ["), F.when(t["ok"], "ok").otherwise("FAILED"), F.lit("] ("), t["command"], F.lit(")")))


def tests_missing() -> Column:
    """U4: three rules."""
    sources = F.transform(F.filter("diffs", lambda d: is_source_file(d["file"]) & (d["status"] != "deleted")), lambda d: d["file"])
    touched = F.exists("diffs", lambda d: is_test_file(d["file"]))
    n = F.size(sources)
    failing = F.size(F.filter("tests", lambda t: ~F.coalesce(t["ok"], F.lit(False))))
    preview = F.concat(F.array_join(F.slice(sources, 1, 5), ", "), F.when(n > 5, "...").otherwise(""))
    rules = [
        F.when((n > 0) & ~touched, F.concat(F.lit("No test files changed for "), n.cast("string"), F.lit(" edited source file(s): "), preview)),
        F.when((n > 0) & (F.size("tests") == 0), F.lit("No tests were executed during this session.")),
        F.when(failing > 0, F.concat(failing.cast("string"), F.lit(" test command(s) reported failures."))),
    ]
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def added_todos() -> Column:
    """Marks in added lines."""
    mark = r"(?i)\b(HACK|XXX|FIXME|TODO)\b[\s:](.*)"
    added = lambda d: F.filter(F.split(F.coalesce(d["unified"], F.lit("")), "\n"), lambda x: x.startswith("+") & ~x.startswith("+++") & x.rlike(mark))
    return F.flatten(F.transform("diffs", lambda d: F.transform(added(d), lambda x: F.concat(d["file"], F.lit(": "), F.upper(F.regexp_extract(x, mark, 1)), F.lit(" "), F.trim(F.regexp_extract(x, mark, 2))))))


def title() -> Column:
    """The first line of the intent, without politeness, 72 characters at most."""
    first = F.trim(F.regexp_extract(F.coalesce("intent", F.lit("")), r"(?m)^\s*(\S[^\n]*)$", 1))
    first = F.regexp_replace(first, r"(?i)^(help me|i need to|i want to|could you|can you|please)\s+", "")
    first = F.when(first != "", first).when(F.size("diffs") > 0, F.concat(F.lit("Update "), F.get("diffs", F.lit(0))["file"])).otherwise("Coding session changes")
    cut = F.substring(first, 1, 72)
    return F.concat(F.upper(F.substring(cut, 1, 1)), F.substring(cut, 2, 72))


def follow_ups(missing: Column, risky: Column, todos: Column) -> Column:
    """In order, each once."""
    failing = F.exists("tests", lambda t: ~F.coalesce(t["ok"], F.lit(False)))
    extra = [
        F.when(F.exists(missing, lambda m: m.startswith("No test")), "Add tests covering the changed source files."),
        F.when(failing, "Fix the failing tests before merging."),
        F.when(F.size(risky) > 0, "Have a reviewer check the risky edits flagged above."),
    ]
    return F.array_distinct(F.concat(todos, F.filter(F.array(*extra), lambda x: x.isNotNull())))


def summarised(episodes):
    """One row of report columns for each episode; parts are computed once each."""
    e = episodes.withColumns({"what_changed": what_changed(), "risky_edits": risky_edits(), "tests_missing": tests_missing(), "todos": added_todos(), "suggested_pr_title": title(), "tests_run_lines": tests_run()})
    e = e.withColumn("follow_up_todos", follow_ups(F.col("tests_missing"), F.col("risky_edits"), F.col("todos")))
    return e.select(F.col("id").alias("episode_id"), "intent", "what_changed", F.transform("diffs", lambda d: d["file"]).alias("files_touched"), F.col("tests_run_lines").alias("tests_run"), "tests_missing", "risky_edits", "suggested_pr_title", "follow_up_todos")


def description() -> Column:
    """A pull request's text out of a summary's columns."""
    bullets = lambda c, mark, none: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: F.concat(F.lit(mark), x)), "\n")).otherwise(none)
    return F.concat(F.lit("## Summary\n"), F.coalesce(F.nullif("intent", F.lit("")), F.lit("Changes produced during a coding session.")), F.lit("\n\n## Changes\n"), bullets("what_changed", "- ", "_None._"), F.lit("\n\n## Tests\n"), bullets("tests_run", "- ", "- No tests were run."), F.lit("\n\n## Risks\n"), bullets("risky_edits", "- ", "_None._"), F.lit("\n\n## Follow-ups\n"), bullets("follow_up_todos", "- [ ] ", "- [ ] _None._"), F.lit("\n"))
