"""Classification of shell commands and of their output, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

READERS = ("cat less more head tail grep egrep fgrep rg ag sed awk cut sort uniq wc ls find fd echo printf tee tr xxd hexdump vim vi nano emacs touch rm cp mv mkdir diff cd export git").split()
FRAMEWORKS = (
    ("pytest", r"\b(?:pytest|py\.test)\b"), ("python-unittest", r"python[\d.]*\s+-m\s+unittest"), ("jest", r"\bjest\b"), ("vitest", r"\bvitest\b"), ("mocha", r"\bmocha\b"),
    ("go-test", r"\bgo\s+test\b"), ("cargo-test", r"\bcargo\s+test\b"), ("rspec", r"\brspec\b"), ("phpunit", r"\bphpunit\b"), ("gradle-test", r"\bgradlew?\b.*\btest\b"),
    ("maven-test", r"\bmvn\b.*\btest\b"), ("npm-test", r"\b(?:bun|yarn|pnpm|npm)\s+(?:run\s+)?test\b"), ("make-test", r"\bmake\s+test\b"),
)
DEPLOYS = (
    ("wrangler", r"\bwrangler\s+(pages\s+)?deploy\b"), ("vercel", r"\bvercel\s+(deploy\b|--prod\b)"), ("netlify", r"\bnetlify\s+deploy\b"), ("gh-workflow", r"\bgh\s+workflow\s+run\b"),
    ("gh-release", r"\bgh\s+release\s+create\b"), ("kubectl", r"\bkubectl\s+apply\b"), ("helm", r"\bhelm\s+(upgrade|install)\b"), ("flyctl", r"\bfly(ctl)?\s+deploy\b"),
    ("firebase", r"\bfirebase\s+deploy\b"), ("serverless", r"\b(serverless|sls)\s+deploy\b"), ("eb", r"\beb\s+deploy\b"), ("cap", r"\bcap\s+\w+\s+deploy\b"),
    ("docker-push", r"\bdocker\s+push\b"), ("npm-deploy", r"\b(?:bun|yarn|pnpm|npm)\s+run\s+deploy\b"), ("make-deploy", r"\bmake\s+deploy\b"),
)
RUNNERS = ("test", "jest", "mocha", "rspec", "phpunit")  # whatever FRAMEWORKS match holds one of them
TRIM = r"(?U)^\s+|\s+$"


def segments(command: Column) -> Column:
    """Trimmed parts of a command line between separators, without quoted text and without empty ones."""
    bare = F.regexp_replace(F.coalesce(command, F.lit("")), r"""'[^']*'|"[^"]*\"""", " ")
    return F.filter(F.transform(F.split(bare, r"&&|\|{1,2}|[\n;]"), lambda s: F.regexp_replace(s, TRIM, "")), lambda s: s != "")


def program(segment: Column) -> Column:
    """The first word that assigns no variable, without its folder; null for none."""
    words = F.filter(F.split(segment, r"\s+"), lambda w: (w != "") & ~w.rlike(r"^\w+="))
    return F.substring_index(F.get(words, F.lit(0)), "/", -1)


def _first(names: tuple, text: Column) -> Column:
    out = None
    for name, pattern in names:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out


def may_run_tests(rendered_input: Column) -> Column:
    """False for JSON text of which no command with a test runner can be read; letters may be written as their codes."""
    return rendered_input.rlike("|".join((*RUNNERS, r"\\u")))


def test_framework(command: Column) -> Column:
    """Which test runner a command line starts; null for none. Most lines are told by a look for a runner's letters."""
    return F.when(command.rlike("|".join(RUNNERS)), framework_in(command))


def framework_in(command: Column) -> Column:
    """The same without that look; ``command`` is named once, so it may be an expression."""
    runs = F.filter(segments(command), lambda s: ~F.coalesce(program(s).isin(*READERS), F.lit(False)) & ~s.rlike(r"--(?:dry-run|co|collect-only|no-run)\b"))
    return F.get(F.filter(F.transform(runs, lambda s: _first(FRAMEWORKS, s)), lambda f: f.isNotNull()), F.lit(0))


def target_env(segment: Column) -> Column:
    """Words count only where they stand alone, not in paths, image names or after a single dash."""

    def bare(*words: str) -> str:
        return rf"(?<![/.:])(?<!(?<!-)-)\b({'|'.join(words)})\b(?![/.:-])"

    return F.when(segment.rlike(r"--prod\b|--production\b|" + bare("master", "main", "prod", "production")), "prod").when(segment.rlike(r"--env[= ]stag|" + bare("staging", "stage")), "staging").when(segment.rlike(r"--env[= ]dev|" + bare("preview", "dev", "development")), "dev").otherwise("unknown")


def deploy(command: Column) -> Column:
    """struct(method, target_env) of the first segment that deploys; null for none."""
    found = F.transform(segments(command), lambda s: F.struct(_first(DEPLOYS, s).alias("method"), target_env(s).alias("target_env")))
    return F.get(F.filter(found, lambda d: d["method"].isNotNull()), F.lit(0))


def lines(text: Column) -> Column:
    """Lines as Python's splitlines gives them."""
    parts = F.split(F.coalesce(text, F.lit("")), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]")
    return F.when(F.try_element_at(parts, F.lit(-1)) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("bigint")


def _counts(passed: Column, failed: Column, skipped: Column, errors: Column) -> Column:
    return F.struct(*(F.coalesce(c, F.lit(0)).cast("bigint").alias(k) for k, c in (("passed", passed), ("failed", failed), ("skipped", skipped), ("errors", errors))))


def output_counts(output: Column) -> Column:
    """struct(passed, failed, skipped, errors) by the first parser that finds anything; null for none."""
    parts = lines(output)
    tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 14, F.lit(1)), 15), "\n")
    zero = F.lit(0)
    p, f, s, e = (number(tail, rf"(\d+) {w}") for w in ("passed", "failed", "skipped", "error"))
    pytest = F.when(p.isNotNull() | f.isNotNull() | e.isNotNull(), _counts(p, f, s, e))
    j = r"Tests:\s+(?:([0-9]+) failed,\s+)?(?:([0-9]+) skipped,\s+)?([0-9]+) passed"
    jest = F.when(output.rlike(j), _counts(number(output, j, 3), number(output, j, 1), number(output, j, 2), zero))
    count = lambda r: F.regexp_count(output, F.lit(r)).cast("bigint")
    good, bad = count(r"(?m)^--- PASS"), count(r"(?m)^--- FAIL")
    neither = (good == 0) & (bad == 0)
    go = F.when(output.rlike(r"(?m)^(ok|FAIL|PASS)\b"), _counts(F.when(neither, count(r"(?m)^ok\s")).otherwise(good), F.when(neither, count(r"(?m)^FAIL\s")).otherwise(bad), zero, zero))
    g = r"([0-9]+)\s+passing(?:.*?([0-9]+)\s+failing)?"
    generic = F.when(output.rlike(g), _counts(number(output, g, 1), number(output, g, 2), zero, zero))
    return F.when(output != "", F.coalesce(pytest, jest, go, generic))


def test_run(command: Column, output: Column, exit_code: Column) -> Column:
    """struct(framework, passed, failed, skipped, errors, total, ok); null if no test ran."""
    framework, text = test_framework(command), F.coalesce(output, F.lit(""))
    c = F.coalesce(output_counts(text), _counts(*(F.lit(0),) * 4))
    total = c["passed"] + c["failed"] + c["skipped"] + c["errors"]
    silent = (total == 0) & (F.regexp_replace(text, TRIM, "") == "") & exit_code.isNull()
    ok = F.when(F.coalesce(exit_code, F.lit(0)) != 0, False).otherwise((total > 0) & (c["failed"] == 0) & (c["errors"] == 0))
    return F.when(framework.isNotNull() & ~silent, F.struct(framework.alias("framework"), c["passed"].alias("passed"), c["failed"].alias("failed"), c["skipped"].alias("skipped"), c["errors"].alias("errors"), total.alias("total"), ok.alias("ok")))


def relativize(command: Column, root: Column) -> Column:
    """The repository's root becomes "." where a path ends or goes on."""
    base = F.regexp_replace(root, "/+$", "")
    quoted = F.concat(F.lit(r"\Q"), base, F.lit(r"\E"), F.lit(r"""(?=/|$|[\s'";&|)])"""))
    return F.when((F.coalesce(base, F.lit("")) == "") | (command == ""), command).otherwise(F.regexp_replace(command, quoted, F.lit(".")))
