"""Commands, outputs, fidelity and text functions on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tracemill.functions import commands, fidelity, hashing, summary
from tracemill.operators import analytics
from tracemill.sources import logs


def one(spark, column, **values):
    """The value of a column expression over one row of literals."""
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def col(*names):
    return [F.col(n) for n in names]


@pytest.mark.parametrize(
    "command, want",
    [
        ("pytest -q", "pytest"), ("python -m pytest tests", "pytest"), ("FOO=1 BAR=x pytest", "pytest"), ("cd x && pytest | tail -3", "pytest"), ("grep pytest a.txt", None), ("cat pytest.ini", None),
        ("echo 'run pytest now'", None), ("cargo test --no-run", None), ("pytest --collect-only", None), ("npm run test:unit", "npm-test"), ("/usr/bin/git commit -m pytest", None), ("gradlew clean test", "gradle-test"),
        ("", None), (None, None), ("go test ./...", "go-test"), ("python3.11 -m unittest", "python-unittest"),
    ],
)
def test_framework(spark, command, want):
    assert one(spark, commands.test_framework(F.lit(command).cast("string"))) == want


@pytest.mark.parametrize(
    "command, want",
    [
        ("wrangler deploy --env production", ("wrangler", "prod")), ("kubectl apply -f k8s/dev.yaml", ("kubectl", "unknown")), ("echo 'fly deploy'", None), ("docker push registry/prod/app:1", ("docker-push", "unknown")),
        ("fly deploy --prod", ("flyctl", "prod")), ("helm upgrade a b --env staging", ("helm", "staging")), ("make deploy dev", ("make-deploy", "dev")), ("eb deploy my-prod", ("eb", "unknown")), ("ls", None),
    ],
)
def test_deploy(spark, command, want):
    got = one(spark, commands.deploy(F.lit(command)))
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(
    "output, want",
    [
        ("5438 failed\n" + "x\n" * 30 + "3 passed in 1s", (3, 0, 0, 0)), ("1 failed, 2 passed, 3 skipped, 1 error", (2, 1, 3, 1)), ("Tests:  2 failed, 1 skipped, 9 passed, 12 total\n" + "\n" * 20, (9, 2, 1, 0)),
        ("--- PASS: A\n--- FAIL: B\nFAIL", (1, 1, 0, 0)), ("ok  a 1s\nok  b 1s\nFAIL c", (2, 1, 0, 0)), ("12 passing\n3 failing", (12, 0, 0, 0)), ("12 passing (1s) 3 failing", (12, 3, 0, 0)), ("hello", None), ("", None),
    ],
)
def test_output(spark, output, want):
    got = one(spark, commands.output_counts(F.lit(output)))
    assert (got and tuple(got)) == want


@pytest.mark.parametrize("output, code, want", [("", None, None), ("", 101, (0, False)), ("odd", None, (0, False)), ("3 passed", None, (3, True)), ("3 passed", 1, (3, False)), ("1 failed, 2 passed", 0, (3, False))])
def test_test_run(spark, output, code, want):
    got = one(spark, commands.test_run(F.lit("pytest"), F.lit(output), F.lit(code).cast("int")))
    assert (got and (got.total, got.ok)) == want


def test_relativize(spark):
    cases = [("/w/app/x", "/w/app", "./x"), ("/w/application", "/w/app", "/w/application"), ("cd /w/app/ && ls /w/app", "/w/app/", "cd ./ && ls ."), ("ls", None, "ls"), ("a", "/", "a")]
    df = spark.createDataFrame(cases, "c string, r string, want string").select(commands.relativize(*col("c", "r")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def test_lines_as_python_splits_them(spark):
    for text in ("", "a", "a\n", "a\r\nb\x0bc\x85d", "\n\n", "a\n\nb"):
        assert one(spark, commands.lines(F.lit(text))) == text.splitlines()


def test_fidelity(spark):
    s = lambda a, b: fidelity.scored(spark.createDataFrame([(a, b)], "a string, b string"), "a", "b").first().score
    assert s("same", "same").composite == 1 and s("same", "same").exact
    assert s("at 2024-01-02 03:04:05 done", "at 2023-11-12 13:14:15 done").factuality == 1
    empty = s("", "abc def")
    assert (empty.factuality, empty.consistency, empty.realism, empty.quality) == (0, 0, 0, 0) and empty.composite == 0.1
    assert one(spark, fidelity.response_type(F.lit("Traceback (most)"))) == "error" and one(spark, fidelity.response_type(F.lit("  "))) == "empty"
    assert one(spark, fidelity.is_json(F.lit(' {"a": 1}'))) and not one(spark, fidelity.is_json(F.lit("{bad"))) and not one(spark, fidelity.is_json(F.lit("1")))
    assert one(spark, fidelity.mask_runtime(F.lit("0xFF took 12 ms pid=3"))) == "§RT§ took §RT§ §RT§"
    assert one(spark, fidelity.realness(F.lit("me@host:~$ ls took 12ms " + "x" * 200))) == 1 + 2 + 2


def test_text_features(spark):
    f = one(spark, fidelity.text_features(F.lit("Error: why? ```x``` error")))
    assert f.keyword_hits == 2 and f.question_marks == 1 and f.code_fences == 2 and f.avg_word_length == pytest.approx(22 / 4)


def test_hash_fraction(spark):
    assert one(spark, hashing.fraction(F.lit("0:ep_1"))) == 0.43909725663252175


def test_token_level(spark):
    arr = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    assert one(spark, analytics.gae(arr(0, 0, 1), arr(0.5, 0.5, 0.5), F.array(*map(F.lit, (1, 1, 1))))) == pytest.approx([0.5, 0.5, 0.5])
    assert one(spark, analytics.gae(arr(0, 9, 1), arr(0.5, 0.5, 0.5), F.array(*map(F.lit, (1, 0, 1))))) == pytest.approx([0.5, 0.0, 0.5])
    m = one(spark, analytics.dis_mask(arr(1, 1, 1), arr(0, 0.5, -0.5), arr(0, 0, 0)))
    assert m.kept == [1, 0, 0] and m.masked == 2
    assert one(spark, analytics.action_format(F.lit("ACTION Bash({}) @ /w"))) == 1 and one(spark, analytics.action_format(F.lit("(x)"))) == pytest.approx(0.3)


def test_ci(spark):
    ci = lambda *c: one(spark, analytics.ci_status(F.array(*(F.lit(x).cast("string") for x in c))))
    assert (ci("SUCCESS", "SUCCESS"), ci("SUCCESS", "ERROR"), ci("SUCCESS", None), ci("PENDING")) == ("success", "failure", "pending", "pending")
    assert one(spark, analytics.ci_status(F.lit(None).cast("array<string>"))) is None


DIFF = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -3,2 +3,3 @@ f\n-a\n+b\n+c\n z\n@@ -9 +10,0 @@\n-q\ndiff --git a/n b/n\nnew file mode 100644\n--- /dev/null\n+++ b/n\n@@ -0,0 +1 @@\n+x\ndiff --git a/p.bin b/p.bin\nBinary files a/p.bin and b/p.bin differ\n"


def test_diffs_and_patches(spark):
    files = [(f.file, f.status, f.additions, f.deletions) for f in one(spark, logs.diff_files(F.lit(DIFF)))]
    assert files == [("x.py", "modified", 2, 2), ("n", "added", 1, 0), ("p.bin", "binary", 0, 0)]
    assert [tuple(r) for r in one(spark, logs.old_ranges(F.lit(DIFF)))] == [("x.py", 3, 2), ("x.py", 9, 1)]
    assert one(spark, logs.diff_files(F.lit(None).cast("string"))) == []
    p = logs.patch_parts(spark.createDataFrame([("*** Begin Patch\n*** Add File: a b\n+1\n+2\n*** Delete File: c\n*** End Patch",), (None,)], "patch string"))
    assert [(r.op, r.path, r.body, r.tool) for r in p.collect()] == [("Add", "a b", "+1\n+2", "Write"), ("Delete", "c", "", "DeleteFile")]


def test_first_json_object(spark):
    rows = spark.createDataFrame([('x {"a": "}"} y',), ("{bad} {\"b\": [1]}",), ("none",), (None,)], "t string")
    assert [r.x for r in rows.select(logs.first_json_object("t").alias("x")).collect()] == ['{"a": "}"}', '{"b": [1]}', None, None]


def test_pull_request_title(spark):
    df = spark.createDataFrame([("\n  please fix the  bug \nmore", []), ("", ["a.py"]), (None, [])], "intent string, files array<string>").withColumn("diffs", F.transform("files", lambda f: F.struct(f.alias("file"))))
    assert [r.t for r in df.select(summary.title().alias("t")).collect()] == ["Fix the  bug", "Update a.py", "Coding session changes"]
