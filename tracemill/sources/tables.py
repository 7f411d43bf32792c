"""Episodes, steps and session events out of the relational tables that the queries run on.

Each adapter has a twin in ``tracemill.oracle``, from which the expected results are computed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMANDS = (
    "python -m pytest -q tests/", "FOO=1 pytest -x | tail -5", "grep pytest setup.cfg", "npm run test:unit", "cargo test --no-run", "go test ./...",
    "echo 'pytest' && make test", "cd app && npm test", "kubectl apply -f k8s/dev.yaml", "wrangler deploy --env production", "fly deploy --prod", "git push origin main",
    "helm upgrade app ./chart --env staging", "docker push registry/prod/app:1", "cat Makefile; mvn -q test", "echo \"make deploy\"",
)
OUTPUTS = (
    "collected 5 items\n5 passed in 0.1s", "2 failed, 3 passed, 1 skipped in 2.5s", "Tests:       1 failed, 2 skipped, 7 passed, 10 total", "ok  \tpkg/a\t0.1s\nFAIL\tpkg/b\t0.2s",
    "--- PASS: TestA\n--- FAIL: TestB\nFAIL", "  12 passing (30ms)\n  2 failing", "", "1 error in 0.3s",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def episodes(spark: SparkSession, sf_dir: str, brief: tuple[str, ...] = ()) -> DataFrame:
    """One episode for each order; its lines are steps, test runs and diffs. Columns of the episode schema, and ``ord``.

    ``brief``: those of steps, tests and diffs that are built with the fields only that scores read."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_shipdate").alias("d"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").cast("bigint").alias("q"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("t"), F.col("l_discount").alias("c"), F.col("l_tax").alias("tax")).alias("line"))
    counted = dict(file_edits="f = 'A'", file_reads="f = 'N'", shell_commands="f = 'R'", tests_run="f <> 'N'", denials="tax > 0.07")
    lines = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"), *(F.count_if(F.expr(f"line.{c}")).cast("int").alias(f"n_{k}") for k, c in counted.items()))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = "cast(array() as array<struct<n:int,p:bigint,s:bigint,d:timestamp,x:double,q:bigint,f:string,t:string,c:double,tax:double>>)"
    o = o.withColumn("lines", F.coalesce("lines", F.expr(none))).withColumn("created_at", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    e = F.expr
    count = lambda k: f"coalesce(n_{k}, 0)"
    broken = "l.f = 'R' and l.t = 'O'"
    tests = f"""transform(filter(lines, l -> l.f <> 'N'), l -> struct(created_at as ts, 'pytest' as framework, 'pytest -q' as command,
        case when {broken} then 0L when l.f = 'R' then l.q div 2 else l.q end as passed, case when {broken} then 0L when l.f = 'R' then l.q - l.q div 2 else 0L end as failed,
        0L as skipped, case when {broken} then l.q else 0L end as errors, case when l.n = 7 then 0L else l.q end as total, l.f <> 'R' as ok, '' as output_excerpt, false as reconstructed))"""
    steps = """transform(lines, (l, i) -> struct(i as index, created_at as ts,
        case when l.f = 'A' then 'file_edit' when l.f = 'R' then 'shell_command' when l.n % 2 = 1 then 'file_read' else 'user_prompt' end as type,
        case when l.f = 'A' then 'Edit' when l.f = 'R' then 'Bash' when l.n % 2 = 1 then 'Read' end as tool, '' as intent,
        case when l.f = 'R' then concat('{"command": "', if(l.p % 2 = 0, 'pytest -q', 'ls src'), '"}') when l.f = 'N' and l.n % 2 = 0 then concat('{"prompt": "look at part ', l.p, '"}') else concat('{"file_path": "src/m', l.p % 50, '.py"}') end as input,
        case when l.n = 5 then '' else concat('part ', l.p, ' has ', l.q, if(l.f = 'R', ' failed', ' lines')) end as observation, true as approved, if(l.s % 3 = 0, null, concat('/w/', l.s % 4)) as cwd, cast(null as bigint) as duration_ms))"""
    diffs = """transform(filter(lines, l -> l.f = 'A'), l -> struct(
        case when l.p % 3 = 0 then concat('docs/d', l.p % 50, '.md') when l.p % 3 = 1 then concat('src/m', l.p % 50, '.py') else concat(if(l.p % 2 = 0, 'tests/test_', 'src/auth_'), l.p % 50, '.py') end as file,
        if(l.p % 4 = 0, 'deleted', 'modified') as status, l.q as additions, cast(l.n as bigint) as deletions, if(l.p % 5 = 0, concat('+++ b/x\\n+# TODO: part ', l.p, '\\n-old'), null) as unified))"""
    if "tests" in brief:
        tests = f"""transform(filter(lines, l -> l.f <> 'N'), l -> struct(case when {broken} then 0L when l.f = 'R' then l.q div 2 else l.q end as passed, case when {broken} then 0L when l.f = 'R' then l.q - l.q div 2 else 0L end as failed,
            case when {broken} then l.q else 0L end as errors, case when l.n = 7 then 0L else l.q end as total, l.f <> 'R' as ok))"""
    if "steps" in brief:
        steps = """transform(lines, (l, i) -> struct(i as index, case when l.f = 'A' then 'file_edit' when l.f = 'R' then 'shell_command' when l.n % 2 = 1 then 'file_read' else 'user_prompt' end as type,
            case when l.f = 'R' then if(l.p % 2 = 0, '{"command": "pytest -q"}', '{"command": "ls src"}') end as input))"""
    if "diffs" in brief:
        diffs = """transform(filter(lines, l -> l.f = 'A'), l -> struct(
            case when l.p % 3 = 0 then concat('docs/d', l.p % 50, '.md') when l.p % 3 = 1 then concat('src/m', l.p % 50, '.py') else concat(if(l.p % 2 = 0, 'tests/test_', 'src/auth_'), l.p % 50, '.py') end as file))"""
    one = "named_struct('ts', {}, 'label', '{}', 'note', '', 'source', '{}', 'confidence', cast({} as double), 'evidence_step_index', cast({} as int), 'model', '')".format
    later = "concat(created_at, 'Z')"
    none_yet = "cast(array() as array<struct<ts:string,label:string,note:string,source:string,confidence:double,evidence_step_index:int,model:string>>)"
    feedback = f"""case substr(o_orderpriority, 1, 1) when '1' then array({one(later, 'useful', 'user', 'null', 'null')})
        when '3' then array({one('created_at', 'too_slow', 'mined', '0.5', '1')}, {one(later, 'accepted_after_edits', 'user', '0.9', 'null')})
        when '5' then array({one(later, 'wrong', 'mined', '0.8', 'o_orderkey % 3')}) else {none_yet} end"""
    deployments = """case when o_orderkey % 5 = 0 then array(struct(created_at as ts, 'fly deploy' as command, 'flyctl' as method, if(o_orderkey % 2 = 0, 'prod', 'staging') as target_env, cast(o_orderkey % 3 as int) as exit_code, if(o_orderkey % 3 = 0, cast(null as boolean), false) as verified, false as reconstructed))
        else cast(array() as array<struct<ts:string,command:string,method:string,target_env:string,exit_code:int,verified:boolean,reconstructed:boolean>>) end"""
    ran = "named_struct('ts', created_at, 'command', '{}', 'cwd', {}, 'exit_code', {}, 'output_excerpt', '', 'is_test', {}, 'reconstructed', false)".format
    ran_none = "cast(array() as array<struct<ts:string,command:string,cwd:string,exit_code:int,output_excerpt:string,is_test:boolean,reconstructed:boolean>>)"
    commands = f"""case o_orderkey % 8 when 3 then array({ran('ls src', "'/w'", 0, 'false')}, {ran('make test', "'/w/app'", 0, 'true')}, {ran('npm test', 'null', 0, 'true')})
        when 5 then array({ran('make test', "'/w'", 1, 'true')}) else {ran_none} end"""
    return o.select(
        F.col("o_orderkey").alias("ord"),
        e("concat('ep_', lpad(o_orderkey, 10, '0'))").alias("id"), F.lit("0.1.0").alias("schema_version"), "created_at", e("element_at(array('claude-code', 'codex', 'unknown'), cast(o_orderkey % 3 as int) + 1)").alias("agent"),
        e("concat(if(o_custkey % 5 = 0, ' Fix ', 'Please refactor the billing module and add tests for '), 'customer ', o_custkey)").alias("intent"),
        e("struct('/w' as root, if(o_custkey % 7 = 6, '', concat('repo', o_custkey % 7)) as repo, if(o_orderkey % 4 = 0, null, 'https://git.example.org/r.git') as remote_url, concat('b', o_orderkey % 9) as branch, substr(md5(cast(o_orderkey as string)), 1, 7) as base_commit, false as dirty)").alias("repo_state"),
        e(steps).alias("steps"), e(diffs).alias("diffs"), e(commands).alias("commands"), e(tests).alias("tests"), e(feedback).alias("human_feedback"),
        e("struct(case o_orderstatus when 'F' then 'merged' when 'O' then 'open' else 'failed' end as status, substr(md5(cast(o_orderkey as string)), 1, 12) as commit, o_orderkey % 17 = 0 as caused_regression, if(o_orderkey % 3 = 0, null, cast(o_orderkey % 1000 as bigint)) as pr_number, if(o_orderstatus = 'O', 'OPEN', 'CLOSED') as pr_state, case o_orderkey % 4 when 0 then null when 1 then 'pending' else 'success' end as ci_status)").alias("outcome"),
        e(f"struct({', '.join(f'{count(k)} as {k}' for k in counted)}, round(aggregate(lines, 0D, (a, l) -> a + l.c), 2) as cost_usd)").alias("stats"),
        e("case when o_orderkey % 2 = 0 then array(concat('area', o_orderkey % 6)) else cast(array() as array<string>) end").alias("labels"),
        e("case when o_orderkey % 7 = 0 then struct(element_at(array('yes', 'partial', 'no', 'unclear'), cast(o_orderkey % 4 as int) + 1) as success, (o_orderkey % 11) / 10D as confidence) end").alias("outcome_hint"),
        e(deployments).alias("deployments"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as steps (episode_id, index, type, tool, input, observation, intent of the episode)."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "user_prompt").when(F.col("role") == "assistant", "tool_post").otherwise("note")
    return c.select(F.col("conv_id").alias("episode_id"), F.col("turn").alias("index"), kind.alias("type"), F.when(F.col("role") == "assistant", "Reply").alias("tool"), F.col("role").alias("role"), F.col("text").alias("observation"))


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as session events (session_id, seq, ts, type, tool_name, command, exit_code, file_path, approved, tokens, cost)."""
    ev = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "user_prompt").when(F.col("event_type") == "view", "file_read").when(F.col("event_type") == "click", "file_edit").when(F.col("event_type") == "purchase", "shell_command").otherwise("denial")
    k = F.get_json_object("props", "$.k").cast("int")
    command = F.element_at(F.array(*map(F.lit, COMMANDS)), (F.col("event_id") % len(COMMANDS)).cast("int") + 1)
    output = F.element_at(F.array(*map(F.lit, OUTPUTS)), (F.col("event_id") % len(OUTPUTS)).cast("int") + 1)
    return ev.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), "ts", kind.alias("type"), F.col("event_type").alias("source_type"), F.col("value"), k.alias("k"),
        F.when(F.col("event_type") == "purchase", command).alias("command"), F.when(F.col("event_type") == "purchase", output).alias("output"),
        F.when((F.col("event_type") == "purchase") & (k % 4 != 3), k % 4).alias("exit_code"), F.when(F.col("event_type").isin("click", "view"), F.concat(F.lit("src/f"), (k % 20).cast("string"), F.lit(".py"))).alias("file_path"),
        F.when(F.col("event_type") == "signup", F.concat(F.when(k % 3 == 0, "yes, ").otherwise(""), F.lit("work on item "), k.cast("string"), F.when(k % 2 == 0, " and describe in detail what has changed there").otherwise(""))).alias("prompt"),
        (F.col("event_type") != "error").alias("approved"),
    )


def hooked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session events with tools, folders and inputs, as hooks give them; files lie below a root."""
    ev = session_events(spark, sf_dir)
    tool = F.when(F.col("type") == "file_edit", "Edit").when(F.col("type") == "file_read", "Read").when(F.col("type").isin("shell_command", "denial"), "Bash")
    path = F.concat(F.lit("/w/app/"), F.col("file_path"))
    given = F.when(F.col("type") == "shell_command", F.to_json(F.struct("command"))).when(path.isNotNull(), F.to_json(F.struct(path.alias("file_path"))))
    return ev.withColumns({"tool_name": tool, "tool_input": given, "file_path": path, "cwd": F.when(F.col("k") % 3 != 0, F.concat(F.lit("/w/app"), F.when(F.col("k") % 3 == 1, "/sub").otherwise("")))})


def session_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meta data of every other session."""
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id")).distinct().where("session_id % 2 = 0")
    e = F.expr
    return s.select(
        "session_id", e("if(session_id % 4 = 0, 'codex', '')").alias("agent"), e("if(session_id % 6 = 0, concat('task ', session_id), null)").alias("intent"), F.lit("2024-05-01T00:00:00").alias("created_at"),
        e("named_struct('root', if(session_id % 8 = 0, '/w/app/src', null), 'repo', 'app', 'branch', 'main')").alias("repo_state"), e("array('zone', concat('area', session_id % 3))").alias("labels"),
        e("named_struct('input_tokens', session_id * 10, 'output_tokens', session_id, 'cost_usd', 0.5D)").alias("usage"), e("if(session_id % 10 = 0, array(named_struct('ts', '2024-01-01', 'label', 'useful', 'source', 'mined')), null)").alias("human_feedback"),
        e("if(session_id % 12 = 0, named_struct('status', 'merged'), null)").alias("outcome"),
    )
