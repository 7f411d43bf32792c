"""Sessions: from ordered events to steps, commands, tests, statistics, segments and feedback.

``events`` have session_id, seq (arrival order), ts, type and the fields of their type; see ``sources.tables``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from tracemill.functions import commands, score
from tracemill.schema import EPISODE, normalised
from tracemill.sources import logs

STEP_TYPES = "denial user_prompt shell_command tool_post file_read file_edit file_write file_delete".split()
CONTINUES = "yes|y|ok|okay|sure|continue|proceed|next|yeah|yep|and|also|then|again|try again|run it|please do|go on|do it|do that|do both|do a|do b|do c"
STATUS = {"file_edit": "modified", "file_write": "added", "file_delete": "deleted"}


def arrival():
    return Window.partitionBy("session_id").orderBy("seq")


def episode_id(session_id: Column) -> Column:
    """The key by which a session and its episode find each other."""
    return F.concat(F.lit("ep_"), F.substring(F.sha1(session_id.cast("string")), 1, 12))


def stats(events: DataFrame) -> DataFrame:
    """A1: a row of counts for each session."""
    count = lambda *kinds: F.count_if(F.col("type").isin(*kinds))
    edits = ("file_edit", "file_write", "file_delete")
    return events.groupBy("session_id").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.floor((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1000).alias("duration_ms"),
        count(*edits, "file_read", "shell_command", "tool_post").alias("tool_calls"), count("file_read").alias("file_reads"), count(*edits).alias("file_edits"),
        count("shell_command").alias("shell_commands"), count("denial").alias("denials"), F.count_if("approved").alias("approvals"),
    )


def steps(events: DataFrame) -> DataFrame:
    """Events that are steps, numbered without gaps, with the step's intent."""
    kept = events.where(F.col("type").isin(*STEP_TYPES))
    verb = F.when(F.col("type") == "file_edit", "edit").when(F.col("type") == "file_write", "write").when(F.col("type") == "file_read", "read").when(F.col("type") == "file_delete", "delete")
    line = F.substring(F.regexp_replace(F.regexp_extract(F.coalesce("prompt", F.lit("")), r"(?Um)^\s*(\S[^\n]*)$", 1), commands.TRIM, ""), 1, 200)
    tool = F.nullif("tool_name", F.lit("")) if "tool_name" in events.columns else F.lit(None).cast("string")
    intent = F.when(F.col("type") == "user_prompt", line).when(F.col("type") == "shell_command", F.substring(F.coalesce("command", F.lit("")), 1, 200)).when(verb.isNotNull(), F.concat(verb, F.lit(" "), F.coalesce(F.nullif("file_path", F.lit("")), F.lit("?")))).when(F.col("type") == "denial", F.concat(F.lit("denied "), F.coalesce(tool, F.lit("tool")))).otherwise(F.coalesce(tool, F.col("type")))
    return kept.withColumn("index", F.row_number().over(arrival()) - 1).withColumn("intent", intent)


def shell(events: DataFrame) -> DataFrame:
    """Shell commands with what they are (test run, deployment) and how they ended."""
    s = events.where("type = 'shell_command'").withColumn("run", commands.test_run(F.col("command"), F.col("output"), F.col("exit_code"))).withColumn("deploy", commands.deploy(F.col("command")))
    failed = F.when(F.coalesce("exit_code", F.lit(0)) != 0, F.lit(False))
    return s.withColumn("is_test", commands.test_framework(F.col("command")).isNotNull()).withColumn("verified", F.when(F.col("deploy").isNotNull(), failed))


def touched_files(events: DataFrame) -> DataFrame:
    """A2: each file's last change, in a session."""
    kinds = F.when(F.col("type") == "file_edit", "modified").when(F.col("type") == "file_write", "added").when(F.col("type") == "file_delete", "deleted")
    return events.where(F.col("type").isin(*STATUS) & (F.coalesce("file_path", F.lit("")) != "")).groupBy("session_id", F.col("file_path").alias("file")).agg(F.max_by(kinds, "seq").alias("status"))


def new_task(prompt: Column) -> Column:
    """long enough, and not beginning as a continuation."""
    flat = F.lower(F.trim(F.regexp_replace(F.coalesce(prompt, F.lit("")), r"(?U)\s+", " ")))
    return (F.length(flat) >= 40) & ~flat.rlike(rf"^(?:{CONTINUES})(?:$|[ ,])")


def segmented(events: DataFrame) -> DataFrame:
    """Adds ``segment`` from 0: a new one at each prompt that opens a task; the first prompt always does.

    Events before the first prompt make a segment of their own. Session starts belong to every segment; they have none here."""
    body = events.where("type <> 'session_start'")
    prompts = F.sum((F.col("type") == "user_prompt").cast("int")).over(arrival().rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.col("type") == "user_prompt") & ((F.coalesce(prompts, F.lit(0)) == 0) | new_task(F.col("prompt")))
    first = F.row_number().over(arrival()) == 1
    return body.withColumn("__opens", (opens | first).cast("int")).withColumn("segment", F.sum("__opens").over(arrival()) - 1).drop("__opens")


def with_prelude(events: DataFrame) -> DataFrame:
    """Segmented events, and each session's start events in each of its segments."""
    parts = segmented(events)
    starts = events.where("type = 'session_start'").join(parts.select("session_id", "segment").distinct(), "session_id")
    return parts.unionByName(starts)


def feedback_segments(feedback: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds to ``feedback(session_id, ts)`` the last segment that had started by then: 0 before all, the last one for a
    time stamp that is none. ``segments(session_id, segment, start)``; sessions without segments fall away.

    Starts and feedback stand in one order by time, in which a running maximum gives the segment: one exchange by session."""
    columns = feedback.columns
    rows = feedback.select("session_id", F.col("ts").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast("bigint").alias("__s"), F.struct(*columns).alias("__row"))
    starts = segments.select("session_id", F.col("start").alias("__at"), F.lit(0).alias("__kind"), F.col("segment").cast("bigint").alias("__s"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"))
    w = Window.partitionBy("session_id")
    upto = F.max("__s").over(w.orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0))
    both = rows.unionByName(starts).withColumns({"__upto": upto, "__last": F.max("__s").over(w)}).where("__kind = 1 and __last is not null")
    return both.select("__row.*", F.when(F.col("__at").isNull(), F.col("__last")).otherwise(F.coalesce("__upto", F.lit(0))).alias("segment"))


def turns(steps_: DataFrame) -> DataFrame:
    """Each prompt opens a turn of the actions that follow; actions before the first prompt fall away. One row a turn."""
    w = Window.partitionBy("session_id").orderBy("index")
    t = steps_.withColumn("turn", F.sum((F.col("type") == "user_prompt").cast("int")).over(w)).where("turn > 0")
    count = lambda *kinds: F.count_if(F.col("type").isin(*kinds))
    return t.groupBy("session_id", "turn").agg(F.min("index").alias("index"), F.min_by("prompt", "index").alias("prompt"), count("file_edit", "file_write", "file_delete").alias("edits"), count("shell_command").alias("commands"), count("file_read").alias("reads"), count("denial").alias("denials"))


def rendered_turns(turns_: DataFrame, clip: int = 400, budget: int = 6000) -> DataFrame:
    """A session's turns as text, its last ``budget`` characters."""
    part = lambda c, name: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {name}(s)")))
    summary = F.concat_ws(", ", part("edits", "edit"), part("commands", "command"), part("reads", "read"), part("denials", "denial"))
    prompt = F.substring(F.trim(F.regexp_replace(F.coalesce("prompt", F.lit("")), r"(?U)\s+", " ")), 1, clip)
    line = F.concat(F.lit("[#"), F.col("index").cast("string"), F.lit("] USER: "), prompt, F.when(summary != "", F.concat(F.lit("\n    agent: "), summary)).otherwise(""))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n")
    return turns_.groupBy("session_id").agg(whole.alias("text")).select("session_id", F.when(F.length("text") > budget, F.substring("text", -budget, budget)).otherwise(F.col("text")).alias("text"))


def ordinal_backfill(events: DataFrame, records: DataFrame) -> DataFrame:
    """The k-th run of a command takes the k-th record's exit code, if there are as many runs as records.

    ``events(session_id, seq, command, exit_code)``, ``records(session_id, ord, command, exit_code)``; a code that is known stays."""
    key = ["session_id", "command"]
    number = lambda d, o: d.withColumns({"__k": F.row_number().over(Window.partitionBy(*key).orderBy(o)), "__n": F.count("*").over(Window.partitionBy(*key))})
    r = number(records, "ord").select(*key, "__k", "__n", F.col("exit_code").alias("__code"))
    return number(events, "seq").join(r, [*key, "__k", "__n"], "left").withColumn("exit_code", F.coalesce("exit_code", "__code")).drop("__k", "__n", "__code")


def reconstructed_failures(events: DataFrame, records: DataFrame) -> DataFrame:
    """Failed commands that left only their announcement, as rows to put right behind it.

    Only where a command's announcements are as many as its records, and its completions as many as the records without
    error. Gives (session_id, seq of the announcement, command, exit_code, output); order by (seq, 1) puts them in place."""
    key = ["session_id", "command"]
    w = Window.partitionBy(*key)
    pre = events.where("type = 'tool_pre'").withColumns({"__k": F.row_number().over(w.orderBy("seq")), "__pre": F.count("*").over(w)})
    post = events.where("type = 'shell_command'").groupBy(*key).agg(F.count("*").alias("__post"))
    r = records.withColumns({"__k": F.row_number().over(w.orderBy("ord")), "__n": F.count("*").over(w), "__ok": F.count_if(~F.col("is_error")).over(w)})
    rows = pre.select(*key, "seq", "__k", "__pre").join(r.select(*key, "__k", "__n", "__ok", "is_error", "exit_code", "output"), [*key, "__k"]).join(post, key, "left")
    return rows.where((F.col("__pre") == F.col("__n")) & (F.coalesce("__post", F.lit(0)) == F.col("__ok")) & F.col("is_error")).select("session_id", "seq", "command", "exit_code", "output")


def merged_feedback(own: DataFrame, mined: DataFrame) -> DataFrame:
    """Mined feedback is added where its label and step aren't there yet, own or mined before."""
    both = own.withColumn("__p", F.lit(0)).unionByName(mined.withColumn("__p", F.lit(1)))
    w = Window.partitionBy("session_id", "label", "evidence_step_index").orderBy("__p", "ord")
    return both.withColumn("__rn", F.row_number().over(w)).where("__p = 0 or __rn = 1").drop("__p", "__rn")


FIELDS = dict(source="string", tool_name="string", tool_input="string", cwd="string", prompt="string", command="string", response="string", exit_code="int", file_path="string", approved="boolean", reconstructed="boolean")
META = {k: EPISODE[k] for k in ("agent", "intent", "created_at", "repo_state", "human_feedback", "outcome", "labels", "outcome_hint")} | {"cwd": "string", "usage": "struct<input_tokens:bigint,output_tokens:bigint,cost_usd:double>", "working_diff": "string"}
OBSERVATION, EXCERPT = 600, 2000


def resolved(events: DataFrame, meta: DataFrame) -> DataFrame:
    """A session's intent and folder: of its meta data, else the first prompt's and the first that is named."""
    e, m = _typed(events, FIELDS), _typed(meta, META)
    cwd = F.nullif("cwd", F.lit(""))
    first = e.groupBy("session_id").agg(F.min_by("prompt", F.when(F.col("type") == "user_prompt", F.col("seq"))).alias("prompt"), F.min_by(cwd, F.when(cwd.isNotNull(), F.col("seq"))).alias("__cwd"))
    m = m.select("session_id", F.nullif("intent", F.lit("")).alias("__intent"), F.nullif("cwd", F.lit("")).alias("__folder"))
    return first.join(m, "session_id", "left").select("session_id", F.coalesce("__intent", "prompt", F.lit("")).alias("intent"), F.coalesce("__folder", "__cwd").alias("cwd"))


def _typed(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``df`` with the named columns, null where it has none; ``output`` is another name of ``response``."""
    if "response" in fields and "response" not in df.columns and "output" in df.columns:
        df = df.withColumnRenamed("output", "response")
    return df.withColumns({k: _as(F.col(k), df.schema[k].dataType, v) if k in df.columns else F.lit(None).cast(v) for k, v in fields.items()})


def _as(c: Column, have: DataType, want: str) -> Column:
    """A column as another type; fields of structs by their names, those it lacks as nulls."""
    if isinstance(have, StructType):
        return F.when(c.isNotNull(), F.from_json(F.to_json(c), want))
    if isinstance(have, ArrayType) and isinstance(have.elementType, StructType):
        return F.when(c.isNotNull(), F.from_json(F.to_json(c), want))
    return c.cast(want)


def relative_path(path: Column, base: Column) -> Column:
    """A path below the base without it, the base itself as "."; without looking at any file system."""
    root = F.regexp_replace(base, "/+$", "")
    below = F.when(path == root, F.lit(".")).when(F.startswith(path, F.concat(root, F.lit("/"))), F.expr("null").cast("string")).otherwise(path)
    rest = F.regexp_replace(F.substr(path, F.length(root) + 2), "^/+", "")
    return F.when((F.coalesce(root, F.lit("")) == "") | (F.coalesce(path, F.lit("")) == ""), path).otherwise(F.coalesce(below, rest))


def observation() -> Column:
    """What a step saw: the answer, else the prompt, cut."""
    return F.substring(F.coalesce(F.nullif("response", F.lit("")), F.col("prompt"), F.lit("")), 1, OBSERVATION)


def scoped_diffs(parsed: Column, touched: Column, own: Column) -> Column:
    """struct(diffs, source): of a parsed working diff the files that the session touched, all of it if that is none;
    the events' own files where nothing of it is left."""
    scoped = F.filter(parsed, lambda d: F.array_contains(touched, d["file"]))
    tree = F.lit("git-working-tree")
    return F.when(parsed.isNull(), F.struct(own.alias("diffs"), F.lit("events").alias("source"))).when(F.size(touched) == 0, F.struct(parsed.alias("diffs"), tree.alias("source"))).when(F.size(scoped) > 0, F.struct(scoped.alias("diffs"), tree.alias("source"))).otherwise(F.struct(own.alias("diffs"), F.lit("events").alias("source")))


def built(events: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """An episode of the whole schema for each session of ``events``, without scores, in one shuffle by session.

    ``meta(session_id, ...)`` may have any of ``META``; what it says goes before what events say. Nested arrays stand in the
    order of arrival; files of a session come sorted by path, each with its last change."""
    e = _typed(events, FIELDS)
    m = _typed(meta if meta is not None else events.sparkSession.createDataFrame([], e.select("session_id").schema), META).select("session_id", F.struct(*META).alias("__meta"))
    e = e.join(m, "session_id", "left").withColumns({"response": F.coalesce("response", F.lit("")), "ts": F.col("ts").cast("string")})
    kind, root = F.col("type"), F.col("__meta.repo_state.root")
    shell_, command = kind == "shell_command", F.coalesce("command", F.lit(""))
    relative = commands.relativize(command, root)
    e = e.withColumn("__command", F.when(shell_, F.when(F.coalesce(root, F.lit("")) == "", command).otherwise(relative)))
    e = e.withColumns({"__run": F.when(shell_, commands.test_run(F.col("__command"), F.col("response"), F.col("exit_code"))), "__deploy": F.when(shell_, commands.deploy(command)), "__test": F.when(shell_, commands.test_framework(F.col("__command")).isNotNull())})
    verb = F.when(kind == "file_edit", "edit").when(kind == "file_write", "write").when(kind == "file_read", "read").when(kind == "file_delete", "delete")
    line = F.substring(F.regexp_replace(F.regexp_extract(F.coalesce("prompt", F.lit("")), r"(?Um)^\s*(\S[^\n]*)$", 1), commands.TRIM, ""), 1, 200)
    tool = F.nullif("tool_name", F.lit(""))
    intent = F.when(kind == "user_prompt", line).when(shell_, F.substring(command, 1, 200)).when(verb.isNotNull(), F.concat(verb, F.lit(" "), F.coalesce(F.nullif("file_path", F.lit("")), F.lit("?")))).when(kind == "denial", F.concat(F.lit("denied "), F.coalesce(tool, F.lit("tool")))).otherwise(F.coalesce(tool, kind))
    given = F.coalesce(F.when(~F.col("tool_input").isin("", "{}", "null"), F.col("tool_input")), F.when(kind == "user_prompt", F.to_json(F.struct(F.coalesce("prompt", F.lit("")).alias("prompt")))), F.lit("{}"))
    again, excerpt = F.coalesce("reconstructed", F.lit(False)), F.substring("response", 1, OBSERVATION)
    step = F.struct("ts", "type", F.col("tool_name").alias("tool"), intent.alias("intent"), given.alias("input"), observation().alias("observation"), "approved", "cwd")
    run = F.struct("ts", "__run.framework", F.col("__command").alias("command"), *(F.col(f"__run.{k}").alias(k) for k in ("passed", "failed", "skipped", "errors", "total", "ok")), F.when(F.length("response") > EXCERPT, F.substring("response", -EXCERPT, EXCERPT)).otherwise(F.col("response")).alias("output_excerpt"), again.alias("reconstructed"))
    status = F.when(kind == "file_edit", "modified").when(kind == "file_write", "added").when(kind == "file_delete", "deleted")
    ordered = lambda cond, x: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("seq", x.alias("x"))))), lambda r: r["x"])
    count = lambda *kinds: F.count_if(kind.isin(*kinds)).alias
    first = lambda c, cond: F.min_by(c, F.when(cond, F.col("seq")))
    when = F.try_to_timestamp("ts")
    parts = e.groupBy("session_id").agg(
        F.any_value("__meta").alias("m"), first("source", F.lit(True)).alias("source"), first("cwd", F.coalesce("cwd", F.lit("")) != "").alias("folder"), first("prompt", kind == "user_prompt").alias("prompt"),
        ordered(kind.isin(*STEP_TYPES), step).alias("steps"),
        ordered(shell_, F.struct("ts", F.col("__command").alias("command"), "cwd", "exit_code", excerpt.alias("output_excerpt"), F.col("__test").alias("is_test"), again.alias("reconstructed"))).alias("commands"),
        ordered(F.col("__run").isNotNull(), run).alias("tests"),
        ordered(F.col("__deploy").isNotNull(), F.struct("ts", command.alias("command"), "__deploy.method", "__deploy.target_env", "exit_code", F.when(F.coalesce("exit_code", F.lit(0)) != 0, F.lit(False)).alias("verified"), again.alias("reconstructed"))).alias("deployments"),
        F.collect_list(F.when(status.isNotNull() & (F.coalesce("file_path", F.lit("")) != ""), F.struct("file_path", "seq", status.alias("status")))).alias("files"),
        F.min_by("ts", when).alias("started_at"), F.max_by("ts", when).alias("ended_at"), F.floor((F.unix_micros(F.max(when)) - F.unix_micros(F.min(when))) / 1000).alias("duration_ms"),
        count("file_edit", "file_write", "file_delete", "file_read", "shell_command", "tool_post")("tool_calls"), count("file_read")("file_reads"), count("file_edit", "file_write", "file_delete")("file_edits"),
        count("shell_command")("shell_commands"), count("denial")("denials"), F.count_if(F.coalesce("approved", F.lit(False))).alias("approvals"),
    )
    base = F.coalesce(F.nullif("m.repo_state.root", F.lit("")), F.nullif("m.cwd", F.lit("")), F.col("folder"))
    files = F.array_sort(F.transform("files", lambda f: F.struct(relative_path(f["file_path"], F.col("base")).alias("file"), (-f["seq"]).alias("o"), f["status"].alias("status"))))
    parts = parts.withColumn("base", base).withColumn("files", files)
    last = F.filter("files", lambda f, i: (i == 0) | (F.get("files", i - 1)["file"] != f["file"]))
    zero = F.lit(0).cast("bigint")
    parts = parts.withColumn("own", F.transform(last, lambda f: F.struct(f["file"].alias("file"), f["status"].alias("status"), zero.alias("additions"), zero.alias("deletions"), F.lit(None).cast("string").alias("unified"))))
    parsed = F.when(F.coalesce("m.working_diff", F.lit("")) != "", logs.diff_files(F.col("m.working_diff")).cast(EPISODE["diffs"]))
    parts = parts.withColumn("d", scoped_diffs(parsed, F.transform("own", lambda d: d["file"]), F.col("own")))
    usage = lambda k, v: F.coalesce(f"m.usage.{k}", F.lit(v)).alias(k)
    stats_ = F.struct("started_at", "ended_at", "duration_ms", "tool_calls", "file_reads", "file_edits", "shell_commands", F.size("tests").cast("bigint").alias("tests_run"), "approvals", "denials", usage("input_tokens", 0), usage("output_tokens", 0), usage("cost_usd", 0.0))
    feedback = F.coalesce("m.human_feedback", F.array().cast(EPISODE["human_feedback"]))
    mined = F.when(F.exists(feedback, lambda f: f["source"] == "mined"), F.array(F.lit("mined_feedback"))).otherwise(F.array().cast("array<string>"))
    labels = F.array_sort(F.array_distinct(F.concat(F.coalesce("m.labels", F.array().cast("array<string>")), F.transform(feedback, lambda f: f["label"]), mined)))
    steps_ = F.transform("steps", lambda s, i: F.struct(i.cast("int").alias("index"), *(s[k].alias(k) for k in ("ts", "type", "tool", "intent", "input", "observation", "approved", "cwd")), F.lit(None).cast("bigint").alias("duration_ms")))
    status_ = F.coalesce(F.col("m.outcome"), F.from_json(F.lit('{"status": "open"}'), EPISODE["outcome"]))
    out = parts.select(
        "session_id", episode_id(F.col("session_id")).alias("id"), F.coalesce("m.created_at", "started_at").alias("created_at"), F.coalesce(F.nullif("m.agent", F.lit("")), "source", F.lit("unknown")).alias("agent"),
        F.coalesce(F.nullif("m.intent", F.lit("")), "prompt", F.lit("")).alias("intent"), F.col("m.repo_state").alias("repo_state"), steps_.alias("steps"), F.col("d.diffs").alias("diffs"), F.col("d.source").alias("diff_source"),
        "commands", "tests", feedback.alias("human_feedback"), status_.alias("outcome"), stats_.alias("stats"), labels.alias("labels"), F.col("m.outcome_hint").alias("outcome_hint"), "deployments",
    )
    return normalised(out)


def with_scores(episodes: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Verified deployments, reward and validity of built episodes; a run that only the environment blocked is a label.

    ``prior(id, validity)``: verdicts that were kept; they are merged with the rules' (J10)."""
    e = score.with_test_signal(episodes.withColumn("deployments", score.verified_deployments()))
    blocked = F.when(F.coalesce("_t.blocked", F.lit(False)), F.array(F.lit("blocked_on_env"))).otherwise(F.array().cast("array<string>"))
    e = e.withColumn("labels", F.array_sort(F.array_union("labels", blocked))).drop("_t")
    e = score.with_scores(e)
    if prior is None:
        return e
    e = e.join(prior.select("id", F.col("validity").alias("__prior")), "id", "left")
    return e.withColumn("validity", F.when(F.col("__prior").isNull(), F.col("validity")).otherwise(score.merged_validity(F.col("__prior"), F.col("validity")))).drop("__prior")


def rewarded_again(episodes: DataFrame) -> DataFrame:
    """The reward computed anew; the verdict stays as it is."""
    return score.with_reward(episodes.drop("reward_vector"))
