"""Readers: JSON lines, hook payloads, OTLP telemetry, recorded rollouts, transcripts and patches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN_METRIC = "claude_code.token.usage"
COST_METRIC = "claude_code.cost.usage"
EVENT = "id string, ts string, session_id string, type string, source string, tool_name string, data string"


def read_jsonl(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """SRC1/SRC2: blank lines are passed over; a malformed line fails the job, or is dropped if ``tolerant``."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: session events with their arrival order in ``seq``, by file and place in it."""
    raw = spark.read.text(path).where("trim(value) <> ''").withColumn("seq", F.monotonically_increasing_id())
    top = F.from_json("value", "id string, ts string, session_id string, type string, source string, tool_name string", {"mode": "FAILFAST"})
    return raw.select(top.alias("e"), F.get_json_object("value", "$.data").alias("data"), "seq").select("e.*", "data", "seq")


DENIED = r"(?i)permission denied|user denied|operation not permitted|request was rejected|tool use was rejected"


STRINGS = "stdout output content result text message".split()


def _is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def _first_text(v: Column, keys) -> Column:
    """Of a variant's fields, the first that holds a text."""
    return F.coalesce(*(F.when(_is_text(F.try_variant_get(v, f"$.{k}", "variant")), F.try_variant_get(v, f"$.{k}", "string")) for k in keys))


def _spoken(v: Column, depth: int) -> Column:
    """A variant as text: texts themselves, objects by their first text field and error output, lists line by line."""
    kind = F.schema_of_variant(v)
    first, err = _first_text(v, STRINGS), _first_text(v, ["stderr"])
    said = F.when(F.regexp_replace(F.coalesce(err, F.lit("")), r"(?U)\s+", "") != "", F.concat(first, F.lit("\n"), err)).otherwise(first)
    out = F.when(v.isNull() | (kind == "VOID"), F.lit("")).when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string"))).when(kind.startswith("OBJECT") & first.isNotNull(), said)
    if depth:
        out = out.when(kind.startswith("ARRAY"), F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: _spoken(x, depth - 1)), "\n"))
    return out.otherwise(F.to_json(v))


def response_text(raw: Column) -> Column:
    """A tool's answer, given as JSON, as text: of an object the first field that is a text, with its error output; a
    list line by line (lists within a list of lists as JSON); what isn't JSON as it is. Long ones are cut with a note."""
    v = F.try_parse_json(raw)
    whole = F.when(raw.isNull(), "").when(v.isNull(), raw).when(raw.startswith("{") & _first_text(v, STRINGS).isNull(), raw).otherwise(_spoken(v, 2))
    return F.when(F.length(whole) > 6000, F.concat(F.substring(whole, 1, 6000), F.lit("\n... [truncated "), (F.length(whole) - 6000).cast("string"), F.lit(" chars]"))).otherwise(whole)


def exit_code(raw: Column) -> Column:
    """The first of six fields that is a whole number, not a truth value; 130 if interrupted."""
    code = lambda k: F.when(F.get_json_object(raw, f"$.{k}").rlike(r"^\s*-?\d+\s*$"), F.trim(F.get_json_object(raw, f"$.{k}")).cast("int"))
    return F.coalesce(*(code(k) for k in "exit_code exitCode returncode return_code code status".split()), F.when(F.get_json_object(raw, "$.interrupted") == "true", 130))


def file_path(tool_input: Column) -> Column:
    """The first of four fields that is a text."""
    return _first_text(F.try_parse_json(tool_input), "file_path notebook_path path filePath".split())


def events_of_hooks(payloads: DataFrame) -> DataFrame:
    """SRC8/N1/N2: ``payloads(payload, seq)`` of JSON as session events."""
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    p = payloads.select("seq", F.coalesce(F.nullif(get("session_id"), F.lit("")), F.lit("unknown-session")).alias("session_id"), F.coalesce(get("hook_event_name"), get("hook"), F.lit("")).alias("hook"), get("cwd").alias("cwd"), get("ts").alias("ts"), get("prompt").alias("prompt"), get("tool_name").alias("tool_name"), get("tool_input").alias("tool_input"), F.to_json(F.try_variant_get(F.try_parse_json("payload"), "$.tool_response", "variant")).alias("raw"), get("transcript_path").alias("transcript_path"), get("source").alias("source"))
    p = p.withColumn("response", response_text(F.col("raw")))
    denied, tool = F.col("response").rlike(DENIED), F.col("tool_name")
    post = F.when(denied, "denial").when(tool.isin("Bash", "BashOutput"), "shell_command").when(tool.isin("Edit", "MultiEdit", "NotebookEdit"), "file_edit").when(tool == "Write", "file_write").when(tool == "DeleteFile", "file_delete").when(tool.isin("Read", "NotebookRead"), "file_read").otherwise("tool_post")
    h = F.col("hook")
    kind = F.when(h == "SessionStart", "session_start").when(h == "SessionEnd", "session_end").when(h == "UserPromptSubmit", "user_prompt").when(h == "PreToolUse", "tool_pre").when(h == "PostToolUse", post).otherwise("note")
    after = h == "PostToolUse"
    return p.withColumn("type", kind).select("session_id", "seq", "ts", "type", "hook", "source", "cwd", "transcript_path", F.when(h.isin("PreToolUse", "PostToolUse"), F.col("tool_input")).alias("tool_input"), F.when(h.isin("PreToolUse", "PostToolUse"), tool).alias("tool_name"), F.when(h == "UserPromptSubmit", F.coalesce("prompt", F.lit(""))).alias("prompt"), F.when(after, F.col("response")).alias("response"), F.when(after, ~denied).alias("approved"), F.when(F.col("type") == "shell_command", F.coalesce(F.get_json_object("tool_input", "$.command"), F.lit(""))).alias("command"), F.when(F.col("type") == "shell_command", exit_code(F.col("raw"))).alias("exit_code"), F.when(F.col("type").startswith("file_"), file_path(F.col("tool_input"))).alias("file_path"))


_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
_POINTS = f"struct<dataPoints:array<struct<asInt:string,asDouble:double,attributes:{_ATTRS}>>>"
METRICS = f"resourceMetrics array<struct<resource:struct<attributes:{_ATTRS}>,scopeMetrics:array<struct<metrics:array<struct<name:string,sum:{_POINTS},gauge:{_POINTS},histogram:{_POINTS}>>>>>>"
LOGS = f"resourceLogs array<struct<resource:struct<attributes:{_ATTRS}>,scopeLogs:array<struct<logRecords:array<struct<body:{_VALUE},attributes:{_ATTRS}>>>>>>"


def attribute(attributes: Column, key: str) -> Column:
    """SRC12: an attribute as text; the last of its name."""
    v = F.try_element_at(F.filter(attributes, lambda a: a["key"] == key), F.lit(-1))["value"]
    return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))


def usage_points(bodies: DataFrame, names: tuple[str, str] = (TOKEN_METRIC, COST_METRIC)) -> DataFrame:
    """SRC10/SRC13: data points of the two usage metrics in ``bodies(body)``; a point's session beats its resource's."""
    r = bodies.select(F.from_json("body", METRICS).alias("b")).select(F.explode("b.resourceMetrics").alias("r"))
    m = r.select(F.col("r.resource.attributes").alias("ra"), F.explode("r.scopeMetrics").alias("s")).select("ra", F.explode("s.metrics").alias("m")).where(F.col("m.name").isin(*names))
    points = F.coalesce("m.sum", "m.gauge", "m.histogram")["dataPoints"]
    p = m.select("ra", F.col("m.name").alias("name"), F.explode(points).alias("p"))
    session = F.coalesce(F.nullif(attribute(F.col("p.attributes"), "session.id"), F.lit("")), F.nullif(attribute(F.col("ra"), "session.id"), F.lit("")))
    return p.select(session.alias("session_id"), "name", attribute(F.col("p.attributes"), "type").alias("type"), F.coalesce(F.col("p.asInt").cast("double"), F.col("p.asDouble"), F.lit(0.0)).alias("value"))


def log_records(bodies: DataFrame) -> DataFrame:
    """SRC11."""
    r = bodies.select(F.from_json("body", LOGS).alias("b")).select(F.explode("b.resourceLogs").alias("r"))
    g = r.select(F.col("r.resource.attributes").alias("ra"), F.explode("r.scopeLogs").alias("s")).select("ra", F.explode("s.logRecords").alias("g"))
    v = F.col("g.body")
    text = F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    return g.select(F.coalesce(attribute(F.col("g.attributes"), "session.id"), attribute(F.col("ra"), "session.id")).alias("session_id"), text.alias("body"), F.map_from_entries(F.transform("g.attributes", lambda a: F.struct(a["key"], F.coalesce(a["value"]["stringValue"], a["value"]["intValue"])))).alias("attributes"))


def usage(points: DataFrame, names: tuple[str, str] = (TOKEN_METRIC, COST_METRIC)) -> DataFrame:
    """A3: tokens (cut to whole numbers point by point) and cost of each session."""
    tokens = lambda kind: F.coalesce(F.sum(F.when((F.col("name") == names[0]) & (F.col("type") == kind), F.col("value").cast("bigint"))), F.lit(0))
    return points.groupBy("session_id").agg(tokens("input").alias("input_tokens"), tokens("output").alias("output_tokens"), F.coalesce(F.sum(F.when(F.col("name") == names[1], F.col("value"))), F.lit(0.0)).alias("cost_usd"))


def merged_usage(old: DataFrame, new: DataFrame) -> DataFrame:
    """What sessions had, and what came."""
    return old.unionByName(new).groupBy("session_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"))


def rollout_calls(rows: DataFrame) -> DataFrame:
    """SRC14-SRC16: calls of a rollout with their outputs. ``rows(ord, payload)`` of JSON payloads.

    A call's output is the last one of its id; its exit code is named in a JSON envelope or in the text before "Output:"."""
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    calls = rows.where(get("type") == "function_call").select("ord", get("call_id").alias("call_id"), get("name").alias("name"), get("arguments").alias("arguments"))
    outs = rows.where(get("type") == "function_call_output").groupBy(get("call_id").alias("call_id")).agg(F.max_by(get("output"), "ord").alias("raw"))
    raw = F.col("raw")
    envelope = F.get_json_object(raw, "$.output")
    body = F.coalesce(envelope, F.when(raw.contains("Output:\n"), F.expr("substring(raw, instr(raw, 'Output:\\n') + 8)")), raw, F.lit(""))
    code = F.coalesce(F.get_json_object(raw, "$.metadata.exit_code").cast("int"), F.nullif(F.regexp_extract(raw, r"Process exited with code (-?\d+)", 1), F.lit("")).cast("int"))
    args = F.col("arguments")
    words = F.from_json(F.get_json_object(args, "$.command"), "array<string>")
    command = F.coalesce(F.get_json_object(args, "$.cmd"), F.when(F.size(words) > 0, F.array_join(words, " ")), F.get_json_object(args, "$.command"))
    return calls.join(outs, "call_id", "left").select("ord", "call_id", "name", command.alias("command"), body.alias("output"), code.alias("exit_code"))


def rollout_usage(rows: DataFrame) -> DataFrame:
    """The last token totals."""
    get = lambda k: F.get_json_object("payload", f"$.info.total_token_usage.{k}").cast("bigint")
    return rows.where(get("input_tokens").isNotNull()).agg(F.max_by(get("input_tokens"), "ord").alias("input_tokens"), F.max_by(get("output_tokens"), "ord").alias("output_tokens"))


def patch_parts(rows: DataFrame, patch: str = "patch") -> DataFrame:
    """SRC17/SRC18: a row for each file of a patch with its operation, path, body and the tool that would do it."""
    block = F.explode(F.filter(F.split(F.concat(F.lit("\n"), F.coalesce(patch, F.lit(""))), r"(?m)\n(?=\*\*\* (?:Delete|Update|Add) File: )"), lambda x: x.rlike(r"^\*{3} (Delete|Update|Add) File: ")))
    b = rows.withColumn("__b", block)
    op = F.regexp_extract("__b", r"^\*{3} (Delete|Update|Add) File: ", 1)
    tool = F.when(op == "Add", "Write").when(op == "Update", "Edit").otherwise("DeleteFile")
    if "exit_code" in rows.columns:  # a patch that failed is no change of its files
        tool = F.when(F.coalesce("exit_code", F.lit(0)) != 0, "ApplyPatch").otherwise(tool)
    body = F.regexp_replace(F.regexp_replace("__b", r"^[^\n]*\n?", ""), r"\n?\*\*\* End Patch\s*$", "")
    return b.select(*rows.columns, op.alias("op"), F.trim(F.regexp_extract("__b", r"File: ([^\n]*)", 1)).alias("path"), body.alias("body"), tool.alias("tool")).drop("__b")


def transcript_commands(lines: DataFrame) -> DataFrame:
    """SRC20/SRC21: shell calls of a transcript with their results, numbered by command. ``lines(ord, value)`` of JSON."""
    block = "array<struct<type:string,id:string,name:string,input:struct<command:string>,tool_use_id:string,is_error:boolean,content:string>>"
    b = lines.select("ord", F.posexplode(F.from_json(F.get_json_object("value", "$.message.content"), block)).alias("pos", "b"))
    use = b.where("b.type = 'tool_use' and b.name = 'Bash'").select("ord", "pos", F.col("b.id").alias("id"), F.col("b.input.command").alias("command"))
    res = b.where("b.type = 'tool_result'").select(F.col("b.tool_use_id").alias("id"), F.coalesce("b.is_error", F.lit(False)).alias("is_error"), F.coalesce("b.content", F.lit("")).alias("output"))
    code = F.coalesce(F.nullif(F.regexp_extract("output", r"^\s*Exit code:? (-?\d+)", 1), F.lit("")).cast("int"), F.when(F.col("is_error"), 1).otherwise(0))
    return use.join(res, "id").withColumn("exit_code", code).withColumn("k", F.row_number().over(Window.partitionBy("command").orderBy("ord", "pos")))


def diff_files(patch: Column) -> Column:
    """Array of struct(file, status, additions, deletions, unified) of a unified diff."""
    blocks = F.filter(F.split(F.coalesce(patch, F.lit("")), r"(?m)^(?=diff --git )"), lambda b: b.startswith("diff --git "))

    def one(b: Column) -> Column:
        new, old = F.regexp_extract(b, r"(?m)^\+\+\+ (?:b/)?([^\n\t]*)", 1), F.regexp_extract(b, r"(?m)^--- (?:a/)?([^\n\t]*)", 1)
        header = F.regexp_extract(b, r"^diff --git a/.*? b/([^\n]*)", 1)
        file = F.when((new == "") | (new == "/dev/null"), F.when((old == "") | (old == "/dev/null"), header).otherwise(old)).otherwise(new)
        status = F.when(b.rlike(r"(?m)^Binary files"), "binary").when(b.rlike(r"(?m)^new file mode") | (old == "/dev/null"), "added").when(b.rlike(r"(?m)^deleted file mode") | (new == "/dev/null"), "deleted").otherwise("modified")
        return F.struct(file.alias("file"), status.alias("status"), F.regexp_count(b, F.lit(r"(?m)^\+(?!\+\+)")).alias("additions"), F.regexp_count(b, F.lit(r"(?m)^-(?!--)")).alias("deletions"), F.concat(F.regexp_replace(b, r"\s+$", ""), F.lit("\n")).alias("unified"))

    return F.transform(blocks, one)


def old_ranges(patch: Column) -> Column:
    """Array of struct(file, start, count) of the old lines that a diff touches."""
    files = F.filter(F.split(F.coalesce(patch, F.lit("")), r"(?m)^(?=--- )"), lambda b: b.startswith("--- ") & ~b.startswith("--- /dev/null"))

    def spans(b: Column) -> Column:
        start, count = F.regexp_extract_all(b, F.lit(r"(?m)^@@ -([0-9]+)(?:,([0-9]+))? "), 1), F.regexp_extract_all(b, F.lit(r"(?m)^@@ -([0-9]+)(?:,([0-9]+))? "), 2)
        file = F.trim(F.regexp_extract(b, r"^--- (?:a/)?([^\n\t]*)", 1))
        return F.zip_with(start, count, lambda s, c: F.named_struct(F.lit("file"), file, F.lit("start"), s.cast("int"), F.lit("count"), F.coalesce(F.nullif(c, F.lit("")).cast("int"), F.lit(1))))

    return F.filter(F.flatten(F.transform(files, spans)), lambda r: r["count"] > 0)


@F.pandas_udf(StringType())
def first_json_object(texts: pd.Series) -> pd.Series:
    """The first balanced object in a text that is JSON; a scanner by its nature, so it runs in Arrow batches."""
    import json

    def scan(text: str | None) -> str | None:
        start = text.find("{") if text else -1
        while start >= 0:
            try:
                _, end = json.JSONDecoder(strict=False).raw_decode(text, start)
                return text[start:end]
            except ValueError:
                start = text.find("{", 1 + start)

    return texts.map(scan, na_action="ignore").astype(object).where(texts.notna(), None)


def mined_feedback(rows: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """``rows(session_id, answer, created_at)`` of a labeler's JSON answers as feedback rows with known labels."""
    items = F.from_json(F.get_json_object("__j", "$.feedback"), "array<struct<step_index:int,label:string,confidence:double,evidence:string>>")
    f = rows.withColumn("__j", first_json_object("answer")).select("session_id", "created_at", F.explode(items).alias("i")).where(F.col("i.label").isin(*labels))
    return f.select("session_id", F.col("created_at").alias("ts"), "i.label", F.substring(F.coalesce("i.evidence", F.lit("")), 1, 300).alias("note"), F.lit("mined").alias("source"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("i.confidence", F.lit(0.5)))).alias("confidence"), F.col("i.step_index").alias("evidence_step_index"))


def population(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """SRC24: deterministic test episodes."""
    e = F.expr
    return spark.range(n).select(e(f"concat('ep_{seed}_', lpad(id, 3, '0'))").alias("id"), e("element_at(array('merged','merged','accepted','abandoned','reverted'), cast(id % 5 as int) + 1)").alias("status"), e("concat('repo', id % 3)").alias("source"), e("element_at(array('terminal','swe','search','mcp','web'), cast(id % 5 as int) + 1)").alias("domain"))
