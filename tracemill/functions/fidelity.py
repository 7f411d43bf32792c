"""How close a predicted observation is to the real one, without any Python at run time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.commands import lines
from tracemill.functions.score import r4

_DAY, _CLOCK, _HEX, _NUMBER = r"\d{4}(?:-\d\d){2}", r"\d\d:\d\d:\d\d", "[0-9a-f]", r"\b\d+(?:[.]\d+)?"
RUNTIME = (
    rf"{_DAY}[T ]{_CLOCK}(?:[.]\d+)?(?:[-+]\d\d:?\d\d|Z)?", rf"\b{_CLOCK}\b", r"0x[\da-fA-F]+", rf"\b{_HEX}{{8}}(?:-{_HEX}{{4}}){{3}}-{_HEX}{{12}}\b",
    rf"\b{_HEX}{{12,40}}\b", rf"{_NUMBER}\s*(?:us|µs|ns|ms)\b", rf"{_NUMBER}(?:s|ms)\b", r"\bpid[\s:=]+\d+\b",
)
RUNTIME_ANY = "(?i)" + "|".join("(?:%s)" % p for p in RUNTIME)
ERROR = r"(?i)traceback|exception|error|fatal|panic|segfault|refused|cannot|no such|not found|denied|\bfailed\b|exit code [1-9]"
PROMPT = r"(?m)^[$#]\s|[.\w-]+@[.\w-]+:.*?[#$]\s"
WEIGHTS = dict(format=0.15, factuality=0.35, consistency=0.20, realism=0.15, quality=0.15)


def t(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def mask_runtime(text: Column) -> Column:
    """C14: time stamps, addresses, ids and durations become one mark."""
    return F.regexp_replace(t(text), RUNTIME_ANY, "§RT§")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def is_json(text: Column) -> Column:
    """C15."""
    bare = F.regexp_replace(t(text), r"^\s+|\s+$", "")
    return bare.rlike(r"^[{\[]") & F.try_parse_json(bare).isNotNull()


def response_type(text: Column) -> Column:
    """C16."""
    return F.when(F.regexp_replace(t(text), r"\s+", "") == "", "empty").when(text.rlike(ERROR), "error").otherwise("success")


def classify(text: Column) -> Column:
    """C17: struct of token counts, lines, characters, is_json and response_type."""
    w = words(t(text))
    runtime = F.size(F.filter(w, lambda x: x.rlike(RUNTIME_ANY)))
    return F.struct((F.size(w) - runtime).alias("deterministic"), F.lit(0).alias("pre_existing"), runtime.alias("runtime_metadata"), F.size(lines(text)).alias("lines"), F.length(t(text)).alias("chars"), is_json(text).alias("is_json"), response_type(text).alias("response_type"))


def scored(df: DataFrame, predicted: str, real: str, name: str = "score") -> DataFrame:
    """Adds a struct of five dimensions, composite and exact.

    Built column by column: within one expression the word sets would be computed at every mention of them."""
    p, g = t(F.col(predicted)), t(F.col(real))
    each = {"_p": p, "_g": g}
    of = {k: F.col(k) for k in ("_p", "_g", "_pm", "_gm", "_pw", "_gw", "_pl", "_gl", "_shared")}
    df = df.withColumns(each)
    df = df.withColumns({"_pm": mask_runtime(of["_p"]), "_gm": mask_runtime(of["_g"]), "_pl": F.size(lines(of["_p"])), "_gl": F.size(lines(of["_g"]))})
    df = df.withColumns({"_pw": F.array_distinct(words(of["_pm"])), "_gw": F.array_distinct(words(of["_gm"]))}).withColumn("_shared", F.size(F.array_intersect("_pw", "_gw")))
    p, g, pw, gw, pl, gl, shared = (of[k] for k in ("_p", "_g", "_pw", "_gw", "_pl", "_gl", "_shared"))
    line = 1.0 - F.least(F.lit(1.0), F.abs(pl - gl) / F.greatest(F.lit(1), gl))
    same = lambda a, b: F.when(a == b, 1.0).otherwise(0.0)
    parts = {
        "format": (line + same(is_json(p), is_json(g)) + same(p.rlike(PROMPT), g.rlike(PROMPT))) / 3.0,
        "factuality": F.when(F.size(gw) == 0, 1.0).otherwise(shared / F.size(gw)),
        "consistency": F.when(F.size(pw) == 0, 0.0).otherwise(shared / F.size(pw)),
        "realism": same(response_type(p), response_type(g)),
        "quality": F.when(F.length(g) == 0, F.when(F.length(p) == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(F.length(p) - F.length(g)) / F.length(g))),
    }
    df = df.withColumn("_exact", p == g).withColumns({f"_{k}": F.when(F.col("_exact"), 1.0).otherwise(v) for k, v in parts.items()})
    composite = sum((F.lit(WEIGHTS[k]) * F.col(f"_{k}") for k in WEIGHTS), F.lit(0.0))
    out = F.struct(*(r4(F.col(f"_{k}")).alias(k) for k in parts), r4(composite).alias("composite"), F.col("_exact").alias("exact"))
    return df.withColumn(name, out).drop(*of, "_exact", *(f"_{k}" for k in parts))


def blend(rule: Column, judge: Column, weight: float = 0.5) -> Column:
    """A judge's dimensions, where present, mixed into the rule's; the composite is weighed anew."""
    part = {k: F.when(judge[k].isNull(), rule[k]).otherwise(r4((1 - weight) * rule[k] + weight * judge[k])) for k in WEIGHTS}
    return F.struct(*(v.alias(k) for k, v in part.items()), r4(sum((F.lit(WEIGHTS[k]) * part[k] for k in WEIGHTS), F.lit(0.0))).alias("composite"), rule["exact"].alias("exact"))


def realness(text: Column) -> Column:
    """C22."""
    return F.regexp_count(t(text), F.lit(RUNTIME_ANY)) + F.when(t(text).rlike(PROMPT), 2).otherwise(0) + F.least(F.lit(3), F.floor(F.length(t(text)) / 100).cast("int"))


HARD_WORDS = "bug|concurrency|crash|deadlock|error|exception|fail|flaky|memory leak|migrat|performance|race condition|refactor|regression|security|timeout|traceback|vulnerab".split("|")


def text_features(text: Column) -> Column:
    """Struct of length, hard words, question marks, code fences and mean word length."""
    w = words(t(text))
    count = lambda c, what: (F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / len(what)
    hits = sum((count(F.lower(t(text)), k) for k in HARD_WORDS), F.lit(0.0))
    return F.struct(F.log1p(F.length(t(text))).alias("log_length"), hits.alias("keyword_hits"), count(t(text), "?").alias("question_marks"), count(t(text), "```").alias("code_fences"), F.when(F.size(w) > 0, F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / F.size(w)).otherwise(0.0).alias("avg_word_length"))
