"""Sinks: JSON lines, Parquet, task bundles and prompt sets, and the dispatcher over export formats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions import score
from tracemill.functions.commands import relativize
from tracemill.operators import datasets, worldmodel
from tracemill.operators.ordering import numbered

FORMATS = tuple("dpo harbor jsonl molt parquet reward rlds sft wm".split())
SAFE_REF = r"^[A-Za-z\d][\w./-]*\z"
SAFE_REMOTE = r"^(?:git@|ssh://|https?://)[\w@:/.~-]+\z"


def toml_text(c: Column) -> Column:
    """SNK9: a TOML basic string: quotes, backslashes and control characters escaped."""
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in [8, 9, 10, 12, 13, *(k for k in range(32) if k not in (8, 9, 10, 12, 13)), 127]:
        short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(code, f"\\u{code:04X}")
        c = F.replace(c, F.lit(chr(code)), F.lit(short))
    return F.concat(F.lit('"'), c, F.lit('"'))


def _lines(*parts: Column) -> Column:
    """Joined by line ends; null parts are left out."""
    return F.concat(F.concat_ws("\n", *parts), F.lit("\n"))


def task_files(episodes: DataFrame) -> DataFrame:
    """SNK7/SNK8/SNK10: ``(path, content)`` of the files of each eligible episode's task folder."""
    e = episodes.withColumn("skip", datasets.skip_reason()).where("skip is null and id rlike '^[A-Za-z0-9_-]+$'").withColumn("v", datasets.verifier())
    command = relativize(F.col("v.command"), F.col("repo_state.root"))
    remote, base = F.when(F.col("repo_state.remote_url").rlike(SAFE_REMOTE), F.col("repo_state.remote_url")), F.when(F.col("repo_state.base_commit").rlike(SAFE_REF), F.col("repo_state.base_commit"))
    pair = lambda k, v: F.concat(F.lit(f"{k} = "), v)
    toml = _lines(F.lit('version = "1.0"'), pair("instruction", toml_text(F.substring(F.coalesce("intent", F.lit("")), 1, 4000))), F.lit("\n[metadata]"), pair("episode_id", toml_text(F.col("id"))), pair("reward", F.col("reward_vector.composite").cast("string")), F.lit("\n[verifier]"), pair("framework", toml_text(F.col("v.framework"))), F.lit("timeout_sec = 120"))
    docker = _lines(F.concat(F.lit("FROM "), datasets.base_image(F.col("v.framework"), F.col("v.command"))), F.lit("WORKDIR /workspace"), F.when(remote.isNotNull(), F.concat(F.lit("RUN git clone "), remote, F.lit(" ."))), F.when(remote.isNotNull() & base.isNotNull(), F.concat(F.lit("RUN git checkout "), base)))
    script = _lines(F.lit("#!/bin/bash\nset -e\ncd /workspace"), command)
    patch = F.array_join(F.transform(F.filter("diffs", lambda d: F.coalesce(d["unified"], F.lit("")) != ""), lambda d: F.concat(F.regexp_replace(d["unified"], r"\s+$", ""), F.lit("\n"))), "")
    meta = F.to_json(F.struct(F.col("id").alias("episode_id"), F.col("reward_vector.composite").alias("reward"), "v", "outcome.status"))
    files = {"task.toml": toml, "environment/Dockerfile": docker, "tests/run-tests.sh": script, "metadata.json": meta, "solution/solution.patch": patch}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.alias("content")) for n, c in files.items())))
    return e.select("id", each.alias("f")).select(F.concat("id", F.lit("/"), "f.name").alias("path"), F.col("f.content").alias("content"))


def write_files(files: DataFrame, root: str) -> int:
    """Writes ``(path, content)`` below a folder that all executors share; a repeated attempt writes the same again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pyarrow.fs.FileSystem.from_uri(root) if ":" in root else (pyarrow.fs.LocalFileSystem(), root)
        for frame in frames:
            for path, content in zip(frame.path, frame.content):
                fs.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{base}/{path}") as out:
                    out.write((content or "").encode())
            yield pd.DataFrame({"n": [len(frame)]})

    return files.mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def prompt_rows(episodes: DataFrame) -> DataFrame:
    """SNK11: prompts with a verifier's specification as a JSON label."""
    e = episodes.withColumn("skip", datasets.skip_reason(True)).where("skip is null").withColumn("v", datasets.verifier())
    command = relativize(F.col("v.command"), F.col("repo_state.root"))
    label = F.to_json(F.struct(F.col("repo_state.remote_url").alias("remote_url"), F.when(F.col("repo_state.base_commit").rlike(SAFE_REF), F.col("repo_state.base_commit")).alias("base_commit"), command.alias("test_command"), F.col("v.framework").alias("framework")))
    ask = F.concat(F.coalesce("intent", F.lit("")), F.lit("\n\nAnswer with a unified diff in a ```diff block."))
    return e.select(ask.alias("input"), label.alias("label"), F.col("id").alias("episode_id"), F.col("reward_vector.composite").alias("composite_reward"), datasets.portable(command).alias("portable"))


def _scrubbed(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(score.finite(c), c)
    if not _has_floats(kind):
        return c
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_scrubbed(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _scrubbed(x, kind.elementType))
    return F.transform_values(c, lambda _, v: _scrubbed(v, kind.valueType))


def _has_floats(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_floats(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_floats(kind.elementType)
    return _has_floats(kind.valueType) if isinstance(kind, T.MapType) else isinstance(kind, (T.DoubleType, T.FloatType))


def finite_or_null(df: DataFrame) -> DataFrame:
    """SNK14: numbers that JSON can't hold become null, however deep they lie."""
    return df.select(*(_scrubbed(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def manifest(rows: DataFrame, *id_columns: str) -> DataFrame:
    """SNK13: number of rows, of distinct episodes, and one hash over all rows that doesn't depend on their order: the sum of
    their SHA-256 hashes' first 15 digits. Ids are counted as rows, never gathered in one; ``manifest_ids`` gives them."""
    row_hash = F.conv(F.substring(F.sha2(F.to_json(F.struct(*rows.columns)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    counts = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row_hash), F.lit(0)).cast("string").alias("dataset_hash"))
    ids = rows.select(F.explode(F.array(*id_columns)).alias("id")).where("id is not null").distinct().agg(F.count("*").alias("episodes"))
    return counts.crossJoin(ids).select("rows", F.col("episodes").cast("int").alias("episodes"), "dataset_hash")


def manifest_ids(rows: DataFrame, order: str, *id_columns: str) -> DataFrame:
    """SNK13: the distinct episodes of a dataset in the order in which they first come: ``(ordinal, id)``."""
    each = rows.select(F.col(order).alias("o"), F.posexplode(F.array(*id_columns)).alias("pos", "id")).where("id is not null")
    first = each.groupBy("id").agg(F.min(F.struct("o", "pos")).alias("f")).select("id", "f.o", "f.pos")
    return numbered(first, "o", "pos", "id", name="ordinal").select("ordinal", "id")


def exported(episodes: DataFrame, fmt: str) -> DataFrame:
    """The rows of an export format over episodes with rewards and validity."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; choose from {', '.join(FORMATS)}")
    if fmt == "sft":
        return datasets.sft_segments(episodes)
    if fmt == "dpo":
        return datasets.with_trajectories(datasets.dpo_pairs(episodes), episodes)
    if fmt == "reward":
        return datasets.reward_rows(episodes)
    if fmt == "rlds":
        return datasets.rlds(datasets.exploded_steps(episodes, "reward_vector"), F.coalesce("reward_vector.composite", F.lit(0.0)))
    if fmt == "wm":
        s = datasets.exploded_steps(episodes, "repo_state", "labels").withColumn("source", worldmodel.source_key()).withColumn("domain", F.coalesce(F.get("labels", F.lit(0)), F.lit("unknown")))
        act = worldmodel.action_repr(F.col("type"), F.col("tool"), F.col("input"), F.col("cwd"))
        return worldmodel.samples(s, act).select("episode_id", F.col("index").alias("turn_index"), "source", "domain", worldmodel.messages().alias("messages"))
    return {"jsonl": lambda: episodes, "parquet": lambda: datasets.flat_rows(episodes), "harbor": lambda: task_files(episodes), "molt": lambda: prompt_rows(episodes)}[fmt]()


def export(episodes: DataFrame, fmt: str, path: str) -> None:
    """SNK1/SNK5/SNK6/SNK12: writes an export; folders of files for ``harbor``, Parquet for ``parquet``, else JSON lines;
    these go to the standard output for the path "-"."""
    if path == "-" and fmt in ("parquet", "harbor", "molt"):
        raise ValueError(f"format {fmt!r} is written to a folder, not to the standard output")
    rows = exported(episodes, fmt)
    if path == "-":
        for line in finite_or_null(rows).toJSON().toLocalIterator():
            print(line)
        return
    if fmt == "harbor":
        write_files(rows, path)
    elif fmt == "parquet":
        rows.write.mode("overwrite").parquet(path)
    else:
        finite_or_null(rows).write.mode("overwrite").json(path)
