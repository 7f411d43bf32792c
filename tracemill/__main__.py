"""Command line over episode files: ``python -m tracemill COMMAND EPISODES [...]``.

EPISODES is a folder or file of episode documents, JSON lines or Parquet; scores are computed anew."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import schema
from tracemill.functions import score, summary
from tracemill.operators import analytics, datasets
from tracemill.sources import logs, sinks, store


def load(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else logs.read_jsonl(spark, path, schema.DDL)
    # Ties between episodes go to the first id; the id itself is the order then.
    return schema.normalised(raw).withColumn("ord", F.col("id"))


def scored(spark: SparkSession, path: str) -> DataFrame:
    e = load(spark, path)
    return store.materialised(score.with_scores(e.withColumn("deployments", score.verified_deployments())))


def show(rows: DataFrame) -> None:
    for line in rows.toJSON().toLocalIterator():
        print(line)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tracemill", description=__doc__)
    p.add_argument("command", choices="list show summary audit export loop validate".split())
    p.add_argument("episodes")
    p.add_argument("--id")
    p.add_argument("--format", choices=sinks.FORMATS, default="sft")
    p.add_argument("--out")
    p.add_argument("--seed", default=0, type=int)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tracemill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "validate":
        bad = load(spark, a.episodes).select("id", schema.validation_errors().alias("errors")).where("size(errors) > 0")
        show(bad)
        return int(not bad.isEmpty())
    e = scored(spark, a.episodes)
    if a.id:
        e = e.where(F.col("id") == a.id)
    if a.command == "list":
        show(datasets.index_rows(e).orderBy("created_at", "id"))
    elif a.command == "show":
        show(e.drop("ord"))
    elif a.command == "summary":
        show(summary.summarised(e).withColumn("description", summary.description()))
    elif a.command == "audit":
        show(analytics.audit(e).orderBy("kind", F.desc("n"), "name"))
    elif a.command == "loop":
        show(analytics.partition(e, seed=a.seed).select("id", "split").orderBy("id"))
    elif a.out:
        sinks.export(e, a.format, a.out)
        print(json.dumps({"format": a.format, "out": a.out}))
    else:
        show(sinks.exported(e, a.format))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
