"""Streaming ingest: usage totals, session finalising, and hook events.

Sessions close by explicit events, not by time, so there are no windows here; state is bounded by the sessions themselves."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemill.operators import sessions
from tracemill.sources import logs
from tracemill.sources.store import upserted

SHARDS = 64


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """JSON files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def usage_totals(bodies: DataFrame, deduplicate: str | None = None) -> DataFrame:
    """A3/J11 as a stream: running totals of each session. Deltas are added as they come; ``deduplicate`` names a column
    of event time by which repeated deliveries within a day are dropped."""
    if deduplicate:
        bodies = bodies.withWatermark(deduplicate, "1 day").dropDuplicatesWithinWatermark(["body"])
    return logs.usage(logs.usage_points(bodies))


def start_usage(bodies: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Running totals as files: each micro-batch appends the sessions that it changed, with its epoch as version."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("version", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return usage_totals(bodies).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).start()


def usage_now(spark: SparkSession, out: str) -> DataFrame:
    """The latest totals of each session."""
    return upserted(None, spark.read.parquet(out), "session_id", "version").drop("version", "epoch")


def finalise(batch: DataFrame, epoch: int, events: str, out: str) -> None:
    """E1/SRC9 for one micro-batch: appends its events, and rebuilds the sessions that it ended, from all their events.

    Both writes are keyed by the epoch and overwrite their own folders, so a batch that is run again changes nothing. Events
    lie in folders by a hash of their session and then by epoch, so that a rebuild lists and reads those of the sessions
    concerned only."""
    spark = batch.sparkSession
    batch = batch.withColumns({"shard": F.pmod(F.xxhash64("session_id"), F.lit(SHARDS)).cast("int"), "epoch": F.lit(epoch).cast("bigint")})
    batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard", "epoch").parquet(events)
    ended = batch.where(F.col("hook").isin("Stop", "SessionEnd")).select("session_id", "shard").distinct()
    shards = sorted(r.shard for r in ended.select("shard").distinct().collect())
    if not shards:
        return
    every = spark.read.option("basePath", events).parquet(*(f"{events}/shard={s}" for s in shards))
    mine = every.join(ended, ["session_id", "shard"], "left_semi").drop("shard", "epoch")
    sessions.built(mine).withColumn("version", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")


def start_finalising(events: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Events of hooks to episodes; the latest version of a session's episode is what ``store.upserted`` picks."""
    return events.writeStream.foreachBatch(lambda b, e: finalise(b, e, os.path.join(store, "events"), os.path.join(store, "episodes"))).option("checkpointLocation", checkpoint).start()


def finalised(spark: SparkSession, store: str) -> DataFrame:
    """The latest episode of each session."""
    return upserted(None, spark.read.parquet(os.path.join(store, "episodes")), "session_id", "version")
