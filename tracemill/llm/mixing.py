"""Mixing sources to target weights along a curriculum.

A schedule gives each source its share of the training tokens as a piecewise linear function of progress (0 to 1). The
integral of a source's share, times the token budget, is its cumulative demand. Tokens are byte-pair tokens, counted as
``token_counts`` counts them, unless a column of lengths is named. Its documents stand in a random order
fixed by a hash; a document whose tokens begin after C tokens of its source is trained on where the demand reaches the
middle of it, so the inverse of the demand gives its position. A source with less tokens than demanded is repeated; what
a source has beyond its demand is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.common import checked, cut, documents, fresh, partitions
from tracemill.llm.token_counts import count_tokens

SEED = 11


def flattening_schedule(totals: DataFrame) -> DataFrame:
    """``(source, knot, share)`` at progress 0, 0.5 and 1 out of ``totals(source, total)``.

    Training begins with the sources' natural shares and ends with shares in proportion to the root of their totals,
    halfway it is halfway between. A source without tokens has no share."""
    own = totals.where("total > 0")
    sums = own.agg(F.sum("total").cast("double").alias("sum0"), F.sum(F.sqrt("total")).alias("sum1"))
    shares = own.crossJoin(F.broadcast(sums)).select("source", (F.col("total") / F.col("sum0")).alias("s0"), (F.sqrt("total") / F.col("sum1")).alias("s1"))
    knots = F.explode(F.array(*(F.struct(F.lit(k).alias("knot"), ((1 - k) * F.col("s0") + k * F.col("s1")).alias("share")) for k in (0.0, 0.5, 1.0))))
    return shares.select("source", knots.alias("k")).select("source", "k.knot", "k.share")


def demand_segments(schedule: DataFrame, budget: Column) -> DataFrame:
    """Schedule segments with the demand where each begins and ends; negative and null shares count as 0."""
    w = Window.partitionBy("source").orderBy("knot")
    share = F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(0.0))
    s = schedule.where("knot is not null").select("source", "knot", share.alias("share")).withColumns({"next_knot": F.lead("knot").over(w), "next_share": F.lead("share").over(w)}).where("next_knot > knot")
    area = (F.col("share") + F.col("next_share")) / 2 * (F.col("next_knot") - F.col("knot")) * budget
    return s.withColumn("area", area).withColumn("end", F.sum("area").over(w)).withColumn("begin", F.col("end") - F.col("area"))


def positions(docs: DataFrame, schedule: DataFrame | None = None, budget_tokens: int | None = None, seed: int = SEED, buckets: int | None = None, length: str | None = None) -> DataFrame:
    """``(doc_id, source, n_tokens, repeat int, position double)``: the training plan of ``docs(doc_id, text, source)``.

    ``repeat`` counts a document's uses from 0; ``position`` lies in [0, 1]. ``budget_tokens`` defaults to all tokens of
    ``docs``; ``schedule(source, knot, share)`` to ``flattening_schedule``. ``length`` names a column of ``docs`` with the
    documents' lengths; by default the texts' byte-pair tokens are counted. A source that the schedule lacks gets no
    position. Nulls: a null source is a source of its own; a null doc_id is like any other id; null, empty and blank texts,
    and null lengths or such below 1, have no tokens, so nothing of them is trained on and they get no position. Repeated rows
    count as documents each, in an order that doesn't matter as they are equal. An empty table gives no rows. Other
    columns are ignored, whatever their names."""
    spark = docs.sparkSession
    buckets = buckets or max(64, partitions(spark))
    counted = count_tokens(docs.where(F.col("text").rlike(r"[^ \t\n\r\f]")), frequent=0, keep=("source",)) if length is None else docs.select("doc_id", "source", F.col(length).cast("bigint").alias("n_tokens"))
    rows = counted.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source"), "n_tokens").where("n_tokens > 0")
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "doc_id")), 1, 15), 16, 10).cast("bigint")
    rows = cut(rows.withColumn("draw", order).withColumn("bucket", F.floor(F.shiftright("draw", 30) * buckets / 2**30).cast("int")))
    # Running sums in two steps, so that one large source is not one task.
    by = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("sum"))
    w = Window.partitionBy("source").orderBy("bucket")
    by = cut(by.withColumn("base", F.coalesce(F.sum("sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    totals = by.groupBy("source").agg(F.sum("sum").alias("total"))
    budget = F.lit(budget_tokens) if budget_tokens is not None else F.lit(totals.agg(F.sum("total")).first()[0] or 0)
    if schedule is None:
        schedule = flattening_schedule(totals)
    else:
        schedule = schedule.withColumn("source", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    segments = cut(demand_segments(schedule, budget.cast("double")))
    demand = segments.groupBy("source").agg(F.max("end").alias("demand"))
    w = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("n_tokens").over(w)).join(by.select("source", "bucket", "base"), ["source", "bucket"]).join(totals.join(demand, "source"), "source")
    middle = F.col("base") + F.col("upto") - F.col("n_tokens") / 2
    placed = placed.withColumn("middle", middle).where("middle < demand")
    uses = F.sequence(F.lit(0), F.floor((F.col("demand") - F.col("middle")) / F.col("total")).cast("int"))
    placed = placed.withColumn("repeat", F.explode(uses)).withColumn("at", F.col("middle") + F.col("repeat") * F.col("total")).where("at < demand")
    each = segments.select(F.col("source").alias("s"), "begin", "end", "area", "knot", "next_knot", "share", "next_share")
    placed = placed.join(each, (F.col("source") == F.col("s")) & (F.col("at") >= F.col("begin")) & (F.col("at") < F.col("end")))
    # The demand is quadratic within a segment; u is the part of it that has passed.
    rise, part = F.col("next_share") - F.col("share"), (F.col("at") - F.col("begin")) / F.col("area") * (F.col("share") + F.col("next_share")) / 2
    u = 2 * part / (F.col("share") + F.sqrt(F.greatest(F.col("share") * F.col("share") + 2 * rise * part, F.lit(0.0))))
    position = F.col("knot") + F.least(u, F.lit(1.0)) * (F.col("next_knot") - F.col("knot"))
    source = F.when(F.col("source") != "", F.expr("substring(source, 2)"))
    return placed.select("doc_id", source.alias("source"), "n_tokens", "repeat", position.alias("position"))


def in_training_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the plan uses them, with their own columns, range-sorted by position, ties by doc_id.

    Documents of which nothing is trained on (no tokens, no demand left) go. Rows that share a doc_id are used as their
    ids are: each such row, for each use that the plan has for the id, once. Columns may have any names."""
    position, doc = fresh(docs, "position"), fresh(docs, "doc")
    plan = positions(docs, **options).groupBy("doc_id", "repeat").agg(F.min("position").alias(position)).select(F.col("doc_id").alias(doc), position)
    joined = docs.join(checked(plan), docs["doc_id"].eqNullSafe(F.col(doc)))
    return joined.orderBy(position, doc).select(docs.columns)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(documents(spark, sf_dir)).orderBy("position", "doc_id", "repeat")
