"""Corpus preparation in stages; each stage's output is written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of ``documents``. Rows go for these reasons only: the classifier rejects
their text, another document of their group of near copies stays, or the training plan has no use for them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import mixing, ngram_join, pieces, quality
from tracemill.llm.common import shared_path, spread, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier fitted on the labels doesn't reject; null and empty texts are rejected.

    Repeated rows are judged each; an empty table gives no rows; columns may have any names."""
    return quality.keep_good(spread(docs), quality.train(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group of near copies stays, and all documents that are in no group.

    Rows of one doc_id with different texts are documents each; rows equal in both are copies. Rows without doc_id or text
    stay; an empty table gives no rows; columns may have any names."""
    return ngram_join.first_of_groups(spread(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the curriculum uses each.

    Equal positions are ordered by doc_id; repeated rows are used as their id is, each; null, empty and blank texts have no
    tokens and go; a null source is a source of its own; an empty table gives no rows; columns may have any names."""
    return mixing.in_training_order(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, part, row, ids, n_tokens, round_trip)`` for each row.

    (part, row) names a row of the files that were read; sorted by both, rows stand in the training order that those files
    hold. Both are null if ``docs`` isn't as it was read from files. Repeated rows are encoded each; a null text has null results; an
    empty table gives no rows; other columns are left out, whatever their names."""
    own = [F.col(c) for c in ("doc_id", "text", "lang", "source")]
    try:
        place = docs.select(*own, F.col("_metadata.file_name").alias("part"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # not as it was read from files
        place = docs.select(*own, F.lit(None).cast("string").alias("part"), F.lit(None).cast("bigint").alias("row"))
    return pieces.encode(spread(place), keep=("lang", "source", "part", "row"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("source_mixing", source_mixing),
    ("sentencepiece_encoding", sentencepiece_encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = shared_path(spark, f"pipeline-{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
