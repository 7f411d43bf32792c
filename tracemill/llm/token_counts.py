"""Token counts by a two-tier lookup on the map side.

A text's byte-pair tokens are those of its pre-tokens, so its count is a sum of pre-token lengths. The frequent
pre-tokens of all documents, found by a mergeable sketch, are encoded once on the driver; their lengths go to the workers
as a compact table. A pre-token that the table lacks is encoded by the worker that meets it and kept in a bounded cache.
No pre-token is ever exchanged between executors, and no result depends on which pre-tokens are in the table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import documents, slices

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FREQUENT, TRACKED, CACHE, LONGEST = 16_384, 65_536, 500_000, 64


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encoding(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Lengths(dict):
    """Pre-token lengths: itself the frequent ones; what it lacks is encoded once and kept in a cache that starts anew when full."""

    def __init__(self, frequent: dict[str, int], encode, limit: int = CACHE):
        super().__init__(frequent)
        self.encode, self.limit, self.met = encode, limit, {}

    def __missing__(self, token: str) -> int:
        n = self.met.get(token)
        if n is None:
            n = len(self.encode(token))
            if len(token) <= LONGEST:
                if len(self.met) >= self.limit:
                    self.met = {}
                self.met[token] = n
        return n


def frequent_pretokens(docs: DataFrame, k: int = FREQUENT, tracked: int = TRACKED) -> list[str]:
    """About the ``k`` most frequent pre-tokens that are a word or number with the space before it, over all documents.
    Those of more than ``LONGEST`` characters are left to the workers, so that sketches and table stay small.

    Executors fold what they read into frequent-item sketches of bounded size; only these are merged, first in groups, so
    that the last merge reads about the root of the number of tasks."""
    words = docs.select(F.explode(F.expr(r"regexp_extract_all(text, ' ?\\p{L}+| ?\\p{N}+', 0)")).alias("w")).where(F.length("w") <= LONGEST)
    groups = max(1, round(docs.rdd.getNumPartitions() ** 0.5))
    parts = words.groupBy(F.pmod(F.spark_partition_id(), F.lit(groups)).alias("g")).agg(F.expr(f"approx_top_k_accumulate(w, {tracked})").alias("s"))
    # Grouped by a constant: combining no sketches at all fails, a group that isn't there gives no row.
    row = parts.groupBy(F.lit("all").alias("every")).agg(F.expr("approx_top_k_combine(s)").alias("s")).select(F.expr(f"approx_top_k_estimate(s, {k})").alias("top")).first()
    return [x.item for x in row.top or []] if row else []


def count_tokens(docs: DataFrame, path: str = RANKS, frequent: int = FREQUENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *keep, n_tokens bigint)`` for each row of ``docs(doc_id, text)``: the length of its byte-pair encoding.

    A null text has a null count, an empty one 0. Strings of special tokens count as ordinary text. Repeated rows are
    counted each; an empty table gives no rows; other columns are left out. ``frequent`` = 0 does without the table."""
    context = docs.sparkSession.sparkContext
    ranks = load_ranks(path)
    own = encoding(ranks)
    top = frequent_pretokens(docs.select(F.col("text").cast("string").alias("text")), frequent) if frequent else []
    compact = context.broadcast(("\n".join(top), np.array([len(own.encode_ordinary(t)) for t in top], np.uint32)))
    shared = context.broadcast(ranks)
    chosen = docs.select("doc_id", *keep, F.col("text").cast("string").alias("__text"))
    names = chosen.columns[:-1]
    schema = T.StructType([*chosen.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sizes = compact.value
        lengths = Lengths(dict(zip(words.split("\n"), sizes.tolist())) if words else {}, encoding(shared.value).encode_ordinary)
        find, length = regex.compile(PATTERN).findall, lengths.__getitem__
        for batch in batches:
            for part in slices(batch, "__text"):
                counts = [None if t is None else sum(map(length, find(t))) for t in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), pa.array(counts, pa.int64())], [*names, "n_tokens"])

    return chosen.mapInArrow(run, schema)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
