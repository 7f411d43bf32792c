"""Helpers shared by the operators of this subpackage: shared storage, Arrow batch handling, byte-level hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

SLICE_BYTES, BROADCAST_ROWS, BROADCAST_BYTES = 1 << 20, 300_000, 32 << 20
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scanned table on as many partitions as there are cores at least: a few large row groups would leave most idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); where the session names none, a temporary one on a local
    master, and an error on a cluster, whose executors share no temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tracemill-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checked(small: DataFrame) -> DataFrame:
    """Materialised, and marked for broadcast only if its rows and the bytes of its texts were counted to be few; else Spark joins by an exchange."""
    small = cut(small)
    wide = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in small.schema.fields if not isinstance(f.dataType, (NumericType, BooleanType))]
    n, width = small.agg(F.count("*"), F.coalesce(F.sum(sum(wide, F.lit(0))), F.lit(0))).first()
    return F.broadcast(small) if n <= BROADCAST_ROWS and width <= BROADCAST_BYTES else small


def expanded(near: DataFrame, equal: DataFrame) -> DataFrame:
    """All pairs that follow from ``near``, pairs of the least ids of classes, and ``equal``, each class's least id with its others.

    Both have two ids, the lesser first, and a value, which is 1 within a class; pairs between two classes have that of their least ids."""
    a, b, value = near.columns
    reps = near.select(F.col(a).alias("id")).union(near.select(b)).union(equal.select(a)).distinct()
    members = cut(reps.select(F.col("id").alias("rep"), "id").union(equal.select(a, b)))
    one, two = members.select(F.col("rep").alias("r1"), F.col("id").alias("x")), members.select(F.col("rep").alias("r2"), F.col("id").alias("y"))
    across = near.join(one, F.col(a) == F.col("r1")).join(two, F.col(b) == F.col("r2"))
    inside = one.join(two, F.col("r1") == F.col("r2")).where("x < y").select(F.col("x").alias(a), F.col("y").alias(b), F.lit(1.0).alias(value))
    return across.select(F.least("x", "y").alias(a), F.greatest("x", "y").alias(b), value).union(inside)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    have, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name in have:
        name += "_"
    return name


def shared_path(spark: SparkSession, stem: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts back to back and the n + 1 offsets into them; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, off, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows holding about ``limit`` bytes of text (one longer text is a run of its own)."""
    if batch.num_rows == 0:
        return
    _, off = text_buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def map_slices(df: DataFrame, text: str, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` over bounded runs of rows, so that numpy temporaries stay small whatever Spark's batch size is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                out = f(part)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows with equal keys out of batches sorted by those keys; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(batch.column(k)[a].as_py() for k in keys)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64 arrays."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(1)
def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Word bytes in lower case (0: not in a word), and a random 64-bit name for each of them (0 for 0)."""
    fold = np.zeros(256, np.uint8)
    for c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
        fold[c] = c
    fold[65:91] = np.arange(97, 123)
    names = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
    names[0] = 0
    return fold, names


_POWERS: list[np.ndarray] = []
_R, _R_INV = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of an odd multiplier and of its inverse, mod 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 21)
        out = []
        for r in (_R, _R_INV):
            p = np.full(size, r, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word, and n + 1 offsets of the texts into the words.

    A word is a run of ASCII letters and digits and of characters beyond ASCII, without regard to ASCII case."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    fold, names = byte_tables()
    b = fold[data]
    inside = b != 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    start[first] = inside[first]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    up, down = powers(len(data))
    sums = np.add.reduceat(names[b] * up[: len(data)], starts)
    return mix64(sums * down[starts]), np.searchsorted(starts, offsets)


def ngram_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams; a text of 1 to n - 1 words has one gram, of all its words."""
    words, at = word_hashes(data, offsets)
    step = U64(0x9E3779B97F4A7C15)
    grams = words.copy()
    for k in range(1, n):
        grams[: len(words) - k] = grams[: len(words) - k] * step + words[k:]
    grams = mix64(grams + U64(n))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            keep = np.empty(len(g), bool)
            keep[:1] = True
            np.not_equal(g[1:], g[:-1], out=keep[1:])
            yield g if keep.all() else g[keep]
        elif b > a:
            h = words[a : a + 1]
            for k in range(a + 1, b):
                h = h * step + words[k : k + 1]
            yield mix64(h + U64(1000 + b - a))
        else:
            yield np.zeros(0, U64)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``edges(src, dst)`` (bigint); a component is named by its least node.

    Alternating large-star and small-star rounds: each is one exchange over the edges, and the number of rounds grows
    with the logarithm of the longest chain. Every round is checkpointed, as its input would otherwise be computed again."""
    e = cut(edges.where("src <> dst and src is not null and dst is not null").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())

    def mark(d: DataFrame) -> tuple:
        return tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.union(low.where("m < u").selectExpr("u", "m as v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(least.selectExpr("u", "m as v")).distinct())
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


LINKS = "a bigint, b bigint, n bigint"


class Links:
    """Links and connected groups of the items of one block (or two), out of the pairs found there, bit by bit.

    ``weight``: the ids an item stands for; ``mixed``: whether it also stands for ids that have other items."""

    def __init__(self, names: np.ndarray, weight: np.ndarray, mixed: np.ndarray):
        self.names, self.weight, self.mixed = names, weight, mixed
        self.count, self.met, self.root = np.zeros(len(names)), np.zeros(len(names), bool), np.arange(len(names))
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs (i, j) of items; each pair comes once."""
        self.met[i] = self.met[j] = True
        self.count += np.bincount(i, self.weight[j], len(self.names)) + np.bincount(j, self.weight[i], len(self.names))
        if self.mixed.any() and (own := self.mixed[i] | self.mixed[j]).any():
            self.pairs.append((self.names[i[own]], self.names[j[own]]))
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while ((up := self.root[self.root]) != self.root).any():
                self.root = up

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Of ``LINKS``: (item, root of its group here, links here), and (item, item, null) for pairs with a mixed item."""
        at = np.flatnonzero(self.met)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(self.names[at]), pa.array(self.names[self.root[at]]), pa.array(self.count[at].astype(np.int64))], ["a", "b", "n"])
        for a, b in self.pairs:
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "n"])


def class_links(ids: DataFrame, members: DataFrame, found: DataFrame) -> DataFrame:
    """``(id, class_id, links)`` for each of ``ids(id)``: the least id that links lead to, and the number of ids linked with it.

    ``members(rep, id, multi, weight)``: each distinct item ``rep`` with its ids, all linked with each other; multi: the id has
    other items too; weight: the ids of the item that don't. ``found``: ``LINKS`` between items."""
    found = cut(found)
    sums = found.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    least = members.groupBy("rep").agg(F.min("id").alias("least"))
    one, two = least.select(F.col("rep").alias("a"), F.col("least").alias("src")), least.select(F.col("rep").alias("b"), F.col("least").alias("dst"))
    edges = found.where("n is not null and a <> b").select("a", "b").distinct().join(one, "a").join(two, "b").select("src", "dst")
    groups_ = connected_components(edges.union(members.join(least, "rep").select("id", "least")))
    counts = members.where("not multi").join(sums, "rep", "left").select("id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"))
    if not members.where("multi").isEmpty():
        # An id with several items may meet another by more than one of them: these pairs are told apart by id.
        met = found.where("n is null").select("a", "b")
        met = met.union(met.select("b", "a")).union(members.where("multi").select("rep", F.col("rep").alias("b"))).distinct()
        x = members.select(F.col("rep").alias("a"), F.col("id").alias("x"), F.col("multi").alias("mx"))
        y = members.select(F.col("rep").alias("b"), F.col("id").alias("y"), F.col("multi").alias("my"))
        pairs = met.join(x, "a").join(y, "b").where("x <> y and (mx or my)").select("x", "y").distinct()
        counts = counts.union(pairs.groupBy("x").agg(F.count("*").alias("links"))).groupBy("id").agg(F.sum("links").alias("links"))
    linked = counts.where("links > 0").join(groups_, F.col("id") == F.col("node")).select("id", "component", "links")
    return ids.join(checked(linked), "id", "left").select("id", F.coalesce("component", "id").alias("class_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))
