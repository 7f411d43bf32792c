"""Near-duplicate embeddings: all links by bounds on parts of vectors, or pairs by cross-polytope hashing.

``vector_links`` compares all with all, exactly. Vectors are rotated at random; by Cauchy-Schwarz a cosine is at most the
product of the first quarter of the coordinates plus that of the lengths of the rest, which one matrix product over a
quarter of the width gives for a tile of pairs. Only pairs whose bound reaches the threshold get their cosine computed.

``near_pairs`` hashes, and misses some pairs right at the threshold.
Three rounds of random sign flips and fast Hadamard transforms rotate each unit vector at random; its hash is the
coordinate of greatest size with its sign, for ``hashes`` rotations together. Equal vectors are found first and stand for
each other. The others go to their own bucket in each of ``tables`` tables, and probe besides the buckets that are next
best, where one rotation's hash is replaced by its second choice. Vectors that meet in a bucket are a candidate pair,
and every candidate pair is verified by its exact cosine. The number of rotations in a hash is fixed. The number of tables
follows from the dimension, the threshold and the recall asked for, by trials on random pairs that just reach the
threshold; so whether two vectors pair never depends on what else is in the table, or how much.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.common import LINKS, U64, Links, class_links, cut, expanded, groups, mix64, partitions, shared_path, table

THRESHOLD, RECALL, HASHES, SEED, BLOCK, TRIALS = 0.95, 0.98, 3, 5, 2048, 4000
TILE, FILE_ROWS, MARGIN = 1024, 16_384, 1e-4
PAIRS = "vec_a bigint, vec_b bigint, cosine double"


@lru_cache
def _small(width: int) -> np.ndarray:
    """The Hadamard matrix of up to 8 rows, scaled to keep lengths."""
    at = np.arange(width)
    return (1 - 2.0 * (np.bitwise_count(at[:, None] & at) & 1)).astype(np.float32) / np.float32(np.sqrt(width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (a power of two long), scaled to keep lengths: three levels of butterflies at a time."""
    n, width = x.shape
    left = width
    while left > 1:
        r = min(8, left)
        x = (x.reshape(-1, r) @ _small(r)).reshape(n, width // r, r).swapaxes(1, 2).reshape(n, width)
        left //= r
    return x


def rotations(width: int, count: int, seed: int) -> np.ndarray:
    """Signs (count, 3, width) of random flips."""
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (count, 3, width))


def buckets(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """Bucket keys (rows, tables, 1 + probes) of unit vectors: a row's own bucket, then those it probes besides."""
    n, dim = x.shape
    width = max(2, 1 << (dim - 1).bit_length())
    padded = np.zeros((n, width), np.float32)
    padded[:, :dim] = x
    out = np.empty((n, tables, 1 + probes), np.int64)
    every = np.arange(n)
    signs = rotations(width, tables * hashes, seed)
    for t in range(tables):
        best, second, loss = [], [], []
        for k in range(hashes):
            y = padded
            for flip in signs[t * hashes + k]:
                y = hadamard(y * flip)
            size = np.abs(y)
            a = size.argmax(axis=1)
            most = size[every, a]
            size[every, a] = -1
            b = size.argmax(axis=1)
            best.append(2 * a + (y[every, a] < 0))
            second.append(2 * b + (y[every, b] < 0))
            loss.append(most - size[every, b])

        def name(parts: list[np.ndarray], t: int = t) -> np.ndarray:
            h = np.full(n, t, U64)
            for p in parts:
                h = mix64(h * U64(0x9E3779B97F4A7C15) + p.astype(U64) + U64(1))
            return h.view(np.int64)

        out[:, t, 0] = name(best)
        order = np.argsort(np.stack(loss), axis=0)
        for p in range(probes):
            # Changes from the least loss on: rotation order[0], then order[1], ..., then all of them.
            changed = [np.where((order[min(p, hashes - 1)] == k) if p < hashes else True, second[k], best[k]) for k in range(hashes)]
            out[:, t, 1 + p] = name(changed)
    return out


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of length 1 in double precision, in which the square of no single-precision number over- or underflows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten(), np.float32).reshape(len(column), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hash(tables: int, hashes: int, probes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = buckets(_unit(batch.column("embedding")), tables, hashes, probes, seed)
            probing = np.tile(np.arange(keys.shape[2]) > 0, keys.shape[1])
            at = pa.array(np.repeat(np.arange(batch.num_rows), len(probing)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.tile(probing, batch.num_rows)), batch.column("vec_id").take(at)], ["bucket", "probing", "vec_id"])

    return run


@lru_cache
def tables_for(dim: int, threshold: float, recall: float, hashes: int, probes: int, seed: int = SEED) -> int:
    """Tables after which a pair that just reaches the threshold has met with a probability of at least ``recall``.

    The probability to meet in one table is taken from ``TRIALS`` random pairs of that cosine, each in a table of its own
    rotations out of 40."""
    if dim < 2 or threshold >= 1:
        return 1
    r = np.random.default_rng(seed)
    x, y = r.normal(size=(2, TRIALS, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * y / np.linalg.norm(y, axis=1, keepdims=True)
    met = []
    for k, at in enumerate(np.array_split(np.arange(TRIALS), 40)):
        a, b = (buckets(v[at], 1, hashes, probes, seed + 1 + k)[:, 0] for v in (x, y))
        met.append(((a[:, :1] == b).any(axis=1) | (b[:, :1] == a).any(axis=1)).mean())
    miss = 1 - np.mean(met)
    return 1 if miss <= 1 - recall else 64 if miss >= 1 else min(64, math.ceil(math.log(1 - recall) / math.log(miss)))


def _verify(threshold: float):
    """Pairs of a bucket's two parts: its own vectors with each other and with those that probe it."""

    def pairs(ids: np.ndarray, own: np.ndarray, x: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(left), BLOCK):
            rows = left[a : a + BLOCK]
            for b in range(0, len(right), BLOCK):
                others = right[b : b + BLOCK]
                cosine = x[rows] @ x[others].T
                i, j = np.nonzero(cosine >= threshold)
                i, j, c = rows[i], others[j], cosine[i, j]
                keep = (ids[i] != ids[j]) & (own[i] | own[j])
                if keep.any():
                    p, q = ids[i[keep]], ids[j[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(np.minimum(c[keep], 1.0))], ["vec_a", "vec_b", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["bucket", "one", "two"]):
            one, two = t["one"][0].as_py(), t["two"][0].as_py()
            ids, own, part = t["vec_id"].to_numpy(), ~t["probing"].to_numpy(zero_copy_only=False), t["part"].to_numpy()
            if len(ids) < 2 or not own.any():
                continue
            x, every = _unit(t["embedding"]), np.arange(len(ids))
            if one == two:
                yield from pairs(ids, own, x, np.flatnonzero(own), every)
            else:
                yield from pairs(ids, own, x, every[part == one], every[part == two])

    return run


def _clean(vectors: DataFrame) -> DataFrame:
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    fine = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = v.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    # A class is told by its hash and then its numbers, with -0 as 0; ids are never gathered in one row.
    return v.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0).cast("float")))


def near_pairs(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES, tables: int | None = None, probes: int | None = None, seed: int = SEED, part: int = 8 * BLOCK, all_pairs: bool = False) -> DataFrame:
    """``(vec_a, vec_b, cosine)``: pairs of ``vectors(vec_id, embedding array<float>)`` with a cosine of at least ``threshold``.

    Vectors with equal numbers form one class: each pairs with the class's least vec_id (cosine 1), which stands for the
    class in pairs with others; vec_a is the lesser id. ``all_pairs`` writes out the pairs that follow from the classes as
    well. A null vec_id, a null, empty or zero embedding, or one with null or non-finite numbers takes no part; embeddings
    of different lengths are never paired. Repeated rows count as one. An empty table gives no pairs. Other columns are
    ignored. Any two vectors are compared by their cosine in double precision once they meet in a bucket (a cosine within
    its rounding of the threshold may fall on either side), so pairs may be missed but none is wrong: of pairs right at the
    threshold about ``recall`` are found, of closer ones more. A bucket of more than ``part`` rows is cut into parts, which
    are compared pair by pair in tasks of their own; that changes the cost only."""
    v = _clean(vectors)
    classes = cut(v.withColumn("first", F.min("vec_id").over(Window.partitionBy("embedding"))))
    equal = classes.where("vec_id <> first").select(F.col("first").alias("vec_a"), F.col("vec_id").alias("vec_b"), F.lit(1.0).alias("cosine")).distinct()
    firsts = cut(classes.where("vec_id = first").select("vec_id", "embedding").distinct())
    parts = partitions(vectors.sparkSession)
    probes = hashes if probes is None else probes
    near = None
    # An Arrow array of vectors becomes a matrix, so each length is hashed by itself.
    for (dim,) in sorted(firsts.select(F.size("embedding")).distinct().collect()):
        same = firsts.where(F.size("embedding") == dim)
        count = tables or tables_for(dim, threshold, recall, hashes, probes)
        hashed = same.mapInArrow(_hash(count, hashes, probes, seed), "bucket bigint, probing boolean, vec_id bigint")
        # Buckets of one vector, or of probes only, go before vectors are fetched.
        w = Window.partitionBy("bucket")
        met = hashed.withColumns({"own": F.sum((~F.col("probing")).cast("int")).over(w), "all": F.count("*").over(w)}).where("own > 0 and all > 1")
        # Part p of n meets parts p to n - 1 as the first of two, and parts 0 to p - 1 as the second.
        met = met.withColumn("n", F.ceil(F.col("all") / part).cast("int")).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int"))
        met = met.select("bucket", "probing", "vec_id", "part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
        met = met.select("bucket", "probing", "vec_id", "part", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"))
        keys = ["bucket", "one", "two"]
        found = met.join(same, "vec_id").repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_verify(threshold), PAIRS)
        near = found if near is None else near.union(found)
    if near is None:
        return equal
    near = near.groupBy("vec_a", "vec_b").agg(F.max("cosine").alias("cosine"))
    return expanded(near, equal) if all_pairs else near.union(equal)


def _bounding(x: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Rows (first quarter of the rotated coordinates, length of the rest): their products bound the cosines of unit vectors."""
    n, dim = x.shape
    width = max(2, 1 << (dim - 1).bit_length())
    y = np.zeros((n, width), np.float32)
    y[:, :dim] = x
    for flip in rotations(width, 1, seed)[0]:
        y = hadamard(y * flip)
    k = max(1, width // 4)
    rest = np.linalg.norm(y[:, k:], axis=1, keepdims=True)
    return np.ascontiguousarray(np.hstack([y[:, :k], rest]), np.float32)


def near_tiles(left: np.ndarray, right: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (i, j) of all pairs of unit vectors with a cosine of at least the threshold, by tiles: within ``left`` (i < j), or between it and ``right``."""
    two = left if right is None else right
    a, b = _bounding(left), _bounding(two)
    for p in range(0, len(left), TILE):
        for q in range(p if right is None else 0, len(two), TILE):
            i, j = np.nonzero(a[p : p + TILE] @ b[q : q + TILE].T >= threshold - MARGIN)
            if right is None and p == q:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            x, y = left[p : p + TILE], two[q : q + TILE]
            if len(i) * 50 > len(x) * len(y):
                cosine = (x @ y.T)[i, j]
            else:
                cosine = np.einsum("ij,ij->i", x[i], y[j])
            ok = cosine >= threshold
            if ok.any():
                yield p + i[ok], q + j[ok]


def _vectors(uri: str) -> pa.Table:
    fs, at = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_file(at) as f:
        return pq.read_table(f)


def _link_files(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist()):
                sides = [_vectors(u) for u in ([one] if one == two else [one, two])]
                rep, weight, mixed = (np.concatenate([t[c].to_numpy() for t in sides]) for c in ("rep", "weight", "mixed"))
                links, at = Links(rep, weight, mixed), sides[0].num_rows
                x = [_unit(t["embedding"]) for t in sides]
                for i, j in near_tiles(x[0], x[1] if x[1:] else None, threshold):
                    links.add(i, at + j if x[1:] else j)
                yield from links.rows()

    return run


def vector_links(vectors: DataFrame, threshold: float = THRESHOLD, file_rows: int = FILE_ROWS) -> DataFrame:
    """``(vec_id, class_id, links)`` for each vec_id of ``vectors(vec_id, embedding array<float>)``.

    links: the number of other ids with a cosine of at least ``threshold``, all of them, equal vectors too; class_id: the
    least id of all that links lead to, step by step (its own without links). No pair is missed; a cosine within its
    rounding in double precision of the threshold may fall on either side. Which embeddings take part is as in ``near_pairs``; the others have
    no links. An id of several embeddings is linked if any of them is, and once. Repeated rows count as one; a null vec_id
    has no row. An empty table gives no rows. Other columns are ignored.

    Distinct vectors are written to files of at most ``file_rows`` rows in the shared folder, and each pair of files is a
    piece of work: time grows with the square of the vectors, what is exchanged with the vectors that have links."""
    spark = vectors.sparkSession
    v = _clean(vectors)
    by_id, by_vector = Window.partitionBy("vec_id"), Window.partitionBy("embedding")
    if v.groupBy("vec_id").count().where("count > 1").isEmpty():
        rows = v.withColumns({"row": F.col("vec_id"), "multi": F.lit(False)})
    else:
        rows = cut(v.distinct().withColumn("row", F.monotonically_increasing_id())).withColumn("multi", F.count("*").over(by_id) > 1)
    single = (~F.col("multi")).cast("int")
    rows = cut(rows.withColumns({"rep": F.min("row").over(by_vector), "weight": F.sum(single).over(by_vector), "mixed": F.max("multi").over(by_vector)}))
    found = None
    for (dim,) in sorted(rows.select(F.size("embedding")).distinct().collect()):
        path = shared_path(spark, f"vectors-{dim}")
        rows.where((F.col("row") == F.col("rep")) & (F.size("embedding") == dim)).select("rep", "embedding", "weight", "mixed").write.option("maxRecordsPerFile", file_rows).parquet(path)
        files = sorted(spark.read.parquet(path).inputFiles())
        work = [(a, b) for k, a in enumerate(files) for b in files[k:]]
        pairs = spark.createDataFrame(work, "one string, two string").repartition(min(len(work), 1000))
        some = pairs.mapInArrow(_link_files(threshold), LINKS)
        found = some if found is None else found.union(some)
    ids = vectors.select(F.col("vec_id").cast("bigint").alias("id")).where("id is not null").distinct()
    if found is None:
        return ids.select(F.col("id").alias("vec_id"), F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("links"))
    return class_links(ids, rows.select("rep", F.col("vec_id").alias("id"), "multi", "weight"), found).withColumnRenamed("id", "vec_id")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings"))
