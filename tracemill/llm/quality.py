"""Quality classifier: a byte-level convolutional network in numpy.

Bytes have learned vectors; learned filters of 8 bytes pass over the text every 4 bytes. Their outputs are max-pooled in
overlapping chunks of 512 bytes (448 apart) that cover the whole document. The mean and the maximum over the chunks go
into one logistic unit, which gives the probability of good quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.common import documents, slices, table, text_buffers

MAX_TRAIN, MAX_TRAIN_BYTES, MAX_TOTAL_BYTES, EPOCHS, BATCH, RATE, THRESHOLD = 4000, 200_000, 64_000_000, 16, 48, 0.004, 0.5
DIM, STRIDE, FILTERS = 8, 4, 32
BLOCK, CHUNK, HOP = 16, 8, 7  # positions in a block; blocks in a chunk; blocks from a chunk to the next
_SPAN = BLOCK * STRIDE


def _layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded with zero bytes to whole blocks (4 zeros at least), and the offsets of their blocks."""
    blocks = -(-(np.diff(offsets) + STRIDE) // _SPAN)
    at = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(int(at[-1]) * _SPAN + STRIDE, np.uint8)
    for a, b, to in zip(offsets[:-1].tolist(), offsets[1:].tolist(), (at[:-1] * _SPAN).tolist()):
        out[to : to + b - a] = data[a:b]
    return out, at


def _chunks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last block (exclusive) of each chunk, and the offsets of the texts' chunks."""
    blocks = np.diff(at)
    count = np.maximum(1, -(-(blocks - CHUNK) // HOP) + 1)
    of = np.concatenate([[0], np.cumsum(count)])
    k = np.arange(of[-1]) - np.repeat(of[:-1], count)
    start = np.repeat(at[:-1], count) + k * HOP
    return start, np.minimum(start + CHUNK, np.repeat(at[1:], count)), of


@dataclass
class Network:
    vectors: np.ndarray  # (256, DIM)
    low: np.ndarray  # (STRIDE * DIM, FILTERS): the filters' first 4 bytes
    high: np.ndarray  # and last 4
    bias: np.ndarray
    weights: np.ndarray  # (2 * FILTERS,): of mean and maximum
    offset: np.ndarray  # (1,)

    @staticmethod
    def initial(seed: int) -> Network:
        r = np.random.default_rng(seed)
        normal = lambda scale, *shape: r.normal(0, scale, shape).astype(np.float32)
        return Network(normal(0.5, 256, DIM), normal(0.18, STRIDE * DIM, FILTERS), normal(0.18, STRIDE * DIM, FILTERS), np.zeros(FILTERS, np.float32), normal(0.1, 2 * FILTERS), np.zeros(1, np.float32))

    def pooled(self, padded: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedded bytes by position, rectified filter outputs, and their maxima by block.

        At a text's last position the filters see zeros, not the text that follows in the batch."""
        x = self.vectors[padded].reshape(-1, STRIDE * DIM)
        out = x[1:] @ self.high
        out[at[1:] * BLOCK - 1] = np.tile(self.vectors[0], STRIDE) @ self.high
        out += x[:-1] @ self.low
        out += self.bias
        np.maximum(out, 0, out=out)
        return x, out, out.reshape(-1, BLOCK, FILTERS).max(axis=1)

    def features(self, blocks: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        start, end, of = _chunks(at)
        top = np.maximum.reduceat(np.vstack([blocks, np.zeros((1, FILTERS), np.float32)]), np.stack([start, end], 1).ravel(), axis=0)[::2]
        mean = np.add.reduceat(top, of[:-1], axis=0) / np.diff(of)[:, None].astype(np.float32)
        return np.hstack([mean, np.maximum.reduceat(top, of[:-1], axis=0)]), top, start, of

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        padded, at = _layout(data, offsets)
        z = self.features(self.pooled(padded, at)[2], at)[0] @ self.weights + self.offset
        p = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60)))
        return np.where(np.diff(offsets) > 0, p, 0.0)

    def gradients(self, data: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        padded, at = _layout(data, offsets)
        x, out, blocks = self.pooled(padded, at)
        f, top, start, of = self.features(blocks, at)
        dz = ((1 / (1 + np.exp(-np.clip(f @ self.weights + self.offset, -60, 60))) - y) / len(y)).astype(np.float32)
        df = dz[:, None] * self.weights
        count = np.diff(of)
        text = np.repeat(np.arange(len(y)), count)
        dtop = (df[:, :FILTERS] / count[:, None].astype(np.float32))[text]
        best = top == f[:, FILTERS:][text]
        dtop = dtop + best * (df[:, FILTERS:] / np.maximum(1, np.add.reduceat(best, of[:-1], axis=0, dtype=np.int64)).astype(np.float32))[text]
        # The one position that gave each chunk its maximum takes the gradient.
        rows = np.minimum(start[:, None] + np.arange(CHUNK), len(blocks) - 1)
        block = np.take_along_axis(rows, (blocks[rows] == top[:, None, :]).argmax(axis=1), axis=1)
        filters = np.broadcast_to(np.arange(FILTERS), block.shape)
        live = top > 0
        block, filters, g = block[live], filters[live], dtop[live].astype(np.float32)
        position = block * BLOCK + out.reshape(-1, BLOCK, FILTERS)[block, :, filters].argmax(axis=1)
        dlow, dhigh = np.zeros_like(self.low), np.zeros_like(self.high)
        last = np.isin(position, at[1:] * BLOCK - 1)
        after = np.where(last, len(x), position + 1)
        x = np.vstack([x, np.tile(self.vectors[0], STRIDE)])
        order = np.argsort(filters, kind="stable")
        cuts = np.searchsorted(filters[order], np.arange(FILTERS + 1))
        for k in range(FILTERS):
            o = order[cuts[k] : cuts[k + 1]]
            dlow[:, k] = g[o] @ x[position[o]]
            dhigh[:, k] = g[o] @ x[after[o]]
        dvec = np.zeros((256, DIM), np.float32)
        codes = np.vstack([padded.reshape(-1, STRIDE), np.zeros((1, STRIDE), np.uint8)])
        for w, where in ((self.low, position), (self.high, after)):
            each = (g[:, None] * w.T[filters]).reshape(-1, DIM)
            which = codes[where].ravel()
            for d in range(DIM):
                dvec[:, d] += np.bincount(which, each[:, d], 256).astype(np.float32)
        return [dvec, dlow, dhigh, np.bincount(filters, g, FILTERS).astype(np.float32), f.T @ dz, dz.sum(keepdims=True)]


def fit(texts: list[bytes], good: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam on the mean log loss. Without both kinds of label, the network answers by the one it has (good, if none)."""
    net = Network.initial(seed)
    if len(set(good.tolist())) < 2:
        net.weights[:] = 0
        net.offset[:] = 20 if len(good) == 0 or good[0] else -20
        return net
    params = [net.vectors, net.low, net.high, net.bias, net.weights, net.offset]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    r = np.random.default_rng(seed)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + RATE / 20
        order = r.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            held = [texts[i] for i in part]
            grads = net.gradients(np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]), good[part].astype(np.float32))
            step += 1
            for p, g, a1, a2 in zip(params, grads, m, v):
                a1 += 0.1 * (g - a1)
                a2 += 0.01 * (g * g - a2)
                p -= rate * (a1 / (1 - 0.9**step)) / (np.sqrt(a2 / (1 - 0.99**step)) + 1e-6)
    return net


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES, max_total: int = MAX_TOTAL_BYTES) -> Network:
    """Fits on at most ``max_train`` labelled documents, half of them of each quality where there are as many, the first by a hash of doc_id.

    Of these, as many are taken in that order as hold ``max_total`` bytes. Labels of a null doc_id, labels other than 0 and
    1, ids with labels of both kinds, and documents longer than ``max_bytes``, are passed over here (never in scoring); of
    several rows of one doc_id, the least text is taken; repeated labels count once."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    chosen = None
    for quality in (0, 1):
        part = known.where(F.col("quality") == quality).select("doc_id", F.lit(quality).alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train // 2)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where((F.length("text") > 0) & (F.octet_length("text") <= max_bytes)).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # of max_train rows at most
    rows = rows.withColumn("upto", upto).where(F.col("upto") <= max_total).select("doc_id", "quality", "text").collect()
    rows.sort(key=lambda r: (r.doc_id, r.quality, r.text))
    return fit([r.text.encode() for r in rows], np.array([r.quality for r in rows], np.int64))


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, probability double, keep boolean)`` for each row of ``docs(doc_id, text)``, from its whole text.

    A null or empty text has probability 0. Equal texts have equal probabilities, up to rounding. Repeated rows are
    scored each; an empty table gives no rows; other columns are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                p = shared.value.probability(*text_buffers(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array(p >= threshold)], ["doc_id", "probability", "keep"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, probability double, keep boolean")


def keep_good(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the network doesn't reject, with all their columns; it sees each row once.

    Rows with a null or empty text are rejected (probability 0), if ``threshold`` is above 0; repeated rows are judged
    each; an empty table gives no rows. Columns may have any names."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                yield part.filter(pa.array(shared.value.probability(*text_buffers(part.column("text"))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
