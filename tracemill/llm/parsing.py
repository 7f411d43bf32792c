"""Document fingerprints by locally consistent parsing.

A text is a sequence of bytes. On each level runs of equal symbols become one symbol; deterministic coin tossing turns
the rest into small labels (twice the lowest bit in which a symbol differs from the one before, plus that bit, until six
labels are left), and phrases begin where a label is greater than both its neighbours. A phrase's name is a hash of the
symbols in it, and the names are the symbols of the next level. Where phrases begin depends on a few symbols around, so
equal substrings get the same phrase names but for some at their two ends, wherever in a text they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import U64, documents, mix64, slices, text_buffers

LEVEL = 4
_R = U64(0x9FB21C651E98DF25)
MARGIN = 5  # labels look at 4 symbols to the left at most, landmarks at one more to each side


def _toss_table(bits: int) -> np.ndarray:
    """Labels of all pairs (before, here) of unequal symbols below 2 ** bits."""
    n = 1 << bits
    differ = np.arange(n)[:, None] ^ np.arange(n)[None, :]
    low = np.where(differ == 0, 0, np.log2(np.maximum(differ & -differ, 1))).astype(np.int64)
    return (2 * low + ((np.arange(n)[None, :] >> low) & 1)).astype(np.uint8)


_TOSS4, _TOSS3 = _toss_table(4).ravel(), _toss_table(3).ravel()
_TOSS7 = _toss_table(7).ravel()
_BYTE_NAMES = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _before(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each symbol's predecessor; at the beginning of a text, the symbol with its lowest bit flipped."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first] = x[first] ^ x.dtype.type(1)
    return out


def labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 5, unequal for neighbours, of symbols (uint8 or uint64) that are unequal to their neighbours."""
    if symbols.dtype == np.uint8:
        a = _before(symbols, first)
        differ = a ^ symbols
        low = _LOW8[differ]
        out = 2 * low + (symbols >> low & np.uint8(1))
    else:
        differ = _before(symbols, first) ^ symbols
        only = differ & (~differ + U64(1))
        low = (only.astype(np.float64).view(np.int64) >> 52) - 1023  # exact: a power of two
        out = (2 * low + (symbols >> low.view(U64) & U64(1)).view(np.int64)).astype(np.uint8)
        out = _TOSS7[_before(out, first).astype(np.uint16) * np.uint16(128) + out]
    out = _TOSS4[_before(out, first) * np.uint8(16) + out]
    return _TOSS3[_before(out, first) * np.uint8(8) + out]


_LOW8 = np.array([0, *((x & -x).bit_length() - 1 for x in range(1, 256))], np.uint8)


def level(symbols: np.ndarray, offsets: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the phrases of each text, the texts' offsets among them, and where (in bytes) phrases begin."""
    n = len(symbols)
    if not n:
        return np.zeros(0, U64), offsets, begins
    first = np.zeros(n, bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    # Runs of equal symbols.
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new |= first
    at = np.flatnonzero(new)
    run = np.diff(at, append=n)
    one, head = symbols[at], np.flatnonzero(first[at])
    lab = labels(one, head)
    mark = np.zeros(len(one), bool)
    mark[1:-1] = (lab[1:-1] > lab[:-2]) & (lab[1:-1] > lab[2:])
    mark[head] = True
    tail = head[1:] - 1  # a text's last symbol has no right neighbour and begins no phrase
    mark[tail[tail > 0]] = False
    mark[head] = True
    names = _BYTE_NAMES[one] if one.dtype == np.uint8 else one
    long = np.flatnonzero(run > 1)
    if len(long):
        names = names.copy()
        names[long] = mix64(names[long] + run[long].astype(U64) * _R)
    cut = np.flatnonzero(mark)
    within = np.arange(len(one)) - np.repeat(cut, np.diff(cut, append=len(one)))
    power = np.ones(int(within.max()) + 1, U64)
    power[1:] = _R
    power = np.multiply.accumulate(power)
    out = mix64(np.add.reduceat(mix64(names) * power[within], cut) + U64(1))
    return out, np.searchsorted(at[cut], offsets), begins[at[cut]]


def fingerprints(data: np.ndarray, offsets: np.ndarray, depth: int = LEVEL) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names on level ``depth`` of all texts, the texts' offsets among them, the bytes where they begin (in their text), and one name for each whole text (0 if it is empty)."""
    symbols, off, begins = data, offsets, np.arange(len(data))
    kept, depths, whole = None, 0, np.zeros(len(offsets) - 1, U64)
    while True:
        if depths == depth:
            kept = symbols, off, begins - np.repeat(offsets[:-1], np.diff(off))
        count = np.diff(off)
        if depths:  # the first name that a text has alone, with its level
            done = np.flatnonzero((count == 1) & (whole == 0))
            whole[done] = mix64(symbols[off[:-1][done]] + U64(depths))
        if depths >= depth and (count <= 1).all():
            break
        symbols, off, begins = level(symbols, off, begins)
        depths += 1
    return *kept, whole


def document_fingerprints(docs: DataFrame, depth: int = LEVEL) -> DataFrame:
    """``(doc_id, n_bytes bigint, whole bigint, signatures array<bigint>, starts array<int>)`` for each row of ``docs(doc_id, text)``.

    ``whole`` names the whole text and is equal for equal texts. ``signatures`` are the names of the phrases on level
    ``depth`` in the order of the text, ``starts`` the bytes where they begin. A null text has nulls; an empty text has
    no signatures and the name 0. Repeated rows have equal results; an empty table gives no rows; other columns are left
    out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                column = part.column("text")
                data, offsets = text_buffers(column)
                names, off, starts, whole = fingerprints(data, offsets, depth)
                null = np.asarray(column.is_null())
                at = pa.array(off.astype(np.int32), mask=np.append(null, False)) if null.any() else pa.array(off.astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets), mask=null), pa.array(whole.view(np.int64), mask=null), pa.ListArray.from_arrays(at, pa.array(names.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(starts.astype(np.int32)))], ["doc_id", "n_bytes", "whole", "signatures", "starts"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_bytes bigint, whole bigint, signatures array<bigint>, starts array<int>")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(documents(spark, sf_dir))
