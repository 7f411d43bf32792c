"""SentencePiece encoding and decoding with a batched numpy Viterbi search.

Texts split into words before each run of spaces that follows something else; no piece crosses there. Long words are cut
besides between two characters that stand side by side in no piece. A worker keeps the
ids of words it has seen; new words of equal length advance together: hashes of all their substrings probe the
sorted hashes of the pieces, and for each end position a vectorised maximum over the candidates stores the length of the best
last piece as backpointer.

The score of a path depends on the model. For a unigram model it is the sum of the pieces' scores. For a BPE model the
greedy merges decide, which no sum of scores gives; but a segmentation is the one that merging arrives at exactly if each
two neighbours in it would stay apart when merged alone. So a candidate scores 0 where it may follow the best path's last
piece, else minus infinity, and the maximum is the library's result. Hence long words of a BPE model are cut into overlapping chunks,
which advance together: two chunks are joined where both have a boundary and the pieces at it may be neighbours, and the
whole is what the library gives, as all neighbours in it may be.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import U64, documents, mix64, slices, text_buffers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHE_WORDS, CACHED_CHARS, BATCH_CHARS = 400_000, 48, 200_000
LONG, STEP = 768, 512  # characters of a chunk of a longer word, and from one chunk to the next
_MUL = 0x9E3779B97F4A7C15


def substring_names(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes along the last axis: h[j] - h[i] * _MUL^(j - i) names the substring from i to j."""
    names = mix64(codes.astype(U64) + U64(1))
    h = np.zeros((*codes.shape[:-1], codes.shape[-1] + 1), U64)
    for i in range(codes.shape[-1]):
        h[..., i + 1] = h[..., i] * U64(_MUL) + names[..., i]
    return h


def _name(text: str) -> int:
    return int(substring_names(np.array([ord(c) for c in text], np.uint32))[-1])


class SortedKeys:
    """Distinct uint64 keys, scrambled and sorted, with an index by their top bits; many are probed at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = keys * U64(_MUL)
        order = np.argsort(keys)
        self.shift = 64 - max(4, int(len(keys) * 4).bit_length())
        self.keys = np.append(keys[order], U64(2**64 - 1))
        self.values = np.append(values[order], -1)
        self.first = np.searchsorted(self.keys[:-1], np.arange(1 << (64 - self.shift), dtype=U64) << U64(self.shift))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values, -1 for absent ones."""
        keys = keys * U64(_MUL)
        at = self.first[(keys >> U64(self.shift)).view(np.int64)]
        on = np.flatnonzero(self.keys[at] < keys)
        while len(on):
            at[on] += 1
            on = on[self.keys[at[on]] < keys[on]]
        return np.where(self.keys[at] == keys, self.values[at], -1)


@dataclass
class PieceModel:
    """A model as arrays; ``unknown`` stands for a character that is no piece and is written as bytes."""

    kind: str
    ids: SortedKeys  # by the hash of the piece
    longest: int
    score: np.ndarray  # by id
    created: np.ndarray  # by id: the rank of the merge that makes the piece; -1: a single character
    left: np.ndarray  # by id: what its last merge joins
    right: np.ndarray
    pairs: SortedKeys  # left * size + right to the rank of their merge
    byte_ids: np.ndarray | None  # by byte
    unk_id: int
    flat: np.ndarray  # what ids decode to: bytes back to back, and where they begin
    flat_at: np.ndarray
    bigrams: np.ndarray  # sorted: two characters (the first times 2^32) that stand side by side in a piece

    @property
    def unknown(self) -> int:
        return len(self.score) - 1

    @staticmethod
    def build(pieces: list[str], scores: list[float], kind: str, unk_id: int, control: set[int] = frozenset(), byte_at: dict[int, int] | None = None, unused: set[int] = frozenset()) -> PieceModel:
        size = len(pieces) + 1  # and the unknown character
        own = {p: i for i, p in enumerate(pieces) if p and i != unk_id and i not in control and i not in unused and i not in (byte_at or {})}
        created, left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        order = {i: r for r, i in enumerate(sorted(own.values(), key=lambda i: (-scores[i], i)))}
        usable, pairs = dict(own), {}
        if kind == "bpe":
            for p, i in own.items():
                parts, last = list(p), None
                while len(parts) > 1:
                    ranks = [(order[own[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in own]
                    if not ranks:
                        break
                    _, k = min(ranks)
                    last = (parts[k], parts[k + 1])
                    parts[k : k + 2] = [parts[k] + parts[k + 1]]
                if len(parts) > 1:
                    del usable[p]  # merging never arrives at it
                elif last and last[0] in own and last[1] in own:
                    created[i], left[i], right[i] = order[i], own[last[0]], own[last[1]]
                for k in range(1, len(p)):
                    if p[:k] in own and p[k:] in own:
                        pairs[own[p[:k]] * size + own[p[k:]]] = order[i]
        names = np.array([_name(p) for p in usable], U64)
        texts = [b"" if i in control else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        for i, b in (byte_at or {}).items():
            texts[i] = bytes([b])
        texts[unk_id] = " ⁇ ".encode()
        byte_ids = np.array([i for i, _ in sorted(byte_at.items(), key=lambda x: x[1])], np.int32) if byte_at else None
        return PieceModel(kind, SortedKeys(names, np.array(list(usable.values()), np.int64)), max(map(len, usable), default=1), np.array([*scores, min(scores, default=0) - 10.0]), created, left, right, SortedKeys(np.array(list(pairs), U64), np.array(list(pairs.values()), np.int64)), byte_ids, unk_id, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), np.array(sorted({(ord(x) << 32) + ord(y) for p in own for x, y in zip(p, p[1:])}), np.int64))

    @staticmethod
    def load(path: str = MODEL) -> PieceModel:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        pieces = [sp.id_to_piece(i) for i in every]
        byte_at = {i: int(pieces[i][3:5], 16) for i in every if sp.is_byte(i)}
        normal = [sp.get_score(i) for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        # The library hides the model's type; a BPE model's scores are the negative ranks of its merges.
        kind = "bpe" if all(s == int(s) for s in normal) else "unigram"
        return PieceModel.build(pieces, [sp.get_score(i) for i in every], kind, sp.unk_id(), {i for i in every if sp.is_control(i)}, byte_at, {i for i in every if sp.is_unused(i)})

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging a text of the two pieces a, b ends in these two.

        The merges are undone from the last one: as long as the two touching parts have no merge of their own that comes
        before the one undone last, the later made of the two is undone next."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), np.iinfo(np.int64).max)
        size = len(self.score)
        while len(live):
            rank = self.pairs.find((a * size + b).view(U64))
            bad = (rank >= 0) & (rank < limit)
            ok[live[bad]] = False
            ra, rb = self.created[a], self.created[b]
            go = np.flatnonzero(~bad & ((ra >= 0) | (rb >= 0)))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb
            a, b, limit = np.where(first, self.right[a], a), np.where(first, b, self.left[b]), np.where(first, ra, rb + 1)
        return ok

    def segment(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids ending at each position and their lengths, on the best path of each prefix of equally long words."""
        count, n = words.shape
        h = substring_names(words)
        longest = min(self.longest, n)
        table_ = np.full((longest, count, n), -1, np.int32)  # [length - 1, word, end - 1]
        power = 1
        for k in range(longest):
            power = power * _MUL % (1 << 64)
            table_[k, :, k:] = self.ids.find((h[:, k + 1 :] - h[:, : n - k] * U64(power)).ravel()).reshape(count, n - k)
        table_[0][table_[0] < 0] = self.unknown
        last, back = np.full((count, n + 1), -1, np.int64), np.ones((count, n + 1), np.int64)
        best = np.full((count, n + 1), -np.inf)
        best[:, 0] = 0
        for end in range(1, n + 1):
            most = min(longest, end)
            t = table_[:most, :, end - 1]
            k, w = np.nonzero(t >= 0)
            piece = t[k, w].astype(np.int64)
            before = end - 1 - k
            score = best[w, before]
            if self.kind == "bpe":
                prior = last[w, before]
                check = np.flatnonzero(prior >= 0)
                good = np.ones(len(k), bool)
                good[check] = self.apart(prior[check], piece[check])
                score = np.where(good, score, -np.inf)
            else:
                score = score + self.score[piece]
            grid = np.full((most, count), -np.inf)
            grid[k, w] = score
            choice = grid.argmax(axis=0)
            every = np.arange(count)
            best[:, end], last[:, end], back[:, end] = grid[choice, every], t[choice, every], choice + 1
        return last, back

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word as little-endian int32."""
        cuts = {w: parts for w in words if len(w) > CACHED_CHARS and len(parts := self._cut(w)) > 1}
        short = {p for w in words for p in cuts.get(w, (w,))} if cuts else set(words)
        out: dict[str, bytes] = {}
        by: dict[int, list[str]] = {}
        for w in short:
            if len(w) > LONG and self.kind == "bpe":
                out[w] = self._stitched(w)
            else:
                by.setdefault(len(w), []).append(w)
        for n, same in by.items():
            step = max(1, BATCH_CHARS // n)
            for at in range(0, len(same), step):
                part = same[at : at + step]
                ids = self._paths(np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).reshape(len(part), n))
                hard = (ids == self.unknown).any(axis=1)
                flat = ids[ids >= 0].astype("<i4").tobytes()
                ends = np.cumsum((ids >= 0).sum(axis=1) * 4).tolist()
                out.update(zip(part, (flat[a:b] for a, b in zip([0, *ends], ends))))
                for k in np.flatnonzero(hard).tolist():
                    out[part[k]] = self._with_bytes(part[k], ids[k][ids[k] >= 0])
        for w, parts in cuts.items():
            out[w] = b"".join(map(out.__getitem__, parts))
        return out

    def _paths(self, codes: np.ndarray) -> np.ndarray:
        """Ids of the best path of each of equally long words, -1 before the first; single ASCII characters that are no piece as bytes."""
        last, back = self.segment(codes)
        # All words step back together from their ends.
        end, every, path = np.full(len(codes), codes.shape[1]), np.arange(len(codes)), []
        while (end > 0).any():
            i = np.where(end > 0, last[every, end], -1)
            if self.byte_ids is not None:
                code = codes[every, end - 1]
                one = np.flatnonzero((i == self.unknown) & (code < 128))
                i[one] = self.byte_ids[code[one]]
            path.append(i)
            end = np.where(end > 0, end - back[every, end], 0)
        return np.array(path[::-1]).T

    def _cut(self, word: str) -> list[str]:
        """Parts that no piece crosses; two characters in a row that may both be unknown stay together where they'd be one unknown."""
        codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
        both = (codes[:-1] << 32) + codes[1:]
        at = np.minimum(np.searchsorted(self.bigrams, both), max(0, len(self.bigrams) - 1))
        free = self.bigrams[at] != both if len(self.bigrams) else np.ones(len(both), bool)
        if self.byte_ids is None:
            single = self.ids.find(substring_names(codes[:, None].astype(np.uint32))[:, 1]) < 0
            free &= ~(single[:-1] & single[1:])
        cuts = [0, *(np.flatnonzero(free) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def _stitched(self, word: str) -> bytes:
        """A long word by overlapping chunks that advance together; by itself, if two of them can't be joined."""
        codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        n = len(codes)
        starts = [*range(0, n - LONG, STEP), n - LONG]
        ids: list[int] = []
        ends: list[int] = []
        step = max(1, BATCH_CHARS // LONG)
        for k in range(0, len(starts), step):
            last, back = self.segment(np.stack([codes[a : a + LONG] for a in starts[k : k + step]]))
            for row, start in enumerate(starts[k : k + step]):
                own, at, end = [], [], LONG
                while end > 0:
                    own.append(int(last[row, end]))
                    at.append(start + end)
                    end -= int(back[row, end])
                own, at = own[::-1], at[::-1]
                if not ids:
                    ids, ends = own, at
                    continue
                begin = {a: j + 1 for j, a in enumerate(at[:-1])}  # the piece that begins there
                shared = [(i, begin[e]) for i, e in enumerate(ends) if e in begin]
                shared.sort(key=lambda p: abs(2 * ends[p[0]] - start - ends[-1]))
                if shared:
                    a, b = np.array([ids[i] for i, _ in shared]), np.array([own[j] for _, j in shared])
                    fine = np.flatnonzero(self.apart(a, b))
                if not shared or not len(fine):
                    path = self._paths(codes[None])[0]
                    return self._with_bytes(word, path[path >= 0])
                i, j = shared[fine[0]]
                ids[i + 1 :], ends[i + 1 :] = own[j:], at[j:]
        if self.byte_ids is not None:
            ids = [int(self.byte_ids[codes[e - 1]]) if i == self.unknown and codes[e - 1] < 128 else i for i, e in zip(ids, ends)]
        return self._with_bytes(word, np.array(ids)) if self.unknown in ids else np.array(ids, "<i4").tobytes()

    def _with_bytes(self, word: str, row: np.ndarray) -> bytes:
        ids, at = [], 0
        ascii_ids = set(self.byte_ids[:128].tolist()) if self.byte_ids is not None else set()
        for i in row.tolist():
            if i in ascii_ids:
                ids.append(i)
                at += 1
            elif i != self.unknown:
                piece = self.flat[self.flat_at[i] : self.flat_at[i + 1]].tobytes().decode()
                ids.append(i)
                at += len(piece)
            else:
                if self.byte_ids is not None:
                    ids.extend(self.byte_ids[list(word[at].encode())].tolist())
                elif not ids or ids[-1] != self.unk_id:
                    ids.append(self.unk_id)  # a run of unknown characters is one unknown piece
                at += 1
        return np.array(ids, "<i4").tobytes()

    def decode_bytes(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts of runs of ids, as bytes back to back and offsets, without each one's first space."""
        width = np.diff(self.flat_at)[ids]
        ends = np.concatenate([[0], np.cumsum(width)])
        where = np.repeat(self.flat_at[ids] - ends[:-1], width) + np.arange(ends[-1])
        data, at = self.flat[where], ends[offsets]
        full = at[1:] > at[:-1]
        first = at[:-1][full]
        first = first[data[first] == 32]
        keep = np.ones(len(data), bool)
        keep[first] = False
        return data[keep], np.concatenate([[0], np.cumsum(keep)])[at]


class Encoder:
    """A worker's encoder: the model and the ids of words it has met."""

    word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def __init__(self, model: PieceModel):
        self.model, self.known, self.again = model, {}, set()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts back to back, and offsets."""
        split = [self.word.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        here = set().union(*split)
        new = here.difference(self.known)
        seen = here - new
        self.again |= seen
        if len(self.known) + len(new) > CACHE_WORDS:  # words met again stay
            stay = self.again if len(self.again) <= CACHE_WORDS // 2 else seen
            self.known = {w: self.known[w] for w in stay}
            self.again = set()
        self.known |= self.model.encode_words(list(new))
        get = self.known.__getitem__
        parts = [b"".join(map(get, s)) for s in split]
        for w in new:
            if len(w) > CACHED_CHARS:
                del self.known[w]
        return np.frombuffer(b"".join(parts), "<i4"), np.cumsum([0, *(len(p) // 4 for p in parts)])


def encode(docs: DataFrame, path: str = MODEL, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *keep, ids array<int>, n_tokens int, round_trip boolean)`` for each row of ``docs(doc_id, text)``.

    ``ids`` equals the library's encoding of the whole text, for a model that neither normalises (NFKC, runs of spaces) nor
    has pieces of the user's own, as the one at ``MODEL``. ``round_trip``: decoding the ids gives the text back, which
    fails only for texts that hold the space mark U+2581 itself, as the model can't tell it from a space. A null text has
    null results, an empty text no ids; repeated rows are encoded each; an empty table gives no rows. Other columns are
    left out."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(PieceModel.load(path))
    chosen = docs.select("doc_id", *keep, F.col("text").cast("string").alias("__text"))
    fields = [f for f in chosen.schema.fields if f.name != "__text"]
    schema = T.StructType([*fields, *T._parse_datatype_string("ids array<int>, n_tokens int, round_trip boolean").fields])
    names = [*(f.name for f in fields), "ids", "n_tokens", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            for part in slices(batch, "__text"):
                column = part.column("__text")
                ids, at = encoder.encode([t or "" for t in column.to_pylist()])
                data, off = text_buffers(column)
                back, back_at = encoder.model.decode_bytes(ids, at)
                same = np.diff(off) == np.diff(back_at)
                if same.all() and np.array_equal(data, back):
                    ok = same
                else:
                    ok = np.array([np.array_equal(data[a:b], back[c:d]) for a, b, c, d in zip(off, off[1:], back_at, back_at[1:])], bool)
                null = np.asarray(column.is_null())
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32), mask=np.append(null, False)) if null.any() else pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), lists, pa.array(np.diff(at).astype(np.int32), mask=null), pa.array(ok, mask=null)], names)

    return chosen.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str = MODEL) -> DataFrame:
    """``(doc_id, text)`` out of ``tokens(doc_id, ids)``: bytes that are not UTF-8 become U+FFFD; ids out of range and
    null ids are passed over; null ids arrays give null, empty ones an empty text. doc_id may be of any type; repeated rows
    are decoded each; other columns are left out."""
    model = tokens.sparkSession.sparkContext.broadcast(PieceModel.load(path))
    chosen = tokens.select("doc_id", F.col("ids").cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                if not ids.is_valid:
                    texts.append(None)
                    continue
                x = np.array([i for i in ids.as_py() if i is not None and 0 <= i < m.unknown], np.int64)
                texts.append(m.decode_bytes(x, np.array([0, len(x)]))[0].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return chosen.mapInArrow(run, T.StructType([chosen.schema["doc_id"], T.StructField("text", T.StringType())]))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir))
