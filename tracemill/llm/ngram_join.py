"""N-gram Jaccard self-join by prefixes, and by matrices or prefix trees of sets.

All pairs of documents whose sets of word n-grams have a Jaccard similarity of at least ``threshold``, exactly.

1. Each document emits, of its sorted gram hashes, those in the lowest ``share`` of the hash space, and at least its
   Jaccard prefix (|x| - ceil(t |x|) + 1). Emitted grams are exchanged by gram as packed arrays, which gives document
   frequencies over all documents.
2. In the global order (document frequency, hash) a gram that no other document has can't produce a pair, but takes a
   place in the prefix. A document all of whose prefix is taken by such grams has no partner and leaves here.
3. Of the others, those with equal sets collapse to the least doc_id, and the same is done with all their grams: this
   leaves documents most of whose grams occur elsewhere, each with the rest of its prefix. Documents that share a gram
   there are connected; pairs lie inside the connected components, and inside the groups of one gram.
4. A component is one unit of work if that is cheap. One so large that all its blocks would have to be compared is left
   to its prefix grams, each a unit, if shipping its documents once a gram costs less; so documents that only hang together
   over many links aren't compared all with all. Units beyond ``block`` grams are cut by length and hash.
5. Links and classes (``document_links``, ``first_of_groups``) come of overlaps counted by tiles of a block, of which each
   document keeps its number of links and a root only.
   A list of pairs (``similar_pairs``) comes of tries: each block is stored in a trie of its sets in one order for all (by frequency in the block), compressed to its
   branchings. Every set walks the trie level by level; sets below a node share the overlap counted on the way to it, and
   a subtree is pruned when the lengths that remain can't reach the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from tracemill.llm.common import LINKS, U64, Links, checked, class_links, connected_components, cut, documents, expanded, groups, mix64, ngram_hashes, partitions, slices, text_buffers

N, THRESHOLD, SHARE, BLOCK, FLUSH = 3, 0.6, 0.55, 400_000, 3_000_000
TILE, SPARSE, CHUNK = 1024, 200, 1 << 21
_PACK = "key int, kind int, blob binary"
KEYS = ["by_gram", "unit", "one", "two"]


def prefix_length(size: int, threshold: float) -> int:
    return size - math.ceil(threshold * size - 1e-9) + 1


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal rank side by side: high bytes that hardly change then compress away in the exchange."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(data: pa.Buffer, kind: np.dtype, n: int, at: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel()


def _pack(key: np.ndarray, kind: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each key: the columns' entries of that key, back to back; the columns are sorted by key here."""
    if len(key) and not (key[1:] >= key[:-1]).all():
        order = np.argsort(key, kind="stable")
        key, columns = key[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(key)).tolist()
    blobs = [b"".join(_planes(c[a:b]) for c in columns) for a, b in zip(cuts.tolist(), ends)]
    return pa.RecordBatch.from_arrays([pa.array(key[cuts].astype(np.int32)), pa.array(np.full(len(blobs), kind, np.int32)), pa.array(blobs, pa.binary())], ["key", "kind", "blob"])


def _unpack(t: pa.Table, kind: int, types: list) -> list[np.ndarray]:
    width = sum(np.dtype(x).itemsize for x in types)
    out: list[list[np.ndarray]] = [[] for _ in types]
    for k, blob in zip(t["kind"].to_pylist(), t["blob"]):
        if k == kind:
            data = blob.as_buffer()
            n, at = len(data) // width, 0
            for o, x in zip(out, types):
                o.append(_from_planes(data, x, n, at))
                at += n * np.dtype(x).itemsize
    return [np.concatenate(o) if o else np.zeros(0, x) for o, x in zip(out, types)]


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(doc.view(U64)) >> U64(32)).astype(np.int64) * buckets >> 32


def _emit(sets_of, threshold: float, share: float, buckets: int):
    """Packs the emitted grams by gram (kind 0), and each document's number of grams beyond its prefix (kind 1)."""
    low = min(int(share * 2.0**64), 2**64 - 1)

    def flush(grams: list, docs: list, counts: list, slack: list) -> Iterator[pa.RecordBatch]:
        ids = np.array(docs, np.int64)
        g = np.concatenate(grams)
        order = np.argsort(g)
        g = g[order]
        yield _pack(((g >> U64(32)).astype(np.int64) * buckets) >> 32, 0, [g, np.repeat(ids, counts)[order]])
        yield _pack(_doc_bucket(ids, buckets), 1, [ids, np.array(slack, np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, docs, counts, slack, held = [], [], [], [], 0
        for doc, g in sets_of(batches):
            if len(g):
                p = prefix_length(len(g), threshold)
                e = max(p, int(np.searchsorted(g, U64(low), side="right")))
                grams.append(g[:e].copy())
                docs.append(doc)
                counts.append(e)
                slack.append(e - p)
                held += e
                if held >= FLUSH:
                    yield from flush(grams, docs, counts, slack)
                    grams, docs, counts, slack, held = [], [], [], [], 0
        if held:
            yield from flush(grams, docs, counts, slack)

    return run


def _text_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "text"):
                yield from zip(part.column("doc_id").to_pylist(), ngram_hashes(*text_buffers(part.column("text")), n))

    return run


def _stored_sets(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for doc, g in zip(batch.column("doc").to_pylist(), batch.column("grams")):
            yield doc, np.frombuffer(g.as_buffer(), np.uint64)


def _shared_grams(buckets: int, named: bool):
    """An entry for each gram and document, if at least two documents have the gram; by document.

    ``named``: with the gram's frequency and a name of its set of documents. Grams of the same documents need no telling
    apart: in the prefixes of two documents they take the same places."""

    def flush(held: list) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held)]
        return _pack(_doc_bucket(columns[0], buckets), 0, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for t in groups(batches, ["key"]):
            yield from t.filter(pc.equal(t["kind"], 1)).to_batches()
            g, doc = _unpack(t, 0, [np.uint64, np.int64])
            if len(g):
                order = np.argsort(g, kind="stable")
                g, doc = g[order], doc[order]
                cuts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                df = np.diff(np.append(cuts, len(g)))
                keep = np.repeat(df > 1, df)
                if keep.any():
                    names = (np.repeat(df, df)[keep].astype(np.uint32), np.repeat(mix64(np.add.reduceat(mix64(doc.view(U64)), cuts)), df)[keep]) if named else ()
                    held.append((doc[keep], *names))
            if sum(len(h[0]) for h in held) >= FLUSH:
                yield flush(held)
                held = []
        if held:
            yield flush(held)

    return run


def _partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents whose prefix isn't taken by grams that no other document has."""
    for t in groups(batches, ["key"]):
        (doc,) = _unpack(t, 0, [np.int64])
        ids, slack = _unpack(t, 1, [np.int64, np.int64])
        doc, count = np.unique(doc, return_counts=True)
        order = np.argsort(ids, kind="stable")
        live = count > slack[order][np.searchsorted(ids[order], doc)] if len(doc) else np.zeros(0, bool)
        if live.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[live])], ["doc_id"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of documents that share a gram in each one's prefix, of the documents that have any such gram."""
    for t in groups(batches, ["key"]):
        doc, df, name = _unpack(t, 0, [np.int64, np.uint32, np.uint64])
        ids, slack = _unpack(t, 1, [np.int64, np.int64])
        if not len(doc):
            continue
        order = np.argsort(ids, kind="stable")
        ids, slack = ids[order], slack[order]
        order = np.lexsort((name, df, doc))
        doc, name = doc[order], name[order]
        cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        count = np.diff(np.append(cuts, len(doc)))
        live = count - slack[np.searchsorted(ids, doc[cuts])]
        within = np.arange(len(doc)) - np.repeat(cuts, count)
        keep = within < np.repeat(live, count)
        keep[1:] &= (within[1:] == 0) | (name[1:] != name[:-1])
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(name[keep].view(np.int64)), pa.array(doc[keep])], ["gram", "doc"])


class Trie:
    """Sets of ordered token numbers, stored in a trie whose unbranched chains are single nodes, in breadth-first order."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        rows = [sets[i] for i in order]
        lens = np.array([len(r) for r in rows], np.int64)
        common = [0]
        for a, b in zip(rows, rows[1:]):
            m = min(len(a), len(b))
            d = np.flatnonzero(a[:m] != b[:m])
            common.append(int(d[0]) if len(d) else m)
        common_at = np.array(common)
        self.order, self.lens = np.array(order), lens
        parent, depth, low, high, tokens, child0, child1, own0, own1, edge = [0], [0], [0], [0], [], [], [], [], [], [0]
        todo = [(0, len(rows), 0)]
        at = 0
        while at < len(todo):
            a, b, d = todo[at]
            child0.append(len(todo))
            own0.append(a)
            while a < b and lens[a] == d:
                a += 1
            own1.append(a)
            if a < b:
                cuts = [a, *(np.flatnonzero(common_at[a + 1 : b] <= d) + a + 1).tolist(), b]
                for x, y in zip(cuts, cuts[1:]):
                    end = int(lens[x]) if y - x == 1 else min(int(common_at[x + 1 : y].min()), int(lens[x:y].min()))
                    tokens.append(rows[x][d:end])
                    edge.append(edge[-1] + end - d)
                    parent.append(at)
                    depth.append(end)
                    low.append(int(lens[x:y].min()))
                    high.append(int(lens[x:y].max()))
                    todo.append((x, y, end))
            child1.append(len(todo))
            at += 1
        self.tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.uint32)
        self.edge = np.array([0, *edge])
        self.depth, self.low, self.high, self.child0, self.child1, self.own0, self.own1 = (np.array(x) for x in (depth, low, high, child0, child1, own0, own1))
        last = np.concatenate([[0], self.tokens[self.edge[2:] - 1]]) if len(self.depth) > 1 else np.zeros(1, np.int64)
        self.last = last.astype(np.int64)

    @staticmethod
    def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))

    def search(self, x: np.ndarray, member: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(sets, overlaps) with a Jaccard of at least the threshold to x; member: a False for each token, left so."""
        member[x] = True
        size, rate = len(x), threshold / (1 + threshold)
        nodes, shared = np.zeros(1, np.int64), np.zeros(1, np.int64)
        found, overlap = [], []
        while len(nodes):
            count = self.child1[nodes] - self.child0[nodes]
            shared = np.repeat(shared, count)
            nodes = self._ranges(self.child0[nodes], count)
            fit = (self.high[nodes] >= threshold * size - 1e-9) & (threshold * self.low[nodes] <= size + 1e-9)
            nodes, shared = nodes[fit], shared[fit]
            if not len(nodes):
                break
            width = self.edge[nodes + 1] - self.edge[nodes]
            hits = member[self.tokens[self._ranges(self.edge[nodes], width)]]
            shared = shared + np.add.reduceat(hits, np.cumsum(width) - width, dtype=np.int64)
            rest = size - np.searchsorted(x, self.last[nodes], side="right")
            best = np.minimum(self.high[nodes], np.maximum(self.low[nodes], self.depth[nodes] + rest))
            fit = shared + np.minimum(rest, best - self.depth[nodes]) >= rate * (size + best) - 1e-6
            nodes, shared = nodes[fit], shared[fit]
            count = self.own1[nodes] - self.own0[nodes]
            if count.any():
                each, own = np.repeat(shared, count), self._ranges(self.own0[nodes], count)
                ok = each / (size + self.lens[own] - each) >= threshold
                found.append(self.order[own[ok]])
                overlap.append(each[ok])
        member[x] = False
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found), np.concatenate(overlap)


def trie_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> list[tuple[int, int, float]]:
    """(i, j, jaccard) of sorted distinct uint64 sets: within ``left`` (i < j), or between it and ``right``."""
    every = left + (right or [])
    if not every:
        return []
    values, inverse, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.uint32)
    rank[np.lexsort((values, -count))] = np.arange(len(values), dtype=np.uint32)
    numbers = rank[inverse]
    cuts = np.cumsum([len(s) for s in every])[:-1]
    sets = [np.sort(s) for s in np.split(numbers, cuts)]
    store, walk = (sets, sets) if right is None else (sets[: len(left)], sets[len(left) :])
    trie, member, out = Trie(store), np.zeros(len(values), bool), []
    for j, x in enumerate(walk):
        for i, o in zip(*(v.tolist() for v in trie.search(x, member, threshold))):
            if right is not None or i < j:
                out.append((i, j, o / (len(x) + len(store[i]) - o)))
    return out


def _join_blocks(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, KEYS):
            one, two = t["one"][0].as_py(), t["two"][0].as_py()
            ids, block = t["doc"].to_numpy(), t["block"].to_numpy()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["grams"]]
            if one == two:
                a = b = ids
                found = trie_pairs(sets, None, threshold)
            else:
                a, b = ids[block == one], ids[block != one]
                found = trie_pairs([s for s, k in zip(sets, block) if k == one], [s for s, k in zip(sets, block) if k != one], threshold)
            if found:
                i, j, similarity = (np.array(x) for x in zip(*found))
                x, y = a[i], b[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(similarity)], ["doc_a", "doc_b", "jaccard"])

    return run


class Overlaps:
    """Sizes of the intersections of sets, a tile of ``TILE`` times ``TILE`` sets at a time: within ``left``, or between it and ``right``.

    Tokens of many sets are columns of a matrix, whose product counts them; of the others, each pair of sets is counted one by
    one. A token is of the first kind if its pairs are more than one in ``SPARSE`` of all."""

    def __init__(self, left: list[np.ndarray], right: list[np.ndarray] | None):
        sides = [left] if right is None else [left, right]
        sizes = [np.array([len(x) for x in side], np.int64) for side in sides]
        tokens = np.unique(np.concatenate([x for side in sides for x in side]), return_inverse=True)[1]
        owner = [np.repeat(np.arange(len(n)), n) for n in sizes]
        own = np.split(tokens, [len(owner[0])])[: len(sides)]
        df = [np.bincount(x, minlength=int(tokens.max(initial=-1)) + 1) for x in own]
        pairs = df[0] * (df[0] - 1) if right is None else df[0] * df[1]
        every = len(left) * len(sides[-1])
        dense = (pairs > 0) & ((pairs * SPARSE > every) | (every <= 4096))
        number = np.cumsum(dense) - 1
        self.dense, self.sparse = [], []
        for x, at, side in zip(own, owner, sides):
            m = np.zeros((len(side), int(dense.sum())), np.float32)
            d = dense[x]
            m[at[d], number[x[d]]] = 1
            self.dense.append(m)
            rare = ~d & (pairs[x] > 0)
            x, at = x[rare], at[rare]
            order = np.lexsort((x, at // TILE))
            x, at = x[order], at[order]
            cuts = np.searchsorted(at // TILE, np.arange(-(-len(side) // TILE) + 1))
            self.sparse.append([(x[a:b], at[a:b] % TILE) for a, b in zip(cuts, cuts[1:])])

    def tile(self, a: int, b: int) -> np.ndarray:
        left, right = self.dense[0][a * TILE : (a + 1) * TILE], self.dense[-1][b * TILE : (b + 1) * TILE]
        out = left @ right.T
        (x, i), (y, j) = self.sparse[0][a], self.sparse[-1][b]
        start = np.searchsorted(y, x)
        count = np.searchsorted(y, x, side="right") - start
        some = count > 0
        i, start, count = i[some], start[some], count[some]
        ends = np.cumsum(count)
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1:].sum(), CHUNK)), len(count)))
        for p, q in zip(cuts, cuts[1:]):
            cell = np.repeat(i[p:q] * len(right), count[p:q]) + j[Trie._ranges(start[p:q], count[p:q])]
            out += np.bincount(cell, minlength=out.size).reshape(out.shape)
        return out


def near_tiles(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float, seen: list[list[np.ndarray]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (i, j) of all pairs with a Jaccard of at least the threshold, by tiles: within ``left`` (i < j), or between it and ``right``.

    ``seen``: another set for each one in the same order; pairs that share any of those are left out."""
    two = left if right is None else right
    if not left or not two:
        return
    m, n = (np.array([len(x) for x in side], np.float64) for side in (left, two))
    overlaps = Overlaps(left, right)
    others = Overlaps(seen[0], None if right is None else seen[1]) if seen else None
    rate = threshold / (1 + threshold)
    for a in range(-(-len(left) // TILE)):
        for b in range(a if right is None else 0, -(-len(two) // TILE)):
            p, q = a * TILE, b * TILE
            shared = overlaps.tile(a, b)
            least = (rate * m[p : p + TILE, None]).astype(np.float32) + (rate * n[None, q : q + TILE] - 0.1).astype(np.float32)
            i, j = np.nonzero(shared >= least)
            o = shared[i, j].astype(np.float64)
            ok = o / (m[p + i] + n[q + j] - o) >= threshold
            if right is None and a == b:
                ok &= i < j
            if others is not None and ok.any():
                ok &= others.tile(a, b)[i, j] == 0
            if ok.any():
                yield p + i[ok], q + j[ok]


def _link_blocks(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, KEYS):
            one, two, unit = t["one"][0].as_py(), t["two"][0].as_py(), t["unit"][0].as_py()
            # Of two blocks, the sets of the first come first.
            block = t["block"].to_numpy()
            order = np.argsort(block != one, kind="stable")
            t, at = t.take(pa.array(order)), int((block == one).sum())
            split = (lambda x: [x]) if one == two else (lambda x: [x[:at], x[at:]])
            left, right = [*split([np.frombuffer(x.as_buffer(), np.uint64) for x in t["grams"]]), None][:2]
            seen = None
            if t["by_gram"][0].as_py():  # a pair counts in the first unit that both are in
                seen = split([u[u < unit] for u in (np.array(x, np.int64) for x in t["units"].to_pylist())])
            links = Links(t["doc"].to_numpy(), t["weight"].to_numpy(), t["mixed"].to_numpy(zero_copy_only=False))
            for i, j in near_tiles(left, right, threshold, seen):
                links.add(i, j if right is None else at + j)
            yield from links.rows()

    return run


def _sets(n: int):
    """Sets, their sizes, and two sums over differently mixed grams: equal for equal sets only, but for 128-bit collisions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(ngram_hashes(*text_buffers(part.column("text")), n))
                one = np.array([mix64(s).sum(dtype=U64) for s in sets], U64).view(np.int64)
                two = np.array([mix64(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64) for s in sets], U64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(one), pa.array(two), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "sig1", "sig2", "size", "grams"])

    return run


def _exchange(emitted: DataFrame, named: bool, last, schema: str) -> DataFrame:
    """Emitted grams by gram, then what is shared of them by document."""
    parts = partitions(emitted.sparkSession)
    shared = emitted.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_shared_grams(_buckets(parts), named), _PACK)
    return shared.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(last, schema)


def _buckets(parts: int) -> int:
    return max(64, 4 * parts)


def _units(entries: DataFrame, sizes: DataFrame, block: int) -> tuple[DataFrame, bool]:
    """``(by_gram, unit, doc, size)`` out of ``entries(gram, doc)`` and ``sizes(doc, size)``, and whether any unit is a gram.

    The cost of a unit is the grams shipped for it: its documents' sets, once for each of its blocks."""
    edges = entries.withColumn("first", F.min("doc").over(Window.partitionBy("gram"))).where("doc <> first").select(F.col("doc").alias("src"), F.col("first").alias("dst"))
    members = cut(connected_components(edges).select(F.col("node").alias("doc"), "component").join(sizes, "doc"))
    blocks = F.ceil(F.col("total") / block)
    large = cut(members.groupBy("component").agg(F.sum("size").alias("total")).where(F.col("total") > block).select("component", (F.col("total") * blocks).alias("whole")))
    plain = members.select(F.lit(False).alias("by_gram"), F.col("component").alias("unit"), "doc", "size")
    if large.isEmpty():
        return plain, False
    within = cut(entries.join(members.join(checked(large.select("component")), "component"), "doc"))
    grams = within.groupBy("gram").agg(F.sum("size").alias("total"), F.count("*").alias("docs")).where("docs > 1").select("gram", blocks.alias("blocks"))
    shipped = within.join(grams, "gram").groupBy("component").agg(F.sum(F.col("size") * F.col("blocks")).alias("shipped"))
    chosen = cut(shipped.join(large, "component").where("shipped < whole").select("component"))
    if chosen.isEmpty():
        return plain, False
    chosen = checked(chosen)
    by_gram = within.join(grams.select("gram"), "gram").join(chosen, "component").select(F.lit(True).alias("by_gram"), F.col("gram").alias("unit"), "doc", "size")
    return plain.join(chosen, F.col("unit") == F.col("component"), "left_anti").union(by_gram), True


def _placed(units: DataFrame, threshold: float, block: int) -> DataFrame:
    """``(doc, block, *KEYS)``: each document of a unit, for each pair of the unit's blocks that its block is in.

    A unit's blocks hold documents of one range of sizes each, and about ``block`` grams; only sums by range are needed for
    that, so no unit is one task. Pairs of blocks whose sizes are too far apart are left out."""
    units = units.withColumn("band", F.floor(F.log("size") / -math.log(min(threshold, 0.95))))
    bands = units.groupBy("by_gram", "unit", "band").agg(F.sum("size").alias("sum"))
    large = bands.groupBy("by_gram", "unit").agg(F.sum("sum").alias("total")).where(F.col("total") > block).select("by_gram", "unit")
    cuts = checked(bands.join(large, ["by_gram", "unit"]).select("by_gram", "unit", "band", F.ceil(F.col("sum") / block).alias("cuts")))
    number = F.col("band") * F.lit(1 << 32) + F.pmod(F.xxhash64("doc"), F.col("cuts"))
    ranked = cut(units.join(cuts, ["by_gram", "unit", "band"], "left").select("by_gram", "unit", "doc", "size", F.coalesce(number, F.lit(0)).alias("block")))
    blocks = ranked.groupBy("by_gram", "unit", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.count("*").alias("docs"))
    other = blocks.select("by_gram", "unit", F.col("block").alias("two"), F.col("low").alias("low_two"), F.col("high").alias("high_two"))
    fit = (F.col("low_two") * threshold <= F.col("high") + 1e-6) & (F.col("low") * threshold <= F.col("high_two") + 1e-6)
    tasks = blocks.join(other, ["by_gram", "unit"]).where(fit & ((F.col("block") < F.col("two")) | ((F.col("block") == F.col("two")) & (F.col("docs") > 1)))).select("by_gram", "unit", F.col("block").alias("one"), "two")
    return ranked.join(tasks.withColumn("block", F.explode(F.array_distinct(F.array("one", "two")))), ["by_gram", "unit", "block"]).select("doc", "block", *KEYS)


def _prepared(docs: DataFrame, n: int, threshold: float, share: float, block: int) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Of rows whose doc_id is unique up to equal rows: ``(doc, size, first)``, the documents that may have a partner and the
    least one of an equal set; ``(doc, grams)`` of each first; their units; and whether any unit is a gram."""
    parts = partitions(docs.sparkSession)
    buckets = _buckets(parts)
    partnered = _exchange(docs.mapInArrow(_emit(_text_sets(n), threshold, share, buckets), _PACK), False, _partnered, "doc_id bigint")
    sets = cut(docs.join(checked(partnered), "doc_id").select("doc_id", "text").mapInArrow(_sets(n), "doc bigint, sig1 bigint, sig2 bigint, size int, grams binary"))
    names = sets.select("doc", "size", F.min("doc").over(Window.partitionBy("sig1", "sig2", "size")).alias("first"))
    firsts = cut(names.where("doc = first").select("doc", "size").distinct())
    stored = sets.select("doc", "grams").join(checked(firsts.select("doc")), "doc")
    if not sets.groupBy("doc").count().where("count > 1").isEmpty():
        stored = stored.dropDuplicates(["doc"])
    entries = cut(_exchange(stored.mapInArrow(_emit(_stored_sets, threshold, 1.0, buckets), _PACK), True, _prefixes, "gram bigint, doc bigint"))
    return names, stored, *_units(entries, firsts, block)


def _row_pairs(docs: DataFrame, n: int, threshold: float, share: float, block: int, all_pairs: bool) -> DataFrame:
    """``similar_pairs`` of rows whose doc_id is unique up to equal rows."""
    names, stored, units, by_gram = _prepared(docs, n, threshold, share, block)
    equal = names.where("doc <> first").select(F.col("first").alias("doc_a"), F.col("doc").alias("doc_b"), F.lit(1.0).alias("jaccard")).distinct()
    placed = _placed(units, threshold, block)
    near = stored.join(checked(placed), "doc").repartition(partitions(docs.sparkSession), *KEYS).sortWithinPartitions(*KEYS).mapInArrow(_join_blocks(threshold), "doc_a bigint, doc_b bigint, jaccard double")
    if by_gram:  # a pair may share more than one gram
        near = near.groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))
    return expanded(near, equal) if all_pairs else near.union(equal)


def _row_links(docs: DataFrame, rows: DataFrame | None, n: int, threshold: float, share: float, block: int) -> tuple[DataFrame, DataFrame]:
    """``members`` and ``found`` of ``class_links``: all links of ``docs``, whose doc_id is the row of ``rows`` unless that is None."""
    names, stored, units, by_gram = _prepared(docs, n, threshold, share, block)
    members = names.select(F.col("first").alias("rep"), F.col("doc").alias("id")).distinct()
    if rows is None:
        members = members.withColumn("multi", F.lit(False))
    else:
        members = members.join(rows.select(F.col("row").alias("id"), "doc_id"), "id").select("rep", F.col("doc_id").alias("id")).distinct()
        again = rows.groupBy(F.col("doc_id").alias("id")).agg((F.count("*") > 1).alias("multi"))
        members = members.join(again, "id")
    members = cut(members.select("rep", "id", "multi", F.sum((~F.col("multi")).cast("int")).over(Window.partitionBy("rep")).alias("weight")))
    weights = members.groupBy(F.col("rep").alias("doc")).agg(F.first("weight").alias("weight"), F.max("multi").alias("mixed"))
    placed = _placed(units, threshold, block).join(weights, "doc")
    held = F.lit(None).cast("array<bigint>")
    if by_gram:
        placed, held = placed.join(units.where("by_gram").groupBy("doc").agg(F.collect_list("unit").alias("held")), "doc", "left"), F.col("held")
    placed = checked(placed.withColumn("units", F.when(F.col("by_gram"), held)).drop("held"))
    found = stored.join(placed, "doc").repartition(partitions(docs.sparkSession), *KEYS).sortWithinPartitions(*KEYS).mapInArrow(_link_blocks(threshold), LINKS)
    return members, found


def _clean(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")


def _numbered(docs: DataFrame) -> DataFrame | None:
    """``(doc_id, text, row)``, the distinct rows numbered in the order of doc_id, if a doc_id has more than one text; else None."""
    many = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).where("a <> b")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty() or many.isEmpty():
        return None
    return cut(docs.distinct().orderBy("doc_id", "text").withColumn("row", F.monotonically_increasing_id()))


def similar_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, share: float = SHARE, block: int = BLOCK, all_pairs: bool = False) -> DataFrame:
    """``(doc_a, doc_b, jaccard)``: pairs of ``docs(doc_id, text)`` by word n-gram Jaccard similarity.

    Documents with equal sets form one class: each pairs with the class's least doc_id (jaccard 1), and that document
    stands for the class in the pairs with other classes, so that thousands of copies don't give millions of rows; doc_a
    is the lesser id. ``all_pairs`` writes out the pairs that follow from the classes as well. Nulls: a row without doc_id
    or text takes no part. Empty texts (no words) have an empty set and no partner; texts shorter than n words have one
    gram, of all their words. Equal repeated rows count as one. Rows of one doc_id with different texts are compared each
    by itself: two ids have the greatest similarity of their rows, and an id makes no pair with itself. An empty
    table gives no pairs. Other columns are ignored. ``share`` and ``block`` (the grams of
    a block) influence the cost only, never the result."""
    docs = _clean(docs)
    rows = _numbered(docs)
    if rows is None:
        return _row_pairs(docs, n, threshold, share, block, all_pairs)
    found = _row_pairs(rows.select(F.col("row").alias("doc_id"), "text"), n, threshold, share, block, all_pairs)
    one, two = rows.select(F.col("row").alias("doc_a"), F.col("doc_id").alias("a")), rows.select(F.col("row").alias("doc_b"), F.col("doc_id").alias("b"))
    return found.join(one, "doc_a").join(two, "doc_b").where("a <> b").groupBy(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).agg(F.max("jaccard").alias("jaccard"))


def document_links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """``(doc_id, class_id, links)`` for each doc_id of ``docs(doc_id, text)``.

    links: the number of other ids with a word n-gram Jaccard similarity of at least ``threshold``, all of them, copies too;
    class_id: the least id of all that links lead to, step by step (its own without links). Which rows take part is as in
    ``similar_pairs``; an id of several texts is linked if any of them is, and once. A null text has no links; a null
    doc_id has no row. An empty table gives no rows. Other columns are ignored. ``share`` and ``block`` influence the cost
    only. Pairs are counted where they are found, so that what is exchanged grows with the documents and not with the pairs."""
    own = _clean(docs)
    rows = _numbered(own)
    members, found = _row_links(own if rows is None else rows.select(F.col("row").alias("doc_id"), "text"), rows, n, threshold, share, block)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("id")).where("id is not null").distinct()
    return class_links(ids, members, found).withColumnRenamed("id", "doc_id")


def first_of_groups(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without all but one document of each group that pairs connect: the least doc_id stays.

    All columns stay. Rows of one doc_id are told apart by their texts: each text is a document of its own. Rows equal in
    doc_id and text are copies, of which the first in the order of their other plain columns stays. Rows without doc_id or
    text are in no group and stay."""
    own = _clean(docs)
    rows = _numbered(own)
    members, found = _row_links(own if rows is None else rows.select(F.col("row").alias("doc_id"), "text"), None, **{"n": N, "threshold": THRESHOLD, "share": SHARE, "block": BLOCK} | options)
    grouped = connected_components(found.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(members.select("rep", "id")))
    gone = grouped.where("node <> component")
    id_, text = docs["doc_id"].cast("bigint"), F.xxhash64(docs["text"].cast("string"))
    if rows is None:
        kept = docs.join(checked(gone.select(F.col("node").alias("__doc"))), id_ == F.col("__doc"), "left_anti")
    else:
        gone = rows.join(gone.select(F.col("node").alias("row")), "row").select(F.col("doc_id").alias("__doc"), F.xxhash64("text").alias("__text")).distinct()
        kept = docs.join(checked(gone), (id_ == F.col("__doc")) & (text == F.col("__text")), "left_anti")
    again = own.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__doc"))
    if again.isEmpty():
        return kept
    again = checked(again)
    plain = [docs[f.name] for f in docs.schema.fields if f.name not in ("doc_id", "text") and isinstance(f.dataType, AtomicType)]
    twice = kept.join(again, (id_ == F.col("__doc")) & docs["text"].isNotNull(), "left_semi")
    nth = F.row_number().over(Window.partitionBy(id_, docs["text"].cast("string")).orderBy(*plain, F.lit(0)))
    twice = twice.select(F.struct(*docs.columns).alias("__row"), nth.alias("__nth")).where("__nth = 1").select("__row.*")
    return kept.join(again, (id_ == F.col("__doc")) & docs["text"].isNotNull(), "left_anti").union(twice)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_links(documents(spark, sf_dir))


ORACLE = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
grams AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {N} THEN list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i:i + {N - 1}], ' ')) ELSE [array_to_string(w, ' ')] END)) AS g
  FROM words WHERE len(w) > 0),
classes AS MATERIALIZED (SELECT row_number() OVER () AS c, g, list(DISTINCT doc_id) AS ids FROM grams GROUP BY g),
flat AS (SELECT c, len(g) AS size, unnest(g) AS gram FROM classes),
shared AS (
  SELECT a.c AS one, b.c AS two, a.size AS sa, b.size AS sb, count(*) AS n
  FROM flat a JOIN flat b ON a.gram = b.gram AND b.size >= {THRESHOLD} * a.size - 1e-9 AND a.size >= {THRESHOLD} * b.size - 1e-9
  GROUP BY ALL),
members AS (SELECT c, unnest(ids) AS id FROM classes),
pairs AS MATERIALIZED (
  SELECT DISTINCT a.id AS a, b.id AS b FROM shared JOIN members a ON a.c = one JOIN members b ON b.c = two
  WHERE n::DOUBLE / (sa + sb - n) >= {THRESHOLD} AND a.id <> b.id),
reached AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reached r JOIN pairs p ON r.b = p.a),
links AS (SELECT a, count(*) AS links FROM pairs GROUP BY a),
least AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(b, doc_id)) AS class_id, coalesce(links, 0)::BIGINT AS links
FROM (SELECT DISTINCT doc_id::BIGINT AS doc_id FROM documents WHERE doc_id IS NOT NULL) LEFT JOIN links ON links.a = doc_id LEFT JOIN least ON least.a = doc_id
"""
