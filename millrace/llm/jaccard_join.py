"""Exact Jaccard self-join of documents on word shingles by T-occurrence search.

Two documents link when 100 * |A & B| >= 75 * |A | B|, with A, B their sets of distinct five-word shingles.
With sizes a and b this is 7 * |A & B| >= 3 * (a + b), and every partner holds at least 3/4 of a document's
shingles. The steps:

1. Classes. Documents with equal sets form a class, named by a 64-bit digest of its set. Only classes are
   searched, so copies are never expanded into pairs. A block of texts carries each class once, with its ids.
2. Hubs. Of each set the first `prefix_size(n)` shingles in a random order, about half of it, meet in hash buckets, as
   packed arrays. Two partners share `least_shared(n)` of those at least, n the size of the smaller. Every shingle that
   several classes send has a hub, the least label of these classes, which goes back to the blocks that sent it. A
   class with fewer shared shingles than any partner needs is left out. A shingle takes as many bytes at any size of
   the input: a block names its classes in a bucket only where their texts may be there twice, as a bitmap of the hashes
   of repeated texts tells. Else a class that came in several blocks counts as several, which keeps more hubs than
   are needed, never fewer.
3. Coarse groups. A class forgets the hubs with the fewest of its shingles, `spare(n)` shingles in all at most. What two
   partners forget is less than what they share, so they keep a hub in common: connected components of classes and
   hubs bound the search. Shingles that unlike texts share by chance are few for each text and are forgotten, so
   that groups don't grow together with the input. Texts of groups of several classes are cut into shingles again, and
   their whole sets meet once more: then a class needs 3/4 of its shingles shared, and may forget 3/7 of them, as
   two partners share 3/7 of their sizes' sum. What passages and frequent phrases alone had joined falls apart.
4. T-occurrence search (DivideSkip). Within a block of a group the lists of a query's shingles are sorted by
   length. The longest are set aside; the short ones are merged by a heap (very many postings by merging sorted
   runs) and the documents counted that reach T less the number of long lists; those are looked up in the long
   lists by binary search.
5. A group is cut into blocks of at most about `BLOCK` postings and `MEMBERS` members. Every block is searched;
   one member of each component found in a block goes on to the next round, until the members that are left fit
   into one block. What these links have not joined to the group's main component is then searched against the
   whole group, by pairs of blocks of `BLOCK` postings, as rows are sent once for each pair, `ASKS` blocks of
   queries at a time. So a task holds two blocks at most, the disk a few times the group, and no link between
   different texts is lost at any size.

Shingles are compared by 64-bit hashes. Words are runs without ASCII white space, A-Z in lower case.
Null and empty texts have no shingles and link with nothing. Texts of fewer than five words are one shingle.
Very long texts are cut whole; a text is the least that a task holds. Null ids keep their rows and never name a
component. Repeated rows give repeated rows. Other columns of the input, also such with the names of results, are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

WORDS = 5
#: Postings that a block holds; more where there are so many texts that the buckets' shares would be tiny.
BLOCK = 3 << 18
#: Members that a block holds on average, at most.
MEMBERS = 512
#: Bytes of text for each shingle, as a guess for the number of buckets.
SHINGLE_BYTES = 6
#: Bits of a class's label. Equal labels of two classes join their groups, which loses no link.
LABEL_BITS = 40
#: Slots of the bitmap of the texts that are cut into shingles again: fixed size. Where it fills up, more texts are.
WANTED_BITS = 24
#: Blocks of queries that are searched at a time against the whole of their group.
ASKS = 4
#: Slots of the bitmap of repeated texts: fixed size, whatever the input. Where it fills up, more classes are named.
TWIN_BITS = 22
#: Dropped ids that are broadcast at most; more are joined by a shuffle.
MARKED = 2_000_000
#: Postings up to which short lists are merged by a heap.
HEAP = 1 << 11
#: Share of DivideSkip's long lists: T / (MU * log2(longest list) + 1).
MU = 0.5

_SHORT, _ORDER = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ordered by text and hash, and their number for each text."""
    doc, h, _, _ = common.word_hashes(texts)
    n_words = np.bincount(doc, minlength=len(texts))
    g = common.gram_hashes(h, WORDS)
    d = doc[: len(g)]
    inside = d == doc[WORDS - 1 :] if len(g) else np.empty(0, bool)
    g, d = g[inside], d[inside]
    few = np.flatnonzero((n_words > 0) & (n_words < WORDS))
    if len(few):
        first = np.searchsorted(doc, few)
        whole = np.array([common.mix(np.bitwise_xor.reduce(common.mix(h[a : a + k] + np.arange(1, k + 1, dtype=np.uint64) * _SHORT), keepdims=True) + np.uint64(k))[0] for a, k in zip(first, n_words[few])], np.uint64)
        g, d = np.concatenate([g, whole]), np.concatenate([d, few])
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    return g[new], np.bincount(d[new], minlength=len(texts))


def set_digests(g: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit digest of each set (0 for empty ones)."""
    out = np.zeros(len(n), np.uint64)
    full = n > 0
    if full.any():
        first = (np.cumsum(n) - n)[full]
        out[full] = common.mix(np.add.reduceat(common.mix(g ^ np.uint64(0xD6E8FEB86659FD93)), first) * np.uint64(0x9E3779B97F4A7C15) + np.bitwise_xor.reduceat(common.mix(g), first) + n[full].astype(np.uint64))
    return out


# Hubs ------------------------------------------------------------------------------------------------


def prefix_size(n):
    """Number of a set's first shingles that hold enough of what it shares with any partner.

    A partner has ceil(3n/4) of the n shingles at least. All but ceil(3n/4) - ceil(n/4) are among the first
    prefix_size(n), and so are the first ceil(n/4) shared ones; the same holds for the partner's set.
    """
    return n - (3 * n + 3) // 4 + (n + 3) // 4


def least_shared(n):
    """Number of shingles that the prefixes of a set and of any partner have in common, at least; 3n/4 is the least size of one."""
    return ((3 * n + 3) // 4 + 3) // 4


def spare(n):
    """Number of shared shingles that a set may forget: less than half of those of a partner, whichever is smaller."""
    return (least_shared(n) - 1) // 2


def prefixes(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefixes of sets, each by hash, and their sizes."""
    d = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((common.mix(g ^ _ORDER), d))
    size = prefix_size(n)
    chosen = np.zeros(len(g), bool)
    chosen[order[np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(size, n)]] = True
    return g[chosen], size


def heavy_hubs(at: np.ndarray, hub: np.ndarray, n: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(set, hub) that sets of n shingles keep; a row (at, hub) for each shared shingle of set at, in its prefix or the whole."""
    least, forgotten = ((3 * n + 3) // 4, (3 * n + 6) // 7 - 1) if whole else (least_shared(n), spare(n))
    ok = np.bincount(at, minlength=len(n)) >= np.maximum(least, 1)
    at, hub = at[ok[at]], hub[ok[at]]
    if not len(at):
        return at, hub
    order = np.lexsort((hub, at))
    at, hub = at[order], hub[order]
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (hub[1:] != hub[:-1])))
    weight = np.diff(np.append(first, len(at)))
    at, hub = at[first], hub[first]
    order = np.lexsort((hub, weight, at))
    at, hub, total = at[order], hub[order], np.cumsum(weight[order])
    start = np.searchsorted(at, at)
    kept = total - np.append(0, total)[start] > forgotten[at]
    return at[kept], hub[kept]


_BLOB = "key long, block long, kind int, a binary, b binary, c binary"


def _planes(x: np.ndarray) -> bytes:
    """An array byte by byte, all first bytes, then all second ones: high bytes of small numbers compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack(g: np.ndarray) -> bytes:
    """Ascending hashes as differences."""
    return _planes(np.diff(g, prepend=np.zeros(1, np.uint64)))


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(raw, np.uint64), dtype=np.uint64)


class _Block:
    """Classes of some documents, until they are enough to be sent off."""

    def __init__(self, buckets: int, limit: int):
        self.buckets, self.limit, self.parts, self.size = buckets, limit, [], 0
        self.name = TaskContext.get().partitionId() << 32  # a retried task gives its blocks the same names

    def add(self, ids: list, texts: list[bytes], twin: list[bool], name: list[int] | None = None) -> None:
        """twin: whether the text may be there in other rows, too; name: its hash."""
        g, n = shingle_sets(texts)
        unknown = np.array([i is None for i in ids], bool)
        self.parts.append((np.array([i or 0 for i in ids], np.int64), unknown, np.array(twin, bool), np.array(name or [0] * len(ids), np.int64), set_digests(g, n).view(np.int64), n, *prefixes(g, n)))
        self.size += len(g) + len(ids)

    def add_sets(self, node: np.ndarray, n: np.ndarray, g: np.ndarray) -> None:
        """Whole sets of different classes."""
        none = np.zeros(len(node), bool)
        self.parts.append((node, none, none, np.zeros(len(node), np.int64), node, n, g, n))
        self.size += len(g) + len(node)

    def full(self) -> bool:
        return self.size >= self.limit

    def rows(self) -> pa.RecordBatch:
        ids, unknown, twin, name, node, n, g, size = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        # documents by class; texts without shingles have the digest 0 and come as a class of their own
        known, keep, member, times = np.unique(np.where(n > 0, node, 0), return_index=True, return_inverse=True, return_counts=True)
        lost = np.bincount(member, unknown, len(known)).astype(np.int64)
        twin = np.bincount(member, twin, len(known)) > 0
        order = np.lexsort((unknown, member))
        chosen = np.zeros(len(node), bool)
        chosen[keep] = True  # equal sets of the block count once
        g = g[np.repeat(chosen, size)]
        rank = np.empty(len(node), np.int32)
        rank[keep] = np.arange(len(keep))
        owner = np.repeat(rank[chosen], size[chosen]).astype(_place(len(known)))
        by = np.argsort(g, kind="stable")
        g, owner = g[by], owner[by]
        block, self.name = self.name, self.name + 1
        # kind 0 goes straight back to the block: its classes with their ids
        out = [(block, block, 0, np.stack([known, n[keep], times, lost, name[keep]]).tobytes(), ids[order].tobytes(), b"")]
        cut = np.searchsorted((g >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32), np.arange(self.buckets + 1))
        for k in range(self.buckets):
            lo, hi = cut[k], cut[k + 1]
            if lo < hi:
                some = np.unique(owner[lo:hi]).astype(np.int32)
                some = some[twin[some]]
                out.append((k, block, 2, pack(g[lo:hi]), _planes(owner[lo:hi]), some.tobytes() + known[some].tobytes()))
        cols = list(zip(*out))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["key", "block", "kind", "a", "b", "c"])


def _place(classes: int):
    """Type of the owners in a block of so many classes."""
    return np.uint16 if classes < 65535 else np.uint32


#: Instead of a class: one that no other block is known to hold.
_ALONE = np.iinfo(np.int64).min


def _owners(a: bytes, b: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of a block's share in a bucket: each shingle's owner, and its class or _ALONE."""
    owner = _unplanes(b, np.uint16 if 4 * len(b) == len(a) else np.uint32).astype(np.int32)
    node = np.full(len(owner), _ALONE)
    if c:
        some = np.frombuffer(c, np.int32, len(c) // 12)
        at = np.minimum(np.searchsorted(some, owner), len(some) - 1)
        node = np.where(some[at] == owner, np.frombuffer(c, np.int64, offset=4 * len(some))[at], node)
    return owner, node


def _labels(block: int, owner: np.ndarray) -> np.ndarray:
    """Labels of the classes of a block, in random order."""
    base = common.mix(np.array([block], np.int64).view(np.uint64))
    return (common.mix(base + owner.astype(np.uint64)) >> np.uint64(64 - LABEL_BITS)).view(np.int64)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's entries: the hubs of the shingles of several classes go back to the blocks that sent them."""
    held = [x for t in batches for x in zip(*(t.column(c).to_pylist() for c in ("block", "kind", "a", "b", "c")))]
    out = [x[:4] for x in held if x[1] < 2]
    held = [x for x in held if x[1] == 2]
    if held:
        g = np.concatenate([unpack(x[2]) for x in held])
        size = np.array([len(x[2]) // 8 for x in held])
        owner, node, label = np.empty(len(g), np.int32), np.empty(len(g), np.int64), np.empty(len(g), np.int64)
        stop = np.cumsum(size)
        for (block, _, a, b, c), hi, k in zip(held, stop, size):
            owner[hi - k : hi], node[hi - k : hi] = _owners(a, b, c)
            label[hi - k : hi] = _labels(block, owner[hi - k : hi])
        order = np.argsort(g, kind="stable")
        s = g[order]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        times = np.diff(np.append(first, len(s)))
        low, high = (f.reduceat(node[order], first) for f in (np.minimum, np.maximum))
        shared = (low != high) | ((low == _ALONE) & (times > 1))
        hub = np.empty(len(g), np.int64)
        hub[order] = np.repeat(np.where(shared, np.minimum.reduceat(label[order], first), -1), times)
        for (block, _, _, _, _), hi, k in zip(held, stop, size):
            pick = np.flatnonzero(hub[hi - k : hi] >= 0) + hi - k
            if len(pick):
                out.append((block, 1, _planes(hub[pick]), _planes(owner[pick])))
    for low in range(0, len(out), 64):
        cols = list(zip(*out[low : low + 64]))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["block", "kind", "a", "b"])
    common.release()


_CLASSES = "node long, block long, n long, ids array<long>, name long, hubs array<long>"


def _with_hubs(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[pa.RecordBatch]:
    """A block's classes with their documents; with the hash of a text and the hubs of those that may have partners."""
    rows = [x for t in batches for x in zip(*(t.column(c).to_pylist() for c in ("block", "kind", "a", "b")))]
    block, _, head, raw = next(x for x in rows if x[1] == 0)
    node, n, times, lost, name = np.frombuffer(head, np.int64).reshape(5, -1)
    ids, stop = np.frombuffer(raw, np.int64), np.cumsum(times)
    hub, at = (np.concatenate([np.empty(0, t), *(_unplanes(x[c], t) for x in rows if x[1] == 1)]) for c, t in ((2, np.int64), (3, np.int32)))
    at, hub = heavy_hubs(at, hub, n, whole)
    cut = np.searchsorted(at, np.arange(len(node) + 1))
    for low in range(0, len(node), 256):
        part = range(low, min(low + 256, len(node)))
        own = [ids[stop[k] - times[k] : stop[k] - lost[k]].tolist() + [None] * int(lost[k]) for k in part]
        hubs = [hub[cut[k] : cut[k + 1]].tolist() or None for k in part]
        some = slice(low, low + 256)
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[some], mask=n[some] == 0), pa.array([block] * len(part), pa.int64()), pa.array(n[some]), pa.array(own, pa.list_(pa.int64())), pa.array(name[some]), pa.array(hubs, pa.list_(pa.int64()))],
            ["node", "block", "n", "ids", "name", "hubs"],
        )
    common.release()


def _bitmap(names: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the hashes in the only column of names: fixed size, whatever the input."""
    slots = 1 << bits
    found = names.toDF("name").selectExpr(f"cast(name & {slots - 1} as int) slot").distinct().toArrow()  # at most `slots` rows
    out = np.zeros(slots, bool)
    out[found.column("slot").to_numpy()] = True
    return np.packbits(out, bitorder="little")


def _marked(names: pa.Array, bitmap: np.ndarray) -> np.ndarray:
    """Whether the bitmap has each of the hashes."""
    slot = names.to_numpy() & (8 * len(bitmap) - 1)
    return (bitmap[slot >> 3] >> (slot & 7)) & 1 > 0


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("name"))


def classes_of(docs: DataFrame) -> DataFrame:
    """(node, block, n, ids, name, hubs): the classes of each block of texts, with their documents.

    node is null for texts without shingles; name is the hash of one of the texts, hubs what a class that may have
    partners has in common with them.
    """
    spark = docs.sparkSession
    limit, buckets = _sizes((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHINGLE_BYTES)
    rows = _named(docs)
    repeated = spark.sparkContext.broadcast(_bitmap(rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"), TWIN_BITS))

    def send(batches):
        block = _Block(buckets, limit)
        for batch in batches:
            twin = _marked(batch.column(2), repeated.value)
            for part in common.chunks(zip(batch.column(0).to_pylist(), common.binary(batch.column(1)), twin, batch.column(2).to_pylist()), lambda r: len(r[1] or b"")):
                block.add([r[0] for r in part], [r[1] or b"" for r in part], [r[2] for r in part], [r[3] for r in part])
                if block.full():
                    yield block.rows()
        if block.parts:
            yield block.rows()

    return _hubs(rows.mapInArrow(send, _BLOB), False)


def _sizes(total: int) -> tuple[int, int]:
    """For so many shingles: those that a block holds, and the number of buckets."""
    limit = max(BLOCK, int((16 * total) ** 0.5))
    return limit, max(4, int(total) // (2 * limit) + 1)


def _hubs(sent: DataFrame, whole: bool) -> DataFrame:
    back = sent.groupBy("key").applyInArrow(_meet, "block long, kind int, a binary, b binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _with_hubs(batches, whole)

    out = common.materialize(back.groupBy("block").applyInArrow(run, _CLASSES), "classes")
    common.release_shuffles(sent.sparkSession)
    return out


def meet_again(sets: DataFrame) -> DataFrame:
    """The same of whole sets (grp, node, n, toks)."""
    limit, buckets = _sizes(sets.agg(F.sum("n")).first()[0] or 0)

    def send(batches):
        block = _Block(buckets, limit)
        for batch in batches:
            for part in common.chunks(zip(*(batch.column(c).to_pylist() for c in range(3))), lambda r: len(r[2])):
                node, n, toks = zip(*part)
                block.add_sets(np.array(node, np.int64), np.array(n, np.int64), np.concatenate([unpack(t) for t in toks]))
                if block.full():
                    yield block.rows()
        if block.parts:
            yield block.rows()

    return _hubs(sets.select("node", "n", "toks").mapInArrow(send, _BLOB), True)


# Coarse groups ---------------------------------------------------------------------------------------


def coarse_groups(classes: DataFrame) -> DataFrame:
    """(node, grp, name) of the classes that share a hub with another class; name is the hash of one of its texts."""
    edges = classes.where("hubs is not null").select(F.explode("hubs").alias("a"), F.col("node").alias("b")).distinct()
    groups = common.connected_components(edges).toDF("node", "grp")
    known = groups.join(classes.where("hubs is not null").groupBy("node").agg(F.min("name").alias("name")), "node")
    several = known.groupBy("grp").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("grp")
    return common.materialize(known.join(several, "grp").select("node", "grp", "name"), "groups")


def shingles(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, node, n, toks): the sets of the classes in groups, cut from the texts once more."""
    wanted = docs.sparkSession.sparkContext.broadcast(_bitmap(groups.select("name"), WANTED_BITS))

    def run(batches):
        seen = set()
        for batch in batches:
            batch = batch.filter(pa.array(_marked(batch.column(2), wanted.value)))
            for part in common.chunks(common.binary(batch.column(1)), lambda t: len(t or b"")):
                g, n = shingle_sets([t or b"" for t in part])
                node, stop = set_digests(g, n).view(np.int64), np.cumsum(n)
                own = []
                for k in np.flatnonzero(n):
                    if node[k] not in seen:
                        seen.add(node[k])
                        own.append(k)
                for low in range(0, len(own), 64):
                    some = own[low : low + 64]
                    yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(n[some]), pa.array([pack(g[stop[k] - n[k] : stop[k]]) for k in some], pa.binary())], ["node", "n", "toks"])

    cut = _named(docs).mapInArrow(run, "node long, n long, toks binary")
    return cut.join(groups.select("node", "grp"), "node").dropDuplicates(["node"]).select("grp", "node", "n", "toks")


def grouped_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(grp, node, n, toks): the sets of the classes that may have partners, by the group that holds these."""
    loose = coarse_groups(classes)
    sets = common.materialize(shingles(docs, loose), "sets")
    again = meet_again(sets)
    groups = coarse_groups(again)
    out = common.materialize(sets.drop("grp").join(groups.select("node", "grp"), "node").select("grp", "node", "n", "toks"), "grouped")
    common.discard(loose, sets, again, groups)
    common.release_shuffles(docs.sparkSession)
    return out


def class_table(docs: DataFrame) -> DataFrame:
    """(node, n, ids, grp, toks): the classes of each block; with group and shingles where they may have partners."""
    classes = classes_of(docs)
    return classes.select("node", "n", "ids").join(grouped_sets(docs, classes).select("node", "grp", "toks"), "node", "left")


# T-occurrence search ---------------------------------------------------------------------------------


class Lists:
    """Inverted lists of some sets."""

    def __init__(self, n: np.ndarray, sets: list[np.ndarray]):
        self.n, self.sets = n, sets
        g = np.concatenate(sets)
        at = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        order = np.argsort(g, kind="stable")
        self.of = at[order]
        self.tok, first = np.unique(g[order], return_index=True)
        self.cut = np.append(first, len(g))

    def partners(self, g: np.ndarray, n: int) -> np.ndarray:
        """Members whose overlap o with the set g of size n has 7 o >= 3 (n + size of the member)."""
        need = max(1, -(-3 * n // 4))
        k = np.searchsorted(self.tok, g)
        k = k[(k < len(self.tok)) & (self.tok[np.minimum(k, len(self.tok) - 1)] == g)]
        size = self.cut[k + 1] - self.cut[k]
        if len(k) < need:
            return np.empty(0, np.int64)
        order = np.argsort(-size, kind="stable")
        k, size = k[order], size[order]
        n_long = min(need - 1, int(need / (MU * np.log2(max(2, size[0])) + 1)))
        short = k[n_long:]
        runs = [self.of[self.cut[i] : self.cut[i + 1]] for i in short]
        if size[n_long:].sum() <= HEAP:
            merged = np.array(list(heapq.merge(*(r.tolist() for r in runs))), np.int32)
        else:  # a stable sort merges sorted runs
            merged = np.sort(np.concatenate(runs), kind="stable")
        turn = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
        seen, count = merged[turn], np.diff(np.append(turn, len(merged)))
        full = -(-3 * (n + self.n[seen]) // 7)
        some = count >= full - n_long
        seen, count, full = seen[some], count[some], full[some]
        for i in k[:n_long]:
            if not len(seen):
                break
            one = self.of[self.cut[i] : self.cut[i + 1]]
            at = np.searchsorted(one, seen)
            count = count + ((at < len(one)) & (one[np.minimum(at, len(one) - 1)] == seen))
        return seen[count >= full]


def search(n: np.ndarray, sets: list[np.ndarray], ask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that join all members of a group that links connect, at least.

    ask: positions to be looked up; None: all that the first hub doesn't reach.
    """
    lists = Lists(n, sets)
    a, b = [], []
    if ask is None:
        hub = int(np.argmax(n))
        near = lists.partners(sets[hub], n[hub])
        a.append(np.full(len(near), hub))
        b.append(near)
        reached = np.zeros(len(n), bool)
        reached[near] = True
        reached[hub] = True
        ask = np.flatnonzero(~reached)
    for q in ask:
        near = lists.partners(sets[q], n[q])
        a.append(np.full(len(near), q))
        b.append(near)
    x, y = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
    return x[x != y], y[x != y]


_FOUND = "a long, b long, grp long, n long, toks binary"


def _link_batch(node: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    u, v = common.forest(node[x], node[y]) if len(x) else (node[:0], node[:0])
    none = pa.nulls(len(u), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), none, none, pa.nulls(len(u), pa.binary())], ["a", "b", "grp", "n", "toks"])


def _columns(batches: Iterator[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    held = list(batches)
    return [np.concatenate([t.column(c).to_numpy(zero_copy_only=False) for t in held]) for c in names]


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each of the blocks of groups that a task holds; of groups cut up, a member of each component."""
    grp, part, parts, node, n, toks = _columns(batches, "grp", "part", "parts", "node", "n", "toks")
    order = np.lexsort((node, part, grp))
    g, p = grp[order], part[order]
    cut = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (p[1:] != p[:-1])))
    for own in np.split(order, cut[1:]):
        x = y = own[:0]
        if len(own) > 1:
            x, y = search(n[own], [unpack(toks[i]) for i in own])
            if len(x):
                yield _link_batch(node[own], x, y)
        if parts[own[0]] > 1:
            child, _ = common.forest(x, y) if len(x) else (x, y)
            rest = own[np.setdiff1d(np.arange(len(own)), child)]
            yield pa.RecordBatch.from_arrays([pa.array(node[rest]), pa.nulls(len(rest), pa.int64()), pa.array(grp[rest]), pa.array(n[rest]), pa.array(toks[rest].tolist(), pa.binary())], ["a", "b", "grp", "n", "toks"])


def _search_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between a block of queries and a block of the members of one group."""
    node, n, toks, ask = _columns(batches, "node", "n", "toks", "ask")
    asked = node[ask.astype(bool)]
    node, first = np.unique(node, return_index=True)  # a query of the block is there twice
    if len(asked) and len(node) > 1:
        x, y = search(n[first], [unpack(toks[i]) for i in first], np.flatnonzero(np.isin(node, asked)))
        yield _link_batch(node, x, y)


def _blocks(size: Column) -> Column:
    """Number of blocks for shingles of size bytes."""
    return F.greatest(F.ceil(size / F.lit(8 * BLOCK)), F.lit(1)).cast("int")


def _cut(member: DataFrame, small: bool = True) -> DataFrame:
    """member with the number of blocks of its group (parts) and its own block (part); small: by members, too."""
    parts = _blocks(F.sum(F.length("toks")))
    if small:
        parts = F.greatest(parts, F.ceil(F.count(F.lit(1)) / F.lit(MEMBERS)).cast("int"))
    size = member.groupBy("grp").agg(parts.alias("parts"))
    return member.join(size, "grp").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))


def _rounds(member: DataFrame) -> DataFrame:
    """Links found within blocks, round by round; member: (grp, node, n, toks, parts, part)."""
    links, before = None, None
    while True:
        postings, blocks = member.agg(F.sum(F.length("toks")), F.max("parts")).first()
        if not postings:
            return links if links is not None else member.selectExpr("node a", "node b").where("false")
        packs = int(postings // (8 * BLOCK)) + common.shuffle_partitions(member.sparkSession)
        found = common.materialize(member.withColumn("pack", F.pmod(F.xxhash64("grp", "part"), F.lit(packs))).groupBy("pack").applyInArrow(_search_blocks, _FOUND), "found")
        links = (links.unionByName if links is not None else lambda x: x)(found.where("b is not null").select("a", "b"))
        if blocks == 1 or (before is not None and postings > before / 2):
            return links
        before = postings
        member = _cut(found.where("b is null").selectExpr("grp", "a node", "n", "toks"))


def _rest(member: DataFrame, links: DataFrame) -> DataFrame:
    """Links of the members of cut groups that are not in their group's main component, by pairs of blocks."""
    spark = member.sparkSession
    parts = common.connected_components(links)
    where = member.select("grp", "node", "toks").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")).selectExpr("grp", "node", "component", "length(toks) size")
    most = where.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("grp").agg(F.max(F.struct("c", "component")).alias("m")).select("grp", F.col("m.component").alias("main"))
    left = common.materialize(where.join(most, "grp").where("component <> main").select("grp", "node", "size"), "left")
    asks = left.groupBy("grp").agg(_blocks(F.sum("size")).alias("asks"))
    every = _cut(member.drop("parts", "part"), small=False).join(asks, "grp")  # groups that are one component are done
    of = F.pmod(F.xxhash64("node", F.lit(2)), F.col("asks")).cast("int").alias("i")
    ask = every.join(left.select("grp", "node"), ["grp", "node"], "left_semi").select("grp", "node", "n", "toks", F.lit(True).alias("ask"), "parts", of)
    found = []
    for low in range(0, asks.agg(F.max("asks")).first()[0] or 0, ASKS):  # the group is sent ASKS times at once
        some = F.sequence(F.lit(low), F.least(F.col("asks"), F.lit(low + ASKS)) - 1)
        index = every.where(F.col("asks") > low).select("grp", "node", "n", "toks", F.lit(False).alias("ask"), "part", F.explode(some).alias("i"))
        queries = ask.where(F.col("i").between(low, low + ASKS - 1)).select("grp", "node", "n", "toks", "ask", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "i")
        found.append(common.materialize(index.unionByName(queries).groupBy("grp", "i", "part").applyInArrow(_search_pairs, _FOUND).select("a", "b"), "rest"))
    common.discard(left)
    common.release_shuffles(spark)
    return reduce(DataFrame.unionByName, found) if found else links.where("false")


def class_links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes that connect all classes that similarity connects."""
    sets = grouped_sets(docs, classes)
    member = common.materialize(_cut(sets), "members")
    common.discard(sets)
    common.release_shuffles(docs.sparkSession)
    links = _rounds(member)
    large = member.where("parts > 1")
    if large.limit(1).count():
        links = links.unionByName(_rest(large, links))
    common.discard(member)
    return links


def _components(docs: DataFrame) -> DataFrame:
    """(node, n, ids, component_id) of the classes of each block."""
    docs = common.read_from_files(docs.select("doc_id", "text"))  # texts are read twice
    classes = classes_of(docs)
    parts = common.connected_components(class_links(docs, classes))
    least = classes.where("node is not null").groupBy("node").agg(F.min(F.array_min("ids")).alias("least"))
    named = least.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # the least id of a component, over its classes; then back to the classes
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = common.materialize(named.join(lowest, "component").select("node", "component_id"), "named")
    empty = classes.where("node is null").select("node", "n", "ids", F.lit(None).cast("long").alias("component_id"))
    return classes.where("node is not null").select("node", "n", "ids").join(named, "node").unionByName(empty)


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    return _components(docs).select(F.explode("ids").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of the documents with the least id of their component.

    Rows that repeat an id are one document; of those that differ the one with the least digest stays. Rows
    without an id stay.
    """
    found = components(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count(F.lit(1)).alias("times"))
    # few ids are dropped or repeated: they go to the texts, not the texts to them
    marked = common.materialize(found.where("not stays or times > 1"), "marked")
    near = F.broadcast if marked.count() <= MARKED else lambda df: df
    out = docs.join(near(marked.select("doc_id")), "doc_id", "left_anti").select(docs.columns)
    repeated = marked.where("stays").select("doc_id")
    if repeated.limit(1).count():
        twice = docs.join(near(repeated), "doc_id", "left_semi").select(docs.columns)
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        one = twice.groupBy("doc_id").agg(F.min_by(row, F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))).alias("row"))
        out = out.unionByName(one.select("row.*"))
    return out
