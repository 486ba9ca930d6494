"""Benchmark decontamination: rare n-gram seeds, Smith-Waterman alignment.

1. A first pass counts in the documents the word pairs of the benchmark items. Of an item's pairs the rarest ones
   are its seeds; how many may be left out is set by the bound below, so no copy is lost however common its
   remaining words are.
2. A second pass finds the seeds in whole texts, also with one word put in between. Every hit predicts where the
   item would begin; hits of the same stretch give one window of about four item lengths. Windows with fewer hits
   than the bound, or that share too few words with the item in any order, are left out.
3. Item and window are aligned word by word (Smith-Waterman: match 2, mismatch -1, gap -1). The score over
   that of a perfect copy is the similarity; from `THRESHOLD` on the document is contaminated. Copies with
   words replaced, dropped or inserted keep most of the score.

The bound: an alignment with M matches, R item words replaced or dropped and I words put in scores 2 M - R - I,
so similarity 1/2 of an item of M + R words needs M >= 2 R + I, hence M >= 2/3 of the item. Of the M - 1 pairs of
neighbouring matches each of the R breaks one at most, and only two words put in between break one, so at least
(M + 1) // 2 - 1 pairs are found in the item next to one another and in the text with one word between them at
most. `hits_needed` is that number; leaving out some of an item's pairs lowers it by as many.

Words are runs without ASCII white space and punctuation, A-Z in lower case. Items of fewer than `LEAST_WORDS`
words are matched by their whole word sequence. Items are taken in slices of at most `SLICE_BYTES` bytes or one
item, each with its passes, so what the tasks receive is bounded whatever the size of the benchmark.

Null and empty texts or items match nothing. Very long texts and items are searched whole, in blocks. Repeated
documents give repeated rows; items with equal text each give their row. Null ids stay null. Other columns, also
such with the names of results, are ignored. An empty benchmark contaminates nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import common

THRESHOLD = 0.5
#: Items from this length on have pairs as seeds; the bound gives them one hit at least.
LEAST_WORDS = 4
SLICE_BYTES = 2_500_000
#: Seed places and window words that are held at once.
BLOCK = 1 << 19
MATCH, OTHER, GAP = 2, -1, -1


def _of_item(words: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Hash of each word together with its item."""
    return common.mix(words ^ common.mix(item.astype(np.uint64) + np.uint64(1)))


def hits_needed(words: int) -> int:
    """Pairs of an item of so many words that any copy of similarity 1/2 holds."""
    return max(1, (-(-2 * words // 3) + 1) // 2 - 1)


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of pairs of words; equal to gram_hashes of two neighbours."""
    with np.errstate(over="ignore"):
        return common.mix(common.mix(first ^ common._GRAM[0]) * common._GRAM[0] + common.mix(second ^ common._GRAM[1]) * common._GRAM[1])


class Items:
    """Benchmark items of a slice with their seeds."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.id = [r[0] for r in rows]
        doc, h, _, _ = common.word_hashes([r[1] for r in rows])
        cut = np.searchsorted(doc, np.arange(len(rows) + 1))
        self.words = [h[cut[k] : cut[k + 1]] for k in range(len(rows))]
        gram, item, at = [], [], []
        for k, w in enumerate(self.words):
            g = common.gram_hashes(w, 2 if len(w) >= LEAST_WORDS else len(w)) if len(w) else w
            gram.append(g)
            item.append(np.full(len(g), k))
            at.append(np.arange(len(g)))
        self.gram, self.item, self.at = np.concatenate(gram), np.concatenate(item), np.concatenate(at)
        self.short = sorted({len(w) for w in self.words if 0 < len(w) < LEAST_WORDS})
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.need = np.array([hits_needed(len(w)) if len(w) >= LEAST_WORDS else 1 for w in self.words], np.int64)
        self.word, self.times = np.unique(_of_item(h, doc), return_counts=True)

    def thin(self, count: np.ndarray) -> None:
        """Leaves out the commonest seeds of each item, half as many as it needs hits; count: occurrences of each seed."""
        order = np.lexsort((self.at, -count, self.item))
        first = np.searchsorted(self.item[order], np.arange(len(self.words)))
        rank = np.arange(len(order)) - first[self.item[order]]
        keep = np.sort(order[rank >= (self.need // 2)[self.item[order]]])
        self.need -= self.need // 2
        keep = keep[count[keep] > 0]  # what occurs nowhere is hit nowhere
        self.gram, self.item, self.at = self.gram[keep], self.item[keep], self.at[keep]


SIEVE = np.uint64((1 << 20) - 1)


class Finder:
    """Looks seeds up in texts."""

    def __init__(self, items: Items):
        self.items = items
        self.order = np.argsort(items.gram, kind="stable")
        self.sorted = items.gram[self.order]
        self.key, first = np.unique(self.sorted, return_index=True)
        self.first = np.append(first, len(self.sorted))
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.key & SIEVE).astype(np.int64)] = True
        # words that begin and end a pair that is a seed
        self.begins, self.ends = np.zeros(1 << 20, bool), np.zeros(1 << 20, bool)
        for k, at in zip(items.item, items.at):
            if items.size[k] >= LEAST_WORDS:
                self.begins[items.words[k][at] & SIEVE] = True
                self.ends[items.words[k][at + 1] & SIEVE] = True
        self.word_sieve = np.zeros(1 << 22, bool)
        self.word_sieve[(items.word & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def _known(self, at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = np.flatnonzero(self.sieve[(g & SIEVE).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.key, g[some]), len(self.key) - 1)
        same = self.key[k] == g[some]
        return at[some[same]], k[same]

    def hits(self, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word position and index of the key of every seed in the texts."""
        slot = (h & SIEVE).astype(np.int64)
        begins, ends = self.begins[slot], self.ends[slot]
        found = []
        for ahead in (1, 2):
            at = np.flatnonzero(begins[:-ahead] & ends[ahead:])
            at = at[doc[at] == doc[at + ahead]]
            found.append(self._known(at, _pairs(h[at], h[at + ahead])))
        for n in self.items.short:
            g = common.gram_hashes(h, n)
            at = np.arange(len(g))
            found.append(self._known(at[doc[: len(g)] == doc[n - 1 :]], g[doc[: len(g)] == doc[n - 1 :]]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each item with its window, and the window position where it ends."""
    best, end = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    order = np.argsort([len(w) for w in windows], kind="stable")
    for low in range(0, len(order), 128):
        part = order[low : low + 128]
        length, width = max(len(items[k]) for k in part), max(len(windows[k]) for k in part)
        a, b = np.zeros((len(part), length), np.uint64), np.zeros((len(part), width), np.uint64)
        a_in, b_in = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
        for r, k in enumerate(part):
            a[r, : len(items[k])], a_in[r, : len(items[k])] = items[k], True
            b[r, : len(windows[k])], b_in[r, : len(windows[k])] = windows[k], True
        row = np.zeros((len(part), width + 1), np.int32)
        slope = np.arange(width + 1, dtype=np.int32) * -GAP
        top, where = np.zeros(len(part), np.int32), np.zeros(len(part), np.int64)
        for i in range(length):
            gain = np.where((b == a[:, i : i + 1]) & b_in & a_in[:, i : i + 1], MATCH, OTHER).astype(np.int32)
            new = np.zeros_like(row)
            new[:, 1:] = np.maximum(np.maximum(row[:, :-1] + gain, row[:, 1:] + GAP), 0)
            row = np.maximum.accumulate(new + slope, axis=1) - slope
            at = row.argmax(axis=1)
            now = row[np.arange(len(part)), at]
            better = now > top
            top[better], where[better] = now[better], at[better]
        best[part], end[part] = top, where
    return best, end


def contaminations(finder: Finder, texts: list[bytes]) -> list[tuple[int, int, float, int, int]]:
    """(text, item, similarity, seed hits, word where the best alignment ends) from the threshold on."""
    doc, h, _, _ = common.word_hashes(texts, common.PUNCTUATED)
    if not len(h) or not len(finder.key):
        return []
    at, key = finder.hits(doc, h)
    if not len(at):
        return []
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    items = finder.items
    # hits of an item whose predicted beginnings lie in one stretch of its length, counted block by block
    by_place = np.argsort(at, kind="stable")
    at, key = at[by_place], key[by_place]
    total = np.cumsum(finder.first[key + 1] - finder.first[key])
    n_stretch = len(h) + 2  # stretches of an item, whatever its length
    held, low = [], 0
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + BLOCK, side="right")))
        times = finder.first[key[low:high] + 1] - finder.first[key[low:high]]
        place = np.repeat(at[low:high], times)
        ahead = np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
        entry = finder.order[np.repeat(finder.first[key[low:high]], times) + ahead]
        item, d = items.item[entry], doc[place]
        stretch = (place - cut[d] - items.at[entry]) // items.size[item]
        held.append(np.unique((d * len(items.size) + item) * n_stretch + stretch + 1, return_counts=True))
        low = high
    group, which = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
    n = np.bincount(which, np.concatenate([c for _, c in held])).astype(np.int64)
    # the beginnings that the pairs of a copy predict differ by its length at most: they lie in two neighbouring stretches
    both = n.copy()
    both[:-1] += np.where(group[1:] == group[:-1] + 1, n[1:], 0)
    item = group // n_stretch % len(items.size)
    enough = both >= items.need[item]
    group, item, both = group[enough], item[enough], both[enough]
    if not len(group):
        return []
    d, stretch = group // n_stretch // len(items.size), group % n_stretch - 1
    size = items.size[item]
    pad = size // 2 + 2
    lo = np.maximum(cut[d], cut[d] + stretch * size - pad)
    hi = np.minimum(cut[d + 1], cut[d] + (stretch + 3) * size + pad)
    best: dict[tuple[int, int], tuple[int, int, float, int, int]] = {}
    total, low = np.cumsum(hi - lo), 0
    while low < len(lo):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + BLOCK, side="right")))
        part = np.arange(low, high)
        part = part[_shared_words(finder, h, item[part], lo[part], hi[part]) >= THRESHOLD * size[part]]
        score, end = align([items.words[k] for k in item[part]], [h[a:z] for a, z in zip(lo[part], hi[part])])
        for g, s, e in zip(part, score, end):
            similarity = s / (MATCH * size[g])
            if similarity >= THRESHOLD and similarity > best.get((d[g], item[g]), (0, 0, 0.0))[2]:
                best[d[g], item[g]] = (int(d[g]), int(item[g]), float(similarity), int(both[g]), int(lo[g] + e - cut[d[g]]))
        low = high
    return list(best.values())


def _shared_words(finder: Finder, h: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Words that each window has in common with its item, repeated ones as often as both hold them."""
    items, size = finder.items, hi - lo
    window = np.repeat(np.arange(len(lo)), size)
    place = np.arange(len(window)) - np.repeat(np.cumsum(size) - size, size) + lo[window]
    w = _of_item(h[place], item[window])
    known = np.flatnonzero(finder.word_sieve[(w & np.uint64((1 << 22) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(items.word, w[known]), len(items.word) - 1)
    same = items.word[at] == w[known]
    pair, n = np.unique(window[known[same]] * len(items.word) + at[same], return_counts=True)
    return np.bincount(pair // len(items.word), np.minimum(n, items.times[pair % len(items.word)]), len(lo))


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    rows = ((r[0], (r[1] or "").encode()) for r in benchmark.selectExpr("cast(item_id as long) item_id", "text").orderBy("item_id", "text").toLocalIterator())
    return common.chunks(rows, lambda r: len(r[1]) + 8, SLICE_BYTES)


def _items(rows: list[tuple[int, bytes]]) -> Items:
    return Items([(i, t.translate(_PLAIN)) for i, t in rows])


_PLAIN = bytes(0x20 if common.PUNCTUATED[b] else b for b in range(256))


def finders(docs: DataFrame, benchmark: DataFrame) -> Iterator[Finder]:
    """One finder for each slice of the benchmark, with the seeds that are rarest in docs."""
    for rows in _slices(benchmark):
        items = _items(rows)
        if not len(items.gram):
            continue
        every = Finder(items)
        shared = docs.sparkSession.sparkContext.broadcast(every)  # bounded by SLICE_BYTES

        def count(batches, shared=shared):
            held = np.zeros(len(shared.value.key), np.int64)
            for batch in batches:
                for part in common.chunks((t for t in common.binary(batch.column(0)) if t), len):
                    doc, h, _, _ = common.word_hashes(part, common.PUNCTUATED)
                    np.add.at(held, shared.value.hits(doc, h)[1], 1)
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["key", "n"])

        held = np.zeros(len(every.key), np.int64)
        for key, n in docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").sum("n").toLocalIterator():
            held[key] = n
        items.thin(held[np.searchsorted(every.key, items.gram)])
        if not len(items.gram):
            continue
        yield Finder(items)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, seed_hits, end_word) for each document and item that it holds a copy of."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    schema = "doc_id long, item_id long, similarity double, seed_hits long, end_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for finder in finders(docs, benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(finder)  # bounded by SLICE_BYTES

        def run(batches, shared=shared):
            ids = shared.value.items.id
            for batch in batches:
                for part in common.chunks(zip(batch.column(0).to_pylist(), common.binary(batch.column(1))), lambda r: len(r[1] or b"")):
                    found = contaminations(shared.value, [r[1] or b"" for r in part])
                    c = list(zip(*((part[d][0], ids[k], s, n, e) for d, k, s, n, e in found))) or [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.float64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64())], ["doc_id", "item_id", "similarity", "seed_hits", "end_word"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no copy of an item."""
    out = docs
    for finder in finders(docs, benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(finder)  # bounded by SLICE_BYTES

        def keep(texts, shared=shared):
            bad = {d for d, *_ in contaminations(shared.value, texts)}
            return [k not in bad for k in range(len(texts))]

        out = common.filter_texts(out, keep)
    return out
