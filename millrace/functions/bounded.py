"""A queue that keeps the greatest items only."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Bounded:
    """The size greatest items by key; of equal ones those that came first. Over tables see greatest()."""

    def __init__(self, size: int, key: Callable = lambda x: x):
        self.size, self.key, self._heap, self._n = size, key, [], 0

    def add(self, item) -> Bounded:
        self._n += 1
        entry = (self.key(item), -self._n, item)
        if len(self._heap) < self.size:
            heapq.heappush(self._heap, entry)
        elif self._heap and entry[:2] > self._heap[0][:2]:
            heapq.heapreplace(self._heap, entry)
        return self

    def extend(self, items: Iterable) -> Bounded:
        for x in items:
            self.add(x)
        return self

    def __len__(self) -> int:
        return len(self._heap)

    def __iter__(self) -> Iterator:
        """From the greatest to the least."""
        return (x for _, _, x in sorted(self._heap, key=lambda e: e[:2], reverse=True))

    def clear(self) -> None:
        self._heap.clear()


def greatest(batches: Iterable[pa.RecordBatch], size: int, key: str, place: str, value: str) -> Iterator[pa.RecordBatch]:
    """Of each batch the rows that no queue of size rows of their key leaves out: greatest value first, then least place.

    NaN is the greatest value, null the least of all. One sort of the batch holds the queues of all its keys; the queues
    of several batches or tasks still have to be merged, by row_number.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        code = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        rank = pc.rank(batch.column(value), sort_keys="descending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
        # null is NaN in numpy, too
        nan = np.isnan(batch.column(value).to_numpy(zero_copy_only=False).astype(float))
        rank[nan & batch.column(value).is_valid().to_numpy(zero_copy_only=False)] = 0
        second = pc.rank(batch.column(place), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((second, rank, code))
        c = code[order]
        first = np.searchsorted(c, c)
        yield batch.take(pa.array(np.sort(order[np.arange(len(c)) - first < size])))
