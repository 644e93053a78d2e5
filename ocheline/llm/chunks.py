"""Encode the distinct chunks of texts once and put the ids of whole texts together.

A tokenizer whose pieces never cross certain borders gives the ids of a text as
those of its chunks, one after the other. Texts repeat their words, so each
task encodes a chunk only when it first sees it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

# A task forgets its chunks beyond this number, so that its memory is bounded.
MAX_CHUNKS = 400_000

Encode = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices pool[start:start + length], end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class ChunkEncoder:
    """Ids of chunks, by an `encode` that maps chunks to (all ids, number of ids of each)."""

    def __init__(self, encode: Encode, most: int = MAX_CHUNKS) -> None:
        self._encode, self._most = encode, most
        self._forget()

    def _forget(self) -> None:
        self._known: dict[bytes, int] = {}
        self._pool = np.zeros(1 << 16, np.uint32)
        self._used = 0
        self._starts = np.zeros(1 << 16, np.int64)
        self._lengths = np.zeros(1 << 16, np.int64)

    def _learn(self, chunks: list[bytes]) -> None:
        ids, lengths = self._encode(chunks)
        n, m = len(self._known), len(self._known) + len(chunks)
        while self._used + len(ids) > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        while m > len(self._starts):
            self._starts = np.concatenate([self._starts, np.zeros_like(self._starts)])
            self._lengths = np.concatenate([self._lengths, np.zeros_like(self._lengths)])
        self._pool[self._used : self._used + len(ids)] = ids
        ends = self._used + np.cumsum(lengths)
        self._starts[n:m], self._lengths[n:m] = ends - lengths, lengths
        self._used += len(ids)
        for k, chunk in enumerate(chunks):
            self._known[chunk] = n + k

    def ids(
        self, data: np.ndarray, borders: np.ndarray, offsets: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each).

        Chunks are data[borders[i]:borders[i + 1]]; the texts' `offsets` are borders too.
        """
        chunks = len(borders) - 1
        if chunks <= 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        coded = pa.Array.from_buffers(
            pa.large_binary(),
            chunks,
            [None, pa.py_buffer(np.ascontiguousarray(borders, np.int64)), pa.py_buffer(data)],
        ).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self._known) > self._most:
            self._forget()
        if new := [c for c in distinct if c not in self._known]:
            self._learn(new)
        known = np.fromiter(map(self._known.__getitem__, distinct), np.int64, len(distinct))
        which = known[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self._lengths[which]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        at = np.searchsorted(borders, offsets)
        return gather(self._pool, self._starts[which], lengths), np.diff(sums[at])
