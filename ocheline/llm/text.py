"""Texts of an Arrow batch as one byte array, cut into words by numpy.

Null counts as the empty text everywhere. All helpers work on whole texts; a
batch is cut between rows only, so memory follows the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

PIECE_BYTES = 2 << 20

# ASCII white space, and the bytes of an alphanumeric word (all
# bytes of non-ASCII characters belong to words).
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def pieces(
    batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `most` bytes of text, one row at least."""
    for batch in batches:
        _, offsets = flat(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row)
            row = end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each starts (one more: the end)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, ends, data = column.buffers()
    if ends is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass(frozen=True)
class Words:
    """Words of some texts: `data[starts[i]:ends[i]]`; text t has words first[t]:first[t+1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, none across a text's border."""
    size = len(inside)
    edges = offsets[(offsets > 0) & (offsets < size)]
    before = np.zeros(size, bool)
    before[1:] = inside[:-1]
    before[edges] = False
    after = np.zeros(size, bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> Words:
    """Maximal runs of the bytes that `members` marks."""
    starts, ends = spans(members[data], offsets)
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def joined(found: Words) -> Words:
    """The same words with one space after each, so that n consecutive words are one slice."""
    lengths = found.ends - found.starts
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths - 1
    total = int(ends[-1]) if len(ends) else 0
    out = np.full(total, 0x20, np.uint8)
    inside = np.ones(total, bool)
    if total:
        inside[ends - 1] = False
        source = np.zeros(len(found.data) + 1, np.int8)
        source[found.starts] += 1  # no two words start or end at one place
        source[found.ends] -= 1
        out[inside] = found.data[np.cumsum(source[:-1], dtype=np.int8).view(bool)]
    return Words(out, starts, ends - 1, found.first)


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
# Words beyond this length are hashed one by one.
_LONG_WORD = 512


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _followed(h: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The hash of what `h` is the hash of, followed by `value`; not linear in either."""
    return mixed((h ^ (h >> np.uint64(29))) * _FACTOR + value)


def members(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes are among the sorted ones of `known`."""
    if not len(known):
        return np.zeros(len(values), bool)
    # Most others are told by a table of some of their bits.
    bits = np.uint64(max(10, min(24, int(len(known)).bit_length() + 3)))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    table = np.zeros(1 << int(bits), bool)
    table[known & mask] = True
    out = table[values & mask]
    some = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(known, values[some]), len(known) - 1)
    out[some] = known[place] == values[some]
    return out


def word_hashes(found: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight at a time."""
    lengths = (found.ends - found.starts).astype(np.uint64)
    out = mixed(lengths + np.uint64(seed) * _FACTOR)
    padded = np.concatenate([found.data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(found.data) + 1, "<u8", padded, strides=(1,))
    rows = np.flatnonzero(lengths <= _LONG_WORD)
    at, left = found.starts[rows], lengths[rows]
    while len(rows):
        keep = np.where(left < 8, (np.uint64(1) << (np.uint64(8) * np.minimum(left, np.uint64(7)))) - np.uint64(1), ~np.uint64(0))
        out[rows] = _followed(out[rows], mixed(lanes[at] & keep))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - np.uint64(8)
    for k in np.flatnonzero(lengths > _LONG_WORD):
        raw = found.data[found.starts[k] : found.ends[k]].tobytes()
        out[k] = xxhash.xxh3_64_intdigest(raw, seed)
    return out


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each `size` consecutive values, whatever text they are of."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, taken, width, wide = None, 0, 1, mixed(hashes)
    while True:
        if size & width:  # put together from windows whose sizes are powers of two
            out = wide if out is None else _followed(out[: len(wide) - taken], wide[taken:][: len(out)])
            taken += width
        if 2 * width > size:
            return out[:n]
        wide = _followed(wide[:-width], wide[width:])
        width *= 2


def run_hashes(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each short run hashes[start:start + length]."""
    out = mixed(lengths.astype(np.uint64))
    for k in range(int(lengths.max(initial=0))):
        rows = np.flatnonzero(lengths > k)
        out[rows] = _followed(out[rows], hashes[starts[rows] + k])
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the runs."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.subtract.at(steps, starts + lengths, 1)
    return np.cumsum(steps[:-1]) > 0


def packed(batch: pa.RecordBatch) -> bytes:
    """A batch as compressed bytes, to travel through a shuffle as one value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(
        sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")
    ) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(raw: bytes) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_stream(raw) as reader:
        yield from reader
