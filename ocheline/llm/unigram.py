"""SentencePiece unigram encoding by Viterbi over a double-array trie, and decoding.

Pieces come from a SentencePiece model file; they are never trained here. The
file may hold merge ranks instead of log probabilities; `zipf_scores` turns
the order of the pieces into log scores. Text is taken as it is (identity
normaliser): a space is put in front, spaces are the whitespace marker, and a
character that no piece covers is spelt in byte pieces.

Where no piece holds a marker after its start, a best path never needs a piece
across "text, then space", so the path of a text is that of its
space-separated chunks. Distinct chunks of a batch go through Viterbi in step,
one numpy operation for all of them.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocheline.llm import text as tx
from ocheline.llm.chunks import ChunkEncoder, gather

MARKER = "▁"
# Fixed values of the model file's format: kinds of piece, and what an
# uncovered character costs below the lowest score.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
# Longer chunks are walked one by one instead of in step.
STEP_BYTES = 96


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        if key & 7 == 0:
            value, at = _varint(raw, at)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def read_pieces(raw: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of a serialised SentencePiece model, in the order of the ids."""
    found = []
    for field, value in _fields(raw):
        if field == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            found.append((piece[1].decode(), score, piece.get(3, NORMAL)))
    return found


def zipf_scores(pieces: list[tuple[str, float, int]]) -> list[float]:
    """Log probabilities by Zipf's law from the order of the pieces' scores.

    The r-th best ordinary piece (ties: smaller id first) gets 1 / (r * H).
    """
    order = sorted(
        (k for k, p in enumerate(pieces) if p[2] in (NORMAL, USER)), key=lambda k: (-pieces[k][1], k)
    )
    total = math.log(sum(1 / r for r in range(1, len(order) + 1)) or 1.0)
    scores = [0.0] * len(pieces)
    for r, k in enumerate(order, 1):
        scores[k] = float(np.float32(-math.log(r) - total))
    return scores


@dataclass(frozen=True)
class Trie:
    """Double array: the child of node s by byte c is t = base[s] + c if check[t] = s."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray


def double_array(keys: dict[bytes, int]) -> Trie:
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, number in keys.items():
        node = 0
        for byte in key:
            if byte not in children[node]:
                children[node][byte] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][byte]
        ends[node] = number
    # A few places are tried among the gaps, else the children go to the end.
    size = 4 * len(children) + 4096
    base, check, piece = (np.full(size, v, np.int32) for v in (0, -1, -1))
    taken = bytearray(size)
    taken[0] = 1
    free, end, stack = 1, 1, [(0, 0)]
    while stack:
        node, slot = stack.pop()
        piece[slot] = ends[node]
        wanted = list(children[node])
        if not wanted:
            continue
        while taken[free]:
            free += 1
        low = min(wanted)
        tries = range(max(1, free - low), max(1, free - low) + 64)
        start = next((s for s in tries if not any(taken[s + c] for c in wanted)), max(end - low, 1))
        end = max(end, start + max(wanted) + 1)
        if end + 512 > size:
            base, check, piece = (
                np.concatenate([a, np.full(size, v, np.int32)])
                for a, v in ((base, 0), (check, -1), (piece, -1))
            )
            taken.extend(bytes(size))
            size *= 2
        base[slot] = start
        for byte in wanted:
            taken[start + byte] = 1
            check[start + byte] = slot
            stack.append((children[node][byte], start + byte))
    cut = end + 512
    base, check, piece = base[:cut], check[:cut], piece[:cut]
    return Trie(base, check, piece)


@dataclass(frozen=True)
class Unigram:
    trie: Trie
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown_id: int
    unknown_score: float
    splits: bool
    spelt: np.ndarray
    spelt_starts: np.ndarray

    @staticmethod
    def build(pieces: list[tuple[str, float, int]], scores: list[float] | None = None) -> Unigram:
        """`scores` default to those stored with the pieces."""
        scores = [p[1] for p in pieces] if scores is None else scores
        keys, byte_ids, unknown_id = {}, np.full(256, -1, np.int64), 0
        spelt = []
        for k, (piece, _, kind) in enumerate(pieces):
            raw = piece.replace(MARKER, " ").encode()
            if kind in (NORMAL, USER):
                keys[raw] = k
            elif kind == BYTE:
                byte_ids[int(piece[3:5], 16)] = k
                raw = bytes([int(piece[3:5], 16)])
            elif kind == UNKNOWN:
                unknown_id, raw = k, b" \xe2\x81\x87 "
            else:
                raw = b""
            spelt.append(raw)
        lowest = min((scores[k] for k in keys.values()), default=0.0)
        return Unigram(
            double_array(keys),
            np.array(scores, np.float64),
            byte_ids,
            unknown_id,
            lowest - UNKNOWN_PENALTY,
            not any(b" " in key.lstrip(b" ") for key in keys),
            np.frombuffer(b"".join(spelt), np.uint8),
            np.concatenate([[0], np.cumsum([len(x) for x in spelt])]),
        )

    def _unknown(self, raw: bytes) -> list[int]:
        if (self.byte_ids[list(raw)] < 0).any():
            return [self.unknown_id]
        return self.byte_ids[list(raw)].tolist()

    def path(self, chunk: bytes) -> list[int]:
        """The best pieces of one chunk; of equal paths the one whose last piece is longest."""
        size = len(chunk)
        best, back = [-math.inf] * (size + 1), [(0, -1)] * (size + 1)
        best[0] = 0.0
        base, check, piece, scores = (self.trie.base, self.trie.check, self.trie.piece, self.scores)
        for s in range(size):
            if best[s] == -math.inf or chunk[s] & 0xC0 == 0x80:
                continue
            width = 1
            while s + width < size and chunk[s + width] & 0xC0 == 0x80:
                width += 1
            node, single = 0, False
            for e in range(s, size):
                child = base[node] + chunk[e]
                if check[child] != node:
                    break
                node = child
                k = piece[node]
                if k >= 0:
                    single |= e + 1 - s == width
                    if (score := best[s] + scores[k]) > best[e + 1]:
                        best[e + 1], back[e + 1] = score, (s, int(k))
            if not single and best[s] + self.unknown_score > best[s + width]:
                best[s + width], back[s + width] = best[s] + self.unknown_score, (s, -1)
        out, end = [], size
        while end:
            start, k = back[end]
            out.append([k] if k >= 0 else self._unknown(chunk[start:end]))
            end = start
        return [k for ids in reversed(out) for k in ids]

    def paths(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """`path` of many chunks, short ones in step; (all ids, number of ids of each)."""
        ids: list[list[int]] = [[]] * len(chunks)
        sizes = np.array([len(c) for c in chunks])
        for low, high in ((0, 8), (8, 12), (12, 20), (20, 40), (40, STEP_BYTES)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for s in range(0, len(rows), 8_000):
                part = rows[s : s + 8_000]
                for k, found in zip(part, self._in_step([chunks[r] for r in part], high)):
                    ids[k] = found
        for k in np.flatnonzero(sizes > STEP_BYTES):
            ids[k] = self.path(chunks[k])
        lengths = np.array([len(x) for x in ids], np.int64)
        return np.array([k for x in ids for k in x], np.uint32), lengths

    def _in_step(self, chunks: list[bytes], high: int) -> list[list[int]]:
        n, trie = len(chunks), self.trie
        sizes = np.array([len(c) for c in chunks])
        text = np.frombuffer(b"".join(c.ljust(high + 1, b"\0") for c in chunks), np.uint8)
        text = text.reshape(n, high + 1).astype(np.int32)
        starts_char = (text & 0xC0) != 0x80
        best = np.full((n, high + 1), -np.inf)
        best[:, 0] = 0.0
        from_, by = np.zeros((n, high + 1), np.int16), np.full((n, high + 1), -1, np.int32)
        for s in range(high):
            rows = np.flatnonzero((sizes > s) & starts_char[:, s] & (best[:, s] > -np.inf))
            if not len(rows):
                continue
            here = best[rows, s]
            width = np.ones(len(rows), np.int64)
            for more in (1, 2, 3):
                inside = (width == more) & (s + more < sizes[rows])
                width[inside] += ~starts_char[rows[inside], min(s + more, high)]
            single = np.zeros(len(rows), bool)
            live, node = np.arange(len(rows)), np.zeros(len(rows), np.int32)
            for e in range(s, high):
                child = trie.base[node] + text[rows[live], e]
                on = (trie.check[child] == node) & (sizes[rows[live]] > e)
                live, node = live[on], child[on]
                if not len(live):
                    break
                k = trie.piece[node]
                ends = k >= 0
                if not ends.any():
                    continue
                at, k = live[ends], k[ends]
                single[at] |= width[at] == e + 1 - s
                score = here[at] + self.scores[k]
                better = score > best[rows[at], e + 1]
                at, k = rows[at[better]], k[better]
                best[at, e + 1], from_[at, e + 1], by[at, e + 1] = score[better], s, k
            bare = np.flatnonzero(~single)
            to, score = s + width[bare], here[bare] + self.unknown_score
            better = score > best[rows[bare], to]
            at, to = rows[bare[better]], to[better]
            best[at, to], from_[at, to], by[at, to] = score[better], s, -1
        out: list[list[int]] = [[] for _ in range(n)]
        at, end = np.arange(n), sizes.copy()
        while len(at):
            k, s = by[at, end], from_[at, end].astype(np.int64)
            for row, piece, a, b in zip(at.tolist(), k.tolist(), s.tolist(), end.tolist()):
                out[row].extend([piece] if piece >= 0 else reversed(self._unknown(chunks[row][a:b])))
            at, end = at[s > 0], s[s > 0]
        return [x[::-1] for x in out]

    def encode(self, column: pa.Array, encoder: ChunkEncoder) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); null and empty texts have none."""
        filled = column.fill_null("").cast(pa.large_string())
        empty = pc.equal(filled, "").to_numpy(zero_copy_only=False)
        # The marker itself counts as a space, as it does in the library.
        spaced = pc.replace_substring(filled, MARKER, " ")
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), spaced, pa.scalar("", pa.large_string()))
        data, offsets = tx.flat(pc.if_else(pa.array(empty), pa.scalar("", pa.large_string()), spaced))
        if self.splits:
            space = data == 0x20
            borders = np.flatnonzero(space[1:] & ~space[:-1]) + 1
            borders = np.union1d(borders, offsets)
        else:
            borders = np.unique(offsets)
        return encoder.ids(data, borders, offsets)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts, without the space in front; an unknown piece is spelt as such."""
        starts = self.spelt_starts[ids]
        lengths = self.spelt_starts[ids + 1] - starts
        data = gather(self.spelt, starts, lengths).tobytes()
        sums = np.concatenate([[0], np.cumsum(lengths)])
        ends = sums[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [
            data[a + (data[a : a + 1] == b" ") : b] if b > a else b"" for a, b in zip(ends[:-1], ends[1:])
        ]


def load(model_file: str) -> Unigram:
    """The pieces of a SentencePiece model file on the driver, with Zipf scores."""
    with open(model_file, "rb") as f:
        pieces = read_pieces(f.read())
    return Unigram.build(pieces, zipf_scores(pieces))


def with_ids(
    docs: DataFrame, model: Unigram, text_col: str = "text", ids_col: str = "piece_ids"
) -> DataFrame:
    """`docs` with the piece ids of each whole text; an existing `ids_col` is replaced.

    Null and empty texts have an empty list. Every other text has at least one id.
    """
    rest = docs.drop(ids_col)
    sent = rest.sparkSession.sparkContext.broadcast(model)  # the vocabulary, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(sent.value.paths)
        for part in tx.pieces(batches, text_col):
            ids, counts = sent.value.encode(part.column(text_col), encoder)
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, ids_col])

    schema = T.StructType(
        [*rest.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))]
    )
    return rest.mapInArrow(run, schema)


def with_text(
    coded: DataFrame, model: Unigram, ids_col: str = "piece_ids", text_col: str = "decoded"
) -> DataFrame:
    """`coded` with the text that each list of ids spells; an existing `text_col` is replaced.

    A null or empty list spells the empty text. Bytes that are not UTF-8 become U+FFFD.
    """
    rest = coded.drop(text_col)
    sent = rest.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(s, 256)
                lists = part.column(ids_col)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                texts = [x.decode("utf-8", "replace") for x in sent.value.decode(ids, counts)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], [*part.schema.names, text_col]
                )

    schema = T.StructType([*rest.schema.fields, T.StructField(text_col, T.StringType())])
    return rest.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: Unigram, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, n_pieces, ids_crc32, decoded_crc32, round_trip) of each whole text.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers; round_trip
    tells whether the decoded ids are the text again (null: the empty text).
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Both ways in one pass over the texts, with one Python worker for a task.
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(sent.value.paths)
        for part in tx.pieces(batches, "text", 1 << 20):
            ids, counts = sent.value.encode(part.column("text"), encoder)
            data, offsets = tx.flat(part.column("text"))
            raw, ends = data.tobytes(), np.cumsum(counts)
            out = [[], [], []]
            for text, s, e, a, b in zip(
                sent.value.decode(ids.astype(np.int64), counts),
                (ends - counts).tolist(),
                ends.tolist(),
                offsets[:-1].tolist(),
                offsets[1:].tolist(),
            ):
                out[0].append(zlib.crc32(ids[s:e].astype("<u4").tobytes()))
                out[1].append(zlib.crc32(text))
                out[2].append(text == raw[a:b])
            kinds = (pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(counts), *map(pa.array, out, kinds)],
                ["id", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip"],
            )

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(
        run, f"id {kind}, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean"
    ).withColumnRenamed("id", id_col)
