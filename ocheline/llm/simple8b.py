"""Token ids of a corpus in Simple-8b blocks, in the order of the document ids.

A word has 64 bits: a selector of 4, and 60 that hold as many ids as fit at one
width. Ids too large for that are escaped: the word's payload is all ones and
the next word is the id. Ids are cut into blocks of BLOCK; no word crosses the
border of a block, and the first word of each block is noted, so blocks can be
read on their own and all words of one selector are decoded at once.

A file's record (one row of a Parquet file, so that Spark commits it) has the
ids of a run of documents: `doc_ids`, `lengths`, and `payload`, which is

    "S8B1", number of ids, number of blocks (unsigned 64 bits, little-endian),
    the first word of each block and the number of words (unsigned 32 bits),
    the words (unsigned 64 bits).

`part` and `first` say where the record stands: the number of the ordered part
of the corpus, and how many ids of that part come before.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ocheline.llm import text as tx
from ocheline.llm.chunks import ChunkEncoder, gather

# How many ids of which width each selector packs.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
MAGIC = b"S8B1"
BLOCK = 1024
ESCAPE = np.uint64((1 << 60) - 1)
# About so much text makes one ordered part of the corpus.
PART_BYTES = 64 << 20
# Different chunks that a task remembers.
MOST_CHUNKS = 1_000_000


def _widths(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits that each value needs, 60 for escaped ones; and which those are."""
    bounds = np.uint64(1) << np.arange(60, dtype=np.uint64)
    if values.max(initial=0) < 1 << 16:
        small = np.searchsorted(bounds[:16], np.arange(1 << 16), "right").astype(np.uint8)
        return small[values.astype(np.uint16)], np.zeros(values.shape, bool)
    width = np.searchsorted(bounds, values.ravel(), "right").reshape(values.shape).astype(np.uint8)
    large = values >= ESCAPE
    width[large] = 60
    return width, large


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block and the number of words) of unsigned 64-bit ids."""
    total = len(ids)
    blocks = -(-total // BLOCK)
    values = np.zeros((blocks, BLOCK + 240), np.uint64)
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[:total] = ids
    values[:, :BLOCK] = padded.reshape(blocks, BLOCK)
    width, large = _widths(values)
    selector = np.full((blocks, BLOCK), 15, np.uint8)
    most, size = width, 1
    for s in range(14, -1, -1):
        step = int(COUNTS[s])
        while size < step:  # the greatest width of `size` ids from each place on
            add = min(size, step - size)
            most = np.maximum(most[:, : most.shape[1] - add], most[:, add:])
            size += add
        np.copyto(selector, s, where=most[:, :BLOCK] <= WIDTHS[s])
    sizes = np.minimum(BLOCK, total - np.arange(blocks) * BLOCK)
    row, at, starts = np.arange(blocks), np.zeros(blocks, np.int64), []
    while len(row):
        starts.append(row * BLOCK + at)
        at = at + COUNTS[selector[row, at]]
        live = at < sizes[row]
        row, at = row[live], at[live]
    start = np.sort(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
    block, place = start // BLOCK, start % BLOCK
    chosen = selector[block, place]
    escaped = large[block, place]
    words, flat = chosen.astype(np.uint64) << np.uint64(60), values.ravel()
    for s in range(2, 16):
        rows = np.flatnonzero(chosen == s)
        at, word = block[rows] * values.shape[1] + place[rows], words[rows]
        for k in range(int(COUNTS[s])):
            word |= np.minimum(flat[at + k], ESCAPE) << np.uint64(k * int(WIDTHS[s]))
        words[rows] = word
    where = np.arange(len(words)) + np.cumsum(escaped) - escaped
    out = np.zeros(len(words) + int(escaped.sum()), np.uint64)
    out[where] = words
    out[where[escaped] + 1] = values[block[escaped], place[escaped]]
    first = where[np.searchsorted(block, np.arange(blocks))] if blocks else where
    return out, np.append(first, len(out)).astype(np.uint32)


def unpack(words: np.ndarray, first: np.ndarray, total: int) -> np.ndarray:
    """The ids that `pack` was given."""
    if not total:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    payload = words & ESCAPE
    # A word behind an escape is an id, unless that escape is itself such an id.
    escape = (selector == 15) & (payload == ESCAPE)
    if escape.any():
        raw = np.zeros(len(words), bool)
        for k in np.flatnonzero(escape):
            if not raw[k]:
                raw[k + 1] = True
        escape &= ~raw
    else:
        raw = escape
    block = np.searchsorted(first, np.arange(len(words)), "right") - 1
    counts = np.where(raw, 0, COUNTS[selector])
    sums = np.cumsum(counts) - counts
    start = block * BLOCK + sums - sums[first[block]]
    end = np.minimum((block + 1) * BLOCK, total)
    out = np.zeros(total, np.uint64)
    for s in range(2, 16):
        rows = np.flatnonzero((selector == s) & ~raw)
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(int(COUNTS[s])):
            rows = rows[start[rows] + k < end[rows]]
            out[start[rows] + k] = payload[rows] >> np.uint64(k * int(WIDTHS[s])) & mask
    out[start[escape]] = words[np.flatnonzero(escape) + 1]
    return out


def to_payload(ids: np.ndarray) -> bytes:
    words, first = pack(ids.astype(np.uint64))
    head = np.array([len(ids), len(first) - 1], "<u8").tobytes()
    return MAGIC + head + first.astype("<u4").tobytes() + words.astype("<u8").tobytes()


def from_payload(raw: bytes) -> np.ndarray:
    if raw[:4] != MAGIC:
        raise ValueError("not a Simple-8b record")
    total, blocks = (int(x) for x in np.frombuffer(raw, "<u8", 2, 4))
    first = np.frombuffer(raw, "<u4", blocks + 1, 20).astype(np.int64)
    return unpack(np.frombuffer(raw, "<u8", -1, 20 + 4 * (blocks + 1)), first, total)


# Kinds of bytes for the borders of a byte-level BPE that splits words, numbers,
# other characters and white space apart.
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_ASCII = np.arange(256) < 0x80


def borders(data: np.ndarray, offsets: np.ndarray, special: tuple[bytes, ...] = ()) -> np.ndarray:
    """Places that no token of such a BPE crosses, all texts' ends among them.

    There are none inside or beside the strings of `special` tokens, which the
    library tells before it splits anything else, so a chunk holds them whole
    with what they touch.

    Only what is certain is taken: ASCII and the letters of Latin-1. A token
    starts at a single space between two visible characters, where letters end
    and an ASCII character that is none begins, where letters begin after a
    mark other than an apostrophe, and after a single line end.
    """
    n = len(data)
    if n < 2:
        return np.unique(offsets)
    letter = _LETTER[data]
    # Letters of two bytes: C3 80 to C3 BF but for the signs of times and division.
    second = np.zeros(n, bool)
    second[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7) & (data[1:] >= 0x80)
    starts = letter.copy()
    starts[:-1] |= second[1:]
    ends = letter | second
    mark = _VISIBLE[data] & ~letter & (data != 0x27)
    seen_end, seen_start = ends | _VISIBLE[data], starts | _VISIBLE[data]
    space, line = data == 0x20, data == 0x0A
    cut = np.zeros(n + 1, bool)
    cut[1 : n - 1] = space[1:-1] & seen_end[:-2] & seen_start[2:]
    cut[1:n] |= ends[:-1] & _ASCII[data[1:]] & ~letter[1:]
    cut[1:n] |= mark[:-1] & starts[1:]
    cut[2:n] |= line[1:-1] & seen_end[:-2] & seen_start[2:]
    raw = data.tobytes() if special else b""
    for token in special:
        at = raw.find(token)
        while at >= 0:
            cut[at : at + len(token) + 1] = False
            at = raw.find(token, at + 1)
    cut[offsets] = True
    return np.flatnonzero(cut)


def special_strings(tokenizer_json: str) -> tuple[bytes, ...]:
    """The strings of the tokens that were added to the vocabulary."""
    return tuple(t["content"].encode() for t in json.loads(tokenizer_json)["added_tokens"])


def bpe_encoder(tokenizer_json: str, most: int = MOST_CHUNKS) -> ChunkEncoder:
    """Encode chunks as the tokenizers library does by default: a special token's string is that token."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_str(tokenizer_json)
    special = [t.decode() for t in special_strings(tokenizer_json)]
    (line,) = tokenizer.encode("\n", add_special_tokens=False).ids

    def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [c.decode() for c in chunks]
        # Chunks without white space inside may stand in one text, a line each.
        plain = np.fromiter(
            (t[1:].isalpha() and (t[0] == " " or t[0].isalpha()) or _one_word(t) for t in texts),
            bool,
            len(texts),
        )
        for token in special:
            plain &= np.fromiter((token not in t for t in texts), bool, len(texts))
        lines, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        ids, lengths = [], np.zeros(len(texts), np.int64)
        for s in range(0, len(lines), 20_000):
            part = lines[s : s + 20_000].tolist()
            joined = ["\n".join([texts[k] for k in part[g : g + 200]]) for g in range(0, len(part), 200)]
            for found in tokenizer.encode_batch_fast(joined, add_special_tokens=False):
                ids += [found.ids, [line]]
        every = np.concatenate([np.zeros(0, np.uint32), *(np.array(i, np.uint32) for i in ids)])
        ends = np.flatnonzero(every == line)
        lengths[lines] = np.diff(ends, prepend=-1) - 1
        found = tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)
        others = [np.array(one.ids, np.uint32) for one in found]
        lengths[rest] = [len(o) for o in others]
        pool = np.concatenate([every[every != line], *others])
        order = np.concatenate([lines, rest])
        starts = np.zeros(len(texts), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return gather(pool, starts, lengths), lengths

    return ChunkEncoder(encode, most)


def _one_word(text: str) -> bool:
    """No white space but for a single space in front, and something behind that."""
    return len(text.split()) == 1 and text.lstrip(" ") == text.strip() and text[:2] != "  "


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer_json: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write the token ids of all whole texts to `path`, in ascending order of id.

    Every document ends with `end_id`; null and empty texts are that alone.
    Rows that repeat an id stand next to each other; rows without one come
    first. An empty table writes no record.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / PART_BYTES))
    ordered = (
        narrow.repartitionByRange(parts, "id")
        .sortWithinPartitions("id")
        .withColumn("part", F.spark_partition_id())
    )
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, first, special = bpe_encoder(sent.value), 0, special_strings(sent.value)
        for piece in tx.pieces(batches, "text"):
            data, offsets = tx.flat(piece.column("text"))
            ids, counts = encoder.ids(data, borders(data, offsets, special), offsets)
            ids = np.insert(ids, np.cumsum(counts), end_id)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("part")[:1],
                    pa.array([first], pa.int64()),
                    pa.ListArray.from_arrays([0, piece.num_rows], piece.column("id")),
                    pa.array([counts + 1], pa.list_(pa.int64())),
                    pa.array([to_payload(ids)], pa.binary()),
                ],
                ["part", "first", "doc_ids", "lengths", "payload"],
            )
            first += len(ids)

    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("first", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(narrow.schema["id"].dataType)),
            T.StructField("lengths", T.ArrayType(T.LongType())),
            T.StructField("payload", T.BinaryType()),
        ]
    )
    ordered.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(`id_col`, start, n_tokens, ids) of each document in the files at `path`.

    `start` counts the ids of all documents before it; `ids` are unsigned
    32-bit little-endian integers. Ids of 2^32 and more are an error.
    """
    records = spark.read.parquet(path)
    sums = (
        records.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
        .groupBy(F.col("part").alias("_part"))
        .agg(F.sum("n").alias("n"))
    )
    # One row for each ordered part, a few for each GB of text.
    before = sums.select(
        "_part",
        F.coalesce(
            F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    placed = records.join(F.broadcast(before), F.col("part") == F.col("_part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(n)[row] for n in batch.schema.names}
                ids = from_payload(one["payload"].as_py())
                if len(ids) and ids.max() >= 1 << 32:
                    raise ValueError("an id of more than 32 bits")
                lengths = one["lengths"].values.to_numpy(zero_copy_only=False)
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                each = pa.Array.from_buffers(
                    pa.large_binary(),
                    len(lengths),
                    [None, pa.py_buffer(np.append(0, 4 * ends).astype(np.int64)), pa.py_buffer(raw)],
                )
                start = one["_before"].as_py() + one["first"].as_py() + ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [one["doc_ids"].values, pa.array(start), pa.array(lengths), each.cast(pa.binary())],
                    ["id", "start", "n_tokens", "ids"],
                )

    schema = T.StructType(
        [
            T.StructField("id", records.schema["doc_ids"].dataType.elementType),
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    return (
        placed.select("first", "_before", "doc_ids", "lengths", "payload")
        .mapInArrow(run, schema)
        .withColumnRenamed("id", id_col)
    )
