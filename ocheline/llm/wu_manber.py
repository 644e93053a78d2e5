"""Benchmark decontamination by Wu-Manber multi-pattern search.

Words of ten in a row from a benchmark item (all of a shorter item) are the
patterns, spelt with one space before, between and after the words. Texts are
spelt the same way and searched as bytes: a table says for the block of bytes
under the cursor how far the cursor may jump without missing a pattern; where
the jump is zero, the patterns whose own block hashes alike are compared in
full. Many cursors, one for each stretch of text, move in step.

Patterns of very different length are searched in groups, since the shortest
bounds every jump.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocheline.llm import text as tx
from ocheline.llm.frames import unused
from ocheline.plans.storage import cut_lineage

WINDOW = 10
# A benchmark of more bytes is searched shard by shard; each is broadcast alone.
SHARD_BYTES = 4 << 20
TABLE_BITS = 20
STRETCH = 512
_MIX = np.uint64(0x9E3779B97F4A7C15)


def patterns(items: list[tuple[object, str | None]], size: int = WINDOW) -> dict[bytes, set[str]]:
    """Spelt windows and the ids (as text) of the items that hold them."""
    found: dict[bytes, set[str]] = {}
    for item, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        w = tx.words(tx.LOWER[raw], np.array([0, len(raw)]), tx.ALNUM)
        words = [w.data[s:e].tobytes() for s, e in zip(w.starts, w.ends)]
        for k in range(max(1, len(words) - size + 1) if words else 0):
            found.setdefault(b" " + b" ".join(words[k : k + size]) + b" ", set()).add(str(item))
    return found


def _blocks(data: np.ndarray, width: int) -> np.ndarray:
    """The `width` bytes from each position on as one number; `data` has 8 bytes to spare."""
    wide = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
    return wide & np.uint64((1 << 8 * width) - 1) if width < 8 else wide


def _slots(blocks: np.ndarray) -> np.ndarray:
    return ((blocks * _MIX) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Group:
    """Patterns searched together: `shift` by block, and the patterns of each final block."""

    patterns: list[bytes]
    least: int
    width: int
    shift: np.ndarray
    slots: np.ndarray
    heads: np.ndarray

    @staticmethod
    def build(found: list[bytes]) -> Group:
        least = min(map(len, found))
        width = min(8, least)
        text = np.frombuffer(b"".join(p[:least] for p in found) + bytes(8), np.uint8)
        starts = np.arange(len(found))[:, None] * least + np.arange(least - width + 1)
        slots = _slots(_blocks(text, width)[starts])
        shift = np.full(1 << TABLE_BITS, least - width + 1, np.int64)
        away = np.broadcast_to(np.arange(least - width, -1, -1), slots.shape)
        np.minimum.at(shift, slots.ravel(), away.ravel())
        order = np.argsort(slots[:, -1], kind="stable")
        ordered = [found[k] for k in order]
        heads = _blocks(np.frombuffer(b"".join(p[:8].ljust(8, b"\0") for p in ordered) + bytes(8), np.uint8), 8)
        return Group(
            ordered,
            least,
            width,
            shift.astype(np.int32),
            slots[order, -1],
            np.array(heads[: 8 * len(ordered) : 8]),
        )

    def search(self, data: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of all occurrences in the first `size` bytes of `data`."""
        if size < self.least:
            return
        blocks = _blocks(data, self.width)
        # A cursor stands on the first byte of the last block of a window.
        first, last = self.least - self.width, size - self.width
        at = np.arange(first, last + 1, STRETCH)
        stop = np.minimum(at + STRETCH, last + 1)
        hits = []
        while len(at):
            jump = self.shift[_slots(blocks[at])]
            hits.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        where = np.concatenate(hits)
        slot = _slots(blocks[where])
        low, high = np.searchsorted(self.slots, slot), np.searchsorted(self.slots, slot, "right")
        raw = data.tobytes()
        wide, mask = _blocks(data, 8), np.uint64((1 << 8 * min(8, self.least)) - 1)
        for s in range(0, len(where), 1 << 16):
            lo, n = low[s : s + (1 << 16)], (high - low)[s : s + (1 << 16)]
            ends = np.cumsum(n)
            which = np.repeat(lo - (ends - n), n) + np.arange(int(n.sum()))
            start = np.repeat(where[s : s + (1 << 16)] - first, n)
            same = ((wide[start] ^ self.heads[which]) & mask) == 0
            for b, k in zip(start[same].tolist(), which[same].tolist()):
                if raw.startswith(self.patterns[k], b) and b + len(self.patterns[k]) <= size:
                    yield b, k


@dataclass(frozen=True)
class Searcher:
    """All patterns of a shard in groups of like length, with their words and items."""

    groups: list[Group]
    items: dict[bytes, set[str]]

    @staticmethod
    def build(found: dict[bytes, set[str]]) -> Searcher:
        by_length: dict[int, list[bytes]] = {}
        for pattern in sorted(found):
            by_length.setdefault(min(5, int(math.log2(len(pattern)))), []).append(pattern)
        return Searcher([Group.build(p) for p in by_length.values()], found)

    def hits(self, w: tx.Words) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """First words, numbers of words, and patterns of all occurrences within one text."""
        data = np.concatenate([[0x20], w.data, np.zeros(8)]).astype(np.uint8)
        size = len(w.data) + 1
        at, which = [], []
        for group in self.groups:
            for start, k in group.search(data, size):
                at.append(start)
                which.append(group.patterns[k])
        begin = np.searchsorted(w.starts, np.array(at, np.int64))
        length = np.array([p.count(b" ") - 1 for p in which], np.int64)
        text = np.searchsorted(w.first, begin, "right")
        inside = begin + length <= w.first[np.minimum(text, len(w.first) - 1)]
        kept = [p for p, ok in zip(which, inside.tolist()) if ok]
        return begin[inside], length[inside], kept


def _shards(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The benchmark as (item, text, shard), and the number of shards."""
    narrow = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_BYTES))
    return narrow.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(shards))), shards


def _searcher(items: DataFrame, shard: int, size: int) -> Searcher:
    """That of one shard; its items, SHARD_BYTES and one item at most, come to the driver for it."""
    some = items.where(F.col("shard") == shard).select("item", "text")
    return Searcher.build(patterns([tuple(r) for r in some.toLocalIterator()], size))


def _found(searcher: Searcher, w: tx.Words, rows: int) -> tuple[np.ndarray, np.ndarray, list[set]]:
    """First words and numbers of words of all occurrences, and the items of each text."""
    begin, length, which = searcher.hits(w)
    items: list[set] = [set() for _ in range(rows)]
    for t, p in zip((np.searchsorted(w.first, begin, "right") - 1).tolist(), which):
        items[t] |= searcher.items[p]
    return begin, length, items


_SUMMARY = "struct<n_words:long,n_hit:long,items:array<string>>"


def _summary(w: tx.Words, begin: np.ndarray, length: np.ndarray, items: list[set]) -> pa.Array:
    hit = np.concatenate([[0], np.cumsum(tx.covered(begin, length, len(w.starts)))])
    each = [
        {"n_words": int(n), "n_hit": int(h), "items": sorted(i)}
        for n, h, i in zip(w.counts, np.diff(hit[w.first]), items)
    ]
    return pa.array(each, pa.struct({"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string())}))


def _spelt(column: pa.Array) -> tx.Words:
    data, offsets = tx.flat(column)
    return tx.joined(tx.words(tx.LOWER[data], offsets, tx.ALNUM))


def with_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW,
) -> tuple[DataFrame, str]:
    """`docs` with a struct column (n_words, n_hit, items), and its name.

    Null and empty texts have no words and no hits; items without words match
    nothing; a repeated item or item id counts once; a null item id is 'None'.
    A benchmark of one shard needs no shuffle. Of a larger one the shards are
    worked off one after the other: the searcher of one is made, broadcast and
    dropped, and its hits are written, so neither driver nor executors hold two.
    """
    result = unused(docs, "_hits")
    items, shards = _shards(benchmark, item_col, item_text_col)
    if shards > 1:
        return _by_shards(docs, items, shards, text_col, size, result), result
    sent = docs.sparkSession.sparkContext.broadcast(_searcher(items, 0, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.pieces(batches, text_col):
            w = _spelt(part.column(text_col))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, _summary(w, *_found(sent.value, w, part.num_rows))], [*part.schema.names, result]
            )

    schema = docs.withColumn(result, F.lit(None).cast(_SUMMARY)).schema
    return docs.mapInArrow(run, schema), result


def _by_shards(docs: DataFrame, items: DataFrame, shards: int, text_col: str, size: int, result: str) -> DataFrame:
    row, own, runs_col, items_col = (unused(docs, n) for n in ("_row", "_of", "_runs", "_items"))
    context = docs.sparkSession.sparkContext
    # Written, since a row's number must not change from shard to shard.
    numbered = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    texts = numbered.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
    every = None
    for shard in range(shards):
        sent = context.broadcast(_searcher(items, shard, size))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part in tx.pieces(batches, "text"):
                w = _spelt(part.column("text"))
                begin, length, found = _found(sent.value, w, part.num_rows)
                text = np.searchsorted(w.first, begin, "right") - 1
                some = np.unique(text)
                runs = np.stack([begin - w.first[text], length], axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row").take(pa.array(some)),
                        pa.array([runs[text == t].tobytes() for t in some], pa.binary()),
                        pa.array([sorted(found[t]) for t in some.tolist()], pa.list_(pa.string())),
                    ],
                    ["row", "runs", "items"],
                )

        hits = cut_lineage(texts.mapInArrow(search, "row long, runs binary, items array<string>"))
        sent.destroy()
        every = hits if every is None else every.unionByName(hits)
    merged = every.groupBy(F.col("row").alias(own)).agg(  # a row for each shard at most
        F.collect_list("runs").alias(runs_col), F.array_distinct(F.flatten(F.collect_list("items"))).alias(items_col)
    )
    joined = numbered.join(merged, F.col(row) == F.col(own), "left").drop(row, own)
    columns = docs.columns

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.pieces(batches, text_col):
            w = _spelt(part.column(text_col))
            begin, length, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for t, (runs, items) in enumerate(zip(part.column(runs_col).to_pylist(), part.column(items_col).to_pylist())):
                at = np.frombuffer(b"".join(runs or []), np.int64).reshape(-1, 2)
                begin.append(at[:, 0] + w.first[t])
                length.append(at[:, 1])
                found.append(set(items or ()))
            last = _summary(w, np.concatenate(begin), np.concatenate(length), found)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), last], [*columns, result])

    schema = docs.withColumn(result, F.lit(None).cast(_SUMMARY)).schema
    return joined.mapInArrow(finish, schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(`id_col`, n_words, n_hit, n_items, items_sha256, contaminated), a row for each row."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out, hits = with_hits(narrow, benchmark)
    found = F.col(hits)
    return out.select(
        F.col("id").alias(id_col),
        found["n_words"].alias("n_words"),
        found["n_hit"].alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(found["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (found["n_hit"] > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that hold no window of any benchmark item, as they are."""
    out, hits = with_hits(docs, benchmark, text_col)
    return out.where(F.col(hits)["n_hit"] == 0).drop(hits)
