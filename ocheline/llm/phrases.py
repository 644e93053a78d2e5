"""Substring dedup: recurring passages, found by Aho-Corasick automata.

A window is WINDOW consecutive words of one document; words that lie in a window
which starts anywhere else as well are repeats. Four steps find them all:

1. Each window elects the anchor with the smallest hash among its ANCHOR-word
   phrases. Equal windows elect equal anchors, so an anchor elected at one place
   only belongs to no repeat. Of the elected ones (one word in fourteen) only
   hashes are counted.
2. Documents are dealt out to parts of bounded size. Windows whose elected anchor
   recurs are candidates; they are counted over all parts by 96 bits, the
   anchor's hash of 64 and 32 of one of the whole window. Those found more than
   once confirm the passages: the longest runs of such windows in a text.
3. The different passages of a part are compiled to Aho-Corasick automata of
   bounded size, and all texts of the part are streamed through each of them.
4. What the automata locate is taken out, and nothing else.

Texts travel compressed. What a part receives for an anchor or window is at most
one row, however many copies there are elsewhere or in it.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocheline.llm import text as tx
from ocheline.plans.storage import cut_lineage

WINDOW = 35
ANCHOR = 8
PART_BYTES = 8 << 20
PACK_BYTES = 16 << 20
# Letters of the passages in one automaton, windows in one passage, bytes of a word that is spelt out.
AUTOMATON_BYTES = 1 << 20
PASSAGE = 100
LONG_WORD = 64
_NONE = np.uint64(2**64 - 1)
_LOW = np.uint64(2**32 - 1)


def sliding(values: np.ndarray, size: int, op: np.ufunc) -> np.ndarray:
    """`op` (minimum or maximum) over each `size` consecutive values."""
    width, out = 1, values
    while 2 * width <= size:
        out = op(out[:-width], out[width:])
        width *= 2
    return op(out[: len(out) - (size - width)], out[size - width :]) if size > width else out


class Texts:
    """Words of some texts with their anchors and windows."""

    def __init__(self, column: pa.Array, window: int, anchor: int) -> None:
        data, offsets = tx.flat(column)
        self.words = tx.joined(tx.words(data, offsets, ~tx.SPACE))
        self.window, self.anchor = window, anchor
        self.hashes = tx.word_hashes(self.words)
        first, n = self.words.first, len(self.hashes)
        # Windows and anchors may start so close to a text's end that they cross it.
        left = np.repeat(first[1:], self.words.counts) - np.arange(n)
        self.full = left[: max(0, n - window + 1)] >= window

    @functools.cached_property
    def grams(self) -> np.ndarray:
        """The hash of the anchor at each word."""
        return np.minimum(tx.window_hashes(self.hashes, self.anchor), _NONE - np.uint64(1))

    def least(self, grams: np.ndarray) -> np.ndarray:
        """The smallest gram of each window."""
        reach = self.window - self.anchor + 1
        return sliding(grams, reach, np.minimum) if len(self.full) else grams[:0]

    def elected(self) -> np.ndarray:
        """Which anchors are the smallest of some window."""
        if not len(self.full):
            return np.zeros(len(self.grams), bool)
        reach = self.window - self.anchor + 1
        low = np.where(self.full, self.least(self.grams), np.uint64(0))
        edge = np.zeros(reach - 1, np.uint64)
        return sliding(np.concatenate([edge, low, edge]), reach, np.maximum) == self.grams

    def least_at(self) -> np.ndarray:
        """Where the smallest gram of each window stands, the first of equal ones."""
        if not len(self.full):
            return np.zeros(0, np.int64)
        reach = self.window - self.anchor + 1
        at, width = np.arange(len(self.grams)), 1

        def first(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.where(self.grams[a] <= self.grams[b], a, b)

        while 2 * width <= reach:
            at = first(at[:-width], at[width:])
            width *= 2
        more = reach - width
        return (first(at[: len(at) - more], at[more:]) if more else at)[: len(self.full)]

    def candidates(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, grams of their anchors) of the windows whose smallest anchor is among those found."""
        at = self.least_at()
        some = np.flatnonzero(self.full & found[at]) if len(at) else at
        return some, self.grams[at[some]]

    def passages(self, starts: np.ndarray) -> list[tuple[int, int]]:
        """The longest runs of the windows at the sorted `starts`, as (first word, words).

        A run of more than PASSAGE windows is cut into several that overlap, each
        of a window at least, so what covers one is covered by them.
        """
        breaks = np.flatnonzero(np.diff(starts) != 1) + 1
        out = []
        for run in np.split(starts, breaks) if len(starts) else ():
            for s in range(0, len(run), PASSAGE):
                n = min(PASSAGE, len(run) - s)
                out.append((int(run[s]), n + self.window - 1))
        return out

    @functools.cached_property
    def spelt(self) -> tuple[str, np.ndarray]:
        """(the words, a space around each, where each begins): what the automata read.

        A word beyond LONG_WORD bytes stands there by its length and 128 bits of
        hash, which keeps the automata's branches short.
        """
        w = self.words
        raw, starts = w.data.tobytes().decode("latin-1"), w.starts + 1
        long_ = np.flatnonzero(w.ends - w.starts > LONG_WORD)
        if not len(long_):
            return f" {raw}", starts
        each, at = [], 0
        sizes = w.ends - w.starts
        for k in long_.tolist():
            word = raw[w.starts[k] : w.ends[k]]
            short = f"{len(word)}\t{xxhash.xxh3_128_hexdigest(word.encode('latin-1'))}"  # no word has a tab
            each += [raw[at : w.starts[k]], short]
            at, sizes[k] = int(w.ends[k]), len(short)
        ends = np.cumsum(sizes + 1)
        return " " + "".join([*each, raw[at:]]), ends - sizes

    def passage(self, first: int, words: int) -> str:
        """The spelling of so many words, a space on both sides."""
        raw, starts = self.spelt
        end = starts[first + words] if first + words < len(starts) else len(raw)
        return raw[starts[first] - 1 : end]

    def located(self, made: Iterator[ahocorasick.Automaton]) -> tuple[np.ndarray, np.ndarray]:
        """(first word, words) of each place where a passage of the automata stands in one text."""
        raw, starts = self.spelt
        firsts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for automaton in made:
            hits = np.fromiter(
                (x for end, (size, words) in automaton.iter(raw) for x in (end - size + 2, words)), np.int64
            ).reshape(-1, 2)
            firsts.append(np.searchsorted(starts, hits[:, 0]))
            sizes.append(hits[:, 1])
        first, size = np.concatenate(firsts), np.concatenate(sizes)
        # Texts stand end to end, so a passage may seem to go from one into the next.
        text = np.searchsorted(self.words.first, first, "right")
        inside = first + size <= self.words.first[text]
        return first[inside], size[inside]

    @functools.cached_property
    def window_hashes(self) -> np.ndarray:
        """32 bits of a hash of each window that has nothing to do with its anchor's."""
        found = tx.window_hashes(tx.word_hashes(self.words, seed=1), self.window)[: len(self.full)]
        return found & _LOW

    def forget(self) -> None:
        """Drop what only tells windows apart; words and spelling stay."""
        for name in ("hashes", "grams", "window_hashes", "full"):
            self.__dict__.pop(name, None)

    def repeated(self, grams: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Starts of the windows whose pair of hashes is among the given ones, which are sorted."""
        some, own = self.candidates(tx.members(self.grams, grams))
        other = self.window_hashes[some]
        # Bisection within the given ones of the same gram.
        low, high = np.searchsorted(grams, own, "left"), np.searchsorted(grams, own, "right")
        end = high
        while (low < high).any():
            middle = (low + high) // 2
            less = others[np.minimum(middle, len(others) - 1)] < other
            low, high = np.where((low < high) & less, middle + 1, low), np.where((low < high) & ~less, middle, high)
        hit = low < end
        hit[hit] = others[low[hit]] == other[hit]
        return some[hit]


def automata(passages: list[tuple[str, int]]) -> Iterator[ahocorasick.Automaton]:
    """Automata of bounded size that together know all passages, one at a time."""
    automaton, size = ahocorasick.Automaton(), 0
    for text, words in passages:
        automaton.add_word(text, (len(text), words))
        size += len(text)
        if size > AUTOMATON_BYTES:
            automaton.make_automaton()
            yield automaton
            automaton, size = ahocorasick.Automaton(), 0
    if size:
        automaton.make_automaton()
        yield automaton


def _texts(table: pa.Table, window: int, anchor: int) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    for raw in table.column("raw"):
        for part in tx.pieces(tx.unpacked(raw.as_py()), "text"):
            yield part, Texts(part.column("text"), window, anchor)


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    anchor: int = ANCHOR,
) -> DataFrame:
    """(`id_col`, n_words, n_removed, kept): what is left of each whole text.

    Words are runs of anything but ASCII white space, unchanged; `kept` joins
    those that stay by one space. A word goes if a window that covers it also
    starts anywhere else, in the same text or another; all windows are judged
    on the input. Null and empty texts have no words; texts shorter than a
    window keep all. Repeated rows are copies of each other like any others.
    An empty table gives an empty result; other columns are not looked at.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / PART_BYTES))
    dealt = narrow.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)))

    def elect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tx.pieces(batches, "text"):
            texts = Texts(piece.column("text"), window, anchor)
            at = np.flatnonzero(texts.elected())
            text = np.searchsorted(texts.words.first, at, "right") - 1
            part = piece.column("part").to_numpy()[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts.grams[at].view(np.int64)), pa.array(part)], ["hash", "part"]
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tx.pieces(batches, "text", PACK_BYTES):
            part = piece.column("part").to_numpy()
            order = np.argsort(part, kind="stable")
            keys, starts = np.unique(part[order], return_index=True)
            texts = pa.RecordBatch.from_arrays(
                [piece.column("id").cast(id_type), piece.column("text").cast(pa.large_string())],
                ["id", "text"],
            )
            raws = [
                tx.packed(texts.take(pa.array(rows))) for rows in np.split(order, starts[1:])
            ]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(raws, pa.binary())], ["part", "raw"])

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = np.unique(right.column("hash").to_numpy().view(np.uint64))
        grams, others = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for _, texts in _texts(left, window, anchor):
            starts, own = texts.candidates(tx.members(texts.grams, wanted) & texts.elected())
            grams.append(own)
            others.append(texts.window_hashes[starts])
        gram, other = np.concatenate(grams), np.concatenate(others)
        order = np.lexsort((other, gram))
        gram, other = gram[order], other[order]
        first = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (other[1:] != other[:-1]))[: len(gram)])
        twice = np.diff(np.append(first, len(gram))) > 1
        part = (left if left.num_rows else right).column("part")[0].as_py()
        # The part, whether the window is there more than once, and its 32 bits in one number.
        code = (np.uint64(2 * part) + twice.astype(np.uint64)) << np.uint64(32) | other[first]
        return pa.table({"hash": gram[first].view(np.int64), "code": code.view(np.int64)})

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        grams, others = (right.column(c).to_numpy().view(np.uint64) for c in ("hash", "code"))
        order = np.lexsort((others & _LOW, grams))
        grams, others = grams[order], others[order] & _LOW
        every = list(_texts(left, window, anchor))
        passages = {}
        for _, texts in every:
            for first, words in texts.passages(texts.repeated(grams, others)):
                passages[texts.passage(first, words)] = words
            texts.forget()
        gone = [np.zeros(len(texts.words.starts) + 1, np.int64) for _, texts in every]
        for automaton in automata(sorted(passages.items())):
            for (_, texts), steps in zip(every, gone):
                first, words = texts.located([automaton])
                np.add.at(steps, first, 1)
                np.subtract.at(steps, first + words, 1)
        out: list[list] = [[], [], [], []]
        for (piece, texts), steps in zip(every, gone):
            w = texts.words
            stays = np.cumsum(steps[:-1]) == 0
            kept = tx.joined(tx.Words(w.data, w.starts[stays], w.ends[stays], _ends(stays, w.first)))
            raw, ends = kept.data.tobytes(), np.append(kept.starts, len(kept.data))[kept.first].tolist()
            out[0].append(piece.column("id"))
            out[1].append(w.counts)
            out[2].append(w.counts - kept.counts)
            out[3] += [raw[a : max(a, b - 1)].decode() for a, b in zip(ends[:-1], ends[1:])]
        if not out[0]:
            return pa.table([pa.array([], t) for t in (id_type, pa.int64(), pa.int64(), pa.string())], names)
        return pa.table(
            [pa.chunked_array(out[0]), np.concatenate(out[1]), np.concatenate(out[2]), pa.array(out[3], pa.string())],
            names,
        )

    names = ["id", "n_words", "n_removed", "kept"]
    id_type = _arrow_type(kind)
    recurring = _recurring(
        dealt.mapInArrow(elect, "hash long, part long")
        .groupBy("hash", "part")
        .agg(F.count("*").alias("n"))
    )
    packs = dealt.mapInArrow(pack, "part long, raw binary")
    counted = (
        packs.groupBy("part")
        .cogroup(recurring.groupBy("part"))
        .applyInArrow(candidates, "hash long, code long")
    )
    repeats = cut_lineage(_confirmed(counted))
    schema = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept", T.StringType()),
        ]
    )
    done = packs.groupBy("part").cogroup(repeats.groupBy("part")).applyInArrow(cut, schema)
    return done.withColumnRenamed("id", id_col)


def _recurring(counted: DataFrame) -> DataFrame:
    """(hash, part) of the hashes found more than once; at most one row for each part."""
    places = Window.partitionBy("hash")
    return (
        counted.withColumn("total", F.sum("n").over(places)).where("total > 1").select("hash", "part")
    )


def _confirmed(counted: DataFrame) -> DataFrame:
    """(hash, code, part) of the windows found more than once; `code` is that of `candidates`."""
    other = F.col("code").bitwiseAND(F.lit((1 << 32) - 1))
    twice = F.shiftright("code", 32).bitwiseAND(F.lit(1)) == 1
    places = Window.partitionBy("hash", other)
    return counted.withColumn("_n", F.count("*").over(places)).where((F.col("_n") > 1) | twice).select(
        "hash", "code", F.shiftright("code", 33).alias("part")
    )


def _ends(kept: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(kept)])[first]


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
