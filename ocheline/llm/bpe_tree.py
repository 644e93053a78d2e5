"""Byte-level BPE of texts of any length, by tree concatenation.

Texts up to LONG_BYTES go to the tokenizers library cut where no token crosses,
each different cut once. A longer one is halved until its pieces are that small; the pieces of all texts are dealt out
over the cluster and encoded in parallel; then neighbours are joined, pairs of
pairs, up to the whole text. Where two halves meet, their tokens may be wrong,
so a window around the join is encoded again: some tokens of the left half, some
of the right one. The window is taken over as soon as both sides agree with it,
else it grows to twice as many tokens, at most to both halves.

Why agreement is enough: tokens are a text's BPE exactly if each two neighbours
are the BPE of what both spell. So if the window begins with a token of the left
half and goes over into a token of the right one, all neighbours in the result
are neighbours in one of three right encodings. What the library cuts the text
into before it merges (words, numbers, marks, white space) depends on what
follows only, so cuts agree from the first common one on. Inside one cut (a run
of one kind of character) the run ends where it ends, wherever one starts to
read, but for an apostrophe that begins a contraction and for the last of some
white space; nothing starts there.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ocheline.llm import text as tx
from ocheline.llm.chunks import gather
from ocheline.llm.simple8b import borders, bpe_encoder, special_strings
from ocheline.plans.storage import cut_lineage

# Beyond this a text takes long enough (15 ms) to be shared out.
LONG_BYTES = 32 << 10
# Text and ids that are worked on at once, and different cuts that a worker remembers.
PIECE_BYTES = 1 << 20
MOST_IDS = 1 << 18
MOST_CUTS = 300_000
# Tokens of each side in the first window around a join.
WINDOW = 16
# A contraction is told by at most this many bytes after its start.
AHEAD = 4


@dataclass(frozen=True)
class Coded:
    """A text's bytes, its ids, where each token ends, and which tokens begin a cut."""

    raw: bytes
    ids: np.ndarray
    ends: np.ndarray
    cuts: np.ndarray

    def start(self, k: int) -> int:
        return int(self.ends[k - 1]) if k else 0


class Spelling:
    """The bytes that each id of a byte-level vocabulary spells."""

    def __init__(self, tokenizer_json: str) -> None:
        spec = json.loads(tokenizer_json)
        spelt = {i: _spelling(t) for t, i in spec["model"]["vocab"].items()}
        spelt |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.lengths = np.zeros(max(spelt, default=-1) + 1, np.int64)
        self.lengths[list(spelt)] = [len(t) for t in spelt.values()]
        self._starts = np.cumsum(self.lengths) - self.lengths
        self._bytes = np.frombuffer(b"".join(spelt[i] for i in sorted(spelt)), np.uint8)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of runs of ids, each ending at one of `ends`; ids that are none spell nothing."""
        known = np.minimum(ids.astype(np.int64), len(self.lengths))
        sizes = np.append(self.lengths, 0)[known]
        raw = gather(self._bytes, np.append(self._starts, 0)[known], sizes).tobytes()
        places = np.append(0, np.cumsum(sizes))[ends].tolist()
        return [raw[a:b].decode(errors="replace") for a, b in zip([0, *places], places)]


class Coder:
    """Encode with a byte-level BPE of the tokenizers library."""

    def __init__(self, tokenizer_json: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the cores
        spec = json.loads(tokenizer_json)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["model"]["type"] != "BPE":
            raise ValueError("not a byte-level BPE")
        if spec["pre_tokenizer"]["add_prefix_space"] or spec["model"].get("dropout"):
            raise ValueError("prefix spaces and dropout are not supported")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that look at their neighbours are not supported")
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = special
        longest = sorted(map(re.escape, special), key=len, reverse=True)
        self._apart = re.compile(f"({'|'.join(longest)})") if special else None
        self.lengths = Spelling(tokenizer_json).lengths

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """Runs of ordinary text (id None) and special tokens, in order; nothing is merged across."""
        parts = self._apart.split(text) if self._apart else [text]
        return [(p, self.special.get(p) if k % 2 else None) for k, p in enumerate(parts) if p]

    def piece(self, text: str) -> Coded:
        """A run of ordinary text, encoded on its own."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        ids = np.array(found.ids, np.uint32)
        words = np.array(found.word_ids, np.int64)
        return Coded(text.encode(), ids, np.cumsum(self.lengths[ids]), np.diff(words, prepend=-1) != 0)

    def join(self, left: Coded, right: Coded, window: int = WINDOW) -> Coded:
        """The encoding of both texts as one, from those of each."""
        if not len(left.ids) or not len(right.ids):
            return right if not len(left.ids) else left
        raw, middle = left.raw + right.raw, len(left.raw)
        before, after = window, window
        while True:
            first = _window_start(left, max(0, len(left.ids) - before))
            a = left.start(first)
            b = _window_end(right, min(len(right.ids), after)) + middle
            again = self.piece(raw[a:b].decode())
            held = bool(left.cuts[first]) or again.ids[0] == left.ids[first]
            if not held and first:
                before *= 2
                continue
            seam = _seam(again, right, a, middle, b == len(raw))
            if seam is None and b < len(raw):
                after *= 2
                continue
            k, j = seam if seam is not None else (len(again.ids), len(right.ids))
            cuts = again.cuts[:k].copy()
            cuts[:1] = left.cuts[first]
            ids = np.concatenate([left.ids[:first], again.ids[:k], right.ids[j:]])
            return Coded(
                raw,
                ids,
                np.cumsum(self.lengths[ids]),
                np.concatenate([left.cuts[:first], cuts, right.cuts[j:]]),
            )

    def tree(self, pieces: list[Coded]) -> Coded:
        """All pieces as one text: neighbours are joined until one is left."""
        while len(pieces) > 1:
            pairs = [self.join(a, b) for a, b in zip(pieces[::2], pieces[1::2])]
            pieces = pairs + pieces[2 * len(pairs) :]
        return pieces[0]


def _spelling(token: str) -> bytes:
    """The bytes that a byte-level token stands for."""
    return bytes(map(_BYTE_OF.__getitem__, token))


def _byte_of() -> dict[str, int]:
    """Visible characters of Latin-1 stand for themselves, others for 256 and up in turn."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


_BYTE_OF = _byte_of()


def _whole(raw: bytes, at: int) -> bool:
    """Whether no character goes across this place."""
    return at >= len(raw) or raw[at] & 0xC0 != 0x80


def _safe(raw: bytes, at: int) -> bool:
    """Whether a run of one kind, read from here on, ends where it ends when read from before."""
    if not _whole(raw, at):
        return False
    near = raw[at : at + 8].decode(errors="ignore")[:2]
    if near[:1] == "'":
        return near[1:] not in tuple("stmdrvl")
    if near[:1].isspace():
        return near[1:].isspace() and not "\x1c" <= near[0] <= "\x1f"
    return True


def halves(text: str, most: int = LONG_BYTES) -> list[str]:
    """Pieces of at most `most` bytes by repeated halving; each but the first begins at a safe place."""
    raw = text.encode()
    if len(raw) <= most:
        return [text]
    at = len(raw) // 2
    while at < len(raw) and not _safe(raw, at):
        at += 1
    if at >= len(raw):
        return [text]
    return halves(raw[:at].decode(), most) + halves(raw[at:].decode(), most)


def _window_start(left: Coded, k: int) -> int:
    """The last token up to the k-th at which a window may begin."""
    known = len(left.raw) - AHEAD
    cuts = np.flatnonzero(left.cuts[: k + 1])
    while k > 0:
        if left.cuts[k] and left.start(k) <= known:
            return k
        begin = left.start(int(cuts[np.searchsorted(cuts, k, "right") - 1]))
        if not left.cuts[k] and begin <= known and _safe(left.raw, begin) and _safe(left.raw, left.start(k)):
            return k
        k -= 1
    return 0


def _window_end(right: Coded, k: int) -> int:
    """Where the k-th token of the right side ends, or a later one that ends with a character."""
    while k < len(right.ids) and not _whole(right.raw, int(right.ends[k - 1])):
        k += 1
    return int(right.ends[k - 1])


def _seam(again: Coded, right: Coded, a: int, middle: int, to_end: bool) -> tuple[int, int] | None:
    """(token of the window, token of the right side) from which the right side goes on; None if they disagree."""
    starts = np.append(0, again.ends[:-1]) + a - middle  # places in the right side
    known = len(again.raw) + a - middle - (0 if to_end else AHEAD)
    own = np.append(0, right.ends[:-1])
    first_cut = np.append(np.flatnonzero(right.cuts[1:]) + 1, len(right.ids))[0]
    window_cuts = np.flatnonzero(again.cuts)
    for k in np.flatnonzero((starts >= 0) & (np.append(starts[1:], known + 1) <= known)).tolist():
        j = int(np.searchsorted(own, starts[k]))
        if j >= len(own) or own[j] != starts[k]:
            continue
        if again.cuts[k]:
            if right.cuts[j]:
                return k, j
            continue
        # Inside a run that goes across the join: the same run on both sides, and the same token.
        begin = int(window_cuts[np.searchsorted(window_cuts, k, "right") - 1])
        if 0 < j < first_cut and starts[begin] < 0 and again.ids[k] == right.ids[j]:
            if begin == 0 or _safe(again.raw, int(starts[begin]) + middle - a):
                return k, j
    return None


def encoded(
    docs: DataFrame,
    tokenizer_json: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    long_bytes: int = LONG_BYTES,
    round_trip: bool = False,
) -> DataFrame:
    """(`id_col`, ids array<int>): the ids of each whole text, a row for each row of `docs`.

    With `round_trip` the text that the ids spell comes along as `decoded`, as
    `decoded` makes it of stored ids, without a further way to Python and back.

    The ids are those of the library without special tokens added; a special
    token that stands in a text is one id. Null and empty texts have none.
    Equal long texts are encoded once. An empty table gives an empty result;
    other columns are not looked at.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long_ = F.coalesce(F.octet_length("text"), F.lit(0)) > long_bytes
    # The vocabulary; a worker keeps the encoder that it makes of it for all its tasks.
    sent = docs.sparkSession.sparkContext.broadcast({"vocabulary": tokenizer_json})
    kind = narrow.schema["id"].dataType.simpleString()

    def own() -> Coder:
        if "coder" not in sent.value:
            sent.value["coder"] = Coder(sent.value["vocabulary"])
        return sent.value["coder"]

    names = ["ids", "decoded"] if round_trip else ["ids"]
    schema = "ids array<int>, decoded string" if round_trip else "ids array<int>"

    def results(ids: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
        ends = np.cumsum(counts, dtype=np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.view(np.int32)))
        if not round_trip:
            return [lists]
        if "spelling" not in sent.value:
            sent.value["spelling"] = Spelling(sent.value["vocabulary"])
        return [lists, pa.array(sent.value["spelling"].decode(ids, ends), pa.string())]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "cuts" not in sent.value:
            sent.value["cuts"] = bpe_encoder(sent.value["vocabulary"], MOST_CUTS)
        special = special_strings(sent.value["vocabulary"])
        for part in tx.pieces(batches, "text", PIECE_BYTES):
            data, offsets = tx.flat(part.column("text"))
            ids, counts = sent.value["cuts"].ids(data, borders(data, offsets, special), offsets)
            yield pa.RecordBatch.from_arrays([part.column("id"), *results(ids, counts)], ["id", *names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = own()
        for part in tx.pieces(batches, "text"):
            for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist()):
                rows: list[tuple[int, int, str]] = []  # segment, id of a special token or -1, text
                for segment, (run, special) in enumerate(coder.segments(text)):
                    each = halves(run, long_bytes) if special is None else [run]
                    rows += [(segment, -1 if special is None else special, t) for t in each]
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": [key] * len(rows),
                        "segment": pa.array([r[0] for r in rows], pa.int64()),
                        "piece": pa.array(range(len(rows)), pa.int64()),
                        "special": pa.array([r[1] for r in rows], pa.int64()),
                        "text": [r[2] for r in rows],
                    }
                )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = own()
        for batch in tx.pieces(batches, "text"):
            ids, cuts = [], []
            for text, special in zip(batch.column("text").to_pylist(), batch.column("special").to_pylist()):
                if special >= 0:
                    ids.append(np.array([special], np.uint32))
                    cuts.append(b"\1")
                else:
                    one = coder.piece(text)
                    ids.append(one.ids)
                    cuts.append(np.packbits(one.cuts).tobytes())
            columns = [batch.column(c) for c in ("key", "segment", "piece", "special", "text")]
            yield pa.RecordBatch.from_arrays(
                [*columns, _lists(ids), pa.array(cuts, pa.binary())],
                ["key", "segment", "piece", "special", "text", "ids", "cuts"],
            )

    def concatenate(table: pa.Table) -> pa.Table:
        coder = own()
        table = table.sort_by("piece")
        segment = table.column("segment").to_numpy()
        out, pieces = [], []
        for k in range(table.num_rows):
            ids = table.column("ids")[k].values.to_numpy().astype(np.uint32)
            if table.column("special")[k].as_py() >= 0:
                out.append(ids)
                continue
            cuts = np.unpackbits(np.frombuffer(table.column("cuts")[k].as_py(), np.uint8), count=len(ids))
            raw = table.column("text")[k].as_py().encode()
            pieces.append(Coded(raw, ids, np.cumsum(coder.lengths[ids]), cuts.astype(bool)))
            if k + 1 == table.num_rows or segment[k + 1] != segment[k]:
                out.append(coder.tree(pieces).ids)
                pieces = []
        ids = np.concatenate(out)
        found = results(ids, np.array([len(ids)]))
        return pa.table([table.column("key")[:1], *found], ["key", *names])

    whole = narrow.where(~long_).mapInArrow(short, f"id {kind}, {schema}")
    keyed = narrow.where(long_).select("id", F.sha2("text", 256).alias("key"), "text")
    once = keyed.groupBy("key").agg(F.first("text").alias("text"))
    pieces = (
        once.mapInArrow(cut, "key string, segment long, piece long, special long, text string")
        .repartition("key", "piece")
        .mapInArrow(encode, "key string, segment long, piece long, special long, text string, ids array<int>, cuts binary")
    )
    joined = cut_lineage(
        pieces.groupBy(F.col("key")).applyInArrow(concatenate, f"key string, {schema}")
    )
    parts = keyed.select("id", F.col("key").alias("_key")).join(joined, F.col("_key") == F.col("key"))
    return whole.unionByName(parts.select("id", *names)).withColumnRenamed("id", id_col)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    every = np.concatenate([np.zeros(0, np.uint32), *ids]).view(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(every))


def decoded(coded: DataFrame, tokenizer_json: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`coded` with the text that its ids spell; a column called `out_col` is replaced.

    Special tokens are spelt out. Null ids are the empty text; bytes that are no
    UTF-8 become replacement characters; ids the vocabulary lacks spell nothing.
    """
    sent = coded.sparkSession.sparkContext.broadcast({"vocabulary": tokenizer_json})
    rest = [c for c in coded.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "spelling" not in sent.value:
            sent.value["spelling"] = Spelling(sent.value["vocabulary"])
        for whole in batches:
            sums = np.cumsum(whole.column(ids_col).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            # About so many ids at once, one row at least.
            for part in np.split(np.arange(len(sums)), np.flatnonzero(np.diff(sums // MOST_IDS)) + 1):
                batch = whole.slice(int(part[0]), len(part)) if len(part) else whole
                lists = batch.column(ids_col)
                ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint32)
                ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                texts = pa.array(sent.value["spelling"].decode(ids, ends), pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), texts], [*rest, out_col])

    narrow = coded.select(*rest)
    return narrow.mapInArrow(run, narrow.withColumn(out_col, F.lit("")).schema)
