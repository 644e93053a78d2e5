"""Importance resampling towards a target corpus, by an automaton over its words.

Features of a text are its words and its pairs of neighbouring words; each falls
into the bucket that the CRC-32 of its bytes gives. For each piece of text the
different words, with a delimiter on both sides, are compiled to an Aho-Corasick
automaton whose payload for a word is its CRC and length. Scanning the piece
emits the payloads word by word. The bucket of a pair is composed from the two
payloads, for the CRC of a concatenation follows from the CRCs of its parts and
the length of the second; no feature is ever spelt out.

Two scans make the result: one counts buckets over all source and all target
texts (added up per task, then over tasks), which gives each bucket a gain; the
other adds up the gains of each text. The dictionary is that of a bounded piece
of text, so memory does not follow the vocabulary of the corpus. Draws are the
highest of weight plus Gumbel noise, which is sampling without replacement; the
ranks come from range-ordered parts and their counts, without one task that
sorts all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocheline.llm import text as tx
from ocheline.plans.storage import cut_lineage

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
# The text that one automaton is made for.
PIECE_BYTES = 4 << 20
# Rows of the ordered table that one task gets, so the number of parts grows with the rows.
PART_ROWS = 1 << 20

# A word's bytes stay, A-Z in lower case, all else is a delimiter.
_SPACE, _BREAK = 0x20, 0x0A
_PLAIN = np.where(tx.ALNUM[tx.LOWER], tx.LOWER, _SPACE).astype(np.uint8)
_POLYNOMIAL = 0xEDB88320


def _shifts() -> list[np.ndarray]:
    """For k = 0, 1, …: what 2^k zero bytes behind a text do to its CRC, byte by byte of the CRC."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = (crc >> np.uint32(1)) ^ np.where(crc & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    byte = np.arange(256, dtype=np.uint32)
    one = np.stack([byte << np.uint32(8 * k) for k in range(4)])
    one = crc[one & np.uint32(0xFF)] ^ (one >> np.uint32(8))
    tables = [one]
    for _ in range(31):
        tables.append(shifted(tables[-1], tables[-1]))
    return tables


def shifted(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Apply one of the tables to CRCs; it is linear, so the parts of a CRC are looked up apart."""
    out = np.zeros(crc.shape, np.uint32)
    for k in range(4):
        out ^= table[k][(crc >> np.uint32(8 * k)) & np.uint32(0xFF)]
    return out


_SHIFTS = _shifts()


def composed(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs of concatenations, from those of both parts and the second's length."""
    out = first.copy()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        rows = np.flatnonzero(lengths >> k & 1)
        out[rows] = shifted(out[rows], _SHIFTS[k])
    return out ^ second


class Dictionary:
    """The different words of some texts as an automaton that emits their payloads."""

    def __init__(self, plain: bytes) -> None:
        words = sorted(set(plain.split()))
        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.length = np.array([len(w) for w in words], np.int64)
        # The same with a space behind, as the first part of a pair.
        self.open = composed(self.crc, np.full(len(words), zlib.crc32(b" "), np.uint32), np.ones(len(words), np.int64))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, word in enumerate(words):
            self.automaton.add_word(f" {word.decode('latin-1')} ", k)
        self.automaton.add_word("\n", -1)  # ends a text
        self.automaton.make_automaton()

    def payloads(self, plain: bytes) -> np.ndarray:
        """The numbers of the words one after the other, -1 after each text."""
        found = self.automaton.iter(plain.decode("latin-1"))
        return np.fromiter((k for _, k in found), np.int64)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all texts' features end to end, number of features, number of words of each text)."""
    data, offsets = tx.flat(column)
    # Each text ends with a space, a break and a space, so that no word touches another's delimiter.
    plain = np.insert(_PLAIN[data], np.repeat(offsets[1:], 3), np.tile([_SPACE, _BREAK, _SPACE], len(column)))
    raw = b" " + plain.astype(np.uint8).tobytes()
    known = Dictionary(raw)
    found = known.payloads(raw)
    breaks = np.flatnonzero(found < 0)
    words = np.diff(breaks, prepend=-1) - 1
    word = found >= 0
    pair = word[:-1] & word[1:]
    first, second = found[:-1][pair], found[1:][pair]
    # A word's features stand together: itself, then the pair that it begins.
    size = word.astype(np.int64)
    size[:-1] += pair
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
    out[(ends - size)[word]] = known.crc[found[word]]
    at = np.flatnonzero(pair)
    out[(ends - size)[at] + 1] = composed(known.open[first], known.crc[second], known.length[second])
    return out % np.uint32(BUCKETS), np.diff(ends[breaks], prepend=0), words


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket, empty ones left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for part in tx.pieces(batches, "text", PIECE_BYTES):
            counts += np.bincount(features(part.column("text"))[0], minlength=BUCKETS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    narrow = texts.select(F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """A whole number for each bucket: a thousand times the log of how much likelier it is in the target."""
    counted = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    )
    each = (
        counted.sparkSession.range(BUCKETS)
        .join(counted.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), F.col("id") == F.col("bucket"), "left")
        .select("id", *[F.coalesce(c, F.lit(0).cast("long")).cast("double").alias(c) for c in "st"])
    )
    sums = each.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = ((F.col("t") + 1.0) * (F.col("all_s") + float(BUCKETS))) / ((F.col("s") + 1.0) * (F.col("all_t") + float(BUCKETS)))
    # One row for each of the BUCKETS, whatever the size of the tables.
    rows = each.crossJoin(F.broadcast(sums)).select("id", F.floor(1000.0 * F.log(ratio)).alias("gain")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for bucket, gain in rows:
        out[bucket] = gain
    return out


def noise(id_: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the hash of seed and id; a null id counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean gain of each text's features, 0 without any."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.pieces(batches, "text", PIECE_BYTES):
            buckets, sizes, words = features(part.column("text"))
            sums = np.append(0, np.cumsum(sent.value[buckets]))
            ends = np.cumsum(sizes)
            weight = (sums[ends] - sums[ends - sizes]) // np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(words), pa.array(sizes), pa.array(weight)],
                ["id", "n_words", "n_features", "weight"],
            )

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """`scored` (id, n_words, score, …) with rank 1, 2, … of the drawn rows, null for the others.

    Of the N rows with `least_words` words or more, floor(percent * N / 100) are
    drawn: the highest scores, ties to smaller ids, null ids last.
    """
    may = F.col("n_words") >= least_words
    n = scored.agg(F.count_if(may)).first()[0] or 0
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    # Rows alike in score and id are interchangeable, so they may be dealt by their place.
    place = F.col("_place").asc()
    rows = scored.where(may).withColumn("_place", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(max(1, -(-n // PART_ROWS)), *order, place)
    sorted_ = cut_lineage(
        dealt.sortWithinPartitions(*order, place).withColumn("_at", F.monotonically_increasing_id()).drop("_place")
    )
    # The number of a part and the place in it; written, so a retry can't change them.
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # A row for each part, that is for each PART_ROWS rows.
    before = counts.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
    )
    rank = F.col("_before") + at + 1
    placed = sorted_.join(before, part == F.col("_part")).select(
        *scored.columns, F.when(rank <= percent * n // 100, rank).alias("rank")
    )
    rest = scored.where(~may).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest)


def resampled(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """(`id_col`, n_words, n_features, weight, score, rank) for each row of `docs`.

    Words are runs of ASCII letters, digits and all other characters beyond
    ASCII, A-Z in lower case; features are words and pairs of neighbours, all
    counted as often as they occur. A row with a rank is drawn. Null and empty
    texts have no features and weight 0. Repeated rows are rows of their own with
    equal scores. An empty source gives an empty result; an empty target leaves
    gains that only tell common buckets from rare ones. Other columns are not
    looked at.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text_col))
    scored = cut_lineage(
        weighed(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    )
    return ranked(scored, percent, least_words).withColumnRenamed("id", id_col)
