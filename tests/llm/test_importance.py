"""Importance resampling against sums in plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from ocheline.llm import importance as im

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def buckets(text):
    w = words(text)
    spelt = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    return [zlib.crc32(s.encode()) % im.BUCKETS for s in spelt]


def plain(docs, target, percent=25, least=20):
    """{row number: (n_features, weight, score, rank)}"""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text))
    for text in target:
        t.update(buckets(text))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in range(10000)
    ]
    rows = []
    for id_, text in docs:
        found = buckets(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((id_, len(words(text)), len(found), weight, score))
    may = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = percent * len(may) // 100
    out = [(*r, k + 1 if k < drawn else None) for k, r in enumerate(may)]
    return sorted(out + [(*r, None) for r in rows if r[1] < least], key=str)


def found(df):
    return sorted(
        (tuple(r) for r in df.select(df.columns[0], "n_words", "n_features", "weight", "score", "rank").collect()), key=str
    )


def test_composed_checksums():
    rnd = np.random.default_rng(3)
    parts = [(rnd.bytes(int(a)), rnd.bytes(int(b))) for a, b in rnd.integers(0, 5000, (50, 2))]
    first = np.array([zlib.crc32(a) for a, _ in parts], np.uint32)
    second = np.array([zlib.crc32(b) for _, b in parts], np.uint32)
    got = im.composed(first, second, np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_features_of_each_text():
    texts = [None, "", " \n", "a", "A b", "x\x00y é日本 Ünï 12 a\nb", "aa " * 5, "the end", " x", "a\x7fb"]
    got, sizes, n = im.features(pa.array(texts))
    ends = np.cumsum(sizes)
    for k, text in enumerate(texts):
        assert n[k] == len(words(text))
        assert sorted(got[ends[k] - sizes[k] : ends[k]].tolist()) == sorted(buckets(text)), text


def test_pieces_do_not_change_features(monkeypatch, spark, messy):
    texts, frame = messy
    want = Counter(b for _, t in texts for b in buckets(t))
    for size in (1, 50, 1 << 22):
        monkeypatch.setattr(im, "PIECE_BYTES", size)
        assert {r.bucket: r.n for r in im.bucket_counts(frame).collect()} == want


def test_automaton_emits_the_words():
    """The payloads alone make the features: another automaton makes others."""
    known = im.Dictionary(b" b a c \n a \n")
    assert known.payloads(b" b a c \n a \n").tolist() == [1, 0, 2, -1, 0, -1]
    assert known.crc.tolist() == [zlib.crc32(w) for w in (b"a", b"b", b"c")]


def test_ranks_over_many_parts(spark, monkeypatch):
    docs = [(i % 40 if i % 9 else None, f"w{i % 5} " * 25 if i % 4 else "short") for i in range(400)]
    target = ["w1 w1 w1", "w2 w3", None]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    other = spark.createDataFrame([(t,) for t in target], "text string")
    monkeypatch.setattr(im, "PART_ROWS", 16)
    assert found(im.resampled(frame, other)) == plain(docs, target)


def test_messy_rows(spark, messy, none):
    texts, frame = messy
    target = [t for _, t in texts[:3]]
    other = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    assert found(im.resampled(frame, other, percent=60, least_words=2)) == plain(texts, target, 60, 2)
    assert found(im.resampled(frame, none)) == plain(texts, [])
    assert im.resampled(none, other).collect() == []


def test_null_ids_are_drawn_last_among_ties(spark):
    rows = [(0, 30, 5), (None, 30, 5), (3, 30, 5), (1, 30, 9), (2, 3, 99)]
    scored = spark.createDataFrame(rows, "id long, n_words long, score long")
    got = im.ranked(scored, percent=100)
    assert [(r.id, r["rank"]) for r in got.where("rank is not null").orderBy("rank").collect()] == [
        (1, 1), (0, 2), (3, 3), (None, 4)
    ]
    assert got.where("rank is null").count() == 1
