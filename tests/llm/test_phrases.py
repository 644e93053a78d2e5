"""Repeats are what the automata locate, and hashes never join what differs."""

from __future__ import annotations

import random

import numpy as np
import plain
import pyarrow as pa
import pytest

from ocheline.llm import near_texts, phrases
from ocheline.llm import text as tx


def thue_morse(n):
    """Two words of n letters that any polynomial modulo 2^64 with an odd base takes for one another."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_words_that_polynomials_confuse(spark):
    one, other = thue_morse(1024)
    words = [f"w{k}" for k in range(39)]
    rows = [(1, " ".join([*words[:20], one, *words[20:]])), (2, " ".join([*words[:20], other, *words[20:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(phrases.without_repeats(df)) == plain.without_repeats(rows)
    pair = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    assert sorted(r.component_id for r in near_texts.near_groups(pair).collect()) == [1, 2]


def test_patterned_windows_have_hashes_of_their_own():
    """All windows over two words that are different texts have different hashes."""
    rnd = np.random.default_rng(1)
    a, b = tx.mixed(np.array([1, 2], np.uint64))
    values = np.where(rnd.random(5000) < 0.5, a, b)
    texts = {values[i : i + 35].tobytes() for i in range(len(values) - 34)}
    assert len(np.unique(tx.window_hashes(values, 35))) == len(texts)
    for size in (1, 2, 5, 8, 35, 64):
        once = tx.window_hashes(values[:200], size)
        again = [tx.window_hashes(values[i : i + size], size)[0] for i in range(201 - size)]
        assert once.tolist() == [int(x) for x in again]


def test_word_hashes_see_every_byte():
    words = ["a", "b", "ab", "ba", "a" * 8, "a" * 9, "a" * 16, "a" * 15 + "b", "b" + "a" * 15, "ä", "x" * 600, "x" * 599 + "y"]
    data, offsets = tx.flat(pa.array([" ".join(words)]))
    found = tx.words(data, offsets, ~tx.SPACE)
    for seed in (0, 1):
        assert len(set(tx.word_hashes(found, seed).tolist())) == len(words)
    assert not set(tx.word_hashes(found, 0).tolist()) & set(tx.word_hashes(found, 1).tolist())


def corpus(seed, n=60):
    rnd = random.Random(seed)
    passages = [[f"p{k}x{i}" for i in range(rnd.randint(9, 60))] for k in range(5)]
    rows = []
    for k in range(n):
        words = []
        for _ in range(rnd.randint(0, 5)):
            words += [f"u{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 12))]
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            words += p[a : a + rnd.randint(1, 60)]
        if k % 11 == 0:
            words += ["same"] * rnd.randint(1, 40)  # equal grams within a window
        if k % 13 == 0:
            words.insert(0, "L" * 3000 + str(k % 2))  # a word too long to be spelt out
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_small_parts_passages_and_automata(spark, monkeypatch, seed):
    monkeypatch.setattr(phrases, "PART_BYTES", 3000)
    monkeypatch.setattr(phrases, "AUTOMATON_BYTES", 400)
    monkeypatch.setattr(phrases, "PASSAGE", 7)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain.without_repeats(rows, 9)
    assert sum(r[2] for r in want) > 300
    assert rows_of(phrases.without_repeats(df, window=9, anchor=3)) == want


@pytest.mark.parametrize("places", ["none", "all"])
def test_automata_decide(spark, monkeypatch, places):
    """Without what they locate nothing goes; if they located everything, all would go."""

    def located(self, made):
        n = len(self.words.starts) if places == "all" else 0
        return np.arange(n), np.ones(n, np.int64)

    monkeypatch.setattr(phrases.Texts, "located", located)
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = rows_of(phrases.without_repeats(df, window=9, anchor=3))
    assert found != plain.without_repeats(rows, 9)
    assert [r[2] for r in found] == [r[1] if places == "all" else 0 for r in found]


def test_passages_are_spelt_as_they_stand():
    long_ = "y" * 100
    texts = phrases.Texts(pa.array([f"a {long_} b", "b c", f"a {long_} b c"]), 2, 1)
    for first, words in ((0, 2), (3, 2), (5, 3)):
        (made,) = phrases.automata([(texts.passage(first, words), words)])
        at, size = texts.located([made])
        own = texts.passage(first, words)
        assert (first, words) in list(zip(at.tolist(), size.tolist()))
        for a, n in zip(at.tolist(), size.tolist()):
            assert texts.passage(a, n) == own
    # "b" ends the first text and "b c" begins the second: no passage goes across.
    (made,) = phrases.automata([(" b b ", 2)])
    assert texts.located([made])[0].tolist() == []
