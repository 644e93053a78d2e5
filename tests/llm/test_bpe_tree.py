"""Tree concatenation against the tokenizers library itself."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from ocheline.llm import bpe_tree, queries

with open(queries.BYTE_BPE, encoding="utf-8") as f:
    VOCABULARY = f.read()

# What tokenizers trip over: contractions, white space, marks, many bytes a character, special tokens.
ALPHABET = (
    "a e s t ' 's 're ll d 1 23 = ! < é 日 😀 ̀ \xa0 \x1c 　 the ing hello THE aaaa <|endoftext|> <|endof".split(" ")
    + [" ", "  ", "\n", "\t", " world"]
)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(VOCABULARY)


@pytest.fixture(scope="module")
def coder():
    return bpe_tree.Coder(VOCABULARY)


def whole(coder, text, most, window):
    ids = []
    for run, special in coder.segments(text):
        if special is not None:
            ids.append(special)
            continue
        pieces = [coder.piece(p) for p in bpe_tree.halves(run, most)]
        while len(pieces) > 1:
            joined = [coder.join(a, b, window) for a, b in zip(pieces[::2], pieces[1::2])]
            pieces = joined + pieces[2 * len(joined) :]
        ids += pieces[0].ids.tolist()
    return ids


@pytest.mark.parametrize("seed", range(6))
def test_any_split_gives_the_library_ids(coder, library, seed):
    rnd = random.Random(seed)
    for _ in range(400):
        some = rnd.sample(ALPHABET, rnd.randint(1, len(ALPHABET)))
        text = "".join(rnd.choice(some) for _ in range(rnd.randint(1, 60)))
        want = library.encode(text, add_special_tokens=False).ids
        assert whole(coder, text, rnd.choice([4, 8, 16]), rnd.choice([1, 2, 3])) == want, text


@pytest.mark.parametrize("unit", ["a", "ab", "=", " ", "'", "x'", "\n ", "9", "日本", "they'll've ", "😀"])
def test_long_text_without_a_split(coder, library, unit):
    text = unit * 3000
    want = library.encode(text, add_special_tokens=False).ids
    assert whole(coder, text, 500, 4) == want


def test_windows_stay_small_where_both_sides_agree(coder):
    """A join looks at a few tokens, not at the halves."""
    left, right = coder.piece("some words and more " * 2000), coder.piece("of them " * 2000)
    seen = []
    small = bpe_tree.Coder(VOCABULARY)
    small.piece = lambda text: seen.append(len(text)) or coder.piece(text)
    small.join(left, right)
    assert sum(seen) < 500


def test_wrong_joins_are_seen(coder, library):
    """Without the check both halves would be put together as they are."""
    text = "internationalization" * 50
    pieces = [coder.piece(p) for p in bpe_tree.halves(text, 64)]
    glued = [i for p in pieces for i in p.ids.tolist()]
    want = library.encode(text, add_special_tokens=False).ids
    assert glued != want and whole(coder, text, 64, 2) == want


def test_decoding_equals_the_library(library):
    ids = [0, 255, 300, 50256, 188, 50255, 188, 222, 254]
    found = bpe_tree.Spelling(VOCABULARY).decode(np.array(ids, np.uint32), np.array([3, 3, len(ids)]))
    assert found == [library.decode(i, skip_special_tokens=False) for i in (ids[:3], [], ids[3:])]


@pytest.mark.parametrize("most", [1, 1 << 18])
def test_whole_tables(spark, messy, library, monkeypatch, most):
    monkeypatch.setattr(bpe_tree, "MOST_IDS", most)
    monkeypatch.setattr(bpe_tree, "PIECE_BYTES", most)
    texts, frame = messy
    both = bpe_tree.encoded(frame, VOCABULARY, long_bytes=1000, round_trip=True).withColumnRenamed("decoded", "own")
    found = bpe_tree.decoded(both, VOCABULARY)
    assert found.where("own <> decoded or own is null").count() == 0
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in texts]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in found.collect()), key=key) == sorted(want, key=key)


def test_empty_table_and_null_ids(spark, none):
    assert bpe_tree.decoded(bpe_tree.encoded(none, VOCABULARY), VOCABULARY).collect() == []
    frame = spark.createDataFrame([(1, None), (2, [50256, 99999, None])], "k long, ids array<int>")
    assert [r.decoded for r in bpe_tree.decoded(frame, VOCABULARY).orderBy("k").collect()] == ["", "<|endoftext|>"]


def test_special_tokens_in_long_texts(spark, library):
    text = ("word <|endoftext|>" * 40 + "<|endof" + "text|> ") * 30 + "<|endoftext|>"
    frame = spark.createDataFrame([("x", text), ("y", text), ("z", "<|endoftext|>")], "name string, text string")
    found = bpe_tree.encoded(frame, VOCABULARY, "name", long_bytes=256).collect()
    want = library.encode(text, add_special_tokens=False).ids
    assert {r.name: r.ids for r in found} == {"x": want, "y": want, "z": [50256]}


def test_query_equals_the_library(spark, library):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id] = (
            len(ids),
            hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest(),
        )
    found = queries.op11_bpe_tree(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == want
