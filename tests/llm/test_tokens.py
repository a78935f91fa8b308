import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from rekurve.llm import bpe, token_counts

NOTES = "experiment_id long, description string"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, COUNTER = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
OWN, NATIVE = bpe.WordTokenizer(WORD), bpe.WordTokenizer(WORD, native=True)
LENGTHS = token_counts.Lengths(BYTE, {" cell": 1})
TEXTS = st.one_of(
    st.text(st.characters(codec="utf-8")),
    st.lists(st.sampled_from(["Bleach", " cell", "'S", "don't", "<|endoftext|>", "<|startoftext|>", "\n\n", "  ", "\t", "é", "é", "ΣΑΣ", "İ", "\x85", "\xa0", "\x1c", "12", "½", "…", "細胞", "ﬁ", "🙂", "՘", " ", "꟎"])).map("".join),
)


def whole(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=600, deadline=None)
@given(TEXTS)
def test_encoder_is_the_library(text):
    assert OWN.encode(text) == whole(text) and NATIVE.ids_of(text) == OWN.ids_of(text) == whole(text)[0]
    assert OWN.decode(np.frombuffer(whole(text)[0], "<u4").tolist()) == whole(text)[1]


@settings(max_examples=600, deadline=None)
@given(TEXTS)
def test_count_is_the_library(text):
    assert LENGTHS.count(text) == len(COUNTER.encode(text, add_special_tokens=False).ids)


@settings(max_examples=200, deadline=None)
@given(st.text("abinthe", min_size=1, max_size=150))
def test_heap_is_scan(word):
    assert bpe.merge_heap(word + bpe.END, OWN.ranks) == bpe.merge_scan(word + bpe.END, OWN.ranks)


def test_every_code_point():
    for a in range(0, 0x30000, 64):
        text = "".join(f"a{chr(c)}1{chr(c)}. " for c in range(a, a + 64) if not 0xD800 <= c < 0xE000)
        assert OWN.encode(text) == whole(text)
        assert LENGTHS.count(text) == len(COUNTER.encode(text, add_special_tokens=False).ids)


def test_memory(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_HELD", 3)
    t = bpe.WordTokenizer(WORD)
    for text in ("one two three four five", "five four six one", "one " + "x" * 500):
        assert t.encode(text) == whole(text) and len(t.memory) <= 3


ROWS = [(1, None), (2, ""), (3, "The bleached spot <|endoftext|> recovers. "), (3, "The bleached spot <|endoftext|> recovers. "), (None, "细胞 recovery"), (5, "ab" * 60_000), (6, "Spot recovers, slowly. " * 20_000)]


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in ROWS], NOTES + ", n_tokens int, decoded string")


def test_digests(spark, table):
    got = sorted(map(tuple, bpe.note_digests(table, WORD).collect()), key=repr)
    want = [(i, len(w[0]) // 4, hashlib.sha256(w[0]).hexdigest(), hashlib.sha256(w[1].encode()).hexdigest()) for i, t in ROWS for w in [whole(t or "")]]
    assert got == sorted(want, key=repr)
    assert sorted(((r.experiment_id, r.ids, r.decoded) for r in bpe.encode_notes(table, WORD).collect()), key=repr) == sorted(((i, np.frombuffer(w[0], "<u4").tolist(), w[1]) for i, t in ROWS for w in [whole(t or "")]), key=repr)
    assert bpe.note_digests(table.limit(0), WORD).count() == 0


def test_counts(spark, table):
    got = sorted(map(tuple, token_counts.count_note_tokens(table, BYTE).collect()), key=repr)
    n = lambda t: len(COUNTER.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((i, len((t or "").encode()), n(t), n(t) > 1024) for i, t in ROWS), key=repr)
    assert token_counts.count_note_tokens(table.limit(0), BYTE).count() == 0
