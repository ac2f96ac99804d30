"""Pieces against the tokenizer itself."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm.packing import LENGTH, load_tokenizer, pack, worker_encoder

TOKENIZER = load_tokenizer("word_bpe_49k.json")


def same_ids(text):
    encoder = worker_encoder("word_bpe_49k.json")
    assert np.frombuffer(encoder.texts([text])[0], encoder.kind).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["\u0130\u0650", "a \u0130\u0307\u0323b", "e\u0301 \u1e9b\u0323", "ΣΑΣ Σ. ς", "ǅ ŉ ﬁ ß", "<|endoftext|> x", "it's I'LL don't 'sx", "_a_b__1", "x" * 5000, "١٢ ²½", "\x1c\x85\u2028a", "한글 ห้ กำ"])
def test_hard_texts_have_the_ids_of_the_library(text):
    same_ids(text)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeIsTt' .,!_1\u0130\u0650\u0301\u0307\u0323\u03a3\u1e9b\u0345\u0391İΣé<|>\n\x1c\x85"), st.characters(exclude_categories=["Cs"])), max_size=25))
def test_any_text_has_the_ids_of_the_library(text):
    same_ids(text)


def check(df, length=LENGTH):
    tokenizer = load_tokenizer("word_bpe_49k.json")
    got = pack(df, length).collect()
    want = sorted(((r["doc_id"], [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in df.collect()), key=str)
    # sequences are gapless, and full but the last
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s, pieces in by.items():
        pieces.sort()
        assert [a for a, _ in pieces] == np.r_[0, np.cumsum([n for _, n in pieces])][:-1].tolist()
        assert sum(n for _, n in pieces) == length or s == max(by)
    # rows of one id are put together in the order of the stream
    docs, open_ = [], {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        key = r["doc_id"]
        open_.setdefault(key, []).append(r)
        if r["start"] + r["length"] == r["doc_tokens"]:
            docs.append((key, open_.pop(key)))
    assert not open_
    left = list(want)
    for key, pieces in docs:
        place = next(i for i, (d, ids) in enumerate(left) if d == key and all(p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for p in pieces))
        at = 0
        for p in pieces:
            assert p["start"] == at
            at += p["length"]
        left.pop(place)
    assert not left


def test_whole_table(documents):
    check(documents.repartition(5))


def test_odd_rows(odd_docs):
    check(odd_docs)
    check(odd_docs, 64)


def test_no_rows(no_docs):
    assert pack(no_docs).collect() == []
