"""The transducer against the public library, and exact round trips."""

import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from graphloom.llm.pieces import MODEL, Transducer, decode_pieces, encode_pieces, op3_columns, worker_transducer

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))


def ids(text):
    return np.frombuffer(worker_transducer(MODEL).encode(text), "<i4").tolist()


def model(**spec):
    proto = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path(MODEL), "rb") as f:
        proto.ParseFromString(f.read())
    for key, value in spec.items():
        setattr(proto.normalizer_spec, key, value)
    return proto


@pytest.mark.parametrize("text", ["", " ", "  two  spaces ", "Hello, world!", "naïve façade ß", "中文 🙂", "a\nb\t\tc", "▁mark", "xxxxxxxxxxxx", "\u0000​", "a" * 300, "中文🙂" * 100, "def f(x):\n        return  x\n" * 30])
def test_equals_the_library(text):
    assert ids(text) == LIBRARY.encode(text)


@pytest.mark.parametrize("text", [" " * 100_000, "ab" * 50_000, "   x" * 20_000, "é̀" * 50_000])
def test_long_runs_take_time_in_proportion(text):
    began = time.perf_counter()
    assert ids(text) == LIBRARY.encode(text)
    assert time.perf_counter() - began < 30


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeioust nrl  ABé▁\n.,1中"), max_size=90))
def test_random_texts_equal_the_library(text):
    assert ids(text) == LIBRARY.encode(text)


def test_a_normaliser_with_rules():
    rules = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    charsmap = sentencepiece_model_pb2.ModelProto.FromString(rules.serialized_model_proto()).normalizer_spec.precompiled_charsmap
    assert charsmap
    for squeeze in (True, False):
        proto = model(precompiled_charsmap=charsmap, remove_extra_whitespaces=squeeze).SerializeToString()
        library, own = sentencepiece.SentencePieceProcessor(model_proto=proto), Transducer(proto)
        for text in ["", "  ", "ﬁne ①２ Ｆｕｌｌ  width　x ", "é ㍿ ™ ​ a\tb\r\n", "ﾊﾟ 한글 한", "plain", "が"]:
            assert np.frombuffer(own.encode(text), "<i4").tolist() == library.encode(text), text


def test_a_unigram_model():
    """Scores of their own make the shortest path, not the merges."""
    proto = model()
    proto.trainer_spec.model_type = 1
    for i, p in enumerate(proto.pieces):
        p.score = -1.0 - (i * 7919 % 1009) / 100 if p.type == 1 else p.score
    library, own = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()), Transducer(proto.SerializeToString())
    for text in ["Hello, world!", "the quick brown fox jumps", "naïve façade ß 中文 🙂🙂", "   x  ", "internationalisation of it all"]:
        assert library.decode(np.frombuffer(own.encode(text), "<i4").tolist()) == library.decode(library.encode(text))
        cost = lambda x: sum(-proto.pieces[i].score for i in x if proto.pieces[i].type == 1)
        assert abs(cost(np.frombuffer(own.encode(text), "<i4").tolist()) - cost(library.encode(text))) < 1e-3, text


def test_whole_table(documents):
    got = {r["doc_id"]: r["ids"] for r in encode_pieces(documents).collect()}
    assert got == {r["doc_id"]: LIBRARY.encode(r["text"] or "") for r in documents.collect()}
    assert op3_columns(documents).filter("NOT round_trip").isEmpty()


def test_odd_rows(odd_docs):
    rows = decode_pieces(encode_pieces(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["decoded"] == (r["text"] or "") for r in rows)


def test_no_rows(no_docs):
    assert op3_columns(no_docs).collect() == []
