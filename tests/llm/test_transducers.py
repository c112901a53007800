"""Character maps, unused pieces and long runs of white space, against the library."""

import time

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from test_tokens import PIECES, TRANSDUCER, unigram

from wayfold.llm import pieces


def with_map(rule):
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    made = sentencepiece_model_pb2.ModelProto.FromString(normaliser.serialized_model_proto())
    model = unigram(True)
    model.normalizer_spec.precompiled_charsmap = made.normalizer_spec.precompiled_charsmap
    return model


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf"])
def test_character_maps(rule):
    model = with_map(rule)
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    own = pieces.Transducer.compile(model)
    rng = np.random.default_rng(6)
    letters = list("abcABC x\t\n") + ["ａ", "Ｂ", "①", "ﬁ", "½", "é", "é", "​", "　", "ｶﾞ", "日", "Å", "­", "ß"]
    for _ in range(400):
        text = "".join(rng.choice(letters, rng.integers(0, 12)))
        assert own.encode(text) == library.encode(text), repr(text)


def merges(unused):
    m = unigram(True)
    m.trainer_spec.model_type = 2
    del m.pieces[259:]
    for k, p in enumerate(["ab", "abc", "▁a", "bc", "▁ab", "abab", "▁abc"]):
        m.pieces.add(piece=p, score=-float(k), type=5 if p in unused else 1)
    for k, p in enumerate("▁abc"):
        m.pieces.add(piece=p, score=-100.0 - k, type=1)
    return m


@pytest.mark.parametrize("unused", [(), ("abab",), ("ab", "▁ab")])
def test_unused_pieces(unused):
    model = merges(unused)
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    own = pieces.Transducer.compile(model)
    rng = np.random.default_rng(7)
    for _ in range(300):
        text = "".join(rng.choice(list("aabbc x"), rng.integers(0, 14)))
        assert own.encode(text) == library.encode(text), text


def test_runs_of_white_space_take_linear_time():
    for text in (" " * 100_000, "a" + "  b" * 5000, "\t" * 50_000, "x" * 50_000):
        began = time.process_time()
        got = TRANSDUCER.encode(text)
        assert time.process_time() - began < 2.0
        assert got == PIECES.encode(text)
