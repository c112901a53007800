import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from wayfold.llm import bpe, packing, pieces, token_counts

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ODD = ["", " ", "  a  b ", "a\n b", "\n\n x", "tab\t x", "<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>", "it's we'll", "日本語 テキスト", "🙂 ok", "a b", "a  b", "a\x1c b", "a 　b", "word " * 3000, "x" * 5000, "é ́"]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def by_runs(text):
    return [i for r in bpe.runs(text) for i in bpe.encoder().ids(r)]


@pytest.mark.parametrize("text", ODD)
def test_runs_give_the_librarys_ids(text):
    assert "".join(bpe.runs(text)) == text
    assert by_runs(text) == ids(text)


@given(st.text(st.sampled_from(" \n\t\r \u0085ab1'.<|é日"), max_size=30))
@settings(max_examples=300, deadline=None)
def test_runs_of_any_text(text):
    assert by_runs(text) == ids(text)


def test_every_plain_character_is_alike_in_both_libraries():
    plain = [chr(c) for c in range(0x2100) if bpe._PLAIN.fullmatch(chr(c)) and unicodedata.category(chr(c)) != "Cs"]
    texts = [f"a{c}1{c}{c}!" for c in plain]
    assert [bpe.encoder().quick(t) for t in texts] == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(docs):
    rows = [(i, t, "en") for i, t in enumerate(ODD)] + [(100, None, None), (0, "", "en"), (None, "a b", "en")]
    found = sorted(token_counts.token_counts(docs(rows), limit=10).collect(), key=str)
    wanted = sorted(((i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 10) for i, t, _ in rows), key=lambda r: str(r))
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
    assert token_counts.token_counts(docs([])).count() == 0


def test_summaries_stay_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_counts, "SUMMARY", 10)
    monkeypatch.setattr(token_counts, "HANDED_ON", 5)
    text = " ".join(["the"] * 500 + [str(i) for i in range(1000)])
    (out,) = token_counts._summaries(iter([pa.RecordBatch.from_arrays([pa.array([text])], ["text"])]))
    assert out.num_rows <= 5 and " the" in out.column(0).to_pylist()


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
@settings(max_examples=200, deadline=None)
def test_best_fit_equals_placing_one_by_one(histogram):
    plans, made = packing.best_fit(histogram, 64)
    room = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [k for k, r in enumerate(room) if r >= length]
            if fits:
                room[min(fits, key=lambda k: room[k])] -= length
            else:
                room.append(64 - length)
    assert made == len(room)
    used = {}
    for length, p in plans.items():
        for rank in range(histogram[length]):
            i = int(np.searchsorted(p.first, rank, "right")) - 1
            k, at = divmod(rank - int(p.first[i]), int(p.each[i]))
            used.setdefault(int(p.sequence[i]) + k, []).append((int(p.offset[i]) + at * length, length))
    for slots in used.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(64 - sum(n for _, n in s) for s in used.values()) == sorted(room)


def test_packing(docs):
    rows = [(i, "word " * n, "en") for i, n in enumerate([0, 1, 5, 5, 5, 40, 200, 64, 63, 62])] + [(20, None, None), (2, "word " * 5, "en")]
    found = packing.pack(docs(rows), capacity=64).collect()
    whole = {i: ids(t) + [0] for i, t, _ in rows}
    places = {}
    for r in found:
        piece = np.array(whole[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r.length for r in found) == sum(len(ids(t)) + 1 for _, t, _ in rows)
    assert all(r.length == 64 for r in found if r.piece > 0)
    assert packing.pack(docs([])).count() == 0


# ---- pieces

PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
TRANSDUCER = pieces.Transducer.load(public_tokenizers.path(pieces.MODEL))


@given(st.text(st.sampled_from(" ▁abtheinoTHE\n.,!$12²'é日🙂한"), max_size=40))
@settings(max_examples=500, deadline=None)
def test_merge_models_match_the_library(text):
    got = TRANSDUCER.encode(text)
    assert got == PIECES.encode(text)
    assert TRANSDUCER.decode(got) == PIECES.decode(got)


def unigram(byte_fallback):
    m = sentencepiece_model_pb2.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, byte_fallback
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = "identity", True, True, True
    m.trainer_spec.unk_id, m.trainer_spec.bos_id, m.trainer_spec.eos_id, m.trainer_spec.pad_id = 0, 1, 2, -1
    for p, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=p, score=0, type=kind)
    if byte_fallback:
        for b in range(256):
            m.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    for k, p in enumerate(["▁", "a", "b", "c", "ab", "bc", "▁a", "abc", "▁ab", "cab", "▁c", "ca"]):
        m.pieces.add(piece=p, score=-1.0 - 0.37 * ((7 * k) % 11), type=1)
    return m


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_models_match_the_library(byte_fallback):
    model = unigram(byte_fallback)
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    own = pieces.Transducer.compile(model)
    rng = np.random.default_rng(5)
    for _ in range(300):
        text = "".join(rng.choice(list("abc  x"), rng.integers(0, 14)))
        assert own.encode(text) == library.encode(text), text


def test_encode_and_decode(docs):
    rows = [(0, "The end. \n  of it", "en"), (1, None, None), (2, "", "en"), (3, "日本 🙂", "xx"), (0, "The end. \n  of it", "en"), (4, "long " * 20000, "en")]
    found = {r.doc_id: r for r in pieces.encode_and_decode(docs(rows)).collect()}
    for i, t, _ in rows:
        want = PIECES.encode(t or "")
        assert found[i].n_pieces == len(want) and found[i].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes()) and found[i].round_trip
    lists = {r.doc_id: r.ids for r in pieces.encode(docs(rows)).collect()}
    assert lists[3] == PIECES.encode("日本 🙂") and lists[1] == []
    assert pieces.encode_and_decode(docs([])).count() == 0
