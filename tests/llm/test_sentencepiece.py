from __future__ import annotations

import hashlib
import os
import struct

import numpy as np
import pytest
import sentencepiece

from quaymark.llm import sentencepiece_backend as sp

PATH = os.environ.get("QUAYMARK_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
needs_model = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer model here")
ODD = ["", " ", "  a   b    c     d", " " * 37 + "x" + " " * 5, "a\nb\n\n c\t\td", "▁x ▁▁ y", "\x00\x01é日本語🙂", "<s> </s> <unk> <0x41>", "a" * 300, "  \n  "]


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return f.read()


@needs_model
def test_parity_and_round_trip(model):
    theirs, own, encoder = sentencepiece.SentencePieceProcessor(model_proto=model), sp.Model(model), sp.Encoder(model)
    for text, ids, (raw, parity, whole) in zip(ODD, own.encode(ODD), encoder.encode(ODD), strict=True):
        assert ids == theirs.encode(text) == np.frombuffer(raw, np.int32).tolist()
        assert parity and whole
        assert own.decode([ids])[0] == theirs.decode(ids)


def field(number, value):
    if isinstance(value, int):
        return bytes([number << 3, value])
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    return bytes([number << 3 | 2, len(value)]) + value


def unigram():
    """A unigram model written by hand: no training."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -3.0, 1), ("▁he", -1.0, 1), ("l", -2.5, 1), ("lo", -1.5, 1), ("llo", -4.5, 1), ("o", -3.0, 1)]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    trainer = field(3, 1)
    return data + field(2, trainer) + field(3, field(1, b"identity") + field(3, 1) + field(4, 1) + field(5, 1))


def test_unigram_model():
    data = unigram()
    theirs, own = sentencepiece.SentencePieceProcessor(model_proto=data), sp.Model(data)
    texts = ["hello", " hello   hello ", "lo", "", "o o"]
    assert own.encode(texts) == [theirs.encode(t) for t in texts]
    assert own.decode(own.encode(["hello hello"])) == ["hello hello"]


@needs_model
def test_tables(spark, model, odd_docs, no_docs):
    theirs = sentencepiece.SentencePieceProcessor(model_proto=model)
    found = sp.encode_report(odd_docs, model).collect()
    want = sorted(hashlib.sha256(np.array(theirs.encode(r["text"] or ""), np.int32).tobytes()).hexdigest() for r in odd_docs.collect())
    assert sorted(r["ids_sha256"] for r in found) == want
    assert all(r["parity"] and r["round_trip"] for r in found)
    back = sp.decode(sp.encode(odd_docs, model), model)
    assert sorted(map(str, (r["text"] for r in back.collect()))) == sorted(map(str, (r["text"] for r in odd_docs.collect())))
    assert sp.encode_report(no_docs, model).count() == 0


@needs_model
@pytest.mark.parametrize("piece", ["<user>", "ab▁cd"])
def test_user_defined_pieces(model, piece):
    data = model + field(1, field(1, piece.encode()) + field(2, 0.0) + field(3, sp.USER_DEFINED))
    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["", "a <user>b <user><user> c", "<user>", "xab cdy ab  cd", "no such piece"]
    found = sp.Encoder(data).encode(texts)
    assert [np.frombuffer(ids, np.int32).tolist() for ids, _, _ in found] == theirs.encode(texts)
    assert all(parity for _, parity, _ in found)


@needs_model
def test_parity_compares_whole_texts(model, monkeypatch):
    encoder = sp.Encoder(model)
    monkeypatch.setattr(encoder.model, "normalise", lambda text: "▁" + text.replace(" ", "▁").lower())
    assert [parity for _, parity, _ in encoder.encode(["plain words", "Capital words"])] == [True, False]


@needs_model
def test_very_long_texts(spark, model):
    from llm_rows import make

    long = "some words of a very long text " * 60_000
    found = sp.encode_report(make(spark, [(1, long, "en", "s"), (2, "x" * 200_000, "en", "s")]), model).collect()
    assert all(r["parity"] and r["round_trip"] for r in found)
