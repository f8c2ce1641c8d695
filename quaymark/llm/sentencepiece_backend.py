"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model's protobuf is read field by field; its normaliser, metaspace
marker, scores (unigram, or merges of a BPE model in order of score) and byte
fallback are rebuilt as a ``tokenizers`` model. If no piece has the marker
after another character, a text falls apart at its markers, and at user-defined
pieces, which no normalisation touches: each batch's
distinct chunks are encoded once by the multithreaded batch call, and kept in
a bounded cache. Every whole text is encoded by the sentencepiece library too, from
the raw text on, and the ids are compared.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHE = 300_000
# Numbers of the piece types and model types of the format.
UNKNOWN, USER_DEFINED, UNUSED, BYTE = 2, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire}")
        yield key >> 3, value


class Model:
    """A SentencePiece model, rebuilt."""

    def __init__(self, data: bytes) -> None:
        from tokenizers import Tokenizer, decoders, models, normalizers

        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        norm: dict = {}
        for field, value in proto_fields(data):
            if field == 1:
                piece = dict(proto_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                self.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, 1)))
            elif field == 2:
                trainer = dict(proto_fields(value))
            elif field == 3:
                norm = dict(proto_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.dummy_prefix = bool(norm.get(3, 1))
        self.trim = bool(norm.get(4, 1))
        self.escape = bool(norm.get(5, 1))
        self.charsmap = normalizers.Precompiled(norm[2]) if norm.get(2) else None
        user = sorted((p for p, _, kind in self.pieces if kind == USER_DEFINED), key=len, reverse=True)
        self.user = re.compile("|".join(map(re.escape, user))) if user else None
        self.raw_user = re.compile("|".join(re.escape(p.replace(MARK, " ") if self.escape else p) for p in user)) if user else None
        vocab = {piece: i for i, (piece, _, _) in enumerate(self.pieces)}
        self.user_ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == USER_DEFINED}
        byte_fallback = any(kind == BYTE for _, _, kind in self.pieces)
        unknown = next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)
        if self.kind == BPE:
            model = models.BPE(
                vocab, self._merges(vocab), unk_token=self.pieces[unknown][0], fuse_unk=True, byte_fallback=byte_fallback
            )
        elif self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unknown, byte_fallback)
        else:
            raise ValueError(f"model type {self.kind} has no backend")
        self.backend = Tokenizer(model)
        steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        self.backend.decoder = decoders.Sequence([*steps, decoders.Strip(" ", 1, 0)] if self.dummy_prefix else steps)
        self.splits = all(MARK not in piece.lstrip(MARK) for piece, _, kind in self.pieces if kind not in (UNKNOWN, USER_DEFINED, UNUSED))

    def _merges(self, vocab: dict[str, int]) -> list[tuple[str, str]]:
        found = []
        for piece, score, kind in self.pieces:
            if kind == 1:
                found += [
                    (-score, vocab[piece], piece[:cut], piece[cut:])
                    for cut in range(1, len(piece))
                    if piece[:cut] in vocab and piece[cut:] in vocab
                ]
        return [(left, right) for _, _, left, right in sorted(found, key=lambda m: m[:2])]

    def normalise(self, text: str) -> str:
        if self.charsmap and self.raw_user:
            parts, at = [], 0
            for m in self.raw_user.finditer(text):
                parts += [self.charsmap.normalize_str(text[at : m.start()]), m[0]]
                at = m.end()
            text = "".join(parts) + self.charsmap.normalize_str(text[at:])
        elif self.charsmap:
            text = self.charsmap.normalize_str(text)
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if self.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text

    def chunks(self, text: str) -> list[str]:
        """The normalised text in parts that no piece spans."""
        if self.user:
            found, at = [], 0
            for m in self.user.finditer(text):
                found += [*self._plain(text[at : m.start()]), m[0]]
                at = m.end()
            return found + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not self.splits:
            return [text] if text else []
        return CHUNK.findall(text)

    def encode(self, texts: list[str]) -> list[list[int]]:
        parts = [self.chunks(self.normalise(t)) for t in texts]
        flat = self.chunk_ids([c for p in parts for c in p])
        at, out = 0, []
        for p in parts:
            out.append([i for ids in flat[at : at + len(p)] for i in ids])
            at += len(p)
        return out

    def chunk_ids(self, chunks: list[str]) -> list[list[int]]:
        """The ids of each chunk: a user-defined piece is its own."""
        ids = [x.ids for x in self.backend.encode_batch_fast(chunks, add_special_tokens=False)]
        return [[self.user_ids[c]] if c in self.user_ids else x for c, x in zip(chunks, ids, strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.backend.decode_batch(ids, skip_special_tokens=False)


CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Encoder:
    """Encodes texts chunk by chunk, and compares each whole text with the sentencepiece library."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        self.model = Model(data)
        self.other = sentencepiece.SentencePieceProcessor(model_proto=data)
        # Chunks met lately, and those of the time before: frequent ones move on when the first are full.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.lossy: set[str] = set()

    def _learn(self, new: list[str]) -> None:
        model = self.model
        pieces = [p for p, _, _ in model.pieces]
        changed = []
        for chunk, own in zip(new, model.chunk_ids(new), strict=True):
            if "".join([pieces[i] for i in own]) != chunk:
                changed.append((chunk, own))
            self.known[chunk] = array("i", own).tobytes()
        # Pieces that do not spell the chunk (bytes, unknowns) are decoded by the backend.
        back = model.decode([own for _, own in changed])
        for (chunk, _), text in zip(changed, back, strict=True):
            whole = chunk.replace(MARK, " ")
            if text != (whole[1:] if model.dummy_prefix and whole.startswith(" ") else whole):
                self.lossy.add(chunk)

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bool, bool]]:
        """(ids as 32-bit numbers, parity of the whole text, round trip) of each text."""
        parts = [self.model.chunks(self.model.normalise(t or "")) for t in texts]
        wanted = set().union(*parts)
        if new := wanted - self.known.keys():
            if len(self.known) + len(new) > CACHE:
                self.before, self.known, new = self.known, {}, wanted
                self.lossy &= self.before.keys()
            again = new & self.before.keys()
            self.known.update((c, self.before[c]) for c in again)
            self._learn(list(new - again))
        lossy, find = self.lossy, self.known.__getitem__
        theirs = self.other.encode([t or "" for t in texts], num_threads=1)
        out = []
        for p, other in zip(parts, theirs, strict=True):
            ids = b"".join(map(find, p))
            out.append((ids, ids == array("i", other).tobytes(), not lossy or lossy.isdisjoint(p)))
        return out


_encoders: dict[bytes, Encoder] = {}


def encoder_of(data: bytes) -> Encoder:
    """One encoder for each worker process, kept from task to task with its cache."""
    key = hashlib.sha256(data).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(data)
    return _encoders[key]


def _some(texts: list, size: int = 500) -> Iterator[list]:
    for at in range(0, len(texts), size):
        yield texts[at : at + size]


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, ids, n_tokens`` of every row of ``docs`` (doc_id, text); null text has no ids."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            for some in _some(list(zip(batch["doc_id"], batch["text"], strict=True))):
                found = encoder.encode([t for _, t in some])
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([None if pd.isna(i) else int(i) for i, _ in some], "Int64"),
                        "ids": [None if t is None else np.frombuffer(f[0], np.int32) for (_, t), f in zip(some, found, strict=True)],
                        "n_tokens": [len(f[0]) // 4 for f in found],
                    }
                )

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>, n_tokens long")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(shared.value)
        for batch in batches:
            texts = own.decode([[] if x is None else list(map(int, x)) for x in batch["ids"]])
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "text": [None if x is None else t for x, t in zip(batch["ids"], texts, strict=True)]}
            )

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def encode_report(docs: DataFrame, model: bytes) -> DataFrame:
    """Encode every whole text and report ``doc_id, n_tokens, ids_sha256, parity, round_trip``.

    ids_sha256 hashes the ids as little-endian 32-bit numbers. parity: the
    sentencepiece library gives the same ids for the whole raw text. round_trip: the ids decode to
    the text (as normalised). A null or empty text has no tokens and passes
    both. Repeated rows repeat; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            for some in _some(list(zip(batch["doc_id"], batch["text"], strict=True))):
                found = encoder.encode([t for _, t in some])
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([None if pd.isna(i) else int(i) for i, _ in some], "Int64"),
                        "n_tokens": [len(f[0]) // 4 for f in found],
                        "ids_sha256": [hashlib.sha256(f[0]).hexdigest() for f in found],
                        "parity": [f[1] for f in found],
                        "round_trip": [f[2] for f in found],
                    }
                )

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, n_tokens long, ids_sha256 string, parity boolean, round_trip boolean"
    )


def read_model(spark, path: str) -> bytes:
    """The model file's bytes, through Spark's reader; a model has a few MB."""
    return bytes(spark.read.format("binaryFile").load(path).select(F.col("content")).first()[0])
