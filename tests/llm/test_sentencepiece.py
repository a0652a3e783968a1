"""The encoder against SentencePiece's own unigram encoder, and long texts in parts."""

import struct
import tracemalloc

import numpy as np
import pytest
import sentencepiece

from scribewash.llm import sentencepiece_viterbi as spv


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(k, x):
    if isinstance(x, bytes):
        return _varint(k << 3 | 2) + _varint(len(x)) + x
    return _varint(k << 3 | 5) + struct.pack("<f", x) if isinstance(x, float) else _varint(k << 3) + _varint(x)


def unigram_model(vocabulary):
    """The vocabulary with its scores as a unigram model of SentencePiece."""
    base = sentencepiece.SentencePieceProcessor(model_file=spv.DEFAULT_MODEL)
    score = {i: s / spv.SCALE for _, s, i in vocabulary.pieces}
    out = b""
    for i in range(base.get_piece_size()):
        kind = 2 if base.is_unknown(i) else 3 if base.is_control(i) else 6 if base.is_byte(i) else 1
        out += _field(1, _field(1, base.id_to_piece(i).encode()) + _field(2, score.get(i, 0.0)) + _field(3, kind))
    out += _field(2, _field(3, 1) + _field(35, 1)) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 0) + _field(5, 1))
    return sentencepiece.SentencePieceProcessor(model_proto=out)


@pytest.fixture(scope="module")
def vocabulary():
    return spv.Vocabulary.load(spv.DEFAULT_MODEL)


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), np.int32).tolist()


def test_equals_the_unigram_encoder(spark, vocabulary):
    """Equal ids, but for ties and for sums that the library rounds to 32 bits: ours never score less."""
    own, encoder = unigram_model(vocabulary), spv.Encoder(vocabulary)
    score = {i: s for _, s, i in vocabulary.pieces}
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text]
    texts += ["Hello world this is a test", "日本語 \U0001f600 é\n\nx", "  two  blanks ", "a\tb\n"]
    total = lambda ids: sum(score.get(i, encoder.unknown) for i in ids)
    pairs = [(ids_of(encoder, t), own.encode(t)) for t in texts]
    assert all(a == b or 0 <= total(a) - total(b) < 1e-6 * -total(b) for a, b in pairs)
    assert sum(a == b for a, b in pairs) > 0.9 * len(pairs)
    assert own.encode("Hello world this is a test", out_type=str) == ["▁Hello", "▁world", "▁this", "▁is", "▁a", "▁test"]


def test_a_unigram_model_keeps_its_scores(vocabulary, tmp_path):
    path = tmp_path / "unigram.model"
    path.write_bytes(unigram_model(vocabulary).serialized_model_proto())
    loaded = spv.Vocabulary.load(str(path))
    assert max(abs(a[1] - b[1]) for a, b in zip(loaded.pieces, vocabulary.pieces)) <= 2


def test_parts_and_windows_change_nothing(monkeypatch, vocabulary):
    texts = ["x" * 500 + "ab" * 300, "the" * 400, " " * 300 + "a", "日" * 200 + "é \n " * 90, "one two  three " * 50, "▁ " * 70]
    whole = [ids_of(spv.Encoder(vocabulary), t) for t in texts]
    monkeypatch.setattr(spv, "PART_CHARS", 50)
    for window in (1, 17, 33):
        monkeypatch.setattr(spv, "WINDOW_CHARS", window)
        monkeypatch.setattr(spv, "CACHE_BYTES", 1000)
        assert [ids_of(spv.Encoder(vocabulary), t) for t in texts] == whole


@pytest.mark.parametrize("unit", ["lorem ipsum dolor ", "abcxyz"])
def test_long_texts_take_little_memory(vocabulary, unit):
    text = unit * (3_000_000 // len(unit))
    encoder = spv.Encoder(vocabulary)
    tracemalloc.start()
    n = sum(len(ids) for _, ids in encoder.parts(text)) // 4
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 100_000 and peak < 40e6
