"""Token files and the SentencePiece codec against the libraries themselves."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from quire.llm.pieces import PieceEncoder, byte_level_pieces
from quire.llm.sentencepiece_codec import ModelFile, codec, decode_documents, encode_documents, fields
from quire.llm.token_files import byte_level_encoder, read_token_files, write_token_files

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(n: int) -> list[str]:
    rnd = random.Random(1)
    bits = ["a", "b", " ", "\n", "  ", "'s", "1", "é", ".", "\t", "\x1c", "\r", "日本", "▁", "<s>", "<0x0A>", "\0", " \n", "<|endoftext|>", "the", "😀"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_pieces_join_to_the_text_encoding():
    from tokenizers import Tokenizer

    library, (encode, _) = Tokenizer.from_file(BYTE_BPE), byte_level_encoder(BYTE_BPE)
    texts = odd_texts(3000)
    for text, got in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(got, encode.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert "".join(byte_level_pieces(text)) == text


def test_known_pieces_are_bounded():
    encoder = PieceEncoder(lambda t: t.split(), lambda parts: [[len(p)] for p in parts], "<u2", most=3)
    for k in range(20):
        assert encoder([f"w{k} v{k}"]) == [np.array([len(f"w{k}"), len(f"v{k}")], "<u2").tobytes()]
        assert len(encoder.known) <= 6


def test_token_files_round_trip(spark, edge_docs, no_docs, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    write_token_files(edge_docs.repartition(3), folder, BYTE_BPE, end_id=2)
    got = [tuple(r) for r in read_token_files(spark, folder).orderBy("start").collect()]
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "", r.doc_id) for r in edge_docs.collect()))
    at, want = 0, []
    for _, _, text, doc_id in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    write_token_files(no_docs, folder + "-none", BYTE_BPE, end_id=2)
    assert read_token_files(spark, folder + "-none").collect() == []


def test_codec_agrees_with_sentencepiece():
    import sentencepiece

    peer, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), codec(PIECES)
    texts = odd_texts(4000)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == peer.encode(text), repr(text)
        assert own.decode(ids) == peer.decode(ids.tolist())
    assert not own.differ


def test_protobuf_fields_and_model_file():
    assert list(fields(bytes([8, 150, 1, 18, 2, 104, 105, 29, 0, 0, 128, 63]))) == [(1, 150), (2, b"hi"), (3, b"\0\0\x80?")]
    model = ModelFile(PIECES)
    assert len(model.pieces) == 32_000 and model.byte_fallback and model.separable()
    scores = {p: s for p, s, _ in model.pieces}
    merged = [scores[a + b] for a, b in model.merges()]
    assert merged == sorted(merged, reverse=True)


def test_encode_and_decode_documents(edge_docs, no_docs):
    import sentencepiece
    from pyspark.sql import functions as F

    peer = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = encode_documents(edge_docs, PIECES, check_whole=F.lit(True))
    rows = out.collect()
    assert len(rows) == edge_docs.count() and all(r.parity and r.round_trip for r in rows)
    want = sorted((r.doc_id or -1, *peer.encode(r.text or "")) for r in edge_docs.collect())
    assert sorted((r.doc_id or -1, *r.ids) for r in rows) == want
    back = sorted((r.doc_id or -1, r.text) for r in decode_documents(out, PIECES).collect())
    assert back == sorted((r.doc_id or -1, r.text or "") for r in edge_docs.collect())
    assert encode_documents(no_docs, PIECES).collect() == []


@pytest.mark.parametrize("lead", ["", " ", "  ", "\n"])
def test_leading_blanks(lead):
    import sentencepiece

    peer = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert codec(PIECES).encode([lead + "the cat"])[0].tolist() == peer.encode(lead + "the cat")
