"""SentencePiece codec against the library: ids, decoded text, spans, compiled character maps."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece

from sifter.llm import piece_codec
from sifter.llm.common import prepare, tokenizer_path
from tests.llm.helpers import edge_docs, edge_rows, empty_docs

ALPHABET = "aAbcé'sΣ  ▁ß  \n\t\x85\xa0\x1c12½①漢字한글​́🙂’—|<>s/0x4ﬁ㌔Ａｶﾞ゛"
NAME = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(NAME))


def random_texts(n=600):
    rng = random.Random(3)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)] + [
        "", " ", "  ", "   a  ", "▁", "▁▁a", " ▁ ", "<s></s><unk><0x41>", "a" * 500, " " * 300, "\n" * 50, "\x00a\x00"]


def test_pieces_equal_library(library):
    codec = piece_codec.PieceCodec(tokenizer_path(NAME))
    for t in random_texts():
        n, ids, decoded, begins, ends = codec.run([t])[0]
        expect = library.encode(t)
        assert list(map(int, ids.split())) == expect and n == len(expect), t
        assert decoded == library.decode(expect) == codec.decode(expect), t
        raw = t.encode()
        assert [raw[a:b].decode() for a, b in zip(begins, ends)] == [p.surface for p in library.encode(t, return_type="proto").pieces], t
        # the spans follow each other and cover the text
        assert list(begins) == [0, *ends[:-1]][:len(ends)] and (ends[-1] if len(ends) else 0) == len(raw)


def test_any_ids_decode_as_in_library(library):
    codec, rng = piece_codec.PieceCodec(tokenizer_path(NAME)), random.Random(4)
    for _ in range(1000):
        ids = [rng.choice([0, 1, 2, *range(3, 300), 29871]) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_character_map_and_alignment(rule):
    """Normal forms and alignments of compiled character maps equal the library's."""
    for more in ({}, {"add_dummy_prefix": True}, {"add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True}):
        lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, **more)
        own = piece_codec.Normaliser(piece_codec.Model(lib.serialized_model_proto()))
        for t in random_texts(150):
            norm, source = own.aligned(t)
            expect, offsets = lib.normalize(t, with_offsets=True)
            assert norm == expect, t
            # the library tells a code point of the text for each code point of the normal form
            raw, chars, at = t.encode(), [], 0
            for c in norm:
                chars.append(len(raw[:source[at]].decode()))
                at += len(c.encode())
            assert [*chars, len(raw[:source[at]].decode())] == list(offsets), t
        norm, source = own.run("plain text")
        assert source is None or len(source) == len(norm.encode()) + 1


def test_query_over_edges(spark, library):
    prepare(spark)
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_codec.encode_pieces(edge_docs(spark)).collect())
    expect = []
    for d, t, *_ in edge_rows():
        ids = library.encode(t or "", add_eos=True)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        expect.append((d or -1, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(expect)
    assert piece_codec.encode_pieces(empty_docs(spark)).count() == 0


def test_spans_and_decoding(spark, library):
    prepare(spark)
    rows = piece_codec.encode_pieces(edge_docs(spark), with_spans=True).cache()
    texts = {d: t or "" for d, t, *_ in edge_rows() if d is not None}
    for r in rows.collect():
        pairs = np.array([r.begins, r.ends], "<u8").T
        assert zlib.crc32(np.ascontiguousarray(pairs)) == r.spans_crc32 and len(r.ids) == len(r.begins) + 1 == r.n_tokens
        if r.doc_id is not None:
            raw = texts[r.doc_id].encode()
            assert b"".join(raw[a:b] for a, b in zip(r.begins, r.ends)) == raw and r.decoded == library.decode(r.ids)
    again = {(r.doc_id, r.decoded) for r in piece_codec.decode_pieces(rows).collect()}
    assert again == {(r.doc_id, r.decoded) for r in rows.collect()}
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in piece_codec.decode_pieces(nothing).collect()] == ["", ""]
