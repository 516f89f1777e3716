from __future__ import annotations

import io
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from namewright.llm import token_store as ts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(ts.default_tokenizer())


def brute(rows, library):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_encoder_equals_the_library(library):
    rng = random.Random(0)
    enc = ts.PieceEncoder(ts.default_tokenizer())
    bits = ["a", "b's", "'s", " ", " ", "  ", "\n", "\n\n", "\t", " \n", "é", "漢", "1", "23", "!!", "\0", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "'re", "<|endoftext|>", "<|endof", "text|>", "\u200b", "٣", "²", "_", "-", ".", ",", "ab.", "x", "Ünï,", "𝒳", "\u0301", "Ġ", "Ċ", " the", "word. "]
    for n in (1, 7, 300):
        for _ in range(6000 // n):
            made = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(n)]
            for text, ids in zip(made, enc.encode_all(ts.pa.array(made, "string")), strict=True):
                assert np.frombuffer(ids, enc.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_the_tables(spark, sf_dir, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in ts.op4_token_output(spark, sf_dir).collect()), key=lambda r: r[1])
    assert got == brute(rows, library)


def test_edges_of_the_input(spark, library):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "same"), (3, "same"), (3, "other"), (4, "long word " * 30_000), (-5, "x" * 50_000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, ids string")
    got = sorted((tuple(r) for r in ts.token_output(docs, ts.default_tokenizer()).collect()), key=lambda r: r[1])
    assert got == brute(rows, library)


def test_empty_table(spark):
    assert ts.token_output(spark.createDataFrame([], "doc_id long, text string"), ts.default_tokenizer()).count() == 0


def written(frame_bytes=64):
    sink = io.BytesIO()
    writer = ts.FrameWriter(sink, 2, frame_bytes)
    docs = [np.arange(n, dtype="<u2") + n for n in (3, 0, 40, 100, 1, 5)]
    for i, ids in enumerate(docs):
        writer.add(i, ids.tobytes())
    writer.close()
    return sink.getvalue(), docs


def test_documents_are_read_one_by_one_and_in_any_order():
    raw, docs = written()
    reader = ts.FrameReader(io.BytesIO(raw))
    assert len(reader.frames) > 2
    for place in (3, 0, 5, 1, 2, 4):
        assert reader.ids(place).tolist() == docs[place].tolist()


def test_a_plain_zstandard_reader_sees_the_ids():
    import zstandard

    raw, docs = written()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole == b"".join(d.tobytes() for d in docs)


def test_a_broken_frame_is_told():
    raw, _ = written()
    reader = ts.FrameReader(io.BytesIO(raw))
    broken = bytearray(raw)
    broken[int(reader.starts[1]) + 10] ^= 1
    other = ts.FrameReader(io.BytesIO(bytes(broken)))
    with pytest.raises(Exception):
        for place in range(6):
            other.ids(place)
