"""Exact round trips of the coder and of whole tables."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from daybook.llm import codec
from daybook.llm import token_files as K


@pytest.mark.parametrize("n", [0, 1, 2, 4095, 4096, 4097, 20_000])
@pytest.mark.parametrize("kind", ["random", "skewed", "constant", "periodic", "large"])
def test_round_trip(n, kind):
    rng = np.random.default_rng(n)
    tokens = {
        "random": lambda: rng.integers(0, 49_408, n),
        "skewed": lambda: rng.zipf(1.4, n) % 49_000,
        "constant": lambda: np.full(n, 7),
        "periodic": lambda: np.arange(n) % 37 * 1000,
        "large": lambda: rng.integers(0, 2**32, n),
    }[kind]().astype("<u4")
    raw = codec.pack_file(3, [5, None, -9], [n, 0, 0], tokens)
    part, ids, counts, back = codec.unpack_file(raw)
    assert (part, ids, counts) == (3, [5, None, -9], [n, 0, 0]) and back.tobytes() == tokens.tobytes()
    if n == 20_000 and kind in ("constant", "periodic"):
        assert len(codec.pack_file(3, [5], [n], tokens, codec.BLOCK)) < n / 8


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=60), st.integers(1, 9))
def test_any_ids_and_block_length(ids, block):
    tokens = np.array(ids, dtype="<u4")
    assert codec.unpack_file(codec.pack_file(0, [1], [len(ids)], tokens, block))[3].tolist() == ids


def test_a_block_reads_the_same_alone():
    rng = np.random.default_rng(0)
    blocks = [(rng.zipf(1.5, n) % 5000).astype(np.int64) for n in (900, 900, 300, 7)]
    together = codec.encode_blocks(blocks, 4)
    for b, payload in zip(blocks, together, strict=True):
        assert codec.encode_blocks([b], 4) == [payload]
        assert codec.decode_blocks([payload], [len(b)], 4)[0].tolist() == b.tolist()


def test_learns():
    rng = np.random.default_rng(1)
    phrase = rng.integers(0, 49_000, 200)
    tokens = np.concatenate([phrase for _ in range(20)])
    assert len(codec.encode_blocks([tokens], 4)[0]) < 0.25 * 2 * len(tokens)


def test_blocks_start_from_what_the_file_has_learnt():
    phrase = np.random.default_rng(2).integers(0, 49_000, codec.BLOCK)
    tokens = np.tile(phrase, 8).astype("<u4")  # nothing comes twice in a block
    raw = codec.pack_file(0, [1], [len(tokens)], tokens, codec.BLOCK)
    assert len(raw) < len(tokens) and codec.unpack_file(raw)[3].tobytes() == tokens.tobytes()


def test_a_missed_id_is_one_step_of_the_coder(monkeypatch):
    steps = []
    put = codec._Encoder.put
    monkeypatch.setattr(codec._Encoder, "put", lambda self, *rest: (steps.append(1), put(self, *rest))[1])
    tokens = np.random.default_rng(3).permutation(np.arange(2000) % 100 * 400).astype("<u4")
    raw = codec.pack_file(0, [1], [len(tokens)], tokens, 500)
    assert len(steps) <= 500 and codec.unpack_file(raw)[3].tobytes() == tokens.tobytes()


@pytest.mark.parametrize("top", [0, 1, 255, 65_535, 65_536, codec.DENSE if hasattr(codec, "DENSE") else 1 << 20, 2**32 - 1])
def test_ids_around_each_width(top):
    tokens = np.array([top, 0, top, top, 0, top // 2, top // 2, top] * 40, dtype="<u4")
    assert codec.unpack_file(codec.pack_file(0, [1], [len(tokens)], tokens, 50))[3].tobytes() == tokens.tobytes()


@pytest.mark.parametrize("back", [*range(1, 60), 400, 900])
def test_damage_anywhere_after_the_documents_is_found(back):
    rng = np.random.default_rng(back)
    tokens = (rng.zipf(1.3, 3000) % 40_000).astype("<u4")
    raw = bytearray(codec.pack_file(0, [1], [len(tokens)], tokens))
    raw[-back] ^= 1 << int(rng.integers(8))
    try:
        assert codec.unpack_file(bytes(raw))[3].tobytes() == tokens.tobytes()  # a last bit may not matter
    except ValueError as error:
        assert "damaged" in str(error)


def test_damage_is_found():
    raw = bytearray(codec.pack_file(0, [1], [5000], np.arange(5000, dtype="<u4")))
    raw[-700] ^= 0x40
    with pytest.raises(ValueError, match="damaged"):
        codec.unpack_file(bytes(raw))


def expected(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(K.TOKENIZER))
    return [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes() for t in texts]


@pytest.mark.parametrize("name", ["documents", "odd_documents"])
def test_table_round_trip(spark, request, monkeypatch, tmp_path, name):
    monkeypatch.setattr(K, "FILE_IDS", 3000)
    df = request.getfixturevalue(name)
    folder = f"file://{tmp_path}/files"
    sizes = spark.createDataFrame(K.write_token_files(df, folder).select("file", "ids").toArrow())
    files = [p.name for p in (tmp_path / "files").iterdir()]
    assert sorted(files) == sorted(r.file for r in sizes.collect()) and len(files) > 1
    rows = df.collect()
    back = K.read_token_files(spark, folder).collect()
    want = sorted(((r.doc_id, x) for r, x in zip(rows, expected([r.text for r in rows]), strict=True)), key=str)
    assert sorted(((r.doc_id, bytes(r.ids)) for r in back), key=str) == want
    got = K.document_digests(spark, folder, sizes).collect()
    order = sorted(got, key=lambda r: r.start)
    at = 0
    for r in order:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert sorted(r.ids_crc32 for r in got) == sorted(zlib.crc32(x) for _, x in want)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = K.op7_token_files(spark, str(tmp_path))
    assert out.collect() == [] and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
