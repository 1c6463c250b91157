"""Removed bytes against a plain scan over all strings."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from daybook.llm import suffixes as X
from daybook.llm.words import distinct, prefix_sums, spans


def brute(rows, length):
    """Rows in order; every string is looked up among all that start earlier."""
    seen, out = set(), []
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(raw[s : s + length])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def found(df, length):
    got = X.remove_repeats(df, length).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got), key=str)


def test_covers_hold_every_difference():
    for v, cover in X.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_samples_meet_in_equal_strings():
    for length in (8, 13, 40, 100):
        v, inside = X.cover_of(length)
        assert all(any(inside[(s + k) % v] and inside[(t + k) % v] for k in range(v)) for s in range(v) for t in range(v))
        assert length - v + 1 >= 2 * length // 5


@pytest.mark.parametrize("length", [5, 13, 40, 100])
def test_equals_a_plain_scan(documents, length):
    rows = sorted((r.doc_id, r.text) for r in documents.collect() if True)
    assert found(documents, length) == sorted(brute(rows, length), key=str)


def test_many_small_blocks(documents, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_ROWS", 2)
    monkeypatch.setattr(X, "BLOCK_BYTES", 500)
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    assert found(documents, 30) == sorted(brute(rows, 30), key=str)


def test_overlaps_periods_and_edges(spark):
    rng = random.Random(1)
    rows = [(1, "abc" * 50), (2, "x" * 99), (3, "x" * 100), (4, "x" * 101), (5, "x" * 500)]
    passage = "".join(rng.choices("abcdefgh ", k=140))
    rows += [(6 + k, "".join(rng.choices("abcdefgh ", k=k)) + passage[k % 7 : 140 - k % 5] + "".join(rng.choices("abcdefgh ", k=9))) for k in range(60)]
    rows += [(100, passage[:99]), (101, passage[:50] + passage[50:]), (102, "Ωß" * 60), (103, "ßΩ" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df, 100) == sorted(brute(rows, 100), key=str)


def test_awkward_rows(odd_documents, no_documents):
    got = found(odd_documents, 100)
    assert len(got) == odd_documents.count()
    copies = sorted((r[1], r[2]) for r in got if r[0] == 1)
    longest = max(n for n, _ in copies)
    assert [(n, g) for n, g in copies if n == longest] == [(longest, 0), (longest, longest)]
    assert found(no_documents, 100) == []


def test_names_by_pieces_are_those_of_the_whole_block(monkeypatch):
    rng = np.random.default_rng(5)
    texts = X.Texts([rng.integers(97, 99, n, dtype=np.uint8).tobytes() for n in (0, 5, 300, 12, 1000)])
    at = np.flatnonzero(rng.random(len(texts.raw) - 12) < 0.7)
    whole = spans(prefix_sums(texts.raw), at, at + 12)
    for size in (1, 7, 64, 5000):
        monkeypatch.setattr(X, "NAMED_BYTES", size)
        assert (texts.names(at, 12) == whole).all()
    known, first, place = np.unique(whole, return_index=True, return_inverse=True)
    assert len(known) < len(whole) and (distinct(whole) == known).all()
    flags = rng.random(len(known)) < 0.2
    assert (X._repeats(whole, flags) == (flags[place] | (first[place] != np.arange(len(at))))).all()
    assert len(X._repeats(whole[:0], flags[:0])) == 0


def test_memory_of_a_block():
    texts = np.random.default_rng(6).integers(0, 256, 6_000_000, dtype=np.uint8).tobytes()
    X.Texts([texts[:9000]]).names(np.arange(10), 100)  # powers are kept by the process
    at = np.arange(len(texts) - 100)
    tracemalloc.start()
    names = X.Texts([texts]).names(at, 100)
    named = tracemalloc.get_traced_memory()[1]
    X._repeats(names, np.zeros(len(names), dtype=bool))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert named < 20 * len(texts) and peak < 30 * len(texts)
