"""The join against all pairs."""

from __future__ import annotations

import re

import numpy as np
import pytest

from daybook.llm import jaccard as J


def grams(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, limit=0.8):
    """(id, class, copy, links) by comparing every two rows."""
    sets = [grams(t) for _, t in rows]
    n = len(rows)
    alike = [[i != j and bool(sets[i]) and len(sets[i] & sets[j]) >= limit * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *[label[j] for j in range(n) if alike[i][j]]]) for i in range(n)]
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    out = []
    for i in range(n):
        group = [rows[j][0] for j in range(n) if label[j] == label[i]]
        copies = [rows[j][0] for j in range(n) if j == i or sets[i] and sets[i] == sets[j]]
        out.append((rows[i][0], least(group), least(copies), sum(alike[i])))
    return sorted(out, key=str)


def test_bands_reach_the_recall():
    for recall in (0.9, 0.999, 0.99999):
        bands, rows = J.choose_bands(0.8, recall)
        assert 1 - (1 - 0.8**rows) ** bands >= recall
        assert 1 - (1 - 0.4**rows) ** bands <= 0.5


def test_ngram_sets():
    texts = ["a b c d e f a b c d e", "a b", "", "x  y\tz\nu\rv", "a b c d e"]
    hashes, bounds = J.ngram_sets([t.encode() for t in texts], 5)
    sets = [set(hashes[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert [len(s) for s in sets] == [len(grams(t)) for t in texts]
    assert sets[4] < sets[0] and not sets[1] & sets[0]
    assert all((np.diff(hashes[a:b].astype(object)) > 0).all() for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a + 1)


@pytest.mark.parametrize("name", ["documents", "odd_documents"])
@pytest.mark.parametrize("block", [256, 2])
def test_equals_all_pairs(request, monkeypatch, name, block):
    monkeypatch.setattr(J, "BLOCK", block)  # 2: components of many tiles
    df = request.getfixturevalue(name)
    got = J.ngram_jaccard(df).collect()
    assert sorted(((r.id, r.class_id, r.copy_id, r.n_links) for r in got), key=str) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_a_crowd_of_near_copies(spark):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(150):
        own = list(words)
        own[(7 * k) % 400] = f"own{k}"
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, " ".join(f"x{k}y{i}" for i in range(50))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.id: (r.class_id, r.n_links) for r in J.ngram_jaccard(df).collect()}
    assert all(got[k] == (0, 149) for k in range(150))
    assert all(got[1000 + k] == (1000 + k, 0) for k in range(20))


def test_shared_counts_by_either_way():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, 200).astype(np.uint64)) for _ in range(12)]
    left, right = np.triu_indices(12, 1)
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(left, right, strict=True)]
    assert J._shared(sets, left, right).tolist() == want
    assert J._shared(sets, left[:9], right[:9]).tolist() == want[:9]


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)]
    got = dict(J.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_first_of_class_keeps_rows_whole(documents, odd_documents, no_documents):
    kept = J.first_of_class(documents)
    want = brute([(r.doc_id, r.text) for r in documents.collect()])
    assert kept.schema == documents.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _, _ in want})
    assert J.first_of_class(odd_documents).count() == 5  # the row with one more word is a near copy
    assert J.first_of_class(no_documents).collect() == []
