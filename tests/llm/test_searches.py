"""Both searches against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.llm import bitslice as B
from daybook.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, rank string, score string, row string, lists string"


def vectors(seed=1, n=700, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:300:7] *= 2.5  # longer rows win more products
    x[100:130] = x[100]  # ties
    rows = [(int(i), [float(v) for v in x[i]]) for i in rng.permutation(n)]
    bad = [float("nan")] + [0.1] * (dim - 1)
    odd = [(n, None), (n + 1, bad), (n + 2, [None] + [0.1] * (dim - 1)), (n + 20, [float("inf")] * dim), (None, [0.5] * dim), (n + 40, []), (n + 60, [0.0] * dim)]
    short = [(5000 + 20 * k, [float(k), 1.0, -0.5]) for k in range(4)]
    twice = [(40, [float(v) for v in x[3]]), (43, [float(v) for v in x[43]])]
    return rows + odd + short + twice


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *["x"] * 4) for i, v in rows], SCHEMA).repartition(3)


def usable(rows, zero):
    out = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, v) for i, v in out if zero or any(v)]


def brute(rows, k, product, zero=True):
    rows, out = usable(rows, zero), []
    for a, (i, q) in enumerate(rows):
        if i % 20:
            continue
        others = [(-product(q, v), j) for b, (j, v) in enumerate(rows) if b != a and len(v) == len(q)]
        out.append([(i, r, j, -s) for r, (s, j) in enumerate(sorted(others)[:k], 1)])
    return out


def whole(q, v):
    return sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(q, v, strict=True))


@pytest.mark.parametrize("sizes", [(16_384, 1_024), (64, 5), (1, 1000)])
def test_bitsliced_equals_brute_force(spark, monkeypatch, sizes):
    rows = vectors(n=200 if sizes[0] == 1 else 700)
    if sizes[0] == 1:
        rows = rows[:60]
    monkeypatch.setattr(B, "ROWS", sizes[0])
    monkeypatch.setattr(B, "QUERIES", sizes[1])
    got = sorted(map(tuple, B.top_products(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()))
    assert got == sorted(r for x in brute(rows, 20, whole) for r in x)


def test_block_sums_and_ties():
    rng = np.random.default_rng(4)
    for low, high in ((-3, 3), (-100, 70), (-(2**27), 2**27), (0, 1), (-5, 0)):
        x = rng.integers(low, high, (131, 9))
        x[50:90] = x[50]
        block = B.BitSlicedBlock(x)
        for q in (x[50], x[0] * 0, -x[3], x[9]):
            s = x @ q
            rows, score = block.top(q, 10, 50)
            order = [i for i in np.lexsort((np.arange(131), -s)) if i != 50][:10]
            assert sorted(rows.tolist()) == sorted(order) and dict(zip(rows.tolist(), score.tolist(), strict=True)) == {i: int(s[i]) for i in order}


def test_few_rows_are_all_returned(spark):
    rows = [(20, [1.0, 2.0]), (21, [0.5, 0.5]), (22, [-1.0, 0.0])]
    for search in (B.top_products, N.nearest):
        got = search(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()
        assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(20, 1, 21), (20, 2, 22)]
        assert search(frame(spark, []), F.col("vec_id") % 20 == 0).collect() == []
        assert search(frame(spark, rows), F.lit(False)).collect() == []


@pytest.mark.parametrize("tile", [8_192, 50])
def test_neighbours_recall_and_scores(spark, monkeypatch, tile):
    monkeypatch.setattr(N, "TILE_ROWS", tile)
    rows = vectors(seed=2)
    product = lambda q, v: float((np.array(q) * np.array(v)).sum())
    want = brute(rows, 20, product, zero=False)
    got = {}
    for r in N.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == sorted({x[0][0] for x in want if x})
    hits = total = 0
    vector = {}
    for i, v in usable(rows, False):
        vector.setdefault(i, []).append(v)
    for x in want:
        found = sorted(got[x[0][0]])
        if len(vector[x[0][0]]) > 1:
            continue  # two queries of one id
        assert [f[0] for f in found] == list(range(1, len(x) + 1))
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        for _, j, s in found:
            assert any(s == pytest.approx(product(vector[x[0][0]][0], v), rel=1e-12) for v in vector[j])
        hits += len({f[1] for f in found} & {r[2] for r in x})
        total += len(x)
    assert hits / total >= 0.9


def test_scan_abandons_but_keeps_the_best():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 64))
    query = rng.standard_normal(64)
    near, others = np.arange(200), np.arange(200, 2000)
    left = N.scan(x, query, near, others, 20, N.EPSILON)
    assert len(left) < 600
    best = np.argsort(((x - query) ** 2).sum(1))[:20]
    assert len(set(best.tolist()) & set(left.tolist())) >= 19


def test_rotation_keeps_products():
    turn = N.rotation(33)
    assert np.allclose(turn @ turn.T, np.eye(33))
