"""Clusters against a plain k-means on whole numbers."""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pytest

from daybook.llm import zone_clusters as Z

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string, key string, scatter string"


def plain(rows, k, rounds, dim, scale=64):
    kept = []
    for i, v in rows:
        if i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x * scale) for x in v):
            kept.append((i, [math.floor(x * scale) for x in v]))
    centroids = [v for i, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda v: min((square(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [place(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = []
    for i, v in kept:
        d, n = place(v)
        out.append((i, n, d if d < 2**63 else None))
    return sorted(out, key=str), centroids


def rows_of(seed, n=400, dim=64, groups=5, spread=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((groups, dim))
    x = middle[rng.integers(0, groups, n)] * 0.2 + rng.standard_normal((n, dim)) * spread
    x[50:120] = x[50]  # one vector many times
    rows = [(int(i) - 20, [float(c) for c in x[i]]) for i in range(n)]
    odd = [[0.1] * (dim - 1), [0.1] * (dim + 1), [], None, [None] + [0.1] * (dim - 1), [math.nan] * dim, [math.inf] + [0.0] * (dim - 1)]
    return rows + [(n + i, v) for i, v in enumerate(odd)] + [(None, rows[0][1]), rows[3], (7, rows[9][1])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *["x"] * 4) for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("seed", "block_rows", "k"), [(1, 16, 16), (2, 1000, 3), (3, 1, 5)])
def test_equals_plain_k_means(spark, seed, block_rows, k):
    rows = rows_of(seed, n=400 if block_rows > 1 else 60)
    want, centroids = plain(rows, k, 3, 64)
    got, at = Z.cluster(frame(spark, rows), clusters=k, block_rows=block_rows)
    assert at == centroids
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_huge_components_stay_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in rng.standard_normal(4) * 10.0 ** rng.choice([0, 6, 9, 15, 40, 150, 300])]) for i in range(80)]
    rows += [(100, [1.7e308, 0.0, 0.0, 0.0])]  # not finite after scaling
    want, centroids = plain(rows, 6, 2, 4)
    got, at = Z.cluster(frame(spark, rows), clusters=6, rounds=2, dim=4, block_rows=8)
    assert at == centroids and sorted(map(tuple, got.collect()), key=str) == want
    assert any(d is None for _, _, d in want)


def test_few_and_no_rows(spark):
    rows = rows_of(4)[:3]
    got, at = Z.cluster(frame(spark, rows))
    assert len(at) == 3 and [r.distance for r in got.collect()] == [0, 0, 0]
    got, at = Z.cluster(frame(spark, []))
    assert at == [] and got.collect() == [] and got.columns == ["vec_id", "cluster", "distance"]


@pytest.mark.parametrize(("axes", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_the_curve_goes_from_neighbour_to_neighbour(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    keys = [k.tobytes() for k in Z.hilbert_key(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[np.argsort(np.array(keys, dtype=object))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_candidates_hold_every_nearest_centroid():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((8, 8)))
    centroids = rng.integers(-100, 100, (30, 8)).astype(float)
    left = 0
    for _ in range(200):
        x = np.floor(centroids[rng.integers(30)] + rng.standard_normal((20, 8)) * rng.choice([1, 10, 80]))
        turned = x @ q
        chosen = Z.candidates(x.min(0), x.max(0), turned.min(0), turned.max(0), centroids, centroids @ q)
        best = ((x[:, None] - centroids[None]) ** 2).sum(2).argmin(1)
        assert set(best.tolist()) <= set(chosen.tolist())
        left += len(chosen)
    assert left < 200 * 30 * 0.6


def test_blocks_prune_clustered_vectors(spark):
    rng = np.random.default_rng(6)
    middle = rng.standard_normal((8, 64)) * 3
    x = np.floor((middle[rng.integers(0, 8, 4000)] + rng.standard_normal((4000, 64)) * 0.1) * 64)
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, vec array<double>").repartition(4)
    blocks = Z.ZoneBlocks(rows, 64)
    centroids = [[int(c) for c in v * 64] for v in middle]
    count, total, pairs = blocks.sums(centroids)
    assert sum(count) == 4000 and np.array_equal(np.array(total).sum(0), x.sum(0).astype(int))
    assert pairs < 0.25 * 4000 * 8
