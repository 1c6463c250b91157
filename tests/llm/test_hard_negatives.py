"""Hard negatives against a comparison of all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, row string, key string, tile string, score string, found string, length string"


def brute(rows, step, positives=5, negatives=5, low=80, high=100, scale=256):
    kept = []
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and math.isfinite(x * scale) for x in v):
            kept.append((i, [math.floor(x * scale) for x in v], label))
    fits = lambda s: s if -(2**63) <= s < 2**63 else None
    out = []
    for a, (i, q, label) in enumerate(kept):
        if i % step:
            continue
        score = [(-sum(x * y for x, y in zip(q, v, strict=True)), j, b, other) for b, (j, v, other) in enumerate(kept) if b != a and len(v) == len(q)]
        for p, j, _, _ in sorted(s for s in score if s[3] == label)[:positives]:
            band = sorted(s for s in score if s[3] != label and low * -p <= 100 * -s[0] <= high * -p)
            out += [(i, j, r, s[1], fits(-p), fits(-s[0])) for r, s in enumerate(band[:negatives], 1)]
    return sorted(out, key=str)


def rows_of(seed, n=300, dim=12):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((6, dim))
    x = (middle[rng.integers(0, 6, n)] + rng.standard_normal((n, dim)) * 0.4) * rng.choice([0.2, 1.0, 3.0], (n, 1))
    x[40:80] = x[40]  # ties, within and across labels
    x[100:104] = 0.0
    rows = [(int(i), [float(c) for c in x[i]], int(rng.integers(0, 4))) for i in range(n)]
    odd = [(n + 10, None, 1), (n + 20, [], 1), (n + 30, [math.nan] * dim, 1), (n + 40, [None] + [1.0] * (dim - 1), 1), (n + 50, rows[0][1], None), (None, rows[0][1], 1)]
    short = [(1000 + 10 * k, [float(k), 1.0], k % 2) for k in range(8)]
    return rows + odd + short + [(20, rows[3][1], 2)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, *["x"] * 6) for i, v, label in rows], SCHEMA).repartition(3)


def result(df, **options):
    return sorted(map(tuple, H.hard_negatives(df, F.col("vec_id") % 10 == 0, **options).collect()), key=str)


@pytest.mark.parametrize(("seed", "bucket", "anchors"), [(1, 2_048, 1_024), (2, 7, 5)])
def test_equals_all_pairs(spark, monkeypatch, seed, bucket, anchors):
    monkeypatch.setattr(H, "ANCHORS", anchors)
    monkeypatch.setattr(H, "BUCKETS_A_TILE", 3)
    rows = rows_of(seed)
    want = brute(rows, 10)
    assert len(want) > 300 and {r[2] for r in want} == {1, 2, 3, 4, 5}
    assert result(frame(spark, rows), bucket_rows=bucket) == want


def test_huge_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in np.abs(rng.standard_normal(3)) * 10.0 ** rng.choice([0, 5, 9, 200])], i % 3) for i in range(60)]
    want = brute(rows, 10, low=1)
    assert any(r[4] is None for r in want) and any(r[4] is not None for r in want)
    assert result(frame(spark, rows), low=1, bucket_rows=9) == want


def test_few_rows(spark):
    assert result(frame(spark, [])) == []
    assert result(frame(spark, [(10, [1.0, 0.0], 1)])) == []
    assert result(frame(spark, [(10, [1.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [1.0, 0.5], 2), (13, [0.9, 0.5], 2)])) == brute(
        [(10, [1.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [1.0, 0.5], 2), (13, [0.9, 0.5], 2)], 10
    )


def test_candidates_hold_all_above_the_bound():
    rng = np.random.default_rng(4)
    looked = total = 0
    for dim in (4, 16):
        x = np.floor(rng.standard_normal((500, dim)) * rng.choice([20, 200], (500, 1)))
        b = H.Bucket(np.arange(500), np.arange(500), np.zeros(500, np.int64), x)
        for q in x[:60]:
            exact = x @ q
            length = float(np.linalg.norm(q))
            for share in (0.2, 0.5, 0.9, 1.0):
                bound = int(exact.max() * share)
                if bound <= 0:
                    continue
                found = b.candidates(q / length, length, bound)
                assert set(np.flatnonzero(exact >= bound).tolist()) <= set(found.tolist())
                looked, total = looked + len(found), total + 500
    assert looked < 0.2 * total


def test_score_keys_sort_as_numbers():
    values = [0, 1, -1, 255, 256, -255, -256, 2**63, -(2**63), 10**600, -(10**600), 7]
    assert [H.score_of(k) for k in sorted(map(H.score_key, values))] == sorted(values)
