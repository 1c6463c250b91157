"""64-bit hashes of the words of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 2_000_000
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 2**64)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers: every bit of the input changes about half of the output's."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The values in order, each once. ``np.unique`` would put them into a hash table first, many times slower."""
    x = np.sort(x)
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(max(n, CHUNK_BYTES + 1024), base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Sums of byte values times powers: entry i covers the first i bytes."""
    up, _ = powers(len(raw))
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up, out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges; equal ranges have equal hashes wherever they lie."""
    _, down = powers(len(sums))
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together; a longer text is a range of its own."""
    lo = size = 0
    for k, t in enumerate(texts):
        if k > lo and size + len(t) > limit:
            yield lo, k
            lo, size = k, 0
        size += len(t) + 1
    if len(texts) > lo:
        yield lo, len(texts)


def hash_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the words of text i are hashes[bounds[i]:bounds[i + 1]], in order.

    Words are runs outside of ASCII white space; ``lower`` folds A-Z.
    """
    raw = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    if lower:
        raw = _LOWER[raw]
    gap = _IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    hashes = spans(prefix_sums(raw), starts, ends)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return hashes, np.searchsorted(starts, begin)
