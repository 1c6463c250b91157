"""Clean and junk texts."""

from __future__ import annotations

import random

PARTS = ["ther", "and", "ing", "on", "es", "ra", "to", "mel", "ki", "sto"]


def clean(rng: random.Random) -> str:
    return " ".join("".join(rng.choices(PARTS, k=rng.randint(1, 3))) + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randint(30, 200)))


def junk(rng: random.Random) -> str:
    word = "".join(rng.choices(PARTS, k=2))
    kind = rng.randint(0, 2)
    if kind == 0:
        return " ".join([word] * rng.randint(20, 100))
    if kind == 1:
        return " | ".join(clean(rng).split()[:60])
    return " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in clean(rng).split())
