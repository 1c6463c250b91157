"""The language model: exact counts, distributions that add up, seating against enumeration."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from daybook.llm import pitman_yor as H
from daybook.llm.words import hash_words

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def is_held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def plain(rows):
    counts = Counter(w for i, t in rows if not is_held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        out.append((i, is_held(i), len(own), sum(w in counts for w in own), n, base))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", ["documents", "odd_documents"])
def test_counts_and_base(request, name):
    df = request.getfixturevalue(name)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in H.score_texts(df).collect()), key=str)
    for g, w in zip(got, plain([(r.doc_id, r.text) for r in df.collect()]), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5])


def test_blocks_and_rounds(documents, no_documents, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_BYTES", 2_000)
    want = plain([(r.doc_id, r.text) for r in documents.collect()])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in H.score_texts(documents, rounds=1).collect()), key=str)
    assert [(g[0], g[1], g[2]) for g in got] == [(w[0], w[2], w[3]) for w in want]
    assert all(g[3] == pytest.approx(w[5]) for g, w in zip(got, want, strict=True))
    assert all(math.isfinite(g[4]) and g[4] < 0 for g in got)
    assert H.score_texts(no_documents).collect() == []


def model_of(lines, contexts, rounds=2):
    """The whole model of a small corpus in one shard, without Spark: (words, chance of word in context)."""
    hashes, context = [], []
    for line in lines:
        t, _, first = H._tokens([line.encode()])
        hashes.append(t)
        context.append(contexts.before(t, first)[0])
    names, at = np.unique(np.concatenate(hashes), return_inverse=True)
    parents = contexts.parents
    kinds = len(parents)
    # Every word in every context, so that whole distributions can be added up.
    key = np.arange(len(names) * kinds)
    count = np.bincount(at * kinds + np.concatenate(context), minlength=len(key))
    seat = H.Seating(key // kinds, key % kinds, count, parents, (0.6, 0.7, 0.8))
    base = 1 / (len(names) + 1)
    seat.tables[:] = 0
    totals = np.stack([np.bincount(seat.context, seat.count, kinds), np.bincount(seat.context, seat.count > 0, kinds)], axis=1).astype(float)
    for _ in range(rounds):
        given, after = totals, []
        chance = []
        for _ in seat.samples(given, base, 1):
            after.append(seat.sums(kinds))
            chance.append(seat.chances(after[-1], base))
        totals = np.mean(after, axis=0)
    return names, kinds, np.array(chance), np.array(after), base


def corpus():
    rng = random.Random(2)
    return [" ".join(rng.choice(["a b c", "a b d", "x", "y z", "a", "b c q"]) for _ in range(40)) for _ in range(30)]


def contexts_of(words, pairs=()):
    names = np.sort(hash_words([" ".join(words).encode()], True)[0])
    own = {w: int(np.searchsorted(names, hash_words([w.encode()], True)[0][0])) + 2 for w in words}
    return H.Contexts(names, np.sort(np.array([65536 * own[a] + own[b] for a, b in pairs], dtype=np.int64)))


def test_chances_add_up_to_one_in_every_context():
    contexts = contexts_of(["a", "b", "x"], [("a", "b"), ("b", "a")])
    names, kinds, chance, after, base = model_of(corpus(), contexts)
    for sample, totals in zip(chance, after, strict=True):
        grid = sample.reshape(len(names), kinds)
        unknown = np.zeros(kinds)
        for c in range(kinds):
            above = base if c == 0 else unknown[contexts.parents[c]]
            level = 0 if c == 0 else 1 if contexts.parents[c] == 0 else 2
            customers, tables = totals[c]
            unknown[c] = (1 + (0.6, 0.7, 0.8)[level] * tables) / (1 + customers) * above
        assert np.allclose(grid.sum(0) + unknown, 1)


def test_contexts_tell_words_apart():
    contexts = contexts_of(["a", "b"], [("a", "b")])
    names, kinds, chance, _, _ = model_of(corpus(), contexts)
    at = {w: int(np.searchsorted(names, hash_words([w.encode()], True)[0][0])) for w in "abcdxyz"}
    grid = chance.mean(0).reshape(len(names), kinds)
    a, b, ab = contexts.singles(np.array([hash_words([w.encode()], True)[0][0] for w in "ab"])).tolist() + [kinds - 1]
    assert grid[at["b"], a] > 3 * grid[at["b"], 0]
    assert grid[at["c"], b] > 2 * grid[at["c"], 0]
    assert grid[at["x"], ab] < grid[at["x"], 0] < 1


def test_gibbs_steps_have_the_right_number_of_tables():
    """Tables of one dish under the exact law: customers seated in turn, all arrangements summed by recursion."""
    d, opening, n = 0.5, 1.3, 9
    # weight[t]: sum over arrangements of n customers at t tables of opening**t times the sizes' weights.
    weight = {1: opening}
    for k in range(1, n):
        step = Counter()
        for t, w in weight.items():
            step[t] += w * (k - d * t)
            step[t + 1] += w * opening
        weight = step
    total = sum(weight.values())
    mean = sum(t * w for t, w in weight.items()) / total
    seat = H.Seating(*(np.zeros(1, dtype=np.int64),) * 3, np.zeros(2, dtype=np.int64), (d, d, d))
    rng = np.random.default_rng(0)
    customers = np.full(20_000, n)
    tables = seat._full(0, customers, np.full(20_000, opening))
    for _ in range(60):
        tables = seat._step(0, customers, tables, np.full(20_000, opening), rng)
    assert tables.mean() == pytest.approx(mean, rel=0.06)
    assert tables.min() >= 1 and tables.max() <= n


def test_better_than_the_base_on_held_out_texts(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["the cat sat", "the dog ran", "on the mat", f"word{rng.randint(0, 400)}"]) for _ in range(60))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = [r for r in H.score_texts(df, share=0.01).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.8


def test_contexts_are_frequent_words_and_pairs(spark):
    rows = [(i, "of the x" + str(i)) for i in range(300)]
    found = H.find_contexts(spark.createDataFrame(rows, "id long, text string").repartition(3), 0.05)
    of, the = (hash_words([w], True)[0][0] for w in (b"of", b"the"))
    assert set(found.words.tolist()) == {of, the}
    assert len(found.pairs) == 1 and found.pairs[0] == 65536 * found.singles(np.array([of]))[0] + found.singles(np.array([the]))[0]


@pytest.mark.parametrize("opening", [0.1, 10.0])
def test_tables_of_thousands_of_customers_follow_the_exact_law(opening):
    d, n = 0.8, 3000
    weight = np.full(n + 2, -np.inf)  # logarithms of the weights, by number of tables
    weight[1] = math.log(opening)
    t = np.arange(n + 2)
    for k in range(1, n):
        stay = weight + np.log(np.maximum(k - d * t, 1e-300))
        weight = np.logaddexp(np.where(t <= k, stay, -np.inf), np.append(-np.inf, weight[:-1]) + math.log(opening))
    law = np.exp(weight - weight.max())
    mean = (t * law).sum() / law.sum()
    seat = H.Seating(*(np.zeros(1, dtype=np.int64),) * 3, np.zeros(2, dtype=np.int64), (d, d, d))
    tables = seat._step(0, np.full(4000, n), np.full(4000, n // 2), np.full(4000, opening), np.random.default_rng(0))
    assert tables.mean() == pytest.approx(mean, rel=0.1)
    assert seat._full(0, np.array([1_000_000]), np.array([0.1]))[0] <= 3


@pytest.mark.parametrize("d", [0.3, 0.6, 0.8, 0.95])
@pytest.mark.parametrize("n", [2, 5, 17, 100, 200])
@pytest.mark.parametrize("opening", [0.01, 1.0, 30.0])
def test_tables_of_few_customers_have_the_exact_law(d, n, opening):
    """Total variation between 400,000 draws and the law of seats taken one by one."""
    law = [0.0, 1.0]  # weight of so many tables
    for k in range(1, n):
        law = [(law[t] * (k - d * t) if t < len(law) else 0) + (law[t - 1] * opening if t else 0) for t in range(k + 2)]
        law = [x / max(law) for x in law]
    seat = H.Seating(*(np.zeros(1, dtype=np.int64),) * 3, np.zeros(2, dtype=np.int64), (d, d, d))
    draws = 400_000
    tables = seat._step(0, np.full(draws, n), np.full(draws, 1), np.full(draws, opening), np.random.default_rng(5))
    found = np.bincount(tables, minlength=n + 1) / draws
    assert np.abs(found - np.array(law) / sum(law)).sum() / 2 < 0.01


def test_rare_words_and_pairs_are_contexts(spark):
    """Each of 12,000 words is 1 / 36,000 of the tokens and tells the next one for certain."""
    rows = [(i, " ".join(f"a{j} b{j}" for j in range(i * 40, i * 40 + 40))) for i in range(300)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = H.score_texts(df).filter("not held_out").collect()
    chance = 10 ** (sum(r.score for r in out) / sum(r.n_tokens for r in out))
    plain = 10 ** (sum(r.base_score for r in out) / sum(r.n_tokens for r in out))
    assert chance > 50 * plain


def test_a_hot_word_is_dealt_to_many_shards():
    text = b" ".join(b"hot w%d" % i for i in range(3000))
    rows = [r for r in H._send([0], [text], None, 8, 0) if r["shard"] >= 0]
    hot = hash_words([b"hot"], True)[0][0]
    held = [int((np.frombuffer(r["words"], dtype="<u8") == hot).sum()) for r in rows]
    assert len(held) == 8 and max(held) < 2 * sum(held) / 8
    assert all("docs" not in r for r in rows)


def test_numbers_come_back_as_they_were_packed():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    given = [np.sort(hashes), hashes, rng.integers(-5, 9, 77), np.zeros(0, dtype=np.int64), np.zeros(5, dtype=np.int64), np.array([2**64 - 1, 3], dtype=np.uint64), np.array([-5, -3, 4])]
    for x, y in zip(given, H.unpack(H.pack(*given)), strict=True):
        assert y.view(x.dtype).tolist() == x.tolist()
    assert len(H.pack(np.sort(hashes))) < 7.5 * len(hashes)
    assert [x.tolist() for x in H.unpack(H.pack(*given), 4, 6)] == [[0] * 5, given[6].view(np.uint64).tolist()]


def test_little_is_written_and_turns_score_alike(spark, monkeypatch):
    """What lies in the shared folder at the end, of all rounds, is about as much as the texts (it was 4.6 times that)."""
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.6)) % 60_000}" for _ in range(400_000)]
    rows = [(i, " ".join(words[i * 500 : i * 500 + 500])) for i in range(800)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), "doc_id long, text string")
    assert H._turns(df)[1] > 1
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    found = {}
    for name, turns in (("some", H.TURNS), ("one", 1)):
        monkeypatch.setattr(H, "TURNS", turns)
        before = {*folder.rglob("*.parquet")}
        found[name] = {r.doc_id: r for r in H.score_texts(df).collect()}
        assert sum(x.stat().st_size for x in {*folder.rglob("*.parquet")} - before) < 2 * sum(len(t) for _, t in rows)
    for i, r in found["one"].items():
        other = found["some"][i]
        assert other[:5] == r[:5] and other[5:] == pytest.approx(r[5:])


def test_texts_that_were_shuffled_are_read_alike_in_each_turn(spark):
    rows = [(i, f"a b{i % 7} c") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    chosen, _ = H._turns(df)
    assert chosen.inputFiles() and sorted(r[0] for r in chosen.collect()) == list(range(400))
