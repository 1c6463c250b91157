"""Round robin schedules, and packed pieces against whole encodings."""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from string import punctuation

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from daybook.llm import tokens
from daybook.llm.common import map_batches
from daybook.llm.packing import Schedule, pack
from daybook.llm.tokens import WordIds

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def laid_out(schedule, totals):
    windows = defaultdict(list)
    for q, n in enumerate(totals):
        for _, size, window, offset in schedule.pieces(q, 0, n):
            windows[window].append((offset, size, q))
    return {w: sorted(x) for w, x in windows.items()}


@pytest.mark.parametrize("totals, weights", [
    ([5, 0, 3_000_000, 100, 3], None), ([50_000] * 20, None), ([1000, 500_000, 200_000], [1, 1, 1]), ([3], None), ([2048 * 40], None),
    ([123_456, 7, 1, 1, 1, 99_999], [0.2, 0.5, 0.1, 0.1, 0.05, 0.05]), ([400_000, 300_000], [3, 1]), ([1] * 300 + [200_000], None),
])
def test_every_token_has_one_place(totals, weights):
    schedule = Schedule(totals, weights)
    windows = laid_out(schedule, totals)
    assert sorted(windows) == list(range(schedule.sequences))
    for w, pieces in windows.items():
        at = 0
        for offset, size, _ in pieces:
            assert offset == at
            at += size
        assert at == 2048 or w == schedule.sequences - 1


def test_windows_hold_the_target_shares():
    totals, weights = [400_000, 300_000, 300_000], [3, 2, 1]
    windows = laid_out(Schedule(totals, weights), totals)
    served = np.zeros(3)
    for w in range(100):
        for _, size, q in windows[w]:
            served[q] += size
        # Deficits are carried: what a queue got so far is what it earned, but for a token or two.
        assert np.abs(served - (w + 1) * 2048 * np.array(weights) / 6).max() < 2.5


def test_pieces_do_not_depend_on_the_cut():
    totals = [100_000, 70_000]
    schedule = Schedule(totals)
    whole = [p for p in schedule.pieces(0, 0, totals[0])]
    parts = [(a + s, n, w, o) for s in range(0, totals[0], 777) for a, n, w, o in schedule.pieces(0, s, min(777, totals[0] - s))]
    places = lambda pieces: {a + k: (w, o + k) for a, n, w, o in pieces for k in range(n)}
    assert places(whole) == places(parts)


@pytest.mark.parametrize("name", NAMES)
def test_word_ids_equal_whole_encodings(name, document_rows):
    odd = ["", " ", "a", "a b\nc", " a  b\t c\n\n", "x\n", "\nx", "<|endoftext|> x<|endoftext|>", "don't it's 'tis", "ö Ü İ ſ é x́ ́ y",
           "12345 a1b2 \U0001f600 x", "a ́ b", "ﬁ b", "\x1c b", "\x00 a", "ᄀ ᅡ ᆨ y", "Σ ΑΣ ΟΔΟΣ x", "a b"]
    texts = odd + [a + " " + b for a in odd for b in odd] + [r[1] for r in document_rows if r[1]]
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    words = WordIds(public_tokenizers.path(name))
    for _ in range(2):  # the second time from the store
        got = words.encode(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", NAMES)
def test_a_word_is_encoded_once_for_all_marks_after_it(name):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    words, learnt = WordIds(public_tokenizers.path(name)), []
    learn = words._learn
    words._learn = lambda pieces: (learnt.extend(pieces), learn(pieces))
    ends = ["", ",", "!?", "'", "...", "%%%$", "'s", "'s.", ".5", "\u0301", "\u0301.", "\u0338", "=\u0338", "\u2019,", "_", "\"\u00bb"]
    heads = ["quequer", "don't", "\u00e9t\u00e9", "a1", "7", "x\u0250", "\u03a3", "\u00aa", "\u0130", "\ufb01", "e\u0301", "\u01c5", ".", "", "A.b"]
    texts = [a + h + e + b for h in heads for e in ends for a in ("", "x ", "x\n") for b in ("", " y")]
    texts = [t for t in texts if t] + [f"x {chr(c)}{mark} y" for c in range(33, 0x260) for mark in punctuation]
    for _ in range(2):
        got = words.encode(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [p for p in learnt if p.startswith("quequer") and p.rstrip(",!?.%$_'") == "quequer"] == ["quequer"]


@pytest.mark.parametrize("name", NAMES)
def test_any_white_space(name):
    """All texts of up to six of these characters; white space that only seems to balance."""
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    words = WordIds(public_tokenizers.path(name))
    texts = ["a\tb ", "a\tb \nc", "a\xa0b ", "x\ty\tz \n", "x <|endoftext|> y", "a <|startoftext|>b\nc"]
    texts += ["".join(c) for n in range(1, 7) for c in itertools.product("a \t\n\xa0\x85", repeat=n)]
    want = [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(g, "<u4").tolist() for g in words.encode(texts)] == want


@pytest.mark.parametrize("name", NAMES)
def test_a_piece_is_looked_up_once_for_all_its_places(name):
    class Counted(dict):
        asked = 0

        def get(self, key):
            Counted.asked += 1
            return super().get(key)

    whole, words = Tokenizer.from_file(public_tokenizers.path(name)), WordIds(public_tokenizers.path(name))
    words.store = Counted(words.store)
    texts = ["\u00e9t\u00e9 some words, some words", "", "words, some\nwords!", "a\u03a3 \u03a3a \u03a3"] * 200
    got = words.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    assert Counted.asked <= 12  # distinct pieces, of 2200


def test_groups_of_texts_do_not_show(monkeypatch, document_rows):
    texts = [r[1] for r in document_rows if r[1]]
    want = WordIds(public_tokenizers.path(NAMES[0])).encode(texts)
    monkeypatch.setattr(tokens, "_GROUP", 300)
    assert WordIds(public_tokenizers.path(NAMES[0])).encode(texts) == want


def test_a_full_store_changes_nothing(monkeypatch, document_rows):
    monkeypatch.setattr(tokens, "KEPT", 40)
    words, texts = WordIds(public_tokenizers.path(NAMES[0])), [r[1] for r in document_rows if r[1]]
    whole = Tokenizer.from_file(public_tokenizers.path(NAMES[0]))
    for k in range(0, len(texts), 5):
        got = words.encode(texts[k : k + 5])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts[k : k + 5]]


def ids_of(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(NAMES[0]))
    return [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for t in texts]


@pytest.mark.parametrize("name", ["documents", "odd_documents"])
@pytest.mark.parametrize("weights", [None, {"s0": 5.0, "s1": 1.0, None: 2.0}])
def test_packed_rows(request, name, weights):
    df = request.getfixturevalue(name)
    want = sorted(x.tobytes() for x in ids_of([r.text for r in df.collect()]))
    pieces = pack(df, weights=weights).collect()
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append(p)
        assert len(p.ids) == 4 * p.length and zlib.crc32(p.ids) == p.ids_crc32
    assert sorted(windows) == list(range(len(windows)))
    for w, some in windows.items():
        at = 0
        for p in sorted(some, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 2048 or (w == len(windows) - 1 and at <= 2048)
    docs = defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
    joined = []
    for some in docs.values():
        if len({(p.start, p.doc_tokens) for p in some}) == len(some) and sum(p.length for p in some) == some[0].doc_tokens:
            joined.append(b"".join(p.ids for p in sorted(some, key=lambda p: p.start)))
    if name == "documents":
        assert sorted(joined) == want
    assert sum(p.length for p in pieces) == sum(len(x) // 4 for x in want)


def test_empty_table(no_documents):
    assert pack(no_documents).collect() == []


def test_steps_that_do_not_tokenise_find_no_words_kept(spark):
    rows = spark.range(40).selectExpr("id AS doc_id", "concat('some words ', id) AS text", "'s' AS source").repartition(4)
    assert pack(rows).count() == 40

    def kept(batches):
        import pyarrow as pa

        from daybook.llm import tokens

        for b in batches:
            yield pa.RecordBatch.from_pydict({"kept": [len(tokens._LOADED)]})

    assert {r.kept for r in map_batches(rows.select("doc_id"), kept, "kept bigint").collect()} == {0}
