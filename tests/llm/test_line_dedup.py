"""Shared lines against a plain count over all documents."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from daybook.llm import line_dedup as L

SCHEMA = "doc_id long, text string, doc string, drops string, n_lines string, h1 string, own string, mark string"
BLANKS = " \t\n\x0b\f\r"
FOLD = str.maketrans(L.UPPER, L.LOWER)


def texts(rng: random.Random, n: int) -> list[str | None]:
    shared = [f"{w} line of a footer that many pages have in common, number {i}" for i, w in enumerate(("The", "ÉCOLE", "Straße", "a", "x\tY"))]
    shared += ["short line", "k" * 40, "K" * 39, "é" * 40, "İ" * 41, " " + "n" * 45]
    out: list[str | None] = [None, "", "\n", "\n\n \n"]
    for _ in range(n):
        lines = []
        for _ in range(rng.randrange(1, 9)):
            line = rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice("abcd ") for _ in range(rng.choice((5, 41, 60))))
            line = rng.choice(("", " ", "\t", "\r", "\x0b")) + rng.choice((line, line.upper(), line)) + rng.choice(("", "\r", "  ", "\f"))
            lines.append(line)
        out.append("\n".join(lines))
    return out


def brute(rows, min_docs=5, min_length=40):
    key = lambda x: x.strip(BLANKS).translate(FOLD)
    holders, owner = defaultdict(int), {}
    least = -(2**63)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            holders[k] += 1
            owner[k] = max(owner.get(k, least), least if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = lambda x: len(key(x)) >= min_length and holders[key(x)] >= min_docs and owner[key(x)] != (least if i is None else i)  # noqa: E731, B023
        kept = [x for x in lines if not gone(x)]
        out.append((i, "\n".join(kept) if len(kept) < len(lines) else t, len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * 6) for i, t in rows], SCHEMA).repartition(3)


def result(df, **options):
    rows = L.without_shared_lines(df, **options).select("doc.*", F.col("text").alias("left"), F.struct("n_lines", "n_dropped").alias("told"))
    return sorted(((r.doc_id, r.left, r.told[0], r.told[1]) for r in rows.select("doc_id", "left", "told").collect()), key=str)


@pytest.mark.parametrize("hot", [10_000, 6])
@pytest.mark.parametrize("batches", [1, 5])
def test_equals_brute_force(spark, monkeypatch, batches, hot):
    monkeypatch.setattr(L, "HOT_LINES", hot)  # below, lines go through the shuffled join
    rng = random.Random(batches)
    rows = list(enumerate(texts(rng, 60)))
    rng.shuffle(rows)
    rows += [rows[3], (rows[7][0], rows[8][1]), (None, rows[10][1]), (None, rows[11][1])]
    want = brute(rows)
    assert sum(r[3] for r in want) > 30
    assert result(frame(spark, rows), batches=batches) == want
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_short_lines_and_few_documents(spark):
    rows = [(i, "a b\nshort\nSHORT ") for i in range(3)]
    assert result(frame(spark, rows), min_docs=2, min_length=4) == [(0, "a b", 3, 2), (1, "a b", 3, 2), (2, "a b\nshort\nSHORT ", 3, 0)]
    assert result(frame(spark, rows), min_docs=2, min_length=1)[0] == (0, "", 3, 3)
    assert result(frame(spark, rows)) == [(i, rows[0][1], 3, 0) for i in range(3)]
    assert result(frame(spark, [])) == []


def test_very_long_text(spark):
    lines = [f"line number {i} of a very long text, which is long enough" for i in range(20_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(reversed(lines)) + "\nmore")]
    got = result(frame(spark, rows), min_docs=2)
    assert got[0] == (1, "", 20_000, 20_000) and got[1] == (2, rows[1][1], 20_001, 0)


def test_runs_are_merged_and_known_keys_keep_their_owner(spark):
    runs = L.LineRuns(spark)
    batches = [[(1, 1, 2, 90), (2, 2, 1, 80)], [(1, 1, 3, 70), (3, 3, 1, 60)], [(3, 3, 1, 50)], [(4, 4, 1, 9), (2, 2, 5, 8)], [(1, 1, 1, 1)]]
    for rows in batches:
        runs.add(spark.createDataFrame(rows, "h1 long, h2 long, n long, owner long").groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("owner").alias("owner")))
    assert [bool(r) for r in runs.levels] == [True, False, True]
    join = runs.spark.table(runs.levels[0]).join(runs.spark.table(runs.levels[2]), ["h1", "h2"], "full")
    assert "Exchange" not in join._jdf.queryExecution().simpleString() or "Broadcast" in join._jdf.queryExecution().simpleString()
    assert sorted(map(tuple, runs.close().collect())) == [(1, 1, 6, 90), (2, 2, 6, 80), (3, 3, 2, 60), (4, 4, 1, 9)]
    runs.drop()
