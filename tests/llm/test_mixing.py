"""Systematic sampling against a plain loop over the rows."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import pytest

from daybook.llm.mixing import mix, systematic_copies


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def number(*parts):
    return int(hashlib.md5("|".join(parts).encode()).hexdigest()[:8], 16)


def targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in out]
        share = sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * total / share > most * sizes[s]]
        if not over:
            return out | {s: weight[s] * total / share for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            total -= out[s]


def brute(rows):
    by = defaultdict(list)
    for i, text, source in rows:
        key = "1" if source is None else "0" + source
        ident = "" if i is None else str(i)
        size = words(text)
        by[key].append((math.floor(math.log2(size + 1.0) * 8), number("20240229", ident) % 64, size, ident))
    sizes = {k: sum(x[2] for x in v) for k, v in by.items()}
    goal, out = targets(sizes), []
    for key, docs in by.items():
        rate = min(3.0, goal[key] / sizes[key]) if sizes[key] else 0.0
        start = number("20240229", "offset", key) / 2**32
        for k, (_, _, size, ident) in enumerate(sorted(docs), 1):
            out.append((ident, size, sizes[key], goal[key], math.floor(start + rate * k) - math.floor(start + rate * (k - 1))))
    return sorted(out)


def found(df):
    got = systematic_copies(df).select("doc.doc_id", "size", "source_size", "target", "copies").collect()
    return sorted(("" if r[0] is None else str(r[0]), *r[1:]) for r in got)


@pytest.mark.parametrize("name", ["documents", "odd_documents"])
def test_equals_a_plain_loop(request, name):
    df = request.getfixturevalue(name)
    want = brute([(r.doc_id, r.text, r.source) for r in df.collect()])
    got = found(df)
    assert [(g[:3], g[4]) for g in got] == [(w[:3], w[4]) for w in want]
    assert all(g[3] == pytest.approx(w[3]) for g, w in zip(got, want, strict=True))


def test_reruns_agree_and_limits_hold(documents):
    got = found(documents)
    assert got == found(documents.repartition(5))
    assert all(0 <= g[4] <= 3 for g in got)
    by = defaultdict(lambda: [0, 0.0, 0])
    for _, size, total, goal, copies in got:
        by[total][0] += size * copies
        by[total][1] = goal
        by[total][2] = max(by[total][2], size)
    assert all(abs(taken - goal) <= 3 * longest for taken, goal, longest in by.values())
    assert sum(goal for _, goal, _ in by.values()) == pytest.approx(sum(by))


def test_mix_repeats_whole_rows(documents):
    copies = {r[0]: r[1] for r in systematic_copies(documents).select("doc.doc_id", "copies").collect()}
    mixed = mix(documents)
    assert mixed.schema == documents.schema
    counts = {r[0]: r[1] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in copies.items() if v}


def test_empty_table(no_documents):
    assert systematic_copies(no_documents).collect() == []
    assert mix(no_documents).collect() == []


def test_no_python_in_the_plan(documents):
    plan = mix(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan
