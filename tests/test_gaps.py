"""Gaps between days with facts against laying out every day."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from daybook.operators import spine

DAY = dt.timedelta(days=1)


def brute(rows, first=None, last=None):
    days = [d for _, d in rows if d]
    first, last = first or min(days), last or max(days)
    out = []
    for e in {e for e, _ in rows}:
        seen, d = {d for who, d in rows if who == e}, first
        while d <= last:
            if d in seen:
                d += DAY
                continue
            end = d
            while end + DAY <= last and end + DAY not in seen:
                end += DAY
            out.append((e, d, end, (end - d).days + 1))
            d = end + DAY
    return sorted(out, key=str)


@pytest.mark.parametrize("ends", [{}, {"first": "2024-02-10", "last": "2024-02-20"}, {"first": "2024-01-01"}])
def test_gaps_equal_all_days_without_a_fact(spark, ends):
    rng, start = random.Random(2), dt.date(2024, 2, 1)
    rows = [(e, start + rng.randrange(40) * DAY) for e in ("a", "b", None) for _ in range(25)]
    rows += [("once", start + 5 * DAY), ("never", None), ("b", None), *rows[:9]]
    facts = spark.createDataFrame(rows, "user string, at date").repartition(3)
    want = brute(rows, *[dt.date.fromisoformat(ends[k]) if k in ends else None for k in ("first", "last")])
    got = spine.gap_intervals(facts, ["user"], "at", **ends)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert spine.gap_days(facts, ["user"], "at", **ends).count() == sum(r[3] for r in want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan


def test_no_facts_no_gaps(spark):
    facts = spark.createDataFrame([], "user string, at date")
    assert spine.gap_intervals(facts, ["user"], "at").collect() == []
