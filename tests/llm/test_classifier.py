"""The additive model on data with a known answer, and on awkward rows."""

from __future__ import annotations

import random

import numpy as np
from tests.llm.llm_prose import clean, junk

from daybook.llm import classifier as C


def test_tables_learn_curves_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 0] < 0.6) | (x[:, 1] > 0.5) & (x[:, 2] > 0.5)).astype(float)
    model = C.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.93
    assert len(model.pairs) == 6 and any({i, j} == {1, 2} for i, j, _ in model.pairs)


def test_score_is_the_sum_of_table_entries():
    rng = np.random.default_rng(2)
    x = rng.random((500, 3))
    model = C.fit(x, (x[:, 0] + x[:, 1] > 1).astype(float))
    for row, got in zip(x[:20], model.logit(x[:20]), strict=True):
        total = model.intercept
        for v, e, t in zip(row, model.edges, model.tables, strict=True):
            total += t[sum(k <= v for k in e)]
        for i, j, t in model.pairs:
            total += t[sum(k <= row[i] for k in model.coarse[i]), sum(k <= row[j] for k in model.coarse[j])]
        assert abs(total - got) < 1e-9


def test_held_out_documents(spark):
    rng = random.Random(5)
    rows = [(i, junk(rng) if i % 4 == 0 else clean(rng), int(i % 4 != 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = C.train(docs.filter("doc_id < 400"), labels)
    got = {r.doc_id: r.score for r in C.score(docs.drop("score"), model, ["doc_id"]).collect()}
    held = [(got[i] >= C.THRESHOLD) == bool(q) for i, _, q in rows if i >= 400]
    assert sum(held) / len(held) > 0.97


def test_labels_of_held_out_ids_teach_nothing(spark, documents):
    learn = C.crc32_mod("doc_id", 5) != 0
    ids = [r[0] for r in documents.select("doc_id").collect()]
    one = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    flipped = one.withColumn("quality", C.F.when(learn, C.F.col("quality")).otherwise(1 - C.F.col("quality")))
    first, second = (C.train(documents, x, learn=learn) for x in (one, flipped))
    assert first.intercept == second.intercept
    assert all((a == b).all() for a, b in zip(first.tables, second.tables, strict=True))


def test_awkward_rows(spark, documents, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (4, 1), (4, 0)], "doc_id long, quality int")
    model = C.train(documents, labels)
    for df in (documents, odd_documents):
        out = C.score(df, model, ["doc_id"]).collect()
        assert len(out) == df.count() and all(0 <= r.score <= 1 for r in out)
    assert C.score(no_documents, model, ["doc_id"]).collect() == []
    nobody = C.train(documents, labels.limit(0))
    assert {r.score for r in C.score(documents, nobody, ["doc_id"]).collect()} == {0.5}
    assert C.good_documents(odd_documents, labels).schema == odd_documents.schema
