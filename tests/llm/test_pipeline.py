"""The stages one after the other, and every registered query on a small table."""

from __future__ import annotations

import os
import random

import duckdb
import pytest
from tests.llm.llm_prose import clean, junk
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from daybook.llm import queries
from tools.compare import rows_of

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(i, junk(rng) if i % 5 == 0 else clean(rng), "en", f"s{i % 3}") for i in range(300)]
    rows[7] = (7, rows[6][1], "en", "s0")
    rows[8] = (8, rows[6][1] + " more", "en", None)
    rows[11] = (11, rows[11][1] + " token=abcdef123456 " + rows[12][1], "en", "s1")
    rows[13] = (13, None, "en", "s1")
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(300) if i % 7], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.schema == seen["documents"].schema
    ids = lambda n: {r[0] for r in seen[n].select("doc_id").collect()}
    bad = {i for i in range(300) if i % 5 == 0}
    assert len(ids("quality") & bad) <= 3 and len((ids("documents") - bad) - ids("quality")) <= 3
    assert {6, 7, 8} <= ids("quality") and ids("near_copies") & {6, 7, 8} == {6}
    assert ids("quality") - ids("near_copies") == {7, 8}
    assert ids("secrets") == ids("near_copies")
    text = seen["secrets"].filter("doc_id = 11").first()
    assert "abcdef123456" not in text.text and text.n_chars == len(text.text)
    assert ids("mixing") <= ids("secrets") and seen["mixing"].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    packed = seen["packing"].collect()
    whole = {(p.doc_id): p.doc_tokens for p in packed}
    copies = {r[0]: r[1] for r in seen["mixing"].groupBy("doc_id").count().collect()}
    assert sum(p.length for p in packed) == sum(whole[i] * n for i, n in copies.items())
    again = corpus_pipeline.run(spark, folder).agg(F.sum("length"), F.countDistinct("doc_id")).first()
    assert tuple(again) == (sum(p.length for p in packed), len(copies))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    cursor = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cursor.description], cursor.fetchall())


def test_registered():
    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_near_copies_go_when_the_files_are_cut_anew(spark, tmp_path):
    rng = random.Random(8)
    texts = [clean(rng) for _ in range(40)]
    rows = [(2 * i + k, t) for i, t in enumerate(texts) for k in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "docs"))
    kept = corpus_pipeline.near_copies(spark, spark.read.parquet(str(tmp_path / "docs")), "")
    settings = {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "0"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == list(range(0, 80, 2))
    finally:
        for key in settings:
            spark.conf.unset(key)
