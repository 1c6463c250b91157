"""JSON files in splits of any size against reading each file whole."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from daybook.sources import exports
from daybook.sources.json_records import json_pieces, json_records, placed_pieces

SCHEMA = "id bigint, name string, inner struct<a: bigint, b: string>, list array<struct<x: bigint>>"


def records(rng, n):
    texts = ['plain', 'a "quoted" }{ brace', "back\\slash", 'ends in \\"', "{[}]", "é☃ \U0001f600", "", "tab\tnew\nline", '\\"}', '"', "}", "[,{"]
    out = []
    for i in range(n):
        r = {"id": i, "name": rng.choice(texts) + rng.choice(texts)}
        if i % 3 == 0:
            r["inner"] = {"a": i, "b": rng.choice(texts)}
        if i % 4 == 0:
            r["list"] = [{"x": k} for k in range(i % 5)]
        if i % 7 == 0:
            r[rng.choice(texts[:2])] = rng.choice((1.5, None, "x", True))
        out.append(r)
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("json"), random.Random(5)
    dump = lambda x, **o: json.dumps(x, ensure_ascii=False, **o)
    files = {
        "one_line.json": dump(records(rng, 90)),
        "lines.json": "[\n" + ",\n".join(map(dump, records(rng, 60))) + "\n]\n",
        "pretty.json": dump(records(rng, 25), indent=3),
        "single.json": dump(records(rng, 1)[0] | {"inner": {"a": 1, "b": "}"}}),
        "single_feed.json": dump(records(rng, 1)[0]) + " \n",
        "none.json": "[ ]",
        "mark.json": "﻿" + dump(records(rng, 5)),
    }
    for name, text in files.items():
        (root / name).write_text(text, encoding="utf-8")
    return str(root)


@pytest.mark.parametrize("split", [16, 100, 1_000, 1_000_000])
def test_rows_equal_reading_files_whole(spark, folder, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got = exports.read_json_export(spark, folder, "*.json", SCHEMA)
        pieces = json_pieces(spark, folder, "one_line.json")
        assert pieces.rdd.getNumPartitions() > 3 or split > 1_000
        if split == 100:
            assert pieces.select("block").distinct().count() > 20
        shown = F.to_json(F.struct("id", "name", "inner", "list"))
        mine = sorted((r[0].rsplit("/", 1)[1], r[1]) for r in got.select("path", shown).collect())
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        whole = spark.read.option("multiLine", True).schema(SCHEMA).json(folder).withColumn("path", F.col("_metadata.file_path"))
        want = sorted((r[0].rsplit("/", 1)[1], r[1]) for r in whole.select("path", shown).collect())
        assert mine == want and len(want) == 182
        assert got.filter(F.col(exports.CORRUPT).isNotNull()).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_other_fields_are_texts(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"id": 1, "n": 2.5, "o": {"p": [1, "}"]}}, {"id": 2, "m": true}]')
    got = exports.read_json_export(spark, str(tmp_path), "*.json", "id bigint").drop("path", exports.CORRUPT)
    assert got.columns == ["id", "m", "n", "o"]
    assert sorted(map(tuple, got.collect())) == [(1, None, "2.5", '{"p":[1,"}"]}'), (2, "true", None, None)]


@pytest.mark.parametrize(
    "text",
    ['[{"id": 1}, {"id": 2', '[{"id": 1}, {"id": 2}', '[{"id": 1} {"id": 2}]', '[{"id": 1}}]', '{"id": 1', '[{"id": 1}, {"id": "x]', '[{"id": 1}, {id}]', '[{"id": 1}] rest', '{"id": 1}, {"id": 2}x', "[", '[{"id": 1}, "}"]'],
)
def test_a_damaged_file_is_one_row_and_others_stay(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    (tmp_path / "good.json").write_text('[{"id": 7}]')
    got = exports.read_json_export(spark, str(tmp_path), "*.json", "id bigint")
    rows = sorted((r.path.rsplit("/", 1)[1], r.id, r[exports.CORRUPT] is None) for r in got.collect())
    assert rows == [("bad.json", None, False), ("good.json", 7, True)]


def test_flat_records_are_not_shuffled_by_record(spark, folder):
    placed = placed_pieces(json_pieces(spark, folder, "*.json"))
    texts = [r.text for r in json_records(placed).collect()]
    flat = placed.filter("depth = 0 and after = 0 and opens > 0").count()
    assert len(texts) == 182 and flat == sum(t.count("}") == 1 for t in texts) > 30
