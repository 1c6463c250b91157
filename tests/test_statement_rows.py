"""CSV rows whose quoted cells hold line breaks, in splits of any size, against Python's reader."""

from __future__ import annotations

import csv
import random

import pytest
from pyspark.sql import functions as F

from daybook.plans import imports
from daybook.schemas import BankProfile
from daybook.sources.chat_lines import text_lines
from daybook.sources.statements import cells, find_headers, profile_table, statement_cells, whole_rows
from tests.samples import RULES, TZ

CELLS = ["x", "", "two words", "a,b", 'said "no"', "one\ntwo", "\n", 'q"\n"q', "1,2\n3", "tail\n", '"', "é☃"]


def table_of(rng, n):
    return [[str(i), *[rng.choice(CELLS) for _ in range(3)]] for i in range(n)]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root, rng, want = tmp_path_factory.mktemp("csv"), random.Random(3), {}
    for name, n, end in (("a.csv", 200, "\n"), ("b.csv", 40, "\r\n"), ("c.csv", 1, "\n")):
        want[name] = table_of(rng, n)
        with open(root / name, "w", encoding="utf-8", newline="") as out:
            csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL).writerows(want[name])
    (root / "odd.csv").write_text('1,a 5" pipe,b,c\n2,x,y,z\n')
    want["odd.csv"] = [["1", 'a 5" pipe', "b", "c"], ["2", "x", "y", "z"]]
    return str(root), want


@pytest.mark.parametrize("split", [7, 64, 1_000_000])
def test_rows_equal_those_of_a_csv_reader(spark, files, split):
    root, want = files
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        rows = whole_rows(text_lines(spark, root, "*.csv")).select("path", "block", "line_id", "pos", cells(F.col("line")).alias("cells"))
        got: dict = {}
        for r in sorted(rows.collect()):
            got.setdefault(r.path.rsplit("/", 1)[1], []).append(list(r.cells))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert got["c.csv"] == want["c.csv"]


def test_import_of_such_a_statement_below_a_long_preamble(spark, tmp_path, warehouse):
    profile = BankProfile(
        name="mill", header_signature=("When", "What", "Sum"), date_col="When", narration_col="What",
        amount_style="signed", amount_col="Sum", date_format="%d-%m-%Y",
    )
    rows = ["about this account"] * 40 + ["When,What,Sum", '01-02-2023,"OLD\nMILL",-4.50', '02-02-2023,"a ""b""\n\nc",7', "03-02-2023,plain,1"]
    (tmp_path / "mill.csv").write_text("\n".join(rows) + "\n")
    short = imports.run_job(spark, imports.bank_job([profile], RULES, TZ), str(tmp_path), warehouse).first()
    assert short.rows_inserted == 0
    deep = imports.run_job(spark, imports.bank_job([profile], RULES, TZ, scan_lines=None), str(tmp_path), warehouse).first()
    assert deep.rows_inserted == 3
    found = imports.read_table(spark, warehouse, "transactions").select("narration").collect()
    assert {"plain"} < {r.narration for r in found} and any("MILL" in r.narration for r in found)


def test_a_long_quoted_cell_with_doubled_quotes_is_one_cell(spark):
    long = 'say ""x"" ' * 20 + "x, y " * 20_000
    lines = [f'1,"{long}",2', '"', '"open,1', '"a""', '""', "", ",", '"a"x,b', '"""",1']
    rows = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, line string")
    got = [r.c for r in rows.select("i", cells(F.col("line")).alias("c")).orderBy("i").collect()]
    assert got == [["1", long.replace('""', '"'), "2"], [""], ["open", "1"], ["a"], [""], [""], ["", ""], ["a", "b"], ['"', "1"]]


STATEMENT = BankProfile(
    name="mill", header_signature=("When", "What", "Sum"), date_col="When", narration_col="What",
    amount_style="signed", amount_col="Sum", date_format="%d-%m-%Y",
)


def test_lines_of_files_without_open_quotes_are_neither_sorted_nor_shuffled(spark, tmp_path):
    rows = [("a", 0, 0, i, line) for i, line in enumerate(["top", "When,What,Sum", '01-02-2023,"x",1', "02-02-2023,y,2"])]
    rows += [("b", 0, 0, 0, '"When",What, Sum'), ("b", 1, 0, 0, "01-02-2023,z,3"), ("c", 0, 0, 0, "When,Sum"), (None, 0, 0, 0, "x")]
    path = str(tmp_path / "lines")
    spark.createDataFrame(rows, "path string, block long, line_id long, pos int, line string").write.parquet(path)
    found = statement_cells(spark.read.parquet(path), [STATEMENT])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan
    got = {(r.path, r.date_text, r.narration_text, r.amount_text) for r in found.collect()}
    assert got == {("a", "01-02-2023", "x", "1"), ("a", "02-02-2023", "y", "2"), ("b", "01-02-2023", "z", "3")}


def test_a_header_stands_where_lines_before_it_are_counted(spark):
    rows = [("deep", 0, 0, i, "x") for i in range(40)] + [("deep", 1, 0, 0, "When,What,Sum")]
    rows += [("two", 0, 0, 0, "x"), ("two", 0, 0, 1, "sum,what,WHEN"), ("two", 0, 0, 2, "When,What,Sum")]
    rows += [("twice", 0, 0, 0, "x"), ("twice", 0, 0, 1, "When,What,Sum"), ("twice", 0, 0, 1, "When,What,Sum")]
    lines = spark.createDataFrame(rows, "path string, block long, line_id long, pos int, line string")
    profiles = profile_table(lines, [STATEMENT])
    at = lambda **k: {(r.path, r.header_row) for r in find_headers(lines, profiles, **k).collect()}
    assert at() == {("two", 1), ("twice", 2)}
    assert at(scan_lines=41) == at(scan_lines=None) == {("two", 1), ("twice", 2), ("deep", 40)}
