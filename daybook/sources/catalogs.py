"""CSV catalogs as search documents, and the rule catalog."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.fixed_values import CATALOGS, RULE_COLUMNS, STACK_COLUMNS, STACKS

DOCUMENT = "corpus string, doc_id bigint, text string, record map<string,string>"


def _csv(spark: SparkSession, path: str) -> DataFrame | None:
    """A catalog with all columns as text, in file order; None if there is no such file."""
    try:
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.withColumn("doc_id", F.monotonically_increasing_id())


def catalog_documents(rows: DataFrame, corpus: str, searched: Sequence[str]) -> DataFrame:
    """Rows as documents: the searched columns form the text, all columns the record."""
    names = [c for c in rows.columns if c != "doc_id"]
    value = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names}
    pairs = [x for c in names for x in (F.lit(c), value[c])]
    return rows.select(
        F.lit(corpus).alias("corpus"),
        "doc_id",
        F.concat_ws(" ", *[value[c] for c in searched if c in value]).alias("text"),
        F.create_map(*pairs).alias("record"),
    )


def read_catalogs(spark: SparkSession, folder: str) -> DataFrame:
    """Every catalog below a folder as documents; a catalog without a file has none."""
    wanted = [(corpus, file, columns) for corpus, (file, columns) in CATALOGS.items()]
    wanted += [(f"stack:{s}", f"stacks/{s}.csv", STACK_COLUMNS) for s in STACKS]
    parts = [spark.createDataFrame([], DOCUMENT)]
    for corpus, file, columns in wanted:
        rows = _csv(spark, f"{folder}/{file}")
        if rows is not None:
            parts.append(catalog_documents(rows, corpus, columns))
    return reduce(DataFrame.unionByName, parts)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rule catalog in the columns ``apply_rule`` expects, numbered in file order."""
    rows = _csv(spark, path)
    if rows is None:
        raise FileNotFoundError(path)
    return rows.select(
        F.col("doc_id").alias("rule_no"), *[F.col(c).alias(name) for name, c in RULE_COLUMNS.items()]
    )
