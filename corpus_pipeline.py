"""A training corpus from ``documents``: judge, thin out, mask, mix, pack.

Each stage takes the rows its predecessor kept and its decisions take effect: rejected documents
go, one document of each group of near copies stays, secrets are masked, documents are
taken as often as the mix wants, and what is left is packed into windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.classifier import good_documents
from daybook.llm.common import table
from daybook.llm.jaccard import first_of_class
from daybook.llm.mixing import mix
from daybook.llm.packing import pack
from daybook.llm.secret_scan import mask_secrets
from daybook.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more; it learns from the labels of four fifths of the ids."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group linked by a Jaccard similarity of 0.8 or more."""
    return first_of_class(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; ``n_chars`` is that of the masked text."""
    masked = mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(masked.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in windows of 2048 tokens; a repeated document is packed as often."""
    return pack(docs, keep=("doc_id", "source"))


STAGES = [("quality", quality), ("near_copies", near_copies), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None  # the classifier and the tokenizer are beyond SQL; the stages are tested one by one


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
