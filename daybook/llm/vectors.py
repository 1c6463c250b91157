"""Rows of vectors that take part in a search, and the last step that both searches share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.session import materialize


def valid_vectors(df: DataFrame, id_column: str, vector_column: str, nonzero: bool = False, label: Column | None = None) -> DataFrame:
    """Written rows (row, vec_id, vec, dim) of the vectors that take part; ``row`` numbers them.

    With ``label``, a long, rows have it as well and those where it is null take no part.

    Left out are null and empty vectors, those holding null or non-finite components, with
    ``nonzero`` those of zeros alone, and rows whose id is null, which no result could name.
    """
    vec = F.col(f"`{vector_column}`").cast("array<double>")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    more = [] if label is None else [label.cast("long").alias("label")]
    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), vec.alias("vec"), *more)
    if more:
        rows = rows.filter(F.col("label").isNotNull())
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", number))
    if nonzero:
        rows = rows.filter(F.exists("vec", lambda x: x != 0))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec", F.size("vec").alias("dim"), *["label" for _ in more])
    return materialize(rows, "vectors")


def matrix(column) -> np.ndarray:
    """The vectors of an Arrow column of lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(column), -1), dtype=np.float64)


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query row: highest score first, ties to the smaller vec_id."""
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
