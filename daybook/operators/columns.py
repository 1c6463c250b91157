"""Plan shape helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame) -> DataFrame:
    """The same rows, with computed columns that later filters read instead of repeat.

    A filter on a computed column is pushed to the scan with the expression copied into it,
    which then runs twice or more. Behind a generator of one row per row it stays put.
    Filters on plain columns belong before this.
    """
    return df.select(F.inline_outer(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
