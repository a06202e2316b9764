"""Set operations over batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sources(batches: list[DataFrame]) -> DataFrame:
    """All batches in one schema, missing columns as NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def difference(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a whose key is not in b."""
    return a.join(b.select(key), key, "left_anti")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The non-empty values of a column."""
    return df.select(column).where(F.nullif(F.col(column).cast("string"), F.lit("")).isNotNull()).distinct()


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str = "source") -> DataFrame:
    """Rows of the second feed only for keys the first feed has nothing for."""
    return primary.unionByName(
        fallback.join(primary.select(key), key, "left_anti"), allowMissingColumns=True
    )
