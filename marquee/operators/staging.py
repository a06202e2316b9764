"""Computing costly expressions once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns behind a one-row generator.

    The optimizer copies a projected expression into every filter that reads
    it; for long expressions used many times the plan then grows without bound.
    It does not look through a generator, so each column here is computed once.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
