"""Lookup joins that complete a batch from detail tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import text as X


def price_overrides(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """Unpriced rows take the listed price of the id in their URL.

    ``dimension`` has columns (event_key, min_price).
    """
    key = X.blank_to_null(F.regexp_extract(X.text_or_empty("url"), r"/(?:events?|e)/([^/?\s]+)", 1))
    named = dimension.select("event_key", F.col("min_price").alias("__price"))
    joined = df.withColumn("event_key", key).join(named, "event_key", "left")
    use = (F.coalesce("price", F.lit(0.0)) == 0) & F.col("__price").isNotNull()
    out = [c for c in df.columns if c not in ("price", "price_note")]
    return joined.select(
        *out,
        F.when(use, F.col("__price")).otherwise(F.col("price")).alias("price"),
        F.when(use, F.lit("Manually verified pricing"))
        .otherwise(F.col("price_note"))
        .alias("price_note"),
    )


def enrich(df: DataFrame, details: DataFrame, keys: list[str]) -> DataFrame:
    """Left join; a detail value wins when it is not empty.

    ``details`` has one row per key. Columns the batch lacks are added.
    """
    added = [c for c in details.columns if c not in keys]
    right = details.select(*keys, F.struct(*added).alias("__d"))
    joined = df.join(right, keys, "left")
    kinds = dict(details.dtypes)
    out = []
    for name in dict.fromkeys([*df.columns, *added]):
        if name not in added:
            out.append(F.col(name))
            continue
        detail = F.col(f"__d.{name}")
        if kinds[name] == "string":
            detail = X.blank_to_null(detail)
        out.append((F.coalesce(detail, F.col(name)) if name in df.columns else detail).alias(name))
    return joined.select(*out)


def full_titles(df: DataFrame, details: DataFrame, keys: list[str]) -> DataFrame:
    """A cut title is replaced by the detail title that begins with it."""
    right = details.select(*keys, F.col("title").alias("__full"))
    joined = df.join(right, keys, "left")
    stem = F.rtrim(X.text_or_empty("title"), F.lit(". "))
    title = F.when(F.startswith("__full", stem), F.col("__full")).otherwise(F.col("title"))
    return joined.withColumn("title", title).select(*df.columns)
