"""Scans, paging and keyed changes of the listings table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from marquee import schemas
from marquee.functions.dates import moment, ntz
from marquee.session import cut_lineage


def page(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """O1: by start, ties by id."""
    ordered = df.orderBy("event_date", "id")
    if offset:
        ordered = ordered.offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def all_listings(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Every listing by start, optionally one page."""
    return page(df, limit, offset)


def get_listing(df: DataFrame, listing_id: int) -> DataFrame:
    """The row of one key."""
    return df.where(F.col("id") == listing_id)


def existing_keys(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """S3: rows of a batch whose (url, start) is stored already."""
    return batch.join(stored.select("url", "event_date"), ["url", "event_date"], "left_semi")


def enabled_sources(sources: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Enabled sources, or those asked for by name."""
    chosen = sources.where("enabled")
    return chosen if names is None else chosen.where(F.col("name").isin(names))


def feeds_of(feeds: DataFrame, sources: DataFrame) -> DataFrame:
    """Feed rows of the selected sources."""
    return feeds.join(sources.select(F.col("name").alias("source")), "source", "left_semi")


def decode_rows(df: DataFrame) -> DataFrame:
    """Rows of an older shape in today's schema, with defaults."""
    defaults: dict[str, Column] = {"is_free": F.lit(False), "region": F.lit("westside")}
    for name in ("description", "venue_name", "address", "category", "url", "image_url",
                 "source_logo_url", "price_note"):
        defaults[name] = F.lit("")
    out = []
    for field in schemas.LISTINGS.fields:
        kept = F.col(field.name) if field.name in df.columns else F.lit(None)
        kept = kept.cast(field.dataType)
        if field.name in defaults:
            kept = F.coalesce(kept, defaults[field.name])
        out.append(kept.alias(field.name))
    return df.select(*out)


def recent(df: DataFrame, n: int = 10) -> DataFrame:
    """O3: most recently created."""
    return df.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def assign_keys(
    batch: DataFrame, stored: DataFrame, order: str = "arrival", block: int = 1_000_000
) -> DataFrame:
    """K1: dense new ids above the stored maximum, in arrival order.

    Rows are numbered inside blocks of the arrival order; only the block counts
    (one row per ``block`` rows) pass through a single running sum.
    """
    numbered = batch.drop("id").withColumn("__block", F.floor(F.col(order) / block))
    counts = numbered.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    starts = starts.withColumn("__one", F.lit(1)).join(
        top.withColumn("__one", F.lit(1)), "__one"
    )
    inside = Window.partitionBy("__block").orderBy(order)
    return (
        numbered.withColumn("__rank", F.row_number().over(inside))
        .join(starts, "__block")
        .withColumn("id", F.col("__top") + F.col("__before") + F.col("__rank"))
        .drop("__block", "__n", "__before", "__rank", "__top", "__one")
    )


def insert(batch: DataFrame, stored: DataFrame, as_of, order: str = "arrival") -> DataFrame:
    """K1: batch rows with keys and stamps, ready to append."""
    return (
        assign_keys(batch, stored, order)
        .withColumn("created_at", ntz(as_of))
        .withColumn("updated_at", ntz(as_of))
        .select(*schemas.LISTINGS.fieldNames())
    )


#: Partition column of the stored table: the month of the start, "none" without one.
MONTH = "event_month"


def month_of(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM"), F.lit("none"))


def append_listings(rows: DataFrame, path: str) -> None:
    """K1: append to the table, one folder per month of the start."""
    rows.withColumn(MONTH, month_of(F.col("event_date"))).write.mode("append").partitionBy(MONTH).parquet(path)


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """The stored table, with its month as a column that calendar filters prune by."""
    return spark.read.schema(StructType([*schemas.LISTINGS.fields, StructField(MONTH, StringType())])).parquet(path)


def in_months(df: DataFrame, first=None, after=None) -> DataFrame:
    """Months that can hold a start from one moment to another; other tables pass as they are.

    Adds nothing to a filter on the start but lets the scan skip folders.
    """
    if MONTH not in df.columns:
        return df
    hit = F.lit(True)
    if first is not None:
        hit = hit & (F.col(MONTH) >= F.lit(moment(first).strftime("%Y-%m"))) & (F.col(MONTH) != "none")
    if after is not None:
        hit = hit & (F.col(MONTH) <= F.lit(moment(after).strftime("%Y-%m")))
    return df.where(hit)


def _rewrite_months(spark: SparkSession, path: str, months: list[str], change: Callable[[DataFrame], DataFrame]) -> None:
    """Replaces the rows of some months by what ``change`` makes of them; a month left without rows is emptied.

    New places are written before old ones are emptied. If a job ends in between, moved
    rows are there twice and the same change, run again, leaves them once.
    """
    before = read_listings(spark, path).where(F.col(MONTH).isin(months)).drop(MONTH).dropDuplicates(["id"])
    held = cut_lineage(change(before)).withColumn(MONTH, month_of(F.col("event_date")))
    held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    left = {r[MONTH] for r in held.select(MONTH).distinct().collect()}
    for month in sorted(set(months) - left):
        held.drop(MONTH).limit(0).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{MONTH}={month}")


def update_months(changes: DataFrame, path: str, as_of) -> None:
    """K2: stored rows named by the changes, which may also move to another start; only months touched are written.

    ``changes`` has id, the month a row is stored under (event_month) and the new values.
    """
    target = month_of(F.col("event_date")) if "event_date" in changes.columns else F.col(MONTH)
    touched = changes.select(F.col(MONTH).alias("m")).union(changes.select(target.alias("m"))).distinct()
    months = [r["m"] for r in touched.collect()]  # one row per month
    _rewrite_months(changes.sparkSession, path, months, lambda rows: update(rows, changes.drop(MONTH), as_of))


def delete_months(keys: DataFrame, path: str) -> None:
    """K3: stored rows named by id, of the months (event_month) that ``keys`` gives; no other month is read."""
    months = [r[MONTH] for r in keys.select(MONTH).distinct().collect()]
    _rewrite_months(keys.sparkSession, path, months, lambda rows: delete(rows, keys))


def set_category_months(changes: DataFrame, path: str, as_of) -> None:
    """K4: new category and stamp for the named rows; ``changes`` has id, event_month and category."""
    update_months(changes.select("id", MONTH, "category"), path, as_of)


def update(stored: DataFrame, changes: DataFrame, as_of) -> DataFrame:
    """K2: rows named by the changes take their values and a new stamp."""
    changed = [c for c in changes.columns if c in stored.columns and c not in ("id", "updated_at")]
    incoming = changes.select(
        "id", F.struct(*changed).alias("__new")
    )
    joined = stored.join(incoming, "id", "left")
    hit = F.col("__new").isNotNull()
    out = []
    for name in stored.columns:
        if name == "updated_at":
            out.append(F.when(hit, ntz(as_of)).otherwise(F.col(name)).alias(name))
        elif name in changed:
            out.append(F.when(hit, F.col(f"__new.{name}")).otherwise(F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    return joined.select(*out)


def delete(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """K3: rows whose id is not named."""
    return stored.join(keys.select("id"), "id", "left_anti")


def set_category(stored: DataFrame, changes: DataFrame, as_of) -> DataFrame:
    """K4: new category and stamp for the named rows."""
    return update(stored, changes.select("id", "category"), as_of)
