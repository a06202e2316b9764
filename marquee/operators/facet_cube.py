"""Stored facet counts: listings counted by days, category, venue, source and flags, per month.

A facet or headline report reads the cube's months of its window and no listing. Days decide
every calendar filter, spans included, so reports on the cube equal those on the listings.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.functions.dates import moment, ntz
from marquee.operators import facets as A
from marquee.operators import search as S
from marquee.operators.listings import MONTH, month_of, read_listings
from marquee.session import cut_lineage

#: Names of the cells; ``boxed`` tells whether a listing passes the standard search box.
CELLS = ["event_date", "end_date", "category", "source", "venue_name", "is_free", "region", "boxed"]


def cube_of(listings: DataFrame) -> DataFrame:
    """Cells and how many listings each holds.

    Starts and ends are cut to their day; an end that is no later day is left out, since
    no calendar filter reads it. A missing free flag counts as not free, an empty venue as
    none. Rows without start, category or source are kept in cells of their own.
    """
    start, end = F.date_trunc("day", "event_date"), F.date_trunc("day", "end_date")
    cells = listings.select(
        start.cast("timestamp_ntz").alias("event_date"),
        F.when(end > start, end).cast("timestamp_ntz").alias("end_date"),
        "category", "source", F.nullif("venue_name", F.lit("")).alias("venue_name"),
        F.coalesce("is_free", F.lit(False)).alias("is_free"), "region", S.in_bounds(V.SEARCH_BOX).alias("boxed"),
    )
    counted = cells.groupBy(*CELLS).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn(MONTH, month_of(F.col("event_date")))


def refresh_cube(spark: SparkSession, listings_path: str, cube_path: str, months: list[str] | None = None) -> None:
    """Counts the given months of the stored listings anew, all without the argument.

    To be called after K1 to K4 with the months they touched. Other months are neither read
    nor written; a month left without listings is emptied. Run again, it gives the same cube.
    """
    rows = read_listings(spark, listings_path)
    if months is not None:
        rows = rows.where(F.col(MONTH).isin(months))
    cube = cut_lineage(cube_of(rows.drop(MONTH)))
    cube.write.mode("overwrite").option(
        "partitionOverwriteMode", "static" if months is None else "dynamic").partitionBy(MONTH).parquet(cube_path)
    left = {r[MONTH] for r in cube.select(MONTH).distinct().collect()}  # one row per month
    for month in sorted(set(months or []) - left):
        cube.drop(MONTH).limit(0).write.mode("overwrite").parquet(f"{cube_path.rstrip('/')}/{MONTH}={month}")


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn(MONTH, F.col(MONTH).cast("string"))


def cube_tallies(
    cube: DataFrame, listings: DataFrame, as_of, date_filter: str = "upcoming", specific_date: str | None = None,
    categories: list[str] | None = None, sources: list[str] | None = None, free_only: bool = False,
    region: str | None = None, bbox=V.SEARCH_BOX, min_venue_count: int = 3,
) -> DataFrame:
    """A4: ``facets.filter_tallies`` from the cube; a box of one's own is counted from the listings."""
    if bbox and bbox != V.SEARCH_BOX:
        return A.filter_tallies(listings, as_of, date_filter, specific_date, categories, sources, free_only,
                                region, bbox, min_venue_count)
    hit = F.col("source").isNotNull() & F.col("category").isNotNull() & S.in_region(region)
    if bbox:
        hit = hit & F.col("boxed")
    kept = S.by_date(cube, date_filter, as_of, specific_date).where(hit)
    return A._tally(kept, F.col("n"), categories, sources, free_only, min_venue_count)


def cube_hero_counts(cube: DataFrame, as_of) -> DataFrame:
    """Upcoming listings, those active today, and sources with upcoming ones."""
    today = moment(as_of).date()
    tomorrow = today + timedelta(days=1)
    ahead = F.col("event_date") >= ntz(today)
    starts = ahead & (F.col("event_date") < ntz(tomorrow))
    spans = F.coalesce((F.col("event_date") < ntz(tomorrow)) & (F.col("end_date") >= ntz(today)), F.lit(False))

    def total(hit):
        return F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))

    return cube.agg(
        total(ahead).alias("upcoming"), total(starts | spans).alias("active_today"),
        F.count_distinct(F.when(ahead, F.col("source"))).alias("sources"),
    )
