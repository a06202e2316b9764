"""Facet and headline counts over listings."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.functions.dates import moment, ntz
from marquee.operators import search as S
from marquee.session import small_table


def _base(region: str | None, bbox) -> Column:
    """Rows any facet may count; unlike search, no venue is let in by name."""
    hit = F.col("source").isNotNull() & F.col("category").isNotNull() & S.in_region(region)
    return hit & S.in_bounds(bbox) if bbox else hit


def filter_tallies(
    df: DataFrame,
    as_of,
    date_filter: str = "upcoming",
    specific_date: str | None = None,
    categories: list[str] | None = None,
    sources: list[str] | None = None,
    free_only: bool = False,
    region: str | None = None,
    bbox=V.SEARCH_BOX,
    min_venue_count: int = 3,
) -> DataFrame:
    """A4: all facets in one scan, each ignoring its own selection.

    Rows are (facet, name, n) with facet category, venue or free.
    """
    kept = df.where(_base(region, bbox) & S.date_predicate(date_filter, as_of, specific_date))
    return _tally(kept, F.lit(1), categories, sources, free_only, min_venue_count)


def _tally(
    kept: DataFrame, n: Column, categories: list[str] | None, sources: list[str] | None, free_only: bool, min_venue_count: int
) -> DataFrame:
    """The facets of rows that each stand for so many listings."""
    in_category = F.col("category").isin(categories) if categories else F.lit(True)
    in_source = F.col("source").isin(sources) if sources else F.lit(True)
    free = F.coalesce(F.col("is_free"), F.lit(False))
    toggled = free if free_only else F.lit(True)

    marked = kept.select(
        "category",
        F.nullif("venue_name", F.lit("")).alias("venue"),
        ((toggled & in_source).cast("int") * n).alias("for_category"),
        ((toggled & in_category).cast("int") * n).alias("for_venue"),
        ((free & in_category & in_source).cast("int") * n).alias("for_free"),
    )
    counted = marked.groupingSets(
        [[F.col("category")], [F.col("venue")], []], "category", "venue"
    ).agg(
        F.grouping_id().alias("level"),
        F.sum("for_category").alias("n_category"),
        F.sum("for_venue").alias("n_venue"),
        F.sum("for_free").alias("n_free"),
    )
    level = F.col("level")
    facet = (
        F.when(level == 1, F.lit("category")).when(level == 2, F.lit("venue")).otherwise("free")
    )
    total = F.when(level == 1, F.col("n_category")).when(level == 2, F.col("n_venue")).otherwise(
        F.coalesce("n_free", F.lit(0))
    )
    rows = counted.select(
        facet.alias("facet"),
        F.coalesce("category", "venue").alias("name"),
        total.alias("n"),
    )
    return rows.where(
        (F.col("facet") == "free")
        | ((F.col("facet") == "category") & (F.col("n") > 0))
        | ((F.col("facet") == "venue") & F.col("name").isNotNull() & (F.col("n") >= min_venue_count))
    )


def facet_categories(df: DataFrame, as_of, **filters) -> DataFrame:
    """A1: count per category."""
    rows = filter_tallies(df, as_of, **filters).where("facet = 'category'")
    return rows.select(F.col("name").alias("category"), "n").orderBy("category")


def facet_venues(df: DataFrame, as_of, **filters) -> DataFrame:
    """A2: count per venue that has enough listings."""
    rows = filter_tallies(df, as_of, **filters).where("facet = 'venue'")
    return rows.select(F.col("name").alias("venue_name"), "n").orderBy(F.desc("n"), "venue_name")


def facet_free(df: DataFrame, as_of, **filters) -> DataFrame:
    """A3: free listings, whatever the free toggle says."""
    return filter_tallies(df, as_of, **filters).where("facet = 'free'").select("n")


def category_order(df: DataFrame) -> DataFrame:
    """The canonical categories as a table (ord, category)."""
    rows = list(enumerate(V.CATEGORIES))
    return small_table(df.sparkSession, rows, "ord int, category string")


def visible_categories(counts: DataFrame) -> DataFrame:
    """A5: categories that have listings, in canonical order."""
    order = category_order(counts)
    return order.join(counts, "category").where("n > 0").orderBy("ord")


def selected_totals(tallies: DataFrame, categories: list[str], venues: list[str]) -> DataFrame:
    """Listings behind the selected categories and venues, and the options shown."""
    facet, name, n = F.col("facet"), F.col("name"), F.col("n")

    def total(kind: str, chosen: list[str]) -> Column:
        hit = (facet == kind) & name.isin(chosen)
        return F.coalesce(F.sum(F.when(hit, n)), F.lit(0))

    return tallies.agg(
        F.count_if((facet == "category") & name.isin(V.CATEGORIES)).alias("category_options"),
        total("category", categories).alias("category_listings"),
        F.count_if(facet == "venue").alias("venue_options"),
        total("venue", venues).alias("venue_listings"),
    )


def hero_counts(df: DataFrame, as_of) -> DataFrame:
    """Upcoming listings, those active today, and sources with upcoming ones."""
    today = moment(as_of).date()
    tomorrow = today + timedelta(days=1)
    ahead = F.col("event_date") >= ntz(today)
    starts = ahead & (F.col("event_date") < ntz(tomorrow))
    spans = (F.col("event_date") < ntz(tomorrow)) & (F.col("end_date") >= ntz(today))
    return df.agg(
        F.count_if(ahead).alias("upcoming"),
        F.count_if(starts | F.coalesce(spans, F.lit(False))).alias("active_today"),
        F.count_distinct(F.when(ahead, F.col("source"))).alias("sources"),
    )


def counts_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, largest first."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.col(column).asc_nulls_first())
