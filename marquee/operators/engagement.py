"""Engagement reports over the three visitor logs."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.dates import day, moment, ntz, seconds_between
from marquee.functions.price import pct
from marquee.functions.text import truncate_hard

AT = "created_at"


def since(days: int, as_of) -> Column:
    """Rows of the last so many days, whole days counted."""
    return F.col(AT) >= ntz(moment(as_of).date() - timedelta(days=days))


def _typed(*kinds: str) -> Column:
    return F.col("interaction_type").isin(*kinds)


def daily_metrics(page_views: DataFrame, interactions: DataFrame, searches: DataFrame) -> DataFrame:
    """One row per day that has any activity.

    The logs are stacked and reduced once: first to one row per
    (day, session), so distinct visitors cost no second pass and a day that
    holds most of the rows is already small when it is shuffled by day.
    """
    def stacked(df: DataFrame, kind: Column) -> DataFrame:
        return df.select(F.to_date(AT).alias("date"), "session_id", kind.alias("kind"))

    log = (
        stacked(page_views, F.lit("page"))
        .unionByName(stacked(interactions.where(_typed("view", "click", "favorite")),
                             F.col("interaction_type")))
        .unionByName(stacked(searches, F.lit("search")))
    )
    kinds = {"page_views": "page", "events_viewed": "view", "events_clicked": "click",
             "searches": "search", "favorites_added": "favorite"}
    per_session = log.groupBy("date", "session_id").agg(
        *[F.count_if(F.col("kind") == kind).alias(name) for name, kind in kinds.items()]
    )
    return per_session.groupBy("date").agg(
        F.count_if(F.col("page_views") > 0).alias("unique_visitors"),
        *[F.sum(name).alias(name) for name in kinds],
    )


METRICS = ["unique_visitors", "page_views", "events_viewed", "events_clicked", "searches",
           "favorites_added"]


def metrics_on(page_views, interactions, searches, on) -> DataFrame:
    """The metrics of one day, zeros when nothing happened."""
    return daily_range(page_views, interactions, searches, on, on)


def daily_range(page_views, interactions, searches, first, last) -> DataFrame:
    """A row for every day in [first, last], days without activity as zeros."""
    low, high = moment(first).date(), moment(last).date()
    inside = (F.col(AT) >= ntz(low)) & (F.col(AT) < ntz(high + timedelta(days=1)))
    found = daily_metrics(
        page_views.where(inside), interactions.where(inside), searches.where(inside)
    )
    spine = page_views.sparkSession.range(1).select(
        F.explode(F.sequence(day(low), day(high))).alias("date")
    )
    return (
        spine.join(found, "date", "left")
        .select("date", *[F.coalesce(m, F.lit(0)).alias(m) for m in METRICS])
        .orderBy("date")
    )


def period_summary(daily: DataFrame) -> DataFrame:
    """A10: totals of a range and its click-through rate."""
    totals = daily.agg(*[F.sum(m).alias(m) for m in METRICS])
    return totals.withColumn("click_through_rate", pct("events_clicked", "events_viewed", 1))


def listing_engagement(interactions: DataFrame, days: int, as_of) -> DataFrame:
    """Views and clicks of each listing."""
    return interactions.where(since(days, as_of)).groupBy("event_id").agg(
        F.count_if(_typed("view")).alias("views"), F.count_if(_typed("click")).alias("clicks")
    )


def top_k(df: DataFrame, keys: list[Column], k: int) -> DataFrame:
    """O2: first k rows by the given order."""
    return df.orderBy(*keys).limit(k)


def popular_listings(interactions, listings, as_of, k: int = 10, days: int = 7) -> DataFrame:
    """Top k by views, then clicks; listings since deleted shorten the list."""
    engaged = listing_engagement(interactions, days, as_of)
    top = top_k(engaged, [F.desc("views"), F.desc("clicks"), F.asc("event_id")], k)
    titles = listings.select(F.col("id").alias("event_id"), "title")
    return (
        top.join(titles, "event_id")
        .select("event_id", truncate_hard("title", 50).alias("title"), "views", "clicks",
                pct("clicks", "views", 1).alias("click_rate"))
        .orderBy(F.desc("views"), F.desc("clicks"), "event_id")
    )


def popular_searches(searches: DataFrame, as_of, k: int = 10, days: int = 7) -> DataFrame:
    """Most frequent non-empty queries."""
    asked = searches.where(since(days, as_of) & (F.col("query") != ""))
    counts = asked.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, [F.desc("n"), F.asc("query")], k)


def category_popularity(interactions: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Views and clicks per category."""
    kept = interactions.where(
        since(days, as_of) & F.col("category").isNotNull() & _typed("view", "click")
    )
    counts = kept.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "category")


def source_performance(interactions: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Interactions per source with click-through rate."""
    kept = interactions.where(since(days, as_of) & F.col("source").isNotNull())
    return (
        kept.groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("total_interactions"),
            F.count_if(_typed("view")).alias("views"),
            F.count_if(_typed("click")).alias("clicks"),
            F.count_if(_typed("favorite")).alias("favorites"),
        )
        .withColumn("click_through_rate", pct("clicks", "views", 2))
        .orderBy(F.desc("total_interactions"), "source")
    )


def sessions(page_views: DataFrame, interactions: DataFrame, searches: DataFrame) -> DataFrame:
    """One row per session: first and last seen and four counters."""
    def marks(df: DataFrame, kind: Column) -> DataFrame:
        return df.select("session_id", AT, kind.alias("kind"))

    log = (
        marks(page_views, F.lit("page"))
        .unionByName(marks(interactions, F.col("interaction_type")))
        .unionByName(marks(searches, F.lit("search")))
    )
    kind = F.col("kind")
    return log.groupBy("session_id").agg(
        F.min(AT).alias("first_seen"),
        F.max(AT).alias("last_seen"),
        F.count_if(kind == "page").alias("page_views"),
        F.count_if(kind == "view").alias("events_viewed"),
        F.count_if(kind == "click").alias("events_clicked"),
        F.count_if(kind == "search").alias("searches"),
    )


def session_stats(sessions_: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Sessions that began in the period, their averages and bounce rate."""
    first = ntz(moment(as_of).date() - timedelta(days=days))
    kept = sessions_.where(F.col("first_seen") >= first)
    none = F.lit(0.0)
    return kept.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.coalesce(F.round(F.avg("page_views"), 2), none).alias("avg_page_views"),
        F.coalesce(F.round(F.avg("events_viewed"), 2), none).alias("avg_events_viewed"),
        pct(F.count_if(F.col("page_views") == 1), F.count(F.lit(1)), 2).alias("bounce_rate"),
    )


def filter_usage(searches: DataFrame) -> DataFrame:
    """How often each search filter was used, as (filter, value, n).

    ``categories`` and ``sources`` are comma-joined text.
    """
    def tagged(name: str, values: Column) -> Column:
        return F.transform(
            values, lambda v: F.struct(F.lit(name).alias("filter"), v.alias("value"))
        )

    def listed(name: str) -> Column:
        return F.split(F.nullif(name, F.lit("")), ",")

    used = F.array_compact(
        F.concat(
            tagged("date_filter", F.array(F.col("date_filter"))),
            F.coalesce(tagged("category", listed("categories")), F.array()),
            F.coalesce(tagged("source", listed("sources")), F.array()),
            tagged("free_only", F.array(F.col("free_only").cast("string"))),
        )
    )
    pairs = searches.select(F.explode(used).alias("u")).select("u.filter", "u.value")
    return (
        pairs.where(F.col("value").isNotNull())
        .groupBy("filter", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("filter", F.desc("n"), "value")
    )


def session_extras(sessions_: DataFrame) -> DataFrame:
    """Mean session length and the share seen on more than one day."""
    length = seconds_between("last_seen", "first_seen")
    returning = F.to_date("last_seen") > F.to_date("first_seen")
    return sessions_.agg(
        F.round(F.avg(length), 2).alias("avg_seconds"),
        pct(F.count_if(returning), F.count(F.lit(1)), 2).alias("returning_share"),
    )


def category_trend(interactions: DataFrame) -> DataFrame:
    """Views and clicks per day and category."""
    kept = interactions.where(F.col("category").isNotNull() & _typed("view", "click"))
    return kept.groupBy(F.to_date(AT).alias("date"), "category").agg(
        F.count(F.lit(1)).alias("n")
    )


def enrich_interactions(interactions: DataFrame, listings: DataFrame) -> DataFrame:
    """Each interaction takes source and category of its listing."""
    facts = listings.select(F.col("id").alias("event_id"), "source", "category")
    return interactions.drop("source", "category").join(facts, "event_id")


def favourites(log: DataFrame) -> DataFrame:
    """U4: (session, listing) pairs whose latest action is favourite."""
    acts = log.where(_typed("favorite", "unfavorite"))
    latest = acts.groupBy("session_id", "event_id").agg(
        F.max_by("interaction_type", F.struct(AT, "id")).alias("last_action")
    )
    return latest.where(F.col("last_action") == "favorite").select("session_id", "event_id")


def favourite_sets(log: DataFrame) -> DataFrame:
    """U4: the favourites of each session as one sorted array."""
    return favourites(log).groupBy("session_id").agg(
        F.array_sort(F.collect_set("event_id")).alias("favourites")
    )


def favourite_only(listings: DataFrame, log: DataFrame, session_id: str) -> DataFrame:
    """U4: listings one session keeps as favourites."""
    kept = favourites(log.where(F.col("session_id") == session_id))
    return listings.join(kept.select(F.col("event_id").alias("id")), "id", "left_semi")


def retain(df: DataFrame, days: int, as_of, at: str = AT) -> DataFrame:
    """Rows not older than so many days."""
    return df.where(F.col(at) >= ntz(moment(as_of) - timedelta(days=days)))
