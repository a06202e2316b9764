"""Stored daily rollups: one row a day, merged batch by batch, any period from its days.

Counts add up and visitors are kept as theta sketches, which unite: a period reads one
row a day and no log. A sketch is exact up to ``2 ** LG_ENTRIES`` distinct visitors;
beyond that its standard error is ``1 / sqrt(2 ** LG_ENTRIES - 1)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.dates import day, moment
from marquee.functions.price import pct
from marquee.session import cut_lineage, read_or_empty

AT = "created_at"
#: 16,384 visitors a day exactly, 0.8 % standard error above, at most 128 KiB a row.
LG_ENTRIES = 14
#: Partition column of a stored rollup.
MONTH = "month"
#: The newest batch that a stored day holds.
BATCH = "batch"

KINDS = {"page_views": "page", "events_viewed": "view", "events_clicked": "click",
         "searches": "search", "favorites_added": "favorite"}


def roll_up_days(marks: DataFrame, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """One row per day of the marks (session_id, created_at, kind).

    Sketches and counts are reduced before the shuffle, so a day that holds most of the
    rows moves one row a task. Marks without a stamp belong to no day; a mark without a
    session counts, but is no visitor. Days with marks of other kinds only are kept, as zeros.
    """
    kind = F.col("kind")
    # a prefix, since sketches leave empty text out
    visitor = F.when(kind == "page", F.concat(F.lit("."), F.col("session_id")))
    return marks.where(F.col(AT).isNotNull()).groupBy(F.to_date(AT).alias("date")).agg(
        F.theta_sketch_agg(visitor, lg_entries).alias("visitors"),
        *[F.count_if(kind == value).alias(name) for name, value in KINDS.items()],
    )


def roll_up_sessions(sessions: DataFrame) -> DataFrame:
    """One row per day on which sessions began. Every session may come in one batch only."""
    return sessions.where(F.col("first_seen").isNotNull()).groupBy(F.to_date("first_seen").alias("date")).agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.sum("page_views").alias("page_views"),
        F.sum("events_viewed").alias("events_viewed"),
        F.count_if(F.col("page_views") == 1).alias("bounces"),
    )


def _merged(df: DataFrame, skip: tuple[str, ...] = ()) -> list[Column]:
    """Counts add up, sketches unite."""
    return [
        (F.theta_union_agg(f.name, LG_ENTRIES) if isinstance(f.dataType, T.BinaryType) else F.sum(f.name)).alias(f.name)
        for f in df.schema.fields if f.name not in skip
    ]


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The stored days, none before the first batch."""
    schema = T.StructType([*like.schema.fields]).add(BATCH, "long").add(MONTH, "string")
    return read_or_empty(spark, path, schema)


def merge_days(fresh: DataFrame, path: str, batch: int) -> None:
    """Adds a batch to the stored days; only the months it touches are read and written.

    Batches come in rising order from one writer. Every day says which batch it holds last
    and leaves older ones out, so a batch that is run again, also after it ended between
    two months, counts once. A batch may reach back to any day.
    """
    spark = fresh.sparkSession
    held = cut_lineage(fresh)  # one row a day
    months = [r["m"] for r in held.select(F.date_format("date", "yyyy-MM").alias("m")).distinct().collect()]
    if not months:
        return
    stored = _stored(spark, path, held).where(F.col(MONTH).isin(months)).drop(MONTH)
    known = stored.where(F.col(BATCH) >= batch).select("date")
    added = held.join(known, "date", "left_anti").withColumn(BATCH, F.lit(batch).cast("bigint"))
    rows = stored.unionByName(added).groupBy("date").agg(
        F.max(BATCH).alias(BATCH), *_merged(held, ("date",))
    )
    out = cut_lineage(rows.withColumn(MONTH, F.date_format("date", "yyyy-MM")))
    out.repartition(MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)


def read_days(spark: SparkSession, path: str, first=None, last=None) -> DataFrame:
    """The stored rows of the days in [first, last]; folders of other months are not read.

    Before the first batch with a row there is no table, and Spark's error says so.
    """
    rows = spark.read.parquet(path).withColumn(MONTH, F.col(MONTH).cast("string"))
    if first is not None:
        low = moment(first).date()
        rows = rows.where((F.col(MONTH) >= low.strftime("%Y-%m")) & (F.col("date") >= day(low)))
    if last is not None:
        high = moment(last).date()
        rows = rows.where((F.col(MONTH) <= high.strftime("%Y-%m")) & (F.col("date") <= day(high)))
    return rows


def daily_report(spark: SparkSession, path: str, first, last) -> DataFrame:
    """A row for every day in [first, last], days without activity as zeros."""
    found = read_days(spark, path, first, last).withColumn("unique_visitors", F.theta_sketch_estimate("visitors"))
    spine = spark.range(1).select(F.explode(F.sequence(day(moment(first).date()), day(moment(last).date()))).alias("date"))
    return (
        spine.join(found, "date", "left")
        .select("date", *[F.coalesce(m, F.lit(0)).alias(m) for m in ("unique_visitors", *KINDS)])
        .orderBy("date")
    )


def period_report(spark: SparkSession, path: str, first, last) -> DataFrame:
    """A10: totals of a period, its visitors each counted once, and its click-through rate."""
    totals = read_days(spark, path, first, last).agg(
        F.coalesce(F.theta_sketch_estimate(F.theta_union_agg("visitors", LG_ENTRIES)), F.lit(0)).alias("unique_visitors"),
        *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in KINDS],
    )
    return totals.withColumn("click_through_rate", pct("events_clicked", "events_viewed", 1))


def returning_visitors(spark: SparkSession, path: str, before: tuple, after: tuple) -> DataFrame:
    """Visitors of one period that were there in an earlier one too, and their share."""
    def visitors(period: tuple, name: str) -> DataFrame:
        return read_days(spark, path, *period).agg(F.theta_union_agg("visitors", LG_ENTRIES).alias(name)).withColumn("one", F.lit(1))

    both = visitors(before, "a").join(visitors(after, "b"), "one")
    counted = both.select(
        F.theta_sketch_estimate("b").alias("visitors"),
        F.theta_sketch_estimate(F.theta_intersection("a", "b")).alias("returning"),
    ).select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("visitors", "returning")])
    return counted.withColumn("returning_share", pct("returning", "visitors", 2))


def session_report(spark: SparkSession, path: str, first, last=None) -> DataFrame:
    """Sessions that began in the period, their averages and bounce rate."""
    sums = read_days(spark, path, first, last).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_sessions", "page_views", "events_viewed", "bounces")]
    )
    def mean(c: str) -> Column:
        return F.coalesce(F.round(F.try_divide(F.col(c), F.col("total_sessions")), 2), F.lit(0.0))

    return sums.select(
        "total_sessions", mean("page_views").alias("avg_page_views"), mean("events_viewed").alias("avg_events_viewed"),
        pct("bounces", "total_sessions", 2).alias("bounce_rate"),
    )
