"""Engagement logs and feeds as streams.

A stream of aggregates is written as one folder per micro-batch, overwritten on
replay, and reduced when read: minima, maxima and running counters merge in any
order, so repeated or late batches do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from marquee.functions import dates as D
from marquee.operators import rollups as R

AT = "created_at"


def with_event_time(df: DataFrame, delay: str = "10 minutes", at: str = AT) -> DataFrame:
    """M7: rows count by their own stamp (naive UTC) and may be late by so much."""
    return df.withColumn(at, D.as_instant(at)).withWatermark(at, delay)


def ingest(
    stream: DataFrame, path: str, checkpoint: str, interval: str = "10 seconds", once: bool = False
) -> StreamingQuery:
    """M1: append a stream to a table, one commit per interval."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start(path)


def write_batches(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "update",
    interval: str = "10 seconds", once: bool = False,
) -> StreamingQuery:
    """M1: every micro-batch of an aggregate into its own folder, so a replay overwrites."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(save)
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Rows of the newest batch per key."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return latest.select(*keys, "v.*")


def session_marks(page_views: DataFrame, interactions: DataFrame, searches: DataFrame) -> DataFrame:
    """The three logs as (session_id, created_at, kind)."""
    def marks(df: DataFrame, kind: Column) -> DataFrame:
        return df.select("session_id", AT, kind.alias("kind"))

    return (
        marks(page_views, F.lit("page"))
        .unionByName(marks(interactions, F.col("interaction_type")))
        .unionByName(marks(searches, F.lit("search")))
    )


def _session_counts() -> list[Column]:
    kind = F.col("kind")
    return [
        F.min(AT).alias("first_seen"),
        F.max(AT).alias("last_seen"),
        F.count_if(kind == "page").alias("page_views"),
        F.count_if(kind == "view").alias("events_viewed"),
        F.count_if(kind == "click").alias("events_clicked"),
        F.count_if(kind == "search").alias("searches"),
    ]


def session_stream(marks: DataFrame) -> DataFrame:
    """M2: session table as running state; stamps only widen, whatever the order.

    The state of every session is kept; ``ended_sessions`` lets it go.
    """
    return marks.groupBy("session_id").agg(*_session_counts())


def ended_sessions(marks: DataFrame, pause: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """M2: each session once, in append mode, when it has been silent for ``pause``.

    Its state is freed with that, so state holds open sessions only. An id that comes back
    after the pause gives a further row; ``read_ended`` adds them up. Marks later than
    ``delay`` that belong to no open session are dropped and counted by the query's progress.
    """
    ended = with_event_time(marks, delay).groupBy("session_id", F.session_window(AT, pause).alias("w"))
    rows = ended.agg(*_session_counts()).drop("w")
    for stamp in ("first_seen", "last_seen"):
        rows = rows.withColumn(stamp, D.as_naive(stamp))
    return rows


def read_ended(spark: SparkSession, path: str) -> DataFrame:
    """One row per session id from the ended sessions."""
    counters = ["page_views", "events_viewed", "events_clicked", "searches"]
    return spark.read.parquet(path).groupBy("session_id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        *[F.sum(c).alias(c) for c in counters],
    )


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """M2: the session table from the written batches."""
    counters = ["page_views", "events_viewed", "events_clicked", "searches"]
    return spark.read.parquet(path).groupBy("session_id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        *[F.max(c).alias(c) for c in counters],
    )


def parse_log(raw: DataFrame, schema: StructType, text: str = "value") -> DataFrame:
    """M3: JSON log lines; a line that does not parse keeps its text in _corrupt."""
    wide = StructType([*schema.fields]).add("_corrupt", "string")
    parsed = F.from_json(
        F.col(text), wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    return raw.select(parsed.alias("p")).select("p.*")


def split_valid(parsed: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """M3: (valid rows, quarantined rows); one bad row never holds back its batch."""
    bad = F.col("_corrupt").isNotNull()
    for name in required:
        bad = bad | F.col(name).isNull()
    return parsed.where(~bad).drop("_corrupt"), parsed.where(bad)


def ingest_valid(
    parsed: DataFrame, required: list[str], path: str, quarantine: str, checkpoint: str,
    interval: str = "10 seconds", once: bool = False,
) -> StreamingQuery:
    """M1, M3: valid rows to one table, bad rows to another, in the same micro-batch."""

    def save(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_valid(batch, required)
        good.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")

    writer = parsed.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def daily_stream(marks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """M4: daily metrics; visitors are approximate, since streams keep no exact distinct state."""
    kind = F.col("kind")
    visitor = F.when(kind == "page", F.col("session_id"))
    days = with_event_time(marks, delay).groupBy(F.window(AT, "1 day").alias("w")).agg(
        F.approx_count_distinct(visitor, 0.01).alias("unique_visitors"),
        F.count_if(kind == "page").alias("page_views"),
        F.count_if(kind == "view").alias("events_viewed"),
        F.count_if(kind == "click").alias("events_clicked"),
        F.count_if(kind == "search").alias("searches"),
        F.count_if(kind == "favorite").alias("favorites_added"),
    )
    return days.select(F.to_date(D.as_naive("w.start")).alias("date"), *[c for c in days.columns if c != "w"])


def write_rollup(
    marks: DataFrame, path: str, checkpoint: str, interval: str = "1 minute", once: bool = False
) -> StreamingQuery:
    """Every micro-batch into the stored daily rollup; no state, late rows reach their day.

    A replayed batch counts once (``rollups.merge_days``). A checkpoint belongs to one path.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        R.merge_days(R.roll_up_days(batch), path, batch_id)

    writer = marks.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def popularity_stream(interactions: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """M5: views and clicks of each listing over seven days, moving by one."""
    kind = F.col("interaction_type")
    counted = with_event_time(interactions, delay).groupBy(
        F.window(AT, "7 days", "1 day").alias("w"), "event_id"
    ).agg(F.count_if(kind == "view").alias("views"), F.count_if(kind == "click").alias("clicks"))
    return counted.select(
        D.as_naive("w.start").alias("from"), D.as_naive("w.end").alias("to"), "event_id", "views", "clicks"
    )


def session_windows(
    page_views: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes"
) -> DataFrame:
    """M6: visits, closed by a pause."""
    visits = with_event_time(page_views, delay).groupBy(
        "session_id", F.session_window(AT, gap).alias("w")
    ).agg(F.count(F.lit(1)).alias("page_views"))
    return visits.select(
        "session_id", D.as_naive("w.start").alias("from"), D.as_naive("w.end").alias("to"), "page_views"
    )


def dedup_stream(
    feed: DataFrame, keys: list[str], at: str, delay: str = "1 day"
) -> DataFrame:
    """M8: the first row per key; a key is remembered for the watermark delay."""
    unique = with_event_time(feed, delay, at).dropDuplicatesWithinWatermark(keys)
    return unique.withColumn(at, D.as_naive(at))


def interaction_counts(interactions: DataFrame) -> DataFrame:
    """M9: running count per interaction type."""
    return interactions.groupBy("interaction_type").agg(F.count(F.lit(1)).alias("n"))


def enrich_stream(interactions: DataFrame, listings: DataFrame) -> DataFrame:
    """Each interaction takes source and category of its listing, a static table."""
    facts = listings.select(F.col("id").alias("event_id"), "source", "category")
    return interactions.drop("source", "category").join(facts, "event_id")
