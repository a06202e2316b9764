"""Listings as they were: versions written by every change, and facts as of a moment.

A version says what holds from a moment on: the facts of a listing, or that it is
gone. A click then takes the version that held when it happened, by one ordered pass
over versions and clicks in place of a range join. The pass runs in blocks of time, so
a listing with a large share of all clicks is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import dates as D
from marquee.operators.windows import carry_forward

#: Facts of a listing that reports group by.
FACTS = ["source", "category"]
MONTH, DAYS = "valid_month", 86400


def opened(listings: DataFrame, since: Column) -> DataFrame:
    """(event_id, valid_from, gone, facts...): the first version of rows that are new in the table."""
    return listings.select(
        F.col("id").alias("event_id"), since.cast("timestamp_ntz").alias("valid_from"),
        F.lit(False).alias("gone"), *FACTS)


def changed(before: DataFrame, after: DataFrame, as_of) -> DataFrame:
    """Versions that a change of the table makes (K1 to K4, E5): new rows, rows with other facts, rows gone.

    Rows alike in their facts give no version, so a report's facts change only when
    they do. Ids that are null are no listing and give none.
    """
    old = before.select(F.col("id").alias("event_id"), F.struct(*FACTS).alias("old"))
    new = after.select(F.col("id").alias("event_id"), F.struct(*FACTS).alias("new"))
    both = old.join(new, "event_id", "full").where("event_id is not null and not old <=> new")
    return both.select(
        "event_id", D.ntz(as_of).alias("valid_from"), F.col("new").isNull().alias("gone"),
        *[F.col(f"new.{c}").alias(c) for c in FACTS])


def append_versions(versions: DataFrame, path: str) -> None:
    """Stores versions, one folder per month from which they hold."""
    months = versions.withColumn(MONTH, F.coalesce(F.date_format("valid_from", "yyyy-MM"), F.lit("none")))
    months.write.mode("append").partitionBy(MONTH).parquet(path)


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """All stored versions."""
    return spark.read.parquet(path).drop(MONTH)


def facts_at(interactions: DataFrame, versions: DataFrame, block_days: int = 30) -> DataFrame:
    """Every interaction with source and category of its listing at that moment.

    Interactions with a listing that is gone by then, was not there yet or is unknown
    stay, with nulls, as do those without a moment or a listing. Of versions from one
    moment the one that sorts last holds; a version from the very moment of the click holds.
    """
    held = versions.where("event_id is not null and valid_from is not null").groupBy("event_id", "valid_from").agg(
        F.max(F.struct("gone", *FACTS)).alias("version"))
    bare = interactions.drop(*FACTS)
    dated = F.col("event_id").isNotNull() & F.col("created_at").isNotNull()
    row = F.struct(*[F.col(f"`{c}`") for c in bare.columns])
    clicks = bare.where(dated).select("event_id", D.micros("created_at").alias("at"), row.alias("click"))
    # versions and clicks of one moment are peers; listings without clicks need no pass
    clicked = clicks.select("event_id").distinct()
    marks = held.join(clicked, "event_id", "left_semi").select("event_id", D.micros("valid_from").alias("at"), "version")
    line = clicks.unionByName(marks, allowMissingColumns=True)
    known = carry_forward(line, ["event_id"], "at", "version", "seen", block=block_days * DAYS * 1_000_000)
    live = F.when(~F.col("seen.gone"), F.col("seen"))
    found = known.where("click is not null").select("click.*", *[live[c].alias(c) for c in FACTS])
    kinds = {f.name: f.dataType for f in versions.schema.fields}
    rest = bare.where(~dated).select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in FACTS])
    return found.unionByName(rest)
