"""Audits, health and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import dates as D

FINDINGS = ["anchored_to_scrape_date", "far_future", "weekday_mismatch"]


def ahead(df: DataFrame, as_of) -> DataFrame:
    """Rows the audit looks at: starting today or later."""
    return df.where(F.col("event_date") >= D.ntz(D.moment(as_of).date()))


def audit_weekday(df: DataFrame) -> DataFrame:
    """Q1: the listing binds itself to another weekday than its date."""
    bound = D.binding_weekday("title", "description")
    return df.where(bound != F.weekday("event_date"))


def audit_far_future(df: DataFrame, as_of, days: int = 400) -> DataFrame:
    """Q2: more than so many whole days ahead."""
    return df.where(F.floor(D.seconds_between("event_date", D.ntz(as_of)) / 86400) > days)


def repeat_anchored(df: DataFrame, min_days: int = 3) -> DataFrame:
    """Rows dated on their write day, where that happened on several days."""
    day = F.to_date("event_date")
    anchored = df.where(day == F.to_date("updated_at"))
    repeated = (
        anchored.groupBy("source", "title")
        .agg(F.count_distinct(day).alias("days"))
        .where(F.col("days") >= min_days)
    )
    return anchored.join(repeated.select("source", "title"), ["source", "title"], "left_semi")


def audit_findings(df: DataFrame, as_of) -> DataFrame:
    """Q1-Q3 together: one row (id, source, finding) per suspicion."""
    rows = ahead(df, as_of)
    found = [
        (audit_weekday(rows), "weekday_mismatch"),
        (audit_far_future(rows, as_of), "far_future"),
        (repeat_anchored(rows), "anchored_to_scrape_date"),
    ]
    parts = [r.select("id", "source", F.lit(name).alias("finding")) for r, name in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def audit_counts(findings: DataFrame) -> DataFrame:
    """Findings per source, most suspicious source first."""
    counts = findings.groupBy("source").agg(
        *[F.count_if(F.col("finding") == f).alias(f) for f in FINDINGS],
        F.count(F.lit(1)).alias("total"),
    )
    return counts.orderBy(F.desc("total"), "source")


def table_health(df: DataFrame, as_of, max_age_h: float = 48) -> DataFrame:
    """Size, latest change, its age and a status."""
    found = df.agg(F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("latest"))
    age = D.seconds_between(D.ntz(as_of), "latest") / 3600.0
    status = (
        F.when(F.col("n") == 0, "error")
        .when(F.col("age_hours") > max_age_h, "warning")
        .otherwise("healthy")
    )
    return found.withColumn("age_hours", F.round(age, 2)).withColumn("status", status)


def source_outcomes(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per source: scraped, saved as new, skipped as duplicates, ok.

    ``outcomes`` has one row (source, was_duplicate) per scraped listing.
    """
    counts = outcomes.groupBy("source").agg(
        F.count_if(~F.col("was_duplicate")).alias("saved"),
        F.count_if(F.col("was_duplicate")).alias("skipped"),
    )
    zero = F.lit(0)
    return runs.join(counts, "source", "left").select(
        "source", "ok", "scraped",
        F.coalesce("saved", zero).alias("saved"), F.coalesce("skipped", zero).alias("skipped"),
    )


def run_summary(runs: DataFrame) -> DataFrame:
    """One row about a whole run."""
    ok, order = F.col("ok"), F.struct("duration_s", "source")
    total_s = F.sum("duration_s")
    return runs.agg(
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        F.sum("scraped").alias("scraped"),
        F.round(total_s, 2).alias("total_s"),
        F.round(F.avg("duration_s"), 2).alias("avg_s"),
        F.when(total_s > 0, F.round(F.sum("scraped") / total_s, 1)).alias("rows_per_s"),
        F.min_by("source", F.when(ok, order)).alias("fastest"),
        F.max_by("source", F.when(ok, order)).alias("slowest"),
    )


def clock_skew(nodes: DataFrame) -> DataFrame:
    """Per page, the clock error most nodes agree on.

    ``nodes`` has (page, wall, local_min): the stamped wall clock and the
    minute of the day the schedule states; rows without either do not vote.
    mode is 'stated' without votes, 'utc' or minutes ahead when more than half
    agree, else NULL.
    """
    seen = F.hour("wall") * 60 + F.minute("wall")
    skew = F.pmod(seen - F.col("local_min") + 720, F.lit(1440)) - 720
    as_utc = D.utc_to_local("wall")
    is_utc = (skew != 0) & (F.hour(as_utc) * 60 + F.minute(as_utc) == F.col("local_min"))
    vote = F.when(is_utc, F.lit("utc")).otherwise(skew.cast("string"))
    votes = nodes.select("page", vote.alias("vote")).groupBy("page", "vote").agg(
        F.count("vote").alias("n")
    )
    best = votes.groupBy("page").agg(
        F.sum("n").alias("total"), F.max_by("vote", F.struct("n", "vote")).alias("winner"),
        F.max("n").alias("top"),
    )
    clear = (F.col("top") * 2 > F.col("total")) & (F.col("winner") != "0")
    mode: Column = F.when(F.col("total") == 0, F.lit("stated")).when(clear, F.col("winner"))
    return best.select("page", mode.alias("mode"))
