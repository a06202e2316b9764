"""Stored rollups and sessions with an end, against the exact reports."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import at
from marquee.operators import engagement as E
from marquee.operators import rollups as R
from marquee.session import job_folder
from marquee.streaming import jobs as M

MARKS = "session_id string, created_at timestamp_ntz, kind string"


def marks_of(spark, rows):
    return spark.createDataFrame(rows, MARKS)


def report(spark, path, first, last):
    return {str(r["date"]): (r["unique_visitors"], r["page_views"]) for r in R.daily_report(spark, path, first, last).collect()}


def test_a_batch_run_again_counts_once_and_late_rows_reach_their_day(spark):
    path = job_folder(spark, "days")
    first = marks_of(spark, [("a", at("2024-01-31T10:00"), "page"), ("b", at("2024-01-31T11:00"), "page"), ("a", at("2024-02-01T09:00"), "page")])
    R.merge_days(R.roll_up_days(first), path, 0)
    late = marks_of(spark, [("a", at("2024-01-31T23:00"), "page"), ("c", at("2024-02-02T09:00"), "page"), ("c", at("2024-02-02T09:01"), "click")])
    # the second batch ends after January is written
    R.merge_days(R.roll_up_days(late.where("created_at < timestamp_ntz'2024-02-01'")), path, 1)
    for _ in range(2):
        R.merge_days(R.roll_up_days(late), path, 1)
        assert report(spark, path, "2024-01-30", "2024-02-03") == {
            "2024-01-30": (0, 0), "2024-01-31": (2, 3), "2024-02-01": (1, 1), "2024-02-02": (1, 1), "2024-02-03": (0, 0)}
    total = R.period_report(spark, path, "2024-01-01", "2024-02-29").first()
    assert (total["unique_visitors"], total["page_views"], total["events_clicked"], total["click_through_rate"]) == (3, 5, 1, 0.0)
    back = R.returning_visitors(spark, path, ("2024-01-01", "2024-01-31"), ("2024-02-01", "2024-02-29")).first()
    assert tuple(back) == (2, 1, 50.0)


def test_odd_marks(spark):
    path = job_folder(spark, "days")
    R.merge_days(R.roll_up_days(marks_of(spark, [])), path, 0)  # writes nothing
    odd = [("a", None, "page"), (None, at("2024-01-01T10:00"), "page"), ("", at("2024-01-01T10:00"), "page"),
           ("", at("2024-01-01T10:00"), "page"), ("é" * 5000, at("2024-01-01T10:00"), "page"),
           ("b", at("2024-01-02T10:00"), None), ("b", at("2024-01-03T10:00"), "share")]
    R.merge_days(R.roll_up_days(marks_of(spark, odd)), path, 1)
    assert report(spark, path, "2024-01-01", "2024-01-03") == {"2024-01-01": (2, 4), "2024-01-02": (0, 0), "2024-01-03": (0, 0)}
    none = R.period_report(spark, path, "2030-01-01", "2030-02-01").first()
    assert none["unique_visitors"] == 0 and none["page_views"] == 0
    gone = R.returning_visitors(spark, path, ("2030-01-01", "2030-01-31"), ("2024-01-01", "2024-01-31")).first()
    assert tuple(gone) == (2, 0, 0.0)


def test_visitors_beyond_the_sketch_stay_within_its_error(spark):
    path = job_folder(spark, "days")
    days = [at("2024-03-01T12:00") + timedelta(days=d) for d in range(3)]
    for batch in range(2):  # each day has 60,000 visitors of either batch, half of them in both
        rows = spark.range(60_000).select(F.col("id") + 30_000 * batch).crossJoin(spark.createDataFrame([(d,) for d in days], "created_at timestamp_ntz"))
        marks = rows.select(F.concat(F.lit("s"), F.col(rows.columns[0]).cast("string")).alias("session_id"), "created_at", F.lit("page").alias("kind"))
        R.merge_days(R.roll_up_days(marks), path, batch)
    allowed = 3 / (2 ** R.LG_ENTRIES - 1) ** 0.5
    for visitors, views in report(spark, path, "2024-03-01", "2024-03-03").values():
        assert abs(visitors / 90_000 - 1) < allowed and views == 120_000
    total = R.period_report(spark, path, "2024-03-01", "2024-03-31").first()
    assert abs(total["unique_visitors"] / 90_000 - 1) < allowed


def test_a_report_of_thirty_days_reads_thirty_rows(spark, capsys):
    path = job_folder(spark, "days")
    rows = [(f"s{v}", at("2024-01-01T12:00") + timedelta(days=d), "page") for d in range(120) for v in range(5)]
    for batch in range(2):
        R.merge_days(R.roll_up_days(marks_of(spark, rows)), path, batch)
    read = R.read_days(spark, path, "2024-03-01", "2024-03-30")
    assert read.count() == 30
    R.period_report(spark, path, "2024-03-01", "2024-03-30").explain("formatted")
    plan = capsys.readouterr().out
    assert "month" in plan.split("PartitionFilters")[1].split("\n")[0] and "PushedFilters" in plan


@pytest.fixture
def three_hours(spark):
    """Marks of three hours, one file each; every hour has 40 sessions of its own and one that comes back."""
    folder = job_folder(spark, "marks")
    for hour in range(3):
        rows = [(f"h{hour}-{i}", at(f"2024-01-01T{10 + hour}:00") + timedelta(minutes=m, seconds=i), kind)
                for i in range(40) for m, kind in ((0, "page"), (3, "view"), (4, "click"), (5, "search"))]
        rows += [("back", at(f"2024-01-01T{10 + hour}:02"), "page")]
        marks_of(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_sessions_are_sent_once_and_their_state_is_freed(spark, three_hours):
    marks = spark.read.parquet(three_hours)
    stream = spark.readStream.schema(marks.schema).option("maxFilesPerTrigger", 1).parquet(three_hours)
    out = job_folder(spark, "ended")
    job = M.write_batches(M.ended_sessions(stream), f"{out}/rows", f"{out}/state", "append", once=True)
    job.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in job.recentProgress]
    assert max(states) <= 2 * 41 and states[-1] == 41  # the open sessions of the last hour, of 121 seen
    ended = spark.read.parquet(f"{out}/rows")
    assert ended.where("session_id <> 'back'").groupBy("session_id").count().where("count > 1").count() == 0
    pages, rest, asked = marks.where("kind = 'page'"), marks.where("kind in ('view', 'click')"), marks.where("kind = 'search'")
    closed = F.col("created_at") < F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    exact = E.sessions(pages.where(closed), rest.where(closed).withColumnRenamed("kind", "interaction_type"), asked.where(closed))
    columns = exact.columns
    assert sorted(M.read_ended(spark, f"{out}/rows").select(*columns).collect()) == sorted(exact.collect())
