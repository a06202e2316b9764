"""Stored tables: months that empty, changes run twice, phrases read from the folders of their words."""

from pyspark.sql import functions as F

from conftest import at
from marquee.operators import listings as L
from marquee.operators import phrases as P
from marquee.session import job_folder

NOW = at("2026-02-01T00:00")


def test_an_emptied_month_keeps_no_rows(spark, make_listings):
    path = job_folder(spark, "listings")
    L.append_listings(make_listings([{"id": 1, "event_date": at("2026-01-05T20:00")}, {"id": 2, "event_date": at("2026-03-05T20:00")}]), path)
    change = spark.createDataFrame([(1, "2026-01", at("2026-03-09T20:00"))], "id bigint, event_month string, event_date timestamp_ntz")
    for _ in range(2):  # the second run finds the row moved already
        L.update_months(change, path, NOW)
        rows = L.read_listings(spark, path).orderBy("id").collect()
        assert [(r["id"], r["event_month"]) for r in rows] == [(1, "2026-03"), (2, "2026-03")]
    L.delete_months(spark.createDataFrame([(1, "2026-03"), (2, "2026-03")], "id bigint, event_month string"), path)
    assert L.read_listings(spark, path).count() == 0


def test_a_change_that_ended_between_its_writes_is_healed(spark, make_listings):
    path = job_folder(spark, "listings")
    row = {"id": 1, "title": "a", "event_date": at("2026-01-05T20:00")}
    L.append_listings(make_listings([row]), path)
    L.append_listings(make_listings([{**row, "event_date": at("2026-03-09T20:00")}]), path)  # written, old place not emptied yet
    change = spark.createDataFrame([(1, "2026-01", at("2026-03-09T20:00"))], "id bigint, event_month string, event_date timestamp_ntz")
    L.update_months(change, path, NOW)
    assert [(r["id"], r["event_month"]) for r in L.read_listings(spark, path).collect()] == [(1, "2026-03")]


def test_stored_phrases_follow_the_table(spark, make_listings):
    path = job_folder(spark, "phrases")
    rows = make_listings([{"id": 1, "title": "Wine tasting"}, {"id": 2, "title": "Tasting wine"}, {"id": 3, "description": "A wine TASTING!"}])
    P.index_rows(rows, path, 1)
    P.forget_rows(rows.where("id = 9"), path, 1)

    def found(q):
        return sorted(r["id"] for r in P.stored_phrase_ids(spark, path, q).collect())

    assert found("wine tasting") == [1, 3] and found("") == [] and found("beer") == []
    P.reindex_rows(rows.where("id = 2").withColumn("title", F.lit("Wine tasting")), path, 2)
    P.forget_rows(rows.where("id = 1"), path, 3)
    assert found("wine tasting") == [2, 3] and found("tasting wine") == []
    P.index_rows(rows.where("id = 1"), path, 4)
    assert found("Wine tasting") == [1, 2, 3]


def test_a_phrase_reads_the_folders_of_its_words(spark, make_listings, capsys):
    path = job_folder(spark, "phrases")
    P.index_rows(make_listings([{"id": i, "title": f"word{i} wine tasting"} for i in range(200)]), path, 1)
    P.forget_rows(make_listings([]), path, 1)
    P.stored_postings(spark, path, "wine tasting").explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("\n")[0]
