"""Reports on the stored cube against those on the listings."""

import pytest
from pyspark.sql import functions as F

from conftest import at
from marquee.operators import facet_cube as K
from marquee.operators import facets as A
from marquee.operators import listings as L
from marquee.session import job_folder

NOW = at("2026-01-30T15:00")


@pytest.fixture
def stored(spark, make_listings):
    rows = []
    for i in range(240):
        start = [None, at("2026-01-30T09:00"), at("2026-01-31T23:59"), at("2026-02-03T00:00"), at("2025-12-20T10:00"), at("2026-01-01T20:00")][i % 6]
        end = [None, at("2026-01-30T23:00"), at("2026-02-01T00:00"), at("2026-03-01T10:00")][i % 4]
        rows.append({"id": i, "event_date": start, "end_date": end, "category": [None, "Music", "Art"][i % 3 if i % 5 else 0],
                     "source": ["a", "b", "c", "d"][i % 4] , "venue_name": ["", "Hall", "Club", None][i // 3 % 4],
                     "is_free": [True, False, None][i % 7 % 3], "region": [None, "westside", "beyond"][i % 11 % 3],
                     "latitude": [None, 34.0, 35.0][i % 13 % 3], "longitude": [None, -118.5][i % 2]})
    path = job_folder(spark, "listings")
    L.append_listings(make_listings(rows), path)
    return path


def same(cube, listings, **filters):
    got, want = K.cube_tallies(cube, listings, NOW, **filters), A.filter_tallies(listings, NOW, **filters)
    key = lambda r: tuple(map(str, r))
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key), filters


def test_cube_equals_listings_and_follows_them(spark, stored):
    path = job_folder(spark, "cube")
    K.refresh_cube(spark, stored, path)
    cube, listings = K.read_cube(spark, path), L.read_listings(spark, stored).drop(L.MONTH)
    for kind in ("upcoming", "today", "tomorrow", "today_tomorrow", "this_week", "this_weekend", "this_month"):
        same(cube, listings, date_filter=kind, min_venue_count=1)
    same(cube, listings, date_filter="specific_date", specific_date="2026-02-03", bbox=None, region="westside")
    same(cube, listings, categories=["Music"], sources=["a", "b"], free_only=True, region="beyond", min_venue_count=1)
    same(cube, listings, bbox=(33.0, 34.5, -119.0, -118.0), min_venue_count=1)
    assert K.cube_hero_counts(cube, NOW).first() == A.hero_counts(listings, NOW).first()

    gone = L.read_listings(spark, stored).where("event_month = '2026-02'").select("id", L.MONTH)
    L.delete_months(gone, stored)
    for _ in range(2):
        K.refresh_cube(spark, stored, path, ["2026-02"])
    listings = L.read_listings(spark, stored).drop(L.MONTH)
    cube = K.read_cube(spark, path)
    assert cube.where("event_month = '2026-02'").count() == 0 and cube.agg(F.sum("n")).first()[0] == listings.count() == 200
    same(cube, listings, min_venue_count=1)


def test_a_window_reads_its_months(spark, stored, capsys):
    path = job_folder(spark, "cube")
    K.refresh_cube(spark, stored, path)
    K.cube_tallies(K.read_cube(spark, path), None, NOW, date_filter="this_month").explain("formatted")
    assert "event_month" in capsys.readouterr().out.split("PartitionFilters")[1].split("\n")[0]
