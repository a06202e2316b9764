"""Every registered query with oracle SQL against it, on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare_with_oracle import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(n for n in oracle_sql() if not n.startswith(("op", "pipeline")))


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, oracle, name):
    df = queries()[name](spark, FOLDER)
    cursor = oracle.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())


def test_entry_runs(spark):
    assert entry(spark).count() > 0


def test_search_filters_reach_the_scan(spark):
    plan = queries()["f11_free_flag"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in plan


def test_first_rows_are_cut_before_the_shuffle(spark):
    plan = queries()["w7_cap_per_group"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_calendar_filters_prune_months(spark):
    from marquee.operators import listings as L
    from marquee.operators import search
    from marquee.plans.views import AS_OF, Tables
    from marquee.session import job_folder

    path = job_folder(spark, "pruned")
    L.append_listings(Tables(spark, FOLDER).listings, path)
    stored = L.read_listings(spark, path)
    for found in (search.search(stored, date_filter="this_month", as_of=AS_OF), search.upcoming(stored, AS_OF),
                  search.date_range(stored, "1998-06-01", "1998-06-09"), search.in_calendar_window(stored, "next_month", AS_OF)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(event_month" in plan


def test_rss_files_hold_bounded_payloads(spark):
    """No written line holds the items of a whole source."""
    import glob

    from marquee.plans.feed_plans import PER_PAYLOAD
    from marquee.session import job_folder

    above = job_folder(spark, "rss").removeprefix("file:").rsplit("/", 1)[0]
    before = set(glob.glob(f"{above}/**/*.txt", recursive=True))
    queries()["s10_read_rss"](spark, "/root/testdata/sf0.01")
    new = set(glob.glob(f"{above}/**/*.txt", recursive=True)) - before
    lines = [line for path in new for line in open(path)]
    assert lines and max(line.count("<item ") for line in lines) <= PER_PAYLOAD


def test_rss_files_hold_many_parts(spark, make_listings):
    """A part of a source is a line of its own, but no file of its own; no item is lost between the lines."""
    import glob
    from datetime import datetime
    from types import SimpleNamespace

    from marquee.plans import load_plans
    from marquee.plans.feed_plans import PER_PAYLOAD
    from marquee.session import job_folder

    above = job_folder(spark, "rss").removeprefix("file:").rsplit("/", 1)[0]
    before = set(glob.glob(f"{above}/**/*.txt", recursive=True))
    rows = [{"id": i, "source": "ab"[i % 2], "event_date": datetime(1998, 6, 20, 20)} for i in range(0, 12_000, 7)]
    found = load_plans().PLANS["s10_read_rss"](SimpleNamespace(spark=spark, listings=make_listings(rows)))
    assert sorted(r.title for r in found.collect()) == sorted(f"T {r['id']}" for r in rows if r["id"] % 5 != 3)
    new = set(glob.glob(f"{above}/**/*.txt", recursive=True)) - before
    lines = [line for path in new for line in open(path)]
    assert len(new) == 2 and len(lines) == 2 * 60 and max(line.count("<item ") for line in lines) <= PER_PAYLOAD
