"""Recurrence, dates, streams, publishing and blocks on micro-tables."""

from datetime import date, datetime, timedelta

import pytest
from dateutil.rrule import rrulestr
from pyspark.sql import functions as F

from marquee import schemas
from marquee.functions import dates as D
from marquee.operators import build as B
from marquee.operators import listings as L
from marquee.operators import recurrence as R
from marquee.operators import search as S
from marquee.operators import windows as W
from marquee.session import job_folder
from marquee.sources import feeds
from marquee.sources.registry import IcsDataSource, run_source, source
from marquee.streaming import jobs

RULES = [
    "FREQ=DAILY;INTERVAL=2;COUNT=7", "FREQ=WEEKLY;BYDAY=MO,WE,FR", "FREQ=WEEKLY;INTERVAL=3",
    "FREQ=MONTHLY;BYDAY=2TU", "FREQ=MONTHLY;BYDAY=-1FR;COUNT=3", "FREQ=MONTHLY", "FREQ=MONTHLY;BYMONTHDAY=15",
    "FREQ=YEARLY", "FREQ=WEEKLY;UNTIL=20260701T000000", "FREQ=DAILY;BYDAY=SA,SU",
    "FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1", "FREQ=MONTHLY;BYDAY=FR;BYMONTHDAY=13", "FREQ=WEEKLY;BYMONTH=6,7",
    "FREQ=MONTHLY;BYMONTHDAY=-1", "FREQ=MONTHLY;BYMONTHDAY=31,-31;INTERVAL=2", "FREQ=YEARLY;BYMONTH=11;BYDAY=4TH", "FREQ=YEARLY;BYDAY=20MO,-1SU",
    "FREQ=YEARLY;BYMONTH=2,8", "FREQ=YEARLY;BYMONTHDAY=1,-1", "FREQ=YEARLY;BYDAY=MO;BYMONTHDAY=7", "FREQ=DAILY;BYMONTH=3;INTERVAL=5",
    "FREQ=WEEKLY;INTERVAL=2;WKST=SU;BYDAY=SU,MO", "FREQ=MONTHLY;BYDAY=SA;BYSETPOS=1,3;COUNT=5", "FREQ=YEARLY;BYMONTH=1,6;BYDAY=TU;BYSETPOS=2,-1",
    "FREQ=DAILY;BYMONTHDAY=-1,15",
]


def test_rules_agree_with_a_calendar_library(spark):
    start, low, high = datetime(2025, 10, 31, 19, 30), datetime(2026, 1, 1), datetime(2027, 1, 1)
    rows = [("f", i, {"UID": str(i), "DTSTART": "20251031T193000", "DTEND": "20251031T210000", "RRULE": r})
            for i, r in enumerate(RULES)]
    df = spark.createDataFrame(rows, "feed string, block int, props map<string,string>")
    got = {}
    for r in R.expand_rrule(df, low, high).collect():
        assert r.end - r.start == timedelta(minutes=90)
        got.setdefault(r.block, []).append(r.start)
    for i, rule in enumerate(RULES):
        assert sorted(got.get(i, [])) == rrulestr(rule, dtstart=start).between(low, high, inc=True), rule


def test_the_next_occurrence_has_no_horizon(spark):
    rules = ["FREQ=YEARLY;INTERVAL=4", "FREQ=YEARLY;INTERVAL=90", "FREQ=YEARLY;BYMONTH=2;BYMONTHDAY=29", "FREQ=YEARLY;UNTIL=20250601T000000",
             "FREQ=DAILY;COUNT=3", "FREQ=YEARLY;INTERVAL=4;COUNT=2", "FREQ=HOURLY", "FREQ=MONTHLY;BYDAY=FR;BYMONTHDAY=13"]
    rows = [("f", i, {"UID": str(i), "DTSTART": "20250101T100000", "RRULE": r}) for i, r in enumerate(rules)]
    df = spark.createDataFrame(rows, "feed string, block int, props map<string,string>")
    got = {r.block: r.start for r in R.next_occurrence(df, "2026-01-01").collect()}
    assert got == {0: datetime(2029, 1, 1, 10), 1: datetime(2115, 1, 1, 10), 2: datetime(2028, 2, 29, 10),
                   5: datetime(2029, 1, 1, 10), 7: datetime(2026, 2, 13, 10)}
    assert [(r.block, r.reason) for r in R.unread_rules(df).collect()] == [(6, "FREQ")]


def test_replaced_occurrence_is_left_to_its_own_entry(spark):
    rows = [
        ("f", 0, {"UID": "a", "DTSTART": "20260105T100000", "RRULE": "FREQ=WEEKLY;COUNT=3", "EXDATE": "20260112T100000"}),
        ("f", 1, {"UID": "a", "DTSTART": "20260120T110000", "RECURRENCE-ID": "20260119T100000"}),
    ]
    df = spark.createDataFrame(rows, "feed string, block int, props map<string,string>")
    got = sorted(r.start for r in R.expand_rrule(df, "2026-01-01", "2026-02-01").collect())
    assert got == [datetime(2026, 1, 5, 10), datetime(2026, 1, 20, 11)]


def test_replaced_occurrences_are_dropped_inside_the_row(spark, monkeypatch):
    """Occurrences do not move to be looked up, except those of series with very many replaced ones."""
    def entry(block, uid, start, **more):
        uid = {} if uid is None else {"UID": uid}
        return (more.pop("feed", "f"), block, {**uid, "DTSTART": start, **{k.replace("_", "-"): v for k, v in more.items()}})

    daily = {"RRULE": "FREQ=DAILY;COUNT=5"}
    rows = [entry(0, "a", "20260105T100000", **daily), entry(1, "a", "20260105T100000", feed="g", **daily),
            entry(2, None, "20260105T100000", **daily), entry(3, "b", "20260105T100000", feed=None, **daily),
            entry(4, "b", "20260201T100000", feed=None, RECURRENCE_ID="20260106T100000"), entry(5, None, "20260201T100000", RECURRENCE_ID="20260107T100000")]
    rows += [entry(10 + k, "a", "20260201T100000", RECURRENCE_ID=f"202601{day:02d}T100000") for k, day in enumerate((6, 8, 8, 20))]
    df = spark.createDataFrame(rows, "feed string, block int, props map<string,string>")
    gone = {(0, 6), (0, 8), (2, 7)}
    want = sorted((b, datetime(2026, 1, d, 10)) for b in range(4) for d in range(5, 10) if (b, d) not in gone)
    for most in (R.REPLACED_IN_ROW, 2):
        monkeypatch.setattr(R, "REPLACED_IN_ROW", most)
        found = R.expand_rrule(df, "2026-01-01", "2026-01-31")
        assert sorted((r.block, r.start) for r in found.collect()) == want
        assert ("LeftAnti" in found._jdf.queryExecution().optimizedPlan().toString()) == (most == 2)


@pytest.mark.parametrize("month,day,weekday,now,want", [
    (11, 22, 5, "2026-01-10", None), (11, 22, 6, "2026-01-10", date(2026, 11, 22)),
    (1, 5, None, "2026-06-01", None), (2, 29, 1, "2026-06-01", date(2028, 2, 29)),
])
def test_year_is_checked_by_weekday(spark, month, day, weekday, now, want):
    c = D.resolve_year(F.lit(month), F.lit(day), F.lit(weekday).cast("int"), F.lit(0), F.lit(0), now)
    got = spark.range(1).select(c.alias("d")).first().d
    assert (got.date() if got else None) == want


@pytest.mark.parametrize("day", ["2026-03-01", "2026-03-07", "2026-03-04"])
def test_calendar_filters_on_any_weekday(spark, make_listings, day):
    base = datetime.fromisoformat(day)
    rows = make_listings([{"id": i, "title": "x", "event_date": base + timedelta(days=i)} for i in range(20)])
    sunday = base + timedelta(days=(6 - base.weekday()) % 7)
    saturday = base + timedelta(days=(5 - base.weekday()) % 7)
    want = {
        "this_week": [i for i in range(20) if base + timedelta(days=i) < sunday + timedelta(days=7)],
        "this_weekend": sorted(d.days for d in (saturday - base, sunday + timedelta(days=7) - base)),
        "nonsense": list(range(20)),
    }
    for kind, ids in want.items():
        got = sorted(r.id for r in rows.where(S.date_predicate(kind, base)).collect())
        assert got == ids, kind


def test_blank_and_wordless_queries(make_listings):
    rows = make_listings([{"id": 1, "title": 'Café "Live"'}, {"id": 2, "title": "live cafe"}])
    found = lambda q: sorted(r.id for r in rows.where(S.phrase_match(q)).collect())
    assert found(None) == [1, 2] and found("") == [1, 2]
    assert found("   ") == [] and found("!?") == []
    assert found("cafe live") == [1] and found('" OR cafe*') == []


@pytest.mark.parametrize("block", [1, 3, 100_000])
def test_blocks_do_not_change_running_state(spark, block):
    rows = [("p", i, "h" + str(i) if i % 4 == 2 else None) for i in range(23)]
    df = spark.createDataFrame(rows, "k string, pos int, h string")
    got = {r.pos: r.out for r in W.carry_forward(df, ["k"], "pos", "h", "out", block).collect()}
    last, want = None, {}
    for _, pos, h in rows:
        last = h or last
        want[pos] = last
    assert got == want
    counted = W.running_count(df, ["k"], "pos", F.col("h").isNotNull(), "n", block)
    assert {r.pos: r.n for r in counted.collect()} == {p: sum(1 for x in rows[: p + 1] if x[2]) for p in range(23)}


def test_keys_are_dense_in_arrival_order(spark, make_listings):
    stored = make_listings([{"id": 7, "title": "x"}])
    batch = make_listings([{"id": i, "title": str(i)} for i in range(50)]).withColumn("arrival", F.col("id") * 10)
    got = L.assign_keys(batch, stored, block=60).select("id", "title").collect()
    assert sorted((r.id, r.title) for r in got) == sorted((8 + i, str(i)) for i in range(50))


def test_empty_snapshot_is_refused(spark, make_listings):
    root = job_folder(spark, "pub")
    B.publish(make_listings([{"id": 1, "title": "x"}]), root)
    with pytest.raises(ValueError):
        B.publish(make_listings([]), root)
    assert B.read_published(spark, root).count() == 1


def test_calendar_source_plugin(spark, tmp_path):
    (tmp_path / "a.ics").write_text("BEGIN:VEVENT\r\nUID:1\r\nSUMMARY:Long\r\n  name\r\nEND:VEVENT\r\n", newline="")
    spark.dataSource.register(IcsDataSource)

    @source("cal", "beyond")
    def cal(raw):
        return feeds.ics_entries(raw)

    row = run_source("cal", spark.read.format("ics").load(str(tmp_path))).first()
    assert row.props == {"UID": "1", "SUMMARY": "Long name"} and row.region == "beyond"


def _stream(spark, folder, rows, schema, step):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_sessions_widen_out_of_order_and_late_rows_leave(spark):
    schema = "session_id string, created_at timestamp_ntz, kind string"
    folder = job_folder(spark, "late")
    noon = datetime(2026, 3, 2, 12)
    first = [("s", noon, "page"), ("s", noon + timedelta(hours=30), "view")]
    late = [("s", noon - timedelta(hours=3), "click"), ("t", noon - timedelta(days=2), "page")]
    for step, rows in enumerate((first, late)):
        stream = _stream(spark, folder, rows, schema, step)
        jobs.write_batches(jobs.session_stream(stream), f"{folder}/s", f"{folder}/cs", once=True).awaitTermination()
        jobs.write_batches(jobs.daily_stream(stream, "1 hour"), f"{folder}/d", f"{folder}/cd", once=True).awaitTermination()
    seen = {r.session_id: r for r in jobs.read_sessions(spark, f"{folder}/s").collect()}
    assert seen["s"].first_seen == noon - timedelta(hours=3) and seen["s"].last_seen == noon + timedelta(hours=30)
    assert (seen["s"].page_views, seen["s"].events_viewed, seen["s"].events_clicked) == (1, 1, 1)
    days = {r.date: r for r in jobs.read_latest(spark, f"{folder}/d", ["date"]).collect()}
    assert days[date(2026, 3, 2)].events_clicked == 0 and date(2026, 2, 28) not in days
    assert days[date(2026, 3, 2)].unique_visitors == 1


def test_schema_defaults_of_old_rows(spark):
    old = spark.createDataFrame([(1, "t", "s")], "id bigint, title string, source string")
    row = L.decode_rows(old).first()
    assert (row.region, row.is_free, row.url, row.price) == ("westside", False, "", None)
    assert L.decode_rows(old).columns == schemas.LISTINGS.fieldNames()
