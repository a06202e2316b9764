"""Work that is heavy per row: dealt over all tasks, done once for what rows share."""

import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from marquee.functions import dates as D
from marquee.functions import similarity
from marquee.operators import matching, names
from marquee.operators import recurrence as R
from marquee.plans import feed_plans, series_plans
from marquee.plans.views import Tables

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("build", [series_plans._ruled, series_plans._vevents, feed_plans._rss, feed_plans._ld_pages])
def test_rows_of_one_file_are_dealt_over_all_tasks(spark, build):
    rows = build(Tables(spark, SMALL))
    assert rows.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_rule_and_its_first_day_are_looked_at_once(spark):
    rows = [("f", i, {"UID": str(i), "DTSTART": f"20260105T{10 + i % 5}0000", "RRULE": "FREQ=MONTHLY;BYDAY=MO,TU;BYSETPOS=-1,1"})
            for i in range(50)]
    df = spark.createDataFrame(rows, "feed string, block int, props map<string,string>")
    spans = R._rule_parts(R._with_times(df)).withColumns({
        "r_begin": F.lit("2026-01-05").cast("date"), "r_end": F.lit("2026-03-31").cast("date"),
    }).withColumn("r_named", F.to_json(F.struct(*R.NAMING)))
    found = R.named_days(spans).collect()
    assert [[str(d) for d in r.r_chosen] for r in found] == [
        ["2026-01-05", "2026-01-27", "2026-02-02", "2026-02-24", "2026-03-02", "2026-03-31"]]


def test_only_patterns_of_a_texts_shape_are_tried(spark):
    texts = ["1998-06-17 10:30:00", "1998-06-17T10:30:00", "1998-06-17 10:30", "1998-06-17", "June 7, 1998 7:30 PM", "June 7, 1998",
             "Jun 7, 1998 7:30 pm", "Jun 07, 1998", "Jun 7 1998", "6/7/1998 7:30 AM", "06/07/1998", "7 Jun 1998", "Monday, June 8, 1998",
             "", None, "soon", "June 31, 1998", "17-06-1998", "Jun 7, 1998 at noon", "1998-13-01", "-5", "June 7, 1998 25:00 PM",
             "2024-02-30", "Juné 7, 1998", "7 June 1998", "+1998-06-17", "1998--6-17", "Sept 7, 1998", "12:30", "1998-06-17 10:30:00.5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("t", F.lit(""))), r"\s+", " "),
                            r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? ", "")
    for formats in (D.DATE_FORMATS, ["d MMM yyyy HH:mm:ss"], ["MMMM d yyyy h a", "MMM d yyyy"]):
        every = F.coalesce(*[D._by_pattern(bare, p) for p in formats])
        for r in df.select("t", D.parse_date("t", formats).alias("got"), every.alias("want")).collect():
            assert r.got == r.want, r.t
        assert "transform" in str(D.parse_date("t", formats))  # the text is prepared once, not once a pattern


def test_small_blocks_are_compared_without_an_index(spark, monkeypatch):
    rows = [(i % 7, f"evening of songs number {i // 7}") for i in range(70)]
    df = spark.createDataFrame(rows, "slot int, name string")
    indexed = {tuple(r) for r in names.similar_names(df, df, 0.85, ["slot"], pairs_per_key=0).select("a_name", "b_name").collect()}

    def refused(*_):
        raise AssertionError("a small block was indexed")

    monkeypatch.setattr(names, "_indexed", refused)
    whole = {tuple(r) for r in names.similar_names(df, df, 0.85, ["slot"]).select("a_name", "b_name").collect()}
    assert whole == indexed and len(whole) == 100


def test_rules_are_read_once_per_text_and_day(spark, monkeypatch):
    rows = [("f", i, {"UID": str(i), "DTSTART": f"2026010{5 + i % 2}T{10 + i % 5}0000", "RRULE": "FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,TU"})
            for i in range(50)]
    rows += [("f", 50, {"UID": "s", "DTSTART": "20260301T120000"}), ("f", 51, {"UID": "l", "DTSTART": "20400102T120000", "RRULE": "FREQ=DAILY"}),
             ("f", 52, {"UID": "d", "DTSTART": "20250101T120000", "RRULE": "FREQ=DAILY;COUNT=3"}),
             ("f", 53, {"UID": "x", "DTSTART": "20260105T120000", "RRULE": "FREQ=DAILY", "EXDATE": "20260105"})]
    df = spark.createDataFrame(rows, "feed string, block int, props map<string,string>")
    read, plain_parts = [], R._rule_parts

    def counted(entries):
        read.append(entries.count())
        return plain_parts(entries)

    monkeypatch.setattr(R, "_rule_parts", counted)
    found = {r.block: str(r.start) for r in R.next_occurrence(df, "2026-01-05 12:30:00").collect()}
    # two first days of one rule, and three more rules
    assert read == [5]
    # Mondays and Tuesdays of every second week: the first day is over at half past twelve only by its clock
    assert all(found[i] == (f"2026-01-05 {10 + i % 5}:00:00" if i % 2 == 0 and i % 5 > 2 else f"2026-01-06 {10 + i % 5}:00:00") for i in range(50))
    assert found[50] == "2026-03-01 12:00:00" and found[51] == "2040-01-02 12:00:00" and found[53] == "2026-01-06 12:00:00"
    assert 52 not in found and len(found) == 53


def test_the_fast_ratio_is_that_of_difflib():
    draw = random.Random(7)
    texts = ["".join(draw.choice("abcd é#") for _ in range(draw.randint(1, 24))) for _ in range(400)]
    texts += ["a" * 150, "ab" * 110, "the long night of the open doors", "open doors: the long night"]
    for x in texts[::3]:
        for y in texts[::5]:
            for least in (0.0, 0.45, 0.85):
                plain = SequenceMatcher(None, x, y)
                assert similarity.ratio(x, y, least) == (plain.ratio() if plain.quick_ratio() >= least else 0.0), (x, y)


def test_pairs_of_one_table_leave_the_joins_once(spark, make_listings):
    day = datetime(2026, 1, 5, 10)
    rows = [{"id": i, "title": f"Open doors {i % 3}", "venue_name": "Hall", "source": f"s{i}", "event_date": day + timedelta(hours=i)}
            for i in range(8)]
    reps = matching.representatives(matching.match_facts(make_listings(rows)))
    ends = ["a_id", "b_id"]
    every = matching.candidates(reps, reps).select(*ends).collect()
    once = matching.candidates(reps, reps, falling=True).select(*ends).collect()
    assert sorted(once) == sorted(r for r in every if r.a_id > r.b_id)
    assert len(once) == 28


def test_letters_are_found_once_per_title(spark, make_listings, monkeypatch):
    rows = [{"id": i, "title": f"Open doors {i % 3}", "url": f"https://a.example/{i}"} for i in range(30)]
    seen, plain_marks = [], matching.with_letter_marks

    def counted(df, name):
        seen.append(df.count())
        return plain_marks(df, name)

    monkeypatch.setattr(matching, "with_letter_marks", counted)
    facts = matching.match_facts(make_listings(rows))
    reps = matching.representatives(facts)
    assert seen == [3] and reps.count() == 30
    own = plain_marks(facts, "title").select("id", "m0", "m1", "m2", "m3").collect()
    assert sorted(own) == sorted(reps.select("id", "m0", "m1", "m2", "m3").collect())
