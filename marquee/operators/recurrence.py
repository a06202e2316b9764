"""Series to single occurrences. Each rule is a row-local array, then one explode."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.functions import dates as D
from marquee.functions import text as X
from marquee.operators.staging import staged
from marquee.session import cut_lineage, dealt, spread

DAY_CODES = ["MO", "TU", "WE", "TH", "FR", "SA", "SU"]


def prop(props: Column, name: str) -> Column:
    """Value of a calendar property, with or without parameters on its name."""
    entries = F.map_entries(props)
    hit = F.filter(
        entries, lambda e: (e["key"] == name) | F.startswith(e["key"], F.lit(f"{name};"))
    )
    return F.get(hit, F.lit(0))["value"]


def exception_dates(props: Column, start: Column | None = None) -> Column:
    """EXDATE moments; with ``start`` a date alone means that day at the start's clock."""
    hit = F.filter(
        F.map_entries(props),
        lambda e: (e["key"] == "EXDATE") | F.startswith(e["key"], F.lit("EXDATE;")),
    )
    texts = F.flatten(F.transform(hit, lambda e: F.split(e["value"], ",")))

    def read(text: Column) -> Column:
        moment = D.ics_ts(text)
        if start is None:
            return moment
        clock = start - F.date_trunc("day", start).cast("timestamp_ntz")
        return F.when(F.contains(text, F.lit("T")), moment).otherwise(moment + clock)

    return F.transform(texts, read)


#: Rule parts that are read; a rule with any other names no day and is reported.
RULE_PARTS = ["FREQ", "INTERVAL", "BYDAY", "BYMONTHDAY", "BYMONTH", "BYSETPOS", "WKST", "COUNT", "UNTIL"]
LAST_MOMENT = "9999-12-31 23:59:59"


def _day_code(text: Column) -> Column:
    """A BYDAY entry as one number: seven times its ordinal (0 without one) and its weekday."""
    codes = F.array(*[F.lit(c) for c in DAY_CODES])
    ordinal = F.coalesce(F.regexp_extract(text, r"^([+-]?\d+)", 1).try_cast("int"), F.lit(0))
    return (ordinal * 7 + F.array_position(codes, F.right(text, F.lit(2))) - 1).cast("int")


def _rule_parts(entries: DataFrame) -> DataFrame:
    """Adds the parts of the rule as columns, each computed once per entry."""
    def part(name: str) -> Column:
        return F.try_element_at(F.col("r_parts"), F.lit(name))

    def listed(name: str) -> Column:
        return F.coalesce(F.split(part(name), ","), F.array().cast("array<string>"))

    def numbers(name: str) -> Column:
        return F.transform(listed(name), lambda x: x.try_cast("int"))

    split = F.str_to_map(F.upper(F.trim("rule")), F.lit(";"), F.lit("="))
    parts = staged(entries, {"r_parts": split})
    codes = F.array(*[F.lit(c) for c in DAY_CODES])
    parts = staged(
        parts,
        {
            "r_freq": part("FREQ"),
            "r_step": F.coalesce(part("INTERVAL").try_cast("int"), F.lit(1)),
            "r_days": listed("BYDAY"),
            "r_dates": numbers("BYMONTHDAY"),
            "r_months": numbers("BYMONTH"),
            "r_places": numbers("BYSETPOS"),
            "r_week": F.coalesce(F.array_position(codes, part("WKST")) - 1, F.lit(0)).cast("int"),
            "r_count": part("COUNT").try_cast("int"),
            "r_until_text": part("UNTIL"),
            "r_until_at": D.ics_ts(part("UNTIL")),
            "r_first": F.to_date("m_start"),
        },
    )
    parts = staged(parts, {"r_codes": F.transform("r_days", _day_code)})
    # UNTIL is the last allowed moment; a date alone allows that whole day.
    last_moment = F.make_dt_interval(days=F.lit(1)) - F.make_dt_interval(
        secs=F.lit("0.000001").cast("decimal(18,6)")
    )
    until = F.when(F.col("r_until_text").contains("T"), F.col("r_until_at")).otherwise(
        F.col("r_until_at") + last_moment
    )
    clock = F.col("m_start") - F.col("r_first").cast("timestamp_ntz")
    known = F.array(*[F.lit(c) for c in RULE_PARTS])
    other = F.array_except(F.map_keys("r_parts"), known)
    unread = F.exists(F.concat("r_dates", "r_months", "r_places"), lambda x: x.isNull() | (x == 0))
    frequent = F.col("r_freq").isin("DAILY", "WEEKLY")
    day = "^([+-]?[1-9][0-9]?)?(MO|TU|WE|TH|FR|SA|SU)$"
    bad_day = F.exists("r_days", lambda x: ~F.rlike(x, F.lit(day)) | (frequent & (F.length(x) > 2)))
    reason = (
        F.when(~F.coalesce(F.col("r_freq").isin("DAILY", "WEEKLY", "MONTHLY", "YEARLY"), F.lit(False)), "FREQ")
        .when(F.size(other) > 0, F.array_join(F.array_sort(other), ","))
        .when(F.coalesce(unread, F.lit(False)), "number")
        .when(F.coalesce(bad_day, F.lit(False)), "BYDAY")
        .when(part("INTERVAL").isNotNull() & F.coalesce(part("INTERVAL").try_cast("int") < 1, F.lit(True)), "INTERVAL")
        .when(part("COUNT").isNotNull() & F.col("r_count").isNull(), "COUNT")
        .when(part("UNTIL").isNotNull() & F.col("r_until_at").isNull(), "UNTIL")
    )
    return staged(parts, {"r_until": until, "r_clock": clock, "r_reason": F.when(F.col("rule").isNotNull(), reason)})


def _week(d: Column) -> Column:
    """First day of the rule's week."""
    return F.date_sub(d, F.pmod(F.weekday(d) - F.col("r_week"), F.lit(7)))


def _months(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d) - 1


def _month_start(number: Column) -> Column:
    return F.make_date(F.floor(number / 12).cast("int"), F.pmod(number, F.lit(12)).cast("int") + 1, F.lit(1))


def _days_in_step() -> Column:
    """Days of each period the rule's interval names from r_begin to r_end, those between left out."""
    freq, step, first = F.col("r_freq"), F.col("r_step"), F.col("r_first")
    begin, end = F.col("r_begin"), F.col("r_end")

    def stepped(number) -> Column:
        """Numbers of the periods, the first at or before begin."""
        behind = number(begin) - number(first)
        start = number(first) + F.floor(behind / step).cast("int") * step
        return F.sequence(start, F.greatest(number(end), start), step)

    years = F.transform(stepped(F.year), lambda y: F.sequence(F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y, F.lit(12), F.lit(31))))
    months = F.transform(stepped(_months), lambda m: F.sequence(_month_start(m), F.last_day(_month_start(m))))
    weeks = F.transform(stepped(lambda d: F.floor(F.date_diff(_week(d), F.lit("1970-01-05").cast("date")) / 7).cast("int")),
                        lambda w: F.sequence(F.date_add(F.date_add(F.lit("1970-01-05").cast("date"), w * 7), F.col("r_shift")),
                                             F.date_add(F.date_add(F.lit("1970-01-05").cast("date"), w * 7), F.col("r_shift") + 6)))
    days = F.transform(stepped(F.unix_date), lambda n: F.array(F.date_from_unix_date(n)))
    every = F.when(freq == "YEARLY", years).when(freq == "MONTHLY", months).when(freq == "WEEKLY", weeks).otherwise(days)
    return F.when(begin <= end, every).otherwise(F.array().cast("array<array<date>>"))


def _fits(d: Column) -> Column:
    """A day of a named period that the BY parts name; the columns f_* are those of ``_day_facts``."""
    freq, codes, by_date, by_month = F.col("r_freq"), F.col("r_codes"), F.col("r_dates"), F.col("r_months")
    no_days, no_dates, no_months = F.col("f_no_days"), F.col("f_no_dates"), F.col("f_no_months")
    weekday, dom, month_days = F.weekday(d), F.day(d), F.day(F.last_day(d))
    in_month = no_months | F.array_contains(by_month, F.month(d))
    on_date = no_dates | F.array_contains(by_date, dom) | F.array_contains(by_date, dom - month_days - 1)
    on_start = dom == F.col("f_dom")

    def nth_of(place: Column, length: Column) -> Column:
        """The day is any, the n-th, or the n-th last, of its weekday in a month or year."""
        ahead = place + 6 - (place + 6) % 7
        back = length - place + 7 - (length - place) % 7
        return (F.array_contains(codes, weekday) | F.array_contains(codes, ahead + weekday)
                | F.array_contains(codes, weekday - back))

    in_the_month = nth_of(dom, month_days)
    in_the_year = nth_of(F.dayofyear(d), F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31))))
    on_day = no_days | F.array_contains(codes, weekday)
    monthly = F.when(no_days & no_dates, on_start).otherwise(on_date & (no_days | in_the_month))
    yearly = (
        F.when(no_days & no_dates, on_start & (~no_months | (F.month(d) == F.col("f_month"))))
        .when(no_days, on_date)
        .when(no_months & no_dates, in_the_year)
        .otherwise(on_date & in_the_month)
    )
    weekly_ = F.when(no_days, weekday == F.col("f_weekday")).otherwise(on_day) & on_date
    return in_month & (
        F.when(freq == "DAILY", on_day & on_date)
        .when(freq == "WEEKLY", weekly_)
        .when(freq == "MONTHLY", monthly)
        .otherwise(yearly)
    )


def _day_facts() -> dict[str, Column]:
    """What ``_fits`` asks of every day of a rule, computed once for the rule."""
    low, high = _period_edges()
    return {
        "f_no_days": F.size("r_codes") == 0, "f_no_dates": F.size("r_dates") == 0, "f_no_months": F.size("r_months") == 0,
        "f_dom": F.day("r_first"), "f_month": F.month("r_first"), "f_weekday": F.weekday("r_first"),
        "f_low": low, "f_high": high,
    }


def _placed(days: Column) -> Column:
    """BYSETPOS: the n-th or n-th last of the days of one period."""
    places = F.col("r_places")

    def kept(d: Column, i: Column) -> Column:
        return F.array_contains(places, i + 1) | F.array_contains(places, i - F.size(days))

    return F.when(F.size(places) == 0, days).otherwise(F.filter(days, kept))


def _period_edges() -> tuple[Column, Column]:
    """First and last day of the periods that hold r_begin and r_end."""
    freq, begin, end = F.col("r_freq"), F.col("r_begin"), F.col("r_end")
    low = (
        F.when(freq == "YEARLY", F.make_date(F.year(begin), F.lit(1), F.lit(1)))
        .when(freq == "MONTHLY", _month_start(_months(begin)))
        .when(freq == "WEEKLY", _week(begin)).otherwise(begin)
    )
    high = (
        F.when(freq == "YEARLY", F.make_date(F.year(end), F.lit(12), F.lit(31)))
        .when(freq == "MONTHLY", F.last_day(end))
        .when(freq == "WEEKLY", F.date_add(_week(end), 6)).otherwise(end)
    )
    return low, high


#: The days a rule names follow from these alone, not from the clock, the exceptions or the entry.
NAMING = ["r_freq", "r_step", "r_codes", "r_dates", "r_months", "r_places", "r_week", "r_first", "r_begin", "r_end"]


def named_days(spans: DataFrame) -> DataFrame:
    """(r_named, r_chosen): for each rule, first day and window its days in the window.

    A calendar has few first days, so entries of any number share their days: each
    combination is looked at once, and dealt out by itself, for it is heavy per row.
    """
    rules = spans.where(F.startswith("r_named", F.lit("{"))).groupBy("r_named").agg(
        *[F.first(c).alias(c) for c in NAMING])
    facts = staged(spread(rules, "r_named"), {"r_shift": F.col("r_week"), **_day_facts()})

    def of_period(days: Column) -> Column:
        on = F.filter(days, lambda d: d.between(F.col("f_low"), F.col("f_high")) & _fits(d))
        return D.once(on, _placed)

    days = staged(facts, {"r_days_on": F.flatten(F.transform(_days_in_step(), of_period))})
    chosen = F.filter("r_days_on", lambda d: d.between(F.col("r_begin"), F.col("r_end")))
    return days.select("r_named", chosen.alias("r_chosen"))


#: What makes the days of an entry's rule: its text, the entry's first day and the first day looked at.
RULE_KEY = ["rule", "r_first", "r_low"]


def _rule_windows(keys: DataFrame, high: Column) -> DataFrame:
    """(RULE_KEY, r_until, r_count, r_high, r_reason, r_chosen) of distinct rules, first days and days looked from."""
    parsed = _rule_parts(keys.withColumn("m_start", F.col("r_first").cast("timestamp_ntz")).drop("r_first"))
    # A counted rule is followed from its first day, any other from the window.
    begin = F.when(F.col("r_count").isNull(), F.greatest("r_first", "r_low")).otherwise(F.col("r_first"))
    spans = staged(staged(parsed, {"r_high": high}), {
        "r_begin": begin, "r_end": F.least(F.to_date("r_high"), F.to_date("r_until"))})
    named = F.when(F.col("r_reason").isNull(), F.to_json(F.struct(*NAMING))).otherwise(
        F.concat(F.lit("-"), F.to_json(F.struct(*RULE_KEY))))
    spans = staged(spans, {"r_named": named})
    days = named_days(spans)
    return spans.join(days, "r_named", "left").select(
        *RULE_KEY, "r_until", "r_count", "r_high", "r_reason",
        F.coalesce("r_chosen", F.array().cast("array<date>")).alias("r_chosen"))


def rule_moments(entries: DataFrame, low: Column, high: Column) -> DataFrame:
    """Adds moments, the starts in [low, high] the entry's rule names, spent, r_high and r_reason.

    FREQ DAILY, WEEKLY, MONTHLY and YEARLY with INTERVAL, BYDAY (with ordinals for
    MONTHLY and YEARLY), BYMONTHDAY from either end, BYMONTH, BYSETPOS, WKST, COUNT and
    UNTIL, alone or together. A rule with another part names no day; r_reason says
    which. ``low`` may depend on the entry, ``high`` on the columns r_* of its rule and on
    r_low, the day of ``low``. Every entry has a rule. Rules are read once per text, first
    day and day looked from, not once per entry.
    """
    entries = staged(entries, {"r_first": F.to_date("m_start"), "r_low": F.to_date(low)})
    windows = _rule_windows(dealt(entries.select(*RULE_KEY).distinct()), high)
    spans = entries.join(windows, RULE_KEY)
    count, until = F.col("r_count"), F.col("r_until")
    clock = F.col("m_start") - F.col("r_first").cast("timestamp_ntz")
    starts = F.filter(
        F.transform("r_chosen", lambda d: d.cast("timestamp_ntz") + clock),
        lambda m: until.isNull() | (m <= until),
    )
    spans = staged(spans, {"r_starts": starts})
    counted = F.when(count.isNull(), F.col("r_starts")).otherwise(
        F.slice("r_starts", F.lit(1), F.greatest(count, F.lit(0)))
    )
    moments = F.filter(counted, lambda m: m.between(low, F.col("r_high")))
    spent = F.coalesce(F.size("r_starts") >= count, F.lit(False)) | F.coalesce(F.col("r_high") >= until, F.lit(False))
    return staged(spans, {"moments": moments, "spent": spent}).drop(
        "r_first", "r_low", "r_until", "r_count", "r_starts", "r_chosen")


def unread_rules(vevents: DataFrame) -> DataFrame:
    """(feed, block, uid, rule, reason) of entries whose rule is not expanded."""
    parsed = _rule_parts(_with_times(vevents).where(F.col("rule").isNotNull()))
    return parsed.where(F.col("r_reason").isNotNull()).select(
        "feed", "block", "uid", "rule", F.col("r_reason").alias("reason"))


def _with_times(vevents: DataFrame) -> DataFrame:
    props = F.col("props")
    times = {
        "uid": F.coalesce(F.try_element_at(props, F.lit("UID")), F.lit("")),
        "m_start": D.ics_ts(prop(props, "DTSTART")),
        "m_end": D.ics_ts(prop(props, "DTEND")),
        "rule": prop(props, "RRULE"),
        "replaces": D.ics_ts(prop(props, "RECURRENCE-ID")),
    }
    return staged(vevents, times).where(F.col("m_start").isNotNull())


#: Replaced moments of one series that its entries carry; those of more are looked up per occurrence.
REPLACED_IN_ROW = 1000


def expand_rrule(vevents: DataFrame, first, last) -> DataFrame:
    """Occurrences in [first, last] of (feed, block, props) calendar entries.

    Exception dates are dropped inside the row, and so are occurrences that another entry
    of the feed replaces: entries take the replaced moments of their (feed, uid), so no
    occurrence moves. Where one series has very many, an anti join drops them.
    """
    low, high = D.ntz(first), D.ntz(last)
    entries = _with_times(vevents)
    replaced = entries.where(F.col("replaces").isNotNull()).select(
        "feed", "uid", F.col("replaces").alias("start")
    )
    tally = replaced.groupBy("feed", "uid").agg(F.count(F.lit(1)).alias("n"))
    many = cut_lineage(tally.where(F.col("n") > REPLACED_IN_ROW).drop("n"))
    crowded = not many.isEmpty()
    few = replaced.join(many, ["feed", "uid"], "left_anti") if crowded else replaced
    moved = few.groupBy("feed", "uid").agg(F.collect_set("start").alias("moved"))
    recurring = staged(
        dealt(entries.where(F.col("rule").isNotNull()).join(moved, ["feed", "uid"], "left")),
        {"skipped": exception_dates(F.col("props"))},
    )

    def kept(m: Column) -> Column:
        gone = [F.coalesce(F.array_contains(c, m), F.lit(False)) for c in ("skipped", "moved")]
        return ~(gone[0] | gone[1])

    recurring = rule_moments(recurring, low, high)
    repeats = recurring.withColumn("start", F.explode(F.filter("moments", kept))).drop(
        "moments", "skipped", "moved", "spent", "r_reason", "r_high")
    if crowded:
        repeats = repeats.join(replaced.join(many, ["feed", "uid"], "left_semi"), ["feed", "uid", "start"], "left_anti")
    single = entries.where(F.col("rule").isNull() & F.col("m_start").between(low, high))
    found = repeats.unionByName(single.withColumn("start", F.col("m_start")))
    return found.select(
        "feed", "block", "uid", "props", "start",
        D.shift_end("start", "m_start", "m_end").alias("end"),
    )


#: Periods of a rule looked at in turn for its next occurrence; the last reaches any date.
LOOKAHEADS = (30, 400, 10_000)


def _ahead(periods: int) -> Column:
    """End of a lookahead of so many of the rule's periods, no later than the last date there is.

    It begins with the rule where that is later, so a rule that starts far off answers in the first one.
    """
    step, freq = F.col("r_step").cast("double") * periods, F.col("r_freq")
    days = F.when(freq == "YEARLY", step * 366).when(freq == "MONTHLY", step * 31).when(freq == "WEEKLY", step * 7).otherwise(step)
    begin = F.greatest("r_first", "r_low")
    room = F.date_diff(F.to_date(F.lit(LAST_MOMENT)), begin)
    until = F.date_add(begin, F.least(F.coalesce(days, F.lit(0.0)), room.cast("double")).cast("int"))
    return F.least(until.cast("timestamp_ntz"), D.ntz(LAST_MOMENT))


def next_occurrence(vevents: DataFrame, as_of) -> DataFrame:
    """R2: per entry the first occurrence that is not over yet, however far off.

    Most rules answer within the first lookahead; the rest are looked at again with a
    longer one until they answer, are spent, or the calendar ends.
    """
    now = D.ntz(as_of)
    zero = F.make_dt_interval(secs=F.lit(0).cast("decimal(18,6)"))
    length = F.when(F.col("m_end") > F.col("m_start"), F.col("m_end") - F.col("m_start"))
    entries = staged(
        _with_times(vevents),
        {
            "length": length,
            "cutoff": now - F.coalesce(length, zero),
            "skipped": exception_dates(F.col("props"), F.col("m_start")),
        },
    )
    columns = ["feed", "block", "uid", "m_start", "m_end", "rule", "length", "cutoff", "skipped"]
    entries = cut_lineage(entries.select(*columns))
    answers = [entries.where(F.col("rule").isNull()).withColumn("start", F.col("m_start"))]
    todo = entries.where(F.col("rule").isNotNull())
    for periods in LOOKAHEADS:
        tried = rule_moments(todo, F.col("cutoff"), _ahead(periods))
        ahead = F.filter("moments", lambda m: ~F.coalesce(F.array_contains("skipped", m), F.lit(False)))
        tried = cut_lineage(staged(tried, {"start": F.array_min(ahead)}).drop("moments"))
        ended = F.col("spent") | F.col("r_reason").isNotNull() | (F.col("r_high") >= D.ntz("9999-12-31 00:00:00"))
        answers.append(tried.where(F.col("start").isNotNull()).select(*columns, "start"))
        todo = tried.where(F.col("start").isNull() & ~ended).select(*columns)
        if todo.isEmpty():
            break
    found = answers[0]
    for more in answers[1:]:
        found = found.unionByName(more)
    end = F.when(
        F.col("rule").isNull() & F.col("length").isNull(), F.col("m_end")
    ).otherwise(F.col("start") + F.col("length"))
    return (
        found.withColumn("end", end)
        .where(F.coalesce("end", "start") >= now)
        .select("feed", "block", "uid", "start", "end")
    )


def stated_weekday(title) -> Column:
    """Weekday of "every Friday" or "Fridays" in a title."""
    pattern = V.STATED_WEEKDAY_PATTERN
    found = F.concat(
        F.regexp_extract(X.text_or_empty(title), pattern, 1),
        F.regexp_extract(X.text_or_empty(title), pattern, 2),
    )
    return D.weekday_number(F.concat(F.lower(found), F.lit("day")))


def expand_series(
    df: DataFrame, as_of, weeks: int = 8, series_days: float = 2, longest_days: float = 7
) -> DataFrame:
    """A long span with a stated weekday becomes weekly listings.

    A longer span without one loses its end, so it shows on its first day only.
    """
    today = D.moment(as_of).date()
    span = D.seconds_between("end_date", "event_date") / 86400
    weekday = stated_weekday("title")
    is_series = F.coalesce((span > series_days) & weekday.isNotNull(), F.lit(False))
    blanket = F.coalesce((span > longest_days) & weekday.isNull(), F.lit(False))
    first = F.greatest(F.to_date("event_date"), D.day(today))
    first = F.date_add(first, F.pmod(weekday - F.weekday(first), F.lit(7)).cast("int"))
    last = F.least(F.to_date("end_date"), D.day(today + timedelta(weeks=weeks)))
    days = F.when(
        first <= last, F.sequence(first, last, F.make_dt_interval(days=F.lit(7)).cast("interval day"))
    ).otherwise(F.array().cast("array<date>"))
    clock = F.col("event_date") - F.to_date("event_date").cast("timestamp_ntz")
    moments = F.transform(days, lambda d: d.cast("timestamp_ntz") + clock)
    starts = F.when(is_series, moments).otherwise(F.array("event_date"))
    rows = df.select(
        "*",
        is_series.alias("__series"),
        F.when(~is_series & ~blanket, F.col("end_date")).alias("__end"),
        F.explode(starts).alias("__start"),
    )
    url = F.when(F.col("__series"), X.dated_url("url", "__start")).otherwise(F.col("url"))
    fresh = {"event_date": F.col("__start"), "end_date": F.col("__end"), "url": url}
    return rows.select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in df.columns])


def weekly(
    df: DataFrame, as_of, weekday: str = "weekday", start_min: str = "start_min", weeks: int = 4,
    skip_past: bool = True,
) -> DataFrame:
    """The next occurrences of a weekday and clock; today counts unless past."""
    now = D.moment(as_of)
    lead = F.pmod(F.col(weekday) - F.lit(now.weekday()), F.lit(7)).cast("int")
    if skip_past:
        passed = (lead == 0) & (F.lit(now.hour) >= F.floor(F.col(start_min) / 60))
        lead = F.when(passed, 7).otherwise(lead)
    first = F.date_add(D.day(now), lead)
    days = F.transform(F.sequence(F.lit(0), F.lit(weeks - 1)), lambda w: F.date_add(first, w * 7))
    rows = df.select("*", F.explode(days).alias("__day"))
    return rows.withColumn("start", D.at_clock("__day", F.lit(0), F.col(start_min))).drop("__day")


def expand_schedule(nodes: DataFrame, as_of, days: int = 60) -> DataFrame:
    """Schema.org schedules to starts.

    ``nodes`` has start, end, by_day (names or URLs), frequency, start_min,
    series_start and series_end (dates). Without days it is one dated event,
    kept until it is over; frequencies other than weekly give nothing.
    """
    now = D.moment(as_of)
    names = F.transform(
        F.coalesce("by_day", F.array().cast("array<string>")),
        lambda d: D.weekday_number(F.lower(F.substring_index(d, "/", -1))),
    )
    wanted = F.array_compact(names)
    single = F.size(wanted) == 0
    weekly_ = F.upper(X.text_or_empty("frequency")).isin("P1W", "P7D")
    first = F.greatest(D.day(now), F.coalesce("series_start", D.day(now)))
    last = D.day(now + timedelta(days=days))
    minute = F.coalesce(F.col("start_min"), F.hour("start") * 60 + F.minute("start"))
    spine = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))
    moments = F.transform(
        F.filter(spine, lambda d: F.array_contains(wanted, F.weekday(d))),
        lambda d: D.at_clock(d, F.lit(0), minute),
    )
    bound = F.date_add("series_end", 1).cast("timestamp_ntz")
    live = F.filter(
        moments, lambda m: (m >= D.ntz(now)) & (F.col("series_end").isNull() | (m <= bound))
    )
    alive = F.coalesce("end", "start") >= D.ntz(now)
    starts = (
        F.when(single & alive, F.array("start"))
        .when(~single & weekly_, live)
        .otherwise(F.array().cast("array<timestamp_ntz>"))
    )
    return nodes.select("*", F.explode(starts).alias("occurs"))


_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
_STEM = "(mon|tues|wednes|thurs|fri|satur|sun)day"
SERIES_PATTERN = (
    rf"(?i){_STEM}s?\b[^.]{{0,40}}?\b{_MONTH}\s+{_DAY}\s*(?:-|–|—|to|through)\s*(?:{_MONTH}\s+)?{_DAY}"
)
SINGLE_PATTERN = rf"(?i){_STEM},?\s+{_MONTH}\s+{_DAY}"


def _month_number(name: Column) -> Column:
    stems = F.array(*[F.lit(m) for m in
                      ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")])
    return F.nullif(F.array_position(stems, F.lower(name)).cast("int"), F.lit(0))


def expand_text_series(
    df: DataFrame, as_of, text: str = "schedule", max_occurrences: int = 12
) -> DataFrame:
    """R6: "Wednesdays, July 8 - August 26, 5-8pm" to one row per week (start, end)."""
    today = D.moment(as_of).date()
    s = X.text_or_empty(text)

    def g(pattern: str, i: int) -> Column:
        return F.regexp_extract(s, pattern, i)

    def weekday_of(pattern: str) -> Column:
        return D.weekday_number(F.concat(F.lower(g(pattern, 1)), F.lit("day")))

    # each pattern is matched once per group; the years tried below read the columns
    read = staged(df, {
        "__series": s.rlike(SERIES_PATTERN), "__wd": weekday_of(SERIES_PATTERN),
        "__m1": _month_number(g(SERIES_PATTERN, 2)), "__to": _month_number(g(SERIES_PATTERN, 4)),
        "__d1": g(SERIES_PATTERN, 3).try_cast("int"), "__d2": g(SERIES_PATTERN, 5).try_cast("int"),
        "__m": _month_number(g(SINGLE_PATTERN, 2)), "__d": g(SINGLE_PATTERN, 3).try_cast("int"),
        "__swd": weekday_of(SINGLE_PATTERN), "__c": D.parse_clock(s),
    })
    read = staged(read, {"__m2": F.coalesce("__to", "__m1")})
    parsed = staged(read, {"__r": D.resolve_range("__wd", "__m1", "__d1", "__m2", "__d2", as_of)})
    first = F.greatest(F.col("__r.start"), D.day(today))
    first = F.date_add(first, F.pmod(F.col("__wd") - F.weekday(first), F.lit(7)).cast("int"))
    last = F.col("__r.end")
    weeks = F.when(
        first <= last, F.sequence(first, last, F.make_dt_interval(days=F.lit(7)).cast("interval day"))
    ).otherwise(F.array().cast("array<date>"))
    options = F.array(
        *[D._safe_date(F.lit(y), F.col("__m"), F.col("__d")) for y in range(today.year, today.year + 3)]
    )
    one = F.slice(
        F.filter(options, lambda d: (F.weekday(d) == F.col("__swd")) & (d >= D.day(today))), 1, 1
    )
    days = F.when(F.col("__series"), F.slice(weeks, 1, max_occurrences)).otherwise(one)
    rows = parsed.withColumn("__day", F.explode(days))
    start = D.at_clock("__day", F.lit(0), F.col("__c.start_min"))
    end = D.at_clock("__day", F.lit(0), F.col("__c.end_min"))
    return rows.select(
        *df.columns, start.alias("start"), F.when(end > start, end).alias("end")
    )


def fan_out(
    df: DataFrame, location: str, places: dict[str, list[tuple[str, str]]], default: str
) -> DataFrame:
    """One row per (venue, address) of the location key, unknown keys as the default."""
    by_key = F.create_map(
        *[
            x
            for key, listed in places.items()
            for x in (
                F.lit(key),
                F.array(
                    *[F.struct(F.lit(v).alias("venue"), F.lit(a).alias("address")) for v, a in listed]
                ),
            )
        ]
    )
    chosen = F.coalesce(
        F.try_element_at(by_key, F.col(location)), F.try_element_at(by_key, F.lit(default))
    )
    rows = df.select("*", F.explode(chosen).alias("__p"))
    kept = [c for c in df.columns if c not in ("venue_name", "address")]
    return rows.select(
        *kept, F.col("__p.venue").alias("venue_name"), F.col("__p.address").alias("address")
    )


def from_fixed_schedule(markets: DataFrame, as_of, weeks: int = 8) -> DataFrame:
    """(name, weekday, hours, location, address) x the coming weeks."""
    now = D.moment(as_of)
    lead = F.pmod(F.col("weekday") - F.lit(now.weekday()), F.lit(7)).cast("int")
    first = F.date_add(D.day(now), lead)
    rows = markets.select(
        "*",
        D.open_hours("hours").alias("__h"),
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(weeks - 1)),
                              lambda w: F.date_add(first, w * 7))).alias("__day"),
    )
    about = "Weekly farmers market featuring fresh produce, flowers, and artisan goods. "
    return rows.select(
        F.col("name").alias("title"),
        F.concat(F.lit(about), "hours", F.lit(" at "), "location", F.lit(".")).alias("description"),
        F.col("name").alias("venue_name"),
        "address",
        D.at_clock("__day", F.lit(0), F.col("__h.start_min")).alias("event_date"),
        D.at_clock("__day", F.lit(0), F.col("__h.end_min")).alias("end_date"),
        F.lit("Food & Drink").alias("category"),
        F.lit(True).alias("is_free"),
        F.lit("Free admission").alias("price_note"),
    )
