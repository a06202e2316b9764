"""Checked queries: date and time expressions."""

from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.functions import dates as D
from marquee.plans.catalog import plain, query
from marquee.plans.views import AS_OF


def ts(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def day(c):
    return f"strftime({c}, '%Y-%m-%d')"


def la(c):
    return f"timezone('America/Los_Angeles', timezone('UTC', {c}))"


DOW = "(isodow({0}) - 1)"
NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
DAY_NAME = "CASE {0} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END"


@query("x20_to_local", f"""
SELECT id, CASE WHEN id % 4 = 0 THEN {ts('event_date')}
  WHEN id % 4 = 1 THEN {ts(la('event_date'))}
  WHEN id % 4 = 2 THEN {ts(la("event_date + INTERVAL '7' HOUR"))}
  ELSE {ts(la("event_date - INTERVAL '5' HOUR - INTERVAL '30' MINUTE"))} END AS local,
  {ts(la('event_date'))} AS from_ms
FROM listings
""", "listings")
def _(t):
    k = F.col("id") % 4
    iso = F.date_format("event_date", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.concat(iso, F.when(k == 0, "").when(k == 1, "Z").when(k == 2, "-07:00").otherwise("+05:30"))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    ms = D.seconds_between("event_date", epoch) * 1000
    return plain(t.listings.select("id", D.to_local(raw).alias("local"),
                                   D.epoch_ms_to_local(ms).alias("from_ms")))


@query("x21_ics_ts", f"""
SELECT id, CASE id % 4 WHEN 0 THEN {ts(la('event_date'))} WHEN 1 THEN {ts('event_date')}
  WHEN 2 THEN strftime(event_date, '%Y-%m-%d 00:00:00') END AS stamp FROM listings
""", "listings")
def _(t):
    k = F.col("id") % 4
    full, date = F.date_format("event_date", "yyyyMMdd'T'HHmmss"), F.date_format("event_date", "yyyyMMdd")
    raw = F.when(k == 0, F.concat(full, F.lit("Z"))).when(k == 1, F.concat(full, F.lit(",x"))).when(
        k == 2, date).otherwise("soon")
    return plain(t.listings.select("id", D.ics_ts(raw).alias("stamp")))


@query("x22_parse_date", f"""
SELECT id, CASE WHEN id % 6 = 5 THEN NULL WHEN id % 6 IN (1, 2, 3) THEN strftime(event_date, '%Y-%m-%d 00:00:00')
  ELSE {ts('event_date')} END AS parsed FROM listings
""", "listings")
def _(t):
    k = F.col("id") % 6
    def fmt(p):
        return F.date_format("event_date", p)
    raw = (F.when(k == 0, fmt("yyyy-MM-dd HH:mm:ss")).when(k == 1, fmt("EEEE, MMMM d, yyyy"))
           .when(k == 2, fmt("EEE MMM d yyyy")).when(k == 3, fmt("M/d/yyyy"))
           .when(k == 4, fmt("MMM d,  yyyy h:mm a")).otherwise("to be announced"))
    return plain(t.listings.select("id", D.parse_date(raw).alias("parsed")))


@query("x23_named_weekday", f"""
SELECT id, CAST(CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 2 AND id % 7 <> (id + 1) % 7 THEN NULL ELSE id % 7 END AS BIGINT) AS wd
FROM listings
""", "listings")
def _(t):
    name, other = (F.element_at(F.array(*[F.lit(n) for n in NAMES]), ((F.col("id") + i) % 7 + 1).cast("int"))
                   for i in (0, 1))
    k = F.col("id") % 3
    text = F.when(k == 0, F.col("title")).when(k == 1, F.concat(F.lit("Open "), F.upper(name), F.lit("S and "), name)).otherwise(
        F.concat(name, F.lit(" or "), other))
    return plain(t.listings.select("id", D.named_weekday(text).alias("wd")))


@query("x24_binding_weekday", f"""
SELECT id, CAST(CASE id % 4 WHEN 0 THEN id % 7 WHEN 1 THEN NULL WHEN 2 THEN id % 7 ELSE NULL END AS BIGINT) AS wd FROM listings
""", "listings")
def _(t):
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("id") % 7 + 1).cast("int"))
    k = F.col("id") % 4
    title = F.when(k == 0, F.concat(name, F.lit(" Night Comedy"))).when(
        k == 1, F.concat(F.lit("Loose "), name, F.lit(" mention"))).otherwise("Plain")
    body = F.when(k == 2, F.concat(F.lit("Join us this "), name, F.lit(", at 8"))).otherwise(
        F.concat(F.repeat(F.lit("far "), 40), name, F.lit(", at 8")))
    return plain(t.listings.select("id", D.binding_weekday(title, body).alias("wd")))


def _candidate(year, wd):
    d = f"TRY_CAST('{year}-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE)"
    at = f"({d} + INTERVAL '1' HOUR * h)"
    return (f"WHEN {d} IS NOT NULL AND floor(epoch(TIMESTAMP '1998-06-17 10:30:00' - {at}) / 86400) <= 2"
            f" AND {wd.format(DOW.format(d))} THEN {ts(at)}")


@query("x25_resolve_year", f"""
SELECT id, CASE {_candidate(1998, '(wd IS NULL OR {} = wd)')} {_candidate(1999, '{} = wd')} {_candidate(2000, '{} = wd')} END AS resolved
FROM (SELECT id, month(event_date) AS m, CASE WHEN id % 50 = 1 THEN 29 ELSE day(event_date) END AS d,
        CASE WHEN id % 3 = 0 THEN NULL ELSE id % 7 END AS wd, CAST(id % 24 AS INT) AS h FROM listings)
""", "listings")
def _(t):
    d = F.when(F.col("id") % 50 == 1, 29).otherwise(F.day("event_date"))
    wd = F.when(F.col("id") % 3 != 0, F.col("id") % 7)
    resolved = D.resolve_year(F.month("event_date"), d, wd, (F.col("id") % 24).cast("int"),
                              F.lit(0), AS_OF)
    return plain(t.listings.select("id", resolved.alias("resolved")))


def _range_sql():
    rows = []
    for y in (1997, 1998, 1999):
        a = f"TRY_CAST('{y}-' || lpad(CAST(m1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(d1 AS VARCHAR), 2, '0') AS DATE)"
        b = (f"TRY_CAST(CAST(CASE WHEN m2 < m1 THEN {y + 1} ELSE {y} END AS VARCHAR) || '-' || lpad(CAST(m2 AS VARCHAR), 2, '0')"
             " || '-' || lpad(CAST(d2 AS VARCHAR), 2, '0') AS DATE)")
        rows.append(f"SELECT id, {a} AS s, {b} AS e, CASE WHEN {DOW.format(a)} = wd THEN 0 ELSE 1 END AS off FROM base")
    return " UNION ALL ".join(rows)


@query("x26_resolve_range", f"""
WITH base AS (SELECT id, month(event_date) AS m1, day(event_date) AS d1, CAST(1 + (month(event_date) + id % 3) % 12 AS INT) AS m2,
    CAST(1 + id % 28 AS INT) AS d2, id % 7 AS wd FROM listings),
c AS ({_range_sql()})
SELECT id, {day('s')} AS first, {day('e')} AS last FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY off, e, s) AS rn FROM c WHERE s IS NOT NULL AND e >= DATE '1998-06-17')
WHERE rn = 1
""".strip(), "listings")
def _(t):
    m1, d1 = F.month("event_date"), F.day("event_date")
    m2 = (1 + (m1 + F.col("id") % 3) % 12).cast("int")
    d2 = (1 + F.col("id") % 28).cast("int")
    r = t.listings.select("id", D.resolve_range(F.col("id") % 7, m1, d1, m2, d2, AS_OF).alias("r"))
    return plain(r.where("r is not null").select("id", F.col("r.start").alias("first"), F.col("r.end").alias("last")))


@query("x27_season_year", """
SELECT id, CAST(CASE WHEN id % 2 = 0 THEN CASE WHEN month(event_date) >= 8 THEN 1997 ELSE 1998 END
  WHEN make_date(1998, month(event_date), least(day(event_date), 28)) < TIMESTAMP '1998-05-18 10:30:00' THEN 1999 ELSE 1998 END AS BIGINT) AS y FROM listings
""", "listings")
def _(t):
    d = F.least(F.day("event_date"), F.lit(28))
    season = F.when(F.col("id") % 2 == 0, 1997)
    return plain(t.listings.select("id", D.season_year(F.month("event_date"), d, season, AS_OF).alias("y")))


@query("x28_weekday_rules", f"""
SELECT id, strftime(DATE '1998-06-17' + CAST(CASE WHEN (id % 7 - 2 + 7) % 7 = 0 THEN 7 ELSE (id % 7 - 2 + 7) % 7 END AS INT), '%Y-%m-%d 19:00:00') AS next_one,
  (SELECT min(strftime(day, '%Y-%m-%d 20:30:00')) FROM (
     SELECT day, row_number() OVER (PARTITION BY strftime(day, '%Y-%m'), isodow(day) ORDER BY day) AS nth,
       row_number() OVER (PARTITION BY strftime(day, '%Y-%m'), isodow(day) ORDER BY day DESC) AS from_end
     FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '1998-06-01', TIMESTAMP '1999-06-30', INTERVAL 1 DAY)) AS DATE) AS day))
   WHERE isodow(day) - 1 = l.id % 7 AND day + INTERVAL '20' HOUR + INTERVAL '30' MINUTE >= TIMESTAMP '1998-06-17 10:30:00'
     AND CASE WHEN l.id % 5 = 4 THEN from_end = 1 ELSE nth = l.id % 5 + 1 END) AS nth
FROM listings l
""", "listings")
def _(t):
    wd, k = F.col("id") % 7, F.col("id") % 5
    n = F.when(k == 4, -1).otherwise(k + 1)
    return plain(t.listings.select("id", D.next_weekday(wd, AS_OF).alias("next_one"),
                                   D.nth_weekday(n, wd, AS_OF, 20, 30).alias("nth")))


@query("x29_parse_clock", """
SELECT id, CAST(CASE id % 5 WHEN 0 THEN 17 * 60 WHEN 1 THEN 17 * 60 WHEN 2 THEN 8 * 60 + 30 WHEN 3 THEN 0 ELSE 19 * 60 + 15 END AS BIGINT) AS start_min,
  CAST(CASE id % 5 WHEN 0 THEN 20 * 60 WHEN 1 THEN 20 * 60 WHEN 2 THEN 13 * 60 + 30 END AS BIGINT) AS end_min,
  CAST(CASE id % 5 WHEN 0 THEN 17 * 60 WHEN 1 THEN 17 * 60 WHEN 2 THEN 8 * 60 + 30 WHEN 3 THEN 19 * 60 ELSE 19 * 60 + 15 END AS BIGINT) AS first_min,
  CAST(CASE WHEN id % 5 = 2 THEN 8 * 60 + 30 END AS BIGINT) AS opens,
  CAST(CASE WHEN id % 2 = 0 THEN 20 * 60 ELSE 21 * 60 END AS BIGINT) AS show_min
FROM listings
""", "listings")
def _(t):
    k = F.col("id") % 5
    text = (F.when(k == 0, F.concat("title", F.lit(" 5pm - 8pm"))).when(k == 1, "Fridays 5-8pm")
            .when(k == 2, "8:30am-1:30pm").when(k == 3, "all day").otherwise("Doors 7:15 p.m. sharp"))
    plainly = F.replace(text, F.lit("p.m."), F.lit("pm"))
    show = F.when(F.col("id") % 2 == 0, "7:15pm signup, 8pm start").otherwise("Bar from 5pm, band @ 9pm")
    c = D.parse_clock(text)
    return plain(t.listings.select(
        "id", c["start_min"].alias("start_min"), c["end_min"].alias("end_min"),
        D.start_clock(plainly).alias("first_min"),
        F.when(k == 2, D.open_hours(text)["start_min"]).alias("opens"),
        D.show_clock(show).alias("show_min")))


@query("x30_relative_date", """
SELECT id, CASE id % 3 WHEN 0 THEN '1998-06-17 20:00:00' WHEN 1 THEN '1998-06-18 20:00:00' END AS d FROM listings
""", "listings")
def _(t):
    k = F.col("id") % 3
    word = F.when(k == 0, " Today").when(k == 1, "TOMORROW ").otherwise("next week")
    return plain(t.listings.select("id", D.relative_date(word, AS_OF).alias("d")))


# Easter Sundays of the years the orders fall in.
EASTER = {1995: "04-16", 1996: "04-07", 1997: "03-30", 1998: "04-12", 1999: "04-04", 2000: "04-23", 2001: "04-15"}


@query("x31_holiday", f"""
SELECT id, CASE id % 5 WHEN 0 THEN CAST(y AS VARCHAR) || '-' || CASE y {' '.join(f"WHEN {y} THEN '{d}'" for y, d in EASTER.items())} END
  WHEN 1 THEN strftime(make_date(y, 11, 1) + CAST((3 - (isodow(make_date(y, 11, 1)) - 1) + 7) % 7 + 21 AS INT), '%Y-%m-%d')
  WHEN 2 THEN CAST(y AS VARCHAR) || '-02-14' WHEN 3 THEN CAST(y AS VARCHAR) || '-12-25' ELSE CAST(y AS VARCHAR) || '-12-31' END AS d
FROM (SELECT id, CAST(year(event_date) AS INT) AS y FROM listings)
""", "listings")
def _(t):
    names = F.array(*[F.lit(n) for n in ("easter", "thanksgiving", "valentine", "christmas", "nye")])
    name = F.element_at(names, (F.col("id") % 5 + 1).cast("int"))
    return plain(t.listings.select("id", D.holiday(name, F.year("event_date")).alias("d")))


@query("x32_prefer_timed", f"""
SELECT id, CASE WHEN hour(event_date) = 0 AND end_date IS NOT NULL AND hour(end_date) <> 0 THEN {ts('end_date')}
  ELSE {ts('coalesce(event_date, end_date)')} END AS d FROM listings
""", "listings")
def _(t):
    return plain(t.listings.select("id", D.prefer_timed("event_date", "end_date").alias("d")))


@query("x33_shift_end", f"""
SELECT id, {ts("event_date + INTERVAL '3' DAY + (end_date - event_date)")} AS e FROM listings
""", "listings")
def _(t):
    start = D.plus("event_date", 3, "DAY")
    return plain(t.listings.select("id", D.shift_end(start, "event_date", "end_date").alias("e")))


@query("x48_sane_end", f"""
SELECT id, CASE WHEN end_date > event_date AND end_date - event_date <= INTERVAL '14' HOUR THEN {ts('end_date')} END AS e FROM listings
""", "listings")
def _(t):
    return plain(t.listings.select("id", D.sane_end("event_date", "end_date", 14).alias("e")))


@query("x49_roll_year", f"""
SELECT id, CASE id % 3 WHEN 0 THEN CASE WHEN m < 6 THEN 1999 ELSE 1998 END
  WHEN 1 THEN CASE WHEN floor(epoch(TIMESTAMP '1998-06-17 10:30:00' - make_date(1998, m, d)) / 86400) > 30 THEN 1999 ELSE 1998 END
  ELSE CASE WHEN m < 6 AND 6 - m >= 6 THEN 1999 ELSE 1998 END END || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS rolled
FROM (SELECT id, CAST(month(event_date) AS INT) AS m, CAST(least(day(event_date), 28) AS INT) AS d FROM listings)
""", "listings")
def _(t):
    m, d, k = F.month("event_date"), F.least(F.day("event_date"), F.lit(28)), F.col("id") % 3
    rolled = (F.when(k == 0, D.roll_year(m, d, "earlier_month", AS_OF))
              .when(k == 1, D.roll_year(m, d, "past_30_days", AS_OF))
              .otherwise(D.roll_year(m, d, "half_year_behind", AS_OF)))
    return plain(t.listings.select("id", rolled.alias("rolled")))
