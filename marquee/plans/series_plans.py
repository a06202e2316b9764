"""Checked queries: ordered walks, batch sets, recurrence."""

from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.functions import dates as D
from marquee.operators import recurrence as R
from marquee.operators import sets as U
from marquee.operators import windows as W
from marquee.plans.catalog import plain, query
from marquee.plans.views import AS_OF
from marquee.session import dealt

TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


@query("w1_carry_forward", """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header
FROM conversations
""")
def _(t):
    rows = t.raw("conversations").withColumn(
        "h", F.when(F.col("role") == "user", F.col("text")))
    return W.carry_forward(rows, ["conv_id"], "turn", "h", "header").select("conv_id", "turn", "header")


@query("w2_segment", """
WITH s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM conversations)
SELECT conv_id, CAST(segment AS BIGINT) AS segment, max(CASE WHEN role = 'user' THEN text END) AS title,
  coalesce(string_agg(CASE WHEN role <> 'user' AND text <> '' THEN text END, ' ' ORDER BY turn), '') AS body,
  arg_min('/c/' || turn, turn) FILTER (WHERE turn % 2 = 1) AS link
FROM s WHERE segment > 0 GROUP BY conv_id, segment
""")
def _(t):
    rows = t.raw("conversations").withColumn(
        "link", F.when(F.col("turn") % 2 == 1, F.concat(F.lit("/c/"), F.col("turn").cast("string"))))
    return plain(W.segment(rows, ["conv_id"], "turn", F.col("role") == "user", "text", "link"))


@query("w3_expand_day_tokens", """
SELECT id, CAST(m AS BIGINT) AS month, CAST(d AS BIGINT) AS day FROM (
  SELECT id, 8 AS m, 3 AS d FROM listings UNION ALL SELECT id, 8, 17 FROM listings
  UNION ALL SELECT id, month(event_date), day(event_date) FROM listings
    WHERE NOT (month(event_date) = 8 AND day(event_date) IN (3, 17)))
""", "listings")
def _(t):
    text = F.concat(F.lit("The 9th: August 3rd, 17th and 3rd, "), F.date_format("event_date", "MMMM d"), F.lit("th."))
    rows = t.listings.select("id", text.alias("x"))
    return plain(W.expand_day_tokens(rows, "x").select("id", "month", "day"))


FIRST = """SELECT id, source, category FROM (SELECT *, row_number() OVER (PARTITION BY source, category ORDER BY {0}) AS rn
  FROM listings) WHERE rn <= {1}"""


@query("w4_first_per_key", FIRST.format("event_date, id", 1), "listings")
def _(t):
    return W.first_per_key(t.listings, ["source", "category"], ["event_date", "id"]).select("id", "source", "category")


@query("w5_last_per_key", FIRST.format("event_date DESC, id DESC", 1), "listings")
def _(t):
    return W.last_per_key(t.listings, ["source", "category"], ["event_date", "id"]).select("id", "source", "category")


@query("w7_cap_per_group", FIRST.format("event_date, id", 4), "listings")
def _(t):
    return W.cap_per_group(t.listings, ["source", "category"], ["event_date", "id"], 4).select("id", "source", "category")


@query("w8_regroup", """
SELECT conv_id, CAST(conv_id % 7 AS BIGINT) AS weekday,
  arg_min(trim(regexp_replace(text, '[\\s\\x{a0}]+', ' ', 'g')), turn) AS title,
  CAST(count(*) AS BIGINT) AS parts FROM conversations WHERE trim(text) <> '' GROUP BY conv_id
""")
def _(t):
    names = F.array(*[F.lit(d) for d in V.WEEKDAYS])
    c = t.raw("conversations").select("conv_id", "turn", "text")
    day = c.groupBy("conv_id").agg(F.lit(1).cast("bigint").alias("turn")).select(
        "conv_id", "turn", F.upper(F.get(names, (F.col("conv_id") % 7).cast("int"))).alias("text"))
    rows = c.withColumn("turn", F.col("turn") * 2).unionByName(day)
    grouped = W.regroup(rows, ["conv_id"], "turn", "text")
    counts = c.where(F.trim("text") != "").groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts"))
    return plain(grouped.join(counts, "conv_id").select("conv_id", "weekday", "title", "parts"))


@query("u1_union_sources", """
SELECT id, title, coalesce(source, 'none') AS source, coalesce(price, -1) AS price FROM (
  SELECT id, title, source, CAST(NULL AS DOUBLE) AS price FROM listings WHERE id % 3 = 0
  UNION ALL SELECT id, title, NULL, round(price, 2) FROM listings WHERE id % 3 = 1
  UNION ALL SELECT id, title, source, round(price, 2) FROM listings_incoming)
""", "listings_incoming")
def _(t):
    a = t.listings.where("id % 3 = 0").select("id", "title", "source")
    b = t.listings.where("id % 3 = 1").select("title", "id", "price")
    both = U.union_sources([a, b, t.incoming.select("id", "price", "title", "source")])
    return both.select("id", "title", F.coalesce("source", F.lit("none")).alias("source"),
                       F.coalesce(F.round("price", 2), F.lit(-1.0)).alias("price"))


@query("u2_difference", """
SELECT id FROM listings WHERE id NOT IN (SELECT id - 100000000 FROM listings_incoming)
""", "listings_incoming")
def _(t):
    kept = t.incoming.select((F.col("id") - 100000000).alias("id"))
    return U.difference(t.listings, kept).select("id")


@query("u3_distinct_values", "SELECT DISTINCT address FROM listings WHERE address <> ''", "listings")
def _(t):
    return U.distinct_values(t.listings, "address")


@query("u5_with_fallback", """
SELECT id, source FROM listings WHERE source IN ('NATION_1', 'NATION_2')
UNION ALL SELECT id, source FROM listings_incoming WHERE source NOT IN (SELECT source FROM listings WHERE source IN ('NATION_1', 'NATION_2'))
""", "listings_incoming")
def _(t):
    first = t.listings.where(F.col("source").isin("NATION_1", "NATION_2")).select("id", "source")
    return U.with_fallback(first, t.incoming.select("id", "source"))


# Calendar entries made from the listings: weekly on two days every second
# week, counted every third day, or single.
LOW, HIGH = "1998-06-17 10:30:00", "1998-09-30 23:59:59"
RRULE_SQL = f"""
WITH base AS (SELECT id, event_date AS s, CAST(event_date AS DATE) AS d0, source FROM listings),
 days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '2003-12-31', INTERVAL 1 DAY)) AS DATE) AS d),
 occ AS (
  SELECT b.id, b.source, d + (s - CAST(d0 AS TIMESTAMP)) AS moment FROM base b JOIN days ON d >= d0
   WHERE id % 3 = 0 AND isodow(d) IN (1, 4)
     AND (date_diff('day', CAST(date_trunc('week', d0) AS DATE), CAST(date_trunc('week', d) AS DATE)) // 7) % 2 = 0
     AND d <> DATE '1998-07-06'
  UNION ALL
  SELECT b.id, b.source, d + (s - CAST(d0 AS TIMESTAMP)) FROM base b JOIN days ON d >= d0
   WHERE id % 3 = 1 AND d <> DATE '1998-07-06' AND date_diff('day', d0, d) % 3 = 0 AND date_diff('day', d0, d) < 30
  UNION ALL SELECT id, source, s FROM base WHERE id % 3 = 2)
"""


def _vevents(t):
    k = F.col("id") % 3
    start = F.date_format("event_date", "yyyyMMdd'T'HHmmss")
    end = F.date_format(D.plus("event_date", 90, "MINUTE"), "yyyyMMdd'T'HHmmss")
    rule = F.when(k == 0, "FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,TH").when(k == 1, "FREQ=DAILY;INTERVAL=3;COUNT=10")
    base = {"UID": F.col("id").cast("string"), "DTSTART;TZID=America/Los_Angeles": start, "DTEND": end}
    pairs = [x for name, c in base.items() for x in (F.lit(name), c)]
    props = F.create_map(*pairs)
    exdate = F.create_map(F.lit("EXDATE;TZID=America/Los_Angeles"),
                          F.concat(F.lit("19980706T"), F.date_format("event_date", "HHmmss")))
    props = F.when(rule.isNull(), props).otherwise(F.map_concat(props, exdate, F.create_map(F.lit("RRULE"), rule)))
    return dealt(t.listings).select(F.col("source").alias("feed"), F.col("id").alias("block"), props.alias("props"))


@query("r1_expand_rrule", f"""{RRULE_SQL}
SELECT id AS block, {TS.format('moment')} AS start, {TS.format("moment + INTERVAL '90' MINUTE")} AS "end"
FROM occ WHERE moment BETWEEN TIMESTAMP '{LOW}' AND TIMESTAMP '{HIGH}'
""".strip(), "listings")
def _(t):
    return plain(R.expand_rrule(_vevents(t), LOW, HIGH).select("block", "start", "end"))


@query("r2_next_occurrence", f"""{RRULE_SQL}
SELECT id AS block, {TS.format('min(moment)')} AS start FROM occ WHERE moment + INTERVAL '90' MINUTE >= TIMESTAMP '{LOW}' GROUP BY id
""".strip(), "listings")
def _(t):
    return plain(R.next_occurrence(_vevents(t), LOW).select("block", "start"))


# Rules of many parts, an UNTIL, an override by another entry, and rules that are not read.
PARTS = [
    "FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1", "FREQ=MONTHLY;BYDAY=FR;BYMONTHDAY=13", "FREQ=WEEKLY;BYMONTH=6,7",
    "FREQ=MONTHLY;BYMONTHDAY=-1;INTERVAL=2", "FREQ=YEARLY;BYMONTH=11;BYDAY=4TH", "FREQ=YEARLY;UNTIL=20010101T000000",
    "FREQ=WEEKLY;INTERVAL=2;WKST=SU;BYDAY=SU,MO", "FREQ=MONTHLY;BYDAY=-1SU,2TU", "FREQ=YEARLY;BYWEEKNO=20", "FREQ=YEARLY;INTERVAL=4",
]
MONTHS_ON = "(year(d) * 12 + month(d) - year(d0) * 12 - month(d0))"
PARTS_SQL = f"""
WITH base AS (SELECT id, source, event_date AS s, CAST(event_date AS DATE) AS d0, id % {len(PARTS)} AS k FROM listings),
 days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1999-01-01', TIMESTAMP '2003-12-31', INTERVAL 1 DAY)) AS DATE) AS d),
 occ AS (
  SELECT id, k, d, d + (s - CAST(d0 AS TIMESTAMP)) AS moment FROM base JOIN days ON d >= d0 AND CASE k
   WHEN 0 THEN d = last_day(d) - CASE isodow(last_day(d)) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END
   WHEN 1 THEN day(d) = 13 AND isodow(d) = 5
   WHEN 2 THEN isodow(d) = isodow(d0) AND month(d) IN (6, 7)
   WHEN 3 THEN d = last_day(d) AND {MONTHS_ON} % 2 = 0
   WHEN 4 THEN month(d) = 11 AND isodow(d) = 4 AND day(d) BETWEEN 22 AND 28
   WHEN 5 THEN month(d) = month(d0) AND day(d) = day(d0) AND d + (s - CAST(d0 AS TIMESTAMP)) <= TIMESTAMP '2001-01-01'
   WHEN 6 THEN isodow(d) IN (7, 1) AND ((d - CAST(isodow(d) % 7 AS INT)) - (d0 - CAST(isodow(d0) % 7 AS INT))) % 14 = 0
   WHEN 7 THEN (isodow(d) = 7 AND day(d) > day(last_day(d)) - 7) OR (isodow(d) = 2 AND day(d) BETWEEN 8 AND 14)
   WHEN 9 THEN month(d) = month(d0) AND day(d) = day(d0) AND (year(d) - year(d0)) % 4 = 0
   ELSE false END)
"""


def _ruled(t):
    rules = F.array(*[F.lit(r) for r in PARTS])
    k = (F.col("id") % len(PARTS)).cast("int")
    start = F.date_format("event_date", "yyyyMMdd'T'HHmmss")
    props = F.create_map(F.lit("UID"), F.col("id").cast("string"), F.lit("DTSTART"), start, F.lit("RRULE"), F.get(rules, k))
    series = dealt(t.listings).select(F.col("source").alias("feed"), F.col("id").alias("block"), props.alias("props"))
    # one occurrence of each weekly series in June is moved by an entry of its own
    moved = F.date_add(F.lit("2000-06-05").cast("date"), F.pmod(F.weekday("event_date"), F.lit(7)))
    at = F.concat(F.date_format(moved, "yyyyMMdd"), F.date_format("event_date", "'T'HHmmss"))
    own = F.create_map(F.lit("UID"), F.col("id").cast("string"), F.lit("DTSTART"), F.lit("20000701T120000"), F.lit("RECURRENCE-ID"), at)
    changed = t.listings.where(k == 2).select(
        F.col("source").alias("feed"), (-F.col("id")).alias("block"), own.alias("props"))
    return series.unionByName(changed)


@query("r1_rule_parts", f"""{PARTS_SQL}
SELECT id AS block, {TS.format('moment')} AS start FROM occ WHERE NOT (k = 2 AND d BETWEEN DATE '2000-06-05' AND DATE '2000-06-11')
UNION ALL SELECT -id, '2000-07-01 12:00:00' FROM base WHERE k = 2
""".strip(), "listings")
def _(t):
    return plain(R.expand_rrule(_ruled(t), "1999-01-01 00:00:00", "2003-12-31 23:59:59").select("block", "start"))


@query("r1_unread_rules", "SELECT id AS block, 'BYWEEKNO' AS reason FROM listings WHERE id % 10 = 8", "listings")
def _(t):
    return R.unread_rules(_ruled(t)).select("block", "reason")


@query("r2_next_of_rule_parts", f"""{PARTS_SQL}
SELECT id AS block, {TS.format('min(moment)')} AS start FROM occ GROUP BY id
UNION ALL SELECT -id, '2000-07-01 12:00:00' FROM base WHERE k = 2
""".strip(), "listings")
def _(t):
    return plain(R.next_occurrence(_ruled(t), "1999-01-01 00:00:00").select("block", "start"))


@query("r3_expand_series", f"""
WITH base AS (SELECT id, event_date AS s, end_date AS e, url, id % 7 AS wd,
    CASE WHEN id % 4 = 0 THEN TRUE ELSE FALSE END AS named, epoch(end_date - event_date) / 86400 AS span FROM listings),
 days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1998-06-17', TIMESTAMP '1998-08-12', INTERVAL 1 DAY)) AS DATE) AS d)
SELECT id, {TS.format('d + (s - CAST(CAST(s AS DATE) AS TIMESTAMP))')} AS event_date, NULL AS end_date,
  CASE WHEN url = '' THEN '' ELSE url || '#' || strftime(d, '%Y-%m-%d') END AS url
FROM base JOIN days ON named AND span > 2 AND isodow(d) - 1 = wd AND d >= CAST(s AS DATE) AND d <= CAST(e AS DATE)
UNION ALL
SELECT id, {TS.format('s')}, CASE WHEN NOT named AND span > 7 THEN NULL ELSE {TS.format('e')} END, url
FROM base WHERE NOT (named AND coalesce(span, 0) > 2)
""".strip(), "listings")
def _(t):
    names = F.array(*[F.lit(d) for d in V.WEEKDAYS])
    name = F.get(names, (F.col("id") % 7).cast("int"))
    told = F.when(F.col("id") % 8 == 0, F.concat("title", F.lit(" every "), F.initcap(name))).when(
        F.col("id") % 8 == 4, F.concat(F.upper(name), F.lit("s: "), "title"))
    rows = t.listings.withColumn("title", told.otherwise(F.col("title")))
    return plain(R.expand_series(rows, AS_OF).select("id", "event_date", "end_date", "url"))


@query("r4_weekly", f"""
SELECT id, {TS.format("d + INTERVAL '1' MINUTE * CAST(m AS INT)")} AS start FROM (SELECT id, id % 7 AS wd, (id % 24) * 60 AS m FROM listings)
JOIN (SELECT CAST(unnest(generate_series(TIMESTAMP '1998-06-17', TIMESTAMP '1998-07-22', INTERVAL 1 DAY)) AS DATE) AS d) days
ON isodow(d) - 1 = wd AND (wd <> 2 OR (m // 60 <= 10 AND d > DATE '1998-06-17') OR (m // 60 > 10 AND d < DATE '1998-07-15'))
 AND (wd = 2 OR d < DATE '1998-07-15') AND d <= DATE '1998-07-15'
""", "listings")
def _(t):
    rows = t.listings.select("id", (F.col("id") % 7).alias("weekday"), ((F.col("id") % 24) * 60).cast("int").alias("start_min"))
    return plain(R.weekly(rows, AS_OF).select("id", "start"))


@query("r5_expand_schedule", f"""
WITH n AS (SELECT id, event_date AS s, end_date AS e, CAST(event_date AS DATE) AS ss, CAST(end_date AS DATE) AS se, id % 3 AS k, id % 7 AS wd,
    CASE WHEN id % 2 = 0 THEN 19 * 60 + 30 ELSE hour(event_date) * 60 END AS m FROM listings),
 days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1998-06-17', TIMESTAMP '1998-08-16', INTERVAL 1 DAY)) AS DATE) AS d)
SELECT id, {TS.format('s')} AS occurs FROM n WHERE k = 0 AND coalesce(e, s) >= TIMESTAMP '1998-06-17 10:30:00'
UNION ALL
SELECT id, {TS.format("d + INTERVAL '1' MINUTE * CAST(m AS INT)")} FROM n JOIN days ON k = 1 AND isodow(d) - 1 IN (wd, (wd + 2) % 7) AND d >= ss
WHERE d + INTERVAL '1' MINUTE * CAST(m AS INT) >= TIMESTAMP '1998-06-17 10:30:00' AND (se IS NULL OR d + INTERVAL '1' MINUTE * CAST(m AS INT) <= se + INTERVAL 1 DAY)
""".strip(), "listings")
def _(t):
    names = F.array(*[F.lit(f"https://schema.org/{d.title()}") for d in V.WEEKDAYS])
    k = F.col("id") % 3
    by_day = F.when(k > 0, F.array(F.get(names, (F.col("id") % 7).cast("int")),
                                   F.get(names, ((F.col("id") + 2) % 7).cast("int"))))
    nodes = t.listings.select(
        "id", F.col("event_date").alias("start"), F.col("end_date").alias("end"), by_day.alias("by_day"),
        F.when(k == 1, "P1W").otherwise("P1M").alias("frequency"),
        F.when(F.col("id") % 2 == 0, 19 * 60 + 30).alias("start_min"),
        F.to_date("event_date").alias("series_start"), F.to_date("end_date").alias("series_end"))
    return plain(R.expand_schedule(nodes, AS_OF).select("id", "occurs"))


@query("r6_expand_text_series", """
WITH n AS (SELECT id, id % 3 AS k FROM listings),
 days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1998-06-17', TIMESTAMP '1998-08-26', INTERVAL 1 DAY)) AS DATE) AS d)
SELECT id, strftime(d, '%Y-%m-%d 17:00:00') AS start, strftime(d, '%Y-%m-%d 20:00:00') AS "end" FROM n JOIN days ON k = 0 AND isodow(d) = 3 AND d >= DATE '1998-07-08'
UNION ALL SELECT id, '1998-08-04 19:00:00', NULL FROM n WHERE k = 1
""".strip(), "listings")
def _(t):
    k = F.col("id") % 3
    text = F.when(k == 0, F.concat("title", F.lit(": Wednesdays, July 8 - August 26, 5-8pm"))).when(
        k == 1, "Tuesday, August 4th at 7pm").otherwise("every so often")
    rows = dealt(t.listings).select("id", text.alias("schedule"))
    return plain(R.expand_text_series(rows, AS_OF).select("id", "start", "end"))


PLACES = {"venice": [("Room Venice", "1 A St")], "malibu": [("Room Malibu", "2 B St")],
          "all": [("Room Venice", "1 A St"), ("Room Malibu", "2 B St")]}


@query("r7_fan_out", """
SELECT id, venue_name, address FROM listings_raw JOIN (VALUES ('venice', 'Room Venice', '1 A St'), ('malibu', 'Room Malibu', '2 B St'),
  ('all', 'Room Venice', '1 A St'), ('all', 'Room Malibu', '2 B St')) p(loc2, venue_name, address) ON loc2 = loc
""".replace("listings_raw", "(SELECT id, CASE id % 4 WHEN 0 THEN 'venice' WHEN 1 THEN 'malibu' WHEN 2 THEN 'all' ELSE 'venice' END AS loc FROM listings)"),
       "listings")
def _(t):
    k = F.col("id") % 4
    loc = F.when(k == 0, "venice").when(k == 1, "malibu").when(k == 2, "all").otherwise("mars")
    rows = t.listings.withColumn("loc", loc)
    return R.fan_out(rows, "loc", PLACES, "venice").select("id", "venue_name", "address")


@query("s15_fixed_schedule", """
SELECT n_name AS title, strftime(d, '%Y-%m-%d 08:30:00') AS event_date, strftime(d, '%Y-%m-%d 13:00:00') AS end_date
FROM nation JOIN (SELECT CAST(unnest(generate_series(TIMESTAMP '1998-06-17', TIMESTAMP '1998-08-11', INTERVAL 1 DAY)) AS DATE) AS d) days
  ON isodow(d) - 1 = n_nationkey % 7
""")
def _(t):
    markets = t.raw("nation").select(
        F.col("n_name").alias("name"), (F.col("n_nationkey") % 7).alias("weekday"),
        F.lit("8:30am-1pm").alias("hours"), F.lit("Corner").alias("location"), F.lit("1 A St").alias("address"))
    return plain(R.from_fixed_schedule(markets, AS_OF).select("title", "event_date", "end_date"))
