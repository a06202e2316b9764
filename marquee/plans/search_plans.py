"""Checked queries: scans, filters, facets, paging."""

from datetime import date

from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.functions import text as X
from marquee.operators import facet_cube as K
from marquee.operators import facets as A
from marquee.operators import listings as L
from marquee.operators import phrases as P
from marquee.operators import search as S
from marquee.plans.catalog import plain, query
from marquee.plans.views import AS_OF
from marquee.session import job_folder

TS = "strftime(event_date, '%Y-%m-%d %H:%M:%S')"
BASE_COLS = ["id", "title", "event_date", "category", "source"]
BASE_SQL = f"id, title, {TS} AS event_date, category, source"


def show(df, *cols):
    return plain(df.select(*(cols or BASE_COLS)))


@query("s1_all_listings", f"""
SELECT {BASE_SQL} FROM listings ORDER BY listings.event_date, id LIMIT 200 OFFSET 50
""", "listings")
def _(t):
    return show(L.all_listings(t.listings, 200, 50))


@query("s1_all_listings_unlimited", f"SELECT {BASE_SQL} FROM listings", "listings")
def _(t):
    return show(L.all_listings(t.listings))


@query("s2_get_listing", f"SELECT {BASE_SQL} FROM listings WHERE id = 42", "listings")
def _(t):
    return show(L.get_listing(t.listings, 42))


@query("s3_existing_keys", f"""
SELECT {BASE_SQL} FROM listings_incoming i
WHERE EXISTS (SELECT 1 FROM listings s WHERE s.url = i.url AND s.event_date = i.event_date)
""", "listings_incoming")
def _(t):
    return show(L.existing_keys(t.incoming, t.listings))


@query("s4_enabled_sources", """
SELECT source, CAST(count(*) AS BIGINT) AS n FROM listings
WHERE source IN (SELECT n_name FROM nation WHERE n_nationkey % 3 <> 0)
GROUP BY source
""", "listings")
def _(t):
    config = t.raw("nation").select(
        F.col("n_name").alias("name"), (F.col("n_nationkey") % 3 != 0).alias("enabled")
    )
    return L.feeds_of(t.listings, L.enabled_sources(config)).groupBy("source").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("s16_decode_rows", """
SELECT id, title, coalesce(description, '') AS description, coalesce(category, '') AS category,
  source, CASE WHEN is_free IS NULL THEN FALSE ELSE is_free END AS is_free, 'westside' AS region,
  '' AS price_note
FROM listings
""", "listings")
def _(t):
    old = t.listings.drop("region", "price_note", "source_logo_url")
    return L.decode_rows(old).select(
        "id", "title", "description", "category", "source", "is_free", "region", "price_note"
    )


FLAGSHIP_WHERE = """
event_date >= TIMESTAMP '1998-06-17 00:00:00' AND category IN ('Music', 'Art', 'Family')
  AND is_free AND (region IS NULL OR region = 'westside')
  AND ((latitude IS NULL OR latitude BETWEEN 33.90 AND 34.15)
   AND (longitude IS NULL OR longitude BETWEEN -118.75 AND -118.33)
   OR lower(venue_name) LIKE '%io music academy%')
"""


@query("f1_search", f"""
SELECT {BASE_SQL}, round(latitude, 6) AS latitude FROM listings WHERE {FLAGSHIP_WHERE}
ORDER BY listings.event_date, id LIMIT 100
""", "listings")
def _(t):
    found = S.search(
        t.listings, date_filter="upcoming", categories=["Music", "Art", "Family"], is_free=True,
        bbox=V.SEARCH_BOX, region="westside", as_of=AS_OF,
    )
    return show(found, *BASE_COLS, "latitude")


@query("f1_search_all_filters", f"""
SELECT {BASE_SQL}, venue_name FROM listings
WHERE event_date >= TIMESTAMP '1998-06-17' AND category IN ('Music', 'Tech')
  AND source IN ('NATION_3', 'NATION_7', 'NATION_11', 'NATION_15', 'NATION_19')
  AND hour(event_date) IN (17, 18, 19, 20, 21, 22, 23)
  AND is_free = FALSE AND lower(description) LIKE '%wine tasting%'
ORDER BY listings.event_date, id LIMIT 50 OFFSET 5
""", "listings")
def _(t):
    found = S.search(
        t.listings, q="Wine tasting", date_filter="upcoming", categories=["Music", "Tech"],
        sources=["NATION_3", "NATION_7", "NATION_11", "NATION_15", "NATION_19"],
        times_of_day=["evening", "night"], is_free=False, limit=50, offset=5, as_of=AS_OF,
    )
    return show(found, *BASE_COLS, "venue_name")


def _span(day):
    return (
        f"(CAST(event_date AS DATE) = DATE '{day}' OR (CAST(event_date AS DATE) >= DATE '1998-03-19'"
        f" AND CAST(event_date AS DATE) <= DATE '{day}' AND CAST(end_date AS DATE) >= DATE '{day}'"
        " AND end_date IS NOT NULL))"
    )


CALENDAR = {
    "today": _span("1998-06-17"),
    "tomorrow": _span("1998-06-18"),
    "today_tomorrow": "CAST(event_date AS DATE) BETWEEN DATE '1998-06-17' AND DATE '1998-06-18'",
    "this_week": "CAST(event_date AS DATE) >= DATE '1998-06-17' AND CAST(event_date AS DATE) < DATE '1998-06-28'",
    "this_weekend": "CAST(event_date AS DATE) IN (DATE '1998-06-20', DATE '1998-06-28')",
    "this_month": "strftime(event_date, '%Y-%m') = '1998-06'",
    "specific_date": "event_date >= TIMESTAMP '1998-07-04' AND event_date < TIMESTAMP '1998-07-05'",
    "upcoming": "CAST(event_date AS DATE) >= DATE '1998-06-17'",
}
for _kind, _where in CALENDAR.items():

    @query(f"f2_{_kind}", f"SELECT {BASE_SQL} FROM listings WHERE {_where}", "listings")
    def _(t, kind=_kind):
        return show(t.listings.where(S.date_predicate(kind, AS_OF, "1998-07-04")))


WINDOWS = {
    "today": ("1998-06-17", "1998-06-18"),
    "tomorrow": ("1998-06-18", "1998-06-19"),
    "this_week": ("1998-06-17", "1998-06-22"),
    "this_weekend": ("1998-06-20", "1998-06-22"),
    "this_month": ("1998-06-17", "1998-07-01"),
    "next_month": ("1998-07-01", "1998-08-01"),
}
for _kind, (_a, _b) in WINDOWS.items():

    @query(f"f3_window_{_kind}", f"""
    SELECT {BASE_SQL} FROM listings
    WHERE event_date >= TIMESTAMP '{_a}' AND event_date < TIMESTAMP '{_b}'
    """, "listings")
    def _(t, kind=_kind):
        return show(S.in_calendar_window(t.listings, kind, AS_OF))


@query("f4_active_on", f"SELECT {BASE_SQL} FROM listings WHERE {_span('1998-06-25')}", "listings")
def _(t):
    return show(t.listings.where(S.active_on(date(1998, 6, 25), AS_OF)))


@query("f5_bad_date_is_upcoming", f"SELECT {BASE_SQL} FROM listings WHERE {CALENDAR['upcoming']}",
       "listings")
def _(t):
    return show(t.listings.where(S.date_predicate("specific_date", AS_OF, "soon")))


@query("f6_between_dates", f"""
SELECT {BASE_SQL} FROM listings
WHERE event_date >= TIMESTAMP '1997-01-01 12:00:00' AND event_date < TIMESTAMP '1997-03-01'
""", "listings")
def _(t):
    return show(t.listings.where(S.between_dates("1997-01-01 12:00:00", "1997-03-01")))


@query("f7_date_range", f"""
SELECT {BASE_SQL} FROM listings
WHERE event_date BETWEEN TIMESTAMP '1996-02-01' AND TIMESTAMP '1996-02-29 23:00:00'
""", "listings")
def _(t):
    return show(S.date_range(t.listings, "1996-02-01", "1996-02-29 23:00:00"))


@query("f8_upcoming", f"""
SELECT {BASE_SQL} FROM listings WHERE event_date >= TIMESTAMP '1998-06-17 10:30:00'
ORDER BY listings.event_date, id LIMIT 75
""", "listings")
def _(t):
    return show(S.upcoming(t.listings, AS_OF, 75))


@query("f9_in_lists", f"""
SELECT {BASE_SQL} FROM listings WHERE category IN ('Art', 'Tech')
  AND venue_name IN ('Venue 4 Theater', 'Venue 9 Gallery', 'Venue 15')
""", "listings")
def _(t):
    return show(S.search(t.listings, categories=["Art", "Tech"], limit=None,
                         venues=["Venue 4 Theater", "Venue 9 Gallery", "Venue 15"]))


@query("f10_region", """
SELECT coalesce(region, 'none') AS region, CAST(count(*) AS BIGINT) AS n FROM listings
WHERE region IS NULL OR region = 'westside' GROUP BY 1
""", "listings")
def _(t):
    kept = t.listings.where(S.in_region("westside"))
    return kept.groupBy(F.coalesce("region", F.lit("none")).alias("region")).agg(
        F.count(F.lit(1)).alias("n"))


@query("f11_free_flag", f"SELECT {BASE_SQL} FROM listings WHERE is_free", "listings")
def _(t):
    return show(S.search(t.listings, is_free=True, limit=None))


@query("f12_time_of_day", f"""
SELECT {BASE_SQL} FROM listings WHERE hour(event_date) BETWEEN 5 AND 11 OR hour(event_date) >= 21
""", "listings")
def _(t):
    return show(t.listings.where(S.time_of_day(["morning", "night", "dusk"])))


@query("f13_in_bounds", f"""
SELECT {BASE_SQL} FROM listings
WHERE ((latitude IS NULL OR latitude BETWEEN 33.90 AND 34.15)
   AND (longitude IS NULL OR longitude BETWEEN -118.75 AND -118.33))
   OR lower(venue_name) LIKE '%venue 39%'
""", "listings")
def _(t):
    return show(t.listings.where(S.in_bounds(V.SEARCH_BOX, ["venue 39"])))


@query("f14_phrase_search", """
SELECT doc_id FROM documents
WHERE ' ' || array_to_string(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+'), ' ') || ' '
  LIKE '% of the %'
""")
def _(t):
    docs = t.raw("documents")
    return docs.where(S.phrase_match("Of  THE", ["text"])).select("doc_id")


@query("f15_clean_params", f"""
SELECT {BASE_SQL} FROM listings WHERE {CALENDAR['upcoming']}
  AND hour(event_date) IN (17, 18, 19, 20)
ORDER BY listings.event_date, id LIMIT 5000
""", "listings")
def _(t):
    p = S.clean_params(limit=99999, date_filter="someday", times_of_day=["evening", "noon"],
                       region="mars")
    p.pop("days")
    return show(S.search(t.listings, as_of=AS_OF, **p))


PRESET_WHERE = {
    "weekend": CALENDAR["this_weekend"],
    "free": f"is_free AND {CALENDAR['upcoming']}",
    "family": f"category = 'Family' AND {CALENDAR['upcoming']}",
    "date-night": f"{CALENDAR['upcoming']} AND hour(event_date) BETWEEN 17 AND 23"
                  " AND category IN ('Music', 'Theater', 'Film', 'Food & Drink', 'Comedy')",
}
for _name, _where in PRESET_WHERE.items():

    @query(f"f16_preset_{_name.replace('-', '_')}",
           f"SELECT {BASE_SQL} FROM listings WHERE {_where}", "listings")
    def _(t, name=_name):
        return show(S.preset(t.listings, name, AS_OF, limit=None))


@query("f17_by_category", f"SELECT {BASE_SQL} FROM listings WHERE category = 'Music'", "listings")
def _(t):
    return show(S.by_category(t.listings, "Music"))


@query("f22_drop_past", f"""
SELECT {BASE_SQL} FROM listings
WHERE coalesce(end_date, event_date) >= TIMESTAMP '1998-06-17 10:30:00'
""", "listings")
def _(t):
    return show(S.drop_past(t.listings, AS_OF))


@query("f23_drop_inactive", """
SELECT o_orderkey AS id, o_orderpriority AS mode FROM orders
WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AND o_orderkey % 4 <> 0
""")
def _(t):
    feed = t.raw("orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "P", "EventCancelled").otherwise("Scheduled").alias("status"),
        F.when(F.col("o_orderpriority") == "5-LOW", "Virtual")
        .otherwise(F.col("o_orderpriority")).alias("mode"),
        (F.col("o_orderkey") % 4 != 0).alias("stock"),
    )
    return S.drop_inactive(feed, "status", "mode", "stock").select("id", "mode")


@query("f24_clamp_display_date", f"""
SELECT id, title, strftime(CASE WHEN end_date IS NOT NULL AND event_date < TIMESTAMP '1998-06-18'
    THEN TIMESTAMP '1998-06-18' ELSE event_date END, '%Y-%m-%d %H:%M:%S') AS event_date
FROM listings WHERE {_span('1998-06-18')}
""", "listings")
def _(t):
    found = t.listings.where(S.date_predicate("tomorrow", AS_OF))
    return show(S.clamp_display_date(found, "tomorrow", AS_OF), "id", "title", "event_date")


@query("f25_map_points", """
SELECT id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM listings
WHERE latitude <> 0 AND longitude <> 0
""", "listings")
def _(t):
    return show(S.map_points(t.listings), "id", "latitude", "longitude")


@query("f26_missing_coords", """
SELECT id, title, venue_name, address, source FROM listings
WHERE latitude IS NULL OR longitude IS NULL
""", "listings")
def _(t):
    return S.missing_coords(t.listings)


@query("f27_hero_image", """
SELECT id, image_url <> '' AND image_url <> source_logo_url AND image_url NOT LIKE '/static/logos/%' AS hero
FROM (SELECT id, CASE id % 10 WHEN 1 THEN source_logo_url WHEN 2 THEN '/static/logos/x.png'
        ELSE image_url END AS image_url, source_logo_url FROM listings)
""", "listings")
def _(t):
    k = F.col("id") % 10
    mixed = t.listings.withColumn(
        "image_url",
        F.when(k == 1, F.col("source_logo_url")).when(k == 2, "/static/logos/x.png")
        .otherwise(F.col("image_url")))
    return mixed.select("id", S.is_hero_image().alias("hero"))


@query("f28_in_targets", f"""
SELECT {BASE_SQL} FROM listings
WHERE (lower(title) LIKE '%widget%' OR lower(title) LIKE '%brand#1%')
  AND lower(trim(source)) IN (SELECT lower(n_name) FROM nation WHERE n_regionkey = 1)
""", "listings")
def _(t):
    targets = t.raw("nation").where("n_regionkey = 1").select(F.col("n_name").alias("name"))
    kept = S.in_targets(t.listings, "title", ["Widget", "Brand#1"])
    return show(S.in_target_set(kept, "source", targets))


BOXED = """source IS NOT NULL AND category IS NOT NULL
  AND (latitude IS NULL OR (latitude >= 33.90 AND latitude <= 34.15))
  AND (longitude IS NULL OR (longitude >= -118.75 AND longitude <= -118.33))
  AND CAST(event_date AS DATE) >= DATE '1998-06-17'"""
PICKED = {"categories": ["Music", "Art"], "sources": ["NATION_1", "NATION_2", "NATION_5"]}
IN_CAT, IN_SRC = "category IN ('Music', 'Art')", "source IN ('NATION_1', 'NATION_2', 'NATION_5')"


@query("a1_facet_categories", f"""
SELECT category, CAST(count(*) AS BIGINT) AS n FROM listings WHERE {BOXED} AND {IN_SRC} GROUP BY 1
""", "listings")
def _(t):
    return A.facet_categories(t.listings, AS_OF, **PICKED)


@query("a2_facet_venues", f"""
SELECT venue_name, CAST(count(*) AS BIGINT) AS n FROM listings
WHERE {BOXED} AND {IN_CAT} AND is_free AND venue_name <> '' GROUP BY 1 HAVING count(*) >= 3
""", "listings")
def _(t):
    return A.facet_venues(t.listings, AS_OF, free_only=True, **PICKED)


@query("a3_facet_free", f"""
SELECT CAST(count(*) AS BIGINT) AS n FROM listings WHERE {BOXED} AND {IN_CAT} AND {IN_SRC} AND is_free
""", "listings")
def _(t):
    return A.facet_free(t.listings, AS_OF, **PICKED)


TALLIES = f"""
SELECT 'category' AS facet, category AS name, CAST(count(*) AS BIGINT) AS n FROM listings
WHERE {BOXED} AND is_free AND {IN_SRC} GROUP BY 2
UNION ALL
SELECT 'venue', venue_name, CAST(count(*) AS BIGINT) FROM listings
WHERE {BOXED} AND is_free AND {IN_CAT} AND venue_name <> '' GROUP BY 2 HAVING count(*) >= 3
UNION ALL
SELECT 'free', NULL, CAST(count(*) AS BIGINT) FROM listings
WHERE {BOXED} AND is_free AND {IN_CAT} AND {IN_SRC}
"""


@query("a4_filter_tallies", TALLIES, "listings")
def _(t):
    return A.filter_tallies(t.listings, AS_OF, free_only=True, **PICKED)


@query("a5_visible_categories", f"""
SELECT CAST(CASE category WHEN 'Music' THEN 0 WHEN 'Art' THEN 1 WHEN 'Food & Drink' THEN 2
         WHEN 'Family' THEN 4 ELSE 12 END AS BIGINT) AS ord, category, CAST(count(*) AS BIGINT) AS n
FROM listings WHERE {BOXED} GROUP BY category
""", "listings")
def _(t):
    counts = A.facet_categories(t.listings, AS_OF)
    return plain(A.visible_categories(counts).select("ord", "category", "n"))


@query("a6_selected_totals", f"""
SELECT CAST((SELECT count(DISTINCT category) FROM listings WHERE {BOXED}) AS BIGINT) AS category_options,
  CAST((SELECT count(*) FROM listings WHERE {BOXED} AND category IN ('Music', 'Tech')) AS BIGINT) AS category_listings,
  CAST((SELECT count(*) FROM (SELECT venue_name FROM listings WHERE {BOXED} AND venue_name <> ''
        GROUP BY 1 HAVING count(*) >= 3)) AS BIGINT) AS venue_options,
  CAST((SELECT CASE WHEN count(*) >= 3 THEN count(*) ELSE 0 END FROM listings WHERE {BOXED} AND venue_name = 'Venue 6') AS BIGINT) AS venue_listings
""", "listings")
def _(t):
    return A.selected_totals(A.filter_tallies(t.listings, AS_OF), ["Music", "Tech"], ["Venue 6"])


HERO = """
SELECT CAST(count(*) FILTER (WHERE CAST(event_date AS DATE) >= DATE '1998-06-17') AS BIGINT) AS upcoming,
  CAST(count(*) FILTER (WHERE CAST(event_date AS DATE) = DATE '1998-06-17'
    OR (end_date IS NOT NULL AND CAST(event_date AS DATE) <= DATE '1998-06-17'
        AND CAST(end_date AS DATE) >= DATE '1998-06-17')) AS BIGINT) AS active_today,
  CAST(count(DISTINCT source) FILTER (WHERE CAST(event_date AS DATE) >= DATE '1998-06-17') AS BIGINT) AS sources
FROM listings
"""


@query("a7_hero_counts", HERO, "listings")
def _(t):
    return A.hero_counts(t.listings, AS_OF)


def cubed(t):
    """The cube of the stored listings."""
    stored, path = job_folder(t.spark, "listings"), job_folder(t.spark, "cube")
    L.append_listings(t.listings, stored)
    K.refresh_cube(t.spark, stored, path)
    return K.read_cube(t.spark, path)


@query("a4_cube_tallies", TALLIES, "listings")
def _(t):
    return K.cube_tallies(cubed(t), t.listings, AS_OF, free_only=True, **PICKED)


@query("a7_cube_hero", HERO, "listings")
def _(t):
    return K.cube_hero_counts(cubed(t), AS_OF)


for _by in ("source", "category"):

    @query(f"a8_counts_by_{_by}",
           f"SELECT {_by}, CAST(count(*) AS BIGINT) AS n FROM listings GROUP BY 1", "listings")
    def _(t, by=_by):
        return A.counts_by(t.listings, by)


@query("o1_page", f"""
SELECT {BASE_SQL} FROM listings ORDER BY listings.event_date, id LIMIT 40 OFFSET 1000
""", "listings")
def _(t):
    return show(L.page(t.listings, 40, 1000))


@query("o3_recent", f"""
SELECT {BASE_SQL} FROM listings ORDER BY created_at DESC, id DESC LIMIT 10
""", "listings")
def _(t):
    return show(L.recent(t.listings, 10))


@query("o4_date_buckets", """
SELECT id, CAST(CASE WHEN d <= 0 THEN 0 WHEN d = 1 THEN 1 WHEN d <= 4 THEN 2 WHEN d <= 11 THEN 3 ELSE 4 END AS BIGINT) AS bucket_ord,
  CASE WHEN d <= 0 THEN 'Today' WHEN d = 1 THEN 'Tomorrow' WHEN d <= 4 THEN 'This Week'
       WHEN d <= 11 THEN 'Next Week' ELSE 'Later' END AS bucket
FROM (SELECT id, date_diff('day', DATE '1998-06-17', CAST(event_date AS DATE)) AS d FROM listings)
""", "listings")
def _(t):
    return show(S.date_buckets(t.listings, AS_OF), "id", "bucket_ord", "bucket")


@query("k1_insert", """
SELECT (SELECT max(id) FROM listings) + row_number() OVER (ORDER BY id) AS id, title, source,
  '1998-06-17 10:30:00' AS created_at
FROM listings_incoming
""", "listings_incoming")
def _(t):
    batch = t.incoming.withColumn("arrival", F.col("id"))
    return show(L.insert(batch, t.listings, AS_OF), "id", "title", "source", "created_at")


@query("k1_append", """
SELECT (SELECT max(id) FROM listings) + row_number() OVER (ORDER BY id) AS id, title, strftime(event_date, '%Y-%m') AS event_month FROM listings_incoming
UNION ALL SELECT id, title, strftime(event_date, '%Y-%m') FROM listings
""", "listings_incoming")
def _(t):
    path = job_folder(t.spark, "listings")
    L.append_listings(t.listings, path)
    L.append_listings(L.insert(t.incoming.withColumn("arrival", F.col("id")), t.listings, AS_OF), path)
    return L.read_listings(t.spark, path).select("id", "title", "event_month")


@query("k2_update_months", """
SELECT l.id, CASE WHEN hit THEN upper(l.title) ELSE l.title END AS title, strftime(CASE WHEN hit THEN l.event_date + INTERVAL 40 DAY ELSE l.event_date END, '%Y-%m') AS event_month
FROM (SELECT *, id % 50 = 1 AND month(event_date) = 3 AS hit FROM listings) l
""", "listings")
def _(t):
    path = job_folder(t.spark, "listings")
    L.append_listings(t.listings, path)
    chosen = t.listings.where((F.col("id") % 50 == 1) & (F.month("event_date") == 3))
    changes = chosen.select("id", L.month_of(F.col("event_date")).alias("event_month"), F.upper("title").alias("title"),
                            (F.col("event_date") + F.expr("interval 40 days")).alias("event_date"))
    L.update_months(changes, path, AS_OF)
    return L.read_listings(t.spark, path).select("id", "title", "event_month")


@query("k2_empty_month", """
SELECT id, title, strftime(CASE WHEN strftime(event_date, '%Y-%m') = '1998-03' THEN event_date + INTERVAL 40 DAY ELSE event_date END, '%Y-%m') AS event_month
FROM listings
""", "listings")
def _(t):
    """All rows of a month move, and the month is left empty."""
    path = job_folder(t.spark, "listings")
    L.append_listings(t.listings, path)
    moved = t.listings.withColumn("event_month", L.month_of(F.col("event_date"))).where("event_month = '1998-03'")
    L.update_months(moved.select("id", "event_month", (F.col("event_date") + F.expr("interval 40 days")).alias("event_date")), path, AS_OF)
    return L.read_listings(t.spark, path).select("id", "title", "event_month")


@query("k3_delete_months", """
SELECT id, title, strftime(event_date, '%Y-%m') AS event_month FROM listings
WHERE NOT (month(event_date) = 5 AND (year(event_date) = 1998 OR id % 2 = 0))
""", "listings")
def _(t):
    path = job_folder(t.spark, "listings")
    L.append_listings(t.listings, path)
    gone = t.listings.where((F.month("event_date") == 5) & ((F.year("event_date") == 1998) | (F.col("id") % 2 == 0)))
    L.delete_months(gone.select("id", L.month_of(F.col("event_date")).alias("event_month")), path)
    return L.read_listings(t.spark, path).select("id", "title", "event_month")


@query("k4_category_months", """
SELECT id, CASE WHEN id % 3 = 0 AND month(event_date) < 3 THEN 'Other' ELSE category END AS category,
  CASE WHEN id % 3 = 0 AND month(event_date) < 3 THEN '1998-06-17 10:30:00' ELSE strftime(updated_at, '%Y-%m-%d %H:%M:%S') END AS updated_at
FROM listings
""", "listings")
def _(t):
    path = job_folder(t.spark, "listings")
    L.append_listings(t.listings, path)
    chosen = t.listings.where((F.col("id") % 3 == 0) & (F.month("event_date") < 3))
    L.set_category_months(chosen.select("id", L.month_of(F.col("event_date")).alias("event_month"), F.lit("Other").alias("category")), path, AS_OF)
    return show(L.read_listings(t.spark, path), "id", "category", "updated_at")


@query("t1_stored_index", """
WITH now AS (
  SELECT id, CASE WHEN id % 7 = 0 THEN 'The new widget live' ELSE title END AS title, description, venue_name FROM listings WHERE id % 5 <> 0
), padded AS (
  SELECT id, unnest([title, description, venue_name]) AS body FROM now
)
SELECT DISTINCT id FROM padded
WHERE ' ' || array_to_string(regexp_extract_all(lower(strip_accents(body)), '[\\p{L}\\p{N}]+'), ' ') || ' ' LIKE '% widget live %'
""", "listings")
def _(t):
    """The index follows an insert, a change of titles and a removal, and the phrase reads its folders only."""
    path = job_folder(t.spark, "phrases")
    P.index_rows(t.listings, path, 1)
    P.reindex_rows(t.listings.where("id % 7 = 0").withColumn("title", F.lit("The new widget live")), path, 2)
    P.forget_rows(t.listings.where("id % 5 = 0"), path, 3)
    return P.stored_phrase_ids(t.spark, path, "widget LIVE")


@query("j1_stored_documents", """
SELECT doc_id AS id FROM documents
WHERE ' ' || array_to_string(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+'), ' ') || ' ' LIKE '% in the %'
""")
def _(t):
    """Whole texts of every language in a stored index."""
    path = job_folder(t.spark, "phrases")
    docs = t.raw("documents").withColumnRenamed("doc_id", "id")
    P.index_rows(docs, path, 1, fields=["text"])
    P.forget_rows(docs.limit(0), path, 1)
    return P.stored_phrase_ids(t.spark, path, "in the")


@query("f2_stored_month", """
SELECT id, title FROM listings WHERE event_date >= TIMESTAMP '1998-06-01' AND event_date < TIMESTAMP '1998-07-01'
""", "listings")
def _(t):
    path = job_folder(t.spark, "listings")
    L.append_listings(t.listings, path)
    return S.by_date(L.read_listings(t.spark, path), "this_month", AS_OF).select("id", "title")


@query("k2_update", """
SELECT l.id, CASE WHEN i.id IS NOT NULL THEN i.title ELSE l.title END AS title,
  CASE WHEN i.id IS NOT NULL THEN i.description ELSE l.description END AS description,
  CASE WHEN i.id IS NOT NULL THEN '1998-06-17 10:30:00' ELSE strftime(l.updated_at, '%Y-%m-%d %H:%M:%S') END AS updated_at
FROM listings l LEFT JOIN listings_incoming i ON i.id = l.id + 100000000
""", "listings_incoming")
def _(t):
    changes = t.incoming.select((F.col("id") - 100000000).alias("id"), "title", "description")
    return show(L.update(t.listings, changes, AS_OF), "id", "title", "description", "updated_at")


@query("k3_delete", f"""
SELECT {BASE_SQL} FROM listings WHERE id + 100000000 NOT IN (SELECT id FROM listings_incoming)
""", "listings_incoming")
def _(t):
    return show(L.delete(t.listings, t.incoming.select((F.col("id") - 100000000).alias("id"))))


@query("k4_set_category", """
SELECT id, CASE WHEN id % 3 = 0 THEN 'Other' ELSE category END AS category,
  CASE WHEN id % 3 = 0 THEN '1998-06-17 10:30:00' ELSE strftime(updated_at, '%Y-%m-%d %H:%M:%S') END AS updated_at
FROM listings
""", "listings")
def _(t):
    changes = t.incoming.select((F.col("id") - 100000000).alias("id"),
                                F.lit("Other").alias("category"))
    return show(L.set_category(t.listings, changes, AS_OF), "id", "category", "updated_at")


@query("t1_phrase_index", """
SELECT DISTINCT id FROM listings
WHERE ' ' || array_to_string(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+'), ' ') || ' ' LIKE '% widget live %'
   OR ' ' || array_to_string(regexp_extract_all(lower(coalesce(description, '')), '[a-z0-9]+'), ' ') || ' ' LIKE '% widget live %'
   OR ' ' || array_to_string(regexp_extract_all(lower(coalesce(venue_name, '')), '[a-z0-9]+'), ' ') || ' ' LIKE '% widget live %'
""", "listings")
def _(t):
    from marquee.operators.phrases import phrase_ids, tokens

    return phrase_ids(tokens(t.listings), "widget LIVE")


@query("j1_phrase_semi_join", """
SELECT doc_id AS id, lang, n_chars FROM documents
WHERE ' ' || array_to_string(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+'), ' ') || ' '
  LIKE '% in the %'
""")
def _(t):
    from marquee.operators.phrases import phrase_ids, tokens

    docs = t.raw("documents").withColumnRenamed("doc_id", "id")
    ids = phrase_ids(tokens(docs, fields=["text"]), "in the")
    return docs.join(ids, "id", "left_semi").select("id", "lang", "n_chars")
