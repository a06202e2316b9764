"""Checked queries: engagement reports."""

from pyspark.sql import functions as F

from marquee.functions import text as X
from marquee.functions.price import hash_ip, pct
from marquee.operators import engagement as E
from marquee.operators import history as H
from marquee.operators import listings as L
from marquee.operators import rollups as R
from marquee.plans.catalog import plain, query
from marquee.plans.views import LOG_AS_OF
from marquee.session import job_folder
from marquee.streaming.jobs import session_marks

LOGS = "page_views interactions search_queries"
DAILY_SQL = """
SELECT strftime(d.day, '%Y-%m-%d') AS date,
  CAST((SELECT count(DISTINCT session_id) FROM page_views p WHERE CAST(p.created_at AS DATE) = d.day) AS BIGINT) AS unique_visitors,
  CAST((SELECT count(*) FROM page_views p WHERE CAST(p.created_at AS DATE) = d.day) AS BIGINT) AS page_views,
  CAST((SELECT count(*) FROM interactions p WHERE CAST(p.created_at AS DATE) = d.day AND interaction_type = 'view') AS BIGINT) AS events_viewed,
  CAST((SELECT count(*) FROM interactions p WHERE CAST(p.created_at AS DATE) = d.day AND interaction_type = 'click') AS BIGINT) AS events_clicked,
  CAST((SELECT count(*) FROM search_queries p WHERE CAST(p.created_at AS DATE) = d.day) AS BIGINT) AS searches,
  CAST((SELECT count(*) FROM interactions p WHERE CAST(p.created_at AS DATE) = d.day AND interaction_type = 'favorite') AS BIGINT) AS favorites_added
FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '{first}', TIMESTAMP '{last}', INTERVAL 1 DAY)) AS DATE) AS day) d
"""


@query("a9_daily_metrics", DAILY_SQL.format(first="2024-01-10", last="2024-01-10"), LOGS)
def _(t):
    return plain(E.metrics_on(t.page_views, t.interactions, t.search_queries, "2024-01-10"))


@query("j16_daily_range", DAILY_SQL.format(first="2024-01-26", last="2024-02-03"), LOGS)
def _(t):
    return plain(E.daily_range(t.page_views, t.interactions, t.search_queries,
                               "2024-01-26", "2024-02-03"))


@query("a10_period_summary", f"""
WITH daily AS ({DAILY_SQL.format(first="2024-01-18", last="2024-01-25")})
SELECT CAST(sum(unique_visitors) AS BIGINT) AS unique_visitors, CAST(sum(page_views) AS BIGINT) AS page_views,
  CAST(sum(events_viewed) AS BIGINT) AS events_viewed, CAST(sum(events_clicked) AS BIGINT) AS events_clicked,
  CAST(sum(searches) AS BIGINT) AS searches, CAST(sum(favorites_added) AS BIGINT) AS favorites_added,
  CAST(CASE WHEN sum(events_viewed) > 0 THEN round(sum(events_clicked) * 100.0 / sum(events_viewed), 1) ELSE 0 END AS DOUBLE) AS click_through_rate
FROM daily
""".strip(), LOGS)
def _(t):
    return plain(E.period_summary(E.daily_range(
        t.page_views, t.interactions, t.search_queries, "2024-01-18", "2024-01-25")))


ENGAGED = """
SELECT event_id, CAST(count(*) FILTER (WHERE interaction_type = 'view') AS BIGINT) AS views,
  CAST(count(*) FILTER (WHERE interaction_type = 'click') AS BIGINT) AS clicks
FROM interactions WHERE CAST(created_at AS DATE) >= DATE '2024-01-18' GROUP BY event_id
"""


@query("a11_listing_engagement", ENGAGED, "interactions")
def _(t):
    return plain(E.listing_engagement(t.interactions, 7, LOG_AS_OF))


@query("o2_top_k", f"{ENGAGED} ORDER BY views DESC, clicks DESC, event_id LIMIT 25", "interactions")
def _(t):
    order = [F.desc("views"), F.desc("clicks"), F.asc("event_id")]
    return plain(E.top_k(E.listing_engagement(t.interactions, 7, LOG_AS_OF), order, 25))


@query("j14_popular_listings", f"""
WITH top AS ({ENGAGED} ORDER BY views DESC, clicks DESC, event_id LIMIT 20)
SELECT t.event_id, CASE WHEN length(l.title) > 50 THEN substr(l.title, 1, 50) || '...' ELSE l.title END AS title,
  views, clicks, CAST(CASE WHEN views > 0 THEN round(clicks * 100.0 / views, 1) ELSE 0 END AS DOUBLE) AS click_rate
FROM top t JOIN listings l ON l.id = t.event_id
""".strip(), "interactions listings")
def _(t):
    return plain(E.popular_listings(t.interactions, t.listings, LOG_AS_OF, 20, 7))


@query("a12_popular_searches", """
SELECT query, CAST(count(*) AS BIGINT) AS n FROM search_queries
WHERE CAST(created_at AS DATE) >= DATE '2024-01-18' AND query IS NOT NULL AND query <> ''
GROUP BY query ORDER BY n DESC, query LIMIT 10
""", "search_queries")
def _(t):
    return plain(E.popular_searches(t.search_queries, LOG_AS_OF))


@query("a13_category_popularity", """
SELECT category, CAST(count(*) AS BIGINT) AS n FROM interactions
WHERE CAST(created_at AS DATE) >= DATE '2024-01-18' AND category IS NOT NULL
  AND interaction_type IN ('view', 'click') GROUP BY category
""", "interactions")
def _(t):
    return plain(E.category_popularity(t.interactions, LOG_AS_OF))


@query("a14_source_performance", """
SELECT source, CAST(count(*) AS BIGINT) AS total_interactions,
  CAST(count(*) FILTER (WHERE interaction_type = 'view') AS BIGINT) AS views,
  CAST(count(*) FILTER (WHERE interaction_type = 'click') AS BIGINT) AS clicks,
  CAST(count(*) FILTER (WHERE interaction_type = 'favorite') AS BIGINT) AS favorites,
  CAST(CASE WHEN count(*) FILTER (WHERE interaction_type = 'view') > 0
    THEN round(count(*) FILTER (WHERE interaction_type = 'click') * 100.0 / count(*) FILTER (WHERE interaction_type = 'view'), 2)
    ELSE 0 END AS DOUBLE) AS click_through_rate
FROM interactions WHERE CAST(created_at AS DATE) >= DATE '2024-01-18' AND source IS NOT NULL
GROUP BY source
""", "interactions")
def _(t):
    return plain(E.source_performance(t.interactions, LOG_AS_OF))


SESSIONS = """
SELECT session_id, min(created_at) AS first_seen, max(created_at) AS last_seen,
  CAST(count(*) FILTER (WHERE kind = 'page') AS BIGINT) AS page_views,
  CAST(count(*) FILTER (WHERE kind = 'view') AS BIGINT) AS events_viewed,
  CAST(count(*) FILTER (WHERE kind = 'click') AS BIGINT) AS events_clicked,
  CAST(count(*) FILTER (WHERE kind = 'search') AS BIGINT) AS searches
FROM (SELECT session_id, created_at, 'page' AS kind FROM page_views
      UNION ALL SELECT session_id, created_at, interaction_type FROM interactions
      UNION ALL SELECT session_id, created_at, 'search' FROM search_queries)
GROUP BY session_id
"""


def _sessions(t):
    return E.sessions(t.page_views, t.interactions, t.search_queries)


@query("a15_session_stats", f"""
WITH s AS (SELECT * FROM ({SESSIONS}) WHERE CAST(first_seen AS DATE) >= DATE '2024-01-02')
SELECT CAST(count(*) AS BIGINT) AS total_sessions,
  coalesce(round(avg(page_views), 2), 0) AS avg_page_views,
  coalesce(round(avg(events_viewed), 2), 0) AS avg_events_viewed,
  CAST(coalesce(round(count(*) FILTER (WHERE page_views = 1) * 100.0 / nullif(count(*), 0), 2), 0) AS DOUBLE) AS bounce_rate
FROM s
""".strip(), LOGS)
def _(t):
    return plain(E.session_stats(_sessions(t), "2024-01-09", 7))


@query("a16_sessions", f"""
SELECT session_id, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen,
  strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, page_views, events_viewed, events_clicked, searches
FROM ({SESSIONS})
""", LOGS)
def _(t):
    return plain(_sessions(t))


@query("a17_filter_usage", """
SELECT filter, value, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'date_filter' AS filter, date_filter AS value FROM search_queries
  UNION ALL SELECT 'category', unnest(string_split(categories, ',')) FROM search_queries WHERE categories <> ''
  UNION ALL SELECT 'source', unnest(string_split(sources, ',')) FROM search_queries WHERE sources <> ''
  UNION ALL SELECT 'free_only', CAST(free_only AS VARCHAR) FROM search_queries)
WHERE value IS NOT NULL GROUP BY 1, 2
""", "search_queries")
def _(t):
    return plain(E.filter_usage(t.search_queries))


def rolled(t) -> str:
    """The logs in three batches, the second one run twice."""
    path = job_folder(t.spark, "rollup")
    parts = [[log.where(F.col("id") % 3 == i) for log in (t.page_views, t.interactions, t.search_queries)] for i in range(3)]
    for batch in (0, 1, 1, 2):
        R.merge_days(R.roll_up_days(session_marks(*parts[batch])), path, batch)
    return path


@query("a9_rollup_days", DAILY_SQL.format(first="2024-01-01", last="2024-02-10"), LOGS)
def _(t):
    return plain(R.daily_report(t.spark, rolled(t), "2024-01-01", "2024-02-10"))


@query("a10_rollup_period", """
SELECT (SELECT count(DISTINCT session_id) FROM page_views WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-02-03') AS unique_visitors,
  (SELECT count(*) FROM page_views WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-02-03') AS page_views,
  count(*) FILTER (WHERE interaction_type = 'view') AS events_viewed,
  count(*) FILTER (WHERE interaction_type = 'click') AS events_clicked,
  (SELECT count(*) FROM search_queries WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-02-03') AS searches,
  count(*) FILTER (WHERE interaction_type = 'favorite') AS favorites_added,
  CAST(coalesce(round(count(*) FILTER (WHERE interaction_type = 'click') * 100.0 / nullif(count(*) FILTER (WHERE interaction_type = 'view'), 0), 1), 0) AS DOUBLE) AS click_through_rate
FROM interactions WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-02-03'
""", LOGS)
def _(t):
    return plain(R.period_report(t.spark, rolled(t), "2024-01-05", "2024-02-03"))


@query("a26_rollup_returning", """
WITH a AS (SELECT DISTINCT session_id FROM page_views WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-10'),
 b AS (SELECT DISTINCT session_id FROM page_views WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-11' AND DATE '2024-01-20')
SELECT count(*) AS visitors, count(a.session_id) AS "returning",
  CAST(coalesce(round(count(a.session_id) * 100.0 / nullif(count(*), 0), 2), 0) AS DOUBLE) AS returning_share
FROM b LEFT JOIN a ON a.session_id = b.session_id
""".strip(), "page_views")
def _(t):
    return plain(R.returning_visitors(t.spark, rolled(t), ("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-01-20")))


@query("a15_rollup_sessions", f"""
WITH s AS (SELECT * FROM ({SESSIONS}) WHERE CAST(first_seen AS DATE) >= DATE '2024-01-02')
SELECT CAST(count(*) AS BIGINT) AS total_sessions,
  coalesce(round(avg(page_views), 2), 0) AS avg_page_views,
  coalesce(round(avg(events_viewed), 2), 0) AS avg_events_viewed,
  CAST(coalesce(round(count(*) FILTER (WHERE page_views = 1) * 100.0 / nullif(count(*), 0), 2), 0) AS DOUBLE) AS bounce_rate
FROM s
""".strip(), LOGS)
def _(t):
    path = job_folder(t.spark, "rollup")
    own = _sessions(t).withColumn("__part", F.crc32("session_id") % 2)
    for batch in (0, 1, 1):
        R.merge_days(R.roll_up_sessions(own.where(F.col("__part") == batch)), path, batch)
    return plain(R.session_report(t.spark, path, "2024-01-02"))


@query("a26_session_extras", f"""
SELECT round(avg(CAST(floor(epoch(last_seen) - epoch(first_seen) + 1e-7) AS BIGINT)), 2) AS avg_seconds,
  CAST(round(count(*) FILTER (WHERE CAST(last_seen AS DATE) > CAST(first_seen AS DATE)) * 100.0 / count(*), 2) AS DOUBLE) AS returning_share
FROM ({SESSIONS})
""", LOGS)
def _(t):
    return plain(E.session_extras(_sessions(t)))


@query("a26_category_trend", """
SELECT strftime(created_at, '%Y-%m-%d') AS date, category, CAST(count(*) AS BIGINT) AS n
FROM interactions WHERE category IS NOT NULL AND interaction_type IN ('view', 'click') GROUP BY 1, 2
""", "interactions")
def _(t):
    return plain(E.category_trend(t.interactions))


@query("j15_enrich_interactions", """
SELECT l.source, coalesce(l.category, 'none') AS category, i.interaction_type, CAST(count(*) AS BIGINT) AS n
FROM interactions i JOIN listings l ON l.id = i.event_id GROUP BY 1, 2, 3
""", "interactions listings")
def _(t):
    joined = E.enrich_interactions(t.interactions, t.listings)
    return plain(joined.groupBy(
        "source", F.coalesce("category", F.lit("none")).alias("category"), "interaction_type"
    ).agg(F.count(F.lit(1)).alias("n")))


@query("j15_facts_at_click", """
SELECT i.id, CASE WHEN NOT v.gone THEN v.source END AS source, CASE WHEN NOT v.gone THEN v.category END AS category
FROM interactions i ASOF LEFT JOIN (
  SELECT id AS event_id, created_at AS valid_from, false AS gone, source, category FROM listings
  UNION ALL
  SELECT id, TIMESTAMP '2024-01-10 06:30:00', false, source, 'Community' FROM listings
  WHERE id % 3 = 0 AND category IS DISTINCT FROM 'Community'
  UNION ALL
  SELECT id, TIMESTAMP '2024-01-20 18:00:00', true, NULL, NULL FROM listings WHERE id % 7 = 0
) v ON i.event_id = v.event_id AND v.valid_from <= i.created_at
""", "interactions listings")
def _(t):
    moved = t.listings.where("id % 3 = 0").select("id", F.lit("Community").alias("category"))
    second = L.set_category(t.listings, moved, "2024-01-10 06:30:00")
    third = L.delete(second, second.where("id % 7 = 0"))
    path = job_folder(t.spark, "versions")
    H.append_versions(H.opened(t.listings, F.col("created_at")), path)
    H.append_versions(H.changed(t.listings, second, "2024-01-10 06:30:00"), path)
    H.append_versions(H.changed(second, third, "2024-01-20 18:00:00"), path)
    return H.facts_at(t.interactions, H.read_versions(t.spark, path)).select("id", "source", "category")


FAVOURITES = """
SELECT session_id, event_id FROM (
  SELECT session_id, event_id, interaction_type,
    row_number() OVER (PARTITION BY session_id, event_id ORDER BY created_at DESC, id DESC) AS rn
  FROM interactions WHERE interaction_type IN ('favorite', 'unfavorite'))
WHERE rn = 1 AND interaction_type = 'favorite'
"""


@query("u4_favourite_sets", f"""
SELECT session_id, array_to_string(list_sort(list(event_id)), '|') AS favourites
FROM ({FAVOURITES}) GROUP BY 1
""", "interactions")
def _(t):
    return plain(E.favourite_sets(t.interactions))


@query("u4_favourite_only", f"""
SELECT id, title FROM listings WHERE id IN (SELECT event_id FROM ({FAVOURITES}) WHERE session_id = 's7')
""", "interactions listings")
def _(t):
    return E.favourite_only(t.listings, t.interactions, "s7").select("id", "title")


@query("x38_hash_ip", """
SELECT id, substr(sha256(ip_address), 1, 16) AS ip_hash FROM page_views
""", "page_views")
def _(t):
    return t.page_views.select("id", hash_ip("ip_address").alias("ip_hash"))


@query("x40_pct", """
SELECT l_orderkey AS k, CAST(CASE WHEN count(*) FILTER (WHERE l_returnflag = 'A') > 0
  THEN round(CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS DOUBLE) / count(*) FILTER (WHERE l_returnflag = 'A') * 100, 1) ELSE 0 END AS DOUBLE) AS ratio
FROM lineitem GROUP BY 1
""")
def _(t):
    return t.raw("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        pct(F.count_if(F.col("l_linestatus") == "F"), F.count_if(F.col("l_returnflag") == "A"), 1)
        .alias("ratio"))


@query("x47_lists", """
SELECT id, CAST(len(string_split(nullif(categories, ''), ',')) AS BIGINT) AS n, categories AS joined FROM search_queries
""", "search_queries")
def _(t):
    listed = t.search_queries.withColumn("l", X.split_list("categories"))
    size = F.when(F.col("l").isNotNull(), F.size("l"))
    return plain(listed.select("id", size.alias("n"), X.join_list("l").alias("joined")))


@query("m11_retain", """
SELECT id, session_id FROM page_views WHERE created_at >= TIMESTAMP '2024-01-15 12:00:00'
""", "page_views")
def _(t):
    return E.retain(t.page_views, 10, LOG_AS_OF).select("id", "session_id")
