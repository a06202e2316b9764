"""Checked queries: the event table replayed as a stream; results equal the batch form."""

from pyspark.sql import functions as F

from marquee import schemas
from marquee.functions.dates import as_naive
from marquee.operators import engagement as E
from marquee.operators import rollups as R
from marquee.plans.catalog import plain, query
from marquee.plans.engagement_plans import DAILY_SQL, LOGS, SESSIONS
from marquee.plans.views import Tables
from marquee.session import job_folder
from marquee.streaming import jobs as M

TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


class Replayed(Tables):
    """The same tables with events read as a file stream."""

    def raw(self, name):
        if name != "events":
            return super().raw(name)
        schema = super().raw(name).schema
        return self.spark.readStream.schema(schema).option(
            "pathGlobFilter", "events.parquet").parquet(self.folder)


def replay(t):
    return Replayed(t.spark, t.folder), job_folder(t.spark, "stream")


def run(stream, folder, mode="update"):
    M.write_batches(stream, f"{folder}/out", f"{folder}/state", mode, once=True).awaitTermination()
    return f"{folder}/out"


@query("m1_ingest", "SELECT id, session_id, path FROM page_views", "page_views")
def _(t):
    s, folder = replay(t)
    M.ingest(s.page_views, f"{folder}/out", f"{folder}/state", once=True).awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("id", "session_id", "path")


@query("m2_session_stream", f"""
SELECT session_id, {TS.format('first_seen')} AS first_seen, {TS.format('last_seen')} AS last_seen,
  page_views, events_viewed, events_clicked, searches FROM ({SESSIONS})
""", LOGS)
def _(t):
    s, folder = replay(t)
    marks = M.session_marks(s.page_views, s.interactions, s.search_queries)
    return plain(M.read_sessions(t.spark, run(M.session_stream(marks), folder)))


@query("m2_ended_sessions", f"""
WITH marks AS (SELECT session_id, created_at, 'page' AS kind FROM page_views
  UNION ALL SELECT session_id, created_at, interaction_type FROM interactions
  UNION ALL SELECT session_id, created_at, 'search' FROM search_queries),
 marked AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
  FROM marks WINDOW w AS (PARTITION BY session_id ORDER BY created_at)),
 numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY created_at) AS n FROM marked)
SELECT session_id, {TS.format('min(created_at)')} AS first_seen, {TS.format('max(created_at)')} AS last_seen,
  count(*) FILTER (WHERE kind = 'page') AS page_views, count(*) FILTER (WHERE kind = 'view') AS events_viewed,
  count(*) FILTER (WHERE kind = 'click') AS events_clicked, count(*) FILTER (WHERE kind = 'search') AS searches
FROM numbered GROUP BY session_id, n
HAVING max(created_at) + INTERVAL 30 MINUTE <= (SELECT max(created_at) - INTERVAL 10 MINUTE FROM marks)
""".strip(), LOGS)
def _(t):
    s, folder = replay(t)
    marks = M.session_marks(s.page_views, s.interactions, s.search_queries)
    return plain(t.spark.read.parquet(run(M.ended_sessions(marks), folder, "append")).drop("batch"))


@query("m3_split_valid", """
SELECT event_id AS id, event_id % 7 <> 0 AND event_id % 11 <> 0 AS valid FROM events
""")
def _(t):
    s, folder = replay(t)
    body = F.to_json(F.struct(F.col("event_id").alias("id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
                              F.when(F.col("event_id") % 11 != 0, "/p").alias("path")))
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "session_id": [}'))).otherwise(body)
    wire = s.raw("events").select(text.alias("value"))
    M.ingest_valid(M.parse_log(wire, schemas.PAGE_VIEWS), ["session_id", "path"],
                   f"{folder}/good", f"{folder}/bad", f"{folder}/state", once=True).awaitTermination()
    good = t.spark.read.parquet(f"{folder}/good").select("id", F.lit(True).alias("valid"))
    bad = t.spark.read.parquet(f"{folder}/bad")
    told = F.coalesce(F.col("id"), F.regexp_extract("_corrupt", r'"id": (\d+)', 1).try_cast("bigint"))
    return good.unionByName(bad.select(told.alias("id"), F.lit(False).alias("valid")))


@query("m4_daily_stream", f"""
SELECT date, page_views, events_viewed, events_clicked, searches, favorites_added
FROM ({DAILY_SQL.format(first='2024-01-01', last='2024-02-28').strip()})
WHERE page_views + events_viewed + events_clicked + searches + favorites_added > 0
""", LOGS)
def _(t):
    s, folder = replay(t)
    marks = M.session_marks(s.page_views, s.interactions, s.search_queries)
    days = M.read_latest(t.spark, run(M.daily_stream(marks), folder), ["date"])
    counts = days.drop("unique_visitors")
    return plain(counts.where("page_views + events_viewed + events_clicked + searches + favorites_added > 0"))


@query("m4_rollup_stream", DAILY_SQL.format(first="2024-01-01", last="2024-02-28"), LOGS)
def _(t):
    s, folder = replay(t)
    marks = M.session_marks(s.page_views, s.interactions, s.search_queries)
    M.write_rollup(marks, f"{folder}/days", f"{folder}/state", once=True).awaitTermination()
    return plain(R.daily_report(t.spark, f"{folder}/days", "2024-01-01", "2024-02-28"))


@query("m5_popularity_stream", f"""
SELECT {TS.format('d')} AS "from", {TS.format("d + INTERVAL 7 DAY")} AS "to", event_id,
  CAST(count(*) FILTER (WHERE interaction_type = 'view') AS BIGINT) AS views,
  CAST(count(*) FILTER (WHERE interaction_type = 'click') AS BIGINT) AS clicks
FROM interactions JOIN (SELECT unnest(generate_series(TIMESTAMP '2023-12-20', TIMESTAMP '2024-02-28', INTERVAL 1 DAY)) AS d) days
  ON created_at >= d AND created_at < d + INTERVAL 7 DAY GROUP BY d, event_id
""", "interactions")
def _(t):
    s, folder = replay(t)
    out = run(M.popularity_stream(s.interactions), folder)
    return plain(M.read_latest(t.spark, out, ["from", "to", "event_id"]))


@query("m6_session_windows", f"""
WITH marked AS (SELECT session_id, created_at, CASE WHEN created_at - lag(created_at) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
  FROM page_views WINDOW w AS (PARTITION BY session_id ORDER BY created_at)),
 numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY created_at) AS n FROM marked)
SELECT session_id, {TS.format('min(created_at)')} AS "from", {TS.format("max(created_at) + INTERVAL 30 MINUTE")} AS "to", CAST(count(*) AS BIGINT) AS page_views
FROM numbered GROUP BY session_id, n
HAVING max(created_at) + INTERVAL 30 MINUTE <= (SELECT max(created_at) - INTERVAL 10 MINUTE FROM page_views)
""".strip(), "page_views")
def _(t):
    s, folder = replay(t)
    out = run(M.session_windows(s.page_views), folder, "append")
    return plain(t.spark.read.parquet(out).drop("batch"))


@query("m7_event_time", """
SELECT strftime(created_at, '%Y-%m-%d %H:00:00') AS hour, CAST(count(*) AS BIGINT) AS n FROM page_views GROUP BY 1
""", "page_views")
def _(t):
    s, folder = replay(t)
    hours = M.with_event_time(s.page_views).groupBy(F.window("created_at", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("n")).select(as_naive("w.start").alias("hour"), "n")
    return plain(M.read_latest(t.spark, run(hours, folder), ["hour"]))


@query("m8_dedup_stream", "SELECT DISTINCT session_id, path FROM page_views", "page_views")
def _(t):
    s, folder = replay(t)
    once = M.dedup_stream(s.page_views.select("session_id", "path", "created_at"), ["session_id", "path"],
                          "created_at", "60 days")
    out = run(once, folder, "append")
    return t.spark.read.parquet(out).select("session_id", "path")


@query("m9_interaction_counts", """
SELECT interaction_type, CAST(count(*) AS BIGINT) AS n FROM interactions GROUP BY 1
""", "interactions")
def _(t):
    s, folder = replay(t)
    return M.read_latest(t.spark, run(M.interaction_counts(s.interactions), folder), ["interaction_type"])


@query("m10_enrich_stream", """
SELECT i.id, l.source, coalesce(l.category, 'none') AS category FROM interactions i JOIN listings l ON l.id = i.event_id
""", "interactions listings")
def _(t):
    s, folder = replay(t)
    out = run(M.enrich_stream(s.interactions, t.listings), folder, "append")
    return t.spark.read.parquet(out).select("id", "source", F.coalesce("category", F.lit("none")).alias("category"))


@query("m11_retain_stream", """
SELECT id FROM interactions WHERE created_at >= TIMESTAMP '2024-01-15 12:00:00'
""", "interactions")
def _(t):
    s, folder = replay(t)
    kept = E.retain(s.interactions, 10, "2024-01-25 12:00:00")
    M.ingest(kept, f"{folder}/out", f"{folder}/state", once=True).awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("id")
