"""Checked queries: duplicate detection, clusters, merging, pruning.

Rules that need the similarity measure cannot be said in SQL; their queries run
on the whole tables without an oracle and are compared with a direct
computation in the tests.
"""

from pyspark.sql import functions as F

from marquee.operators import matching as M
from marquee.operators import merging as E
from marquee.operators.clusters import add_pairs, duplicate_clusters, read_clusters
from marquee.plans.catalog import plain, query
from marquee.plans.expression_plans import KM, NORM_TITLE, norm_venue_sql
from marquee.plans.views import AS_OF
from marquee.session import job_folder

GAP = "abs(epoch(i.event_date - s.event_date))"


@query("j2_dup_by_url", f"""
SELECT i.id AS a_id, s.id AS b_id FROM listings_incoming i JOIN listings s
  ON nullif(trim(i.url), '') = nullif(trim(s.url), '') AND {GAP} <= 86400
""", "listings_incoming")
def _(t):
    return M.dup_by_url(M.match_facts(t.incoming), M.match_facts(t.listings)).select("a_id", "b_id")


OVERLAP = f"""i.source = s.source AND {NORM_TITLE.format('i.title')} = {NORM_TITLE.format('s.title')}
  AND epoch(i.end_date - i.event_date) >= 172800 AND epoch(s.end_date - s.event_date) >= 172800
  AND ({norm_venue_sql('i.venue_name')} = '' OR {norm_venue_sql('i.venue_name')} = {norm_venue_sql('s.venue_name')})
  AND s.event_date <= i.end_date AND i.event_date <= s.end_date"""
RELISTED = "(SELECT * REPLACE (lower(title) || '!' AS title, event_date + INTERVAL 1 DAY AS event_date) FROM listings WHERE id % 2 = 0)"


@query("j3_dup_by_overlap", f"SELECT i.id AS a_id, s.id AS b_id FROM {RELISTED} i JOIN listings s ON {OVERLAP}",
       "listings")
def _(t):
    moved = t.listings.where("id % 2 = 0").withColumn(
        "title", F.concat(F.lower("title"), F.lit("!"))).withColumn(
        "event_date", F.col("event_date") + F.expr("interval 1 day"))
    return M.dup_by_overlap(M.match_facts(moved), M.match_facts(t.listings)).select("a_id", "b_id")


@query("j3_first_overlap", f"""
SELECT a_id, b_id FROM (
  SELECT i.id AS a_id, s.id AS b_id, row_number() OVER (PARTITION BY i.id ORDER BY s.event_date, s.id) AS place
  FROM {RELISTED} i JOIN listings s ON {OVERLAP}) WHERE place = 1
""", "listings")
def _(t):
    moved = t.listings.where("id % 2 = 0").withColumn(
        "title", F.concat(F.lower("title"), F.lit("!"))).withColumn(
        "event_date", F.col("event_date") + F.expr("interval 1 day"))
    return M.first_overlap(M.match_facts(moved), M.match_facts(t.listings))


@query("j4_band_join", f"""
SELECT i.id AS a_id, s.id AS b_id FROM listings_incoming i JOIN listings s
  ON i.venue_name = s.venue_name AND i.venue_name <> '' AND {GAP} <= 86400
""", "listings_incoming")
def _(t):
    def side(df):
        return df.where("venue_name <> ''").select("id", "venue_name", F.col("event_date").alias("start"))
    return M.band_join(side(t.incoming), side(t.listings), 24, ["venue_name"]).select("a_id", "b_id")


PAIR_KM = KM.replace("34.05", "s.latitude").replace("(-118.25)", "s.longitude").replace(
    "radians(latitude)", "radians(i.latitude)").replace("- latitude)", "- i.latitude)").replace(
    "- longitude)", "- i.longitude)")


@query("j7_geo_time_pairs", f"""
SELECT i.id AS a_id, s.id AS b_id FROM listings_incoming i JOIN listings s
  ON abs(i.latitude - s.latitude) < 0.01 AND {GAP} <= 10800 AND {PAIR_KM} <= 0.15
""", "listings_incoming")
def _(t):
    return M.geo_time_pairs(M.match_facts(t.incoming), M.match_facts(t.listings)).select("a_id", "b_id")


@query("j8_prune_stale", """
SELECT id FROM listings WHERE NOT (event_date >= TIMESTAMP '1998-06-17 10:30:00'
  AND source IN ('NATION_2', 'NATION_4', 'NATION_6') AND id % 5 <> 0)
""", "listings")
def _(t):
    productive = t.raw("nation").where("n_nationkey in (2, 4, 6)").select(F.col("n_name").alias("source"))
    return E.prune_stale(t.listings, t.listings.where("id % 5 = 0"), productive, AS_OF).select("id")


def _scored(t):
    return M.scored_rows(t.incoming, t.listings)


# Where one text contains the other, their similarity is known without the measure.
_NT, _NV = NORM_TITLE.format, norm_venue_sql
ALIKE = "CASE WHEN {0} = '' OR {1} = '' THEN 0e0 ELSE 2e0 * least(length({0}), length({1})) / (length({0}) + length({1})) END"
OWN_PAIRS = f"""facts AS (
  SELECT i.id AS a_id, s.id AS b_id, {_NT('i.title')} AS ta, {_NT('s.title')} AS tb, {_NV('i.venue_name')} AS va, {_NV('s.venue_name')} AS vb,
    {GAP} / 3600e0 AS gap, i.source = s.source AS one_source, coalesce(nullif(trim(i.url), '') = nullif(trim(s.url), ''), false) AS one_url,
    {PAIR_KM} AS km, {OVERLAP} AS overlapping
  FROM spaced_incoming i JOIN spaced s ON i.id = s.id + 100000000
), measured AS (
  SELECT *, {ALIKE.format('ta', 'tb')} AS t, {ALIKE.format('va', 'vb')} AS v,
    CASE WHEN length(ta) <= length(tb) THEN starts_with(tb, ta || ' at ') ELSE starts_with(ta, tb || ' at ') END AS prefixed FROM facts
), judged AS (
  SELECT *, CASE
    WHEN one_url AND gap <= 24 AND (gap < 1 OR t >= 0.5) THEN 'url'
    WHEN gap > 24 THEN NULL
    WHEN one_source THEN CASE WHEN ta <> '' AND ta = tb AND gap < 1 AND va <> '' AND va = vb THEN 'exact_same_source' END
    WHEN t >= 0.85 AND NOT coalesce(km > 1, false) THEN 'title'
    WHEN t >= 0.7 AND v >= 0.8 THEN 'title_venue'
    WHEN v >= 0.95 AND least(length(ta), length(tb)) >= 4 AND ta <> tb AND prefixed THEN 'venue_prefix_title'
    WHEN gap <= 3 AND v >= 0.85 AND t >= 0.45 THEN 'venue_date'
    WHEN gap <= 3 AND t >= 0.45 AND coalesce(km <= 0.15, false) THEN 'geo_date' END AS method FROM measured
), matched AS (
  SELECT *, CASE WHEN one_url AND gap < 24 AND (gap < 1 OR t >= 0.5) THEN 'url' WHEN overlapping THEN 'multiday_overlap'
    ELSE method END AS match_method FROM judged
)"""


@query("j5_score_pairs", f"WITH {OWN_PAIRS} SELECT a_id, b_id, method AS match_method FROM judged WHERE method IS NOT NULL", "spaced_incoming")
def _(t):
    return M.scored_rows(t.spaced_incoming, t.spaced).select("a_id", "b_id", "match_method")


@query("j5_score_pairs_listings")
def _(t):
    return plain(_scored(t).select("a_id", "b_id", "match_method",
                                   F.round("title_similarity", 4).alias("title_similarity")))


# A pair with one URL and nearly one start, or with all of source, title and
# venue equal, needs no similarity: SQL finds the same pairs.
@query("j5_exact_methods", f"""
SELECT i.id AS a_id, s.id AS b_id, CASE WHEN nullif(trim(i.url), '') = nullif(trim(s.url), '') THEN 'url' ELSE 'exact_same_source' END AS match_method
FROM listings_incoming i JOIN listings s ON {GAP} < 3600 AND (nullif(trim(i.url), '') = nullif(trim(s.url), '')
  OR (i.source = s.source AND {NORM_TITLE.format('i.title')} = {NORM_TITLE.format('s.title')} AND {NORM_TITLE.format('i.title')} <> ''
      AND {norm_venue_sql('i.venue_name')} = {norm_venue_sql('s.venue_name')} AND {norm_venue_sql('i.venue_name')} <> ''))
""", "listings_incoming")
def _(t):
    exact = (F.col("date_diff_hours") < 1) & F.col("match_method").isin("url", "exact_same_source")
    return _scored(t).where(exact).select("a_id", "b_id", "match_method")


@query("j6_best_match_spaced", f"""WITH {OWN_PAIRS}
SELECT a_id AS id, b_id AS match_id, match_method FROM matched WHERE match_method IS NOT NULL""", "spaced_incoming")
def _(t):
    return M.best_match(t.spaced_incoming, t.spaced)


@query("j6_best_match")
def _(t):
    return M.best_match(t.incoming, t.listings)


@query("e1_duplicate_pairs_spaced", f"""WITH {OWN_PAIRS}
SELECT b_id AS id_a, a_id AS id_b, coalesce(method, 'multiday_overlap') AS match_method FROM matched
WHERE method IS NOT NULL OR overlapping""", "spaced_incoming")
def _(t):
    return M.duplicate_pairs(t.spaced.unionByName(t.spaced_incoming))


@query("e1_duplicate_pairs")
def _(t):
    both = t.listings.unionByName(t.incoming)
    return M.duplicate_pairs(both)


ORDERS_OF_ONE = """
SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS cluster FROM orders
WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)
"""


def order_chain(t):
    from pyspark.sql import Window

    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy(F.xxhash64("o_orderkey")))
    chain = t.raw("orders").select(F.col("o_orderkey").alias("id_a"), after.alias("id_b"))
    return chain.where("id_b is not null")


@query("e2_duplicate_clusters", ORDERS_OF_ONE)
def _(t):
    return duplicate_clusters(order_chain(t))


@query("e2_stored_clusters", ORDERS_OF_ONE)
def _(t):
    path, chain = job_folder(t.spark, "clusters"), order_chain(t)
    for version in range(2):
        add_pairs(chain.where(F.pmod(F.xxhash64("id_a", "id_b"), F.lit(2)) == version), path, version)
    return read_clusters(t.spark, path)


def first_of(c, typ="text"):
    p, s = f"p.{c}", f"s.{c}"
    return f"coalesce(nullif({p}, ''), {s}, {p})" if typ == "text" else f"coalesce({p}, {s})"


def timed(c):
    return (f"strftime(CASE WHEN hour(p.{c}) = 0 AND s.{c} IS NOT NULL AND hour(s.{c}) <> 0 THEN s.{c}"
            f" ELSE coalesce(p.{c}, s.{c}) END, '%Y-%m-%d %H:%M:%S')")


MERGED = f"""{first_of('title')} AS title, {first_of('venue_name')} AS venue_name,
  CASE WHEN length(coalesce(s.description, '')) > length(coalesce(p.description, '')) THEN s.description ELSE coalesce(nullif(p.description, ''), s.description, p.description) END AS description,
  {timed('event_date')} AS event_date, {timed('end_date')} AS end_date, {first_of('category')} AS category, {first_of('url')} AS url,
  round(CASE WHEN s.price IS NOT NULL OR lower(s.price_note) LIKE '%sold out%' THEN s.price ELSE p.price END, 2) AS price,
  coalesce(s.is_free, p.is_free) AS is_free, s.price_note AS price_note,
  coalesce(nullif(p.region, ''), nullif(s.region, ''), 'westside') AS region"""
SECOND = """sec AS (SELECT * REPLACE (id - 100000000 AS id, CASE WHEN id % 4 = 0 THEN NULL ELSE price END AS price,
  CASE WHEN id % 6 = 0 THEN 'Sold out' ELSE price_note END AS price_note, id % 5 = 0 AS is_free) FROM listings_incoming)"""
MERGE_COLS = ["title", "venue_name", "description", "event_date", "end_date", "category", "url", "price",
              "is_free", "price_note", "region"]


def _second(t):
    price = F.when(F.col("id") % 4 != 0, F.col("price"))
    note = F.when(F.col("id") % 6 == 0, "Sold out").otherwise(F.col("price_note"))
    return t.incoming.withColumn("price", price).withColumn("price_note", note).withColumn(
        "is_free", F.col("id") % 5 == 0).withColumn("id", F.col("id") - 100000000)


def _shown(df, *more):
    rounded = df.withColumn("price", F.round("price", 2))
    return plain(rounded.select("id", *more, *MERGE_COLS))


@query("e3_merge_pair", f"""WITH {SECOND}
SELECT p.id, p.source, {MERGED}, strftime(p.created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
  '1998-06-17 10:30:00' AS updated_at FROM listings p JOIN sec s ON s.id = p.id
""", "listings_incoming")
def _(t):
    primary = t.listings.where("id % 3 = 0")
    return _shown(E.merge_pair(primary, _second(t), "id", AS_OF), "source", "created_at", "updated_at")


@query("e4_choose_primary", f"""WITH {SECOND},
 lead AS (SELECT l.id, l.source IN ('NATION_3', 'NATION_8', 'NATION_14') AND s.source NOT IN ('NATION_3', 'NATION_8', 'NATION_14') AS yields, l.created_at AS stored_at
   FROM listings l JOIN sec s ON s.id = l.id)
SELECT p.id, p.source, {MERGED}, strftime(stored_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM lead JOIN listings p ON NOT yields AND p.id = lead.id JOIN sec s ON s.id = lead.id
UNION ALL
SELECT p.id, p.source, {MERGED}, strftime(stored_at, '%Y-%m-%d %H:%M:%S')
FROM lead JOIN sec p ON yields AND p.id = lead.id JOIN listings s ON s.id = lead.id
""", "listings_incoming")
def _(t):
    batch = _second(t).withColumn("id", F.col("id") + 100000000)
    matches = batch.select("id", (F.col("id") - 100000000).alias("match_id"))
    merged = E.merge_matched(matches, batch, t.listings, AS_OF, ("NATION_3", "NATION_8", "NATION_14"))
    return _shown(merged, "source", "created_at")


def nth(c, cond):
    return f"arg_min({c}, id) FILTER (WHERE {cond})"


@query("e6_merge_clusters", f"""
SELECT min(id) AS id, coalesce({nth('venue_name', "venue_name <> ''")}, arg_min(venue_name, id)) AS venue_name,
  {nth('round(latitude, 6)', 'latitude IS NOT NULL')} AS latitude,
  strftime(coalesce({nth('end_date', 'hour(end_date) <> 0')}, {nth('end_date', 'end_date IS NOT NULL')}), '%Y-%m-%d %H:%M:%S') AS end_date,
  arg_min(source, id) AS source, coalesce({nth('region', "region <> ''")}, 'westside') AS region,
  arg_max(price_note, id) AS price_note, arg_max(is_free, id) AS is_free,
  coalesce(round(list_extract(list(price ORDER BY id DESC) FILTER (WHERE price IS NOT NULL OR lower(price_note) LIKE '%sold out%'), 1), 2), -1) AS price,
  max(length(description)) AS longest
FROM (SELECT *, id % 300 AS c FROM listings) GROUP BY c
""", "listings")
def _(t):
    clusters = t.listings.select("id", (F.col("id") % 300).alias("cluster"))
    merged = E.merge_clusters(t.listings, clusters, AS_OF)
    return plain(merged.select(
        "id", "venue_name", "latitude", "end_date", "source", "region", "price_note", "is_free",
        F.coalesce(F.round("price", 2), F.lit(-1.0)).alias("price"), F.length("description").alias("longest")))


@query("e5_upsert_batch_spaced", f"""WITH {OWN_PAIRS}
SELECT a_id AS id, b_id AS listing_id, true AS was_duplicate FROM matched WHERE match_method IS NOT NULL
UNION ALL
SELECT a_id, (SELECT max(id) FROM spaced) + row_number() OVER (ORDER BY a_id), false FROM matched WHERE match_method IS NULL
""", "spaced_incoming")
def _(t):
    return E.upsert_batch(t.spaced_incoming, t.spaced, AS_OF)["outcomes"]


@query("e5_upsert_batch")
def _(t):
    return E.upsert_batch(t.incoming, t.listings, AS_OF)["outcomes"]


@query("e5_upsert_table_size")
def _(t):
    done = E.upsert_batch(t.incoming, t.listings, AS_OF)
    return done["table"].agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query("e7_titles_compatible", f"""WITH {OWN_PAIRS}
SELECT a_id, b_id, t >= 0.5 AS compatible FROM measured WHERE one_url AND gap <= 24""", "spaced_incoming")
def _(t):
    pairs = M.dup_by_url(M.match_facts(t.spaced_incoming), M.match_facts(t.spaced))
    return pairs.select("a_id", "b_id", M.titles_compatible("b", "a").alias("compatible"))


@query("e7_titles_compatible_listings")
def _(t):
    pairs = M.dup_by_url(M.match_facts(t.incoming), M.match_facts(t.listings))
    return pairs.select("a_id", "b_id", M.titles_compatible("b", "a").alias("compatible"))


@query("x37_similarity")
def _(t):
    from marquee.functions.similarity import similarity

    pairs = t.listings.select("id", F.round(similarity(F.col("title"), F.col("description")), 6).alias("score"))
    return pairs
