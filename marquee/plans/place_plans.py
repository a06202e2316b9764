"""Checked queries: categories, area rules, coordinate lookup, audits, cards."""

from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.functions.dates import plus
from marquee.operators import build as B
from marquee.operators import categorize as C
from marquee.operators import enrich as N
from marquee.operators import geocode as O
from marquee.operators import geofence as GF
from marquee.operators import quality as Q
from marquee.plans.catalog import plain, query
from marquee.plans.expression_plans import (
    DATE_LABEL, IN_COAST, IN_CORE, IN_COUNTY, MILES, PRICE_LABEL, THEMES, TIME_LABEL,
    city_hint_sql, in_area_sql,
)
from marquee.plans.expression_plans import _norm_address_sql as norm_address_sql
from marquee.plans.views import AS_OF

TEXT = "lower(coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(venue_name, ''))"


def hits(terms, text="txt"):
    return " + ".join(f"CAST(contains({text}, '{k.lower()}') AS INT)" for k in terms)


def scores_sql(keywords=V.CATEGORY_KEYWORDS):
    rows = []
    for i, (category, terms) in enumerate(keywords.items()):
        bonus = ""
        if category in V.CATEGORY_VENUES:
            any_venue = " OR ".join(f"contains(ven, '{v}')" for v in V.CATEGORY_VENUES[category])
            bonus = f" + CASE WHEN {any_venue} THEN 5 ELSE 0 END"
        rows.append(f"SELECT id, {i} AS ord, '{category}' AS cat,"
                    f" ({hits(terms)}{bonus}) * {V.CATEGORY_PRIORITY.get(category, 1.0)} AS score,"
                    f" {hits(terms)} AS raw FROM base")
    return (f"base AS (SELECT id, {TEXT} AS txt, lower(coalesce(venue_name, '')) AS ven FROM listings),"
            f" scores AS ({' UNION ALL '.join(rows)}),"
            " best AS (SELECT l.id, coalesce(s.cat, 'Other') AS cat FROM listings l LEFT JOIN"
            " (SELECT id, cat FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) AS rn"
            " FROM scores WHERE score > 0) WHERE rn = 1) s ON s.id = l.id)")


@query("c1_classify", f"WITH {scores_sql()} SELECT id, cat AS category FROM best", "listings")
def _(t):
    return C.classify(t.listings.drop("category")).select("id", "category")


@query("c2_classify_multi", f"""WITH {scores_sql()}
SELECT l.id, coalesce(s.cats, 'Other') AS categories FROM listings l LEFT JOIN
 (SELECT id, string_agg(cat, '|' ORDER BY ord) AS cats FROM scores WHERE raw >= 2 GROUP BY id) s ON s.id = l.id
""", "listings")
def _(t):
    return plain(C.classify_multi(t.listings).select("id", "categories"))


MORE = {**V.CATEGORY_KEYWORDS, "Tech": [*V.CATEGORY_KEYWORDS["Tech"], "widget", "gizmo"]}


@query("c3_with_keyword", f"WITH {scores_sql(MORE)} SELECT id, cat AS category FROM best", "listings")
def _(t):
    dim = C.keyword_dimension(t.spark)
    for word in ("Widget", "gizmo", "STARTUP"):
        dim = C.with_keyword(dim, "Tech", word)
    return C.classify(t.listings, keywords=C.keyword_mapping(dim)).select("id", "category")


@query("c4_reclassify", f"""WITH {scores_sql()}
SELECT l.id, l.category, b.cat AS new_category, l.category IS DISTINCT FROM b.cat AS changed
FROM listings l JOIN best b ON b.id = l.id
""", "listings")
def _(t):
    return C.reclassify(t.listings)


@query("c5_reclassify_retired", f"""WITH {scores_sql()}
SELECT l.id, CASE WHEN l.category = 'Family' THEN b.cat ELSE l.category END AS category
FROM listings l JOIN best b ON b.id = l.id
""", "listings")
def _(t):
    return C.reclassify_retired(t.listings, AS_OF, ["Family"]).select("id", "category")


@query("a20_reclass_counts", f"""WITH {scores_sql()}
SELECT b.cat AS category, CAST(count(*) AS BIGINT) AS n FROM listings l JOIN best b ON b.id = l.id
WHERE l.category = 'Family' GROUP BY 1
""", "listings")
def _(t):
    return C.reclass_counts(C.retired_changes(t.listings, ["Family"]))


@query("c6_rule_category", f"""
SELECT id, CASE {' '.join(f"WHEN contains(x, '{k}') THEN '{c}'" for k, c in V.BAR_NIGHT_RULES)} ELSE 'Nightlife' END AS category
FROM (SELECT id, lower(title || CASE id % 4 WHEN 0 THEN ' Quiz night' WHEN 1 THEN ' DJ comedy' ELSE '' END) AS x FROM listings)
""", "listings")
def _(t):
    k = F.col("id") % 4
    text = F.concat("title", F.when(k == 0, " Quiz night").when(k == 1, " DJ comedy").otherwise(""))
    rows = t.listings.withColumn("x", text)
    return C.rule_category(rows, "x", V.BAR_NIGHT_RULES, "Nightlife").select("id", "category")


TAGS_SQL = ", ".join("('" + k.replace("'", "''") + f"', '{v}')" for k, v in V.CATEGORY_TAGS.items())


@query("c7_map_category", f"""
SELECT l.id, coalesce(d.category, 'Other') AS category
FROM (SELECT id, CASE id % 5 WHEN 0 THEN 'Arts & Theatre' WHEN 1 THEN 'museums' WHEN 2 THEN category WHEN 3 THEN 'FAMILY' ELSE 'odd' END AS tag FROM listings) l
LEFT JOIN (VALUES {TAGS_SQL}) d(tag, category) ON d.tag = lower(l.tag)
""", "listings")
def _(t):
    k = F.col("id") % 5
    tag = F.when(k == 0, "Arts & Theatre").when(k == 1, "museums").when(k == 2, F.col("category")).when(k == 3, "FAMILY").otherwise("odd")
    rows = t.listings.withColumn("tag", tag).drop("category")
    return C.map_category(rows, "tag", C.category_tags(t.spark)).select("id", "category")


NAMED = in_area_sql("address", "venue_name")
DENY = "contains(lower(concat_ws(' ', nullif(venue_name, ''), title)), 'la cienega farmers market')"
ALLOW = "contains(lower(concat_ws(' ', nullif(venue_name, ''), title)), 'io music academy')"
LOCATED = "latitude IS NOT NULL"
BEYOND = f"CASE WHEN {LOCATED} AND {IN_COUNTY} THEN 'in_la_county' WHEN {LOCATED} THEN 'outside_la_county' ELSE 'beyond_source_unlocated' END"
FENCE = f"""CASE WHEN {DENY} THEN 'denylisted_venue' WHEN region = 'beyond' THEN {BEYOND}
  WHEN {ALLOW} THEN 'allowlisted_venue'
  WHEN {LOCATED} AND ({IN_CORE} OR {IN_COAST}) THEN 'coordinates_in_bounds'
  WHEN {LOCATED} AND {NAMED} AND {MILES} <= 12 THEN 'address_match_near_area'
  WHEN {LOCATED} THEN 'coordinates_outside_area'
  WHEN {NAMED} THEN 'address_text_match'
  WHEN address = '' AND venue_name = '' THEN 'no_location_info' ELSE 'address_not_recognized' END"""
STRICT = f"""CASE WHEN {DENY} THEN 'denylisted_venue' WHEN region = 'beyond' THEN {BEYOND}
  WHEN {ALLOW} THEN 'allowlisted_venue'
  WHEN {LOCATED} AND ({IN_CORE} OR {IN_COAST}) THEN 'coordinates_in_bounds'
  WHEN {LOCATED} THEN 'coordinates_outside_area'
  WHEN {NAMED} THEN 'address_text_match' ELSE 'address_not_recognized' END"""
YES = """reason IN ('in_la_county', 'beyond_source_unlocated', 'allowlisted_venue', 'coordinates_in_bounds',
  'address_match_near_area', 'address_text_match')"""
FENCED_ROWS = """(SELECT id, region, latitude, longitude,
  CASE WHEN id % 31 = 0 THEN '' ELSE address END AS address,
  CASE WHEN id % 31 = 0 THEN '' WHEN id % 37 = 0 THEN 'La Cienega Farmers Market' WHEN id % 41 = 0 THEN 'IO Music Academy LA' ELSE venue_name END AS venue_name,
  title FROM listings)"""


def _fenced(t):
    k31, k37, k41 = (F.col("id") % n == 0 for n in (31, 37, 41))
    venue = F.when(k31, "").when(k37, "La Cienega Farmers Market").when(k41, "IO Music Academy LA")
    return t.listings.withColumn("address", F.when(k31, "").otherwise(F.col("address"))).withColumn(
        "venue_name", venue.otherwise(F.col("venue_name")))


@query("f18_geofence", f"""
SELECT id, reason, {YES} AS accepted FROM (SELECT id, {FENCE} AS reason FROM {FENCED_ROWS})
""", "listings")
def _(t):
    return GF.geofence(_fenced(t)).select("id", "reason", "accepted")


@query("f19_geofence_beyond", f"""
SELECT id, reason, reason <> 'outside_la_county' AS accepted FROM (SELECT id, {BEYOND} AS reason FROM listings)
""", "listings")
def _(t):
    return GF.geofence_beyond(t.listings).select("id", "reason", "accepted")


@query("f20_venue_listed", f"SELECT id, {DENY} AS denied, {ALLOW} AS allowed FROM {FENCED_ROWS}", "listings")
def _(t):
    return _fenced(t).select("id", GF.venue_listed(V.VENUE_DENYLIST).alias("denied"),
                             GF.venue_listed(V.VENUE_ALLOWLIST).alias("allowed"))


@query("f21_geofence_strict", f"""
SELECT id, reason, {YES} AS accepted FROM (SELECT id, {STRICT} AS reason FROM {FENCED_ROWS})
""", "listings")
def _(t):
    return GF.geofence(_fenced(t), strict=True).select("id", "reason", "accepted")


# Geocode table derived from the listings: one row per address key, of mixed age.
NOW_S = 898079400.0
GEO_SQL = f"""geo AS (
  SELECT address_key, CASE WHEN k % 5 = 4 THEN NULL ELSE 34.0 + k % 7 / 100.0 END AS lat,
    CASE WHEN k % 5 = 4 THEN NULL ELSE -118.4 - k % 3 / 100.0 END AS lng,
    CASE WHEN k % 6 = 5 THEN 0.0 ELSE {NOW_S} - 86400.0 * (k % 120) END AS cached_at
  FROM (SELECT lower(trim(address)) AS address_key, min(id) AS k FROM listings WHERE id % 3 = 0 GROUP BY 1
        UNION ALL SELECT lower({norm_address_sql('address')}), min(id) FROM listings WHERE id % 3 = 1 GROUP BY 1
        UNION ALL SELECT lower(venue_name || ', ' || {city_hint_sql('address')}), min(id) FROM listings WHERE venue_name <> '' AND id % 4 = 2 GROUP BY 1
        UNION ALL SELECT '1 override way', 7)),
 state AS (SELECT address_key, lat, lng,
   CASE WHEN lat IS NOT NULL AND (cached_at = 0 OR {NOW_S} - cached_at < 7776000) THEN 'hit'
        WHEN lat IS NULL AND {NOW_S} - cached_at < 604800 THEN 'negative' ELSE 'miss' END AS state FROM geo)"""


def _geocodes(t):
    from marquee.functions import text as X

    rows = t.listings
    def keyed(where, key):
        return rows.where(where).groupBy(key.alias("address_key")).agg(F.min("id").alias("k"))
    parts = keyed("id % 3 = 0", O.address_key("address")).unionByName(
        keyed("id % 3 = 1", O.address_key(X.norm_address("address")))).unionByName(
        keyed("id % 4 = 2 and venue_name <> ''",
              F.lower(F.concat("venue_name", F.lit(", "), X.city_hint("address"))))).unionByName(
        t.spark.range(1).select(F.lit("1 override way").alias("address_key"), F.lit(7).cast("bigint").alias("k")))
    known = F.col("k") % 5 != 4
    return parts.select(
        "address_key",
        F.when(known, 34.0 + F.col("k") % 7 / 100.0).alias("lat"),
        F.when(known, -118.4 - F.col("k") % 3 / 100.0).alias("lng"),
        F.when(F.col("k") % 6 == 5, 0.0).otherwise(NOW_S - 86400.0 * (F.col("k") % 120)).alias("cached_at"))


def _usable(t):
    return O.fresh_geocodes(_geocodes(t), AS_OF).where("state = 'hit'").dropDuplicates(["address_key", "lat", "lng"])


@query("g1_fresh_geocodes", f"WITH {GEO_SQL} SELECT address_key, state FROM state", "listings")
def _(t):
    return O.fresh_geocodes(_geocodes(t), AS_OF).select("address_key", "state")


@query("j9_attach_coords", f"""WITH {GEO_SQL},
 keys AS (
  SELECT id, 1 AS step, lower(trim(address)) AS k FROM listings UNION ALL
  SELECT id, 2, lower({norm_address_sql('address')}) FROM listings UNION ALL
  SELECT id, 3, '1 override way' FROM listings WHERE venue_name = 'Venue 7' UNION ALL
  SELECT id, 4, lower(venue_name || ', ' || {city_hint_sql('address')}) FROM listings WHERE venue_name <> '')
SELECT l.id, CAST(h.step AS BIGINT) AS geo_step, round(h.lat, 4) AS geo_lat, round(h.lng, 4) AS geo_lng
FROM listings l LEFT JOIN (SELECT id, step, lat, lng FROM (
   SELECT keys.id, step, lat, lng, row_number() OVER (PARTITION BY keys.id ORDER BY step, lat, lng) AS rn
   FROM keys JOIN state ON state.address_key = keys.k WHERE state = 'hit') WHERE rn = 1) h ON h.id = l.id
""", "listings")
def _(t):
    curated = t.spark.range(1).select(F.lit("venue 7").alias("venue_key"), F.lit("1 Override Way").alias("address"))
    found = O.attach_coords(t.listings, _usable(t), curated)
    return plain(found.select("id", "geo_step", F.round("geo_lat", 4).alias("geo_lat"),
                              F.round("geo_lng", 4).alias("geo_lng")))


@query("j10_venue_overrides", """
SELECT id, CASE WHEN lower(trim(venue_name)) LIKE 'venue _' THEN 'curated ' || lower(trim(venue_name)) END AS override_address,
  CASE WHEN id % 9 = 0 THEN '1900 Pico Blvd, Santa Monica, CA 90405' END AS known FROM listings
""", "listings")
def _(t):
    dim = t.listings.select(O.venue_key("venue_name").alias("venue_key")).where(
        "venue_key like 'venue _'").distinct().withColumn(
        "address", F.concat(F.lit("curated "), "venue_key"))
    joined = O.venue_overrides(t.listings, dim)
    stage = F.when(F.col("id") % 9 == 0, "Santa Monica College Theatre Arts Stage").otherwise(
        F.col("venue_name"))
    return joined.withColumn("venue_name", stage).select(
        "id", "override_address", O.known_venue_address().alias("known"))


@query("j11_price_overrides", """
SELECT id, CASE WHEN coalesce(price, 0) = 0 AND url <> '' AND id % 2 = 0 THEN CAST(id % 40 AS DOUBLE) ELSE round(price, 2) END AS price,
  CASE WHEN coalesce(price, 0) = 0 AND url <> '' AND id % 2 = 0 THEN 'Manually verified pricing' ELSE price_note END AS price_note FROM listings
""", "listings")
def _(t):
    dim = t.raw("orders").where("o_orderkey % 2 = 0").select(
        F.col("o_orderkey").cast("string").alias("event_key"),
        (F.col("o_orderkey") % 40).cast("double").alias("min_price"))
    return N.price_overrides(t.listings, dim).select("id", F.round("price", 2).alias("price"), "price_note")


@query("j12_enrich", """
SELECT id, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'detail ' || id ELSE description END AS description,
  CASE WHEN id % 3 = 0 THEN o_orderstatus END AS status FROM listings JOIN orders ON o_orderkey = id
""", "listings")
def _(t):
    detail = t.raw("orders").where("o_orderkey % 3 = 0").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("detail "), F.col("o_orderkey").cast("string")))
        .otherwise("").alias("description"),
        F.col("o_orderstatus").alias("status"))
    return N.enrich(t.listings, detail, ["id"]).select("id", "description", "status")


@query("j12_full_titles", """
SELECT id, CASE WHEN id % 3 = 0 THEN title ELSE substr(title, 1, 9) || '...' END AS title FROM listings
""", "listings")
def _(t):
    cut = t.listings.withColumn("title", F.concat(F.substring("title", 1, 9), F.lit("...")))
    detail = t.listings.where("id % 3 <> 2").select(
        "id", F.when(F.col("id") % 3 == 0, F.col("title")).otherwise("Another").alias("title"))
    return N.full_titles(cut, detail, ["id"]).select("id", "title")


@query("o5_budget", """
SELECT address_key, freq FROM (SELECT lower(trim(address)) AS address_key, CAST(count(*) AS BIGINT) AS freq
  FROM listings GROUP BY 1) ORDER BY freq DESC, address_key LIMIT 15
""", "listings")
def _(t):
    work = t.listings.groupBy(O.address_key("address").alias("address_key")).agg(F.count(F.lit(1)).alias("freq"))
    return O.budget(work, 15)


@query("g2_geocode_worklist", f"""WITH {GEO_SQL}
SELECT lower(trim(address)) AS address_key, CAST(count(*) AS BIGINT) AS freq FROM listings
WHERE latitude IS NULL AND lower(trim(address)) NOT IN (SELECT address_key FROM state WHERE state <> 'miss')
GROUP BY 1 ORDER BY freq DESC, address_key LIMIT 30
""", "listings")
def _(t):
    return O.geocode_worklist(t.listings, O.fresh_geocodes(_geocodes(t), AS_OF), 30)


@query("g3_backfill_coords", """
SELECT id, CASE WHEN latitude IS NULL AND id % 2 = 0 THEN 'better ' || address ELSE address END AS address,
  CASE WHEN latitude IS NULL AND id % 2 = 0 THEN 34.01 ELSE round(latitude, 6) END AS latitude,
  CASE WHEN latitude IS NULL AND id % 2 = 0 THEN '1998-06-17 10:30:00' ELSE strftime(updated_at, '%Y-%m-%d %H:%M:%S') END AS updated_at
FROM listings
""", "listings")
def _(t):
    rows = t.listings.withColumn("address", F.concat("address", F.lit(" "), F.col("id").cast("string")))
    better = rows.where("id % 2 = 0").select("address", F.concat(F.lit("better "), "address").alias("better"))
    geo = better.select(O.address_key("better").alias("address_key"), F.lit(34.01).alias("lat"), F.lit(-118.4).alias("lng"))
    out = O.backfill_coords(rows, geo, better, AS_OF)
    bare = F.regexp_replace("address", r" \d+$", "")
    return plain(out.select("id", bare.alias("address"), "latitude", "updated_at"))


DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
AUDITED = """aud AS (SELECT id, source, title, event_date,
    CASE WHEN id % 4 = 0 THEN event_date ELSE updated_at END AS updated_at, id % 3 = 0 AS named, id % 7 AS wd
  FROM listings WHERE event_date >= TIMESTAMP '1998-06-17')"""
MISMATCH = "named AND wd <> isodow(event_date) - 1"
FAR = "floor(epoch(event_date - TIMESTAMP '1998-06-17 10:30:00') / 86400) > 400"


def _audited(t):
    name = F.element_at(F.array(*[F.lit(d) for d in DAYS]), (F.col("id") % 7 + 1).cast("int"))
    told = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Every "), name, F.lit(", "), F.coalesce("description", F.lit(""))))
    return t.listings.withColumn("description", told.otherwise(F.col("description"))).withColumn(
        "updated_at", F.when(F.col("id") % 4 == 0, F.col("event_date")).otherwise(F.col("updated_at")))


@query("q1_audit_weekday", f"WITH {AUDITED} SELECT id, source FROM aud WHERE {MISMATCH}", "listings")
def _(t):
    return Q.audit_weekday(Q.ahead(_audited(t), AS_OF)).select("id", "source")


@query("q2_audit_far_future", f"WITH {AUDITED} SELECT id, source FROM aud WHERE {FAR}", "listings")
def _(t):
    return Q.audit_far_future(Q.ahead(_audited(t), AS_OF), AS_OF).select("id", "source")


ANCHORED = """anch AS (SELECT *, CAST(event_date AS DATE) AS d FROM aud WHERE CAST(event_date AS DATE) = CAST(updated_at AS DATE)),
 rep AS (SELECT id, source FROM anch WHERE (source, title) IN (SELECT (source, title) FROM anch GROUP BY source, title HAVING count(DISTINCT d) >= {n}))"""


@query("w6_repeat_anchored", f"WITH {AUDITED}, {ANCHORED.format(n=2)} SELECT id, source FROM rep", "listings")
def _(t):
    return Q.repeat_anchored(Q.ahead(_audited(t), AS_OF), 2).select("id", "source")


FOUND = f"""WITH {AUDITED}, {ANCHORED.format(n=3)},
 found AS (SELECT id, source, 'weekday_mismatch' AS finding FROM aud WHERE {MISMATCH}
  UNION ALL SELECT id, source, 'far_future' FROM aud WHERE {FAR}
  UNION ALL SELECT id, source, 'anchored_to_scrape_date' FROM rep)"""


@query("q3_audit_findings", f"{FOUND} SELECT id, source, finding FROM found", "listings")
def _(t):
    return Q.audit_findings(_audited(t), AS_OF)


@query("a21_audit_counts", f"""{FOUND}
SELECT source, CAST(count(*) FILTER (WHERE finding = 'anchored_to_scrape_date') AS BIGINT) AS anchored_to_scrape_date,
  CAST(count(*) FILTER (WHERE finding = 'far_future') AS BIGINT) AS far_future,
  CAST(count(*) FILTER (WHERE finding = 'weekday_mismatch') AS BIGINT) AS weekday_mismatch,
  CAST(count(*) AS BIGINT) AS total FROM found GROUP BY source
""", "listings")
def _(t):
    return Q.audit_counts(Q.audit_findings(_audited(t), AS_OF))


@query("a18_table_health", """
SELECT CAST(count(*) AS BIGINT) AS n, strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') AS latest,
  round(epoch(TIMESTAMP '2001-08-03 12:00:00' - max(updated_at)) / 3600, 2) AS age_hours,
  CASE WHEN epoch(TIMESTAMP '2001-08-03 12:00:00' - max(updated_at)) / 3600 > 48 THEN 'warning' ELSE 'healthy' END AS status
FROM listings
""", "listings")
def _(t):
    return plain(Q.table_health(t.listings, "2001-08-03 12:00:00"))


def _runs(t):
    per = t.incoming.groupBy("source").agg(
        F.count(F.lit(1)).alias("scraped"),
        F.round(F.sum(F.col("id") % 50) / 10.0, 1).alias("duration_s"))
    return per.select("source", (F.length("source") % 3 != 0).alias("ok"), "duration_s", "scraped")


RUNS = """runs AS (SELECT source, length(source) % 3 <> 0 AS ok, round(sum(id % 50) / 10.0, 1) AS duration_s,
  count(*) AS scraped FROM listings_incoming GROUP BY source)"""


@query("a19_run_summary", f"""WITH {RUNS}
SELECT CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS successful, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS failed,
  CAST(sum(scraped) AS BIGINT) AS scraped, round(sum(duration_s), 2) AS total_s, round(avg(duration_s), 2) AS avg_s,
  round(sum(scraped) / sum(duration_s), 1) AS rows_per_s,
  (SELECT source FROM runs WHERE ok ORDER BY duration_s, source LIMIT 1) AS fastest,
  (SELECT source FROM runs WHERE ok ORDER BY duration_s DESC, source DESC LIMIT 1) AS slowest
FROM runs
""", "listings_incoming")
def _(t):
    return plain(Q.run_summary(_runs(t)))


@query("a19_source_outcomes", f"""WITH {RUNS}
SELECT source, ok, scraped, CAST((SELECT count(*) FROM listings_incoming i WHERE i.source = r.source AND id % 2 = 1) AS BIGINT) AS saved,
  CAST((SELECT count(*) FROM listings_incoming i WHERE i.source = r.source AND id % 2 = 0) AS BIGINT) AS skipped FROM runs r
""", "listings_incoming")
def _(t):
    outcomes = t.incoming.select("source", (F.col("id") % 2 == 0).alias("was_duplicate"))
    return plain(Q.source_outcomes(_runs(t), outcomes))


@query("a22_clock_skew", """
WITH nodes AS (SELECT source AS page, event_date + INTERVAL '20' HOUR AS wall, id,
   CASE WHEN id % 10 = 0 THEN NULL WHEN length(source) = 8 AND id % 9 <> 0 THEN hour(timezone('America/Los_Angeles', timezone('UTC', event_date + INTERVAL '20' HOUR))) * 60
        WHEN source = 'NATION_12' AND id % 8 <> 0 THEN (hour(event_date + INTERVAL '20' HOUR) * 60 + 1380) % 1440 ELSE id % 1440 END AS local_min FROM listings),
 votes AS (SELECT page, CASE WHEN skew <> 0 AND hour(timezone('America/Los_Angeles', timezone('UTC', wall))) * 60 = local_min THEN 'utc' ELSE CAST(skew AS VARCHAR) END AS vote
  FROM (SELECT *, (hour(wall) * 60 - local_min + 720 + 1440) % 1440 - 720 AS skew FROM nodes WHERE local_min IS NOT NULL)),
 counts AS (SELECT page, vote, count(*) AS n FROM votes GROUP BY 1, 2)
SELECT p.page, CASE WHEN t.total IS NULL THEN 'stated' WHEN w.vote <> '0' THEN w.vote END AS mode
FROM (SELECT DISTINCT page FROM nodes) p
LEFT JOIN (SELECT page, sum(n) AS total FROM counts GROUP BY 1) t ON t.page = p.page
LEFT JOIN counts w ON w.page = p.page AND w.n * 2 > t.total
""".strip(), "listings")
def _(t):
    from marquee.functions.dates import utc_to_local

    wall = plus("event_date", 20, "HOUR")
    local = utc_to_local(wall)
    minute = (
        F.when(F.col("id") % 10 == 0, F.lit(None))
        .when((F.length("source") == 8) & (F.col("id") % 9 != 0), F.hour(local) * 60)
        .when((F.col("source") == "NATION_12") & (F.col("id") % 8 != 0), (F.hour(wall) * 60 + 1380) % 1440)
        .otherwise(F.col("id") % 1440))
    nodes = t.listings.select(F.col("source").alias("page"), wall.alias("wall"), minute.alias("local_min"))
    return Q.clock_skew(nodes)


@query("q4_build_listings", f"""WITH {scores_sql()}
SELECT l.id, title, category, latitude, reason FROM (
  SELECT l.id, trim(title) AS title, coalesce(nullif(l.category, ''), b.cat) AS category, round(latitude, 4) AS latitude, {FENCE} AS reason
  FROM (SELECT * REPLACE (coalesce(latitude, 34.02) AS latitude, coalesce(longitude, -118.41) AS longitude) FROM listings) l JOIN best b ON b.id = l.id) l
WHERE {YES}
""", "listings")
def _(t):
    geo = t.listings.select(O.address_key("address").alias("address_key")).distinct().select(
        "address_key", F.lit(34.02).alias("lat"), F.lit(-118.41).alias("lng"))
    built = B.build_listings(t.listings, geo)
    fenced = GF.geofence(built)
    return plain(fenced.select("id", "title", "category", F.round("latitude", 4).alias("latitude"), "reason"))


@query("q5_listing_cards", f"""
SELECT id, title, venue_name, trim(regexp_replace(address, ', CA [0-9]+$', '')) AS address,
  {DATE_LABEL} AS date_label, {TIME_LABEL} AS time_label,
  CASE WHEN image_url <> '' THEN image_url ELSE CASE lower(coalesce(category, '')) {THEMES} ELSE 'other' END END AS image_or_theme,
  {PRICE_LABEL} AS price_label,
  CASE WHEN {IN_CORE} THEN 'westside' WHEN {IN_COAST} THEN 'malibu' ELSE 'outside' END AS area
FROM listings
""", "listings")
def _(t):
    cards = B.listing_cards(t.listings, AS_OF)
    stock = F.regexp_extract("image", r"^/static/stock/([a-z]+)/", 1)
    return cards.select("id", "title", "venue_name", "address", "date_label", "time_label",
                        F.when(stock != "", stock).otherwise(F.col("image")).alias("image_or_theme"),
                        "price_label", "area")


@query("q6_publish", "SELECT id, title FROM listings", "listings")
def _(t):
    from marquee.session import job_folder

    path = job_folder(t.spark, "publish")
    B.publish(t.listings, path)
    return B.read_published(t.spark, path).select("id", "title")
