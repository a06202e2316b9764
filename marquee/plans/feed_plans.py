"""Checked queries: feed extraction and exports.

Feeds are built from listings rows, so reading them back must give those rows.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from marquee.functions import dates as D
from marquee.functions import variants as J
from marquee.plans.catalog import plain, query
from marquee.plans.views import AS_OF
from marquee.session import dealt, job_folder
from marquee.sources import exports as K
from marquee.sources import feeds as S

TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
ISO = "yyyy-MM-dd'T'HH:mm:ss"


def iso(c):
    return F.date_format(c, ISO)


# A payload holds at most this many ids of one source, however large the tables.
PER_PAYLOAD = 200
# A file of items holds at most this many ids of one source.
PER_FILE = 50_000
PART = "source || '-' || (id // 200)"


def part():
    """Name of the payload a listing is in."""
    return F.concat("source", F.lit("-"), F.floor(F.col("id") / PER_PAYLOAD).cast("string"))


def per_source(t, entry, wrap="entries"):
    """Payloads (source, part, payload) holding an entry per listing."""
    rows = t.listings.groupBy("source", part().alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("id", entry.alias("e")))).alias("es"))
    return rows.select("source", "part", F.to_json(F.struct(F.col("es.e").alias(wrap))).alias("payload"))


@query("s5_json_feed", f"""
SELECT source, id, title, {TS.format("event_date")} AS event_date, round(latitude, 6) AS latitude,
  CASE WHEN venue_name <> '' THEN venue_name END AS venue_name FROM listings
""", "listings")
def _(t):
    entry = F.struct(
        "id", F.col("title").alias("name"), iso("event_date").alias("start_at"),
        F.struct(F.col("venue_name").alias("name"), F.col("latitude").alias("lat")).alias("place"))
    feed = per_source(t, entry)
    rows = S.from_json_feed(feed, "payload", "$.entries", {
        "id": "$.id::bigint", "title": "$.name", "event_date": "$.start_at::local",
        "latitude": "$.place.lat::double", "venue_name": "$.place.name"}, ["source"])
    return plain(rows.select("source", "id", "title", "event_date", "latitude", "venue_name"))


def _ld_pages(t):
    """Events alone, in a list, a graph, an item list, below a place, three levels down; some dated in words, one unreadable."""
    k = F.col("id") % 7
    place = F.struct(F.lit("Place").alias("@type"), F.col("venue_name").alias("name"),
                     F.struct(F.col("address").alias("streetAddress")).alias("address"),
                     F.struct("latitude", "longitude").alias("geo"))
    told = F.date_format("event_date", "MMMM d, yyyy h:mm a")
    start = F.when(F.col("id") % 9 == 0, told).when(F.col("id") % 9 == 1, "some day").otherwise(iso("event_date"))
    node = F.to_json(F.struct(
        F.when(k == 1, "MusicEvent").otherwise("Event").alias("@type"), F.col("title").alias("name"),
        start.alias("startDate"), iso("end_date").alias("endDate"), place.alias("location"),
        F.array("image_url").alias("image"), F.col("url"),
        F.when(F.col("is_free"), F.struct(F.lit("0").alias("price"))).otherwise(
            F.struct(F.round("price", 2).cast("string").alias("price"))).alias("offers")))
    ld = (F.when(k == 0, node).when(k == 1, F.concat(F.lit("["), node, F.lit(', {"@type": "Place", "name": "x"}]')))
          .when(k == 2, F.concat(F.lit('{"@context": "x", "@graph": ['), node, F.lit("]}")))
          .when(k == 3, F.concat(F.lit('{"@type": "Place", "name": "x", "event": ['), node, F.lit("]}")))
          .when(k == 4, F.concat(F.lit('{"@graph": [{"@type": "WebPage", "mainEntity": {"about": '), node, F.lit("}}]}")))
          .otherwise(F.concat(F.lit('{"@type": "ItemList", "itemListElement": [{"item": '), node, F.lit("}]}"))))
    html = F.concat(F.lit('<html><script type="application/ld+json">{broken</script>'
                          '<script data-x type="application/ld+json">\n'), ld, F.lit("</script><p>x</p></html>"))
    return dealt(t.listings).select(F.col("id").alias("page_id"), F.lit("https://p.example.com/").alias("url"), html.alias("html"))


@query("s6_json_ld", f"""
SELECT id AS page_id, trim(title) AS title, {TS.format("event_date")} AS event_date, {TS.format("end_date")} AS end_date,
  venue_name, address, image_url, CASE WHEN url = '' THEN 'https://p.example.com/' ELSE url END AS url,
  CASE WHEN NOT is_free THEN round(price, 2) END AS price, is_free FROM listings WHERE id % 9 <> 1
""", "listings")
def _(t):
    return plain(S.from_json_ld(_ld_pages(t)).select(
        "page_id", "title", "event_date", "end_date", "venue_name", "address", "image_url", "url", "price", "is_free"))


@query("s6_rejected_events", "SELECT id AS page_id, 'some day' AS start_text, 'startDate' AS reason FROM listings WHERE id % 9 = 1", "listings")
def _(t):
    return S.rejected_events(_ld_pages(t)).select("page_id", "start_text", "reason")


@query("s7_page_state", f"""
SELECT source, id, title, {TS.format("event_date")} AS event_date FROM listings
""", "listings")
def _(t):
    entry = F.struct("id", "title", iso("event_date").alias("at"))
    feed = per_source(t, entry)
    by_id = F.length("source") % 2 == 0
    pages = feed.select(
        "source", F.lit("u").alias("url"),
        F.when(by_id, F.concat(F.lit('<script id="__STATE__" type="application/json">'), "payload", F.lit("</script>")))
        .otherwise(F.concat(F.lit("<script>window.__STATE__ = "), "payload", F.lit(";</script>"))).alias("html"))
    rows = S.from_page_state(pages, "__STATE__", "$.entries",
                             {"id": "$.id::bigint", "title": "$.title", "event_date": "$.at::local"}, ["source"])
    return plain(rows.select("source", "id", "title", "event_date"))


@query("s8_chunked_state", f"""
SELECT {PART} AS page_id, CAST(id AS VARCHAR) AS entry, title || '!' AS title FROM listings WHERE title <> ''
""", "listings")
def _(t):
    def entry(title):
        return F.struct(title.alias("title"), iso("event_date").alias("start"), F.lit("s").alias("slug"),
                        F.struct(F.col("id").cast("string").alias("id")).alias("sys"))
    old = per_source(t, entry(F.col("title")), "events")
    new = per_source(t, entry(F.concat("title", F.lit("!"))), "events").withColumnRenamed("payload", "newer")
    flight = F.concat(F.lit('x "events":[ broken, then '), "payload", F.lit(" and "), "newer")
    half = F.floor(F.length("flight") / 2).cast("int")

    def push(text):
        literal = F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")
        return F.concat(F.lit("<script>self.__next_f.push([1,"), literal, F.lit("])</script>"))

    pages = old.join(new.drop("source"), "part").withColumn("flight", flight).select(
        F.col("part").alias("page_id"),
        F.concat(push(F.substring("flight", F.lit(1), half)),
                 push(F.substring("flight", half + 1, F.length("flight")))).alias("html"))
    return S.from_chunked_state(pages, {"title": "$.title"}).select("page_id", "entry", "title")


def _ics_feeds(t):
    block = F.concat(
        F.lit("BEGIN:VEVENT\r\nUID:"), F.col("id").cast("string"),
        F.lit("\r\nDTSTART;TZID=America/Los_Angeles:"), F.date_format("event_date", "yyyyMMdd'T'HHmmss"),
        F.lit("\r\nSUMMARY:a long\r\n  "), F.col("title"), F.lit("\r\nX:1\r\nX:2\r\nEND:VEVENT\r\n"))
    rows = t.listings.groupBy(part().alias("feed")).agg(
        F.array_sort(F.collect_list(F.struct("id", block.alias("b")))).alias("bs"))
    return rows.select("feed",
                       F.concat(F.lit("BEGIN:VCALENDAR\r\n"), F.array_join("bs.b", ""), F.lit("END:VCALENDAR")).alias("value"))


def _ics_rows(entries):
    from marquee.operators.recurrence import prop

    p = F.col("props")
    return plain(entries.select(
        "feed", prop(p, "UID").alias("uid"), prop(p, "SUMMARY").alias("summary"), prop(p, "X").alias("x"),
        D.ics_ts(prop(p, "DTSTART")).alias("start")))


@query("s9_ics", f"""
SELECT {PART} AS feed, CAST(id AS VARCHAR) AS uid, 'a long ' || title AS summary, '2' AS x, {TS.format("event_date")} AS start FROM listings
""", "listings")
def _(t):
    return _ics_rows(S.ics_entries(_ics_feeds(t)))


@query("s9_ics_files", f"""
SELECT 'file' AS feed, CAST(id AS VARCHAR) AS uid, 'a long ' || title AS summary, '2' AS x, {TS.format("event_date")} AS start FROM listings
""", "listings")
def _(t):
    folder = job_folder(t.spark, "ics")
    _ics_feeds(t).select("value").write.option("lineSep", "\r\n").text(folder)
    return _ics_rows(S.read_ics(t.spark, folder).withColumn("feed", F.lit("file")))


def _rss(t, published_at="08 Jun 1998 09:30:00"):
    """Articles that name a day with a clock, one of last year first, no day, or are old."""
    k = F.col("id") % 5
    month_day = F.date_format("event_date", "EEEE, MMMM d")
    said = (F.when(k == 0, F.concat(month_day, F.lit(" from 7:30pm"))).when(k == 1, "soon")
            .when(k == 2, F.concat(F.lit("on "), F.date_format("event_date", "MMMM d"), F.lit("th, 1998, not Monday, March 3, 1997")))
            .when(k == 3, F.concat(month_day, F.lit(" 1998"))).otherwise("on Friday, Hall 12"))
    body = F.concat(F.lit("&lt;p&gt;Come "), said, F.lit(", at The Sunset Hall, $"), (F.col("id") % 90).cast("string"), F.lit(".&lt;/p&gt;"))
    published = F.when(k == 3, "Thu, 01 Jan 1998 09:30:00 GMT").otherwise(f"Mon, {published_at} GMT")
    item = F.concat(
        F.lit('<item xmlns:content="c" xmlns:media="m"><title>T '), F.col("id").cast("string"), F.lit("</title><link>https://n.example.com/"), F.col("id").cast("string"),
        F.lit("</link><pubDate>"), published, F.lit("</pubDate><description>About</description><content:encoded>"), body,
        F.lit('</content:encoded><media:content url="/i.jpg"/></item>'))
    return dealt(t.listings).select("id", item.alias("payload"))


_NAMED = "(TIMESTAMP '1998-01-01' + INTERVAL '1' MONTH * (month(event_date) - 1) + INTERVAL '1' DAY * (day(event_date) - 1))"
_REAL = "NOT (month(event_date) = 2 AND day(event_date) = 29)"
_NEAR = "floor(epoch(TIMESTAMP '1998-06-17 10:30:00' - {0}) / 86400) < 60"
RSS_ROWS = f"""
SELECT id, 'T ' || id AS title, 'https://n.example.com/' || id AS url, 'The Sunset Hall' AS venue_name,
  strftime(CASE WHEN id % 5 = 0 AND {_REAL} AND {_NEAR.format("(" + _NAMED + " + INTERVAL '1170' MINUTE)")} THEN {_NAMED} + INTERVAL '1170' MINUTE
    WHEN id % 5 = 2 AND {_REAL} AND {_NEAR.format(_NAMED)} THEN {_NAMED}
    ELSE TIMESTAMP '1998-06-08 09:30:00' END, '%Y-%m-%d %H:%M:%S') AS event_date,
  CAST(id % 90 AS DOUBLE) AS price, '/i.jpg' AS image_url
FROM listings WHERE id % 5 <> 3
"""


@query("s10_rss", RSS_ROWS, "listings")
def _(t):
    rows = S.from_rss(S.rss_items(_rss(t)), AS_OF)
    return plain(rows.select("id", "title", "url", "venue_name", "event_date", "price", "image_url"))


@query("s10_read_rss", RSS_ROWS.replace("SELECT id, 'T '", "SELECT 'T '"), "listings")
def _(t):
    """The same items written as feed files, one of bounded size per range of a source, and read by the file reader."""
    folder = job_folder(t.spark, "rss")
    items = _rss(t).join(t.listings.select("id", "source"), "id")
    file = F.xxhash64("source", F.floor(F.col("id") / PER_FILE)).alias("file")
    lines = items.groupBy("source", part().alias("part"), file).agg(F.array_join(F.collect_list("payload"), "").alias("line"))
    # a file is one channel, so that its first line opens it and its last one closes it; a line is a part
    order = Window.partitionBy("file").orderBy("part", "source")
    opened = F.when(F.lag("file").over(order).isNull(), "<channel>").otherwise("")
    closed = F.when(F.lead("file").over(order).isNull(), "</channel>").otherwise("")
    files = lines.select("file", F.row_number().over(order).alias("place"), F.concat(opened, "line", closed).alias("value"))
    files.sortWithinPartitions("file", "place").drop("place").write.partitionBy("file").option("maxRecordsPerFile", 0).text(folder)
    rows = S.from_rss(S.read_rss(t.spark, folder), AS_OF)
    return plain(rows.select("title", "url", "venue_name", "event_date", "price", "image_url"))


@query("s11_html_cards", f"""
SELECT id AS page_id, CAST(p AS BIGINT) AS pos, title || ' &' AS title, 'https://s.example.com/e/' || id || '/' || p AS link, {TS.format("event_date")} AS starts
FROM listings, (SELECT unnest([0, 1]) AS p)
""", "listings")
def _(t):
    def card(n):
        return F.concat(
            F.lit('<div class="card"><h3><a href="/e/'), F.col("id").cast("string"), F.lit(f'/{n}">'), F.col("title"),
            F.lit(' <b>&amp;</b></a></h3><time datetime="'), iso("event_date"), F.lit('">soon</time></div>\n'))
    pages = t.listings.select(F.col("id").alias("page_id"), F.lit("https://s.example.com/list").alias("url"),
                              F.concat(F.lit("<main>"), card(0), card(1), F.lit("</main>")).alias("html"))
    rules = S.CardRules(card=r'(?s)<div class="card">(.*?)</div>', text={"title": r"(?s)<h3>(.*?)</h3>"},
                        raw={"at": r'<time datetime="([^"]+)"'}, links={"link": r'href="([^"]+)"'})
    rows = S.from_html_cards(pages, rules)
    return plain(rows.select("page_id", "pos", "title", "link", D.to_local("at").alias("starts")))


@query("s11_page_paragraphs", """
SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, h AS href FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS c, generate_subscripts(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), 1) AS i FROM pages) x,
  LATERAL (SELECT regexp_extract(c, 'href="([^"]*)"', 1) AS h)
""")
def _(t):
    rules = S.CardRules(card=r"(?s)<li>(.*?)</li>", raw={"href": r'href="([^"]*)"'})
    return plain(S.from_html_cards(t.raw("pages"), rules).select("page_id", "pos", "href"))


@query("s12_page_links", """
SELECT DISTINCT page_id, CASE WHEN h = '' OR h LIKE 'http://%' OR h LIKE 'https://%' THEN h
  WHEN h LIKE '/%' THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || h
  ELSE rtrim(url, '/') || '/' || h END AS link
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]+)"', 1)) AS h FROM pages)
""")
def _(t):
    return S.page_links(t.raw("pages"))


@query("s13_series_tables", """
SELECT o_orderkey AS id, c_name AS title, CASE WHEN c_custkey % 4 = 0 THEN 'free' ELSE 'paid' END AS kind,
  strftime(timezone('America/Los_Angeles', timezone('UTC', o_orderdate)), '%Y-%m-%d %H:%M:%S') AS event_date,
  CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey AS DOUBLE) + 0.5 END AS price
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_custkey % 5 <> 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderstatus <> 'P'
  AND timezone('America/Los_Angeles', timezone('UTC', o_orderdate)) >= TIMESTAMP '1998-06-17 10:30:00'
""")
def _(t):
    key = F.col("c_custkey")
    none = F.lit(None)
    series = t.raw("customer").select(
        F.concat(F.lit("{A-"), key.cast("string"), F.lit("}")).alias("globalid"), F.col("c_name").alias("event_title"),
        F.lit("d").alias("event_description"), F.concat("c_mktsegment", F.lit(" Park")).alias("park_unit"),
        F.lit("1 A St").alias("park_address"), F.when(key % 5 == 0, "Cancelled").otherwise("Open").alias("status"),
        F.lit("https://x.example.com/#top").alias("event_signup_link"),
        F.when(key % 4 == 0, "Free").otherwise("Paid").alias("event_costType"),
        F.concat(F.lit("$ "), key.cast("string"), F.lit(".5 each")).alias("event_cost"),
        F.lit("No").alias("parking_yes_no"), none.cast("string").alias("parking_cost"),
        F.lit(-118.4).alias("x"), F.lit(34.0).alias("y"))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    occ = t.raw("orders").select(
        F.concat(F.lit("a-"), F.col("o_custkey").cast("string")).alias("parentglobalid"),
        (D.seconds_between("o_orderdate", epoch) * 1000).alias("event_date_start"),
        F.lit(None).cast("bigint").alias("event_date_end"),
        F.when(F.col("o_orderstatus") == "P", "Cancelled by ranger").alias("status"),
        none.cast("string").alias("cancelled_text"), "o_orderkey")
    rows = S.from_series_tables(series, occ, AS_OF, ["Building", "machinery park"])
    keyed = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("c_name").alias("title"), D.utc_to_local("o_orderdate").alias("event_date"),
        F.col("o_orderstatus"))
    found = rows.select("title", "event_date", "price", F.when(F.col("is_free"), "free").otherwise("paid").alias("kind")).distinct()
    return plain(keyed.where("o_orderstatus <> 'P'").drop("o_orderstatus").join(found, ["title", "event_date"]).select(
        "id", "title", "kind", "event_date", "price"))


SHOWS = """
SELECT p_partkey AS film, strftime(o_orderdate, '%Y-%m-%d') AS day, p_name AS title,
  strftime(min(seen_at), '%Y-%m-%d %H:%M:%S') AS event_date,
  array_to_string(list_transform(list_sort(list_distinct(list(seen_at))), lambda x: lower(strftime(x, '%-I:%M%p'))), ', ') AS clocks
FROM (SELECT p_partkey, p_name, o_orderdate, o_orderdate + INTERVAL '1' HOUR * CAST(h AS INT) AS seen_at
      FROM orders JOIN part ON p_partkey = o_orderkey % 50, (SELECT unnest([11, 19, 19]) AS h))
WHERE seen_at >= TIMESTAMP '1998-06-17 10:30:00' GROUP BY 1, 2, 3
"""


@query("s14_showtimes", SHOWS)
def _(t):
    days = t.raw("orders").groupBy((F.col("o_orderkey") % 50).alias("film"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.lit(1))
    shows = F.transform(F.array(F.lit("T19:00:00-07:00"), F.lit("T11:00:00"), F.lit("T19:00:00")),
                        lambda h: F.struct(F.concat(F.col("day"), h).alias("startsAt")))
    films = days.groupBy(F.col("film").cast("string").alias("film")).agg(
        F.map_from_entries(F.collect_list(F.struct("day", shows.alias("s")))).alias("days"))
    payloads = films.select(F.to_json(F.create_map("film", "days")).alias("payload"))
    movies = t.raw("part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit(5400).alias("runtime"),
        F.lit("PG").alias("certificate"), F.col("p_type").alias("synopsis"))
    rows = S.from_showtimes(payloads, movies, AS_OF)
    return plain(rows.select(F.col("film").cast("bigint").alias("film"), "day", "title", "event_date", F.col("clock").alias("clocks")))


@query("a23_showtime_text", """
SELECT o_custkey AS k, array_to_string(list_transform(list_sort(list_distinct(list(o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 AS INT)))),
  lambda x: lower(strftime(x, '%-I:%M%p'))), ', ') AS clocks
FROM orders GROUP BY 1
""")
def _(t):
    at = D.plus("o_orderdate", F.col("o_orderkey") % 24, "HOUR")
    per = t.raw("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_set(at)).alias("ts"))
    return plain(per.select("k", S.clock_text(F.col("ts")).alias("clocks")))


@query("s17_page_meta", """
SELECT page_id, replace(replace(replace(replace(replace(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS title,
  nullif(regexp_extract(html, '(?i)<meta name="description" content="([^"]*)"', 1), '') AS description
FROM pages
""")
def _(t):
    return S.page_meta(t.raw("pages")).select("page_id", "title", "description")


@query("j13_resolve_refs", """
SELECT l.source || '-' || (l.id // 200) AS doc, CAST(l.id AS VARCHAR) AS key, CASE WHEN l.id % 4 = 3 THEN NULL WHEN l.id % 4 = 2 THEN 'own ' || l.id ELSE coalesce(v.title, NULL) END AS name
FROM listings l LEFT JOIN listings v ON v.source = l.source AND v.id = l.id + 25 AND v.id // 200 = l.id // 200
""", "listings")
def _(t):
    k = F.col("id") % 4
    pointer = F.when(k < 2, F.concat(F.lit('{"__ref": "'), (F.col("id") + 25).cast("string"), F.lit('"}'))).when(
        k == 2, F.concat(F.lit('{"name": "own '), F.col("id").cast("string"), F.lit('"}')))
    body = F.concat(F.lit('{"name": '), F.regexp_replace(F.to_json(F.array("title")), r"^\[|\]$", ""),
                    F.coalesce(F.concat(F.lit(', "venue": '), pointer), F.lit("")), F.lit("}"))
    entry = F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('": '), body)
    docs = t.listings.groupBy(part().alias("part")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ", "), F.lit("}")).alias("payload"))
    rows = S.resolve_refs(S.entities(docs, "part", "payload"), "$.venue")
    return rows.select("doc", "key", J.text_at("resolved", "$.name").alias("name"))


@query("j17_listed_products", """
SELECT o_orderkey AS page_id, CAST(s AS BIGINT) AS seen, p AS product_id, p_name AS name FROM (
  SELECT o_orderkey, 0 AS s, o_orderkey % 70 AS p FROM orders UNION ALL
  SELECT o_orderkey, 1, o_custkey % 70 FROM orders WHERE o_custkey % 70 <> o_orderkey % 70)
JOIN (SELECT p_partkey % 100 AS product, arg_max(p_name, p_partkey) AS p_name FROM part GROUP BY 1) ON product = p
""")
def _(t):
    a, b = (F.col(c) % 70 for c in ("o_orderkey", "o_custkey"))
    tag = lambda c: F.concat(F.lit('<option data-product-id = "'), c.cast("string"), F.lit('">'))
    pages = t.raw("orders").select(F.col("o_orderkey").alias("page_id"), F.concat(tag(a), tag(b), tag(a)).alias("html"))
    catalogue = t.raw("part").select((F.col("p_partkey") % 100).alias("product_id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"))
    # Ids come up again and again; the latest row must win.
    rows = S.listed_products(pages, catalogue)
    return plain(rows.select("page_id", "seen", "product_id", "name"))


@query("j18_occurrences_with_detail", f"""
SELECT url, {TS.format("CASE WHEN id % 2 = 0 THEN CAST(d AS TIMESTAMP) + INTERVAL '19' HOUR + INTERVAL '30' MINUTE ELSE first END")} AS event_date,
  CASE WHEN id % 2 = 0 THEN strftime(d, '%Y-%m-%d 21:00:00') END AS end_date
FROM (SELECT '/e/' || (id % 97) AS url, CAST(event_date AS DATE) AS d, min(event_date) AS first, id % 97 AS id FROM listings WHERE id % 97 <> 5 GROUP BY 1, 2, 4)
""", "listings")
def _(t):
    k = F.col("id") % 97
    pairs = t.listings.select(F.concat(F.lit("/e/"), k.cast("string")).alias("url"), "event_date")
    half = F.col("k") % 2 == 0
    details = t.listings.select(k.alias("k")).distinct().where("k <> 5").select(
        F.concat(F.lit("/e/"), F.col("k").cast("string")).alias("url"),
        F.when(half, "7:30 pm").alias("start_text"), F.when(half, "9pm").alias("end_text"))
    return plain(S.occurrences_with_detail(pairs, details).select("url", "event_date", "end_date"))


@query("a24_min_price", """
SELECT l_orderkey AS k, CASE WHEN min(l_linenumber) > 1 OR min(l_quantity) > 0 THEN min(CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END) END AS price
FROM lineitem GROUP BY 1
""")
def _(t):
    text = F.when(F.col("l_linenumber") == 7, "call us").otherwise(F.col("l_quantity").cast("string"))
    items = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.collect_list(F.struct(text.alias("price"))).alias("variants"))
    return items.select("k", S.min_price(F.col("variants"))["price"].alias("price"))


@query("a25_map_extent", """
SELECT round(min(latitude), 6) AS south, round(max(latitude), 6) AS north, round(min(longitude), 6) AS west, round(max(longitude), 6) AS east FROM listings
""", "listings")
def _(t):
    return plain(S.map_extent(t.listings))


@query("a25_grid_clusters", """
SELECT CAST(floor(latitude / 0.05) AS BIGINT) AS row, CAST(floor(longitude / 0.05) AS BIGINT) AS col, CAST(count(*) AS BIGINT) AS n,
  round(avg(latitude) + 0.0000001, 5) AS latitude, round(avg(longitude) + 0.0000001, 5) AS longitude FROM listings WHERE latitude IS NOT NULL GROUP BY 1, 2
""", "listings")
def _(t):
    g = S.grid_clusters(t.listings, 0.05)
    return plain(g.select("row", "col", "n", F.round(F.col("latitude") + 1e-7, 5).alias("latitude"),
                          F.round(F.col("longitude") + 1e-7, 5).alias("longitude")))


@query("k5_export_json", """
SELECT id, title, strftime(event_date, '%Y-%m-%dT%H:%M:%S') AS event_date, coalesce(category, 'none') AS category FROM listings
""", "listings")
def _(t):
    folder = job_folder(t.spark, "json")
    K.export_json(t.listings, folder)
    back = t.spark.read.schema("id bigint, title string, event_date string, category string").json(folder)
    return back.select("id", "title", "event_date", F.coalesce("category", F.lit("none")).alias("category"))


ESC = r"replace(replace({0}, ',', '\,'), ';', '\;')"


@query("k6_export_ics", f"""
SELECT id, array_to_string(list_filter(['BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//Listings//Export//EN', 'CALSCALE:GREGORIAN', 'METHOD:PUBLISH', 'BEGIN:VEVENT',
  'UID:' || id || '@listings.example.com', 'DTSTAMP:19980617T103000', 'DTSTART:' || strftime(event_date, '%Y%m%dT%H%M%S'),
  'DTEND:' || strftime(coalesce(end_date, event_date + INTERVAL 2 HOUR), '%Y%m%dT%H%M%S'), 'SUMMARY:' || {ESC.format('title')},
  'DESCRIPTION:' || {ESC.format("coalesce(description, 'No description available')")},
  'LOCATION:' || {ESC.format("concat_ws(', ', nullif(venue_name, ''), address)")}, CASE WHEN url <> '' THEN 'URL:' || url END, 'CATEGORIES:' || category,
  CASE WHEN latitude <> 0 AND longitude <> 0 THEN 'GEO:' || latitude || ';' || longitude END, 'STATUS:CONFIRMED', 'SEQUENCE:0', 'END:VEVENT', 'END:VCALENDAR'], lambda x: x IS NOT NULL), chr(13) || chr(10)) AS ics
FROM listings
""", "listings")
def _(t):
    return K.listing_ics(t.listings, AS_OF).select("id", "ics")


@query("k7_json_ld", """
SELECT id, CASE WHEN coalesce(nullif(venue_name, ''), address) IS NOT NULL THEN title END AS name,
  strftime(event_date, '%Y-%m-%dT%H:%M:%S') || '-0' || CAST(epoch(timezone('UTC', timezone('America/Los_Angeles', event_date)) - event_date) // 3600 AS INT) || ':00' AS starts,
  coalesce(nullif(venue_name, ''), address) AS place, CASE WHEN is_free THEN '0' WHEN price IS NOT NULL THEN format('{:.2f}', price) END AS price,
  nullif(image_url, '') AS image, nullif(url, '') AS url, address, round(CASE WHEN longitude IS NOT NULL THEN latitude END, 6) AS latitude,
  CASE WHEN latitude IS NOT NULL THEN round(longitude, 6) END AS longitude, description,
  CASE WHEN is_free OR price IS NOT NULL THEN nullif(url, '') END AS offer_url, 'Event' AS kind
FROM listings
""", "listings")
def _(t):
    ld = K.listing_json_ld(t.listings)

    def at(path):
        return F.get_json_object("json_ld", path)

    return ld.select("id", at("$.name").alias("name"), at("$.startDate").alias("starts"),
                     at("$.location.name").alias("place"), at("$.offers.price").alias("price"),
                     at("$.image").alias("image"), at("$.url").alias("url"), at("$.location.address").alias("address"),
                     F.round(at("$.location.geo.latitude").cast("double"), 6).alias("latitude"),
                     F.round(at("$.location.geo.longitude").cast("double"), 6).alias("longitude"),
                     at("$.description").alias("description"), at("$.offers.url").alias("offer_url"), at("$['@type']").alias("kind"))
