"""Checked queries: text, geography and price expressions."""

from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.functions import geo as G
from marquee.functions import price as P
from marquee.functions import text as X
from marquee.functions import variants as J
from marquee.plans.catalog import plain, query

NORM_TITLE = (
    "trim(regexp_replace(regexp_replace(replace(replace(lower({0}), '\"', ''), '''', ''),"
    " '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
)


def norm_venue_sql(c):
    s = f"lower({c})"
    for suffix in V.VENUE_SUFFIXES:
        s = f"regexp_replace({s}, '{suffix}$', '')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def quoted(items):
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


@query("x1_norm_title", f"""
SELECT id, {NORM_TITLE.format("'  The \"Big\" ' || title || ' - it''s ON!'")} AS t FROM listings
""", "listings")
def _(t):
    s = F.concat(F.lit("  The \"Big\" "), "title", F.lit(" - it's ON!"))
    return t.listings.select("id", X.norm_title(s).alias("t"))


VENUE_IN = """venue_name || CASE id % 5 WHEN 0 THEN ' Los Angeles' WHEN 1 THEN ' - Los Angeles'
  WHEN 2 THEN ' Theatre LA' WHEN 3 THEN ' center  ' ELSE '' END"""


@query("x2_norm_venue", f"SELECT id, {norm_venue_sql(VENUE_IN)} AS v FROM listings", "listings")
def _(t):
    return t.listings.select("id", X.norm_venue(F.expr(VENUE_IN)).alias("v"))


ADDRESS_IN = """CASE id % 5 WHEN 0 THEN '155-199 Third Street, Unit 4b, Venice' WHEN 1 THEN address || ' (rear) call us'
  WHEN 2 THEN CAST(id AS VARCHAR(20)) || ' second ave # 12 (x), Suite. 9, Malibu ,' WHEN 3 THEN '  fifth element way,  Venice' ELSE address END"""


def _norm_address_sql(c):
    s = f"trim({c})"
    steps = [
        (r"\s*\([^)]*\)", "", "g"), (r"(\b\d{5}\b).*$", r"\1", "g"),
        (r"^(\s*\d+)\s*[-–]\s*\d+", r"\1", ""), (r"\s*#\s*\w+", "", "g"),
        (r"\s*\b(?:suite|ste|unit|apt|apartment|fl|floor)\b\.?\s*#?\s*\w+", "", "gi"),
    ]
    steps += [(rf"\b{w}\b(\s+(?:{V.STREET_TYPES})\b)", rf"{d}\1", "gi")
              for w, d in V.ORDINAL_WORDS.items()]
    steps += [(r"\s{2,}", " ", "g")]
    for pattern, replacement, flags in steps:
        s = f"regexp_replace({s}, '{pattern}', '{replacement}', '{flags}')"
    return f"trim(trim(trim({s}), ','))"


@query("x3_norm_address", f"SELECT id, {_norm_address_sql(ADDRESS_IN)} AS a FROM listings", "listings")
def _(t):
    return t.listings.select("id", X.norm_address(F.expr(ADDRESS_IN)).alias("a"))


def city_hint_sql(c):
    whens = " ".join(f"WHEN contains(lower({c}), '{x.lower()}') THEN '{x}, CA'" for x in V.CITY_HINTS)
    return f"CASE {whens} ELSE 'Los Angeles, CA' END"


@query("x4_city_hint", f"SELECT id, {city_hint_sql('address')} AS hint FROM listings", "listings")
def _(t):
    return t.listings.select("id", X.city_hint("address").alias("hint"))


def in_area_sql(address, venue):
    text = f"lower(concat_ws(' ', nullif({address}, ''), nullif({venue}, '')))"
    places = " OR ".join(f"contains({text}, '{n}')" for n in V.AREA_NEIGHBORHOODS)
    return (f"({places} OR list_has_any(regexp_extract_all({text}, '\\b\\d{{5}}\\b'),"
            f" [{quoted(V.AREA_ZIPS)}]))")


@query("x5_zips_and_area", f"""
SELECT id, array_to_string(regexp_extract_all(address, '\\b\\d{{5}}\\b'), '|') AS zips,
  {in_area_sql('address', 'venue_name')} AS in_area,
  CASE WHEN id % 3 = 0 THEN TRUE ELSE {in_area_sql("'nowhere'", 'venue_name')} END AS by_city
FROM listings
""", "listings")
def _(t):
    none = F.lit(None).cast("string")
    city = F.when(F.col("id") % 3 == 0, F.lit("West Hollywood"))
    return plain(t.listings.select(
        "id", X.zips("address").alias("zips"),
        X.address_in_area("address", none, "venue_name").alias("in_area"),
        X.address_in_area(F.lit("nowhere"), city, "venue_name").alias("by_city")))


COMPACT_IN = """CASE id % 4 WHEN 0 THEN address WHEN 1 THEN address || '-1234' WHEN 2 THEN replace(address, 'CA', 'California,')
  ELSE regexp_replace(address, ' [0-9]+$', '') END"""


@query("x6_compact_address", f"""
SELECT id, trim(rtrim(trim(regexp_replace(trim({COMPACT_IN}), ',\\s*(California|CA)\\s*,?\\s*\\d{{5}}(-\\d{{4}})?\\s*$|,\\s*(California|CA)\\s*$|,\\s*\\d{{5}}(-\\d{{4}})?\\s*$', '', 'i')), ',')) AS a
FROM listings
""", "listings")
def _(t):
    return t.listings.select("id", X.compact_address(F.expr(COMPACT_IN)).alias("a"))


@query("x7_clean_text", """
SELECT id, trim(replace(replace('  Farmers\\'' ' || title || ' \\"x\\" ', '\\''', ''''), '\\"', '"')) AS t FROM listings
""", "listings")
def _(t):
    s = F.concat(F.lit("  Farmers\\' "), "title", F.lit(' \\"x\\" '))
    return t.listings.select("id", X.clean_text(s).alias("t"))


@query("x8_strip_html", """
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}\\x{85}\\x{2028}\\x{2029}]+', ' ', 'g')) AS body
FROM pages
""")
def _(t):
    return t.raw("pages").select("page_id", X.strip_html("html").alias("body"))


@query("x9_strip_markdown", r"""
SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  '[' || title || '](https://x.example.com) and **' || coalesce(nullif(venue_name, ''), 'Hall') || ' room**' || chr(10) || ' ## ' || chr(10) || 'Sh\*t \[x\]',
  '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '\*\*(\S(?:.*?\S)?)\*\*', '\1', 'g'),
  '(?m)^\s*[~#]+\s*$', '', 'g'), '\\([*_\[\]()~#])', '\1', 'g'), '\s+', ' ', 'g')) AS t FROM listings
""", "listings")
def _(t):
    room = F.coalesce(X.blank_to_null("venue_name"), F.lit("Hall"))
    s = F.concat(F.lit("["), "title", F.lit("](https://x.example.com) and **"), room,
                 F.lit(" room**\n ## \nSh\\*t \\[x\\]"))
    return t.listings.select("id", X.strip_markdown(s).alias("t"))


URL_IN = """CASE id % 4 WHEN 0 THEN url WHEN 1 THEN '/e/' || CAST(id AS VARCHAR(20)) WHEN 2 THEN 'e/' || CAST(id AS VARCHAR(20)) ELSE '' END"""


@query("x10_absolute_url", f"""
SELECT id, CASE WHEN u = '' OR u LIKE 'http%' THEN u
  WHEN u LIKE '/%' THEN 'https://site.example.com' || u ELSE 'https://site.example.com/list/' || u END AS u
FROM (SELECT id, {URL_IN} AS u FROM listings)
""", "listings")
def _(t):
    return t.listings.select(
        "id", X.absolute_url(F.expr(URL_IN), F.lit("https://site.example.com/list/")).alias("u"))


@query("x11_ics_escape", r"""
SELECT id, replace(replace(replace(d, chr(10), '\n'), ',', '\,'), ';', '\;') AS escaped,
  trim(regexp_replace(replace(d, chr(10), ' '), '\s+', ' ', 'g')) AS back
FROM (SELECT id, coalesce(description, '') || '; a, b' || chr(10) || title AS d FROM listings)
""", "listings")
def _(t):
    d = F.concat(X.text_or_empty("description"), F.lit("; a, b\n"), "title")
    e = X.ics_escape(d)
    return t.listings.select("id", e.alias("escaped"), X.ics_unescape(e).alias("back"))


@query("x12_slug_and_filename", """
SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  substr(lower(trim(regexp_replace(regexp_replace(title || ' - ' || title, '[^\\w\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '-')), 1, 50)
    || '-' || strftime(event_date, '%Y-%m-%d') || '.ics' AS file
FROM listings
""", "listings")
def _(t):
    twice = F.concat("title", F.lit(" - "), "title")
    return t.listings.select("id", X.slug("title").alias("slug"),
                             X.ics_filename(twice, "event_date").alias("file"))


@query("x13_truncate", """
SELECT id, CASE WHEN length(d) > 40 THEN regexp_replace(substr(d, 1, 39), ' [^ ]*$', '') || '…' ELSE d END AS soft,
  CASE WHEN length(d) > 50 THEN substr(d, 1, 50) || '...' ELSE d END AS hard
FROM (SELECT id, coalesce(description, title) AS d FROM listings)
""", "listings")
def _(t):
    d = F.coalesce("description", "title")
    return t.listings.select("id", X.truncate_words(d, 40).alias("soft"),
                             X.truncate_hard(d, 50).alias("hard"))


@query("x14_occurrence_url", """
SELECT id, url || '#' || CASE WHEN id % 3 = 0 THEN '' ELSE 'u' || id || '-' END || strftime(event_date, '%Y%m%dT%H%M') AS by_uid,
  CASE WHEN url = '' THEN '' ELSE url || '#' || strftime(event_date, '%Y-%m-%d') END AS by_day
FROM listings
""", "listings")
def _(t):
    uid = F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("u"), F.col("id").cast("string")))
    return t.listings.select("id", X.occurrence_url("url", uid, "event_date").alias("by_uid"),
                             X.dated_url("url", "event_date").alias("by_day"))


@query("x15_split_title", """
SELECT id, CASE WHEN id % 3 = 0 THEN title WHEN id % 3 = 1 THEN title || ' | Nowhere' ELSE title || ' | x' END AS title,
  CASE WHEN id % 3 = 0 THEN 'malibu' WHEN id % 3 = 2 THEN 'all locations' END AS location,
  CASE WHEN id % 2 = 0 THEN venue_name END AS venue
FROM listings
""", "listings")
def _(t):
    k = F.col("id") % 3
    raw = F.concat("title", F.when(k == 0, " | Malibu").when(k == 1, " | Nowhere")
                   .otherwise(" | x | all locations"))
    s = X.split_title(raw, ["venice", "malibu", "all locations"])
    tagged = F.when(F.col("id") % 2 == 0, F.concat("title", F.lit(" @ "), "venue_name")).otherwise(
        F.col("title"))
    return t.listings.select("id", s["title"].alias("title"), s["location"].alias("location"),
                             X.at_venue(tagged).alias("venue"))


@query("x16_mine_place", """
SELECT id, CASE WHEN id % 2 = 0 THEN 'The Sunset Hall' ELSE '' END AS venue,
  CASE WHEN id % 3 = 0 THEN CAST(100 + id % 900 AS VARCHAR) || ' Main Street Blvd, Santa Monica, CA 90401'
       WHEN id % 3 = 1 THEN CAST(100 + id % 900 AS VARCHAR) || ' Pico Ave, Santa Monica, CA' ELSE '' END AS address
FROM listings
""", "listings")
def _(t):
    number = (100 + F.col("id") % 900).cast("string")
    k = F.col("id") % 3
    prose = F.concat(
        F.lit("Join us at Least once, at The event was held, "),
        F.when(F.col("id") % 2 == 0, "and at The Sunset Hall, tonight. ").otherwise("soon. "),
        F.when(k == 0, F.concat(F.lit("Find it: "), number, F.lit(" Main Street Blvd, Santa Monica, CA 90401")))
        .when(k == 1, F.concat(F.lit("Find it: "), number, F.lit(" Pico Ave")))
        .otherwise("No place given"))
    p = X.mine_place(prose)
    return t.listings.select("id", p["venue"].alias("venue"), p["address"].alias("address"))


@query("x17_sanitize_query", """
SELECT id, '"' || replace(trim(regexp_replace(' ' || title || chr(9) || ' x ', '[\\x00-\\x1f]', ' ', 'g')), '"', '""') || '"' AS q
FROM listings
""", "listings")
def _(t):
    return t.listings.select(
        "id", X.sanitize_query(F.concat(F.lit(" "), "title", F.lit("\t x "))).alias("q"))


DATE_LABEL = """CASE WHEN CAST(end_date AS DATE) > CAST(event_date AS DATE) AND year(end_date) <> year(event_date)
    THEN strftime(event_date, '%b %d, %Y') || ' – ' || strftime(end_date, '%b %d, %Y')
  WHEN CAST(end_date AS DATE) > CAST(event_date AS DATE) THEN strftime(event_date, '%b %d') || ' – ' || strftime(end_date, '%b %d, %Y')
  ELSE strftime(event_date, '%a, %b %d, %Y at %I:%M %p') END"""
TIME_LABEL = """CASE WHEN hour(event_date) = 0 AND minute(event_date) = 0 THEN '' ELSE strftime(event_date, '%-I:%M %p') END"""


@query("x18_labels", f"SELECT id, {DATE_LABEL} AS date_label, {TIME_LABEL} AS time_label FROM listings",
       "listings")
def _(t):
    return t.listings.select("id", X.date_label("event_date", "end_date").alias("date_label"),
                             X.time_label("event_date").alias("time_label"))


@query("x19_join_address", """
SELECT id, concat_ws(', ', nullif(venue_name, ''), nullif(address, ''), category, 'CA') AS a FROM listings
""", "listings")
def _(t):
    return t.listings.select(
        "id", X.join_address("venue_name", "address", "category", F.lit("CA")).alias("a"))


def haversine_sql(a, b, c, d, radius):
    return (f"{radius} * 2 * atan2(sqrt(h), sqrt(1 - h))".replace(
        "h)", f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c}))"
              f" * pow(sin(radians({d} - {b}) / 2), 2)))", 1).replace(
        "1 - h", f"1 - (pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c}))"
                 f" * pow(sin(radians({d} - {b}) / 2), 2))"))


KM = haversine_sql("latitude", "longitude", "34.05", "(-118.25)", "6371.0")
MILES = haversine_sql("latitude", "longitude", "34.0095", "(-118.4977)", "3959")
IN_CORE = "(latitude BETWEEN 33.94 AND 34.09 AND longitude BETWEEN -118.55 AND -118.33)"
IN_COAST = "(latitude BETWEEN 34.0 AND 34.11 AND longitude BETWEEN -118.95 AND -118.55)"
IN_COUNTY = "(latitude BETWEEN 33.69 AND 34.8233 AND longitude BETWEEN -118.952 AND -117.646)"


@query("x34_haversine", f"""
SELECT id, round({KM}, 4) AS km, round({MILES}, 4) AS miles FROM listings
""", "listings")
def _(t):
    p = V.REFERENCE_POINT
    return t.listings.select(
        "id",
        F.round(G.haversine("latitude", "longitude", F.lit(34.05), F.lit(-118.25)), 4).alias("km"),
        F.round(G.haversine("latitude", "longitude", F.lit(p[0]), F.lit(p[1]), "mi"), 4)
        .alias("miles"))


@query("x35_boxes", f"""
SELECT id, CASE WHEN {IN_CORE} THEN 'westside' WHEN {IN_COAST} THEN 'malibu' ELSE 'outside' END AS area,
  {IN_CORE} OR {IN_COAST} AS covered, {IN_COUNTY} AS county FROM listings
""", "listings")
def _(t):
    return t.listings.select(
        "id", G.area("latitude", "longitude").alias("area"),
        G.in_coverage("latitude", "longitude").alias("covered"),
        G.in_box("latitude", "longitude", V.COUNTY_BOX).alias("county"))


@query("x36_within_radius", f"""
SELECT id, {MILES} <= 12 AS near FROM listings
""", "listings")
def _(t):
    return t.listings.select(
        "id", G.within_radius("latitude", "longitude").alias("near"))


THEMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.CATEGORY_THEME.items())


@query("x39_theme", f"""
SELECT id, CASE lower(coalesce(category, '')) {THEMES} ELSE 'other' END AS theme FROM listings
""", "listings")
def _(t):
    return t.listings.select("id", P.theme("category").alias("theme"))


@query("x39_theme_image")
def _(t):
    return t.listings.select("id", P.theme_image("id", "title", "category").alias("image"))


PROSE = """CASE id % 4 WHEN 0 THEN title || ' Free Admission, was $9' WHEN 1 THEN 'Tickets $' || CAST(id AS VARCHAR(20)) || '.50 at the door'
  WHEN 2 THEN title ELSE 'from $12 to $20' END"""
COST = """CASE id % 3 WHEN 0 THEN 'Free' WHEN 1 THEN '$ 15.25 pp' ELSE '1,2' || CAST(id AS VARCHAR(20)) || ' dollars' END"""


@query("x41_price_from_text", f"""
SELECT id, free AS is_free, CASE WHEN NOT free THEN TRY_CAST(nullif(regexp_extract(p, '\\$(\\d+(?:\\.\\d{{2}})?)', 1), '') AS DOUBLE) END AS price,
  CASE WHEN free THEN 'Free' WHEN regexp_matches(p, '\\$\\d') THEN '$' || regexp_extract(p, '\\$(\\d+(?:\\.\\d{{2}})?)', 1) ELSE 'TBD' END AS price_note,
  CAST(CASE id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 15.25 ELSE 1 END AS DOUBLE) AS labelled,
  TRY_CAST(nullif(regexp_extract(replace(c, ',', ''), '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS first_number
FROM (SELECT id, {PROSE} AS p, {COST} AS c, regexp_matches(lower({PROSE}), 'free admission') AS free FROM listings)
""", "listings")
def _(t):
    p = P.price_from_text(F.expr(PROSE))
    return t.listings.select(
        "id", p["is_free"].alias("is_free"), p["price"].alias("price"),
        p["price_note"].alias("price_note"), P.labelled_price(F.expr(COST))["price"].alias("labelled"),
        P.first_number(F.expr(COST)).alias("first_number"))


@query("x42_price_from_offer", """
SELECT id, CASE WHEN id % 4 = 3 OR is_free THEN NULL ELSE round(coalesce(price, 7.5), 2) END AS price,
  CASE WHEN id % 4 = 3 THEN FALSE ELSE is_free END AS is_free
FROM listings
""", "listings")
def _(t):
    amount = F.when(F.col("is_free"), F.lit("0")).otherwise(
        F.round(F.coalesce("price", F.lit(7.5)), 2).cast("string"))
    k = F.col("id") % 4
    offer = (
        F.when(k == 0, F.format_string('{"offers": {"price": "%s"}}', amount))
        .when(k == 1, F.format_string('{"offers": [{"lowPrice": %s, "price": 99}]}', amount))
        .when(k == 2, F.format_string('{"offers": {"lowPrice": "%s", "price": "1"}}', amount))
        .otherwise('{"offers": "ask"}'))
    v = t.listings.withColumn("v", J.parsed(offer)).withColumn("o", J.price_from_offer("v"))
    return v.select("id", F.round("o.price", 2).alias("price"), F.col("o.is_free").alias("is_free"))


@query("x43_minor_units", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey / 100.0 END AS amount FROM orders
""")
def _(t):
    raw = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.col("o_custkey").cast("string"))
    return t.raw("orders").select(F.col("o_orderkey").alias("id"),
                                  P.minor_units(raw, 2).alias("amount"))


PRICE_LABEL = """CASE WHEN is_free THEN 'FREE' WHEN coalesce(price, 0) <> 0 THEN '$' || format('{:.2f}', price)
  WHEN price_note = '' OR upper(price_note) = 'TBD' THEN NULL
  WHEN NOT regexp_matches(lower(price_note), '\\$|otherwise|after|except|member') AND regexp_matches(lower(price_note), 'free|no charge|no cost|gratis|complimentary') THEN 'FREE'
  ELSE price_note END"""


@query("x44_price_label", f"SELECT id, {PRICE_LABEL} AS label FROM listings", "listings")
def _(t):
    return t.listings.select("id", P.price_label("price", "is_free", "price_note").alias("label"))


@query("x45_scalar_or_first", """
SELECT id, CASE WHEN image_url <> '' THEN image_url END AS image, concat_ws(', ', address, 'CA') AS address,
  CASE WHEN id % 3 <> 1 THEN nullif(venue_name, '') END AS place FROM listings
""", "listings")
def _(t):
    k = F.col("id") % 4
    img = F.col("image_url")
    image = (
        F.when(k == 0, F.to_json(F.struct(img.alias("image"))))
        .when(k == 1, F.to_json(F.struct(F.array(img).alias("image"))))
        .when(k == 2, F.to_json(F.struct(F.struct(img.alias("url")).alias("image"))))
        .otherwise(F.to_json(F.struct(F.array(F.struct(img.alias("url"))).alias("image")))))
    postal = F.struct(F.col("address").alias("streetAddress"), F.lit("CA").alias("addressRegion"))
    flat = F.concat("address", F.lit(", CA"))
    j = F.col("id") % 3
    place = (
        F.when(j == 0, F.to_json(F.struct(F.struct(F.col("venue_name").alias("name"), postal.alias("address")).alias("location"))))
        .when(j == 1, F.to_json(F.struct(F.struct(flat.alias("address")).alias("location"))))
        .otherwise(F.to_json(F.struct(F.array(F.struct(F.col("venue_name").alias("name"), postal.alias("address"))).alias("location")))))
    v = t.listings.select("id", J.parsed(image).alias("i"), J.parsed(place).alias("p"))
    return v.select("id", J.scalar_or_first("i", "$.image", "url").alias("image"),
                    J.postal_address("p").alias("address"),
                    J.scalar_or_first("p", "$.location", "name").alias("place"))


@query("x46_overlay", """
SELECT id, coalesce(nullif(venue_name, ''), address) AS v FROM listings
""", "listings")
def _(t):
    return t.listings.select("id", X.overlay("address", "venue_name").alias("v"))


@query("x50_price_range", """
SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN lo <> hi THEN '$' || lo || ' - $' || hi WHEN lo = '0' THEN 'free' ELSE '$' || lo END AS label
FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_linenumber % 4 AS VARCHAR) AS lo,
        CAST((l_linenumber + l_orderkey % 2) % 4 AS VARCHAR) AS hi FROM lineitem)
""")
def _(t):
    low = F.col("l_linenumber") % 4
    high = (F.col("l_linenumber") + F.col("l_orderkey") % 2) % 4
    return plain(t.raw("lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"),
        P.price_range(low.cast("string"), high.cast("string")).alias("label")))


@query("x51_append_missing", """
SELECT id, CASE WHEN id % 2 = 0 THEN title || ' — ' || source || ', DJ' ELSE title || ' with ' || lower(source) || ', dj' END AS t FROM listings
""", "listings")
def _(t):
    names = F.array("source", F.lit(""), F.lit("DJ"))
    text = F.when(F.col("id") % 2 == 0, F.col("title")).otherwise(
        F.concat("title", F.lit(" with "), F.lower("source"), F.lit(", dj")))
    return t.listings.select("id", X.append_missing(text, names).alias("t"))
