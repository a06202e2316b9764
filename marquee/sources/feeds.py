"""Feed and page tables to rows: JSON, JSON-LD, page state, RSS, HTML cards.

Every job takes a table of payloads or pages and returns one row per entry.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee import fixed_values as V
from marquee.functions import dates as D
from marquee.functions import price as P
from marquee.functions import text as X
from marquee.functions import variants as J
from marquee.operators.staging import staged
from marquee.operators.windows import first_per_key, last_per_key


def _mapped(v: str, mapping: dict[str, str]) -> list[Column]:
    """Columns from paths; a path may end in ::type (string when absent)."""
    out = []
    for name, path in mapping.items():
        path, _, kind = path.partition("::")
        kind = kind or "string"
        if kind == "local":
            value = D.to_local(J.text_at(v, path))
        elif kind == "epoch_ms":
            value = D.epoch_ms_to_local(F.try_variant_get(F.col(v), path, "bigint"))
        elif kind == "string":
            value = J.text_at(v, path)
        else:
            value = F.try_variant_get(F.col(v), path, kind)
        out.append(value.alias(name))
    return out


def from_json_feed(
    df: DataFrame, payload: str, items: str, mapping: dict[str, str], keep: list[str] = ()
) -> DataFrame:
    """Entries of the list at ``items``, fields by path.

    ``mapping`` is column -> path, with ::local for ISO times, ::epoch_ms for
    epoch milliseconds and ::double and the like for other types.
    """
    listed = F.try_variant_get(J.parsed(payload), items, "array<variant>")
    entries = df.select(*keep, F.posexplode(listed).alias("pos", "v"))
    return entries.select(*keep, "pos", *_mapped("v", mapping))


def _as_list(v: Column, path: str) -> Column:
    """The value as an array of variants, a single value as one element."""
    many = F.try_variant_get(v, path, "array<variant>")
    one = F.try_variant_get(v, path, "variant")
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<variant>"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _events_within(scripts: pd.Series) -> pd.Series:
    """Objects of a type that ends in Event, as JSON, wherever they stand in the scripts of a page."""
    def walk(top) -> list[str]:
        found, waiting = [], [top]
        while waiting:
            node = waiting.pop()
            if isinstance(node, dict):
                kinds = node.get("@type")
                kinds = kinds if isinstance(kinds, list) else [kinds]
                if any(isinstance(k, str) and k.endswith("Event") for k in kinds):
                    found.append(json.dumps(node))
                waiting += list(node.values())[::-1]
            elif isinstance(node, list):
                waiting += node[::-1]
        return found

    def page(texts) -> list[str]:
        out: list[str] = []
        for text in texts if texts is not None else ():
            try:
                out += walk(json.loads(text))
            except (ValueError, RecursionError):
                continue
        return out

    return scripts.map(page)


EVENT_SCHEMA = (
    "name string, description string, startDate string, endDate string, url string, eventStatus string, "
    "location string, image string, offers string"
)


def json_ld_nodes(pages: DataFrame, keep: list[str] = ("page_id", "url")) -> DataFrame:
    """Every event of a page's JSON-LD, however deep: pos and the node's members as text."""
    scripts = F.regexp_extract_all(
        X.text_or_empty("html"),
        F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"),
        F.lit(1),
    )
    marked = pages.where(F.contains(F.lower("html"), F.lit("ld+json"))).select(*keep, scripts.alias("scripts"))
    found = marked.select(*keep, F.posexplode(_events_within("scripts")).alias("pos", "node"))
    found = found.withColumnRenamed("url", "__page_url")
    kept = [c if c != "url" else "__page_url" for c in keep]
    return staged(found, {"e": F.from_json("node", EVENT_SCHEMA)}).select(*kept, "pos", "node", "e.*")


def _read_events(nodes: DataFrame) -> DataFrame:
    """Adds the dates and the first place, image and offer of each event."""
    def first(member: str) -> Column:
        """The object of a member, or of the first of its list; text that is neither gives NULL."""
        v = J.parsed(F.when(F.rlike(F.col(member), F.lit(r"^\s*[\[{]")), F.col(member)))
        return F.coalesce(F.try_variant_get(v, "$[0]", "variant"), v)

    def read(member: str) -> Column:
        return F.coalesce(D.to_local(member), D.parse_date(member))

    rows = staged(nodes, {
        "__place": first("location"), "__image": first("image"), "__offer": first("offers"),
        "event_date": read("startDate"), "end_date": read("endDate"),
    })
    return staged(rows, {"__cost": J.price_from_offer("__offer", "$"), "title": X.squeeze(X.text_or_empty("name"))})


def event_rows(nodes: DataFrame, keep: list[str] = ("page_id", "url")) -> DataFrame:
    """Listing columns of the event nodes that have a name and a date."""
    rows = _read_events(nodes)
    image = F.when(~F.rlike("image", F.lit(r"^\s*[\[{]")), F.col("image"))
    page_url = F.col("__page_url") if "url" in keep else F.lit("")
    return rows.select(
        *[c for c in keep if c != "url"],
        "title",
        X.strip_html("description").alias("description"),
        F.coalesce(J.text_at("__place", "$.name"), F.lit("")).alias("venue_name"),
        J.postal_address("__place", "$").alias("address"),
        J.number_at("__place", "$.geo.latitude").alias("latitude"),
        J.number_at("__place", "$.geo.longitude").alias("longitude"),
        "event_date",
        "end_date",
        F.coalesce(X.blank_to_null("url"), page_url).alias("url"),
        F.coalesce(J.text_at("__image", "$.url"), J.scalar_at("__image", "$"), image, F.lit("")).alias("image_url"),
        F.col("__cost.price").alias("price"),
        F.col("__cost.is_free").alias("is_free"),
        X.text_or_empty("eventStatus").alias("status"),
    ).where((F.col("title") != "") & F.col("event_date").isNotNull())


def rejected_events(pages: DataFrame, keep: list[str] = ("page_id", "url")) -> DataFrame:
    """Events that give no listing, with what they say: no name, or a date that is not read."""
    rows = _read_events(json_ld_nodes(pages, keep))
    reason = F.when(F.col("title") == "", "name").when(F.col("event_date").isNull(), "startDate")
    return rows.where(reason.isNotNull()).select(
        *[c for c in keep if c != "url"], "pos", "title", F.col("startDate").alias("start_text"), reason.alias("reason"))


def from_json_ld(pages: DataFrame) -> DataFrame:
    """Page HTML to listing rows."""
    return event_rows(json_ld_nodes(pages))


def page_state(pages: DataFrame, script_id: str, keep: list[str] = ("page_id", "url")) -> DataFrame:
    """The state object a page carries in a script of that id, or assigns to that name."""
    by_id = F.regexp_extract(
        "html", rf'(?is)<script[^>]*id="{script_id}"[^>]*>(.*?)</script>', 1
    )
    assigned = F.regexp_extract(
        "html", rf"(?is)<script[^>]*>\s*(?:window\.)?{script_id}\s*=\s*(.*?);?\s*</script>", 1
    )
    text = F.coalesce(X.blank_to_null(by_id), X.blank_to_null(assigned))
    return pages.select(*keep, J.parsed(text).alias("state")).where("state is not null")


def from_page_state(
    pages: DataFrame, script_id: str, items: str, mapping: dict[str, str],
    keep: list[str] = ("page_id", "url"),
) -> DataFrame:
    """Entries of a list inside the page state."""
    states = page_state(pages, script_id, keep)
    listed = F.try_variant_get("state", items, "array<variant>")
    rows = states.select(*keep, F.posexplode(listed).alias("pos", "v"))
    return rows.select(*keep, "pos", *_mapped("v", mapping))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _event_lists(texts: pd.Series) -> pd.Series:
    """Entries of every "events":[...] array in a text (a list may end mid-text)."""
    decoder, marker = json.JSONDecoder(), '"events":'

    def entries(text: str) -> list[str]:
        found, at = [], text.find(marker)
        while at >= 0:
            try:
                listed, _ = decoder.raw_decode(text, at + len(marker))
            except ValueError:
                listed = []
            if isinstance(listed, list):
                found += [json.dumps(e) for e in listed if isinstance(e, dict)]
            at = text.find(marker, at + 1)
        return found

    return texts.map(lambda t: entries(t) if t else [])


def from_chunked_state(pages: DataFrame, mapping: dict[str, str], key: str = "page_id") -> DataFrame:
    """Page state streamed in script fragments; the last entry per id wins."""
    chunks = F.regexp_extract_all(
        "html", F.lit(r"(?s)<script[^>]*>\s*self\.__next_f\.push\((\[.*?\])\)\s*;?\s*</script>"), F.lit(1)
    )
    parts = F.transform(chunks, lambda c: F.try_variant_get(F.try_parse_json(c), "$[1]", "string"))
    text = F.array_join(F.array_compact(parts), "")
    rows = pages.select(key, F.posexplode(_event_lists(text)).alias("pos", "json"))
    rows = rows.withColumn("v", J.parsed("json")).drop("json")
    usable = rows.where(
        " and ".join(f"try_variant_get(v, '$.{p}', 'string') <> ''" for p in ("title", "start", "slug"))
    )
    keyed = usable.withColumn("entry", F.coalesce(J.text_at("v", "$.sys.id"), J.text_at("v", "$.slug")))
    return last_per_key(keyed, [key, "entry"], ["pos"]).select(key, "entry", *_mapped("v", mapping))


@dataclass(frozen=True)
class CardRules:
    """A pattern for a card (group 1) and patterns for its fields (group 1)."""

    card: str
    text: dict[str, str] = field(default_factory=dict)
    raw: dict[str, str] = field(default_factory=dict)
    links: dict[str, str] = field(default_factory=dict)


def from_html_cards(pages: DataFrame, rules: CardRules, key: str = "page_id") -> DataFrame:
    """One row per card; text fields without markup, links made absolute."""
    found = F.regexp_extract_all(X.text_or_empty("html"), F.lit(rules.card), F.lit(1))
    cards = pages.select(key, F.col("url").alias("page_url"), F.posexplode(found).alias("pos", "card"))

    def grab(pattern: str) -> Column:
        return F.regexp_extract("card", pattern, 1)

    return cards.select(
        key, "page_url", "pos",
        *[X.strip_html(grab(p)).alias(n) for n, p in rules.text.items()],
        *[grab(p).alias(n) for n, p in rules.raw.items()],
        *[X.absolute_url(grab(p), F.col("page_url")).alias(n) for n, p in rules.links.items()],
    )


def page_links(pages: DataFrame, pattern: str = ".", key: str = "page_id") -> DataFrame:
    """Distinct absolute links of each page that match a pattern."""
    hrefs = F.regexp_extract_all(X.text_or_empty("html"), F.lit(r"""(?i)<a\s[^>]*href="([^"]+)\""""), F.lit(1))
    links = pages.select(key, "url", F.explode(F.array_distinct(hrefs)).alias("href"))
    full = links.select(key, X.absolute_url("href", "url").alias("link"))
    return full.where(F.col("link").rlike(pattern)).distinct()


def page_meta(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Title, h1 and the meta properties of each page."""
    html = X.text_or_empty("html")
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<meta\s[^>]*>)"), F.lit(1))
    pairs = F.transform(
        tags,
        lambda t: F.struct(
            F.lower(F.regexp_extract(t, r"""(?i)(?:property|name)="([^"]*)\"""", 1)).alias("key"),
            F.regexp_extract(t, r"""(?i)content="([^"]*)\"""", 1).alias("value"),
        ),
    )
    named = staged(
        pages,
        {
            "title": X.strip_html(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)),
            "h1": X.strip_html(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)),
            "__pairs": F.filter(pairs, lambda p: p["key"] != ""),
        },
    )
    # A repeated name keeps its first value.
    first = F.filter(
        "__pairs",
        lambda p, i: ~F.exists(F.slice("__pairs", F.lit(1), i), lambda q: q["key"] == p["key"]),
    )

    def m(name: str) -> Column:
        return F.try_element_at("meta", F.lit(name))

    return staged(named, {"meta": F.map_from_entries(first)}).select(
        key, "title", "h1", "meta",
        F.coalesce(m("og:image"), m("twitter:image")).alias("image"),
        F.coalesce(m("og:description"), m("description")).alias("description"),
        D.to_local(m("event:start_time")).alias("start"),
        D.to_local(m("event:end_time")).alias("end"),
    )


# ---- calendar and RSS files ------------------------------------------------


def ics_entries(df: DataFrame, feed: str = "feed", text: str = "value") -> DataFrame:
    """Calendar texts to (feed, block, props); lines unfolded, parameters kept on names."""
    unfolded = F.regexp_replace(F.replace(X.text_or_empty(text), F.lit("\r\n"), F.lit("\n")), "\n[ \t]", "")
    blocks = F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT\n(.*?)END:VEVENT"), F.lit(1))
    rows = df.select(F.col(feed).alias("feed"), F.posexplode(blocks).alias("block", "body"))
    lines = F.filter(F.split("body", "\n"), lambda line: F.contains(line, F.lit(":")))
    pairs = F.transform(
        lines,
        lambda line: F.struct(
            F.trim(F.substring_index(line, ":", 1)).alias("key"),
            F.trim(F.regexp_replace(line, r"(?s)^[^:]*:", "")).alias("value"),
        ),
    )
    rows = staged(rows, {"pairs": pairs})
    # A repeated name keeps its last value.
    last = F.filter(
        "pairs",
        lambda p, i: ~F.exists(
            F.slice("pairs", i + 2, F.greatest(F.size("pairs"), F.lit(1))), lambda q: q["key"] == p["key"]
        ),
    )
    return rows.select("feed", "block", F.map_from_entries(last).alias("props")).where(F.size("props") > 0)


def read_ics(spark: SparkSession, path: str) -> DataFrame:
    """Calendar files; one task per file."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("feed"), "value"
    )
    return ics_entries(files)


RSS_SCHEMA = (
    "title string, link string, pubDate string, description string, `content:encoded` string, "
    "`media:content` struct<_url:string>"
)


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files as plain columns."""
    items = spark.read.format("xml").option("rowTag", "item").schema(RSS_SCHEMA).load(path)
    return items.select(
        "title", "link", "pubDate", "description",
        F.col("content:encoded").alias("content"), F.col("media:content._url").alias("image_url"),
    )


def rss_items(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One RSS item per row, as XML text in a column, to plain columns."""
    item = F.from_xml(F.col(payload), RSS_SCHEMA, {"rowTag": "item"})
    kept = [c for c in df.columns if c != payload]
    return df.select(*kept, item.alias("i")).select(
        *kept, "i.title", "i.link", "i.pubDate", "i.description",
        F.col("i").getField("content:encoded").alias("content"),
        F.col("i").getField("media:content").getField("_url").alias("image_url"),
    )


def article_date(content: str, published: str, as_of, grace_days: int = 30) -> Column:
    """The date a recent article names, with the clock near it, else its publication stamp.

    An article published more than ``grace_days`` ago has no date, whatever it names. A
    date without a year is of the year of publication. Of each pattern the first hit
    counts; one that is no date, or lies 60 days or more back or two years or more
    ahead, leaves the choice to the next pattern.
    """
    text, now = X.text_or_empty(content), D.ntz(as_of)
    stamp = F.regexp_extract(
        X.text_or_empty(published), r"(\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2})", 1
    )
    stamped = D.parse_date(stamp, ["d MMM yyyy HH:mm:ss"])

    def whole_days(later: Column, earlier: Column) -> Column:
        return F.floor(D.seconds_between(later, earlier) / 86400)

    year = F.coalesce(F.year(stamped), F.year(now)).cast("string")
    tries = []
    for pattern in V.ARTICLE_DATE_PATTERNS:
        near = rf"(?s){pattern}(.{{0,80}})"
        found = F.regexp_replace(F.regexp_extract(text, near, 1), r"(?<=\d)(?:st|nd|rd|th)|,", "")
        clock = F.upper(F.regexp_extract(F.regexp_extract(text, near, 2), V.ARTICLE_CLOCK_PATTERN, 1))
        clock = F.regexp_replace(clock, r"^(\d{1,2})(:\d{2})?\s*([AP]M)$", "$1$2 $3")

        def read(said: Column) -> Column:
            dated = F.when(said.rlike(r"\d{4}$"), said).otherwise(F.concat(said, F.lit(" "), year))
            both = F.concat_ws(" ", F.regexp_replace(dated, r"\s+", " "), X.blank_to_null(clock))
            moment = D.parse_date(both, [f"{m} d yyyy{c}" for m in ("MMMM", "MMM") for c in (" h:mm a", " h a", "")])
            return F.when(said != "", D.once(moment, lambda m: F.when(
                (whole_days(now, m) < 60) & (whole_days(m, now) < 730), m)))

        tries.append(D.once(found, read))
    old = F.coalesce(whole_days(now, stamped) > grace_days, F.lit(False))
    return F.when(~old, F.coalesce(*tries, stamped))


def from_rss(items: DataFrame, as_of, default_address: str = "Santa Monica, CA") -> DataFrame:
    """RSS items to listing rows; items without a date leave."""
    kept = [c for c in items.columns if c not in
            ("title", "link", "pubDate", "description", "content", "image_url")]
    rows = items.withColumn("body", X.strip_html("content")).withColumn("about", X.strip_html("description"))
    rows = staged(rows, {
        "place": X.mine_place("body"), "cost": P.price_from_text("body"),
        "event_date": article_date("body", "pubDate", as_of),
    })
    return rows.where("event_date is not null and title <> ''").select(
        *kept, "title",
        F.coalesce(X.blank_to_null("about"), F.substring("body", 1, 400)).alias("description"),
        F.col("place.venue").alias("venue_name"),
        F.coalesce(X.blank_to_null("place.address"), F.lit(default_address)).alias("address"),
        "event_date",
        X.text_or_empty("link").alias("url"),
        X.text_or_empty("image_url").alias("image_url"),
        "cost.is_free", "cost.price", "cost.price_note",
    )


# ---- joined feeds ----------------------------------------------------------


def _bare_id(c: str) -> Column:
    return F.lower(F.regexp_replace(F.trim(X.text_or_empty(c)), r"^\{+|\}+$", ""))


def from_series_tables(
    series: DataFrame, occurrences: DataFrame, as_of, parks: list[str] | None = None,
    home: str = "",
) -> DataFrame:
    """Occurrences with the listing facts of their parent series.

    ``series``: globalid, event_title, event_description, park_unit,
    park_address, status, event_signup_link, event_costType, event_cost,
    parking_yes_no, parking_cost, x, y. ``occurrences``: parentglobalid,
    event_date_start, event_date_end (epoch ms), status, cancelled_text.
    """
    kept = series.where(F.lower(X.text_or_empty("status")) != "cancelled")
    if parks is not None:
        kept = kept.where(X.any_term(F.lower(X.text_or_empty("park_unit")), [p.lower() for p in parks]))
    kept = kept.withColumn("__key", _bare_id("globalid")).drop("status")
    open_ = occurrences.where(
        ~F.lower(X.text_or_empty("status")).contains("cancel") & (X.text_or_empty("cancelled_text") == "")
    )
    timed = open_.select(
        _bare_id("parentglobalid").alias("__key"),
        D.epoch_ms_to_local("event_date_start").alias("event_date"),
        D.epoch_ms_to_local("event_date_end").alias("end_date"),
    ).where(F.col("event_date").isNotNull() & (F.coalesce("end_date", "event_date") >= D.ntz(as_of)))
    joined = timed.join(kept, "__key")
    free = F.lower(F.trim(X.text_or_empty("event_costType"))) == "free"
    parking = (F.lower(X.text_or_empty("parking_yes_no")) == "yes") & (X.text_or_empty("parking_cost") != "")
    base = F.coalesce(X.blank_to_null(F.trim(X.text_or_empty("event_signup_link"))), F.lit(home))
    return joined.select(
        X.squeeze("event_title").alias("title"),
        X.squeeze("event_description").alias("description"),
        X.squeeze("park_unit").alias("venue_name"),
        X.squeeze("park_address").alias("address"),
        F.col("y").alias("latitude"), F.col("x").alias("longitude"),
        "event_date", "end_date",
        F.concat(F.substring_index(base, "#", 1), F.lit("#"),
                 F.date_format("event_date", "yyyy-MM-dd'T'HH:mm")).alias("url"),
        F.when(~free, P.first_number("event_cost")).alias("price"),
        free.alias("is_free"),
        F.when(parking, F.concat(F.lit("Parking: $"), "parking_cost")).otherwise("").alias("price_note"),
    ).where(F.col("title") != "")


def clock_text(times: Column) -> Column:
    """A23: "7:30pm, 9:45pm"."""
    return F.array_join(
        F.transform(times, lambda m: F.lower(F.date_format(m, "h:mma"))), ", "
    )


def from_showtimes(schedules: DataFrame, movies: DataFrame, as_of, payload: str = "payload") -> DataFrame:
    """map<film, map<day, showtimes>> to one row per film and day.

    ``movies`` has id, title, runtime (seconds), certificate and synopsis.
    """
    kind = "map<string, map<string, array<struct<startsAt:string>>>>"
    films = schedules.select(F.explode(F.from_json(payload, kind)).alias("film", "days"))
    shows = films.select("film", F.explode("days").alias("day", "shows")).select(
        "film", "day", F.explode("shows.startsAt").alias("at")
    )
    wall = F.regexp_replace("at", r"(?i)(z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")
    upcoming = shows.withColumn("at", wall).where(F.col("at") >= D.ntz(as_of))
    per_day = upcoming.groupBy("film", "day").agg(F.array_sort(F.collect_set("at")).alias("times"))
    named = movies.select(
        F.col("id").cast("string").alias("film"), X.squeeze("title").alias("title"), "runtime", "certificate",
        X.truncate_words(X.squeeze("synopsis"), 400).alias("synopsis"),
    )
    rated = X.text_or_empty("certificate") != ""
    length = F.concat(F.round(F.col("runtime") / 60).cast("int").cast("string"), F.lit(" min."))
    facts = F.when(F.col("runtime") > 0, F.when(rated, F.concat(length, F.lit(" "), "certificate")).otherwise(length)).when(
        rated, F.col("certificate"))
    parts = F.array_compact(F.array(
        facts, X.blank_to_null("synopsis"), F.concat(F.lit("Showtimes - "), clock_text(F.col("times")))
    ))
    about = F.concat(F.array_join(F.transform(parts, lambda p: F.rtrim(p, F.lit("."))), ". "), F.lit("."))
    return per_day.join(named, "film").where("title <> ''").select(
        "film", "day", "title", about.alias("description"), F.get("times", F.lit(0)).alias("event_date"),
        clock_text(F.col("times")).alias("clock"), X.slug("title").alias("slug"),
    )


def entities(df: DataFrame, doc: str, payload: str) -> DataFrame:
    """A normalised entity map to rows (doc, key, value)."""
    as_map = F.try_variant_get(J.parsed(payload), "$", "map<string, variant>")
    return df.select(F.col(doc).alias("doc"), F.explode(as_map).alias("key", "value"))


def resolve_refs(rows: DataFrame, path: str, ref: str = "__ref") -> DataFrame:
    """Adds resolved: the entity a reference at a path points to, or the value itself."""
    pointed = F.try_variant_get("value", f"{path}['{ref}']", "string")
    own = F.try_variant_get("value", path, "variant")
    targets = rows.select(F.col("doc"), F.col("key").alias("__ref"), F.col("value").alias("__target"))
    joined = rows.withColumn("__ref", pointed).withColumn("__own", own).join(
        targets, ["doc", "__ref"], "left"
    )
    resolved = F.coalesce("__target", F.when(F.col("__ref").isNull(), F.col("__own")))
    return joined.select("doc", "key", "value", resolved.alias("resolved"))


def listed_products(pages: DataFrame, catalogue: DataFrame, order: str = "pos") -> DataFrame:
    """Products a page lists, in first-seen order; the last catalogue row of an id counts.

    ``catalogue`` has product_id and an order column.
    """
    found = F.regexp_extract_all(X.text_or_empty("html"), F.lit(r'data-product-id\s*=\s*"(\d+)"'), F.lit(1))
    ids = pages.select("page_id", F.posexplode(F.array_distinct(found)).alias("seen", "product_id"))
    ids = ids.withColumn("product_id", F.col("product_id").cast("bigint"))
    latest = last_per_key(catalogue, ["product_id"], [order])
    return ids.join(latest, "product_id")


def occurrences_with_detail(pairs: DataFrame, details: DataFrame) -> DataFrame:
    """(day, url) pairs with the detail of their URL; its clock sets the time.

    ``details`` has one row per url with start_text and end_text.
    """
    dated = pairs.withColumn("__day", F.to_date("event_date"))
    unique = first_per_key(dated, ["url", "__day"], ["event_date"])
    joined = unique.join(details, "url")
    told = X.text_or_empty("start_text") != ""
    start = D.at_clock("__day", F.lit(0), D.parse_clock("start_text")["start_min"])
    ends = X.text_or_empty("end_text") != ""
    end = D.at_clock("__day", F.lit(0), D.parse_clock("end_text")["start_min"])
    return joined.withColumn("event_date", F.when(told, start).otherwise(F.col("event_date"))).withColumn(
        "end_date", F.when(ends, end)
    ).drop("__day")


def min_price(variants) -> Column:
    """struct(price, is_free): lowest readable price; 0 means free."""
    prices = F.transform(variants, lambda v: v["price"].cast("string").try_cast("double"))
    low = F.array_min(F.array_compact(prices))
    return F.struct(F.when(low != 0, low).alias("price"), F.coalesce(low == 0, F.lit(False)).alias("is_free"))


def map_extent(df: DataFrame) -> DataFrame:
    """The box around all located rows."""
    return df.where((F.col("latitude") != 0) & (F.col("longitude") != 0)).agg(
        F.min("latitude").alias("south"), F.max("latitude").alias("north"),
        F.min("longitude").alias("west"), F.max("longitude").alias("east"),
    )


def grid_clusters(df: DataFrame, cell: float) -> DataFrame:
    """Located rows per grid cell, with their mean position."""
    located = df.where((F.col("latitude") != 0) & (F.col("longitude") != 0))
    return located.groupBy(
        F.floor(F.col("latitude") / cell).alias("row"), F.floor(F.col("longitude") / cell).alias("col")
    ).agg(
        F.count(F.lit(1)).alias("n"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude")
    )
