"""Listings as JSON, iCalendar and schema.org JSON-LD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import dates as D
from marquee.functions import text as X
from marquee.functions.price import money

STAMPS = ["event_date", "end_date", "created_at", "updated_at"]


def _iso(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def listing_json(df: DataFrame) -> DataFrame:
    """K5: (id, json) with ISO times and explicit nulls."""
    out = [_iso(c).alias(c) if c in STAMPS else F.col(c) for c in df.columns]
    return df.select("id", F.to_json(F.struct(*out), {"ignoreNullFields": "false"}).alias("json"))


def export_json(df: DataFrame, path: str) -> None:
    """K5: one JSON object per line."""
    listing_json(df).select("json").write.mode("overwrite").text(path)


def listing_ics(
    df: DataFrame, as_of, producer: str = "-//Listings//Export//EN", domain: str = "listings.example.com"
) -> DataFrame:
    """K6: (id, file, ics): one calendar text per listing; two hours when no end is known."""
    stamp = "yyyyMMdd'T'HHmmss"
    end = F.coalesce("end_date", D.plus("event_date", 2, "HOUR"))
    place = F.coalesce(X.blank_to_null(X.join_address("venue_name", "address")), F.lit("Location TBA"))
    about = F.coalesce(X.blank_to_null("description"), F.lit("No description available"))

    def light(c: Column) -> Column:
        return F.replace(F.replace(c, F.lit(","), F.lit("\\,")), F.lit(";"), F.lit("\\;"))

    def line(name: str, value: Column, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{name}:"), value)
        return text if when is None else F.when(when, text)

    located = (F.col("latitude") != 0) & (F.col("longitude") != 0)
    lines = [
        *[F.lit(x) for x in ("BEGIN:VCALENDAR", "VERSION:2.0", f"PRODID:{producer}",
                             "CALSCALE:GREGORIAN", "METHOD:PUBLISH", "BEGIN:VEVENT")],
        line("UID", F.concat(F.col("id").cast("string"), F.lit(f"@{domain}"))),
        line("DTSTAMP", F.lit(D.moment(as_of).strftime("%Y%m%dT%H%M%S"))),
        line("DTSTART", F.date_format("event_date", stamp)),
        line("DTEND", F.date_format(end, stamp)),
        line("SUMMARY", light(F.col("title"))),
        line("DESCRIPTION", X.ics_escape(about)),
        line("LOCATION", light(place)),
        line("URL", F.col("url"), X.text_or_empty("url") != ""),
        line("CATEGORIES", F.col("category"), X.text_or_empty("category") != ""),
        line("GEO", F.concat(F.col("latitude").cast("string"), F.lit(";"), F.col("longitude").cast("string")), located),
        *[F.lit(x) for x in ("STATUS:CONFIRMED", "SEQUENCE:0", "END:VEVENT", "END:VCALENDAR")],
    ]
    return df.select(
        "id", X.ics_filename("title", "event_date").alias("file"), F.concat_ws("\r\n", *lines).alias("ics")
    )


def export_ics(df: DataFrame, path: str, as_of) -> None:
    """K6: calendar texts, written in parallel."""
    listing_ics(df, as_of).select("ics").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def _with_offset(c: str) -> Column:
    """Local time with the offset in force at that time."""
    utc = F.convert_timezone(F.lit(D.LOCAL_ZONE), F.lit("UTC"), F.col(c))
    hours = (D.seconds_between(utc, c) / 3600).cast("int")
    return F.concat(_iso(c), F.format_string("-%02d:00", hours))


def listing_json_ld(df: DataFrame) -> DataFrame:
    """K7: (id, json_ld); NULL without a name, a start or a place."""
    place = F.coalesce(X.blank_to_null("venue_name"), X.blank_to_null("address"))
    geo = F.when(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull(),
        F.struct(F.lit("GeoCoordinates").alias("@type"), "latitude", "longitude"),
    )
    location = F.struct(
        F.lit("Place").alias("@type"), place.alias("name"),
        X.blank_to_null("address").alias("address"), geo.alias("geo"),
    )
    free = F.coalesce("is_free", F.lit(False))
    url = X.blank_to_null("url")
    offer = F.when(
        free | F.col("price").isNotNull(),
        F.struct(
            F.lit("Offer").alias("@type"), F.lit("USD").alias("priceCurrency"),
            F.lit("https://schema.org/InStock").alias("availability"),
            F.when(free, F.lit("0")).otherwise(F.ltrim(money("price"), F.lit("$"))).alias("price"),
            url.alias("url"),
        ),
    )
    node = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"),
        F.col("title").alias("name"), _with_offset("event_date").alias("startDate"),
        F.lit("https://schema.org/EventScheduled").alias("eventStatus"),
        F.lit("https://schema.org/OfflineEventAttendanceMode").alias("eventAttendanceMode"),
        location.alias("location"),
        F.when(F.col("end_date").isNotNull(), _with_offset("end_date")).alias("endDate"),
        X.blank_to_null("image_url").alias("image"),
        X.blank_to_null(F.substring(X.strip_tags("description"), 1, 500)).alias("description"),
        url.alias("url"), offer.alias("offers"),
    )
    text = F.to_json(node)
    for char, code in [("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"),
                       ("\u2028", "\\u2028"), ("\u2029", "\\u2029")]:
        text = F.replace(text, F.lit(char), F.lit(code))
    usable = (X.text_or_empty("title") != "") & F.col("event_date").isNotNull() & place.isNotNull()
    return df.select("id", F.when(usable, text).alias("json_ld"))
