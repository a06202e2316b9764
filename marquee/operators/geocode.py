"""Coordinate lookup against a geocode table (address_key, lat, lng, cached_at)."""

from __future__ import annotations

from datetime import timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.functions import text as X
from marquee.functions.dates import moment
from marquee.operators.listings import update
from marquee.session import small_table

POSITIVE_SECONDS = 90 * 86400
NEGATIVE_SECONDS = 7 * 86400


def fresh_geocodes(dimension: DataFrame, as_of) -> DataFrame:
    """G1: adds state (hit, negative, miss); rows without a stamp are stamped now."""
    now = F.lit(moment(as_of).replace(tzinfo=timezone.utc).timestamp())
    found = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    stamp = F.coalesce("cached_at", F.lit(0.0))
    age = now - stamp
    state = (
        F.when(found & ((stamp == 0) | (age < POSITIVE_SECONDS)), "hit")
        .when(~found & (age < NEGATIVE_SECONDS), "negative")
        .otherwise("miss")
    )
    return dimension.withColumn("state", state).withColumn(
        "cached_at", F.when(found & (stamp == 0), now).otherwise(F.col("cached_at"))
    )


def address_key(c) -> Column:
    return F.lower(F.trim(X.text_or_empty(c)))


def venue_key(c) -> Column:
    """Venue name for exact lookups: ampersand entities decoded, lower case."""
    s = F.replace(X.text_or_empty(c), F.lit("&amp;"), F.lit("&"))
    for entity, char in [("&#39;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")]:
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.lower(F.trim(s))


def override_dimension(spark) -> DataFrame:
    """Curated venue addresses as rows (venue_key, address)."""
    return small_table(spark, list(V.VENUE_ADDRESSES.items()), "venue_key string, address string")


def venue_overrides(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """Adds override_address for venues with a curated address."""
    named = dimension.select(
        F.col("venue_key").alias("__venue"), F.col("address").alias("override_address")
    )
    keyed = df.withColumn("__venue", venue_key("venue_name"))
    return keyed.join(named, "__venue", "left").drop("__venue")


def known_venue_address() -> Column:
    """Canonical address of a venue whose name contains a listed part."""
    venue, known = F.lower(X.text_or_empty("venue_name")), F.lit(None).cast("string")
    for part, address in reversed(V.KNOWN_VENUE_ADDRESSES.items()):
        known = F.when(venue.contains(part), F.lit(address)).otherwise(known)
    return known


def attach_coords(
    df: DataFrame, geocodes: DataFrame, overrides: DataFrame | None = None
) -> DataFrame:
    """Adds geo_lat, geo_lng and geo_step from the first key that is known.

    The keys are the address, the normalised address, the curated address of the
    venue, and "venue, city". They are looked up once per distinct
    (address, venue): a place that holds most rows costs one lookup.
    ``geocodes`` holds usable rows only (G1 state hit).
    """
    places = df.select(
        X.text_or_empty("address").alias("__address"), X.text_or_empty("venue_name").alias("__venue")
    ).distinct()
    dimension = overrides if overrides is not None else override_dimension(df.sparkSession)
    curated = dimension.select(
        F.col("venue_key").alias("__vk"), F.col("address").alias("__override")
    )
    places = places.withColumn("__vk", venue_key("__venue")).join(curated, "__vk", "left")
    venue = F.trim("__venue")
    named = venue != ""
    raw, tidy = address_key("__address"), address_key(X.norm_address("__address"))
    keys = F.array(
        raw,
        tidy,
        F.when(named, address_key("__override")),
        F.when(named, address_key(F.concat(venue, F.lit(", "), X.city_hint("__address")))),
    )
    tries = places.select(
        "__address", "__venue", F.posexplode(keys).alias("step", "address_key")
    ).where(F.col("address_key") != "")
    found = (
        tries.join(geocodes.select("address_key", "lat", "lng"), "address_key")
        .groupBy("__address", "__venue")
        .agg(F.min(F.struct("step", "lat", "lng")).alias("hit"))
    )
    joined = df.withColumn("__address", X.text_or_empty("address")).withColumn(
        "__venue", X.text_or_empty("venue_name")
    ).join(found, ["__address", "__venue"], "left")
    return joined.select(
        *df.columns,
        F.col("hit.lat").alias("geo_lat"),
        F.col("hit.lng").alias("geo_lng"),
        (F.col("hit.step") + 1).alias("geo_step"),
    )


def budget(worklist: DataFrame, n: int) -> DataFrame:
    """The n most frequent keys."""
    return worklist.orderBy(F.desc("freq"), "address_key").limit(n)


def geocode_worklist(df: DataFrame, geocodes: DataFrame, n: int | None = None) -> DataFrame:
    """Distinct addresses of unlocated rows that the table does not answer."""
    wanted = (
        df.where(F.col("latitude").isNull() | F.col("longitude").isNull())
        .select(address_key("address").alias("address_key"))
        .where(F.col("address_key") != "")
        .groupBy("address_key")
        .agg(F.count(F.lit(1)).alias("freq"))
    )
    answered = geocodes.where(F.col("state") != "miss").select("address_key")
    open_ = wanted.join(answered, "address_key", "left_anti")
    return open_ if n is None else budget(open_, n)


def backfill_coords(
    df: DataFrame, geocodes: DataFrame, better_addresses: DataFrame, as_of
) -> DataFrame:
    """Unlocated rows get coordinates, and a better address where one is listed.

    ``better_addresses`` has columns (address, better).
    """
    missing = df.where(F.col("latitude").isNull() | F.col("longitude").isNull())
    improved = (
        missing.select("id", "address", "venue_name")
        .join(better_addresses, "address", "left")
        .select("id", F.coalesce("better", "address").alias("address"), "venue_name")
    )
    found = attach_coords(improved, geocodes).where(F.col("geo_step").isNotNull())
    changes = found.select(
        "id", "address", F.col("geo_lat").alias("latitude"), F.col("geo_lng").alias("longitude")
    )
    return update(df, changes, as_of)
