"""Area rules applied to a batch of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.functions import geo as G
from marquee.functions import text as X


def venue_listed(terms: list[str]) -> Column:
    """venue and title together contain one of the terms."""
    return X.any_term(X.spaced("venue_name", "title"), terms)


def _verdict(accepted: bool, reason: str) -> Column:
    return F.struct(F.lit(accepted).alias("accepted"), F.lit(reason).alias("reason"))


def beyond_verdict() -> Column:
    """located rows must lie in the county, unlocated ones pass."""
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    inside = G.in_box("latitude", "longitude", V.COUNTY_BOX)
    return (
        F.when(located & inside, _verdict(True, "in_la_county"))
        .when(located, _verdict(False, "outside_la_county"))
        .otherwise(_verdict(True, "beyond_source_unlocated"))
    )


def area_verdict(strict: bool = False) -> Column:
    """box first, then address text; strict sources get no text rescue."""
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    boxed = G.in_coverage("latitude", "longitude")
    named = X.address_in_area("address", F.lit(None).cast("string"), "venue_name")
    any_text = (X.text_or_empty("address") != "") | (X.text_or_empty("venue_name") != "")
    verdict = F.when(located & boxed, _verdict(True, "coordinates_in_bounds"))
    if not strict:
        near = named & G.within_radius("latitude", "longitude")
        verdict = verdict.when(located & near, _verdict(True, "address_match_near_area"))
    verdict = verdict.when(located, _verdict(False, "coordinates_outside_area"))
    verdict = verdict.when(named, _verdict(True, "address_text_match"))
    if not strict:
        verdict = verdict.when(~any_text, _verdict(False, "no_location_info"))
    return verdict.otherwise(_verdict(False, "address_not_recognized"))


def geofence(df: DataFrame, strict: bool = False) -> DataFrame:
    """adds accepted and reason; first rule that applies decides."""
    verdict = (
        F.when(venue_listed(V.VENUE_DENYLIST), _verdict(False, "denylisted_venue"))
        .when(F.col("region") == "beyond", beyond_verdict())
        .when(venue_listed(V.VENUE_ALLOWLIST), _verdict(True, "allowlisted_venue"))
        .otherwise(area_verdict(strict))
    )
    judged = df.withColumn("__v", verdict)
    return judged.select(*df.columns, "__v.accepted", "__v.reason")


def geofence_beyond(df: DataFrame) -> DataFrame:
    """F19 alone."""
    judged = df.withColumn("__v", beyond_verdict())
    return judged.select(*df.columns, "__v.accepted", "__v.reason")
