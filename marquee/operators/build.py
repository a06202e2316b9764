"""Q4-Q6: raw feed rows to listings, cards, and publishing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.functions import dates as D
from marquee.functions import geo as G
from marquee.functions import price as P
from marquee.functions import text as X
from marquee.operators.categorize import classify
from marquee.operators.geocode import attach_coords, known_venue_address
from marquee.operators.geofence import geofence
from marquee.operators.search import date_bucket, is_hero_image


def build_listings(
    raw: DataFrame, geocodes: DataFrame, strict: bool = False, keep_rejected: bool = False
) -> DataFrame:
    """Q4: known address, coordinates, fence, category, clean text.

    ``raw`` has the feed columns with naive local times; ``geocodes`` usable
    rows. Rejected rows leave unless asked for.
    """
    rows = raw.withColumn("address", F.coalesce(known_venue_address(), F.col("address")))
    unlocated = F.col("latitude").isNull() | F.col("longitude").isNull()
    rows = attach_coords(rows, geocodes)
    rows = rows.withColumn("__use", unlocated & F.col("geo_step").isNotNull())
    rows = rows.withColumn("latitude", F.when(F.col("__use"), F.col("geo_lat")).otherwise(F.col("latitude")))
    rows = rows.withColumn("longitude", F.when(F.col("__use"), F.col("geo_lng")).otherwise(F.col("longitude")))
    rows = geofence(rows.drop("__use", "geo_lat", "geo_lng", "geo_step"), strict)
    if not keep_rejected:
        rows = rows.where("accepted")
    rows = classify(rows, "__category")
    cleaned = {
        **{c: X.clean_text(c) for c in ("title", "description", "venue_name")},
        **{c: F.trim(X.text_or_empty(c)) for c in ("address", "url", "image_url", "price_note")},
        "source_logo_url": X.text_or_empty("source_logo_url"),
        "category": F.coalesce(X.blank_to_null("category"), F.col("__category")),
        "is_free": F.coalesce("is_free", F.lit(False)),
    }
    kept = [cleaned[c].alias(c) if c in cleaned else F.col(c) for c in raw.columns]
    extra = ["accepted", "reason"] if keep_rejected else []
    return rows.select(*kept, *extra)


def listing_cards(df: DataFrame, as_of) -> DataFrame:
    """Q5: the columns a result page shows."""
    bucket = date_bucket(as_of)
    picture = F.when(is_hero_image(), F.trim("image_url")).otherwise(
        P.theme_image("id", "title", "category")
    )
    return df.select(
        "id",
        "title",
        "venue_name",
        X.compact_address("address").alias("address"),
        X.date_label("event_date", "end_date").alias("date_label"),
        X.time_label("event_date").alias("time_label"),
        bucket["ord"].alias("bucket_ord"),
        bucket["label"].alias("bucket"),
        picture.alias("image"),
        P.price_label("price", "is_free", "price_note").alias("price_label"),
        G.area("latitude", "longitude").alias("area"),
        "event_date",
    )


def publish(df: DataFrame, root: str) -> str:
    """Q6: write a snapshot and point readers at it, refusing an empty one.

    Each snapshot has its own folder, so the previous one stays readable and
    nothing is copied; the pointer changes only after the rows are written.
    """
    spark = df.sparkSession
    name = f"snapshot-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    if spark.read.parquet(f"{root}/{name}").isEmpty():
        raise ValueError("refusing to publish an empty snapshot")
    spark.range(1).select(
        F.lit(name).alias("snapshot"), F.current_timestamp().alias("published_at")
    ).write.mode("append").parquet(f"{root}/pointer")
    return name


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """Q6: the snapshot published last."""
    latest = spark.read.parquet(f"{root}/pointer").orderBy(F.desc("published_at")).first()
    return spark.read.parquet(f"{root}/{latest['snapshot']}")
