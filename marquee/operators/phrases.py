"""Token index and phrase lookup, over a table at hand or kept beside a stored one.

The stored index holds postings in folders by a hash of the token, so a phrase reads the
folders of its words only. Postings are never changed: each carries the version of the
change that wrote it, and a tombstone (id, version) ends all earlier postings of a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import text as X
from marquee.operators.search import TEXT_FIELDS


def tokens(df: DataFrame, key: str = "id", fields: list[str] = TEXT_FIELDS) -> DataFrame:
    """One row (id, field, pos, token) per word."""
    per_field = F.array(
        *[F.struct(F.lit(f).alias("field"), X.words(f).alias("words")) for f in fields]
    )
    return (
        df.select(key, F.explode(per_field).alias("f"))
        .select(key, "f.field", F.posexplode("f.words").alias("pos", "token"))
    )


def phrase_ids(index: DataFrame, q: str, key: str = "id") -> DataFrame:
    """Ids where the words of q are adjacent in one field.

    Each occurrence of a phrase word votes for the position where the phrase
    would begin; a begin with a vote per word is a match. One aggregation, so
    a frequent word costs a scan and not a join.
    """
    phrase = X.words(F.lit(q))
    slots = F.filter(
        F.sequence(F.lit(0), F.size(phrase) - 1),
        lambda i: F.get(phrase, i) == F.col("token"),
    )
    votes = (
        index.where(F.array_contains(phrase, F.col("token")) & (F.size(phrase) > 0))
        .select(key, "field", "pos", F.explode(slots).alias("slot"))
        .groupBy(key, "field", (F.col("pos") - F.col("slot")).alias("begin"))
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    return votes.where(F.col("votes") == F.size(phrase)).select(key).distinct()


#: Folders of a stored index; part of its layout, so a table keeps the number it began with.
BUCKETS = 64


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def index_rows(rows: DataFrame, path: str, version: int, key: str = "id", fields: list[str] = TEXT_FIELDS) -> None:
    """K1, K2: postings of new or changed rows; changed ones are forgotten first, at the same version."""
    postings = tokens(rows, key, fields).select(
        F.col(key).alias("id"), "field", "pos", "token", F.lit(version).cast("bigint").alias("version"), _bucket(F.col("token")).alias("bucket"))
    postings.write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")


def forget_rows(keys: DataFrame, path: str, version: int, key: str = "id") -> None:
    """K2, K3: ends the postings that rows had before this version."""
    keys.select(F.col(key).alias("id"), F.lit(version).cast("bigint").alias("ended")).write.mode("append").parquet(f"{path}/tombstones")


def reindex_rows(rows: DataFrame, path: str, version: int, key: str = "id", fields: list[str] = TEXT_FIELDS) -> None:
    """K2, K4: changed rows as they are now."""
    forget_rows(rows, path, version, key)
    index_rows(rows, path, version, key, fields)


def stored_postings(spark: SparkSession, path: str, q: str, key_type: str = "bigint") -> DataFrame:
    """Live postings (id, field, pos, token) of the words of a query, from the folders of these words."""
    words = X.words(F.lit(q))
    asked = spark.range(1).select(words.alias("w"), F.transform(words, _bucket).alias("b")).first()
    kinds = f"id {key_type}, field string, pos int, token string, version bigint, bucket int"
    found = spark.read.schema(kinds).parquet(f"{path}/postings").where(
        F.col("bucket").isin(asked["b"]) & F.col("token").isin(asked["w"]))
    ends = spark.read.schema(f"id {key_type}, ended bigint").parquet(f"{path}/tombstones")
    # a posting ends with any later tombstone of its row
    last = ends.groupBy("id").agg(F.max("ended").alias("ended"))
    return found.join(last, "id", "left").where(F.col("ended").isNull() | (F.col("version") >= F.col("ended"))).select("id", "field", "pos", "token")


def stored_phrase_ids(spark: SparkSession, path: str, q: str, key_type: str = "bigint") -> DataFrame:
    """Ids of the stored rows that hold the phrase."""
    return phrase_ids(stored_postings(spark, path, q, key_type), q)
