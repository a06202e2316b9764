"""Shared helpers of the training-data operators.

Words are maximal runs of anything but ASCII white space. On UTF-8 bytes that
is exactly ``bytes.split()``, and ``bytes.lower()`` folds A-Z only, so the
Python operators read texts as bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marquee.session import job_folder

#: ASCII white space: space and U+0009 to U+000D.
SPACE = b" \t\n\x0b\x0c\r"
#: A word, for engines that use regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


#: Most bytes of an Arrow batch between the JVM and Python; long texts make few rows a batch.
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_BYTES, unless they are smaller already.

    Each running task holds a few batches on either side, so this bounds an executor's
    memory besides its heap.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if now.lstrip("-").isdigit() and not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, to be read in bounded batches."""
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """Write once to the shared folder and read back: later readers repeat no work.

    Survives lost executors, and unlike a checkpoint it is columnar and compressed, with
    zstandard: numbers of places and texts take less disk than with the default.
    A filter on ``parts`` reads only the folders it needs.
    """
    spark = df.sparkSession
    folder = job_folder(spark, name)
    df.write.option("compression", "zstd").partitionBy(*parts).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def hashed_sample(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """At most ``size`` rows, those with the smallest hash of the keys.

    A threshold on the hash leaves about 1.5 times as many before they are ordered, so a
    task sends the driver its share and not ``size`` rows of its own.
    """
    n = df.count()
    hashed = df.withColumn("_hash", F.xxhash64(*keys))
    if n > 3 * size:
        limit = int(-(1 << 63) + (1 << 64) * 1.5 * size / n)
        hashed = hashed.where(F.col("_hash") < F.lit(limit))
    return hashed.orderBy("_hash", *keys).limit(size).drop("_hash")


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as fold 0."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(n)), F.lit(0)).cast("int")


def widened(schema: StructType, ddl: str) -> StructType:
    """A schema with more columns, given as DDL."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text for Arrow; no copy on the JVM side."""
    return F.col(column).cast("string").cast("binary")


def rows_to_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of bounded length."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def packed(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    """Numpy arrays or lists as one record batch."""
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )
