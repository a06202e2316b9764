"""Near duplicates by the similarity of whole texts.

SimHash fingerprints over runs of five words, linked by their Golay keys (``simhash``), give
candidates: all texts of one component of fingerprints. Similar texts differ in up to a dozen
bits, beyond the reach of these keys, so MinHash bands over the same runs give further ones.
The exact Jaccard similarity of the shingle sets decides. Texts alike in their words (A-Z in
lower case) are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.buckets import bit_filter, bucket_links, spots
from marquee.llm.common import packed, text_bytes, widened, written
from marquee.llm.simhash import fingerprint, print_links, shingle_hashes
from marquee.llm.substring_dedup import SETS, JaccardAtLeast, Passages, band_keys, text_key, tuned_bands
from marquee.operators.clusters import duplicate_clusters


def _distinct(found: np.ndarray) -> np.ndarray:
    """Distinct shingles of a text; one of its own for a text without words."""
    return np.unique(found) if len(found) else np.zeros(1, np.uint64)


def text_table(docs: DataFrame, how: Passages) -> DataFrame:
    """(id, node, print, b0, b1, ...) from (id, text): each text's number, fingerprint and band keys."""
    bands = tuned_bands(how.similarity, how.rows, how.recall)
    picked = docs.select("id", text_bytes("text").alias("_text"))
    names = ["node", "print", *[f"b{i}" for i in range(bands)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                texts = [x.as_py() or b"" for x in part.column(1)]
                every = [shingle_hashes(x, how.width) for x in texts]
                prints = pa.array(np.fromiter(map(fingerprint, every), np.uint64, len(every)).view(np.int64))
                sets = [_distinct(x) for x in every]
                starts = np.cumsum([0, *map(len, sets)])[:-1]
                keys = band_keys(np.concatenate(sets), starts, how.rows, bands)
                nodes = pa.array([text_key(x.lower().split()) for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), nodes, prints, *map(pa.array, keys)], names=["id", *names])

    return picked.mapInArrow(run, widened(picked.drop("_text").schema, ", ".join(f"{n} bigint" for n in names)))


def text_sets(docs: DataFrame, wanted: np.ndarray, how: Passages) -> DataFrame:
    """(node, payload): shingle sets of the texts that pass the filter."""
    def has(spot: int) -> bool:
        return bool(wanted[spot >> 3] >> (spot & 7) & 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in batches:
            nodes, sets = [], []
            for data in batch.column(0):
                text = data.as_py() or b""
                node = text_key(text.lower().split())
                if node not in told and all(map(has, spots(node))):
                    if len(told) > 500_000:
                        told.clear()
                    told.add(node)
                    nodes.append(node)
                    sets.append(np.sort(_distinct(shingle_hashes(text, how.width)).view(np.int64)).tobytes())
            yield packed([nodes, sets], SETS)

    return docs.select(text_bytes("text").alias("_text")).mapInArrow(run, "node bigint, payload binary").dropDuplicates(["node"])


def similar_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", how: Passages = Passages()) -> DataFrame:
    """(id, component_id) for each row: the smallest id among the rows reachable over similar texts.

    Texts whose fingerprints are tied within 3 bits and texts that share a band are compared.
    Null ids are passed over; texts without words (null, empty, blank) are alike.
    """
    own = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = written(text_table(own, how), "texts")
    bands = [c for c in rows.columns if c not in ("id", "node", "print")]
    nodes = written(rows.groupBy("node", "print", *bands).agg(F.min("id").alias("least")), "text-nodes")
    near = duplicate_clusters(print_links(nodes.select("print").distinct()), "u", "v").withColumnRenamed("id", "print")
    of_print = F.xxhash64(F.lit("print"), F.coalesce("cluster", "print"))
    keys = nodes.join(near, "print", "left").select(F.explode(F.array(of_print, *bands)).alias("key"), "node")
    common = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    colliding = written(keys.join(common, "key").distinct(), "text-keys")
    sets = text_sets(own, bit_filter(colliding.select("node").distinct()), how)
    links = bucket_links(colliding.join(sets, "node").select("key", "node", "payload"),
                         JaccardAtLeast(how.similarity), how.chunk, numeric=False)
    grouped = duplicate_clusters(links, "u", "v").withColumnRenamed("id", "node")
    rooted = nodes.select("node", "least").join(grouped, "node", "left").withColumn("root", F.coalesce("cluster", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("node", "root").join(least, "root").select("node", "component_id")
    return rows.select("id", "node").join(named, "node").select(F.col("id").alias(doc_id), "component_id")
