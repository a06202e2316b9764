"""Repeated passages across documents, by MinHash banding of paragraphs.

A paragraph is one line of a text. Its shingles (runs of five words, A-Z in lower
case) give MinHash values that are joined into bands; paragraphs that share a band
are compared by the exact Jaccard similarity of their shingle sets. Linked
paragraphs form components, and all but the first of each component leave their texts.

Passages that begin or end inside a line are no paragraphs; ``shared_runs`` finds them by
blocks that the words themselves delimit. Both kinds of spans leave a text together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.buckets import bit_filter, bucket_links, spots
from marquee.llm.common import packed, text_bytes, widened, written
from marquee.llm.shared_runs import Runs, shared_runs
from marquee.operators.clusters import duplicate_clusters
from marquee.session import cut_lineage


@dataclass(frozen=True)
class Passages:
    """Paragraphs under ``min_words`` words are left alone: headings, list items, greetings."""

    width: int = 5
    similarity: float = 0.8
    min_words: int = 10
    recall: float = 0.995
    rows: int = 3
    chunk: int = 128
    #: How runs inside lines are found; None: whole lines only.
    runs: Runs | None = Runs()


def tuned_bands(similarity: float, rows: int, recall: float) -> int:
    """Fewest bands of ``rows`` values that find a pair at the threshold with this probability."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


def shingles(words: list[bytes], width: int) -> list[int]:
    """Hashes of all runs of ``width`` words; fewer words make one run."""
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(b" ".join(words))]
    return [digest(b" ".join(words[i : i + width])) for i in range(len(words) - width + 1)]


def paragraphs(data: bytes, min_words: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first byte, words in lower case) of the lines with enough words."""
    at = 0
    for line in data.split(b"\n"):
        if len(line) >= 2 * min_words - 1:
            words = line.lower().split()
            if len(words) >= min_words:
                yield at, words
        at += len(line) + 1


def text_key(words: list[bytes]) -> int:
    """128 bits of the words cut to 63: one number per distinct paragraph."""
    return xxhash.xxh3_128_intdigest(b" ".join(words)) & ((1 << 63) - 1)


def band_keys(hashes: np.ndarray, starts: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """(paragraph, band) -> key, for concatenated shingle hashes."""
    seeds = np.random.default_rng(7)
    keys = np.zeros((bands, len(starts)), np.uint64)
    for band in range(bands):
        mixed = np.full(len(starts), band + 1, np.uint64)
        for _ in range(rows):
            a, b = (np.uint64(int(x)) for x in seeds.integers(1, 1 << 63, 2))
            spun = hashes * (a | np.uint64(1)) + b
            spun ^= spun >> np.uint64(29)
            least = np.minimum.reduceat(spun, starts)
            mixed = (mixed ^ least) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
        keys[band] = mixed
    return keys.view(np.int64)


class JaccardAtLeast:
    """Which sets of one list are similar to which of another; sets are ascending int64 arrays."""

    def __init__(self, least: float):
        self.least = least

    def __call__(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        if len(a) * len(b) <= 16:
            return np.array([[self._pair(x, y) for y in b] for x in a])
        sizes_a, sizes_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
        both = self._has(a, shared) @ self._has(b, shared).T
        return both >= self.least * (sizes_a[:, None] + sizes_b[None, :] - both) - 1e-6

    def _pair(self, x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= self.least * (len(x) + len(y) - both) - 1e-6

    @staticmethod
    def _has(sets: list[np.ndarray], shared: np.ndarray) -> np.ndarray:
        has = np.zeros((len(sets), len(shared)), np.float32)
        for i, values in enumerate(sets):
            at = np.searchsorted(shared, values)
            at = at[at < len(shared)]
            has[i, at[np.isin(shared[at], values, assume_unique=True)]] = 1
        return has


def _ident(doc_id: str, text: str) -> list:
    """A document is its id and text; the hash keeps the text out of the shuffles."""
    return [F.col(f"`{doc_id}`").alias("_id"), F.xxhash64(F.col(f"`{text}`")).alias("_th")]


def paragraph_table(docs: DataFrame, doc_id: str, text: str, how: Passages) -> DataFrame:
    """(_id, _th, pos, size, para, b0, b1, ...): occurrences of paragraphs (bytes, line end included) with their band keys.

    A task tells the band keys of a paragraph once; where it meets it again, they are null.
    """
    bands = tuned_bands(how.similarity, how.rows, how.recall)
    picked = docs.select(*_ident(doc_id, text), text_bytes(text).alias("_text")).where(F.col("_text").isNotNull())
    names = ["pos", "size", "para", *[f"b{i}" for i in range(bands)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in batches:
            held: list[tuple[int, int, int, int, bool]] = []
            hashes: list[int] = []
            starts: list[int] = []
            for row, data in enumerate(batch.column(2)):
                text_ = data.as_py()
                for pos, words in paragraphs(text_, how.min_words):
                    end = text_.find(b"\n", pos)
                    para = text_key(words)
                    held.append((row, pos, (end + 1 if end >= 0 else len(text_)) - pos, para, para not in told))
                    if para not in told:
                        if len(told) > 500_000:
                            told.clear()
                        told.add(para)
                        starts.append(len(hashes))
                        hashes += shingles(words, how.width)
                    if len(hashes) > 300_000 or len(held) > 100_000:
                        yield out(batch, held, hashes, starts)
                        held, hashes, starts = [], [], []
            if held:
                yield out(batch, held, hashes, starts)

    def out(batch: pa.RecordBatch, held: list, hashes: list, starts: list) -> pa.RecordBatch:
        rows, pos, size, para, new = (np.array(x, np.int64) for x in zip(*held))
        keys = band_keys(np.array(hashes, np.uint64), np.array(starts), how.rows, bands) if starts else np.zeros((bands, 0), np.int64)
        take, own = pa.array(rows), pa.array(np.cumsum(new) - 1, mask=new == 0)
        columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(pos), pa.array(size), pa.array(para),
                   *(pa.array(k).take(own) for k in keys)]
        return pa.RecordBatch.from_arrays(columns, names=["_id", "_th", *names])

    return picked.mapInArrow(run, widened(picked.drop("_text").schema, ", ".join(f"{n} bigint" for n in names)))


SETS = pa.schema([("node", pa.int64()), ("payload", pa.binary())])


def shingle_sets(docs: DataFrame, wanted: np.ndarray, text: str, how: Passages) -> DataFrame:
    """(node, payload): shingle sets of the paragraphs that pass the filter, each at least once."""
    def has(spot: int) -> bool:
        return bool(wanted[spot >> 3] >> (spot & 7) & 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in batches:
            nodes, sets = [], []
            for data in batch.column(0):
                for _, words in paragraphs(data.as_py(), how.min_words):
                    para = text_key(words)
                    if para not in told and all(map(has, spots(para))):
                        if len(told) > 500_000:
                            told.clear()
                        told.add(para)
                        nodes.append(para)
                        sets.append(np.unique(np.array(shingles(words, how.width), np.uint64)).view(np.int64).tobytes())
            yield packed([nodes, sets], SETS)

    texts = docs.select(text_bytes(text).alias("_text")).where(F.col("_text").isNotNull())
    return texts.mapInArrow(run, "node bigint, payload binary").dropDuplicates(["node"])


def repeated_paragraphs(docs: DataFrame, doc_id: str, text: str, how: Passages) -> DataFrame:
    """(_id, _th, pos): first bytes of the lines of a document that repeat an earlier passage.

    The first occurrence of a component, by id (null last), hash of the text and
    position, stays.
    """
    bands = tuned_bands(how.similarity, how.rows, how.recall)
    seen = written(paragraph_table(docs, doc_id, text, how), "paragraphs")
    place = F.struct(F.col("_id").isNull().alias("none"), "_id", "_th", "pos")
    names = [f"b{i}" for i in range(bands)]
    # a paragraph moves once a task: a line in many documents is no hot key
    distinct = seen.where("b0 is not null").select("para", *names)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = distinct.select(F.explode(F.array(*names)).alias("key"), F.col("para").alias("node")).repartition(n, "key")
    # one shuffle serves the count and the join
    common = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    colliding = written(keys.join(common, "key").distinct(), "colliding")
    sets = shingle_sets(docs, bit_filter(colliding.select("node").distinct()), text, how)
    links = bucket_links(colliding.join(sets, "node").select("key", "node", "payload"),
                         JaccardAtLeast(how.similarity), how.chunk, numeric=False)
    grouped = duplicate_clusters(links, "u", "v").withColumnRenamed("id", "para")
    counted = seen.groupBy("para").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    classes = counted.join(grouped, "para", "left").where("cluster is not null or n > 1")
    classes = cut_lineage(classes.select("para", "first", F.coalesce("cluster", "para").alias("cluster")))
    keeper = classes.groupBy("cluster").agg(F.min("first").alias("keep"))
    named = classes.select("para", "cluster").join(keeper, "cluster").select("para", "keep")
    again = seen.select("_id", "_th", "pos", "size", "para").join(named, "para").where(~place.eqNullSafe(F.col("keep")))
    return again.select("_id", "_th", F.col("pos").alias("start"), (F.col("pos") + F.col("size")).alias("end")).distinct()


def repeated_spans(docs: DataFrame, doc_id: str, text: str, how: Passages) -> DataFrame:
    """(_id, _th, pieces, last, n_removed, removed): what stays of each document that repeats something.

    ``pieces`` (at, size in bytes) lie between the spans to cut, ``last`` is where the final
    piece begins; ``removed`` holds the spans (at, size), overlapping ones made one.
    """
    spans = repeated_paragraphs(docs, doc_id, text, how)
    if how.runs:
        own = docs.where(F.col(f"`{text}`").isNotNull()).select(*_ident(doc_id, text), F.col(f"`{text}`").alias("text"))
        spans = spans.unionByName(shared_runs(own, how.runs))
    ahead = Window.partitionBy("_id", "_th").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    told = spans.withColumn("done", F.coalesce(F.max("end").over(ahead), F.lit(0)))
    opens = told.withColumn("opens", (F.col("start") > F.col("done")) | (F.col("done") == 0))
    so_far = Window.partitionBy("_id", "_th").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = opens.withColumn("island", F.sum(F.col("opens").cast("int")).over(so_far)).groupBy("_id", "_th", "island").agg(
        F.min("start").alias("at"), F.max("end").alias("end"), F.min("done").alias("done"))
    return merged.groupBy("_id", "_th").agg(
        F.array_sort(F.collect_list(F.struct(F.col("done").alias("at"), (F.col("at") - F.col("done")).alias("size")))).alias("pieces"),
        F.max("end").alias("last"), F.count(F.lit(1)).alias("n_removed"),
        F.array_sort(F.collect_list(F.struct("at", (F.col("end") - F.col("at")).alias("size")))).alias("removed"))


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", how: Passages = Passages()) -> DataFrame:
    """All rows and columns of ``docs`` with repeated passages cut from the text.

    Added: n_removed (bigint) and removed (spans cut: at and size in bytes of the text,
    ascending, none touching). A line is cut with its line end, a run inside a line from its
    first word to its last. A null text stays null, an empty one empty; a text that only
    repeats others becomes empty but for white space. Rows alike in id and text are one
    document and fare alike. Columns of ``docs`` with an added name are replaced.
    """
    cuts = repeated_spans(docs, doc_id, text, how).select(
        F.col("_id").alias("_i"), F.col("_th").alias("_t"), "pieces", "last", "n_removed", "removed")
    own = [c for c in docs.columns if c not in ("n_removed", "removed")]
    left = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)], F.xxhash64(F.col(f"`{text}`")).alias("_h"))
    names = {c: F.col(f"_c{i}") for i, c in enumerate(own)}
    joined = left.join(cuts, names[doc_id].eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_t")), "left")
    data = names[text].cast("binary")

    def piece(at: Column, size: Column | int) -> Column:
        return F.decode(F.substring(data, at.cast("int") + 1, size if isinstance(size, int) else size.cast("int")), "utf-8")

    kept = F.array_join(F.transform("pieces", lambda p: piece(p["at"], p["size"])), "")
    rest = piece(F.col("last"), (1 << 31) - 1)
    cut = F.when(F.col("pieces").isNull(), names[text]).otherwise(F.concat(kept, rest))
    return joined.select(
        *[(cut if c == text else names[c]).alias(c) for c in own],
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("removed", F.expr("cast(array() as array<struct<at:bigint,size:bigint>>)")).alias("removed"))
