"""Near duplicates by SimHash fingerprints and Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay
code (23, 12) puts every 23-bit word within 3 bits of exactly one codeword, so a
segment decodes to a 12-bit index that words near one another tend to share. The
indices of a segment and of all its one-bit neighbours (at most 6 are distinct)
contain the index of every word one bit away.

Pigeonhole over 3 differing bits: either some segment is equal and another differs
in at most one bit, or each differs in exactly one. Keys for the first case join a
raw segment with the fuzzy indices of another; keys for the second join indices of
all three. Every pair within 3 bits shares a key, and shared keys are verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.buckets import bit_filter, bucket_links, passing
from marquee.llm.common import packed, text_bytes, widened, written
from marquee.operators.clusters import duplicate_clusters
from marquee.session import dealt

WIDTHS = (23, 23, 18)
STARTS = (0, 23, 46)
SEED = 42
#: Generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Distinct fingerprints of one key that a task compares at once.
CHUNK = 1024


def shingle_hashes(data: bytes, width: int = 3, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``width`` words of a text, repeats included; A-Z in lower case.

    Fewer words make one shingle of them all, no words make none.
    """
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], seed) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())]
    return np.array(found, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit set where over half of the hashes have it; zero for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


@cache
def _error_of_syndrome() -> np.ndarray:
    """Error pattern of up to 3 bits for each of the 2,048 remainders."""
    out = np.zeros(2048, np.uint32)
    for size in (1, 2, 3):
        for bits in combinations(range(23), size):
            word = np.array([sum(1 << b for b in bits)], np.uint32)
            out[_syndrome(word)[0]] = word[0]
    return out


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator."""
    rest = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        has = (rest >> np.uint32(bit)) & np.uint32(1)
        rest = rest ^ has * np.uint32(GENERATOR << (bit - 11))
    return rest


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Index (0 to 4,095) of the codeword within 3 bits of each 23-bit word."""
    return ((words ^ _error_of_syndrome()[_syndrome(words)]) >> np.uint32(11)).astype(np.int64)


def fuzzy_indices(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own index, distinct indices of the word and its one-bit neighbours (padded), which are real."""
    around = words[:, None] ^ np.concatenate(([0], 1 << np.arange(width))).astype(np.uint32)[None, :]
    index = codeword_index(around)
    own = index[:, 0].copy()
    index = np.sort(index, 1)
    new = np.ones(index.shape, bool)
    new[:, 1:] = index[:, 1:] != index[:, :-1]
    wide = int(new.sum(1).max()) if len(words) else 1
    order = np.argsort(~new, 1, kind="stable")[:, :wide]
    return own, np.take_along_axis(index, order, 1), np.take_along_axis(new, order, 1)


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key) for all keys of all fingerprints."""
    bits = prints.view(np.uint64)
    raw = [((bits >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.uint32) for s, w in zip(STARTS, WIDTHS)]
    fuzzy = [fuzzy_indices(r, w) for r, w in zip(raw, WIDTHS)]
    at, keys = [], []

    def add(family: int, values: np.ndarray, real: np.ndarray) -> None:
        rows, columns = np.nonzero(real)
        at.append(rows)
        keys.append(values[rows, columns] | family << 60)

    pairs = [(i, j) for i in range(3) for j in range(3) if i != j]
    for family, (i, j) in enumerate(pairs):
        add(family, raw[i].astype(np.int64)[:, None] << 12 | fuzzy[j][1], fuzzy[j][2])
    (a, aa, ar), (b, bb, br), (c, cc, cr) = fuzzy
    n = len(prints)
    ends = aa[:, :, None] << 24 | cc[:, None, :]
    add(6, (ends | b[:, None, None] << 12).reshape(n, -1), (ar[:, :, None] & cr[:, None, :]).reshape(n, -1))
    add(6, a[:, None] << 24 | bb << 12 | c[:, None], br)
    rows, values = np.concatenate(at), np.concatenate(keys)
    pair = np.unique(np.stack((rows, values)), axis=1)
    return pair[0], pair[1]


class WithinBits:
    """Links of fingerprints that differ in at most ``most`` bits."""

    def __init__(self, most: int):
        self.most = most

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]) <= self.most

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= self.most


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and ``print`` (the 64 bits as a long)."""
    others = [c for c in docs.columns if c not in (text, "print", "_text")]
    picked = docs.select(*[F.col(f"`{c}`") for c in others], text_bytes(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (fingerprint(shingle_hashes(x.as_py() or b"")) for x in batch.column(len(others))), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*others, "print"])

    return picked.mapInArrow(run, widened(picked.drop("_text").schema, "print bigint"))


KEYS = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("payload", pa.int64())])


def _mixed(keys: np.ndarray) -> np.ndarray:
    """The keys, one to one, with all bits like random ones."""
    bits = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = (bits ^ bits >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (bits ^ bits >> np.uint64(32)).view(np.int64)


def _keys(prints: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """(key, node, payload) of all keys, or of those that pass the filter."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy()
            for start in range(0, len(every), 2000):
                own = every[start : start + 2000].copy()
                rows, keys = fuzzy_keys(own)
                keys = _mixed(keys)
                if wanted is not None:
                    good = passing(wanted, keys)
                    rows, keys = rows[good], keys[good]
                yield packed([keys, own[rows], own[rows]], KEYS)

    return prints.mapInArrow(emit, "key bigint, node bigint, payload bigint")


def shared_keys(prints: DataFrame) -> DataFrame:
    """(key, node, payload): the keys that two fingerprints share, and few others.

    Most keys are of one fingerprint only. Of all keys only the numbers move, to be counted;
    the rows are made again behind a filter of fixed size, so the others never move.
    """
    prints = dealt(prints)
    counts = _keys(prints).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return _keys(prints, bit_filter(counts.where("n > 1").select(F.col("key").alias("node"))))


def print_links(prints: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(u, v): links between distinct fingerprints (one column, ``print``) within 3 bits."""
    return bucket_links(shared_keys(prints), WithinBits(3), chunk, numeric=True)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id, print, component_id) for each row.

    Equal fingerprints are one node, so a group of copies of any size costs one row.
    ``component_id`` is the smallest id among the rows reachable over links of at most
    3 bits; ids that are null are passed over, and a component of null ids only has a
    null id. Texts without words (null, empty, blank) have fingerprint zero and are
    linked like any other. Repeated rows are answered row by row.
    """
    rows = written(fingerprints(docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))), "simhash")
    nodes = rows.groupBy("print").agg(F.min("id").alias("least"))
    grouped = duplicate_clusters(print_links(nodes.select("print"), chunk), "u", "v")
    rooted = nodes.join(grouped.withColumnRenamed("id", "print"), "print", "left").withColumn(
        "root", F.coalesce("cluster", "print"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("print", "root").join(least, "root").select("print", "component_id")
    return rows.join(named, "print").select(F.col("id").alias(doc_id), "print", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                classes_of: Callable[[DataFrame, str, str], DataFrame] = near_duplicates) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one of each component of ``classes_of`` stays.

    It is the row with the smallest id; among rows that share this id (or the null id)
    the one with the smallest hash of all its columns, and of rows alike in all columns
    one. All columns are kept.
    """
    own = docs.columns
    row_hash = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in own])
    classes = classes_of(
        docs.select(F.struct(F.col(f"`{doc_id}`").isNull().alias("none"), F.col(f"`{doc_id}`").alias("id"),
                             row_hash.alias("hash")).alias("row"), F.col(f"`{text}`").alias("text")), "row", "text")
    winners = classes.groupBy("component_id").agg(F.count(F.lit(1)).alias("_n")).select("component_id.*")
    tagged = docs.withColumn("_hash", row_hash)
    kept = tagged.join(
        winners.select(F.col("id").alias("_id"), F.col("hash").alias("_win")),
        F.col(f"`{doc_id}`").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_win")), "left_semi")
    alone = kept.groupBy("_hash", F.col(f"`{doc_id}`").alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    twice = F.col(f"`{doc_id}`").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_twin"))
    alone = alone.select("_id", F.col("_hash").alias("_twin"))
    return kept.join(alone, twice, "left_anti").select(own).unionByName(
        kept.join(alone, twice, "left_semi").select(own).dropDuplicates())
