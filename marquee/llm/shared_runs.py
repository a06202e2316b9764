"""Runs of words that texts share, wherever they lie in a line.

A text is cut into blocks at places chosen by its words alone: of every ``window``
consecutive runs of three words, the one with the least hash begins a block. Two texts
that share a run of words cut its inside alike, so their blocks there are equal, however
the rest and the lines differ. Blocks in a row that all came before are a shared run; the
first place of each block is never part of one, so nothing leaves all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import SPACE, text_bytes, widened, written
from marquee.session import cut_lineage


@dataclass(frozen=True)
class Runs:
    """Blocks are at most ``window`` words, so an exact run of 2 * window + min_words + 2 words is always found."""

    window: int = 16
    min_words: int = 16


_RANDOM = np.random.default_rng(29)
#: Random odd numbers: by byte (A-Z as a-z), by place in a word and by place in a block.
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _RANDOM.integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.isin(np.arange(256), list(SPACE))
#: Bytes of texts worked on together; a longer text comes alone.
TOGETHER = 2_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of parts that begin at ``starts``, each value weighted by its place in its part."""
    sizes = np.diff(np.append(starts, len(values)))
    place = np.arange(len(values)) - np.repeat(starts, sizes)
    return _mixed(np.add.reduceat(values * _PLACE[place % len(_PLACE)], starts))


def blocks(texts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """(text, number, start, end, words, key) of all blocks; start and end are bytes of the text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    gap = _IS_SPACE[data]
    edges = np.flatnonzero(np.diff(gap, prepend=True))
    first, last = edges[::2], edges[1::2]  # a word begins, a word has ended
    n = len(first)
    if not n:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    own = np.searchsorted(begins, first, side="right") - 1
    letters = np.flatnonzero(~gap)
    word = _sums(_BYTE[data[letters]], np.searchsorted(letters, first))
    new = np.diff(own, prepend=-1) != 0
    if n >= window + 2:
        three = _mixed(word[:-2] + _mixed(word[1:-1]) * _PLACE[1] + _mixed(word[2:]) * _PLACE[2])
        views = np.lib.stride_tricks.sliding_window_view(three, window)
        whole = own[: len(views)] == own[window + 1 :][: len(views)]
        at = np.flatnonzero(whole)
        least = window - 1 - views[at, ::-1].argmin(1)  # the last of equals
        new[at + least] = True
    starts = np.flatnonzero(new)
    key = _sums(word, starts)
    text = own[starts]
    ends = np.append(starts[1:], n) - 1
    number = np.arange(len(starts)) - np.searchsorted(text, text, side="left")
    return text, number, first[starts] - begins[text], last[ends] - begins[text], ends - starts + 1, key.view(np.int64)


def _portions(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    start, held, size = 0, [], 0
    for i, data in enumerate(batch.column(column)):
        text = data.as_py() or b""
        if held and size + len(text) > TOGETHER:
            yield start, held
            start, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield start, held


def _later(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """1 for a block that equals one before it in its text, else 0."""
    order = np.lexsort((key, text))  # stable: equal blocks stay in their order
    same = (np.diff(text[order]) == 0) & (np.diff(key[order]) == 0)
    out = np.zeros(len(key), np.int64)
    out[order[1:][same]] = 1
    return out


def block_table(docs: DataFrame, how: Runs) -> DataFrame:
    """(_id, _th, spot, span, key) of the blocks of (_id, _th, _text).

    ``spot`` is the number of a block times 512, plus 256 if its text has an equal block
    before, and its words; ``span`` its first byte times 2**32 and its last: few columns, since
    all blocks of all texts are shuffled.
    """
    names = ["spot", "span", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in _portions(batch, 2):
                text, number, start, end, words, key = blocks(texts, how.window)
                take = pa.array(text + begin)
                columns = (number << 9 | _later(text, key) << 8 | words, start << 32 | end, key)
                arrays = [batch.column(0).take(take), batch.column(1).take(take), *map(pa.array, columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=["_id", "_th", *names])

    return docs.mapInArrow(run, widened(docs.drop("_text").schema, ", ".join(f"{c} bigint" for c in names)))


def shared_runs(docs: DataFrame, how: Runs = Runs()) -> DataFrame:
    """(_id, _th, start, end): bytes of the runs that repeat an earlier text, from (_id, _th, text).

    The first place of a block, by id (null last), hash of the text and number, stays. Null,
    empty and short texts have no runs. Keys common to many texts are counted before they
    move, with the first id alone, since all blocks move there; where an id has several texts,
    the first of them is sought among the blocks of such ids. The join that brings the first
    ids back is left to adaptive skew handling.
    """
    seen = written(block_table(docs.select("_id", "_th", text_bytes("text").alias("_text")), how), "blocks")
    kept = ["_id", "_th", "spot", "span"]
    heads = seen.groupBy("key").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = seen.join(heads, "key")
    first = F.col("_id").eqNullSafe(F.col("least")) & (F.col("spot").bitwiseAND(F.lit(256)) == 0)
    again = met.where(~first).select(*kept)
    texts = docs.groupBy("_id").agg(F.min("_th").alias("lo"), F.max("_th").alias("hi"))
    several = cut_lineage(texts.where("lo <> hi").select(F.col("_id").alias("owner")))
    if not several.isEmpty():
        held = met.where(first).join(several, F.col("_id").eqNullSafe(F.col("owner")), "left_semi")
        leads = held.groupBy("key").agg(F.min("_th").alias("lead"))
        again = again.unionByName(held.join(leads, "key").where("_th <> lead").select(*kept))
    lane = Window.partitionBy("_id", "_th").orderBy("spot")
    number = F.shiftright("spot", 9)
    # rows alike in id and text hold each block as often as they come; it counts once
    fresh = F.lag("spot").over(lane).isNull() | (F.lag("spot").over(lane) != F.col("spot"))
    islands = again.select(
        "_id", "_th", "span", (number - F.dense_rank().over(lane)).alias("island"),
        F.when(fresh, F.col("spot").bitwiseAND(F.lit(255))).otherwise(0).alias("words"))
    runs = islands.groupBy("_id", "_th", "island").agg(
        F.min(F.shiftright("span", 32)).alias("start"), F.max(F.col("span").bitwiseAND(F.lit((1 << 32) - 1))).alias("end"),
        F.sum("words").alias("words"))
    return runs.where(F.col("words") >= how.min_words).select("_id", "_th", "start", "end")
