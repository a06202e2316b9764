"""Quality rules by compression bands.

Each whole text, and each fixed chunk of it, is compressed with zstandard. A
ratio (raw bytes over compressed bytes) above its band means repetition, below
it noise; the bands depend on the length, since short texts pay for the frame
and long ones offer more to refer back to. Chunks are judged in texts of two
chunks or more (8,192 bytes); a shorter text is judged as a whole only. Everything
about a row comes from that row: one pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import SPACE, rows_to_batches, text_bytes, widened


@dataclass(frozen=True)
class Band:
    """Ratios allowed for texts shorter than ``below`` bytes (null: any length)."""

    below: int | None
    least: float
    most: float


#: Allowed whole-text ratios by length in bytes.
WHOLE = (
    Band(128, 0.0, 3.0), Band(256, 0.9, 3.0), Band(1024, 1.1, 3.2), Band(4096, 1.3, 3.6),
    Band(16384, 1.4, 4.2), Band(None, 1.5, 5.0),
)


@dataclass(frozen=True)
class CompressionRules:
    """Limits of the verdict.

    A text fails when its whole ratio leaves the band of its length, or when more
    than ``odd_share`` of its chunks leave the chunk band. Chunks have
    ``chunk_bytes`` bytes; a last chunk under half of that is not judged alone.
    """

    level: int = 3
    chunk_bytes: int = 4096
    chunk_least: float = 1.3
    chunk_most: float = 4.0
    odd_share: float = 0.25
    bands: tuple[Band, ...] = field(default=WHOLE)

    def band(self, n: int) -> Band:
        return next(b for b in self.bands if b.below is None or n < b.below)


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside a window of ``width`` words that occurs twice or more; exact.

    Windows are ranked by doubling (1, 2, 4, 8 words), so equal ranks mean equal words.
    """
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    step = 1
    while step < width:
        _, rank = np.unique(rank[:-step] << 32 | rank[step:], return_inverse=True)
        step *= 2
    again = np.bincount(rank)[rank] > 1
    if not again.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_measures(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = data.split()
    text = data.decode("utf-8", "replace")
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    return (
        len(words),
        len(text) - sum(data.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")),
        sum(data.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def ratios(data: bytes, rules: CompressionRules, press: zstandard.ZstdCompressor) -> tuple[float, int, int]:
    """Whole ratio, judged chunks, chunks outside the chunk band."""
    whole = len(data) / len(press.compress(data))
    size, judged, odd = rules.chunk_bytes, 0, 0
    if len(data) >= 2 * size:
        for start in range(0, len(data), size):
            piece = data[start : start + size]
            if 2 * len(piece) >= size:
                judged += 1
                odd += not rules.chunk_least <= len(piece) / len(press.compress(piece)) <= rules.chunk_most
    return whole, judged, odd


MEASURES = pa.schema([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("zstd_ratio", pa.float64()),
    ("n_chunks", pa.int64()), ("n_odd_chunks", pa.int64()), ("in_band", pa.bool_()),
])


def compression_rules(docs: DataFrame, text: str = "text", rules: CompressionRules = CompressionRules()) -> DataFrame:
    """All columns of ``docs`` but the text, with its measures and the verdict.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, zstd_ratio,
    n_chunks, n_odd_chunks, in_band, base_failed, kept. A null text counts as empty;
    an empty text has ratio 0, no chunks, is in band and fails by its word count. A
    repeated row is judged again, alike. Columns of ``docs`` with one of the added
    names are left out. ``kept`` is false for fewer than 20 words, for more than 30 %
    of the words in repeated windows, and outside the bands.
    """
    taken = {*MEASURES.names, "base_failed", "kept", text, "_text"}
    others = [c for c in docs.columns if c not in taken]
    picked = docs.select(*[F.col(f"`{c}`") for c in others], text_bytes(text).alias("_text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=rules.level)

        def row(data: bytes | None) -> tuple:
            data = data or b""
            whole, judged, odd = ratios(data, rules, press) if data else (0.0, 0, 0)
            band = rules.band(len(data))
            good = not data or (band.least <= whole <= band.most and odd <= rules.odd_share * judged)
            return *text_measures(data), whole, judged, odd, good

        for batch in batches:
            found = [row(x.as_py()) for x in batch.column(len(others))]
            for more in rows_to_batches(found, MEASURES, max(1, len(found))):
                columns = [*batch.columns[:-1], *more.columns]
                yield pa.RecordBatch.from_arrays(columns, names=[*others, *MEASURES.names])

    kinds = {pa.int64(): "bigint", pa.float64(): "double", pa.bool_(): "boolean"}
    schema = widened(picked.drop("_text").schema, ", ".join(f"{f.name} {kinds[f.type]}" for f in MEASURES))
    out = picked.mapInArrow(judge, schema)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("in_band"))
