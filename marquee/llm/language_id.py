"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams (1 to 3 letters, words padded
with blanks) of a language by rank. A text is ranked the same way and compared
with every profile by the out-of-place distance: the sum of rank differences,
where an n-gram missing from the profile counts as the full profile length.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import packed, text_bytes, widened

PROFILE = 400
#: A language no text was learned for, or a text without letters.
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or 0 for anything that is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _padded(data: bytes) -> np.ndarray:
    """Letters of a text in lower case; each run of others is one 0, as are both ends."""
    raw = data.decode("utf-8", "replace").encode("utf-32-le", "replace")
    codes = _letters()[np.frombuffer(raw, np.uint32)]
    codes = np.concatenate((np.zeros(1, np.uint32), codes, np.zeros(1, np.uint32)))
    keep = codes != 0
    keep[0] = True
    keep[1:] |= codes[:-1] != 0
    return codes[keep].astype(np.uint64)


def grams(data: bytes) -> np.ndarray:
    """All n-grams of 1 to 3 letters as numbers, 21 bits a letter; none crosses a blank."""
    a = _padded(data)
    if len(a) < 3:
        return np.zeros(0, np.uint64)
    b = a[1:]
    pair = a[:-1] << np.uint64(21) | b
    third = a[2:]
    triple = pair[:-1] << np.uint64(21) | third
    # a blank may open or end an n-gram (an opening blank packs as a shorter number, so it is marked)
    mark = np.uint64(1 << 63)
    inner = b[:-1] != 0
    pair = np.where(a[:-1] == 0, pair | mark, pair)
    triple = np.where(a[:-2] == 0, triple | mark, triple)[inner]
    return np.concatenate((a[a != 0], pair, triple))


def ranked(found: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, ties by their number."""
    values, counts = _counted(found)
    if len(values) > size:
        edge = np.partition(counts, len(counts) - size)[len(counts) - size]
        sure = counts >= edge
        values, counts = values[sure], counts[sure]
    return values[np.argsort(-counts, kind="stable")[:size]]


def _counted(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order, and their counts."""
    ordered = np.sort(found)
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """(lang, gram, place): the ``size`` most frequent n-grams of each language.

    Counts cover all rows whose text and language are not null. Tasks sum their
    counts before the shuffle, so a language with most of the rows costs no more.
    """
    picked = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), text_bytes(text).alias("_text"))
    picked = picked.where(F.col("lang").isNotNull() & F.col("_text").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        held: dict[str, int] = {}

        def flush(name: str) -> pa.RecordBatch:
            values, counts = _counted(np.concatenate(waiting.pop(name)))
            held.pop(name)
            return packed([[name] * len(values), values.view(np.int64), counts], COUNTS)

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = grams(data.as_py())
                if len(found):
                    waiting.setdefault(name, []).append(found)
                    held[name] = held.get(name, 0) + len(found)
                    if held[name] > 1_000_000:
                        yield flush(name)
        for name in list(waiting):
            yield flush(name)

    sums = picked.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = F.row_number().over(_by_lang())
    return sums.withColumn("place", best - 1).where(F.col("place") < size).select("lang", "gram", "place")


def _by_lang():
    from pyspark.sql import Window

    return Window.partitionBy("lang").orderBy(F.desc("n"), "gram")


def profile_table(profiles: DataFrame, size: int = PROFILE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, all profile n-grams in order, and each one's place per language (``size``: absent)."""
    rows = profiles.collect()  # languages x profile length
    langs = sorted({r["lang"] for r in rows})
    every = np.unique(np.array([r["gram"] for r in rows], np.int64).view(np.uint64))
    places = np.full((len(every) + 1, len(langs)), size, np.int32)
    for r in rows:
        at = np.searchsorted(every, np.array([r["gram"]], np.int64).view(np.uint64))[0]
        places[at, langs.index(r["lang"])] = r["place"]
    return langs, every, places


def out_of_place(found: np.ndarray, every: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Distance to each language, and the largest distance such a text can have."""
    top = ranked(found, size)
    at = np.searchsorted(every, top)
    at[at == len(every)] = 0
    at = np.where(every[at] == top, at, len(every))
    place = places[at]
    gap = np.abs(place - np.arange(len(top), dtype=np.int32)[:, None])
    return np.where(place == size, size, gap).sum(0), size * len(top)


def scored(data: bytes, langs: list[str], every: np.ndarray, places: np.ndarray, size: int) -> tuple[str, float, int]:
    """Language, score and number of n-grams of one text."""
    found = grams(data)
    if not len(found) or not langs:
        return UNKNOWN, 0.0, len(found)
    far, largest = out_of_place(found, every, places, size)
    best = int(far.argmin())
    return langs[best], 1.0 - float(far[best]) / largest, len(found)


#: Powers of two of n-grams that have a limit of their own.
LENGTHS = 48


def learn_limits(docs: DataFrame, profiles: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, list[float]]:
    """Language -> least score by the power of two of n-grams: half the median of the labelled texts.

    All texts whose language is not null are scored, each whole and as its beginnings of 4,
    8, 16, ... bytes, so that short texts are judged by short ones. A length not seen in a
    language takes the limit of the nearest shorter one, else of the shortest.
    """
    langs, every, places = profile_table(profiles, size)
    picked = docs.where(F.col(f"`{lang}`").isNotNull()).select(text_bytes(text).alias("_text")).where(F.col("_text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = []
                for data in batch.column(0).slice(start, 500):
                    whole = data.as_py()
                    cuts = [1 << k for k in range(2, max(2, (len(whole) - 1).bit_length()))]
                    rows += [scored(whole[:cut], langs, every, places, size) for cut in (*cuts, len(whole))]
                rows = [(a, n.bit_length() - 1, b) for a, b, n in rows if a != UNKNOWN]
                yield packed(list(zip(*rows)) or [[], [], []], LIMITS)

    medians = picked.mapInArrow(run, "lang string, power int, score double").groupBy("lang", "power").agg(
        F.percentile_approx("score", 0.5).alias("median")).collect()  # languages x lengths
    out: dict[str, list[float]] = {}
    for name in sorted({r["lang"] for r in medians}):
        seen = {r["power"]: r["median"] / 2 for r in medians if r["lang"] == name}
        now, out[name] = seen[min(seen)], []
        for power in range(LENGTHS):
            now = seen.get(power, now)
            out[name].append(now)
    return out


LIMITS = pa.schema([("lang", pa.string()), ("power", pa.int32()), ("score", pa.float64())])


def within_limits(limits: dict[str, list[float]]) -> Column:
    """Whether an annotated text (``annotate``) is near enough to its language."""
    if not limits:
        return F.lit(False)
    table = F.create_map(*[c for name, own in limits.items() for c in (F.lit(name), F.array(*map(F.lit, own)))])
    least = table[F.col("_lang_pred")][F.floor(F.log2("_n_grams")).cast("int")]
    return (F.col("_lang_pred") != UNKNOWN) & (F.col("_score") >= F.coalesce(least, F.lit(0.0)))


def identify(
    docs: DataFrame, profiles: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = PROFILE
) -> DataFrame:
    """(id, lang_pred, score, n_grams) for each row; see ``annotate``."""
    found = annotate(docs.select(F.col(f"`{doc_id}`").alias(doc_id), F.col(f"`{text}`").alias("_own")), profiles, "_own", size)
    return found.select(
        doc_id, F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"), F.col("_n_grams").alias("n_grams"))


def annotate(docs: DataFrame, profiles: DataFrame, text: str = "text", size: int = PROFILE) -> DataFrame:
    """All columns of ``docs`` with _lang_pred, _score and _n_grams, from each whole text alone.

    ``_score`` is 1 - distance / largest distance a text of so many n-grams can have.
    A text that is null, empty or without letters, and any text where no profile
    exists, is ``und`` with score 0. Equal distances go to the first language by
    name. Repeated rows and null ids are answered row by row.
    """
    langs, every, places = profile_table(profiles, size)
    own = [c for c in docs.columns if c not in ("_text", "_lang_pred", "_score", "_n_grams")]
    picked = docs.select(*[F.col(f"`{c}`") for c in own])
    has_text = own.index(text)

    def one(data: str | None) -> tuple[str, float, int]:
        return scored(data.encode("utf-8", "replace") if data else b"", langs, every, places, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(x.as_py()) for x in batch.column(has_text)]
            a, b, c = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(a, pa.string()), pa.array(b, pa.float64()), pa.array(c, pa.int64())],
                names=[*own, "_lang_pred", "_score", "_n_grams"])

    return picked.mapInArrow(run, widened(picked.schema, "_lang_pred string, _score double, _n_grams bigint"))
