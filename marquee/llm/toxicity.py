"""Toxicity by a weighted lexicon.

Texts are folded (look-alike letters, digits and signs in place of letters), then one
Aho-Corasick pass finds all terms of the lexicon. A term is the beginning of words, or a
whole word. Hits inside exception phrases don't count. The weights of the others are set
against the length of the text and calibrated to a probability.

A lexicon may be written by hand or learned from labelled texts: word beginnings are
counted by label over all distinct labelled texts, those that surely favour one label
become terms, and words or pairs of words that alone lead to no bad label become
exceptions.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import rows_to_batches, widened, written

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ᴏ": "o",
}
#: Digits and signs written for letters; 1, ! and | may be i or l and stay one sign.
SIGNS = {"0": "o", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "1", "|": "1"}
#: Characters without width, and marks that can be put on any letter.
UNSEEN = [0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370)]

_LETTERS = str.maketrans({**LOOKALIKES, **{chr(c): None for c in UNSEEN}})
_SIGNS = str.maketrans(SIGNS)
_INNER = re.compile(r"[@$!|]+(?=[^\W_])")
_WORDS = re.compile(r"[^\W_]+")


def _spelled(found: re.Match) -> str:
    """Signs within a word as letters; in front of one they stay signs."""
    signs, before = found.group(), found.string[found.start() - 1 : found.start()]
    return signs.translate(_SIGNS) if before.isalnum() else signs


def fold_text(text: str | None) -> str:
    """The words of a text in folded letters, one space before, between and after them; one space without words."""
    text = text or ""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = text.lower().translate(_LETTERS)
    else:
        text = text.lower()
    if any(c in text for c in "@$!|"):
        text = _INNER.sub(_spelled, text)
    # digits stand for letters in words that have letters
    words = [w if w.isalpha() or w.isdigit() else w.translate(_SIGNS) for w in _WORDS.findall(text)]
    return f" {' '.join(words)} " if words else " "


def spellings(term: str, most: int = 4) -> Iterator[str]:
    """A term with its first few i and l each as written or as the sign that may be both."""
    spots = [i for i, c in enumerate(term) if c in "il"][:most]
    for signs in itertools.product((False, True), repeat=len(spots)):
        letters = list(term)
        for spot, sign in zip(spots, signs):
            if sign:
                letters[spot] = "1"
        yield "".join(letters)


@dataclass(frozen=True)
class Lexicon:
    """Terms and exceptions in folded letters, and the calibration.

    A term begins with a space: a word begins with the rest, and is the rest if it ends
    with a space too. An exception is one or two whole words between spaces.
    """

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    #: Constant, and the factors of the weight of all hits and of that against the length (``_measured``).
    calibration: tuple[float, float, float] = (-3.0, 1.0, 1.0)


class Matcher:
    """All terms and exceptions of a lexicon in one automaton."""

    def __init__(self, lexicon: Lexicon):
        self.automaton = ahocorasick.Automaton()
        held: dict[str, tuple[float, int]] = {}
        for term, weight in lexicon.terms.items():
            for written_ in spellings(term):
                held[written_] = (weight, 0)
        for phrase in lexicon.exceptions:
            for written_ in spellings(phrase):
                held[written_] = (held.get(written_, (0.0, 0))[0], 1)
        for pattern, (weight, spared) in held.items():
            self.automaton.add_word(pattern, (len(pattern), weight, spared))
        if held:
            self.automaton.make_automaton()
        self.empty = not held

    def hits(self, folded: str) -> dict[int, float]:
        """Start of each hit word -> the weight of its heaviest term, outside exceptions."""
        found: dict[int, float] = {}
        spared: set[int] = set()
        if self.empty:
            return found
        for end, (size, weight, spares) in self.automaton.iter(folded):
            start = end - size + 1
            if spares:
                spared.add(start)
                inner = folded.find(" ", start + 1, end)
                if inner > 0:
                    spared.add(inner)
            if weight > found.get(start, 0.0):
                found[start] = weight
        return {at: w for at, w in found.items() if at not in spared}


# -- learning ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Learning:
    """Lengths of word beginnings, bounds of what is kept, and how sure a term must be."""

    #: About so many distinct labelled texts are learned from, by a hash of the text.
    texts: int = 20_000
    shortest: int = 2
    longest: int = 8
    #: Most candidates that reach the driver, most terms and exceptions of a lexicon.
    candidates: int = 4096
    terms: int = 512
    exceptions: int = 2048
    #: A term's share of toxic texts is so many times its share of others, at this many standard deviations.
    ratio: float = 8.0
    sure: float = 2.0
    #: A term comes in such a share of the toxic texts: what only the copies of a few share is none.
    share: float = 0.02
    #: Texts without other hits that make an exception.
    alone: int = 3


def labelled_texts(docs: DataFrame, labels: DataFrame, doc_id: str, label: str, text: str, how: Learning) -> DataFrame:
    """(_text, toxic) of distinct labelled texts, written; a text with several labels has the greater.

    Labels find their texts by id and hash, so only the chosen texts move.
    """
    own = docs.where(F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text")).withColumn("_h", F.xxhash64("_text"))
    told = labels.where(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("_id")).agg(
        F.max(F.col(f"`{label}`") > 0).alias("toxic"))
    known = written(own.select("_id", "_h").join(told, "_id").groupBy("_h").agg(F.max("toxic").alias("toxic")), "labelled")
    n = known.count()
    if n > how.texts:
        known = known.where(F.col("_h") < F.lit(int(-(1 << 63) + (1 << 64) * how.texts / n)))
    # about ``how.texts`` rows of a hash and a flag, whatever the input
    chosen = own.select("_h", "_text").join(F.broadcast(known), "_h")
    return written(chosen.groupBy("_h").agg(F.min("_text").alias("_text"), F.max("toxic").alias("toxic")).drop("_h"), "lessons")


def beginnings(folded: str, how: Learning) -> Counter[str]:
    """How often each word beginning and whole word comes, written as terms."""
    out: Counter[str] = Counter()
    for word, n in Counter(folded.split()).items():
        for size in range(how.shortest, min(how.longest, len(word)) + 1):
            out[f" {word[:size]}"] += n
        if len(word) <= 2 * how.longest:
            out[f" {word} "] += n
    return out


def _counted(texts: DataFrame, how: Learning) -> DataFrame:
    """(term, t1, t2, t3, c1, c2, c3): toxic and other texts that hold a term at least 1, 2 or 3 times."""
    names = ["t1", "t2", "t3", "c1", "c2", "c3"]
    kinds = pa.schema([("term", pa.string()), *[(c, pa.int64()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            yield from rows_to_batches(((term, *n) for term, n in held.items()), kinds)
            held.clear()

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                first = 0 if toxic else 3
                for term, n in beginnings(fold_text(text.as_py()), how).items():
                    row = held.get(term)
                    if row is None:
                        row = held[term] = [0] * 6
                    for at in range(first, first + min(n, 3)):
                        row[at] += 1
                if len(held) > 300_000:
                    yield from flush()
        yield from flush()

    return texts.mapInArrow(run, "term string, " + ", ".join(f"{c} bigint" for c in names)).groupBy("term").agg(
        *[F.sum(c).alias(c) for c in names])


def _surprise(toxic: Column, clean: Column, n1: int, n0: int) -> Column:
    """Twice the log likelihood ratio of a share of toxic texts other than the whole corpus has."""
    share = n1 / (n1 + n0)
    seen = toxic + clean

    def part(n: Column, p: float) -> Column:
        return F.when(n > 0, n * F.log(n / seen / F.lit(p))).otherwise(0.0)

    return 2 * (part(toxic, share) + part(clean, 1 - share))


def learn_terms(texts: DataFrame, n1: int, n0: int, how: Learning) -> dict[str, float]:
    """Terms and their weights, the log ratio of a term's shares of toxic and other texts.

    Of a word's beginnings the one that tells most is a term, of equal ones the longest.
    """
    counts = written(_counted(texts, how).where("t1 >= 3"), "beginnings")
    tried = max(counts.count(), 1)
    by_times = F.explode(F.array(*[F.struct(F.col(f"t{i}").alias("toxic"), F.col(f"c{i}").alias("clean")) for i in (1, 2, 3)]))
    rows = counts.select("term", by_times.alias("n")).select("term", "n.toxic", "n.clean")
    ratio = F.log((F.col("toxic") + 0.5) / (n1 + 1) / ((F.col("clean") + 0.5) / (n0 + 1)))
    doubt = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    told = rows.where(F.col("toxic") >= F.greatest(F.lit(3), F.ceil(F.lit(how.share * n1)))).select(
        "term", _surprise(F.col("toxic"), F.col("clean"), n1, n0).alias("surprise"), (ratio - how.sure * doubt).alias("least"))
    # a surprise that chance gives once among so many tries is none
    told = told.where((F.col("least") > math.log(how.ratio)) & (F.col("surprise") > 2 * math.log(tried)))
    best = told.groupBy("term").agg(F.max("surprise").alias("surprise"))
    order = [F.desc("surprise"), F.desc(F.length("term")), F.col("term")]
    chosen: list[str] = []
    for row in best.orderBy(*order).limit(how.candidates).collect():
        term = row["term"]
        if len(chosen) < how.terms and not any(term.startswith(c.rstrip()) or c.startswith(term.rstrip()) for c in chosen):
            chosen.append(term)
    once = counts.where(F.col("term").isin(chosen)).withColumnsRenamed({"t1": "toxic", "c1": "clean"}).select("term", ratio.alias("weight")).collect()
    return {r["term"]: max(r["weight"], 0.1) for r in sorted(once, key=lambda r: r["term"])}


def phrases(folded: str, starts: Iterable[int]) -> Iterator[set[str]]:
    """For each hit word: the word, the word with the one before, and with the one after."""
    for start in starts:
        end = folded.index(" ", start + 1)
        out = {folded[start : end + 1]}
        if start:
            out.add(folded[folded.rindex(" ", 0, start) : end + 1])
        if end + 1 < len(folded):
            out.add(folded[start : folded.index(" ", end + 1) + 1])
        yield out


def learn_exceptions(texts: DataFrame, terms: dict[str, float], n1: int, n0: int, how: Learning) -> list[str]:
    """Phrases that hold all hits of some texts, and no more often of toxic texts than of others."""
    lexicon = Lexicon(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        held: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                folded = fold_text(text.as_py())
                starts = list(matcher.hits(folded))
                if starts:
                    for phrase in set.intersection(*phrases(folded, starts)):
                        held.setdefault(phrase, [0, 0])[0 if toxic else 1] += 1
        rows = ((phrase, *n) for phrase, n in held.items())
        yield from rows_to_batches(rows, pa.schema([("phrase", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())]))

    counts = texts.mapInArrow(run, "phrase string, toxic bigint, clean bigint").groupBy("phrase").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    spared = counts.where((F.col("clean") >= how.alone) & (F.col("toxic") * n0 <= F.col("clean") * n1))
    rows = spared.orderBy(F.desc("clean"), "phrase").limit(how.exceptions).collect()
    return sorted(r["phrase"] for r in rows)


def weighed(texts: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """All columns but the text, with hits, weight and n_words of the folded text."""
    own = [c for c in texts.columns if c not in (text, "hits", "weight", "n_words")]
    picked = texts.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            found, weight, words = [], [], []
            for data in batch.column(len(own)):
                folded = fold_text(data.as_py())
                hits = matcher.hits(folded)
                found.append(len(hits))
                weight.append(float(sum(hits.values())))
                words.append(folded.count(" ") - 1)
            made = [pa.array(found, pa.int64()), pa.array(weight, pa.float64()), pa.array(words, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*own, "hits", "weight", "n_words"])

    return picked.mapInArrow(run, widened(picked.drop("_text").schema, "hits bigint, weight double, n_words bigint"))


def _measured(rows: DataFrame) -> list[Column]:
    """What is calibrated: the weight of all hits, and the same against the length."""
    return [F.log2(1 + F.col("weight")), F.log2(1 + 100 * F.col("weight") / (F.col("n_words") + 10))]


def fit(points: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on points with counts of either label; factors are never negative."""
    use = [0, 1]
    while True:
        x = np.column_stack([np.ones(len(points)), points[:, use]])
        b = np.zeros(x.shape[1])
        b[0] = math.log((toxic.sum() + 0.5) / (clean.sum() + 0.5))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            slope = x.T @ (toxic - (toxic + clean) * p) - 0.01 * b
            curve = (x * ((toxic + clean) * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(b))
            step = np.linalg.solve(curve, slope)
            b += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-9:
                break
        if not use or b[1:].min() >= 0:
            out = [0.0, 0.0]
            for i, at in enumerate(use):
                out[at] = float(b[1 + i])
            return float(b[0]), out[0], out[1]
        use.pop(int(np.argmin(b[1:])))


def learn_lexicon(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "toxic", text: str = "text", how: Learning = Learning(),
) -> Lexicon:
    """Terms, exceptions and calibration from the texts of ``docs`` with a label (more than 0: toxic).

    Null labels, texts and ids are no lessons; equal texts are one. Without texts of both
    labels the lexicon is empty and every score about the share of toxic texts, a quarter
    without any.
    """
    texts = labelled_texts(docs, labels, doc_id, label, text, how)
    n1, n0 = texts.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    if not n1 or not n0:
        return Lexicon({}, [], (math.log((n1 + 0.5) / (n0 + 1.5)), 0.0, 0.0))
    terms = learn_terms(texts, n1, n0, how)
    lexicon = Lexicon(terms, learn_exceptions(texts, terms, n1, n0, how) if terms else [])
    rows = weighed(texts, lexicon, "_text")
    steps = [F.round(m * 8).cast("int").alias(f"m{i}") for i, m in enumerate(_measured(rows))]
    bins = rows.select("toxic", *steps).groupBy("m0", "m1").agg(
        F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c")).collect()
    points = np.array([(b["m0"] / 8, b["m1"] / 8) for b in sorted(bins)])
    toxic, clean = (np.array([float(b[k]) for b in sorted(bins)]) for k in ("t", "c"))
    return Lexicon(terms, lexicon.exceptions, fit(points, toxic, clean))


def score_texts(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """All columns but the text, with hits, weight, n_words, score (0 to 1) and predicted (1 from 0.5 on).

    A null or empty text has no hits and scores as any text without. Repeated rows score
    alike. Columns of ``docs`` with an added name are replaced.
    """
    rows = weighed(docs.drop("score", "predicted"), lexicon, text)
    own = [F.col(f"`{c}`") for c in rows.columns]
    constant, total, dense = lexicon.calibration
    m = _measured(rows)
    score = 1 / (1 + F.exp(-(F.lit(constant) + F.lit(total) * m[0] + F.lit(dense) * m[1])))
    return rows.select(*own, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
