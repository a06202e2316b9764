"""Quality classifier by co-training of two views of a document.

One classifier sees the text, the other what is known about the page. In each round both
score all documents without a label, and the documents one of them is surest about join
the training rows of the other with its verdict. In the end each view is calibrated on
labelled rows it has not learned from, and the calibrated odds are combined.

The classifiers are logistic regressions over hashed features. They are fitted on the
driver, on a bounded sample of labelled rows and a bounded number of pseudo-labels per
round; features are computed once, and every document is scored in every round.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import hashed_sample, text_bytes, widened, written

#: Size of both feature spaces; a feature fits 16 bits.
SPACE = 1 << 16
#: Tokens whose features a task remembers.
MEMORY = 300_000


@dataclass(frozen=True)
class CoTraining:
    """``sample``: most labelled rows used; ``grow``: pseudo-labels per view, class and round."""

    sample: int = 8_000
    rounds: int = 3
    grow: int = 200
    sure: float = 0.95
    check_share: float = 0.3
    steps: int = 120
    penalty: float = 1e-4
    threshold: float = 0.5


_SHAPES = [(re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"9")]


def token_features(token: bytes) -> tuple[int, int]:
    """A token's word and its shape: which kinds of characters follow one another."""
    shape = token
    for pattern, mark in _SHAPES:
        shape = pattern.sub(mark, shape)
    return xxhash.xxh32_intdigest(token.lower(), 1) % SPACE, xxhash.xxh32_intdigest(shape, 2) % SPACE


def text_features(data: bytes, memory: dict[bytes, tuple[int, int]]) -> np.ndarray:
    """Distinct features of a whole text: words, shapes, and how often words and shapes come back."""
    words = data.split()
    distinct = set(words)
    out: set[int] = set()
    for w in distinct:
        found = memory.get(w)
        if found is None:
            if len(memory) >= MEMORY:
                memory.clear()
            found = memory[w] = token_features(w)
        out.update(found)
    if words:
        fresh = int(10 * len(distinct) / len(words))
        size = len(words).bit_length()
        out.add(xxhash.xxh32_intdigest(b"fresh %d %d" % (fresh, size), 3) % SPACE)
    return np.array(sorted(out), np.uint16)


def meta_features(values: dict[str, object]) -> np.ndarray:
    """Distinct features of the page: each value, numbers by their number of bits, and pairs of values."""
    said = []
    for name, value in values.items():
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            value = int(abs(value)).bit_length() if value == value and abs(value) != float("inf") else None
        said.append(f"{name}={value}")
    said += [f"{a}&{b}" for i, a in enumerate(said) for b in said[:i]]
    return np.unique(np.array([xxhash.xxh32_intdigest(s, 4) % SPACE for s in said], np.uint16))


@dataclass
class Rows:
    """Feature lists end to end."""

    ids: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, lists: list[np.ndarray]) -> Rows:
        return cls(np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64),
                   np.cumsum([len(x) for x in lists]))

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """Bias and mean weight of each row, times the root of its number of features."""
        sums = np.concatenate(([0.0], np.cumsum(weights[self.ids])))
        starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64)
        size = np.maximum(self.ends - starts, 1)
        return bias + (sums[self.ends] - sums[starts]) / np.sqrt(size)


@dataclass
class View:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, rows: Rows) -> np.ndarray:
        return self.slope * rows.scores(self.weights, self.bias) + self.shift


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_view(lists: list[np.ndarray], labels: np.ndarray, how: CoTraining) -> View:
    """Logistic regression by gradient steps scaled per feature."""
    rows, view = Rows.of(lists), View(np.zeros(SPACE), 0.0)
    if not len(lists):
        return view
    starts = np.concatenate(([0], rows.ends[:-1])).astype(np.int64)
    size = rows.ends - starts
    owner, root = np.repeat(np.arange(len(lists)), size), np.sqrt(np.maximum(size, 1))
    seen, seen_bias = np.full(SPACE, 1e-8), 1e-8
    for _ in range(how.steps):
        wrong = (sigmoid(rows.scores(view.weights, view.bias)) - labels) / len(labels)
        slope = np.bincount(rows.ids, weights=(wrong / root)[owner], minlength=SPACE) + how.penalty * view.weights
        seen += slope * slope
        seen_bias += wrong.sum() ** 2
        view.weights -= 0.5 * slope / np.sqrt(seen)
        view.bias -= 0.5 * wrong.sum() / np.sqrt(seen_bias)
    return view


def calibrate(view: View, lists: list[np.ndarray], labels: np.ndarray) -> None:
    """Slope and shift of the odds on rows the view has not learned from (Platt's targets)."""
    if len(np.unique(labels)) < 2:
        return
    z = Rows.of(lists).scores(view.weights, view.bias)
    good, bad = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    theta = np.array([1.0, 0.0])
    x = np.stack((z, np.ones_like(z)), 1)
    for _ in range(50):
        p = sigmoid(x @ theta)
        gradient = x.T @ (p - target) + 1e-3 * (theta - [1.0, 0.0])
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    view.slope, view.shift = max(float(theta[0]), 0.0), float(theta[1])


def features(docs: DataFrame, doc_id: str, text: str, meta: list[str]) -> DataFrame:
    """(_id, seen, about, row): features of both views of each row."""
    picked = docs.select(F.col(f"`{doc_id}`").alias("_id"), text_bytes(text).alias("_text"),
                         *[F.col(f"`{c}`").alias(f"m{i}") for i, c in enumerate(meta)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, tuple[int, int]] = {}
        known: dict[tuple, bytes] = {}
        for batch in batches:
            seen = [text_features(x.as_py() or b"", memory).tobytes() for x in batch.column(1)]
            about = []
            for values in zip(*(batch.column(2 + i).to_pylist() for i in range(len(meta)))) if meta else [()] * batch.num_rows:
                found = known.get(values) if len(known) < MEMORY else None
                if found is None:
                    found = known[values] = meta_features(dict(zip(meta, values))).tobytes()
                about.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(seen, pa.binary()), pa.array(about, pa.binary())], names=["_id", "seen", "about"])

    schema = widened(picked.select("_id").schema, "seen binary, about binary")
    return picked.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in column.to_pylist()]


def _surest(seen: DataFrame, marks: DataFrame, views: tuple[View, View], taken: set[int], how: CoTraining) -> list:
    """Unlabelled rows each view is surest about: (view, verdict, row, features of both), ``grow`` of each kind.

    Scores travel without the features; those of the chosen few are fetched in the end.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            fresh = ~np.isin(rows, list(taken))
            for i, view in enumerate(views):
                p = sigmoid(view.logit(Rows.of(_lists(batch.column(1 + i)))))
                for verdict, sure in ((1, p), (0, 1 - p)):
                    at = np.flatnonzero((sure >= how.sure) & fresh)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), i)), pa.array(np.full(len(at), verdict)), pa.array(sure[at]), pa.array(rows[at])],
                        names=["view", "verdict", "sure", "row"])

    found = seen.select("row", "seen", "about").mapInArrow(run, "view bigint, verdict bigint, sure double, row bigint")
    best = F.row_number().over(Window.partitionBy("view", "verdict").orderBy(F.desc("sure"), F.xxhash64("row"), "row"))
    pool = found.join(marks, "row", "left_anti")
    chosen = pool.withColumn("place", best).where(F.col("place") <= how.grow).drop("sure")
    few = F.broadcast(chosen)  # at most 4 * grow rows
    return seen.select("row", "seen", "about").join(few, "row").orderBy("view", "verdict", "place").collect()


def co_trained(seen: DataFrame, marks: DataFrame, how: CoTraining) -> tuple[View, View, float, dict]:
    """Both calibrated views, the log odds of a good document, and what was learned from.

    ``seen``: row, seen, about; ``marks``: row, label. The report counts labelled rows and
    the pseudo-labels of each round.
    """
    sample = F.broadcast(hashed_sample(marks, how.sample, "row"))  # at most ``sample`` rows
    labelled = seen.join(sample, "row").orderBy(F.xxhash64("row"), "row")
    rows = labelled.select("seen", "about", "label").toArrow()
    lists = (_lists(rows.column("seen")), _lists(rows.column("about")))
    labels = rows.column("label").to_numpy().astype(float)
    cut = int(len(labels) * how.check_share)
    check = tuple(x[:cut] for x in lists)
    train: tuple[list, list] = (list(lists[0][cut:]), list(lists[1][cut:]))
    target: tuple[list, list] = (list(labels[cut:]), list(labels[cut:]))
    taken: set[int] = set()
    report: dict = {"labelled": len(labels), "pseudo": []}
    views = ()
    for turn in range(how.rounds + 1):
        views = tuple(fit_view(x, np.array(y), how) for x, y in zip(train, target))
        for view, held in zip(views, check):
            calibrate(view, held, labels[:cut])
        if turn == how.rounds or len(np.unique(labels)) < 2:
            break
        found = _surest(seen, marks, views, taken, how)
        for r in found:
            other = 1 - r["view"]
            train[other].append(np.frombuffer(r["about"] if other else r["seen"], np.uint16))
            target[other].append(float(r["verdict"]))
            taken.add(r["row"])
        report["pseudo"].append(len(found))
    good = (labels.sum() + 1) / (len(labels) + 2)
    return views[0], views[1], float(np.log(good / (1 - good))), report


def quality_scores(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    meta: tuple[str, ...] = ("source", "lang", "n_chars"), label: str = "quality", how: CoTraining = CoTraining(),
) -> DataFrame:
    """(id, text_score, meta_score, score, kept) for each row of ``docs``.

    Scores are probabilities of quality 1. A label counts for all rows with its id; of
    several labels of an id the mean, rounded down, counts; null ids and labels do not.
    Null or empty texts are scored by the features they lack, null page values are values
    like any other. Where no labels of both kinds exist all scores are the share of good
    labels (a half without any) and everything is kept. Repeated rows score alike.
    """
    marks = labels.select(F.col(f"`{doc_id}`").alias("_l"), F.col(f"`{label}`").cast("double").alias("_q")).where(
        "_l is not null and _q is not null").groupBy("_l").agg(F.floor(F.avg("_q")).cast("int").alias("label"))
    seen = written(features(docs, doc_id, text, list(meta)), "features")
    by_row = written(seen.select("_id", "row").join(marks, F.col("_id") == F.col("_l")).select("row", "label"), "labels")
    by_text, by_meta, prior, report = co_trained(seen, by_row, how)
    some = len(report["pseudo"]) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (v.logit(Rows.of(_lists(batch.column(1 + i)))) for i, v in enumerate((by_text, by_meta)))
            if not some:
                a = b = np.full(batch.num_rows, prior)
            score = sigmoid(a + b - prior)
            kept = score >= how.threshold if some else np.ones(batch.num_rows, bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sigmoid(a)), pa.array(sigmoid(b)), pa.array(score), pa.array(kept)],
                names=[doc_id, "text_score", "meta_score", "score", "kept"])

    picked = seen.select(F.col("_id").alias(doc_id), "seen", "about")
    return picked.mapInArrow(run, widened(picked.select(doc_id).schema, "text_score double, meta_score double, score double, kept boolean"))
