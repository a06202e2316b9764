"""Language-model scoring with a hidden Markov model.

Words are mapped to a bounded set of classes: the most frequent words are classes of
their own, all others share classes by their ending. A latent state emits a class, and a
class emits one of its words by corpus counts:

    p(text) = p(classes of the text) * product of p(word | class)

The first factor is the HMM, trained by Baum-Welch until the likelihood stands still: each
task adds up the expected counts of its texts, the sums are aggregated, the driver
normalises tables of a fixed size. The
second rests on a table of all words of the corpus, which grows with it and is joined,
never broadcast; only the most frequent words, a fixed number, travel to the tasks.

A long text is cut into segments that are computed side by side: the product of its
steps turns any state distribution at a segment's start into the one at its end, so
stitching the segments gives the exact forward recursion.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marquee.llm.common import packed, text_bytes, written

#: The end of a text, a token like any other; it cannot be a word, since it holds a space.
END = b" "


@dataclass(frozen=True)
class Shape:
    """Sizes of the model; none depends on the input."""

    states: int = 6
    own_classes: int = 2048
    shared_classes: int = 1024
    #: Words whose counts travel to the tasks; the counts of all others are joined.
    frequent: int = 250_000
    #: Baum-Welch rounds; None: until the likelihood stops rising, see ``trained``.
    iterations: int | None = None
    #: A round that raises log10 p of a training token by less is a standstill.
    least_gain: float = 1e-3
    #: No standstill counts before so many rounds.
    least_rounds: int = 3
    #: Parts of the texts after each of which the model moves.
    shares: int = 4
    segment: int = 1024
    smooth: float = 0.1
    #: Frequent classes that count as neighbours when the first states are made.
    neighbours: int = 64

    @property
    def classes(self) -> int:
        return self.own_classes + self.shared_classes


def tokens(data: bytes) -> list[bytes]:
    """Words of a text with A-Z in lower case, then the end."""
    return [*data.lower().split(), END]


def shared_class(word: bytes, shape: Shape) -> int:
    """Class of a word by its last two bytes and length."""
    return shape.own_classes + xxhash.xxh32_intdigest(word[-2:] + bytes((min(len(word), 12),))) % shape.shared_classes


# -- counts ------------------------------------------------------------------------------


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all rows; a null text is empty and still has an end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = packed([list(held), list(held.values())], pa.schema([("word", pa.binary()), ("n", pa.int64())]))
            held.clear()
            return out

        for batch in batches:
            for data in batch.column(0):
                held.update(tokens(data.as_py() or b""))
                if len(held) > 300_000:
                    yield flush()
        if held:
            yield flush()

    return docs.select(text_bytes(text).alias("_text")).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What the tasks know of the words: counts of the frequent ones, totals of the classes."""

    shape: Shape
    counts: dict[bytes, int]
    classes: dict[bytes, int]
    total: int
    distinct: int
    class_total: np.ndarray
    class_distinct: np.ndarray

    def class_of(self, word: bytes) -> int:
        found = self.classes.get(word)
        return shared_class(word, self.shape) if found is None else found

    def base(self, n: int) -> float:
        return math.log10((n + 1) / (self.total + self.distinct + 1))

    def within(self, kind: int, n: int) -> float:
        """log10 p(word | class), one share kept for all unseen words; a class of one word is sure."""
        if kind < self.shape.own_classes:
            return 0.0
        return math.log10((n + 1) / (self.class_total[kind] + self.class_distinct[kind] + 1))


#: Steps per doubling of a count.
STEPS = 64


def most_frequent(counts: DataFrame, sizes: list[int]) -> list[dict[bytes, int]]:
    """For each size the words of the highest counts, no more than so many: (word, n), most frequent first.

    Whole steps of the count are taken, so equal counts fare alike. The thresholds come
    from a histogram of a few thousand steps, so no task sends more than its own share.
    """
    stepped = counts.withColumn("step", F.floor(F.log2("n") * STEPS).cast("int"))
    bars = stepped.groupBy("step").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect()

    def threshold(most: int) -> float:
        held, least = 0, math.inf
        for bar in bars:
            held += bar["words"]
            if held > most:
                break
            least = bar["step"]
        return least

    least_steps = [threshold(size) for size in sizes]
    wide = min(least_steps)
    rows = stepped.where(F.col("step") >= F.lit(int(wide))).collect() if wide < math.inf else []
    rows.sort(key=lambda r: (-r["n"], bytes(r["word"])))
    return [{bytes(r["word"]): r["n"] for r in rows if r["step"] >= least} for least in least_steps]


def learn_vocabulary(counts: DataFrame, shape: Shape) -> Vocabulary:
    """From a written table of (word, n). The driver gets the frequent words and the class totals."""
    held, own_words = most_frequent(counts, [shape.frequent, shape.own_classes])
    classes = {w: i for i, w in enumerate(own_words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, distinct = np.zeros(shape.classes, np.int64), np.zeros(shape.classes, np.int64)
        for batch in batches:
            words = batch.column(0).to_pylist()
            own = np.fromiter((classes[w] if w in classes else shared_class(w, shape) for w in words), np.int64, len(words))
            np.add.at(total, own, batch.column(1).to_numpy())
            distinct += np.bincount(own, minlength=shape.classes)
        yield packed([np.arange(shape.classes), total, distinct], pa.schema([(c, pa.int64()) for c in ("c", "n", "v")]))

    sums = counts.mapInArrow(run, "c bigint, n bigint, v bigint").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    total, distinct = np.zeros(shape.classes, np.int64), np.zeros(shape.classes, np.int64)
    for r in sums:
        total[r["c"]], distinct[r["c"]] = r["n"], r["v"]
    return Vocabulary(shape, held, classes, int(total.sum()), int(distinct.sum()), total, distinct)


# -- texts as classes --------------------------------------------------------------------


class _Places(dict):
    """Places of the frequent words; any other word has none."""

    def __missing__(self, word: bytes) -> int:
        return -1


def encoded(docs: DataFrame, doc_id: str, text: str, keep: list[str], vocabulary: Vocabulary) -> DataFrame:
    """Texts as class sequences (bytes of uint16), with the sums over frequent words and the other words.

    Columns: row, id, the kept ones, classes, n_tokens, n_known, base, within, rare
    (words with their numbers of occurrences), share (by a hash of id and classes).
    """
    own = ["id", *keep]
    picked = docs.select(F.col(f"`{doc_id}`").alias("id"), *[F.col(c) for c in keep], text_bytes(text).alias("_text"))
    kinds = StructType.fromDDL("classes binary, n_tokens bigint, n_known bigint, base double, within double, "
                               "rare array<struct<word:binary,times:int>>")
    schema = StructType([*picked.drop("_text").schema.fields, *kinds.fields])
    v = vocabulary
    place = _Places((w, i) for i, w in enumerate(v.counts))
    kind_of = np.array([v.class_of(w) for w in v.counts] or [0], np.uint16)
    base_of = np.array([v.base(n) for n in v.counts.values()] or [0.0])
    within_of = np.array([v.within(int(c), n) for c, n in zip(kind_of, v.counts.values())] or [0.0])

    def one(data: bytes | None) -> tuple:
        words = tokens(data or b"")
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        other = np.flatnonzero(at < 0)
        known = at if not len(other) else at[at >= 0]
        kinds_ = kind_of[at]
        unheld = [words[i] for i in other.tolist()]
        kinds_[other] = [shared_class(w, v.shape) for w in unheld]
        rare = [{"word": w, "times": n} for w, n in Counter(unheld).items()]
        return kinds_.tobytes(), len(words), len(known), float(base_of[known].sum()), float(within_of[known].sum()), rare

    types = [pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(),
             pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = [one(x.as_py()) for x in part.column(len(own))]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[*own, *kinds.names])

    rows = picked.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    return rows.withColumn("share", F.pmod(F.xxhash64("id", "classes"), F.lit(v.shape.shares)).cast("int"))


# -- the latent model --------------------------------------------------------------------


@dataclass
class Hmm:
    """Start (K), transition (K x K) and emission (C x K) probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def neighbour_counts(texts: DataFrame, shape: Shape) -> np.ndarray:
    """(class, neighbour): how often a frequent class stands before (first half) or after a class, over all texts."""
    wide = shape.neighbours

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(shape.classes * 2 * wide, np.int64)
        for _, sequences in _grouped(batches, 0):
            for one in sequences:
                left, right = one[:-1].astype(np.int64), one[1:].astype(np.int64)
                for own, other, side in ((right, left, 0), (left, right, wide)):
                    near = other < wide
                    np.add.at(sums, own[near] * (2 * wide) + other[near] + side, 1)
        at = np.flatnonzero(sums)
        yield packed([at, sums[at]], pa.schema([("at", pa.int64()), ("x", pa.int64())]))

    rows = texts.select("classes").mapInArrow(run, "at bigint, x bigint").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(shape.classes * 2 * wide)
    out[rows.column("at").to_numpy()] = rows.column("x").to_numpy()
    return out.reshape(shape.classes, 2 * wide)


def clusters(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """k-means of weighted points, started from points that lie far apart."""
    centres = [points[np.argmax(weights)]]
    while len(centres) < k:
        apart = np.min([((points - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(points[np.argmax(apart * weights)])
    own = np.zeros(len(points), np.int64)
    for _ in range(30):
        own = ((points[:, None] - np.array(centres)[None]) ** 2).sum(2).argmin(1)
        centres = [np.average(points[own == j], axis=0, weights=weights[own == j]) if (own == j).any() else centres[j] for j in range(k)]
    return own


def first_guess(vocabulary: Vocabulary, near: np.ndarray) -> Hmm:
    """A state for each cluster of classes with like neighbours (``near``, of ``neighbour_counts``).

    States that begin alike part slowly; these begin with classes of their own.
    """
    shape = vocabulary.shape
    weights = vocabulary.class_total + 1.0
    seen = np.sqrt(near / (near.sum(1, keepdims=True) + 1)) - np.sqrt(near.sum(0) / (near.sum() + 1))
    _, _, axes = np.linalg.svd(seen * np.sqrt(weights)[:, None], full_matrices=False)
    own = clusters(seen @ axes[: shape.states + 2].T, weights, shape.states)
    emit = np.full((shape.classes, shape.states), 0.05)
    emit[np.arange(shape.classes), own] = 1
    emit *= weights[:, None]
    # moves between clusters, as far as the right neighbour is one of the frequent classes
    share = np.eye(shape.states)[own]
    move = share.T @ near[:, shape.neighbours :] @ share[: shape.neighbours] + 1
    return Hmm(np.full(shape.states, 1 / shape.states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


class Segments:
    """Class sequences cut into segments of a bounded length, longest first, side by side.

    The first classes of all segments come first, then the second ones, and so on: a step
    of all segments is one slice.
    """

    def __init__(self, sequences: list[np.ndarray], length: int):
        self.texts = len(sequences)
        cuts = [np.arange(0, len(s), length) for s in sequences]
        self.text = np.repeat(np.arange(self.texts), [len(c) for c in cuts])
        offset = np.cumsum([0] + [len(s) for s in sequences])
        begin = np.concatenate([c + o for c, o in zip(cuts, offset)])
        self.flat = np.concatenate(sequences).astype(np.int64)
        size = np.diff(np.append(begin, len(self.flat)))
        order = np.argsort(-size, kind="stable")
        self.begin, self.size, self.order = begin[order], size[order], order
        self.live = [int(np.searchsorted(-self.size, -t, side="left")) for t in range(int(size.max()))]
        self.flat = self.flat[np.concatenate([self.begin[:n] + t for t, n in enumerate(self.live)])]
        self.step = np.cumsum([0, *self.live]).tolist()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        first = np.flatnonzero(np.diff(self.text, prepend=-1))
        count = np.diff(np.append(first, len(self.text)))
        #: waves[j]: the j-th segments of all texts that have so many, by their place side by side
        self.waves = [rank[first[count > j] + j] for j in range(int(count.max()))]
        self.owner = self.text[order]
        self.several = count[self.owner] > 1


def segment_maps(hmm: Hmm, seg: Segments) -> np.ndarray:
    """(S x K x K) up to a factor a segment: what it makes of a state before it, for texts of several segments.

    Entry [s, i, j] is the probability of the segment's classes ending in state j, given
    that its first step leaves state i; a text's first segment starts without a step. The
    segments are those of ``seg.several``, in their order.
    """
    k = len(hmm.start)
    own = np.flatnonzero(seg.several)
    begins = np.isin(own, seg.waves[0])
    made = np.broadcast_to(np.eye(k), (len(own), k, k)).copy()
    for t, n in enumerate(seg.live):
        live = int(np.searchsorted(own, n))
        if not live:
            break
        part = (made[:live].reshape(-1, k) @ hmm.move).reshape(live, k, k)
        if t == 0:
            part[begins] = np.eye(k)
        part *= hmm.emit[seg.flat[seg.step[t] + own[:live]]][:, None, :]
        if t % 8 == 7:  # eight steps are far from underflow
            part /= part.max((1, 2))[:, None, None]
        made[:live] = part
    return made / made.max((1, 2))[:, None, None]


def stitched(hmm: Hmm, seg: Segments) -> tuple[np.ndarray, np.ndarray]:
    """Per segment the distribution before it, and the backward weights after it (S x K); of texts of several."""
    k = len(hmm.start)
    maps = segment_maps(hmm, seg) if seg.several.any() else np.zeros((0, k, k))
    place = np.cumsum(seg.several) - 1
    now = np.tile(hmm.start, (seg.texts, 1))
    before = np.tile(hmm.start, (len(seg.size), 1))
    later, behind = np.ones((seg.texts, k)), np.ones((len(seg.size), k))
    waves = [w[seg.several[w]] for w in seg.waves]
    for wave in waves:
        text = seg.owner[wave]
        before[wave] = now[text]
        after = np.einsum("si,sij->sj", now[text], maps[place[wave]])
        now[text] = after / after.sum(1)[:, None]
    for wave in waves[::-1]:
        text = seg.owner[wave]
        behind[wave] = later[text]
        earlier = np.einsum("sij,sj->si", maps[place[wave]], later[text])
        later[text] = earlier / earlier.max(1)[:, None]
    return before, behind


def forward_scores(hmm: Hmm, seg: Segments) -> np.ndarray:
    """log10 probability of each text: the scaled forward recursion, all segments at once."""
    before, _ = stitched(hmm, seg)
    _, total = _forward(hmm, seg, before, hmm.emit[seg.flat])
    score = np.zeros(len(seg.size))
    logs = np.log10(total)
    for t, n in enumerate(seg.live):
        score[:n] += logs[seg.step[t] : seg.step[t + 1]]
    return np.bincount(seg.owner, weights=score, minlength=seg.texts)


def _forward(hmm: Hmm, seg: Segments, before: np.ndarray, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state distribution after each class and the scale of each step, in the order of ``seg.flat``."""
    begins = np.zeros(len(seg.size), bool)
    begins[seg.waves[0]] = True
    alpha, total = np.empty_like(emitted), np.empty(len(emitted))
    now = before
    for t, n in enumerate(seg.live):
        at = slice(seg.step[t], seg.step[t + 1])
        part = alpha[at]
        np.matmul(now[:n], hmm.move, out=part)
        if t == 0:
            part[begins] = hmm.start
        part *= emitted[at]
        sums = total[at]
        part.sum(1, out=sums)
        part /= sums[:, None]
        now = part
    return alpha, total


def expected_counts(hmm: Hmm, seg: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of the texts, and their log10 probability."""
    before, behind = stitched(hmm, seg)
    k, segments = len(hmm.start), len(seg.size)
    emitted = hmm.emit[seg.flat]
    alpha, total = _forward(hmm, seg, before, emitted)
    ends = alpha[np.array(seg.step)[seg.size - 1] + np.arange(segments)]
    beta = np.empty_like(alpha)
    back = behind / np.maximum((ends * behind).sum(1), 1e-300)[:, None]  # so that ends * back sums to 1
    emitted /= total[:, None]
    turned = np.ascontiguousarray(hmm.move.T)
    for t in range(len(seg.live) - 1, -1, -1):
        at = slice(seg.step[t], seg.step[t + 1])
        part = back[: seg.live[t]]
        beta[at] = part
        out = emitted[at]
        out *= part
        np.matmul(out, turned, out=part)
    # from here ``emitted`` is the class's emission times what follows, scaled
    begins = np.zeros(segments, bool)
    begins[seg.waves[0]] = True
    inner = ~begins
    moves = before[inner].T @ emitted[:segments][inner]
    former = np.concatenate([np.arange(seg.step[t - 1], seg.step[t - 1] + seg.live[t]) for t in range(1, len(seg.live))] or [np.zeros(0, np.int64)])
    moves = (moves + alpha[former].T @ emitted[segments:]) * hmm.move
    beta *= alpha
    beta /= beta.sum(1)[:, None]
    starts = beta[:segments][begins].sum(0)
    emits = np.column_stack([np.bincount(seg.flat, weights=beta[:, j], minlength=len(hmm.emit)) for j in range(k)])
    return starts, moves, emits, float(np.log10(total).sum())


#: Tokens computed side by side by a task.
BATCH = 800_000


def _grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of batches with bounded numbers of tokens; a longer text comes alone."""
    for batch in batches:
        start, held, size = 0, [], 0
        for i, data in enumerate(batch.column(column)):
            sequence = np.frombuffer(data.as_py(), np.uint16)
            if held and size + len(sequence) > BATCH:
                yield batch.slice(start, i - start), held
                start, held, size = i, [], 0
            held.append(sequence)
            size += len(sequence)
        if held:
            yield batch.slice(start), held


def count_step(texts: DataFrame, hmm: Hmm, shape: Shape) -> np.ndarray:
    """Expected counts of texts (column classes) as one array, added up per task, then over tasks; last their log10 p."""
    size = shape.states + shape.states**2 + shape.classes * shape.states + 1
    # counts need no more than single precision; scores are computed in double
    single = Hmm(*(x.astype(np.float32) for x in (hmm.start, hmm.move, hmm.emit)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size)
        for _, sequences in _grouped(batches, 0):
            a, b, e, s = expected_counts(single, Segments(sequences, shape.segment))
            sums += np.concatenate((a, b.ravel(), e.ravel(), [s]))
        at = np.flatnonzero(sums)
        yield packed([at, sums[at]], pa.schema([("at", pa.int64()), ("x", pa.float64())]))

    rows = texts.select("classes").mapInArrow(run, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(size)
    out[rows.column("at").to_numpy()] = rows.column("x").to_numpy()
    return out


def normalised(sums: np.ndarray, shape: Shape) -> Hmm:
    """The model that expected counts make."""
    k, c = shape.states, shape.classes
    start, move = sums[:k] + shape.smooth, sums[k : k + k * k].reshape(k, k) + shape.smooth
    emit = sums[k + k * k : -1].reshape(c, k) + shape.smooth
    return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def standstill(scores: list[float], shape: Shape) -> bool:
    """Whether log10 p per token, round by round, has settled.

    A gain that is small but larger than the one before is the states beginning to part.
    """
    if len(scores) < max(3, shape.least_rounds):
        return False
    before, last = scores[-2] - scores[-3], scores[-1] - scores[-2]
    return last < shape.least_gain and last <= before


def trained(texts: DataFrame, vocabulary: Vocabulary, shape: Shape) -> Hmm:
    """The model after Baum-Welch over all texts, until ``standstill`` or for ``shape.iterations`` rounds.

    A round goes through the shares of the texts (column share). Each share's new counts
    take the place of its old ones and the model follows at once, so a round over all texts
    moves the model as often as there are shares.
    """
    hmm, scores = first_guess(vocabulary, neighbour_counts(texts, shape)), []
    held: dict[int, np.ndarray] = {}
    while vocabulary.total and len(scores) != shape.iterations:
        for share in range(shape.shares):
            held[share] = count_step(texts.where(F.col("share") == share), hmm, shape)
            hmm = normalised(sum(held.values()), shape)
        scores.append(sum(x[-1] for x in held.values()) / vocabulary.total)
        if shape.iterations is None and standstill(scores, shape):
            break
    return hmm


def class_scores(texts: DataFrame, hmm: Hmm, shape: Shape) -> DataFrame:
    """(row, latent): log10 probability of each class sequence by the forward recursion."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sequences in _grouped(batches, 1):
            score = forward_scores(hmm, Segments(sequences, shape.segment))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=["row", "latent"])

    return texts.select("row", "classes").mapInArrow(run, "row bigint, latent double")


def score_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    flag: str | None = None, shape: Shape = Shape(),
) -> DataFrame:
    """(id, flag, n_tokens, n_known, train_tokens, base_score, score) for each row.

    ``flag`` names a boolean column of ``docs``; rows where it is true are scored and not
    learned from (none: all rows are learned from). A null text is empty: one token, the
    end. Words not seen in training count as unseen ones of their class. Without training
    rows the model is uniform. Repeated rows are learned and scored as often as they come.
    """
    own = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text0"),
                      (F.col(f"`{flag}`") if flag else F.lit(False)).alias("_flag"))
    counts = written(word_counts(own.where(~F.col("_flag")), "_text0"), "words")
    vocabulary = learn_vocabulary(counts, shape)
    texts = written(encoded(own, "_id", "_text0", ["_flag"], vocabulary), "classes", "share")
    hmm = trained(texts.where(~F.col("_flag")), vocabulary, shape)
    latent = class_scores(texts, hmm, shape)
    rare = texts.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    v = vocabulary
    totals = [(i, int(v.class_total[i] + v.class_distinct[i] + 1)) for i in range(shape.own_classes, shape.classes)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = np.zeros(shape.classes)
        for i, n in totals:
            room[i] = math.log10(n)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, words, times, n = (batch.column(i) for i in range(4))
            times, n = times.to_numpy(), n.to_numpy()
            kinds = np.fromiter((shared_class(w, shape) for w in words.to_pylist()), np.int64, len(words))
            share = np.log10(n + 1.0)
            order = rows.to_numpy()
            new = np.flatnonzero(np.diff(order, prepend=order[0] - 1))
            yield packed([
                order[new], np.add.reduceat(times * (n > 0), new), np.add.reduceat(times * (share - math.log10(v.total + v.distinct + 1)), new),
                np.add.reduceat(times * (share - room[kinds]), new)],
                pa.schema([("row", pa.int64()), ("k", pa.int64()), ("b", pa.float64()), ("w", pa.float64())]))

    counted = rare.join(counts, "word", "left").select("row", "word", "times", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    tail = counted.mapInArrow(sums, "row bigint, k bigint, b double, w double").groupBy("row").agg(
        F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("w").alias("w"))
    whole = texts.select("row", "id", "_flag", "n_tokens", "n_known", "base", "within").join(latent, "row").join(tail, "row", "left")
    none = F.lit(0.0)
    return whole.select(
        F.col("id").alias(doc_id), F.col("_flag").alias(flag or "held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(v.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", none)).alias("base_score"),
        (F.col("latent") + F.col("within") + F.coalesce("w", none)).alias("score"))
