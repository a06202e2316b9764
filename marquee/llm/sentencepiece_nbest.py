"""SentencePiece encoding with the N best segmentations, and decoding.

A text becomes a lattice: positions are nodes, pieces of the vocabulary are arcs with
their scores. A forward Viterbi pass gives the best score from the start to every node;
A-star then walks backward from the end, and those scores are its heuristic, exact, so
complete paths come out in order of their score.

No piece of a vocabulary with spaces at the front of its pieces crosses from a letter to
a space, so such places cut the lattice into chunks. The chunks of a batch of texts that
are not yet known are matched and scored together, column by column. A text's N best
need only the N - 1 chunks whose second-best segmentation loses least: A-star runs in
those, and over their combinations.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import widened

SPACE = "▁"
#: Stand-in for a space mark that is part of the text itself: a code point no valid text has.
LITERAL = "\ud800"
#: A character outside the vocabulary costs this much more than the rarest piece.
UNKNOWN_COST = 10.0
#: Characters of the chunks remembered by a task, each chunk counting ENTRY more; cleared when full.
MEMORY = 8_000_000
ENTRY = 30
#: Bytes of the texts that are encoded together, up to one text more.
TOGETHER = 500_000
#: Characters of the chunks that are scored together; a longer chunk comes alone.
SCORED = 200_000
#: Vocabulary of the queries, where the executors have it installed.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

#: (score, ids) of one segmentation.
Path = tuple[float, tuple[int, ...]]


#: Of a chunk: score and ids (bytes of int32) of the best segmentation, what the second best loses.
Known = tuple[float, bytes, float]


class Trie:
    """Pieces by their characters, for many positions at once: a hash table of (state, character)."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        letters = sorted({c for p in pieces for c in p})
        self.letter = np.zeros(0x110000, np.int64)
        for i, c in enumerate(letters, 1):
            self.letter[ord(c)] = i
        number, steps, states = {c: i for i, c in enumerate(letters, 1)}, {}, 1
        ends: dict[int, tuple[int, float]] = {}
        for piece, entry in pieces.items():
            state = 0
            for c in piece:
                key = state << 21 | number[c]
                if key not in steps:
                    steps[key] = states
                    states += 1
                state = steps[key]
            ends[state] = entry
        self.piece = np.full(states, -1, np.int64)
        self.score = np.zeros(states)
        for state, (i, s) in ends.items():
            self.piece[state], self.score[state] = i, s
        self._keys, self._next = np.full(1 << 19, -1, np.int64), np.zeros(1 << 19, np.int64)
        while len(steps) * 3 > len(self._keys):
            self._keys, self._next = np.full(2 * len(self._keys), -1, np.int64), np.zeros(2 * len(self._keys), np.int64)
        keys, values = np.array(list(steps), np.int64), np.array(list(steps.values()), np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = self._keys[slot] == -1
            at, first = np.unique(slot[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self._keys[at], self._next[at] = keys[chosen], values[chosen]
            left = np.ones(len(keys), bool)
            left[chosen] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & (len(self._keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(40)) & np.uint64(len(self._keys) - 1)).astype(np.int64)

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Next states; -1 where there is none."""
        keys = states << 21 | letters
        slot = self._slot(keys)
        held = self._keys[slot]
        out = np.where(held == keys, self._next[slot], -1)
        more = np.flatnonzero((held != keys) & (held != -1))
        while len(more):
            slot[more] = (slot[more] + 1) & (len(self._keys) - 1)
            held = self._keys[slot[more]]
            good = held == keys[more]
            out[more[good]] = self._next[slot[more[good]]]
            more = more[~good & (held != -1)]
        return out


@dataclass
class Lattice:
    """Vocabulary of a model: pieces with score, and bytes for what has no piece."""

    pieces: dict[str, tuple[int, float]]
    bytes_: list[int]
    longest: int
    unknown: float
    cut: re.Pattern
    trie: Trie
    raw: np.ndarray
    known: dict[str, Known] = field(default_factory=dict)
    searched: dict[tuple[str, int], list[Path]] = field(default_factory=dict)
    #: What the two remember, in characters.
    held: int = 0
    looked: int = 0

    @classmethod
    @functools.cache
    def load(cls, model_file: str) -> Lattice:
        """From a SentencePiece model with byte fallback; once per worker process."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces, bytes_ = {}, [0] * 256
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                bytes_[int(model.id_to_piece(i)[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[model.id_to_piece(i)] = (i, model.get_score(i))
        return cls.of(pieces, bytes_)

    @classmethod
    def of(cls, pieces: dict[str, tuple[int, float]], bytes_: list[int]) -> Lattice:
        joined = {c for p in pieces if len(p) > 1 for c in p}
        inner = "".join(re.escape(c) for c in sorted(joined - {SPACE}))
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            cut = re.compile(".+", re.DOTALL)
        else:  # spaces with the letters that follow, or a character that stands in no longer piece
            cut = re.compile(f"{SPACE}+[{inner}]*|[{inner}]+|." if inner else ".", re.DOTALL)
        least = min((s for _, s in pieces.values() if s > -1e8), default=0.0)
        raw = np.full(max([i for i, _ in pieces.values()] + bytes_, default=0) + 1, b"", object)
        for b, i in enumerate(bytes_):
            raw[i] = bytes((b,))
        for p, (i, _) in pieces.items():
            raw[i] = p.replace(SPACE, " ").encode()
        return cls(pieces, bytes_, max(map(len, pieces), default=1), least - UNKNOWN_COST, cut, Trie(pieces), raw)

    def chunks(self, text: str) -> list[str]:
        """Chunks of a text with its spaces marked and one more in front."""
        return self.cut.findall(SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)) if text else []

    def fallback(self, c: str) -> list[int]:
        """Byte ids of a character; the stand-in gives the mark itself."""
        return [self.bytes_[b] for b in (SPACE if c == LITERAL else c).encode("utf-8", "surrogatepass")]

    # -- the best segmentation of many chunks ------------------------------------------

    def learn(self, chunks: Iterable[str]) -> None:
        """Score the chunks that are not known yet, together."""
        if self.held > MEMORY:
            self.known.clear()
            self.held = 0
        fresh = [c for c in dict.fromkeys(chunks) if c not in self.known]
        fresh.sort(key=len)
        start = 0
        while start < len(fresh):
            size, end = 0, start
            while end < len(fresh) and (size == 0 or size + len(fresh[end]) <= SCORED):
                size += len(fresh[end])
                end += 1
            self._score(fresh[start:end])
            start = end

    def _arcs(self, text: str, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, length, id, score) of all arcs of the chunks laid end to end; id -1: bytes."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = self.trie.letter[codes]
        ends = np.repeat(np.cumsum(sizes), sizes)
        at, state = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        single = np.zeros(len(codes), bool)
        for length in range(1, self.longest + 1):
            state = self.trie.step(state, letters[at + length - 1])
            alive = state >= 0
            at, state = at[alive], state[alive]
            hit = self.trie.piece[state] >= 0
            if length == 1:
                single[at[hit]] = True
            found.append((at[hit], np.full(int(hit.sum()), length), self.trie.piece[state[hit]], self.trie.score[state[hit]]))
            room = at + length < ends[at]
            at, state = at[room], state[room]
            if not len(at):
                break
        lone = np.flatnonzero(~single)
        found.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), -1), np.full(len(lone), self.unknown)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _score(self, chunks: list[str]) -> None:
        sizes = np.array([len(c) for c in chunks])
        text = "".join(chunks)
        firsts = np.cumsum(sizes) - sizes
        chunk_of = np.repeat(np.arange(len(chunks)), sizes)
        start, length, piece, score = self._arcs(text, sizes)
        owner = chunk_of[start]
        tail, head = start + owner, start + length + owner  # nodes: one more than characters a chunk
        local = start + length - firsts[owner]
        forward, taken = self._best(tail, head, score, local, len(text) + len(chunks), firsts + np.arange(len(chunks)))
        last = firsts + sizes + np.arange(len(chunks))
        backward, _ = self._best(head, tail, score, sizes[owner] - (start - firsts[owner]), len(forward), last)
        best = forward[last]
        used = np.zeros(len(start), bool)
        node, which, steps = last.copy(), np.arange(len(chunks)), []
        while len(which):
            arc = taken[node]
            used[arc] = True
            steps.append((which, arc))
            node = tail[arc]
            more = node != firsts[which] + which
            node, which = node[more], which[more]
        loss = np.where(used, np.inf, best[owner] - (forward[tail] + score + backward[head]))
        second = np.full(len(chunks), np.inf)
        np.minimum.at(second, owner, loss)
        which, arcs = (np.concatenate(x[::-1]) for x in zip(*steps))
        order = np.argsort(which, kind="stable")
        which, arcs = which[order], arcs[order]
        cuts = np.searchsorted(which, np.arange(len(chunks) + 1)).tolist()
        ids = piece[arcs].astype(np.int32)
        packed = ids.tobytes()
        values = [packed[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:])]
        for i in np.unique(which[ids < 0]).tolist():
            wide: list[int] = []
            for arc in arcs[cuts[i] : cuts[i + 1]].tolist():
                wide += [int(piece[arc])] if piece[arc] >= 0 else self.fallback(text[start[arc]])
            values[i] = np.array(wide, np.int32).tobytes()
        self.known.update(zip(chunks, zip(best.tolist(), values, second.tolist())))
        self.held += sum(map(len, chunks)) + ENTRY * len(chunks)

    @staticmethod
    def _best(tail, head, score, column, nodes, roots) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over arcs in the order of their column: best score and arc to each node."""
        best, taken = np.full(nodes, -np.inf), np.full(nodes, -1)
        best[roots] = 0.0
        order = np.lexsort((head, column))
        column, head_, tail_, score_ = column[order], head[order], tail[order], score[order]
        cuts = np.searchsorted(column, np.arange(1, column[-1] + 2)) if len(column) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            to, value = head_[a:b], best[tail_[a:b]] + score_[a:b]
            new = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            most = np.maximum.reduceat(value, new)
            best[to[new]] = most
            top = np.flatnonzero(value == np.repeat(most, np.diff(np.append(new, len(to)))))[::-1]
            taken[to[top]] = order[a:b][top]  # the first of equals is written last
        return best, taken

    # -- the n best of one chunk -------------------------------------------------------

    def arcs_to(self, chunk: str, end: int) -> Iterator[tuple[int, tuple[int, ...], float]]:
        """(start, ids, score) of the arcs that end at a node."""
        single = False
        for start in range(max(0, end - self.longest), end):
            found = self.pieces.get(chunk[start:end])
            if found:
                single |= start == end - 1
                yield start, (found[0],), found[1]
        if not single:
            yield end - 1, tuple(self.fallback(chunk[end - 1])), self.unknown

    def forward(self, chunk: str) -> list[float]:
        """Best score from the start to every node."""
        best = [0.0] + [float("-inf")] * len(chunk)
        for end in range(1, len(chunk) + 1):
            best[end] = max(best[start] + score for start, _, score in self.arcs_to(chunk, end))
        return best

    def chunk_paths(self, chunk: str, n: int) -> list[Path]:
        """The n best segmentations of a chunk, best first."""
        found = self.searched.get((chunk, n))
        if found is None:
            if self.looked > MEMORY // 4:
                self.searched.clear()
                self.looked = 0
            found = self.searched[chunk, n] = self._search(chunk, n)
            self.looked += n * (len(chunk) + ENTRY)
        return found

    def _search(self, chunk: str, n: int) -> list[Path]:
        best, turn = self.forward(chunk), count()
        # (-(heuristic + walked), order of arrival, node, walked, arcs from here to the end)
        open_: list[tuple] = [(-best[-1], next(turn), len(chunk), 0.0, None)]
        out: list[Path] = []
        while open_ and len(out) < n:
            _, _, node, walked, arcs = heapq.heappop(open_)
            if node == 0:
                ids: list[int] = []
                while arcs:
                    ids += arcs[0]
                    arcs = arcs[1]
                out.append((walked, tuple(ids)))
                continue
            for start, arc, score in self.arcs_to(chunk, node):
                heapq.heappush(open_, (-(best[start] + walked + score), next(turn), start, walked + score, (arc, arcs)))
        return out

    # -- texts -------------------------------------------------------------------------

    def encode(self, text: str, n: int, parts: list[str] | None = None) -> tuple[float, np.ndarray, list[tuple[float, list[tuple[int, int, list[int]]]]]]:
        """(score, ids, others) of a text.

        Each of the up to n - 1 others is (score, edits): edits (at, length, ids) replace
        ``length`` of the best ids from ``at`` on. An empty text has no pieces and no others.
        ``parts``: the chunks of the text, if they have been learned.
        """
        if parts is None:
            parts = self.chunks(text)
            self.learn(parts)
        if not parts:
            return 0.0, np.zeros(0, np.int32), []
        scores, values, seconds = zip(*[self.known[c] for c in parts])
        ids = np.frombuffer(b"".join(values), np.int32)
        total = sum(scores)
        if n < 2:
            return total, ids, []
        lost = np.array(seconds)
        few = min(n - 1, len(parts))
        close = np.argpartition(lost, few - 1)[:few] if few < len(parts) else np.arange(len(parts))
        close = np.sort(close[np.isfinite(lost[close])])
        paths = {int(at): self._from_best(parts[at], values[at], n) for at in close}
        others = []
        for loss, chosen in combined({at: [p[0][0] - x[0] for x in p] for at, p in paths.items()}, n)[1:]:
            edits = [(sum(map(len, values[:at])) // 4, len(values[at]) // 4, list(paths[at][k][1])) for at, k in sorted(chosen.items())]
            others.append((total - loss, edits))
        return total, ids, others

    def _from_best(self, chunk: str, best: bytes, n: int) -> list[Path]:
        """The n best of a chunk, beginning with the given one of the equally good."""
        paths = self.chunk_paths(chunk, n)
        first = (paths[0][0], tuple(np.frombuffer(best, np.int32).tolist()))
        return [first, *[p for p in paths if p[1] != first[1]]][:n]

    def decode(self, ids: np.ndarray) -> str:
        """Text of a segmentation; the space put in front goes."""
        return b"".join(self.raw[ids].tolist()).decode("utf-8", "surrogatepass")[1:]


def in_portions(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about TOGETHER bytes of text."""
    sizes = np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    portion = (np.cumsum(sizes) - sizes) // TOGETHER
    cuts = [*np.flatnonzero(np.diff(portion, prepend=-1)).tolist(), batch.num_rows]
    for start, end in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(start, end - start)


def edited(ids: np.ndarray, edits: list) -> np.ndarray:
    """Ids of a segmentation given as edits of the best."""
    out, done = [], 0
    for at, length, own in edits:
        out += [ids[done:at], np.array(own, np.int32)]
        done = at + length
    return np.concatenate([*out, ids[done:]]).astype(np.int32)


def combined(losses: dict[int, list[float]], n: int) -> list[tuple[float, dict[int, int]]]:
    """The n cheapest choices of one segmentation a chunk: (loss, the choices that are not the best).

    A-star from the last chunk back: what is still to come costs nothing at best, and
    that is exact, since the best of every chunk loses nothing.
    """
    order = sorted(losses, reverse=True)
    turn = count()
    open_: list[tuple] = [(0.0, next(turn), (), 0)]
    out = []
    while open_ and len(out) < n:
        loss, _, chosen, done = heapq.heappop(open_)
        out.append((loss, dict(chosen)))
        for i in range(done, len(order)):
            for k, more in enumerate(losses[order[i]]):
                if k:
                    heapq.heappush(open_, (loss + more, next(turn), chosen + ((order[i], k),), i + 1))
    return out


ADDED = ("ids array<int>, score double, n_pieces bigint, "
         "others array<struct<score:double,edits:array<struct<at:int,length:int,ids:array<int>>>>>, round_trip boolean")


def encode_texts(docs: DataFrame, model_file: str, text: str = "text", n: int = 4) -> DataFrame:
    """All columns of ``docs`` but the text, with its n best segmentations.

    Added: ids (the best), score, n_pieces, others (the second to the n-th: score, and how
    the ids differ from the best; fewer where the lattice has fewer paths), round_trip
    (every one of them decodes to the text). Equal scores come in a fixed order. A null
    text has null in all of these; an empty one has no pieces and score 0. Columns of
    ``docs`` with an added name are left out; repeated rows are encoded alike.
    ``model_file`` is read by each worker; it must be installed where executors run.
    """
    names = ["ids", "score", "n_pieces", "others", "round_trip"]
    own = [c for c in docs.columns if c not in (text, "_text", *names)]
    picked = docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text}`").cast("string").alias("_text"))
    edit = pa.struct([("at", pa.int32()), ("length", pa.int32()), ("ids", pa.list_(pa.int32()))])
    kinds = [pa.float64(), pa.int64(), pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(edit))])), pa.bool_()]

    def one(lattice: Lattice, data: str | None, parts: list[str]) -> tuple:
        if data is None:
            return None, None, None, None, None
        score, ids, others = lattice.encode(data, n, parts)
        good = lattice.decode(ids) == data and all(
            lattice.decode(ids[a : a + size]) == lattice.decode(np.array(new, np.int32)) for _, edits in others for a, size, new in edits)
        shown = [{"score": s, "edits": [{"at": a, "length": z, "ids": x} for a, z, x in edits]} for s, edits in others]
        return ids, score, len(ids), shown, good

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice.load(model_file)
        for batch in batches:
            for part in in_portions(batch, len(own)):
                texts = part.column(len(own)).to_pylist()
                parts = [lattice.chunks(t) if t else [] for t in texts]
                lattice.learn(c for p in parts for c in p)
                first, *rest = zip(*(one(lattice, t, p) for t, p in zip(texts, parts)))
                ends = np.cumsum([0] + [0 if x is None else len(x) for x in first])
                flat = np.concatenate([x for x in first if x is not None] or [np.zeros(0, np.int32)])
                lists = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array([x is None for x in first]))
                columns = [lists, *(pa.array(c, k) for c, k in zip(rest, kinds))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[*own, *names])

    return picked.mapInArrow(run, widened(picked.drop("_text").schema, ADDED))


def decode_ids(encoded: DataFrame, model_file: str, ids: str = "ids") -> DataFrame:
    """All columns of ``encoded`` and ``text``, decoded from the ids; null for null ids."""
    own = [c for c in encoded.columns if c != "text"]
    picked = encoded.select(*[F.col(f"`{c}`") for c in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice.load(model_file)
        for batch in batches:
            texts = [None if x is None else lattice.decode(np.array(x, np.int32)) for x in batch.column(own.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*own, "text"])

    return picked.mapInArrow(run, widened(picked.schema, "text string"))
