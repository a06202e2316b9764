"""Repair of conversation structure by branch and bound.

A conversation is an optional system turn followed by pairs of user and assistant turns.
Each damaged one gets the cheapest edits that make it such a sequence: keep, give another
role, delete, insert an empty turn. The search is depth first with an explicit stack, in
the order of the edits' letters. Bounds on what the rest must cost cut branches against
the incumbent, and a table per node cuts prefixes that are no better than an earlier one;
when the stack is empty the incumbent is proved.

The search reads a few bytes a row: texts are judged where they lie and enter a shuffle
only once, to be put together with the edits found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import bounded_batches, rows_to_batches, text_bytes, written

BLANKS = " \t\n\x0b\x0c\r"
KEEP, INSERT, DELETE = 0, 2, 3
#: Positions in the sequence: nothing yet, after the system turn, after a user turn, after a pair.
NONE, SYSTEM, USER, PAIR = range(4)
#: Where a user or assistant turn leads from each of them.
NEXT = (USER, USER, PAIR, USER)
#: Where a kept row leads, by its initial; absent: it can't stand there.
KEPT = {
    "s": {NONE: SYSTEM},
    "u": {NONE: USER, SYSTEM: USER, PAIR: USER},
    "a": {USER: PAIR},
}
FAR = 1 << 60


def suffix_bounds(initials: list[str], faults: list[int]) -> np.ndarray:
    """(row, position) -> no completion from there costs less.

    The recursion runs backward over the rows and forgets that a conversation must end
    after a pair, so it is at most two inserted turns too low.
    """
    n = len(initials)
    out = np.zeros((n + 1, 4), np.int64)
    for i in range(n - 1, -1, -1):
        after, fault = out[i + 1].tolist(), faults[i]
        step = [x + DELETE for x in after]
        if fault < 2:
            to = KEPT.get(initials[i], {})
            for s in range(4):
                step[s] = min(step[s], INSERT + fault + after[NEXT[s]], fault + after[to[s]] if s in to else FAR)
        once = [min(step[s], INSERT + step[NEXT[s]]) for s in range(4)]
        out[i] = [min(step[s], INSERT + once[NEXT[s]]) for s in range(4)]
    return out


def moves(initial: str, fault: int, place: int) -> list[tuple[str, int, int, int]]:
    """(letter, rows taken, new position, cost) in the order of the letters; ``initial`` is empty past the last row.

    ``fault``: 0 none, 1 truncated, 2 blank or a duplicate.
    """
    insert = ("I", 0, NEXT[place], INSERT)
    if not initial:
        return [insert]
    out = [("D", 1, place, DELETE), insert]
    if fault < 2:
        to = KEPT.get(initial, {}).get(place)
        if to is not None:
            out.append(("K", 1, to, KEEP + fault))
        out.append(("R", 1, NEXT[place], INSERT + fault))
    return out


def _dive(initials: list[str], faults: list[int], bounds: np.ndarray) -> int:
    """Cost of the path that follows the bounds: the first incumbent."""
    at, place, cost = 0, NONE, 0
    while at < len(initials):
        _, taken, place, more = min(
            moves(initials[at], faults[at], place), key=lambda m: (m[3] + bounds[at + m[1], m[2]], m[0]))
        at, cost = at + taken, cost + more
    return cost + INSERT * {NONE: 0, PAIR: 0, USER: 1, SYSTEM: 2}[place]


def cheapest_edits(initials: list[str], faults: list[int]) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, the ASCII-least among equally cheap ones.

    Prefixes come off the stack in the order of their letters, so of two that reach a
    node at one cost the earlier is the lesser, and the later can go. Prefixes of one
    node and cost are never one the beginning of the other: that would take a free insert.
    """
    # any initial but s, u and a is a role that can't stay
    initials = [c or "?" for c in initials]
    n = len(initials)
    bounds = suffix_bounds(initials, faults)
    incumbent, audit = _dive(initials, faults, bounds), None
    reached = np.full((n + 1, 4), FAR, np.int64)
    #: (row, position, cost, letters so far as a chain back to the start)
    stack: list[tuple] = [(0, NONE, 0, None)]
    while stack:
        at, place, cost, chain = stack.pop()
        least = cost + bounds[at, place]
        # before the search has an audit of its own, equally cheap ones are still wanted
        if least > incumbent or (least == incumbent and audit is not None) or cost >= reached[at, place]:
            continue
        reached[at, place] = cost
        if at == n and place in (NONE, PAIR):
            incumbent, audit = cost, chain
            continue
        options = moves(initials[at] if at < n else "", faults[at] if at < n else 0, place)
        for letter, taken, to, more in reversed(options):
            stack.append((at + taken, to, cost + more, (letter, chain)))
    letters = []
    while audit is not None:
        letters.append(audit[0])
        audit = audit[1]
    return int(incumbent), "".join(reversed(letters))


# -- rows -----------------------------------------------------------------------------------


def signs(rows: DataFrame, conv: str, turn: str, role: str, text: str, alive: Column) -> DataFrame:
    """Rows with what the search needs of them, judged without moving their texts."""
    ends = F.rtrim("_text", F.lit(BLANKS))
    named = rows.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("_text"), alive.alias("alive"))
    said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("_text"))
    return named.select(
        "conv", "alive", "turn", "role", F.unhex(F.sha2(said, 256)).alias("mark"), (ends == "").alias("blank"),
        (~F.substring(ends, -1, 1).isin(".", "!", "?")).alias("cut"), F.col("_text").alias("text"))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """The rows of a conversation side by side: by turn (null first), then role and a digest of role and text."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "conv").sortWithinPartitions("conv", *first, F.col("turn").asc_nulls_first(), "role", "mark")


#: Of a conversation: turns missing between the first and the last, faults, wrong neighbours, edits.
FOUND = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def repairs(signed: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation.

    A row's first fault counts: blank, duplicate (role and text seen earlier), truncated
    (not ended by ``.``, ``!`` or ``?``). Rows that are not ``alive`` only name their
    conversation. A task holds about 100 bytes for each turn of one conversation.
    """
    rows = _in_order(signed.select("conv", "alive", "turn", "role", "mark", "blank", "cut"))
    schema = signed.select("conv", *[F.lit(0).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                           F.lit("").alias("audit")).schema

    def one(rows_: Iterator[tuple]) -> tuple:
        initials, faults, seen = [], [], set()
        kinds = {"blank": 0, "duplicate": 0, "truncated": 0}
        turns, first, last, illegal = 0, None, None, 0
        for alive, turn, role, mark, blank, cut in rows_:
            if not alive:
                continue
            fault = "blank" if blank else "duplicate" if mark in seen else "truncated" if cut else None
            seen.add(mark)
            if fault:
                kinds[fault] += 1
            if turn is not None and turn != last:
                turns, first, last = turns + 1, turn if first is None else first, turn
            if initials and initials[-1] + role[:1] not in ("su", "ua", "au"):
                illegal += 1
            initials.append(role[:1])
            faults.append(0 if fault is None else 1 if fault == "truncated" else 2)
        gaps = last - first + 1 - turns if turns else 0
        return gaps, *kinds.values(), illegal, *cheapest_edits(initials, faults)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.Schema] = []

        def results() -> Iterator[tuple]:
            for conv, rows_ in _groups(batches, kinds, [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
                                                        ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
                                                        ("audit", pa.string())]):
                yield conv, *one(rows_)

        yield from _typed(results(), kinds)

    return rows.mapInArrow(run, schema)


def _groups(batches: Iterator[pa.RecordBatch], kinds: list, added: list) -> Iterator[tuple]:
    """(conversation, its rows) one after the other; rows are read as they come, never all at once."""
    def stream() -> Iterator[tuple]:
        for batch in batches:
            if not kinds:
                kinds.append(pa.schema([("conv", batch.schema.field(0).type), *added]))
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                yield from zip(*(c.to_pylist() for c in part.columns))

    rows = stream()
    held = next(rows, None)

    def own(conv) -> Iterator[tuple]:
        nonlocal held
        while held is not None and held[0] == conv:
            yield held[1:]
            held = next(rows, None)

    while held is not None:
        conv = held[0]
        group = own(conv)
        yield conv, group
        for _ in group:  # what the caller left
            pass


def _typed(rows: Iterator[tuple], kinds: list) -> Iterator[pa.RecordBatch]:
    """Rows as record batches, once the first row has told the schema."""
    for first in rows:
        def all_rows():
            yield first
            yield from rows
        yield from rows_to_batches(all_rows(), kinds[0], 1000)


def _edited(audit: str, rows: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, str, bytes]]:
    """(edit, role, text) of the repaired conversation."""
    place = NONE
    for letter in audit:
        if letter == "I":
            role, text = ("assistant" if place == USER else "user"), b""
        else:
            role, text = next(rows)
        if letter == "D":
            continue
        if letter == "R":
            role = "assistant" if place == USER else "user"
        place = KEPT[role[:1]][place] if letter == "K" else NEXT[place]
        yield letter, role, text


def _with_edits(signed: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's edits, then its rows with their texts."""
    none = {f: F.lit(None).cast(t) for f, t in found.dtypes if f != "conv"}
    own = signed.where("alive").select(
        "conv", F.lit(1).alias("kind"), "turn", "role", "mark", text_bytes("text").alias("text"), *[c.alias(f) for f, c in none.items()])
    marks = found.select(
        "conv", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"),
        F.lit(None).cast("binary").alias("mark"), F.lit(None).cast("binary").alias("text"), *none)
    return _in_order(own.unionByName(marks), "kind")


def repaired_rows(signed: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: (conv, at, edit, role, text), at counting from 0."""
    schema = signed.select("conv", F.lit(0).cast("bigint").alias("at"), F.lit("").alias("edit"), F.lit("").alias("role"),
                           F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.Schema] = []

        def results() -> Iterator[tuple]:
            for conv, rows in _groups(batches, kinds, [("at", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]):
                audit = next(rows)[-1]
                for at, (edit, role, text) in enumerate(_edited(audit, ((r[2], r[4]) for r in rows))):
                    yield conv, at, edit, role, text.decode()

        yield from _typed(results(), kinds)

    return _with_edits(signed, found).mapInArrow(run, schema)


def repair_digests(signed: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with repaired_sha256: of the lines ``role:text`` of the repaired conversation, joined by newlines."""
    schema = found.select("*", F.lit("").alias("repaired_sha256")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.Schema] = []
        added = [*[(f, pa.int64()) for f in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                 ("audit", pa.string()), ("repaired_sha256", pa.string())]

        def results() -> Iterator[tuple]:
            for conv, rows in _groups(batches, kinds, added):
                told = next(rows)[5:]
                digest, between = hashlib.sha256(), b""
                for _, role, text in _edited(told[-1], ((r[2], r[4]) for r in rows)):
                    digest.update(between + role.encode() + b":")
                    digest.update(text)
                    between = b"\n"
                yield conv, *told, digest.hexdigest()

        yield from _typed(results(), kinds)

    return _with_edits(signed, found).mapInArrow(run, schema)


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    alive: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(signed rows, repairs) of conversations, for ``repaired_rows`` and ``repair_digests``.

    Null roles and texts count as one space: such a text is blank, such a role can't stay.
    Rows are taken by turn, null first; rows of one turn by role, then by a digest of role
    and text. Repeated rows are duplicates of the first. Null conversation ids are one
    conversation. A conversation without a row that is ``alive`` has zeros and an empty
    audit; an empty table gives no rows. Other columns are not read.
    """
    bounded_batches(rows.sparkSession)
    signed = signs(rows, conv, turn, role, text, F.lit(True) if alive is None else alive)
    return signed, written(repairs(signed), "repairs")


def damage(rows: DataFrame) -> DataFrame:
    """Conversation rows with faults planted by crc32 of ``conv_id:turn`` modulo 20; ``alive`` is false for dropped rows.

    0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    own = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"),
                      F.coalesce(F.col("text").cast("string"), space).alias("text"), kind.alias("kind"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return own.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("alive"), F.explode(times).alias("copy")).drop("copy")
