"""Chat formatting with loss masks, by incremental rendering of a black-box template.

A template is any function from turns to one string. It is rendered for each prefix of
a conversation; what an output adds to the one before is the span of the last turn, and
an output that does not begin with the one before shows a template that rewrites
history. Inside a span the text is found by rendering the turn with two probe texts:
what both outputs share at the front and the back is the turn's frame.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import packed

#: (role, text) pairs.
Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

#: Strings that steer the model; none of them stands unescaped in a formatted text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[END]")
MARK = "\\"
_PLAIN = re.compile("|".join(f"({re.escape(c[0])})({re.escape(MARK)}*)({re.escape(c[1:])})" for c in CONTROL))
_TAKEN = re.compile("|".join(f"({re.escape(c[0])}){re.escape(MARK)}({re.escape(MARK)}*)({re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    """One more mark inside each control string, whatever marks it has; undone by ``unescape``."""
    return _PLAIN.sub(lambda m: _whole(m, MARK), text)


def unescape(text: str) -> str:
    """One mark less inside each marked control string."""
    return _TAKEN.sub(lambda m: _whole(m, ""), text)


def _whole(found: re.Match, mark: str) -> str:
    head, marks, tail = (x for x in found.groups() if x is not None)
    return head + mark + marks + tail


def render(turns: Turns) -> str:
    """The library's own template."""
    out = ["<s>"]
    for role, text in turns:
        body = escape(text)
        if role == "user":
            out.append(f"[INST] {body} [/INST]")
        elif role == "assistant":
            out.append(f" {body}</s>")
        elif role == "system":
            out.append(f"<<SYS>>{body}<</SYS>>")
        else:
            out.append(f"[ROLE]{escape(role)}[/ROLE]{body}[END]")
    return "".join(out)


_TURN = re.compile(
    r"\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>>(?P<system>.*?)<</SYS>>|"
    r"\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)\[END\]| (?P<assistant>.*?)</s>", re.DOTALL)


def parse(formatted: str) -> Turns:
    """Turns of an output of ``render``."""
    turns, at = [], len("<s>")
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        if found["role"] is not None:
            turns.append((unescape(found["role"]), unescape(found["other"])))
        else:
            turns.append(next((r, unescape(found[r])) for r in ("user", "system", "assistant") if found[r] is not None))
        at = found.end()
    return turns


@dataclass(frozen=True)
class Span:
    """A turn in the output: all of it, and its text. Positions are code points."""

    start: int
    end: int
    text_start: int
    text_end: int


class RewritesHistory(ValueError):
    """A later turn changed what had been rendered for earlier ones."""


#: Two private-use characters: texts that share no character.
PROBES = ("\ue000", "\ue001")


def _frame(template: Template, before: Turns, role: str) -> tuple[str, str, str]:
    """What the template puts before and after the text of a turn, and the output before it."""
    held = template(before) if before else ""
    one, two = (template([*before, (role, p)]) for p in PROBES)
    if not one.startswith(held) or not two.startswith(held):
        raise RewritesHistory(f"turn {len(before)}")
    one, two = one[len(held) :], two[len(held) :]
    head = next((i for i, (a, b) in enumerate(zip(one, two)) if a != b), len(one))
    back = next((i for i, (a, b) in enumerate(zip(one[::-1], two[::-1])) if a != b), len(one))
    return one[:head], one[len(one) - back :], held


def locate(template: Template, turns: Turns, carried: Turns = ()) -> tuple[str, list[Span]]:
    """Output added by ``turns`` after ``carried`` ones, and their spans in it.

    Raises ``RewritesHistory`` for a template that changes earlier output, and ValueError
    for one whose frame depends on the text.
    """
    before = list(carried)
    base = len(template(before)) if before else 0
    out, spans = "", []
    for role, text in turns:
        head, back, held = _frame(template, before, role)
        before.append((role, text))
        out = template(before)
        if not out.startswith(held):
            raise RewritesHistory(f"turn {len(before) - 1}")
        start, end = len(held) - base, len(out) - base
        if not out.startswith(head, len(held)) or not out.endswith(back) or end - start < len(head) + len(back):
            raise ValueError("the frame of a turn depends on its text")
        spans.append(Span(start, end, start + len(head), end - len(back)))
    return out[base:], spans


#: Turns rendered from one beginning; longer conversations go on from a carried context.
BLOCK = 32


def rendered(template: Template, turns: Turns, block: int = BLOCK) -> tuple[str, list[Span], bool]:
    """(output, spans, rewrites): the whole conversation by successive prefixes.

    Prefixes are rendered in blocks so that a conversation of n turns costs n * block
    turns and not n squared. A block goes on from the first turn and the last two of the
    block before. That is exact for a template that looks no further back; whether it
    does is seen from the whole output, which must equal the blocks put together. If it
    does not, every prefix is rendered in full.
    """
    whole = template(turns)
    if len(turns) > block:
        pieces, spans, done = [], [], 0
        for at in range(0, len(turns), block):
            carried = turns[:at] if at < 3 else [turns[0], *turns[at - 2 : at]]
            try:
                piece, own = locate(template, turns[at : at + block], carried)
            except ValueError:
                break
            pieces.append(piece)
            spans += [Span(*(p + done for p in (s.start, s.end, s.text_start, s.text_end))) for s in own]
            done += len(piece)
        if "".join(pieces) == whole and len(spans) == len(turns):
            return whole, spans, False
    try:
        out, spans = locate(template, turns)
    except RewritesHistory:
        return whole, [], True
    return out, spans, False


FORMATTED = pa.schema([
    ("conv", pa.int64()), ("formatted", pa.string()), ("rewrites_history", pa.bool_()),
    ("spans", pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                  ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_())]))),
])


def format_conversations(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    template: Template = render, learn: tuple[str, ...] = ("assistant",), block: int = BLOCK,
) -> DataFrame:
    """(id, formatted, rewrites_history, spans) per conversation.

    ``spans`` has role, start, end, text_start, text_end (code points) and loss for each
    turn; loss marks the texts of the roles in ``learn``. Turns are ordered by number
    (null first), then role and text; repeated rows are turns like any other. A null text
    or role is empty. Rows without an id form one conversation. A template that rewrites
    history gives its last output, no spans and no loss. One conversation is one sample
    and must fit a task; conversations are streamed one after another.
    """
    picked = rows.select(
        F.col(f"`{conv_id}`").cast("bigint").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = picked.repartition(n, "conv").sortWithinPartitions("conv", "turn", "role", "text")

    def one(conv: int | None, turns: Turns) -> tuple:
        out, spans, rewrites = rendered(template, turns, block)
        marks = [{"role": r, "start": s.start, "end": s.end, "text_start": s.text_start, "text_end": s.text_end,
                  "loss": r in learn} for (r, _), s in zip(turns, spans)]
        return conv, out, rewrites, marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, turns, held, size = None, [], [], 0
        for batch in batches:
            for conv, r, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if turns and conv != current:
                    held.append(one(current, turns))
                    size += len(held[-1][1])
                    turns = []
                    if size > 1 << 20:
                        yield packed(list(zip(*held)), FORMATTED)
                        held, size = [], 0
                current = conv
                turns.append((r, t))
        if turns:
            held.append(one(current, turns))
        if held:
            yield packed(list(zip(*held)), FORMATTED)

    span = "array<struct<role:string,start:bigint,end:bigint,text_start:bigint,text_end:bigint,loss:boolean>>"
    out = ordered.mapInArrow(run, f"conv bigint, formatted string, rewrites_history boolean, spans {span}")
    return out.withColumnRenamed("conv", conv_id)


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(formatted: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """What the formatted texts say, read back from them by ``parse`` and the loss spans."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, out, spans in zip(*(c.to_pylist() for c in batch.columns)):
                turns = parse(out)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                loss = "".join(unescape(out[s["text_start"] : s["text_end"]]) for s in spans if s["loss"])
                rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                             hashlib.sha256(loss.encode()).hexdigest(), len(out)))
            yield packed([list(c) for c in zip(*rows)] or [[]] * 6, DIGEST_ROWS)

    return formatted.select(F.col(f"`{conv_id}`").alias("conv_id"), "formatted", "spans").mapInArrow(run, DIGESTS)


DIGEST_ROWS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])
