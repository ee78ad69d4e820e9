"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its context and only its reply is trainable.
Examples of a conversation are prefixes of one another, so format_examples() stores them by pieces: what a piece adds to
the one before (delta), the length of the prefix that it goes on from (context_chars), and whether an example closes with
it. The files grow with the input, not with the square of a conversation. expand() reads them as whole examples, one row
for each reply with its whole context, in a stream; digest() takes its figures from these whole examples.

The template marks the turns; control strings and backslashes inside texts get a backslash before them, which parse()
takes away again.

Results for odd input: a null text or role reads as empty; turns are ordered by turn (nulls first), then role and text,
so repeated rows and ties have one order; a null conv_id is a conversation of its own; turns after the last reply, and
conversations without a reply, close with a row without a loss span; empty tables give empty tables; other columns are not
read. A conversation of any length streams through one task, as the order of its turns and the digests of its contract
need; the task holds about FLUSH characters while formatting, and the conversation's text while reading whole examples.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

FLUSH = 1 << 20
CONTROL = re.compile(r"\\|</?s>|\[/?INST\]|<</?SYS>>|<</?ROLE>>|<<TEXT>>")
_ESCAPED = re.compile(r"\\(\\|</?s>|\[/?INST\]|<</?SYS>>|<</?ROLE>>|<<TEXT>>)")
_PIECES = re.compile(rf"{_ESCAPED.pattern}|(</?s>|\[/?INST\]|<</?SYS>>|<</?ROLE>>|<<TEXT>>)")

PIECES = "conv_id long, piece long, target_turn long, context_chars long, delta string, loss_start long, loss_end long, closes boolean"
EXAMPLES = "conv_id long, example long, target_turn long, text string, loss_start long, loss_end long"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and end of the text in it)."""
    head, tail = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}.get(role, (f"<<ROLE>>{escape(role)}<<TEXT>>", "<</ROLE>>"))
    own = escape(text)
    return head + own + tail, len(head), len(head) + len(own)


def parse(formatted: str, begin: int = 0) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of formatted turns, from a place between two turns on."""
    roles = {"<<SYS>>": "system", "[INST]": "user", "<s>": "assistant"}
    role, name = "", ""
    for m in _PIECES.finditer(formatted, begin):
        mark = m[2]
        if mark is None:
            continue
        if mark in roles:
            role, begin = roles[mark], m.end()
        elif mark == "<<ROLE>>":
            begin = m.end()
        elif mark == "<<TEXT>>":
            name, begin = unescape(formatted[begin : m.start()]), m.end()
        else:
            yield (name if mark == "<</ROLE>>" else role), unescape(formatted[begin : m.start()])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    held = 0
    conv: object = _format  # no conversation yet
    piece = context = size = 0
    delta: list[str] = []
    closed = True

    def close(turn: int | None, loss: tuple[int | None, int | None], closes: bool) -> None:
        nonlocal piece, context, size, held, closed
        whole = "".join(delta)
        out.append((conv, piece, turn, context, whole, *loss, closes))
        piece, context, size, held, closed = piece + 1, context + len(whole), 0, held + len(whole), closes
        delta.clear()

    def rest() -> None:
        if delta or not closed:
            close(None, (None, None), True)

    for batch in batches:
        for c, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if c != conv:
                rest()
                conv, piece, context, size, closed = c, 0, 0, 0, True
            shown, begin, end = render(role or "", text or "")
            base = context + size
            delta.append(shown)
            size += len(shown)
            closed = False
            if role == "assistant":
                close(turn, (base + begin, base + end), True)
            elif size > FLUSH:
                close(None, (None, None), False)
            if held > FLUSH or len(out) > 4096:
                yield _batch(out, PIECES)
                out, held = [], 0
    rest()
    if out:
        yield _batch(out, PIECES)


def format_examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The examples of all conversations, by pieces: a row closes an example of an assistant turn (target_turn, with its
    loss span in the whole example), or holds turns that no reply follows. One shuffle, of the turns by conversation."""
    t = turns.select(turns[conv_col].cast("long").alias("c"), turns[turn_col].cast("long").alias("t"), turns[role_col].alias("r"), turns[text_col].alias("x"))
    return t.repartition("c").sortWithinPartitions("c", "t", "r", "x").mapInArrow(_format, PIECES)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    conv: object = _expand
    example = held = 0
    whole = ""
    for batch in batches:
        for c, turn, context, delta, start, end, closes in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "target_turn", "context_chars", "delta", "loss_start", "loss_end", "closes")), strict=True):
            if c != conv:
                conv, example, whole = c, 0, ""
            if context != len(whole):
                raise ValueError(f"pieces of conversation {c} are missing")
            whole += delta
            if closes:
                out.append((c, example, turn, whole, start, end))
                example, held = example + 1, held + len(whole)
            if held > FLUSH or len(out) > 4096:
                yield _batch(out, EXAMPLES)
                out, held = [], 0
    if out:
        yield _batch(out, EXAMPLES)


def expand(pieces: DataFrame) -> DataFrame:
    """Whole examples from their pieces: one row for each assistant turn, all that came before it and its reply in text,
    and a last row without a loss span where turns follow the last reply. Sorted by conversation and example within a
    partition, which holds conversations whole."""
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_expand, EXAMPLES)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    conv: object = _digest
    turns = chars = shown = 0
    before = ""
    all_turns, loss = hashlib.sha256(), hashlib.sha256()

    def done() -> None:
        if conv is not _digest:
            out.append((conv, turns, all_turns.hexdigest(), chars, loss.hexdigest(), shown))

    for batch in batches:
        for c, example, start, end in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "text", "loss_start", "loss_end")), strict=True):
            if c != conv:
                done()
                conv, turns, chars, shown, before = c, 0, 0, 0, ""
                all_turns, loss = hashlib.sha256(), hashlib.sha256()
            if not example.startswith(before):
                raise ValueError(f"an example of conversation {c} does not go on from the one before")
            shown += len(example)
            for role, text in parse(example, len(before)):  # the turns before are those of the last example
                turns += 1
                all_turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if start is not None:
                learnt = unescape(example[start:end])
                chars += len(learnt)
                loss.update(learnt.encode("utf-8", "surrogatepass"))
            before = example
        if len(out) > 4096:
            yield _batch(out, DIGEST)
            out = []
    done()
    if out:
        yield _batch(out, DIGEST)


def digest(pieces: DataFrame) -> DataFrame:
    """Reads whole examples back: for each conversation its turns, the text under the loss mask, and the characters of
    all its examples, with a last one of the turns that no reply follows."""
    return expand(pieces).mapInArrow(_digest, DIGEST)


#: Turns that hold control strings themselves, to be formatted with a table as a probe.
PROBE = T.StructType([T.StructField(n, t) for n, t in (("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()))])
