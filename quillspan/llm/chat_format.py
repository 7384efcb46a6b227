"""Chat formatting by incremental black-box rendering.

A template is a function from turns to one string that nothing else is known about. Rendering one turn more each time
and comparing the output with the one before shows what that turn added: its span. If the output before is not a prefix
of the new one, the template has rewritten history; that is reported with the position of the first change.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# The control strings of the bracket template, and the mark that takes one apart.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]")
ESCAPE = "\\"


def escape(text: str) -> str:
    """The text with no control string in it; ``unescape`` gives the text back."""
    text = text.replace(ESCAPE, ESCAPE + ESCAPE)
    for c in CONTROLS:
        text = text.replace(c, c[0] + ESCAPE + c[1:])
    return text


def unescape(text: str) -> str:
    if ESCAPE not in text:
        return text
    out, at = [], 0
    while (i := text.find(ESCAPE, at)) >= 0:
        out += [text[at:i], text[i + 1 : i + 2]]
        at = i + 2
    return "".join([*out, text[at:]])


def bracket_template(turns: list[Turn]) -> str:
    """User turns in [INST], system turns in [SYS], assistant turns bare up to </s>, other roles named in [ROLE]."""
    out = []
    for role, text in turns:
        text = escape(text)
        if role == "user":
            out.append(f"<s>[INST] {text} [/INST]")
        elif role == "assistant":
            out.append(f" {text}</s>")
        elif role == "system":
            out.append(f"[SYS] {text} [/SYS]")
        else:
            out.append(f"[ROLE]{escape(role)}[/ROLE] {text}</s>")
    return "".join(out)


def read_turn(piece: str) -> tuple[str, str, int, int]:
    """Role, text, and where the escaped text begins and ends, of one turn of the bracket template."""
    for head, role, tail in (("<s>[INST] ", "user", " [/INST]"), ("[SYS] ", "system", " [/SYS]"), (" ", "assistant", "</s>")):
        if piece.startswith(head) and piece.endswith(tail):
            a, b = len(head), len(piece) - len(tail)
            return role, unescape(piece[a:b]), a, b
    end = piece.index("[/ROLE] ")
    a, b = end + len("[/ROLE] "), len(piece) - len("</s>")
    return unescape(piece[len("[ROLE]") : end]), unescape(piece[a:b]), a, b


@dataclass
class Piece:
    """What a turn added to the rendered conversation, and where."""

    turn: int
    role: str
    start: int
    text: str
    #: First position at which the turn changed what stood before; None if nothing did.
    rewrites_at: int | None


def _pieces(template: Template, turns: Iterable[Turn], before: str = "", first: int = 0, held: list[Turn] | None = None) -> Iterator[Piece]:
    """Pieces by full prefixes, from turn ``first`` on, after ``held`` turns that gave ``before``."""
    held = [] if held is None else held
    for n, turn in enumerate(turns, first):
        held.append(turn)
        after = template(held)
        same = len(before) if after.startswith(before) else len(commonprefix([before, after]))
        yield Piece(n, turn[0], same, after[same:], None if same == len(before) else same)
        before = after


def render_incrementally(template: Template, turns: Iterable[Turn], window: int | None = None) -> Iterator[Piece]:
    """Each turn's piece, from the outputs for successive prefixes.

    Without ``window`` every prefix is rendered from the first turn on, which is right for any template and costs the
    square of the conversation. ``window`` renders prefixes of at most that many turns and then begins again from the
    last one, which is right only if the template's output for a turn depends on little before it. That is not taken on trust:
    a new beginning must give the end of what stood before, and at every power of two turns and at the end the pieces must make up
    the whole prefix rendered at once. Pieces are given out once they are proved; where either fails, the turns since the last proof,
    and all that follow, are rendered by full prefixes. What a window cannot show is history that is rewritten and put back between two proofs.
    Either way a conversation's turns are held.
    """
    turns = iter(turns)
    if not window:
        yield from _pieces(template, turns)
        return
    every: list[Turn] = []
    whole = ""  # the last proved output
    proved, waiting = 0, []
    held: list[Turn] = []
    before, base = "", 0  # base: where the rendering of ``held`` begins

    def right() -> bool:
        nonlocal whole
        full = template(every)
        if any(p.rewrites_at is not None for p in waiting) or whole + "".join(p.text for p in waiting) != full:
            return False
        whole = full
        return True

    for turn in turns:
        every.append(turn)
        good = True
        if len(held) >= window:
            again = template(held[-1:])
            good = before.endswith(again)
            base += len(before) - len(again)
            held, before = held[-1:], again
        if good:
            held.append(turn)
            after = template(held)
            same = len(before) if after.startswith(before) else len(commonprefix([before, after]))
            waiting.append(Piece(len(every) - 1, turn[0], base + same, after[same:], None if same == len(before) else base + same))
            before = after
        if len(every) & (len(every) - 1) == 0 or not good:
            if not (good and right()):
                yield from _pieces(template, chain(every[proved:], turns), whole, proved, every[:proved])
                return
            yield from waiting
            proved, waiting = len(every), []
    if waiting:
        if right():
            yield from waiting
        else:
            yield from _pieces(template, every[proved:], whole, proved, every[:proved])


def _render(template: Template, window: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int | None, Turn]]:
            for batch in batches:
                yield from zip(batch.column("conv_id").to_pylist(), zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True), strict=True)

        out: list[tuple] = []
        size = 0
        for conv, turns in groupby(rows(), key=lambda r: r[0]):
            for p in render_incrementally(template, (t for _, t in turns), window):
                out.append((conv, p.turn, p.role, p.start, p.start + len(p.text), p.text, p.rewrites_at))
                size += len(p.text)
                if len(out) >= 2000 or size > 4_000_000:
                    yield _batch(out)
                    out, size = [], 0
        yield _batch(out)

    return run


_TYPES = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("piece", pa.string()), ("rewrites_at", pa.int64())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _TYPES, strict=True)], [n for n, _ in _TYPES])


def format_chats(turns: DataFrame, template: Template = bracket_template, window: int | None = None) -> DataFrame:
    """``turns`` (conv_id, turn, role, text, ...) to a row for each turn: (conv_id, turn, role, start, end, piece, rewrites_at).

    Turns are taken by (turn, role, text), so ties have an order; ``turn`` counts them from 0. start and end are code
    points in the formatted conversation, which is its pieces in a row. A null role or text is empty; a null conv_id is
    a conversation of its own; repeated rows are turns of their own; other columns are not read; an empty table gives no rows. Rows of a
    conversation stay together and in order within a partition: they are sorted and streamed. Every prefix is rendered in
    full; ``window`` spares that, proved against full prefixes as ``render_incrementally`` says. A text or conversation of any length is
    rendered whole.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_render(template, window), "conv_id long, turn long, role string, start long, end long, piece string, rewrites_at long")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the pieces say, read back: rows of a conversation come in order."""

    def rows() -> Iterator[tuple[int | None, str]]:
        for batch in batches:
            yield from zip(batch.column("conv_id").to_pylist(), batch.column("piece").to_pylist(), strict=True)

    out: list[tuple] = []
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for conv, pieces in groupby(rows(), key=lambda r: r[0]):
        turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for _, piece in pieces:
            role, text, a, b = read_turn(piece)
            turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == "assistant":  # the loss mask: the escaped text's characters of assistant turns
                masked = unescape(piece[a:b])
                loss.update(masked.encode("utf-8", "surrogatepass"))
                loss_chars += len(masked)
            n += 1
            chars += len(piece)
        out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        if len(out) >= 2000:
            yield batch()
            out = []
    yield batch()


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation of ``format_chats`` with the bracket template, read back from its pieces.

    A row for each conversation, in which a null text is empty and repeated rows are turns of their own; a null conv_id
    is a conversation; texts of any length are read whole; an empty table gives no rows. Needs the order that ``format_chats`` gives.
    """
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
