"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of (role, text) to a string. To learn where each turn stands in its output, the
successive prefixes of a conversation are rendered and consecutive outputs compared: where the longer one continues the
shorter one, the rest is the new turn's span; where it doesn't, the template rewrites history and the turn is marked.
The text inside a span is found by rendering the same prefix with two probe texts that differ in their first and last
character: what both outputs share before and after them is the template's. The loss mask holds the text spans of the
assistant's turns.

Turns arrive sorted by conversation and are rendered in segments of SEGMENT turns, so memory and the work for a turn are
bounded however long a conversation is. A template must render a later segment as it would a conversation of its own,
after its opening, so it may look back over at most SEGMENT turns; the first two turns of each later segment are checked
against the turn before and the segment marked if not. Dependence on turns further back isn't seen.

Cases: a null conversation id is a conversation; null roles and texts are empty; equal turn numbers are ordered by role
and text, null turns come first, repeated rows are turns of their own; an empty table has no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossloom.llm.common import own_name

SEGMENT = 128
START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
MARK = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")
PROBES = ("\x02a\x03", "\x04b\x05")

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]


def escape(text: str) -> str:
    """No control string is left: < and | get a backslash more between them."""
    return MARK.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text) if "<\\" in text else text


def chatml(turns: list[Turn]) -> str:
    """The template of the query: ChatML marks around escaped roles and texts."""
    return "".join(f"{START}{escape(role).replace(chr(10), NEWLINE)}\n{escape(text)}{END}\n" for role, text in turns)


def parse_chatml(formatted: str) -> list[Turn]:
    """The turns, read back from chatml's output."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        head = formatted.index("\n", at)
        end = formatted.index(END, head)
        out.append((unescape(formatted[at + len(START) : head].replace(NEWLINE, "\n")), unescape(formatted[head + 1 : end])))
        at = end + len(END) + 1
    return out


def common_prefix(a: str, b: str) -> int:
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def common_suffix(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[-1 - n] == b[-1 - n]:
        n += 1
    return n


def render_turns(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int, int, int, bool]]]:
    """The output, and for each turn: start, end, text start, text end, and whether it rewrote what stood before."""
    before, spans = template([]) if turns else "", []
    for k, (role, _) in enumerate(turns):
        after = template(turns[: k + 1])
        start = common_prefix(before, after)
        rewrites = start < len(before)
        a, b = (template([*turns[:k], (role, p)]) for p in PROBES)
        head = common_prefix(a, b)
        tail = common_suffix(a[head:], b[head:])
        spans.append((start, len(after), head, max(head, len(after) - tail), rewrites))
        before = after
    return before, spans


def segments(rows: Iterator[tuple], size: int = SEGMENT) -> Iterator[tuple[object, int, list[Turn], bool]]:
    """From (conversation, role, text) in order: conversation, number of the segment's first turn, its turns, whether it is the last."""
    for conv, group in groupby(rows, key=lambda r: r[0]):
        held: list[Turn] = []
        first = 0
        for _, role, text in group:
            if len(held) == size:
                yield conv, first, held, False
                first, held = first + size, []
            held.append((role, text))
        yield conv, first, held, True


def continues(previous: Turn | None, turns: list[Turn], output: str, template: Template) -> bool:
    """Whether the segment's start renders the same after the turn before it."""
    if previous is None:
        return True
    head = turns[:2]
    alone, after = template(head), template([previous, *head])
    return after.startswith(template([previous])) and after.endswith(alone[len(template([])) :])


def plain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """By Arrow, which keeps ids as they are: in pandas a null would turn the ids of its batch into doubles."""
    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            yield conv, "" if role is None else role, "" if text is None else text


def with_kind(batches: Iterator[pa.RecordBatch]) -> tuple[Iterator[pa.RecordBatch], pa.DataType]:
    """The batches, and the type of their first column."""
    first = next(batches, None)
    return (iter(()), pa.null()) if first is None else (chain([first], batches), first.schema.field(0).type)


def record_batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), schema, strict=True)], names=[n for n, _ in schema])


def in_order(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Only these columns; each conversation in one partition, its turns in order."""
    picked = df.select(F.col(conv), F.col(turn), F.col(role), F.col(text))
    return picked.repartition(conv).sortWithinPartitions(F.col(conv).asc_nulls_first(), F.col(turn).asc_nulls_first(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first()).select(conv, role, text)


def format_turns(df: DataFrame, template: Template = chatml, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each turn: conversation, n (its number), piece (what the template adds for it), text_start and
    text_end in the piece, in_loss, rewrites_history. The pieces of a conversation, joined by n, are its output."""
    kind = dict(df.dtypes)[conv]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, id_type = with_kind(batches)
        schema = [("conv", id_type), ("n", pa.int64()), ("piece", pa.string()), ("text_start", pa.int32()), ("text_end", pa.int32()), ("in_loss", pa.bool_()), ("rewrites_history", pa.bool_())]
        last: tuple = (object(), None)
        for c, first, turns, _ in segments(plain_rows(batches)):
            output, spans = render_turns(turns, template)
            broken = not continues(last[1] if last[0] == c else None, turns, output, template)
            last = (c, turns[-1])
            yield record_batch([(c, first + k, output[a:b], x - a, y - a, turns[k][0] == "assistant", r or broken) for k, (a, b, x, y, r) in enumerate(spans)], schema)

    got = in_order(df, conv, turn, role, text).mapInArrow(run, f"conv {kind}, n long, piece string, text_start int, text_end int, in_loss boolean, rewrites_history boolean")
    return got.withColumnRenamed("conv", own_name(got, conv) if conv != "conv" else conv)


def format_digests(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation, of what is read back from chatml's output.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites_history.
    """
    kind = dict(df.dtypes)[conv]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, id_type = with_kind(batches)
        columns = [("conv_id", id_type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites_history", pa.bool_())]
        rows: list[tuple] = []
        state: dict = {}
        previous: Turn | None = None
        for c, first, turns, last in segments(plain_rows(batches)):
            if first == 0:
                state, previous = {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "rewrites": False}, None
            output, spans = render_turns(turns, chatml)
            state["rewrites"] |= any(s[4] for s in spans) or not continues(previous, turns, output, chatml)
            previous = turns[-1]
            for r, t in parse_chatml(output):
                state["turns"].update(f"{r}\n{t}\n".encode("utf-8", "surrogatepass"))
                state["n"] += 1
            for (r, _), (_, _, a, b, _) in zip(turns, spans, strict=True):
                if r == "assistant":
                    t = unescape(output[a:b])
                    state["loss"].update(t.encode("utf-8", "surrogatepass"))
                    state["loss_chars"] += len(t)
            state["chars"] += len(output)
            if last:
                rows.append((c, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["rewrites"]))
                if len(rows) >= 1000:
                    yield record_batch(rows, columns)
                    rows = []
        if rows:
            yield record_batch(rows, columns)

    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"
    return in_order(df, conv, turn, role, text).mapInArrow(run, schema)
