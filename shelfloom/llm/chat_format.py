"""Chat formatting around any template, seen only through what it renders.

``Template`` is a function of a list of turns (role, text) to a string. Successive
prefixes of a conversation are rendered; where each output starts with the one
before, the rest is the span of the new turn. Where it doesn't, the template has
rewritten history; the conversation is flagged with the first such turn, and its
spans come from marked renderings of the whole. A turn's text is located inside
its span by rendering the turn once more with a marker for its text.

A turn whose text can't be placed that way is flagged too, and has no text span.

A conversation is rendered once for each prefix, which is the method: its work
grows with the square of the number of its turns. A conversation is sorted into
one task and its rows are held there; other conversations are not. Rows without a
conversation's id are not gathered: each is a conversation of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.llm import arrow

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Stands for the text of a turn in a marked rendering; a private character, doubled when texts hold it.
_MARK = "\ue000"

_SPANS = "array<struct<turn:int,role:string,`start`:int,`end`:int,text_start:int,text_end:int,loss:boolean,located:boolean>>"
_SPANS_ARROW = pa.list_(pa.struct([("turn", pa.int32()), ("role", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text_start", pa.int32()), ("text_end", pa.int32()), ("loss", pa.bool_()), ("located", pa.bool_())]))

#: The strings by which the template below marks turns.
OPEN, ROLE_END, CLOSE = "### ", ": ", " </turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_CONTROL_OR_COLON = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")


def escape(text: str) -> str:
    """A backslash before every control string and backslash; ``unescape`` undoes it."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_template(turns: list[Turn]) -> str:
    """``### role: text </turn>`` and a line break for each turn, with control strings escaped."""
    return "".join(OPEN + _CONTROL_OR_COLON.sub(lambda m: "\\" + m[0], role) + ROLE_END + escape(text) + CLOSE for role, text in turns)


_ROLE_TOKEN = re.compile(r"\\(?:\\|###|</turn>|:)|: |\\")
_TEXT_TOKEN = re.compile(r"\\(?:\\|###|</turn>)| </turn>\n|###|</turn>|\\")


def _upto(formatted: str, at: int, tokens: re.Pattern, end: str) -> int:
    """Where the first ``end`` that no backslash escapes is."""
    for m in tokens.finditer(formatted, at):
        if m[0] == end:
            return m.start()
        if len(m[0]) == 1 or m[0][0] != "\\":
            break
    raise ValueError(f"no turn at {at}")


def read_turns(formatted: str) -> list[Turn]:
    """The turns that ``turn_template`` was given, from its output alone."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        role = at + len(OPEN)
        role_end = _upto(formatted, role, _ROLE_TOKEN, ROLE_END)
        text = role_end + len(ROLE_END)
        text_end = _upto(formatted, text, _TEXT_TOKEN, CLOSE)
        turns.append((unescape(formatted[role:role_end]), unescape(formatted[text:text_end])))
        at = text_end + len(CLOSE)
    return turns


def _text_span(template: Template, turns: list[Turn], i: int, out: str) -> tuple[int, int] | None:
    """Where the rendering of ``turns`` has the text of turn ``i``; None if it can't be told."""
    mark = _MARK
    while mark in out:
        mark += _MARK
    marked = template([*turns[:i], (turns[i][0], mark), *turns[i + 1 :]])
    at = marked.find(mark)
    tail = len(marked) - at - len(mark)
    if at < 0 or marked.find(mark, at + 1) >= 0 or len(out) < at + tail or out[:at] != marked[:at] or out[len(out) - tail :] != marked[at + len(mark) :]:
        return None
    return at, len(out) - tail


def format_turns(template: Template, turns: list[Turn], learn: frozenset[str] = frozenset({"assistant"})) -> tuple[str, list[dict], int]:
    """(output, spans, the first turn that rewrote history or -1).

    A span whose text can't be placed has ``located`` false and an empty text span at its start.
    """
    before, spans, rewrote = "", [], -1
    for i in range(len(turns)):
        out = template(turns[: i + 1])
        if rewrote < 0 and not out.startswith(before):
            rewrote = i
        found = _text_span(template, turns[: i + 1], i, out)
        start, end = found or (len(before), len(before))
        spans.append({"turn": i, "role": turns[i][0], "start": len(before), "end": len(out), "text_start": start, "text_end": end, "loss": turns[i][0] in learn, "located": found is not None})
        before = out
    if rewrote >= 0:
        at = 0
        for i, span in enumerate(spans):
            found = _text_span(template, turns, i, before)
            start, end = found or (at, at)
            span |= {"text_start": start, "text_end": end, "start": at, "end": max(at, end), "located": found is not None}
            at = span["end"]
        spans[-1]["end"] = len(before)
    return before, spans, rewrote


def _format(template: Template, learn: frozenset[str]):
    def batch(done: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), _SPANS_ARROW, pa.bool_(), pa.int32(), pa.int64())
        names = ("conv_id", "n_turns", "formatted", "spans", "rewrites_history", "first_rewrite", "n_unlocated")
        return arrow.made({n: ([r[i] for r in done], t) for i, (n, t) in enumerate(zip(names, types, strict=True))})

    def one(conv: int | None, turns: list[Turn]) -> tuple:
        out, spans, rewrote = format_turns(template, turns, learn)
        return conv, len(turns), out, spans, rewrote >= 0, rewrote, sum(not s["located"] for s in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, done, size = None, [], [], 0
        for rows in arrow.parts(batches, 2_000):
            for key, role, text in zip(*arrow.values(rows, "conv_id", "role", "text"), strict=True):
                if turns and (key is None or key != conv):
                    done.append(one(conv, turns))
                    size += len(done[-1][2])
                    turns = []
                    if len(done) >= 500 or size > 16_000_000:
                        yield batch(done)
                        done, size = [], 0
                conv = key
                turns.append((role or "", text or ""))
        if turns:
            done.append(one(conv, turns))
        if done:
            yield batch(done)

    return run


def format_conversations(rows: DataFrame, template: Template = turn_template, learn: frozenset[str] = frozenset({"assistant"})) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) to one row for each conversation.

    (conv_id, n_turns, formatted, spans, rewrites_history, first_rewrite,
    n_unlocated: turns whose text has no span). Turns go by turn, then role and
    text, nulls first; a repeated row is a repeated turn. A null role or text is
    empty; each row with a null conv_id is a conversation of one turn with a null
    id, so that such rows are spread over all tasks. Other columns are ignored; an
    empty table gives no rows.
    """
    own = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("alone", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")))
    own = own.repartition("conv_id", "alone").sortWithinPartitions("conv_id", "turn", "role", "text").drop("alone")
    return own.mapInArrow(_format(template, learn), f"conv_id bigint, n_turns bigint, formatted string, spans {_SPANS}, rewrites_history boolean, first_rewrite int, n_unlocated bigint")
