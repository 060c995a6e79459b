"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to one string. Successive prefixes of the turns are rendered and
consecutive outputs compared: what was added is the new turn's span. Where an output does not begin with the one
before, the template rewrites history; then spans are located in the final output alone. Where a turn's text lies
within is found by rendering it once more with a probe in its place, and so is where its role is printed.

Defined results: a null text or role is empty; turns sort by turn, then role and text, nulls first; repeated rows are
turns of their own; a null conv_id is a conversation; an empty table has none. What a template does with a turn may depend
on all others, so a conversation is rendered as a whole, prefix by prefix, in one task: its work grows with the square of
its length, its memory with the length. A turn whose text the template alters or drops has no text span and is no loss; a
conversation with such a turn, or with a role that neither its print nor its markup tells, has null digests when read back. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]

_CONTROL = re.compile(r"\\|</?s>|\[/?(?:INST|ROLE)|<</?SYS>>|<\|im_(?:start|end)\|>")
_ESCAPED = re.compile(r"\\(\\|u003c|u005b)")
_OPEN = {"\\": "\\\\", "<": "\\u003c", "[": "\\u005b"}
_BACK = {"\\": "\\", "u003c": "<", "u005b": "["}


def escape(text: str) -> str:
    """Backslashes doubled, and the first character of each control string written as \\u003c or \\u005b."""
    return _CONTROL.sub(lambda m: _OPEN[m[0][0]] + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


def inst(turns: Turns) -> str:
    """Instruction markup: [INST] for users, </s> after assistants, <<SYS>> for systems, [ROLE] for any other."""
    shape = {"user": "<s>[INST] {} [/INST]", "assistant": " {} </s>", "system": "<<SYS>>\n{}\n<</SYS>>\n"}
    out = []
    for role, text in turns:
        head, tail = shape[role].split("{}") if role in shape else (f"<s>[ROLE {role}] ", " [/ROLE]")
        out.append(head + text + tail)
    return "".join(out)


def chatml(turns: Turns) -> str:
    return "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in turns)


def last_answer_only(turns: Turns) -> str:
    """A template that rewrites history: earlier assistant texts lose what stands before their last blank line."""
    last = len(turns) - 1
    return chatml([(r, t.rpartition("\n\n")[2] if r == "assistant" and i < last else t) for i, (r, t) in enumerate(turns)])


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


ROLE, TEXT = 0, 1


def _probe(out: str) -> str:
    probe = "\ue000"
    while probe in out:
        probe += "\ue001"
    return probe


def _within(render: Callable[[Turns], str], turns: Turns, at: int, out: str, part: int = TEXT) -> tuple[int, int] | None:
    """Where turn `at`'s text (or role) stands in `out`, the rendering of `turns`; None if the template alters, drops or repeats it."""
    probe, (role, text) = _probe(out), turns[at]
    seen = render([*turns[:at], (role, probe) if part == TEXT else (probe, text), *turns[at + 1 :]])
    text = turns[at][part]
    start = seen.find(probe)
    if start < 0 or seen[:start] + text + seen[start + len(probe) :] != out:
        return None
    return start, start + len(text)


def locate(render: Callable[[Turns], str], turns: Turns) -> tuple[str, list[tuple[int, int, tuple[int, int] | None]], int | None]:
    """(output, a (start, end, text span) per turn, the first turn that rewrites history or None)."""
    out, spans, rewrites = render([]), [], None
    for k in range(len(turns)):
        before, out = out, render(turns[: k + 1])
        start = len(before)
        if not out.startswith(before):
            rewrites = k if rewrites is None else rewrites
            start = _shared(before, out)
        spans.append((start, len(out), _within(render, turns[: k + 1], k, out) if rewrites is None else None))
    if rewrites is not None:
        inner = [_within(render, turns, k, out) for k in range(len(turns))]
        spans = [(s, e, w) for (s, e, _), w in zip(spans, inner, strict=True)]
    return out, spans, rewrites


def role_spans(render: Callable[[Turns], str], turns: Turns, out: str, spans: list[tuple[int, int, tuple[int, int] | None]], rewrites: int | None) -> list[tuple[int, int] | None]:
    """Where each turn's role is printed in `out`; None where the template shows it by markup alone."""
    found = []
    for k, (start, stop, inner) in enumerate(spans):
        role = turns[k][ROLE]
        if rewrites is not None:
            found.append(_within(render, turns, k, out, ROLE))
        elif inner and (role in out[start : inner[0]] or role in out[inner[1] : stop]):
            found.append(_within(render, turns[: k + 1], k, out[:stop], ROLE))
        else:
            found.append(None)
    return found


#: Roles that a template may show by markup alone.
ROLES = ("user", "assistant", "system")


def legend(render: Callable[[Turns], str]) -> dict[tuple[str, str], str | None]:
    """What a template puts before and after a text, for a first turn and for one after another, to its role; None where two
    roles look the same. Found by rendering turns of the ROLES."""
    shown: dict[tuple[str, str], str | None] = {}
    for turns in [[(r, "x")] for r in ROLES] + [[(a, "x"), (b, "x")] for a in ROLES for b in ROLES]:
        out, spans, rewrites = locate(render, turns)
        start, stop, inner = spans[-1]
        if rewrites is None and inner:
            around = out[start : inner[0]], out[inner[1] : stop]
            role = turns[-1][ROLE]
            shown[around] = role if shown.get(around, role) == role else None
    return shown


FORMATTED = "conv_id long, formatted string, rewrites_at int, spans array<struct<role:string,start:long,stop:long,role_start:long,role_stop:long,text_start:long,text_stop:long,loss:boolean>>"
_SPANS = pa.list_(pa.struct([("role", pa.string()), *[(f, pa.int64()) for f in ("start", "stop", "role_start", "role_stop", "text_start", "text_stop")], ("loss", pa.bool_())]))
_SCHEMA = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("rewrites_at", pa.int32()), ("spans", _SPANS)])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def format_conversations(conversations: DataFrame, template: Callable[[Turns], str] = inst) -> DataFrame:
    """A row per conversation, columns as in FORMATTED; loss marks assistant turns, whose text span is the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, turns in groupby(_rows(batches), key=lambda r: r[0]):
            turns = [(escape(role or ""), escape(text or "")) for *_, role, text in turns]
            out, spans, rewrites = locate(template, turns)
            rows = []
            for (role, _), (s, e, w), at in zip(turns, spans, role_spans(template, turns, out, spans, rewrites), strict=True):
                (r0, r1), (t0, t1) = at or (None, None), w or (None, None)
                rows.append({"role": role, "start": s, "stop": e, "role_start": r0, "role_stop": r1, "text_start": t0, "text_stop": t1, "loss": role == "assistant" and w is not None})
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "formatted": out, "rewrites_at": rewrites, "spans": rows}], schema=_SCHEMA)

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame, template: Callable[[Turns], str] = inst) -> DataFrame:
    """Digests of each conversation, read from its formatted text by the places of the spans: a role where it is printed, else
    by the markup around its text, as `template` marks the ROLES. Turns are the spans that take up any of the text."""
    marks = legend(template)

    def of(conv: int | None, out: str, spans: list[dict]) -> list:
        spans = [x for x in spans if x["stop"] > x["start"]]
        turns, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
        for x in spans:
            if x["text_start"] is None:
                return [conv, len(spans), None, None, None, len(out)]
            if x["role_start"] is None:
                role = marks.get((out[x["start"] : x["text_start"]], out[x["text_stop"] : x["stop"]]))
            else:
                role = unescape(out[x["role_start"] : x["role_stop"]])
            if role is None:
                return [conv, len(spans), None, None, None, len(out)]
            text = unescape(out[x["text_start"] : x["text_stop"]])
            turns.update(f"{role}\n{text}\n".encode())
            if x["loss"]:
                loss.update(text.encode())
                chars += len(text)
        return [conv, len(spans), turns.hexdigest(), chars, loss.hexdigest(), len(out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        for batch in batches:
            done = [of(*row) for row in _rows([batch])]
            yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in done], schema=_DIGESTS)

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(run, DIGESTS)


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
#: A conversation that consists of the template's own control strings.
TRIAL = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def digests(conversations: DataFrame) -> DataFrame:
    """Format all conversations and the trial one, and read the digests back. Rows of a conv_id of -1 join the trial one."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    trial = conversations.sparkSession.createDataFrame(TRIAL, "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.union(trial)))
