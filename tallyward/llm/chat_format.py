"""Chat formatting with turn spans found by incremental black-box rendering.

A template is any object that renders a list of (role, text) to a string.  Nothing else is asked of it: the successive
prefixes of a conversation are rendered, and what the output gains with a turn is that turn's span.  If a longer prefix
does not begin with the output of the shorter one, the template rewrites history; the turn at which it does is reported
and spans are not given, since they would be wrong.  Where a turn's own text lies in its span is found in the same way,
by rendering the turn with a probe in place of its text.  The loss mask is the spans of the assistant's texts.

:class:`MarkedTemplate` marks turns with control strings and escapes, reversibly, what could be read as one in a text.

The probe is a character that is in none of the conversation's roles and texts.  Rendering every prefix takes time that
grows with the square of a conversation's length, and a conversation is rendered in one task: no less is known of a
black box.

Cases: null texts and roles are empty; turns are ordered by turn number, role and text (nulls first); rows without a
conversation id form one conversation; repeated rows are turns each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
#: Code points of private use, of which a probe is made; a template's escapes leave them alone.
PRIVATE = (range(0xE000, 0xF900), range(0xF0000, 0xFFFFE), range(0x100000, 0x10FFFE))
#: Code points of formatted text that are handed on in one batch, about.
BATCH_CHARS = 4 << 20


class Template(Protocol):
    def render(self, turns: list[Turn]) -> str: ...


class MarkedTemplate:
    """``<s>[ROLE] text [/ROLE]</s>`` for each turn, with the control characters in roles and texts escaped."""

    def render(self, turns: list[Turn]) -> str:
        return "".join(f"<s>[{self.escape(role)}] {self.escape(text)} [/TURN]</s>\n" for role, text in turns)

    @staticmethod
    def escape(text: str) -> str:
        r"""No ``<``, ``[`` or ``]`` is left, so no control string: ``\`` ``<`` ``[`` ``]`` become ``\\`` ``\l`` ``\b`` ``\e``."""
        return text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b").replace("]", "\\e")

    @staticmethod
    def unescape(text: str) -> str:
        if "\\" not in text:
            return text
        parts = text.split("\\\\")
        return "\\".join(p.replace("\\l", "<").replace("\\b", "[").replace("\\e", "]") for p in parts)

    def role_of(self, span: str) -> str:
        return self.unescape(span[span.index("[") + 1 : span.index("]")])


@dataclass
class Formatted:
    text: str
    #: (start, end, start of the turn's own text, its end) by turn; empty if the template rewrites history.
    spans: list[tuple[int, int, int, int]] = field(default_factory=list)
    rewritten_at: int | None = None


def probe_for(turns: list[Turn]) -> str:
    """A private-use character that is in no role or text of these turns; if all are, a longer run of one than any there."""
    held = set().union(*(part for turn in turns for part in turn)) if turns else set()
    for points in PRIVATE:
        for k in points:
            if chr(k) not in held:
                return chr(k)
    one = chr(PRIVATE[0][0])
    probe = one + one
    while any(probe[1:] in part for turn in turns for part in turn):
        probe += one
    return probe


def format_turns(template: Template, turns: list[Turn]) -> Formatted:
    """Renders a conversation and locates its turns."""
    before, spans, probe = template.render([]), [], probe_for(turns)
    for k, (role, _) in enumerate(turns):
        now = template.render(turns[: k + 1])
        if not now.startswith(before):
            return Formatted(template.render(turns), [], k)
        probed = template.render([*turns[:k], (role, probe)])
        if not probed.startswith(before) or (at := probed.find(probe, len(before))) < 0:
            return Formatted(template.render(turns), [], k)
        tail = probed[at + len(probe) :]
        end = len(now) - len(tail)
        if end < at or not now.endswith(tail) or now[:at] != probed[:at]:
            return Formatted(template.render(turns), [], k)
        spans.append((len(before), len(now), at, end))
        before = now
    return Formatted(before, spans)


def _conversations(rows: DataFrame):
    """Turn rows in partitions sorted so that each conversation's turns follow each other."""
    source = rows.select(F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[Turn]]]:
    rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
    for key, group in groupby(rows, key=lambda r: r[0]):
        yield key, [(role, text) for _, role, text in group]


def format_conversations(rows: DataFrame, template: Template, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, turn_spans, loss_spans, rewritten_at) for each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.list_(pa.int64()))
        kinds = {"conv_id": pa.int64(), "formatted": pa.string(), "turn_spans": spans, "loss_spans": spans, "rewritten_at": pa.int64()}
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))

        chars = 0
        for key, turns in _grouped(batches):
            f = format_turns(template, turns)
            loss = [[a, b] for (role, _), (_, _, a, b) in zip(turns, f.spans, strict=False) if role == loss_role]
            held.append((key, f.text, [list(s) for s in f.spans], loss, f.rewritten_at))
            chars += len(f.text) + 100
            if chars >= BATCH_CHARS:
                yield out()
                held.clear()
                chars = 0
        if held:
            yield out()

    return _conversations(rows).mapInArrow(run, "conv_id long, formatted string, turn_spans array<array<long>>, loss_spans array<array<long>>, rewritten_at long")


def read_back(formatted: DataFrame, template: MarkedTemplate) -> DataFrame:
    """Digests of what the formatted texts and their spans say, without a look at the conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            out = []
            for key, text, spans, loss in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                turns, masked, chars = hashlib.sha256(), hashlib.sha256(), 0
                for start, end, a, b in spans:
                    turns.update(f"{template.role_of(text[start:end])}\n{template.unescape(text[a:b])}\n".encode())
                for a, b in loss:
                    own = template.unescape(text[a:b])
                    masked.update(own.encode())
                    chars += len(own)
                out.append((key, len(spans), turns.hexdigest(), chars, masked.hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names)

    return formatted.select("conv_id", "formatted", "turn_spans", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
