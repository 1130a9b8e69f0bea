"""Chat formatting by a grammar round trip.

A conversation is rendered as a sequence of turns:

    ### <role>: <text>
    </turn>

A deterministic parser reads this back: a turn ends at the first `</turn>` without a backslash before it, and in a text one
backslash is dropped from each run of backslashes before `###` or `</turn>`. Each turn is rendered as it is first and parsed
again; where the recovered turn differs from the source, the conflicting content is escaped (one more backslash before
each control string) and the round trip is repeated until both are identical. Turns delimit themselves, so each is settled alone,
without a shuffle, and a conversation is their concatenation. The loss mask covers the rendered texts of the assistant.

Reading back streams over turns in order with running digests, so a conversation of any length needs the memory of one turn.

Defined cases: null role or text counts as empty; equal or null turn numbers are ordered by role and text, nulls first; repeated
rows are repeated turns; a null conv_id is a conversation of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

OPEN, CLOSE = "### ", "\n</turn>\n"
LEARNT_ROLE = "assistant"
_CONTROL = re.compile(r"(\\*)(###|</turn>)")
_ESCAPED = re.compile(r"(\\*)\\(###|</turn>)")
_END = re.compile(r"(?<!\\)</turn>")
_ROLE_CONTROL = re.compile(r"[%:#\\<\n]")
_ROLE_ESCAPED = re.compile(r"%([0-9a-f]{2})")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render_turn(role: str, body: str) -> tuple[str, int, int]:
    """The rendered turn and where its body begins and ends."""
    head = OPEN + _ROLE_CONTROL.sub(lambda m: f"%{ord(m[0]):02x}", role) + ": "
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, begin and end of the body) of each turn; ValueError where the grammar doesn't hold."""
    out, at = [], 0
    while at < len(rendered):
        colon = rendered.find(": ", at)
        if not rendered.startswith(OPEN, at) or colon < 0 or "\n" in rendered[at:colon]:
            raise ValueError(f"no turn begins at {at}")
        end = _END.search(rendered, colon + 2)
        if end is None or not rendered.startswith(CLOSE, end.start() - 1) or end.start() - 1 < colon + 2:
            raise ValueError(f"the turn at {at} doesn't end")
        role = _ROLE_ESCAPED.sub(lambda m: chr(int(m[1], 16)), rendered[at + len(OPEN) : colon])
        out.append((role, unescape(rendered[colon + 2 : end.start() - 1]), colon + 2, end.start() - 1))
        at = end.end() + 1
    return out


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The first rendering that parses back to the same turn: the text as it is, or with its control strings escaped."""
    for body in (text, escape(text)):
        rendered = render_turn(role, body)
        try:
            if parse(rendered[0]) == [(role, text, *rendered[1:])]:
                return rendered
        except ValueError:
            pass
    raise ValueError(f"no rendering of a turn parses back: {text[:80]!r}")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, loss_begin and loss_end (null without loss): a row per turn. Joined in order of turn they are the conversation."""

    def render(batches):
        for batch in batches:
            rows = [(*format_turn(role or "", text or ""), role) for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            learnt = [r[3] == LEARNT_ROLE for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] if m else None for r, m in zip(rows, learnt)], pa.int64()) for k in (1, 2))],
                names=["conv_id", "turn", "role", "text", "formatted", "loss_begin", "loss_end"],
            )

    source = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return source.mapInArrow(render, "conv_id long, turn long, role string, text string, formatted string, loss_begin long, loss_end long")


def in_order(turns: DataFrame) -> DataFrame:
    """All turns of a conversation in one partition, in order."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans (begin and end in code points): a row per conversation."""

    def join(batches):
        for conv, turns in _by_conversation(in_batches(batches, ("formatted", "loss_begin", "loss_end"))):
            parts, spans, at = [], [], 0
            for formatted, begin, end in turns:
                if begin is not None:
                    spans.append({"begin": at + begin, "end": at + end})
                parts.append(formatted)
                at += len(formatted)
            spans_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(parts)], pa.string()), pa.array([spans], spans_type)], names=["conv_id", "formatted", "loss_spans"])

    return in_order(format_turns(conversations)).mapInArrow(join, "conv_id long, formatted string, loss_spans array<struct<begin:bigint,end:bigint>>")


def in_batches(batches, names):
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), *(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def _by_conversation(rows):
    """(conv_id, iterator over its turns) of sorted rows."""
    from itertools import groupby

    for conv, own in groupby(rows, key=lambda r: r[0]):
        yield conv, (r[1:] for r in own)


def digests(conversations: DataFrame) -> DataFrame:
    """What the formatted output says when it is read back, a row per conversation."""

    def read_back(batches):
        for conv, turns in _by_conversation(in_batches(batches, ("formatted", "loss_begin", "loss_end"))):
            n = chars = learnt = 0
            every, loss = hashlib.sha256(), hashlib.sha256()
            for formatted, begin, end in turns:
                for role, text, *_ in parse(formatted):
                    every.update(f"{role}\n{text}\n".encode())
                    n += 1
                chars += len(formatted)
                if begin is not None:
                    text = unescape(formatted[begin:end])
                    loss.update(text.encode())
                    learnt += len(text)
            yield conv, n, every.hexdigest(), learnt, loss.hexdigest(), chars

    def in_arrow(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        rows = []
        for row in read_back(batches):
            rows.append(row)
            if len(rows) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return in_order(format_turns(conversations)).mapInArrow(in_arrow, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
