"""Chat formatting with offset-aligned loss masks.

Method: turns are rendered into one text, the text is encoded once with
character offsets, and the sorted spans of the turns that carry loss are cut
with the sorted token spans by binary search.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Both markers are
single tokens, so a rendered conversation may be cut between turns without
changing any token: a long conversation is rendered in segments of bounded
size, dealt over tasks by range, and no task holds a whole one.

Escape (reversible): in texts and roles each ``<`` followed by n backslashes
and ``|`` gets one backslash more, so no marker can arise inside a text; in
roles, backslash and newline are written ``\\\\`` and ``\\n`` first.

Defined results: null texts and roles are empty; a null conversation id is a
conversation of its own; turns with equal numbers follow role, then text, and
null turn numbers come first; repeated rows are repeated turns; an empty table
gives no rows; columns other than the four named are not used.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
# Characters after which a segment ends (at the next turn).
SEGMENT_CHARS = 1 << 18

SEGMENT_FIELDS = (
    "conv_id bigint, first_turn bigint, first_role string, part int, n_turns int, formatted string, "
    "ids binary, loss_mask binary, loss_spans array<struct<start:int,end:int>>"
)
DIGEST_FIELDS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)
_TO_ESCAPE, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns and the spans of the texts that carry loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        at += len(head)
        if role == LOSS_ROLE:
            spans.append((at, at + len(body)))
        parts += [head, body, END, "\n"]
        at += len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    turns = []
    for turn in formatted.split(END + "\n")[:-1]:
        role, _, text = turn.removeprefix(START).partition("\n")
        turns.append((unescape_role(role), unescape(text)))
    return turns


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Tokens that overlap a span, and the characters of those tokens inside the spans.

    ``offsets`` holds the (start, end) of each token, both sorted; a token is
    found by binary search on either side of a span.
    """
    mask, kept = np.zeros(len(offsets), np.uint8), []
    if len(offsets):
        starts, ends = offsets[:, 0], offsets[:, 1]
        for start, end in spans:
            first, last = np.searchsorted(ends, start, "right"), np.searchsorted(starts, end, "left")
            if start < end and first < last:
                mask[first:last] = 1
                kept.append((max(start, int(starts[first])), min(end, int(ends[last - 1]))))
    return mask, kept


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    found.add_special_tokens([START, END])
    return found


def _segments(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, turn, role, text) rows to rendered and encoded segments."""
    tokenizer = _tokenizer(path)
    conv, first, part, chars, turns = object(), None, 0, 0, []

    def done() -> pa.RecordBatch:
        text, spans = render(turns)
        coded = tokenizer.encode(text, add_special_tokens=False)
        mask, kept = loss_mask(np.array(coded.offsets, np.int64).reshape(-1, 2), spans)
        row = {
            "conv_id": conv, "first_turn": first[0], "first_role": first[1], "part": part, "n_turns": len(turns),
            "formatted": text, "ids": np.array(coded.ids, "<u4").tobytes(), "loss_mask": mask.tobytes(),
            "loss_spans": [{"start": a, "end": b} for a, b in kept],
        }
        return pa.RecordBatch.from_pylist([row], schema=_SEGMENT_ARROW)

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if row[0] != conv or chars >= SEGMENT_CHARS:
                if turns:
                    yield done()
                part = part + 1 if row[0] == conv else 0
                conv, first, chars, turns = row[0], row[1:3], 0, []
            turns.append((row[2] or "", row[3] or ""))
            chars += len(turns[-1][1]) + len(turns[-1][0])
    if turns:
        yield done()


_SPAN = pa.struct([pa.field("start", pa.int32()), pa.field("end", pa.int32())])
_SEGMENT_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("first_turn", pa.int64()), ("first_role", pa.string()), ("part", pa.int32()),
     ("n_turns", pa.int32()), ("formatted", pa.string()), ("ids", pa.binary()), ("loss_mask", pa.binary()),
     ("loss_spans", pa.list_(_SPAN))]
)
_DIGEST_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def format_conversations(
    df: DataFrame, path: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Rendered, encoded and masked segments of every conversation (``SEGMENT_FIELDS``).

    The segments of a conversation, in the order of ``first_turn``,
    ``first_role`` and ``part`` (nulls first), put together are the
    formatted conversation, its ids and its mask (one byte per token).
    """
    rows = df.select(
        F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        F.col(role).alias("role"), F.col(text).alias("text"),
    )
    ordered = rows.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(lambda batches: _segments(batches, path), SEGMENT_FIELDS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state = object(), None

    def done() -> pa.RecordBatch:
        n, turns, chars, loss, size = state
        return pa.RecordBatch.from_pylist(
            [dict(zip(_DIGEST_ARROW.names, (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size)))],
            schema=_DIGEST_ARROW,
        )

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "formatted", "loss_spans")]
        for key, formatted, spans in zip(*columns):
            if state is None or key != conv:
                if state:
                    yield done()
                conv, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for span in spans:
                text = unescape(formatted[span["start"] : span["end"]])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
    if state:
        yield done()


def digest(segments: DataFrame) -> DataFrame:
    """One row per conversation (``DIGEST_FIELDS``), read back from its segments.

    A hash of a whole conversation must see its parts in order: they stream
    through one task, which holds one segment at a time.
    """
    ordered = (
        segments.select("conv_id", "first_turn", "first_role", "part", "formatted", "loss_spans")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "first_turn", "first_role", "part")
    )
    return ordered.mapInArrow(_digests, DIGEST_FIELDS)
