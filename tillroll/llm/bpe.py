"""Byte-level BPE: encode and decode whole texts with a public tokenizer file.

Method: every pre-token is merged by a priority queue of merge ranks over a
doubly linked list of symbols; an entry whose symbols have changed since it
was queued is stale and skipped. Decoding concatenates vocabulary strings.

Words repeat, so each task keeps bounded caches: of pre-tokens, and of the
stretches between single spaces (a space between two non-blank characters
always starts a new pre-token, so these can be encoded on their own).

Defined results: a null text is encoded as the empty text (no ids, empty
``ids``); strings of the file's special tokens inside a text become those
tokens; rows are independent, so ties, repeated rows and empty tables need no
rule; other columns pass through, and columns named like the outputs are
replaced. A very long text is worked on in segments.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from tillroll.llm.common import Known, add_columns

# Fixed value: the pre-token pattern of the byte-level tokenizer files.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Entries of a task's caches; a full cache starts again empty.
WORD_CACHE = 600_000
STRETCH_CACHE = 300_000
# Characters of a text worked on at once.
SEGMENT = 1 << 20
# A merge is packed as rank and new id, a queue entry as merge and place.
_BITS = 20
_LOW = (1 << _BITS) - 1
_PLACE = 32
_AT = (1 << _PLACE) - 1


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary.

    Printable Latin-1 bytes stand for themselves; the others get the
    characters from code point 256 on, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class ByteBPE:
    """Encoder and decoder of one tokenizer file (see the module's text)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_alphabet()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [vocab[c] for c in letters]
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left] << _BITS | vocab[right]] = rank << _BITS | vocab[left + right]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max(max(vocab.values()), *self.special.values(), 0)
        self.strings = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(of_letter[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self._pretokens = regex.compile(PRETOKEN).findall
        self._cut = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
            if self.special
            else None
        )
        self._word = Known(lambda w: np.array(self.merge(w.encode()), "<u4").tobytes(), WORD_CACHE).__getitem__
        self._spaced = Known(lambda s: self._apart(" " + s), STRETCH_CACHE).__getitem__

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: merge by queue of ranks over linked symbols."""
        ids = list(map(self.byte_ids.__getitem__, word))
        n = len(ids)
        if n < 2:
            return ids
        get = self.merges.get
        queue = []
        i = 0
        left = ids[0] << _BITS
        for right in ids[1:]:
            m = get(left | right)
            if m is not None:
                queue.append(m << _PLACE | i)
            left = right << _BITS
            i += 1
        if not queue:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n))
        ids.append(-1)  # the list's end
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i = entry & _AT
            m = entry >> _PLACE
            j = after[i]
            left = ids[i]
            if left < 0 or ids[j] < 0 or get(left << _BITS | ids[j]) != m:
                continue  # stale: a neighbour has been merged since
            ids[i] = new = m & _LOW
            ids[j] = -1
            k = after[i] = after[j] if j < n else n
            before[k] = i
            if k < n:
                m = get(new << _BITS | ids[k])
                if m is not None:
                    push(queue, m << _PLACE | i)
            h = before[i]
            if h >= 0:
                m = get(ids[h] << _BITS | new)
                if m is not None:
                    push(queue, m << _PLACE | h)
        return [i for i in ids if i >= 0]

    def _apart(self, text: str) -> bytes:
        """Ids of a text, pre-token by pre-token."""
        return b"".join(map(self._word, self._pretokens(text)))

    def _plain(self, text: str) -> bytes:
        """Ids of a text that holds no special token."""
        if not text:
            return b""
        stretches = text.split(" ")
        if not all(stretches) or "\n " in text or " \n" in text or not text.replace("\n", "").isprintable():
            return self._apart(text)  # blanks side by side
        first = self._apart(stretches[0])
        return first + b"".join(map(self._spaced, stretches[1:]))

    def _segments(self, text: str):
        """Pieces of a text that encode independently: cut before a lone space."""
        at = 0
        while len(text) - at > SEGMENT:
            cut = text.find(" ", at + SEGMENT)
            while cut > 0 and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace() or cut + 1 >= len(text)):
                cut = text.find(" ", cut + 1)
            if cut <= 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        parts = self._cut(text) if self._cut else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif len(part) <= SEGMENT:
                out.append(self._plain(part))
            else:
                out.extend(map(self._apart, self._segments(part)))
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str:
        """Vocabulary strings of the ids, put together."""
        if not ids:
            return ""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with ``out``: the ids of ``text`` (binary, little-endian unsigned 32 bits)."""

    def make():
        bpe = load(path)
        return lambda b: [[bpe.encode(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]]

    return add_columns(df, f"`{out}` binary", make)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the text of ``ids`` (special tokens are kept; null gives the empty text)."""

    def make():
        bpe = load(path)
        return lambda b: [[bpe.decode(t) for t in b.column(b.schema.get_field_index(ids)).to_pylist()]]

    return add_columns(df, f"`{out}` string", make)


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Encode, then decode the ids, in one pass over the rows."""

    def make():
        bpe = load(path)

        def work(batch):
            encoded = [bpe.encode(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            return [encoded, [bpe.decode(e) for e in encoded]]

        return work

    return add_columns(df, f"`{ids}` binary, `{out}` string", make)
