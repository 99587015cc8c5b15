"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes.

A text's byte offsets where tokens of both tokenizers end cut both token lists
into groups; every occurrence pair inside a group is a link of two token ids.

Method: inverted pair bitmaps. Documents are numbered in chunks. For each pair
of ids a chunk holds one compressed bitmap of its documents (a sorted list of
16-bit numbers, or plain bits where that is shorter) and planes of further
links: plane k has a document if bit k of (links - 1) is set. Bitmaps of a
chunk's batches are OR-merged as the chunk closes; chunks share no document,
so a pair's bitmap over all documents is its chunks' bitmaps side by side and
its popcount the sum of theirs. The postings then carry each pair's count, and
whether it is the highest of its first id, back to their documents: per chunk
the bitmaps are decoded and added up document by document.

What is shuffled are postings, about two bytes for each document of a pair,
never links. Texts stay where they are read.

Defined results: texts that are null, empty, or whose tokens do not spell
space + text in both tokenizers have no tokens and zeros. Special tokens are
never used; their strings are plain text. Every row is a document of its own,
so repeated rows and equal or null ids are counted as they come; an empty
table gives no rows; other columns are ignored. A group with very many tokens is
counted by distinct ids, never by all its links.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.bpe import PRETOKEN, byte_alphabet
from tillroll.llm.common import Scratch, slices

# A chunk closes at so many documents (numbers have 16 bits) or (pair, document) entries.
CHUNK_DOCS = 1 << 16
CHUNK_ENTRIES = 4_000_000
_SLOT = 16
# Groups with more links than this are counted by distinct ids.
WIDE = 1024
# Rows handed back to Spark at once.
ROWS = 16384
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Tokens:
    """Two tokenizers: ids of whole texts, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.encode_a = self._encoder(a_path, spec, vocab)
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.a_length = np.zeros(size, np.int64)
        for token, i in vocab.items():
            self.a_length[i] = len(token)

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.b_length = np.array([len(b) for b in self.b_bytes], np.int64)
        # Ids as they are listed, with what follows them: first ids ',' or '|', second ids ',' or ';' or nothing.
        self.listed = [b"%d%s" % (i, end) for i in range(size) for end in (b",", b"|")]
        self.b_listed = len(self.listed)
        self.listed += [b"%d%s" % (i, end) for i in range(len(self.b_bytes)) for end in (b",", b";", b"")]

    @staticmethod
    def _encoder(path: str, spec: dict, vocab: dict[bytes, int]):
        """Texts to ids: merges whose results are numbered in order are ranks, which tiktoken applies faster."""
        ids = spec["model"]["vocab"]
        merged = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if all(a < b for a, b in zip(merged, merged[1:])) and len(merged) + 256 == len(vocab):
            import tiktoken

            ranks = tiktoken.Encoding("own", pat_str=PRETOKEN, mergeable_ranks=vocab, special_tokens={})
            return lambda text: ranks.encode_to_numpy(text, disallowed_special=())
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.int64)

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        if self.pieces.is_byte(i):
            return bytes([int(piece[1:-1], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All first ids, all second ids, and how many of each every text has (none where the bytes differ)."""
        a_ids, b_ids = [], []
        n_a, n_b = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for at, (text, b) in enumerate(zip(texts, self.pieces.encode([t or "" for t in texts], num_threads=1))):
            if not text:
                continue
            spelled = (" " + text).encode()
            if b"".join(map(self.b_bytes.__getitem__, b)) != spelled:
                continue
            a = self.encode_a(" " + text)
            # Pre-tokens are stretches of the text in order, so equal lengths are equal bytes.
            if int(self.a_length[a].sum()) != len(spelled):
                continue
            a_ids.append(a)
            b_ids.append(b)
            n_a[at], n_b[at] = len(a), len(b)
        none = [np.zeros(0, np.int64)]
        return (
            np.concatenate(a_ids or none).astype(np.int64),
            np.concatenate([np.array(b, np.int64) for b in b_ids] or none),
            n_a,
            n_b,
        )


@lru_cache(maxsize=2)
def load(a_path: str, b_path: str) -> Tokens:
    return Tokens(a_path, b_path)


def _sums(per_row: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, of, per_row)
    return out


class Aligned:
    """Groups and links of a batch of texts, all texts' bytes laid end to end."""

    def __init__(self, tokens: Tokens, texts: list[str | None]):
        self.tokens, self.size = tokens, len(texts)
        self.a, self.b, self.n_a, self.n_b = tokens.encode(texts)
        a_end, b_end = np.cumsum(tokens.a_length[self.a]), np.cumsum(tokens.b_length[self.b])
        ends = np.zeros((int(a_end[-1]) if len(a_end) else 0) + 1, np.int8)
        ends[a_end] += 1
        ends[b_end] += 2
        self.a_last, self.b_last = ends[a_end] == 3, ends[b_end] == 3
        self.a_group = np.cumsum(self.a_last) - self.a_last
        self.b_group = np.cumsum(self.b_last) - self.b_last
        groups = int(self.a_last.sum())
        self.a_in, self.b_in = np.bincount(self.a_group, minlength=groups), np.bincount(self.b_group, minlength=groups)
        self.a_doc = np.repeat(np.arange(self.size), self.n_a)
        self.group_doc = self.a_doc[self.a_last]
        self.n_groups = np.bincount(self.group_doc, minlength=self.size)
        self.n_links = _sums(self.a_in * self.b_in, self.group_doc, self.size)

    def groups(self) -> list[bytes]:
        """Each text's groups: ``a1,a2|b1;a3|b2,b3``."""
        a_before, b_before = np.cumsum(self.a_in) - self.a_in, np.cumsum(self.b_in) - self.b_in
        line = np.empty(len(self.a) + len(self.b), np.int64)
        line[np.arange(len(self.a)) + b_before[self.a_group]] = 2 * self.a + self.a_last
        ending = self.b_last.astype(np.int64)
        ending[np.cumsum(self.n_b)[self.n_b > 0] - 1] = 2
        line[np.arange(len(self.b)) + (a_before + self.a_in)[self.b_group]] = self.tokens.b_listed + 3 * self.b + ending
        upto = np.cumsum(self.n_a + self.n_b).tolist()
        get = self.tokens.listed.__getitem__
        return [b"".join(map(get, line[start:end].tolist())) for start, end in zip([0, *upto], upto)]

    def entries(self, first_slot: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys (first id, second id, document number) and how many links each has."""
        a_size, b_size = len(self.tokens.a_length), len(self.tokens.b_length)
        if (a_size * b_size).bit_length() + _SLOT > 63:
            raise ValueError("vocabularies too large for packed keys")
        wide = np.flatnonzero(self.a_in * self.b_in > WIDE)
        times = self.b_in[self.a_group]
        if len(wide):
            times = np.where(np.isin(self.a_group, wide), 0, times)
        b_before = np.cumsum(self.b_in) - self.b_in
        which = np.repeat(np.arange(len(self.a)), times)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        second = self.b[b_before[self.a_group][which] + nth]
        slot = first_slot + self.a_doc[which]
        keys = ((self.a[which] * b_size + second) << _SLOT) | slot
        if not len(wide):
            return np.unique(keys, return_counts=True)
        parts, links = [keys], [np.ones(len(keys), np.int64)]
        a_before = np.cumsum(self.a_in) - self.a_in
        for g in wide.tolist():
            a_ids, a_times = np.unique(self.a[a_before[g] : a_before[g] + self.a_in[g]], return_counts=True)
            b_ids, b_times = np.unique(self.b[b_before[g] : b_before[g] + self.b_in[g]], return_counts=True)
            at = first_slot + int(self.group_doc[g])
            parts.append((((a_ids[:, None] * b_size + b_ids[None, :]) << _SLOT) | at).ravel())
            links.append((a_times[:, None] * b_times[None, :]).ravel())
        keys, which = np.unique(np.concatenate(parts), return_inverse=True)
        return keys, _sums(np.concatenate(links), which, len(keys))


def _lists(numbers: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values: each the next ``lengths`` of the 16-bit ``numbers``."""
    offsets = np.concatenate([[0], np.cumsum(lengths * 2)]).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(numbers.astype("<u2").tobytes())]
    )


def _bits(numbers: np.ndarray, size: int) -> bytes:
    marks = np.zeros(size, np.uint8)
    marks[numbers] = 1
    return np.packbits(marks, bitorder="little").tobytes()


def _numbers(bits: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))


def postings(keys: np.ndarray, links: np.ndarray, slots: int) -> dict[str, pa.Array]:
    """One row for each pair of the sorted ``keys``: its bitmap, planes, and both popcounts."""
    pair, slot = keys >> _SLOT, keys & (CHUNK_DOCS - 1)
    start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    n_docs = np.diff(np.append(start, len(pair)))
    n_links = np.add.reduceat(links, start)
    row = np.repeat(np.arange(len(start)), n_docs)
    more = links - 1
    planes = np.array([int(m).bit_length() for m in np.maximum.reduceat(more, start).tolist()], np.int64)
    # Plane k of a row is the child at its first child + k.
    first = np.cumsum(planes) - planes
    child, numbers = [], []
    for k in range(int(planes.max(initial=0))):
        has = np.flatnonzero(more >> k & 1)
        child.append(first[row[has]] + k)
        numbers.append(slot[has])
    child = np.concatenate(child or [np.zeros(0, np.int64)])
    numbers = np.concatenate(numbers or [np.zeros(0, np.int64)])[np.argsort(child, kind="stable")]
    in_plane = np.bincount(child, minlength=int(planes.sum()))

    dense = n_docs > slots // 16
    docs, plane_lists = _lists(slot, n_docs), _lists(numbers, in_plane)
    if dense.any():
        docs, plane_lists = docs.to_pylist(), plane_lists.to_pylist()
        for r in np.flatnonzero(dense).tolist():
            docs[r] = _bits(np.frombuffer(docs[r], "<u2"), slots)
            for c in range(int(first[r]), int(first[r] + planes[r])):
                plane_lists[c] = _bits(np.frombuffer(plane_lists[c], "<u2"), slots)
        docs, plane_lists = pa.array(docs, pa.binary()), pa.array(plane_lists, pa.binary())
    offsets = pa.array(np.append(first, planes.sum()), pa.int32())
    return {
        "pair": pa.array(pair[start]), "dense": pa.array(dense), "docs": docs,
        "planes": pa.ListArray.from_arrays(offsets, plane_lists), "pair_docs": pa.array(n_docs), "pair_links": pa.array(n_links),
    }


# What the first pass writes: rows of documents (slot is not null) and rows of postings.
_FIRST = pa.schema([
    ("chunk", pa.int64()), ("slot", pa.int32()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS],
    ("groups", pa.binary()), ("groups_sha256", pa.string()),
    ("pair", pa.int64()), ("dense", pa.bool_()), ("docs", pa.binary()), ("planes", pa.list_(pa.binary())),
    ("pair_docs", pa.int64()), ("pair_links", pa.int64()),
])
_FIRST_DDL = (
    "chunk bigint, slot int, doc_id bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", groups binary, groups_sha256 string,"
    " pair bigint, dense boolean, docs binary, planes array<binary>, pair_docs bigint, pair_links bigint"
)


def _rows(columns: dict, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in _FIRST], schema=_FIRST
    )


def _aligner(a_path: str, b_path: str, with_groups: bool):
    """The first pass: aligns texts and closes chunks of postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load(a_path, b_path)
        chunk, used = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([k for k, _ in held])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            if len(keys):
                columns = postings(keys, np.concatenate([n for _, n in held])[order], used)
                columns["chunk"] = pa.array(np.full(len(columns["pair"]), chunk))
                whole = _rows(columns, len(columns["pair"]))
                for at in range(0, whole.num_rows, ROWS):
                    yield whole.slice(at, ROWS)
            held.clear()

        for whole in batches:
            for batch in slices(whole):
                if used and (used + batch.num_rows > CHUNK_DOCS or sum(len(k) for k, _ in held) > CHUNK_ENTRIES):
                    yield from close()
                    chunk, used = chunk + 1, 0
                found = Aligned(tokens, batch.column(1).to_pylist())
                columns = {c: pa.array(getattr(found, c), pa.int64()) for c in _COUNTS}
                lists = found.groups()
                columns["groups_sha256"] = pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in lists], pa.string())
                if with_groups:
                    columns["groups"] = pa.array(lists, pa.binary())
                columns["chunk"] = pa.array(np.full(batch.num_rows, chunk))
                columns["slot"] = pa.array(np.arange(used, used + batch.num_rows), pa.int32())
                columns["doc_id"] = batch.column(0)
                yield _rows(columns, batch.num_rows)
                held.append(found.entries(used))
                used += batch.num_rows
        if held:
            yield from close()

    return run


_SCORES = pa.schema([("chunk", pa.int64()), ("slot", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by document over postings (chunk, dense, docs, planes, count, best) that come sorted by chunk."""
    now, best, total = None, None, None

    def out() -> pa.RecordBatch:
        slot = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(slot), now)), pa.array(slot, pa.int32()), pa.array(best[slot]), pa.array(total[slot])],
            schema=_SCORES,
        )

    def add(binary: pa.Array, dense: np.ndarray, weight: np.ndarray, is_best: np.ndarray, times: np.ndarray) -> None:
        # ``times``: how many links a document in each of these bitmaps stands for.
        lists = binary.filter(pa.array(~dense))
        sizes = np.diff(np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]) // 2
        start = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset] if len(lists) else 0
        values = lists.buffers()[2]
        slot = np.frombuffer(values, "<u2", int(sizes.sum()), int(start)) if sizes.sum() else np.zeros(0, np.int64)
        np.add.at(total, slot, np.repeat((weight * times)[~dense], sizes))
        np.add.at(best, slot, np.repeat((is_best * times)[~dense], sizes))
        for r in np.flatnonzero(dense).tolist():
            slot = _numbers(binary[r].as_py())
            total[slot] += weight[r] * times[r]
            best[slot] += is_best[r] * times[r]

    for whole in batches:
        chunks = whole.column(0).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], chunks[1:] != chunks[:-1]])).tolist() if len(chunks) else []
        for start, end in zip(cuts, [*cuts[1:], len(chunks)]):
            if chunks[start] != now:
                if now is not None:
                    yield out()
                now = int(chunks[start])
                best, total = np.zeros(CHUNK_DOCS, np.int64), np.zeros(CHUNK_DOCS, np.int64)
            _, dense, docs, planes, count, top = whole.slice(start, end - start).columns
            dense, count, top = dense.to_numpy(zero_copy_only=False), count.to_numpy(), top.to_numpy(zero_copy_only=False).astype(np.int64)
            add(docs, dense, count, top, np.ones(len(count), np.int64))
            n_planes = planes.value_lengths().to_numpy()
            if n_planes.sum():
                row = np.repeat(np.arange(len(count)), n_planes)
                k = np.arange(len(row)) - np.repeat(np.cumsum(n_planes) - n_planes, n_planes)
                add(planes.flatten(), dense[row], count[row], top[row], np.int64(1) << k)
    if now is not None:
        yield out()


def align(
    df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text", with_groups: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_a, n_b, n_groups, n_links, groups_sha256[, groups], n_best, count_sum) and
    pairs (a_id, b_id, docs, links, best): documents that hold the pair linked, links, highest of its first id."""
    scratch = Scratch(df.sparkSession, "alignment")
    b_size = _b_size(b_path)
    read = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    first = scratch.keep(read.mapInArrow(_aligner(a_path, b_path, with_groups), _FIRST_DDL), "first")
    posted = first.filter("pair is not null")
    counts = posted.groupBy("pair").agg(F.sum("pair_docs").alias("count"), F.sum("pair_links").alias("links"))
    a_id, b_id = F.floor(F.col("pair") / F.lit(b_size)).cast("bigint"), F.pmod("pair", F.lit(b_size)).cast("bigint")
    # A first id has at most as many pairs as the second vocabulary has ids.
    of_a = Window.partitionBy("a_id")
    counts = counts.select("pair", a_id.alias("a_id"), b_id.alias("b_id"), "count", "links")
    pairs = scratch.keep(counts.withColumn("best", F.col("count") == F.max("count").over(of_a)), "pairs")

    scored = posted.select("pair", "chunk", "dense", "docs", "planes").join(pairs.select("pair", "count", "best"), "pair")
    scored = scored.select("chunk", "dense", "docs", "planes", "count", "best").repartition("chunk").sortWithinPartitions("chunk")
    scores = scored.mapInArrow(_scores, "chunk bigint, slot int, n_best bigint, count_sum bigint")
    docs = first.filter("slot is not null").select(
        "chunk", "slot", "doc_id", *_COUNTS, "groups_sha256", *([F.col("groups").cast("string").alias("groups")] if with_groups else [])
    )
    found = docs.join(scores, ["chunk", "slot"], "left").drop("chunk", "slot")
    return found.fillna(0, ["n_best", "count_sum"]), pairs.select("a_id", "b_id", F.col("count").alias("docs"), "links", "best")


@lru_cache(maxsize=2)
def _b_size(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
