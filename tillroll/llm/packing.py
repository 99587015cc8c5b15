"""Best-fit packing of tokenized documents into sequences, by a grouping genetic algorithm.

Method: a solution is a grouping of pieces into bins. Crossover injects whole
well-filled bins of one parent into the other, removes the bins that now hold
duplicates and best-fits the displaced pieces again. Pieces are dealt over
shards of bounded size by a hash; each shard is evolved on several islands
(tasks) apart, from different starts; the elite of every island migrates to the
next, and after the last epoch the islands of a shard meet and their best
solution is taken. What counts is the whole table: a solution is better if it
has fewer bins, then if less room is lost outside its least filled bins. These
few bins of every shard are taken apart and evolved anew together, round by
round, until one group is left.

Tokens: a text's ids by a public tokenizer file with word ends, then one id 0.

Defined results: a null text is the empty text (one token, the id 0); only
documents longer than the capacity are cut; rows are packed as they come, so
repeated rows are packed each, also with null or equal ids; an empty table
gives no rows; other columns are ignored. A piece's place (sequence, offset)
is the same for the same stored pieces: ties go by length, then row number.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.bpe import byte_alphabet
from tillroll.llm.common import Known, Scratch, slices

CAPACITY = 2048
SEPARATOR = 0
# Fixed value: the word pattern of the tokenizer file with word ends.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Stretches in a task's memo of those that go to the library alone.
MEMO = 200_000
# The characters put behind each word, and as a word of its own between stretches.
END, BREAK = "\x00", "\x01"
# Pieces of a shard (about), islands, epochs between migrations, children of an epoch, solutions on an island.
SHARD_PIECES = 16384
ISLANDS = 2
EPOCHS = 2
CHILDREN = 12
POPULATION = 4
# Least filled bins that a shard hands on, and shards that pack them anew together.
OPEN_BINS = 4
MERGED = 32


class WordIds:
    """Ids of whole texts by a tokenizer file with word ends.

    A lot of texts is taken at once: their words are found and merged together.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._special = [t["content"] for t in spec["added_tokens"]]
        self._ranks = self._ranked(spec)
        self._find_words = regex.compile(WORD).findall
        self._break = int(self._ranks.encode_to_numpy(BREAK + END, disallowed_special=())[0])
        # From U+0300 on letters are composed and lower case depends on neighbours.
        self._high = re.compile("[\u0300-\U0010ffff]").search
        self._alone = Known(self._of_library, MEMO).__getitem__

    def _ranked(self, spec: dict):
        """The file's merges as ranks, with a null character as the mark of a word's end.

        A word's last byte and the mark are one symbol of the file from the
        start; here they are the first two to be merged, as these symbols have
        lower ids than any merge. Merges whose results are numbered in order
        are ranks.
        """
        import tiktoken

        vocab = spec["model"]["vocab"]
        mark = spec["model"]["end_of_word_suffix"]
        special = set(self._special)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if not all(a < b for a, b in zip([2 * len(byte_of) - 1, *merged], merged)):
            raise ValueError("the file's merges are not numbered in order")
        ranks = {}
        for token, i in vocab.items():
            if token not in special:
                end = END.encode() if token.endswith(mark) else b""
                ranks[bytes(map(byte_of.__getitem__, token.removesuffix(mark))) + end] = i
        return tiktoken.Encoding("words", pat_str=f"[^{END}]*{END}", mergeable_ranks=ranks, special_tokens={})

    def _is_odd(self, text: str) -> bool:
        """Whether the library itself is needed: special tokens, letters that are composed, the marks used here."""
        if END in text or BREAK in text or any(s in text for s in self._special):
            return True
        return not text.isascii() and self._high(text) is not None

    def _of_library(self, stretch: str) -> bytes:
        return np.array(self._tokenizer.encode(stretch, add_special_tokens=False).ids, "<u4").tobytes()

    def _simple(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that need nothing but lower case and the words' merges, all texts at once."""
        if not texts:
            return []
        words = self._find_words(f" {BREAK} ".join(["", *texts]).lower())
        ids = self._ranks.encode_to_numpy(END.join(words) + END, disallowed_special=()).astype("<u4")
        broken = ids == self._break
        cuts = np.flatnonzero(broken)
        starts = (4 * (cuts - np.arange(len(cuts)))).tolist()
        found = ids[~broken].tobytes()
        return list(map(found.__getitem__, map(slice, starts, [*starts[1:], len(found)])))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without the separator."""
        simple: list[str] = []
        # Of each text: numbers of simple texts, and ids of stretches that go to the library alone.
        parts: list[list[int | bytes]] = []
        for text in texts:
            own: list[int | bytes] = []
            parts.append(own)
            # White space never survives, so stretches between spaces can be encoded apart.
            runs = itertools.groupby(text.split(" "), self._is_odd) if text and self._is_odd(text) else [(False, [text or ""])]
            for odd, run in runs:
                if odd:
                    own += map(self._alone, run)
                else:
                    own.append(len(simple))
                    simple.append(" ".join(run))
        found = self._simple(simple)
        return [b"".join(found[p] if isinstance(p, int) else p for p in own) for own in parts]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def load(path: str) -> WordIds:
    return WordIds(path)


def pieces(
    df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's tokens, cut at ``capacity``."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    ddl = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    if with_ids:
        fields.append(("ids", pa.binary()))
        ddl += ", ids binary"
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(path)
        end = np.array([SEPARATOR], "<u4").tobytes()
        for batch in itertools.chain.from_iterable(map(slices, batches)):
            rows: list[tuple] = []
            held = 0
            for doc, found in zip(batch.column(0).to_pylist(), words.encode_all(batch.column(1).to_pylist())):
                ids = found + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(fields)])
                held += len(ids) if with_ids else 0
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, ddl)


def best_fit(items: np.ndarray, lengths: np.ndarray, bins: np.ndarray, loads: list[int], capacity: int) -> None:
    """Put ``items`` in order into the fullest bin with room, else into a new one (``bins``, ``loads`` change)."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for b, load in enumerate(loads):
        if load < capacity:
            stacks[capacity - load].append(b)
            rooms |= 1 << (capacity - load)
    for item, size in zip(items.tolist(), lengths[items].tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            b, room = len(loads), capacity
            loads.append(0)
        bins[item] = b
        loads[b] += size
        room -= size
        if room:
            if not stacks[room]:
                rooms |= 1 << room
            stacks[room].append(b)


class Solution:
    """Pieces grouped into bins."""

    def __init__(self, bins: np.ndarray, lengths: np.ndarray, capacity: int):
        used, self.bins = np.unique(bins, return_inverse=True)
        self.loads = np.bincount(self.bins, weights=lengths, minlength=len(used)).astype(np.int64)
        # Room that stays unused: what the least filled bins leave can still be used by other shards' pieces.
        self.waste = int((capacity - np.sort(self.loads)[OPEN_BINS:]).sum())
        # Fewer bins first, then less waste, then fuller bins.
        self.worth = (-len(used), -self.waste, float(((self.loads / capacity) ** 2).sum()))

    def open_bins(self, capacity: int) -> np.ndarray:
        """The least filled bins with room, the ones to be packed anew."""
        least = np.argsort(self.loads, kind="stable")[:OPEN_BINS]
        return least[self.loads[least] < capacity]


def decreasing(lengths: np.ndarray, capacity: int, rng: np.random.Generator | None = None) -> Solution:
    """Best fit by decreasing length, with some disorder if ``rng`` is given."""
    key = -lengths.astype(float) if rng is None else -lengths * rng.uniform(0.9, 1.0, len(lengths))
    bins = np.zeros(len(lengths), np.int64)
    best_fit(np.argsort(key, kind="stable"), lengths, bins, [], capacity)
    return Solution(bins, lengths, capacity)


def cross(a: Solution, b: Solution, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> Solution:
    """Whole well-filled bins of ``b`` go into ``a``; pieces of the bins they disturb are best-fitted again."""
    well = np.flatnonzero(b.loads == capacity)
    if not len(well):
        well = np.argsort(-b.loads, kind="stable")[: max(1, len(b.loads) // 2)]
    taken = np.zeros(len(b.loads), bool)
    taken[well[rng.random(len(well)) < rng.uniform(0.05, 0.9)]] = True
    moved = taken[b.bins]
    hit = np.zeros(len(a.loads), bool)
    hit[a.bins[moved]] = True
    # The emptiest bins of ``a`` are dissolved too, so that their pieces get another chance.
    hit[np.argsort(a.loads, kind="stable")[: 1 + int(len(a.loads) * rng.uniform(0.0, 0.1))]] = True
    displaced = np.flatnonzero(hit[a.bins] & ~moved)
    bins = np.where(moved, len(a.loads) + b.bins, a.bins)
    bins[displaced] = -1
    used, inverse = np.unique(bins, return_inverse=True)
    if len(displaced):
        used, inverse = used[1:], inverse - 1
    loads = np.bincount(inverse[inverse >= 0], weights=lengths[inverse >= 0], minlength=len(used)).astype(int).tolist()
    # By decreasing length, with some disorder, or the same pieces would meet again.
    key = -lengths[displaced] * rng.uniform(rng.uniform(0.5, 1.0), 1.0, len(displaced))
    best_fit(displaced[np.argsort(key, kind="stable")], lengths, inverse, loads, capacity)
    return Solution(inverse, lengths, capacity)


def evolve(start: list[Solution], lengths: np.ndarray, capacity: int, children: int, seed: int, spare: int = 0, plain: bool = True) -> Solution:
    """The best solution after ``children`` crossings, from ``start`` and fresh ones.

    It ends early only where nothing better can matter: no grouping has fewer
    bins, and no more than ``spare`` tokens of room are lost to the whole table.
    ``plain`` adds best fit by decreasing length itself; the other fresh
    solutions are disordered by ``seed``, so islands start apart.
    """
    rng = np.random.default_rng(seed)
    alive = list(start) or ([decreasing(lengths, capacity)] if plain else [])
    least = -(-int(lengths.sum()) // capacity)

    def done(s: Solution) -> bool:
        return len(s.loads) <= least and s.waste <= spare

    if not any(map(done, alive)):
        while len(alive) < POPULATION:
            alive.append(decreasing(lengths, capacity, rng))
    for _ in range(children):
        alive.sort(key=lambda s: s.worth, reverse=True)
        if done(alive[0]):
            break
        i, j = rng.choice(len(alive), 2, replace=False) if len(alive) > 1 else (0, 0)
        child = cross(alive[min(i, j)], alive[max(i, j)], lengths, capacity, rng)
        if child.worth > alive[-1].worth:
            alive[-1] = child
    return max(alive, key=lambda s: s.worth)


def _evolved(sizes: DataFrame, capacity: int, spare: int, scratch: Scratch) -> DataFrame:
    """(shard, row, length, bin, offset, open) of (shard, row, length): islands evolve apart, migrate, and meet."""

    def island(frame: pd.DataFrame) -> tuple[pd.DataFrame, Solution]:
        # Rows of a shard, once for each solution that has come here (origin; -1: none yet).
        frame = frame.sort_values(["origin", "length", "row"], ascending=[True, False, True], kind="stable")
        lots = [lot for _, lot in frame.groupby("origin", sort=True)]
        lengths = lots[0]["length"].to_numpy(np.int64)
        start = [Solution(lot["bin"].to_numpy(np.int64), lengths, capacity) for lot in lots if lot["origin"].iloc[0] >= 0]
        own = int(frame["island"].iloc[0])
        seed = int(frame["shard"].iloc[0]) * 1009 + own
        return lots[0], evolve(start, lengths, capacity, CHILDREN, seed, spare, plain=own == 0)

    def epoch(frame: pd.DataFrame) -> pd.DataFrame:
        lot, best = island(frame)
        return pd.DataFrame({"shard": lot["shard"], "island": lot["island"], "row": lot["row"], "length": lot["length"], "bin": best.bins})

    ddl = "shard bigint, island int, row bigint, length int, bin bigint"
    lots = sizes.select(
        "shard", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), "row", "length",
        F.lit(-1).cast("bigint").alias("bin"), F.lit(-1).alias("origin"),
    )
    for _ in range(EPOCHS):
        best = scratch.keep(lots.groupBy("shard", "island").applyInPandas(epoch, ddl), "epoch")
        # The elite stays and a copy of it migrates to the next island.
        here = best.withColumn("origin", F.col("island"))
        there = best.withColumn("origin", F.col("island")).withColumn("island", (F.col("island") + 1) % ISLANDS)
        lots = here.unionByName(there)

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        lot, best = island(frame)
        opened = np.zeros(len(best.loads), bool)
        opened[best.open_bins(capacity)] = True
        placed = pd.DataFrame({"row": lot["row"].to_numpy(), "bin": best.bins, "length": lot["length"].to_numpy(), "open": opened[best.bins]})
        placed = placed.sort_values(["bin", "length", "row"], ascending=[True, False, True])
        placed["offset"] = placed.groupby("bin")["length"].cumsum() - placed["length"]
        placed["shard"] = int(frame["shard"].iloc[0])
        return placed[["shard", "row", "length", "bin", "offset", "open"]]

    met = best.withColumn("origin", F.col("island")).withColumn("island", F.lit(ISLANDS))
    return met.groupBy("shard").applyInPandas(meet, "shard bigint, row bigint, length int, bin bigint, offset bigint, open boolean")


def pack(stored: DataFrame, capacity: int = CAPACITY, row: str = "row", length: str = "length") -> DataFrame:
    """(row, sequence_id, offset) for the stored pieces (``row`` is unique; lengths from 1 to ``capacity``).

    Shards are evolved first; then the least filled bins of every ``MERGED``
    shards are taken apart and evolved together, and theirs again, until one
    group is left. A round's groups are bounded by the bins they take.
    """
    shards = max(1, round(stored.count() / SHARD_PIECES))
    sizes = stored.select(
        F.col(row).alias("row"), F.col(length).cast("int").alias("length"),
        F.pmod(F.xxhash64(F.col(row)), F.lit(shards)).alias("shard"),
    )
    scratch = Scratch(stored.sparkSession, "packing")
    # The whole table reaches its least number of sequences if no more room than this is lost in each shard.
    spare = (capacity - 1) // shards
    parts, level = [], 0
    while True:
        placed = _evolved(sizes, capacity, spare, scratch)
        last = shards == 1
        if not last:
            placed = scratch.keep(placed, "placed")
        done = placed if last else placed.filter("not open")
        sequence = F.shiftleft(F.col("shard"), 24).bitwiseOR(F.col("bin")).bitwiseOR(F.lit(level << 56).cast("bigint"))
        parts.append(done.select("row", sequence.alias("sequence_id"), "offset"))
        if last:
            break
        sizes = placed.filter("open").select("row", "length", F.floor(F.col("shard") / F.lit(MERGED)).cast("bigint").alias("shard"))
        shards, level = -(-shards // MERGED), level + 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(
    df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Pieces of every document with their sequence and offset (columns of :func:`pieces`, then the place)."""
    scratch = Scratch(df.sparkSession, "pieces")
    stored = scratch.keep(
        pieces(df, path, id_col, text, capacity, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces"
    )
    return stored.join(pack(stored, capacity), "row").drop("row")
