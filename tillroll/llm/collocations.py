"""Phrase collocation mining by set-oriented relations (SETM).

The occurrence relation of length k holds (piece, position, group) sorted by
piece and position; a group is a phrase of k words in one language. A round

1. counts the groups over all documents and keeps those with enough places,
2. semi-joins the occurrences with the groups kept,
3. merge-joins them with themselves on piece and adjacent position, which
   gives the occurrences of length k + 1, and persists them.

Pieces never leave their block of documents, so the merge-join runs inside
blocks of bounded size (one compressed row a block). What Spark shuffles are
pre-aggregated counts, one row for each group of a block, and once a round the
blocks themselves, to meet the groups kept. A group that a third of all pieces
hold sends one row a block. Nothing is broadcast.

Scores are exact: integer division of decimals of 38 digits (enough for counts
below 10^15). A phrase inside a longer candidate is compared with those one
word longer only: whatever holds for a still longer one holds for them too.

Defined results: a null text is empty, a null language is ``und``; words that
never reach ``least`` places count for ``n`` only; rows are counted as they come,
repeated ones too; an empty table gives no rows; ties go by the phrase's bytes;
other columns are ignored. A very long text may be cut between pieces; a piece
is never cut, so memory is bounded by a block and the longest piece.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import Scratch

# What separates pieces, and words in a piece.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
NO_LANG = "und"
# Words of a block, about; blocks of a task; groups of a block (bits of a group's number).
BLOCK_WORDS = 1 << 20
_SEQ_BITS, _LOCAL_BITS = 16, 25
# Rows handed back to Spark at once.
ROWS = 1 << 16
_FOLD = bytes(
    0x2E if b in PIECE_ENDS else b + 32 if 65 <= b <= 90 else 0x20 if b == 9 else b for b in range(256)
)  # piece ends are '.', words are split at blanks

# A block is one row that holds its occurrences (size words), and one row for each of its groups with its places n.
_WORDS = pa.schema([
    ("block", pa.int64()), ("lang", pa.string()), ("local", pa.int32()), ("w", pa.binary()), ("n", pa.int64()),
    ("size", pa.int64()), ("places", pa.binary()),
])
_WORDS_DDL = "block bigint, lang string, local int, w binary, n bigint, size bigint, places binary"
_GROUPS = pa.schema([
    ("block", pa.int64()), ("local", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("n", pa.int64()), ("places", pa.binary()),
])
_GROUPS_DDL = "block bigint, local int, x bigint, y bigint, n bigint, places binary"


def pack(piece: np.ndarray, pos: np.ndarray, item: np.ndarray) -> bytes:
    """An occurrence relation sorted by piece and position, compressed column by column."""
    steps = np.diff(piece, prepend=0)
    raw = b"".join(np.ascontiguousarray(c, "<i4").tobytes() for c in (steps, pos, item))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(places: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, position, item) of :func:`pack`."""
    raw = pa.decompress(places[8:], int.from_bytes(places[:8], "little"), codec="zstd", asbytes=True)
    steps, pos, item = np.frombuffer(raw, "<i4").reshape(3, -1)
    return np.cumsum(steps, dtype=np.int32), pos, item


def _rows(schema: pa.Schema, count: int, **columns) -> Iterator[pa.RecordBatch]:
    """``count`` rows, some at a time; columns not given are null, single values are repeated."""
    arrays = []
    for field in schema:
        values = columns.get(field.name)
        if values is None:
            arrays.append(pa.nulls(count, field.type))
        elif isinstance(values, (np.ndarray, list)):
            arrays.append(pa.array(values, field.type))
        else:
            arrays.append(pa.array([values], field.type).take(pa.array(np.zeros(count, np.int8))))
    whole = pa.RecordBatch.from_arrays(arrays, schema=schema)
    for at in range(0, count, ROWS):
        yield whole.slice(at, ROWS)


class _Block:
    """Words of one language while they are gathered."""

    def __init__(self):
        self.ids = defaultdict(itertools.count().__next__)
        self.end = self.ids[b"."]
        self.items: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        """Words with b'.' between pieces."""
        words.append(b".")
        self.items.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def rows(self, block: int, lang: str) -> Iterator[pa.RecordBatch]:
        items = np.concatenate(self.items)
        end = items == self.end
        piece = np.cumsum(end, dtype=np.int32)
        at = np.arange(len(items), dtype=np.int32)
        start = np.concatenate([[0], at[end] + 1]).astype(np.int32)
        words = ~end
        piece, item = piece[words], items[words]
        if not len(item):
            return
        counts = np.bincount(item, minlength=len(self.ids))[1:]  # the first number is the piece end's
        local = np.arange(1, len(self.ids), dtype=np.int32)
        yield from _rows(_WORDS, len(local), block=block, lang=lang, local=local, w=list(self.ids)[1:], n=counts)
        places = pack(piece, at[words] - start[piece], item)
        yield from _rows(_WORDS, 1, block=block, lang=lang, size=len(item), places=[places])


def _gather(block_words: int):
    """Documents (lang, text as bytes) to blocks: groups of one word, and their occurrences by piece and position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = itertools.count(TaskContext.get().partitionId() << _SEQ_BITS)
        open_: dict[str, _Block] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                words = text.translate(_FOLD).replace(b".", b" . ").split(b" ")
                words = [w for w in words if w]
                while words:
                    block = open_.setdefault(lang, _Block())
                    part, words = words, []
                    if len(part) > block_words:  # cut a very long text after a piece
                        try:
                            cut = part.index(b".", block_words) + 1
                            part, words = part[:cut], part[cut:]
                        except ValueError:
                            pass
                    before = block.size
                    block.add(part)
                    held += block.size - before
                    while open_ and (block.size >= block_words or held > 2 * block_words or len(open_) > 1024):
                        full = max(open_, key=lambda x: open_[x].size)
                        block = open_.pop(full)
                        held -= block.size
                        yield from block.rows(next(numbers), full)
                        if not open_:
                            break
                        block = max(open_.values(), key=lambda b: b.size)
        for lang, block in open_.items():
            yield from block.rows(next(numbers), lang)

    return run


def _extend(with_places: bool):
    """Groups kept (block, local, gid) followed by their block's places, to blocks one word longer.

    The merge-join on piece and next position: places are sorted, so the next
    position of a piece is the next row, if it is there.
    """

    def block_rows(block: int, local: np.ndarray, gid: np.ndarray, places: bytes) -> Iterator[pa.RecordBatch]:
        piece, pos, item = unpack(places)
        number = np.full(int(max(item.max(initial=0), local.max(initial=0))) + 1, -1, np.int64)
        number[local] = np.arange(len(local))
        group = number[item]
        few = group >= 0
        piece, pos, group = piece[few], pos[few], group[few]
        met = np.flatnonzero((piece[1:] == piece[:-1]) & (pos[1:] == pos[:-1] + 1))
        if not len(met):
            return
        pair, which, counts = np.unique(group[met] * len(gid) + group[met + 1], return_inverse=True, return_counts=True)
        locals_ = np.arange(len(pair), dtype=np.int32)
        yield from _rows(_GROUPS, len(pair), block=block, local=locals_, x=gid[pair // len(gid)], y=gid[pair % len(gid)], n=counts)
        if with_places:
            yield from _rows(_GROUPS, 1, block=block, places=[pack(piece[met], pos[met], which)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            block, local, gid, places = batch.columns
            start = 0
            for end in np.flatnonzero(places.is_valid().to_numpy(zero_copy_only=False)).tolist():
                held.append((local.slice(start, end - start).to_numpy(), gid.slice(start, end - start).to_numpy()))
                both = [np.concatenate(c) for c in zip(*held)]
                held, start = [], end + 1
                if len(both[0]):
                    yield from block_rows(block[end].as_py(), *both, places[end].as_py())
            if start < len(block):
                held.append((local.slice(start).to_numpy(), gid.slice(start).to_numpy()))

    return run


class _Groups:
    """Counts groups of rows (keys, here, n) that come sorted by keys and here, holding less than ``least`` rows.

    A group is known to be kept as soon as its places reach ``least``; from
    then on its rows pass by, and its total follows when it ends.
    """

    def __init__(self, schema: pa.Schema, n_keys: int, least: int):
        self.schema, self.n_keys, self.least = schema, n_keys, least
        self.held: pa.RecordBatch | None = None  # rows of the last group, not yet known to be kept
        self.key: list | None = None  # the last group, known to be kept: key, gid, places so far
        self.gid = self.places = 0

    def _rows(self, keys: list, here, gid, f) -> pa.RecordBatch:
        size = len(gid)
        given = [*(keys or [None] * self.n_keys), here, gid, f]
        return pa.RecordBatch.from_arrays(
            [pa.nulls(size, t.type) if c is None else c.cast(t.type) if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(given, self.schema)],
            schema=self.schema,
        )

    def _close(self) -> Iterator[pa.RecordBatch]:
        if self.key is not None:
            yield self._rows([pa.array([k], t.type) for k, t in zip(self.key, self.schema)], None, [self.gid], [self.places])
        self.key = None

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.held is not None:
            batch = pa.Table.from_batches([self.held, batch]).combine_chunks().to_batches()[0]
            self.held = None
        if not batch.num_rows:
            return
        keys, (here, n) = batch.columns[: self.n_keys], (batch.column(self.n_keys + i).to_numpy() for i in range(2))
        new = np.zeros(len(here), bool)
        new[0] = True
        for k in keys:
            new[1:] |= pc.not_equal(k.slice(1), k.slice(0, len(k) - 1)).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(new)
        sizes = np.diff(np.append(start, len(here)))
        places, gid = np.add.reduceat(n, start), here[start].copy()
        if self.key is not None:
            if self.key == [k[0].as_py() for k in keys]:
                places[0] += self.places
                gid[0] = self.gid
                self.key = None
            else:
                yield from self._close()
        kept = places >= self.least
        rows = np.repeat(kept, sizes)
        if rows.any():
            yield self._rows(None, here[rows], np.repeat(gid[kept], sizes[kept]), None)
        if kept[-1]:
            self.key, self.gid, self.places = [k[int(start[-1])].as_py() for k in keys], int(gid[-1]), int(places[-1])
        else:
            self.held = batch.slice(int(start[-1]))
        whole = np.flatnonzero(kept[:-1])
        if len(whole):
            at = pa.array(start[whole])
            yield self._rows([k.take(at) for k in keys], None, gid[whole], places[whole])

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self._close()


def _counted(blocks: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Groups with ``least`` places or more: a row (gid, f, keys) for each, and a row (gid, here) for each block's group.

    One shuffle by the group: its rows are one for each block, so they are the
    counts before the last sum. ``here`` numbers a block's group, ``gid`` is the
    least of them.
    """
    here = F.shiftleft(F.col("block"), _LOCAL_BITS).bitwiseOR(F.col("local").cast("bigint"))
    flat = blocks.filter("local is not null").select(*keys, here.alias("here"), "n")
    kinds = dict(flat.dtypes)
    ddl = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", here bigint, gid bigint, f bigint"
    arrow = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64()}
    schema = pa.schema([*((k, arrow[kinds[k]]) for k in keys), ("here", pa.int64()), ("gid", pa.int64()), ("f", pa.int64())])
    n_keys = len(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Groups(schema, n_keys, least)
        for batch in batches:
            yield from groups.add(batch)
        yield from groups.end()

    return flat.repartition(*keys).sortWithinPartitions(*keys, "here").mapInArrow(count, ddl)


def _longer(blocks: DataFrame, kept: DataFrame, with_places: bool) -> DataFrame:
    """Occurrences one word longer: the semi-join with the groups kept, then the merge-join, block by block."""
    none = F.lit(None)
    block, local = F.shiftright("here", _LOCAL_BITS), F.col("here").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)).cast("int")
    members = kept.filter("here is not null").select(block.alias("block"), local.alias("local"), "gid")
    groups = members.withColumn("places", none.cast("binary"))
    places = blocks.filter("places is not null").select("block", none.cast("int").alias("local"), none.cast("bigint").alias("gid"), "places")
    met = groups.unionByName(places).repartition("block").sortWithinPartitions("block", F.col("local").asc_nulls_last())
    return met.mapInArrow(_extend(with_places), _GROUPS_DDL)


def _cuts(a: Column, parts: Column, rests: Column) -> Column:
    """The lowest score over all cuts (ties: the first): struct of score, k, l, r."""
    wide = "decimal(38,0)"
    a = a.cast(wide)
    ratio = F.zip_with(
        parts, rests, lambda first, rest: F.struct(first.alias("l"), rest.alias("r"), (first.cast("decimal(19,0)") * rest.cast("decimal(19,0)")).alias("lr"))
    )
    top = F.lit(1_000_000).cast("decimal(7,0)") * (a.cast("decimal(15,0)") * a.cast("decimal(15,0)"))
    scored = F.transform(
        ratio,
        lambda c, k: F.struct(_div(top, c["lr"]).alias("score"), k.alias("k"), c["l"].alias("l"), c["r"].alias("r")),
    )
    return F.array_min(scored)


def _div(top: Column, bottom: Column) -> Column:
    """Whole quotient of two decimals without places."""
    return F.call_function("div", top, bottom)


def collocations(
    df: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, inside: int = 50, top: int | None = 2000,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to ``longest`` words of every language.

    ``least``: places a phrase needs; ``inside``: per cent of a phrase's places
    from which a longer candidate around it drops it; ``top``: rows a language (None: all).
    """
    scratch = Scratch(df.sparkSession, "collocations")
    read = df.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text).cast("string").cast("binary").alias("text"))
    blocks = scratch.keep(read.mapInArrow(_gather(block_words), _WORDS_DDL), "words")
    totals = scratch.keep(blocks.groupBy("lang").agg(F.sum("size").alias("n")), "totals")

    kept = scratch.keep(_counted(blocks, ["lang", "w"], least), "kept")
    none = F.array().cast("array<bigint>")
    # Every group once: its phrase, last word, counts of its beginnings and ends from 1 word on.
    word = F.col("w").cast("string")
    groups = scratch.keep(
        kept.filter("f is not null").select("gid", "lang", "f", word.alias("phrase"), word.alias("last"), none.alias("starts"), none.alias("ends")), "groups"
    )
    candidates: list[DataFrame] = []
    for length in range(2, longest + 1):
        more = scratch.keep(_longer(blocks, kept, length < longest), "places")
        scratch.drop(blocks)
        scratch.drop(kept)
        blocks = more
        kept = scratch.keep(_counted(blocks, ["x", "y"], least), "kept")
        left = groups.select(
            F.col("gid").alias("x"), "lang", F.col("phrase").alias("head"), F.concat("starts", F.array("f")).alias("starts")
        )
        right = groups.select(F.col("gid").alias("y"), "last", F.concat("ends", F.array("f")).alias("ends"))
        new = kept.filter("f is not null").select("gid", "f", "x", "y").join(left, "x").join(right, "y")
        longer = scratch.keep(
            new.select("gid", "lang", "f", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "starts", "ends", "x", "y"), "groups"
        )
        if length > 2:
            # The largest count of a candidate one word longer.
            around = longer.select(F.col("x").alias("gid"), "f").unionByName(longer.select(F.col("y").alias("gid"), "f"))
            around = around.groupBy("gid").agg(F.max("f").alias("around"))
            candidates[-1] = groups.join(around, "gid", "left").filter(
                F.col("around").isNull() | (F.col("around").cast("decimal(19,0)") * 100 < F.col("f").cast("decimal(19,0)") * inside)
            )
        candidates.append(longer)
        groups = longer
    every = None
    for c in candidates:
        c = c.select("lang", "phrase", F.col("f").alias("a"), _cuts(F.col("f"), F.col("starts"), F.reverse("ends")).alias("cut"))
        every = c if every is None else every.unionByName(c)
    every = every.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
