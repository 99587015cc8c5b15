"""Near-duplicate vectors by a subspace pigeonhole join.

Method: unit vectors are turned by a fixed random rotation and cut into blocks
of few dimensions. Two vectors with cosine >= t lie at squared distance
<= 2 - 2 t; each block gets a share of that budget in proportion to its
dimensions, and by the pigeonhole principle a linked pair keeps within the
share in at least one block. So each block is range-joined on a grid of cells
(every vector goes to all cells that its box of half the radius touches, where
any two vectors within the radius meet), and the union of the pairs that meet
is verified exactly by cosine in double precision.

A pair may meet in several cells and blocks. It is counted in the first block
whose share it keeps, in the cell of its boxes' lowest common corner, so no
pairs are written or shuffled: a cell gives back link counts and a spanning
forest of its links. Exact copies are collapsed into one vector with a weight
first. Cells with more than ``CELL_ROWS`` vectors are counted beforehand and cut
into narrower ones, level by level; those that are too full at the last level
(groups of near copies) are dealt over tasks as pairs of parts of about that
size, so any group needs bounded memory in each task. Inside a cell, rows are
halved along one coordinate after the other, and only rows within the radius
of a cut meet across it; what meets is tested by the block's distance, and what
passes by the whole vectors.

Defined results: rows with a null label, or a vector that is null, empty,
zero or holds null, NaN or infinite components link with nothing (n_links 0,
own component, kept); vectors of unlike length never link; rows that repeat an
id count as vectors of their own and share its component; rows with a null id
link with nothing and have a null component (kept); an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import Scratch
from tillroll.llm.components import components
from tillroll.llm.topk import usable

COSINE = 0.98
# Dimensions of a block; cell widths in radii, from level to level (each is the one before divided by STEP).
BLOCK = 8
STEP = 2
WIDTHS = (6.0, 3.0, 1.5)
# Vectors of a cell worked on at once; pairs verified at once; rows below which all pairs of a piece are tested.
CELL_ROWS = 2048
PAIRS = 1 << 16
LEAF = 12
SEED = 20240607
# Slack that keeps rounding from losing a pair before the exact check; digits kept of turned coordinates.
SLACK = 1e-9
DIGITS = 11


class Grid:
    """Blocks, radii and cells of unit vectors of one length."""

    def __init__(self, dim: int, cosine: float):
        self.turn, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
        self.blocks = [slice(at, min(at + BLOCK, dim)) for at in range(0, dim, BLOCK)]
        budget = (2 - 2 * cosine) * (1 + SLACK) + SLACK
        self.shares = np.array([budget * (b.stop - b.start) / dim for b in self.blocks])
        self.radii = np.sqrt(self.shares) * (1 + SLACK)

    def turned(self, unit: np.ndarray) -> np.ndarray:
        """Rotated vectors, rounded so that they are the same in whichever batch they are computed."""
        return np.round(unit @ self.turn, DIGITS)

    def _corner(self, turned: np.ndarray, block: int, side: float, level: int) -> np.ndarray:
        r = self.radii[block]
        return np.floor((turned[:, self.blocks[block]] + side * r / 2) / (WIDTHS[level] * r)).astype(np.int16)

    def low(self, turned: np.ndarray, block: int, level: int = 0) -> np.ndarray:
        return self._corner(turned, block, -1.0, level)

    def cells(self, turned: np.ndarray, block: int, level: int = 0, outer: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and cells (rows of coordinates): every cell that a row's box touches.

        ``outer``: the cells of the level before that the rows lie in; only cells inside them count.
        """
        low = self.low(turned, block, level)
        wide = self._corner(turned, block, 1.0, level) > low
        rows, cells = [], []
        for mask in range(1 << low.shape[1]):
            up = np.array([mask >> d & 1 for d in range(low.shape[1])], np.int16)
            fits = (wide | (up == 0)).all(axis=1)
            if outer is not None:
                fits &= ((low + up) // STEP == outer).all(axis=1)
            fits = np.flatnonzero(fits)
            rows.append(fits)
            cells.append(low[fits] + up)
        return np.concatenate(rows), np.concatenate(cells)


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, so that the squares neither overflow nor vanish.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (i, j) among n nodes."""
    label = np.arange(n)
    froms, tos = [label[:0]], [label[:0]]
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return np.concatenate(froms), np.concatenate(tos)
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        best = np.full(n, n)
        np.minimum.at(best, np.maximum(a, b), np.minimum(a, b))
        roots = np.flatnonzero(best < n)
        froms.append(roots)
        tos.append(best[roots])
        parent = np.arange(n)
        parent[roots] = best[roots]
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        label = parent[label]


def run_pairs(ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i < j) of rows of one run, some at a time; ``ends[i]`` is where row i's run ends."""
    at = np.arange(len(ends))
    todo = ends - at - 1
    done = np.concatenate([[0], np.cumsum(todo)])
    row = 0
    while row < len(ends):
        stop = max(row + 1, int(np.searchsorted(done, done[row] + PAIRS, "right")) - 1)
        i = np.repeat(at[row:stop], todo[row:stop])
        j = i + 1 + np.arange(len(i)) - np.repeat(done[row:stop] - done[row], todo[row:stop])
        if len(i):
            yield i, j
        row = stop


def _halves(x: np.ndarray, rows: np.ndarray, other: np.ndarray, radius: float) -> tuple[int, float] | None:
    """The coordinate along which the rows lie widest apart and where to halve it; None if no half would lose anything."""
    both = x[rows] if other is rows else np.concatenate([x[rows], x[other]])
    span = both.max(axis=0) - both.min(axis=0)
    d = int(span.argmax())
    return (d, float(np.median(both[:, d]))) if span[d] > 2 * radius else None


def _across(x: np.ndarray, a: np.ndarray, b: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a row of ``a`` and a row of ``b`` that may lie within ``radius``; each once."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if not len(a) or not len(b):
            continue
        cut = None if len(a) * len(b) <= LEAF * LEAF else _halves(x, a, b, radius)
        if cut is None:
            yield np.repeat(a, len(b)), np.tile(b, len(a))
            continue
        d, at = cut
        xa, xb = x[a, d], x[b, d]
        la, lb = xa <= at, xb <= at
        parts = [(a[la], b[lb]), (a[~la], b[~lb])]
        parts.append((a[la & (xa >= at - radius)], b[~lb & (xb <= at + radius)]))
        parts.append((a[~la & (xa <= at + radius)], b[lb & (xb >= at - radius)]))
        if max(len(p) * len(q) for p, q in parts) > 0.9 * len(a) * len(b):  # equal values: halving does not help
            yield np.repeat(a, len(b)), np.tile(b, len(a))
            continue
        todo += parts


def close_pairs(x: np.ndarray, rows: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ``rows`` whose coordinates ``x`` may lie within ``radius``: halved, and halved again, each pair once.

    Only the bands of ``radius`` beside a cut meet across it.
    """
    todo = [rows]
    while todo:
        a = todo.pop()
        cut = None if len(a) <= LEAF else _halves(x, a, a, radius)
        if cut is not None:
            d, at = cut
            left = x[a, d] <= at
            l, r = a[left], a[~left]
            if 0 < len(l) < len(a):
                todo += [l, r]
                yield from _across(x, l[x[l, d] >= at - radius], r[x[r, d] <= at + radius], radius)
                continue
        for i, j in run_pairs(np.full(len(a), len(a))):
            yield a[i], a[j]


def candidates(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of one run to be tested, in lots; ``radius`` is that of each run's block."""
    small = np.flatnonzero(sizes <= LEAF)
    ends = np.repeat(starts[small] + sizes[small], sizes[small])
    rows = ends - np.repeat(np.cumsum(sizes[small]), sizes[small]) + np.arange(len(ends))
    if len(rows):
        in_lot = np.searchsorted(rows, ends)
        for i, j in run_pairs(in_lot):
            yield rows[i], rows[j]
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for run in np.flatnonzero(sizes > LEAF).tolist():
        for pair in close_pairs(x, np.arange(starts[run], starts[run] + sizes[run]), float(radius[run])):
            held.append(pair)
            if sum(len(i) for i, _ in held) > PAIRS:
                yield tuple(np.concatenate(c) for c in zip(*held))
                held = []
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


_KEY = ["label", "dim", "block", "level", "cell"]
_RUN = [*_KEY, "lo", "hi"]


def _joined(frame: pd.DataFrame, cosine: float) -> pd.DataFrame | None:
    """Link counts (b null) and forest links of whole runs of cells, sorted by ``_RUN``."""
    ids, weights = frame["id"].to_numpy(), frame["weight"].to_numpy()
    counts, pairs = np.zeros(len(frame), np.int64), []
    new = np.zeros(len(frame), bool)
    for c in _RUN:
        v = frame[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(np.concatenate([[True], new[1:]]))
    sizes = np.diff(np.append(starts, len(frame)))
    dims = frame["dim"].to_numpy()
    for dim in np.unique(dims[starts[sizes > 1]]):
        runs = np.flatnonzero((sizes > 1) & (dims[starts] == dim))
        chosen = np.repeat(starts[runs], sizes[runs]) + np.arange(sizes[runs].sum()) - np.repeat(np.cumsum(sizes[runs]) - sizes[runs], sizes[runs])
        grid = Grid(int(dim), cosine)
        part = frame.iloc[chosen]
        unit = _unit(np.frombuffer(b"".join(part["v"]), f"<f{len(part['v'].iloc[0]) // dim}").reshape(-1, dim).astype(np.float64))
        turned = grid.turned(unit)
        block, level, cell = (part[c].to_numpy() for c in ("block", "level", "cell"))
        # A run's rows are compared in its block; blocks of fewer dimensions are filled up with zeros.
        own_block = np.zeros((len(part), BLOCK))
        for b, where in enumerate(grid.blocks):
            here = block == b
            own_block[here, : where.stop - where.start] = turned[here][:, where]
        own, across = part["own"].to_numpy(), (part["lo"] != part["hi"]).to_numpy()
        share = grid.shares[block]
        first = np.cumsum(sizes[runs]) - sizes[runs]
        for i, j in candidates(own_block, first, sizes[runs], grid.radii[block[first]]):
            # The block's distance first: few pairs are left for the whole vectors.
            gap = own_block[i] - own_block[j]
            near = (gap * gap).sum(axis=1) <= share[i]
            near &= ~across[i] | (own[i] != own[j])
            i, j = i[near], j[near]
            if not len(i):
                continue
            near = (unit[i] * unit[j]).sum(axis=1) >= cosine
            i, j = i[near], j[near]
            if not len(i):
                continue
            gap = (turned[i] - turned[j]) ** 2
            within = np.stack([gap[:, b].sum(axis=1) <= s for b, s in zip(grid.blocks, grid.shares)], axis=1)
            ok = within.argmax(axis=1) == block[i]
            for b, deep in set(zip(block[i][ok].tolist(), level[i][ok].tolist())):
                here = np.flatnonzero(ok & (block[i] == b) & (level[i] == deep))
                corners = [np.maximum(grid.low(turned[i[here]], b, at), grid.low(turned[j[here]], b, at)) for at in range(deep + 1)]
                path = np.frombuffer(b"".join(cell[i[here]]), np.int16).reshape(len(here), -1)
                ok[here] &= (np.concatenate(corners, axis=1) == path).all(axis=1)
            i, j = chosen[i[ok]], chosen[j[ok]]
            np.add.at(counts, i, weights[j])
            np.add.at(counts, j, weights[i])
            pairs.append((i, j))
    if not pairs:
        return None
    i, j = (np.concatenate(x) for x in zip(*pairs))
    nodes, number = np.unique(ids, return_inverse=True)
    f, t = forest(number[i], number[j], len(nodes))
    total = np.zeros(len(nodes), np.int64)
    np.add.at(total, number, counts)
    some = np.flatnonzero(total)
    return pd.DataFrame({
        "a": np.concatenate([nodes[some], nodes[f]]),
        "b": pd.array([None] * len(some) + nodes[t].tolist(), dtype="Int64"),
        "n": np.concatenate([total[some], np.zeros(len(f), np.int64)]),
    })


def _deal(cosine: float, single: bool, level: int, with_vectors: bool):
    """Vectors into the cells of a level: at level 0 of every block, later of the cell (``block``, ``cell``) they lie in."""

    def pieces(batch: pd.DataFrame) -> Iterator[tuple[Grid, int, pd.DataFrame, np.ndarray]]:
        for dim, part in batch.groupby(batch["v"].map(len) if level == 0 else batch["dim"]):
            grid = Grid(int(dim), cosine)
            if level == 0:
                given = np.stack(part["v"].to_numpy())
                part = part.assign(dim=int(dim), v=[v.astype("<f4" if single else "<f8").tobytes() for v in given])
            else:
                given = np.frombuffer(b"".join(part["v"]), "<f4" if single else "<f8").reshape(-1, int(dim))
            yield grid, int(dim), part, grid.turned(_unit(given.astype(np.float64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                for grid, dim, part, turned in pieces(whole.iloc[at : at + 512]):
                    for block in range(len(grid.blocks)):
                        if level == 0:
                            lot, own, outer, path = part, turned, None, None
                        else:
                            inside = (part["block"] == block).to_numpy()
                            lot, own = part[inside], turned[inside]
                            if not len(lot):
                                continue
                            path = lot["cell"].to_numpy()
                            width = grid.blocks[block].stop - grid.blocks[block].start
                            outer = np.frombuffer(b"".join(path), np.int16).reshape(len(lot), -1)[:, -width:]
                        rows, cells = grid.cells(own, block, level, outer)
                        names = [c.tobytes() for c in cells]
                        if path is not None:
                            names = [path[r] + c for r, c in zip(rows.tolist(), names)]
                        out = {"label": lot["label"].to_numpy()[rows], "dim": dim, "block": block, "level": level, "cell": names}
                        if with_vectors:
                            out |= {c: lot[c].to_numpy()[rows] for c in ("id", "weight", "v")}
                        yield pd.DataFrame(out)

    return run


def links(reps: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(a, b, n) of (id, weight, label, v) rows of usable vectors with unique ids.

    Rows without ``b`` add the weight ``n`` of ``a``'s links; rows with ``b``
    are the links of a spanning forest.
    """
    single = dict(reps.dtypes)["v"] == "array<float>"
    key = "label bigint, dim int, block int, level int, cell binary"
    full = f"{key}, id bigint, weight bigint, v binary"
    scratch = Scratch(reps.sparkSession, "cells")
    now, small = reps, []
    for level in range(len(WIDTHS)):
        counted = now.mapInPandas(_deal(cosine, single, level, False), key).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("rows"))
        large = scratch.keep(counted.filter(F.col("rows") > CELL_ROWS), "large")
        dealt = now.mapInPandas(_deal(cosine, single, level, True), full).join(large, _KEY, "left")
        if level == len(WIDTHS) - 1 or large.isEmpty():
            small.append(dealt)
            break
        # Cells with too many vectors are cut into narrower ones; the others are done.
        dealt = scratch.keep(dealt, "dealt")
        small.append(dealt.filter("rows is null"))
        now = dealt.filter("rows is not null").drop("rows", "level")
    every = small[0]
    for part in small[1:]:
        every = every.unionByName(part)
    parts = F.coalesce(F.ceil(F.col("rows") / CELL_ROWS), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    # A part meets every part of its cell, its own included, in a run of rows of its own.
    met = every.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    runs = met.select(
        *_KEY, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "weight", "v"
    )
    ordered = runs.repartition(*_RUN).sortWithinPartitions(*_RUN)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = frame[_RUN].iloc[-1]
            same = np.ones(len(frame), bool)
            for c in _RUN:
                same &= frame[c].to_numpy() == last[c]
            whole, held = frame[~same], frame[same]
            if len(whole) and (got := _joined(whole.reset_index(drop=True), cosine)) is not None:
                yield got
        if held is not None and (got := _joined(held.reset_index(drop=True), cosine)) is not None:
            yield got

    return ordered.mapInPandas(join, "a bigint, b bigint, n bigint")


def near_duplicates(
    df: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``df``."""
    scratch = Scratch(df.sparkSession, "near")
    rows = df.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).alias("v")
    )
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0)
    fine = F.coalesce(fine, F.lit(False))
    # Exact copies become one vector with a weight; the partial count collapses a large group before it is shuffled.
    reps = scratch.keep(
        rows.filter(fine).groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")), "reps"
    )
    # Vectors that repeat an id would merge under it, so they are numbered by a key of their own.
    keyed = scratch.keep(reps.withColumn("key", F.monotonically_increasing_id()), "keyed")
    found = scratch.keep(links(keyed.select(F.col("key").alias("id"), "weight", "label", "v"), cosine), "links")
    counts = found.filter("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("others"))
    # Links between ids: those found, and an id that stands for several vectors joins them by itself.
    ids = keyed.select("key", "id")
    named = (
        found.filter("b is not null").join(ids.select(F.col("key").alias("a"), F.col("id").alias("ia")), "a")
        .join(ids.select(F.col("key").alias("b"), F.col("id").alias("ib")), "b")
    )
    members = rows.filter(fine).select("id", "label", "v").join(keyed.withColumnRenamed("id", "rep"), ["label", "v"])
    placed = scratch.keep(members.select("id", "rep", "key", "weight"), "members")
    between = named.select(F.col("ia").alias("a"), F.col("ib").alias("b")).unionByName(
        placed.select(F.col("id").alias("a"), F.col("rep").alias("b"))
    )
    joined = components(between)
    out = (
        placed.join(counts, "key", "left")
        .select("id", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        .join(joined, "id", "left")
        .select(F.col("id").alias("vec_id"), "n_links", F.coalesce("component_id", "id").alias("component_id"))
    )
    alone = rows.filter(~fine).select(F.col("id").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(None).cast("bigint").alias("component_id"))
    # A row that can't link still shares the component of its id, if that id is linked elsewhere.
    alone = (
        alone.join(joined.withColumnsRenamed({"id": "vec_id", "component_id": "c"}), "vec_id", "left")
        .select("vec_id", "n_links", F.coalesce("c", "vec_id").alias("component_id"))
    )
    both = out.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
