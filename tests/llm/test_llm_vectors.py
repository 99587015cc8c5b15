"""Near-duplicate vectors and top-k search against brute force."""

import re

import numpy as np
import pytest

from tillroll.llm import topk, vectors
from tillroll.llm.components import components

NAN, INF = float("nan"), float("inf")


def brute_components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def vector_rows(dim=16, seed=0):
    """(id, vector, label): groups of near copies, exact copies, odd values, ties."""
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1):
        for _ in range(5):
            center = rng.normal(size=dim)
            for _ in range(12):
                rows.append((center + rng.normal(size=dim) * 0.11 * np.linalg.norm(center) / np.sqrt(dim)).tolist())
        rows += [rng.normal(size=dim).tolist() for _ in range(30)]
        rows += [rows[-1]] * 6
        rows += [[0.0] * dim, None, [NAN] + [1.0] * (dim - 1), [INF] + [0.0] * (dim - 1), [None] + [1.0] * (dim - 1), []]
        rows += [rng.normal(size=dim - 3).tolist()] * 2
    half = len(rows) // 2
    out = [(3 * i, v, 0 if i < half else 1) for i, v in enumerate(rows)]
    out.append((10_000, rows[0], None))
    out.append((10_001, (np.array(rows[0]) * 1e-3).tolist(), 0))
    return out


def fine(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v or [])


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rows = vector_rows()
    # The parts of a large cell: the bound is read when the plan is built.
    monkeypatch.setattr(vectors, "CELL_ROWS", 8)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, key string, weight int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df.repartition(3)).collect()}
    links, degree = [], [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i], rows[j]
            if a[2] is not None and a[2] == b[2] and fine(a[1]) and fine(b[1]) and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links.append((i, j))
                    degree[i] += 1
                    degree[j] += 1
    assert len(links) > 100
    root = brute_components(len(rows), links)
    want = {rows[i][0]: (degree[i], rows[root[i]][0], root[i] == i) for i in range(len(rows))}
    assert got == want
    assert vectors.near_duplicates(df.limit(0)).collect() == []


def test_grid_meets_every_pair_within_its_share():
    rng = np.random.default_rng(2)
    grid = vectors.Grid(12, 0.98)
    x = vectors._unit(rng.normal(size=(300, 12)))
    y = vectors._unit(x + rng.normal(size=x.shape) * 0.03)
    tx, ty = grid.turned(x), grid.turned(y)
    for block, part in enumerate(grid.blocks):
        near = ((tx[:, part] - ty[:, part]) ** 2).sum(axis=1) <= grid.shares[block]
        cells = [{}, {}]
        for own, t in zip(cells, (tx, ty)):
            for row, cell in zip(*grid.cells(t, block)):
                own.setdefault(int(row), set()).add(cell.tobytes())
        corner = np.maximum(grid.low(tx, block), grid.low(ty, block))
        for i in np.flatnonzero(near):
            assert corner[i].tobytes() in cells[0][i] & cells[1][i]


def test_narrower_cells_meet_every_pair_inside_their_cell():
    """Level by level: a pair's lowest common corner lies in the path of cells that both rows are dealt into."""
    rng = np.random.default_rng(4)
    grid = vectors.Grid(8, 0.98)
    x = vectors._unit(rng.normal(size=(200, 8)))
    y = vectors._unit(x + rng.normal(size=x.shape) * 0.05)
    tx, ty = grid.turned(x), grid.turned(y)
    near = np.flatnonzero(((tx - ty) ** 2).sum(axis=1) <= grid.shares[0])
    assert len(near) > 50
    tx, ty = tx[near], ty[near]
    outer = None
    for level in range(len(vectors.WIDTHS)):
        corner = np.maximum(grid.low(tx, 0, level), grid.low(ty, 0, level))
        for t in (tx, ty):
            rows, cells = grid.cells(t, 0, level, outer)
            dealt = set(zip(rows.tolist(), map(bytes, cells)))
            assert {(i, bytes(c)) for i, c in enumerate(corner)} <= dealt
        outer = corner


@pytest.mark.parametrize("dim,n,spread", [(8, 700, 1.0), (3, 400, 1.0), (8, 300, 0.0), (5, 500, 0.02)])
def test_close_pairs_are_all_found_once(dim, n, spread):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(n, dim)) * spread
    x[n // 2 :] = x[: n - n // 2] + rng.normal(size=(n - n // 2, dim)) * 0.02 * spread
    rows = rng.permutation(n)[: n - 3]
    found = [tuple(sorted(p)) for i, j in vectors.close_pairs(x, rows, 0.1) for p in zip(i.tolist(), j.tolist())]
    assert len(found) == len(set(found)) and all(a != b for a, b in found)
    near = {(a, b) for a in rows.tolist() for b in rows.tolist() if a < b and ((x[a] - x[b]) ** 2).sum() <= 0.01}
    assert near <= set(found)


def test_few_pairs_of_unclustered_vectors_are_compared():
    """Dimension 64, no near copies: under 5 % of the coordinates that all pairs have are looked at, and next to no
    whole vectors; the share falls as the table grows."""
    grid, shares = vectors.Grid(64, 0.98), []
    for n in (1000, 4000):
        turned = grid.turned(vectors._unit(np.random.default_rng(9).normal(size=(n, 64))))
        tested, whole, every = 0, 0, n * (n - 1) / 2
        for block, where in enumerate(grid.blocks):
            x = turned[:, where]
            for i, j in vectors.close_pairs(x, np.arange(n), grid.radii[block]):
                tested += len(i)
                whole += int((((x[i] - x[j]) ** 2).sum(axis=1) <= grid.shares[block]).sum())
        assert tested * vectors.BLOCK < 0.05 * every * 64 and whole < 1e-3 * every
        shares.append(tested / every)
    assert shares[1] < 0.6 * shares[0]


@pytest.mark.parametrize("rows", [4, 20])
def test_levels_and_parts_equal_brute_force(spark, monkeypatch, rows):
    """So small a bound that cells are cut at every level and the fullest are dealt as parts."""
    monkeypatch.setattr(vectors, "CELL_ROWS", rows)
    data = vector_rows(dim=8, seed=6)
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    monkeypatch.setattr(vectors, "CELL_ROWS", 10**9)
    want = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    assert got == want and sum(n for n, _ in got.values()) > 100


def test_forest_spans_the_links():
    rng = np.random.default_rng(3)
    i, j = rng.integers(0, 60, 50), rng.integers(0, 60, 50)
    f, t = vectors.forest(i, j, 60)
    assert brute_components(60, zip(f.tolist(), t.tolist())) == brute_components(60, zip(i.tolist(), j.tolist()))
    assert len(f) == 60 - len(set(brute_components(60, zip(i.tolist(), j.tolist()))))


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (301, 300), (300, 301), (302, 301)]
    got = dict(components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    want = {i: 0 for i in range(41)} | {k: 100 for k in range(100, 130)} | {k: 300 for k in (300, 301, 302)}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


@pytest.mark.parametrize("large", [False, True])
def test_top_k_equals_brute_force(spark, large):
    rng = np.random.default_rng(5)
    scale = 1e5 if large else 1.0
    rows = [(i, (rng.integers(-3, 4, 8) / 2 * scale).tolist()) for i in range(90)]
    rows += [(i, rows[0][1]) for i in range(90, 110)]  # ties
    rows += [(200, None), (250, [None] * 8), (300, [NAN] * 8), (350, [INF] * 8), (400, [1.0, 2.0]), (450, [1.0, 3.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id bigint, embedding array<double>, score int, ids string").repartition(4)
    ask = df.filter("vec_id % 50 = 0 or vec_id in (1, 2)")
    got = {}
    for r in topk.top_k(ask, df, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ok = [(i, np.floor(np.array(v) * 256).astype(object)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for i, v in ok:
        if i % 50 == 0 or i in (1, 2):
            scores = sorted((-int((v * w).sum()), j) for j, w in ok if j != i and len(w) == len(v))
            if scores:
                want[i] = [(n, j, -s) for n, (s, j) in enumerate(scores[:5], 1)]
    assert {k: sorted(v) for k, v in got.items()} == want
    assert topk.top_k(ask.limit(0), df, k=5).collect() == []


def test_top_k_deals_the_vectors_of_a_query_block_to_parts(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 2)
    monkeypatch.setattr(topk, "PART_BLOCKS", 3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rng = np.random.default_rng(6)
        rows = [(i, (rng.integers(-3, 4, 8) / 2).tolist()) for i in range(120)]
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
        best = topk.top_k(df.filter("vec_id < 4"), df, k=5)
        got = sorted(tuple(r) for r in best.collect())
        plan = best._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    whole = [np.floor(np.array(v) * 256).astype(np.int64) for _, v in rows]
    want = []
    for i in range(4):
        scores = sorted((-int(whole[i] @ w), j) for j, w in enumerate(whole) if j != i)[:5]
        want += [(i, n, j, -s) for n, (s, j) in enumerate(scores, 1)]
    assert got == sorted(want)
    # The vectors' exchange is by query block and part, and no join of the vectors is by the query block alone.
    sides = re.findall(r"(?:Join|JoinSkew\w*)(?:\(\w+=\w+\))? \[([^\]]*)\], \[([^\]]*)\]", plan.split("== Initial Plan ==")[-1])
    keys = [re.sub(r"#\d+L?", "", left) for left, _ in sides]
    assert keys.count("qb, part") == 1 and keys.count("qb") == 1
