"""N-gram Jaccard join: near-duplicate texts by prefix filters under several token orders.

A text's tokens are its distinct word windows. Two texts with Jaccard
similarity >= t share a token within the first n - ceil(t n) + 1 of each, in
whatever global order the tokens are sorted, so a pair must pass this filter
under several orders. The first order puts tokens of frequent buckets last (a
count sketch of fixed size over all texts says which) and generates candidates;
under it, length and place filters apply as well. A candidate pair's overlap is
then bounded by the counts of its tokens in hash buckets (a byte a token is
moved, not the set), it must share prefix tokens under the other orders (by
hash) too, and what passes all filters is verified exactly on the whole sets.

Only components are asked for, so no group is expanded into all its pairs:

1. equal sets become one class (a fingerprint grouping), and a task emits a
   set's prefix once; tokens shared by exactly the same texts are one group;
2. in each group the texts outside the first component are compared with some
   of its members, at first with the smallest text (``ROUNDS`` times);
3. what remains, pairs of different components that share a prefix token and
   were not compared yet, is compared in full; groups are cut in parts of
   ``GROUP_ROWS``, so a task holds two parts whatever the group's size.

Of the candidate pairs between two components one is verified first; the
others wait, and are verified only if the components are still apart at the
end. Each step is exact, and step 3 leaves no pair out. Sets are compared by 64-bit
hashes of their windows.

Defined results: null, empty and blank texts have no tokens (n_shingles 0, own
component); texts with fewer words than a window have one token, the whole
sequence; rows that repeat an id share its component and are linked by any of
their texts; rows with a null id link with nothing and have a null component;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import Scratch, slices, split_by_ids
from tillroll.llm.components import components
from tillroll.llm.shingles import mix, shingle_set
from tillroll.llm.vectors import run_pairs

WORDS, PERCENT = 5, 75
# The frequency sketch: buckets, and the slices in which it is added up.
SKETCH_BITS, SLICES = 20, 16
# Rounds of step 2, and members that a text is compared with; rows of a part of a group in step 3.
ROUNDS, PIVOTS, GROUP_ROWS = 2, 4, 4096
# Rows up to which a group is known by its texts (a larger one is known by its token).
KNOWN_ROWS = 1 << 16
# Seeds of the further token orders.
ORDERS = (0xA5A5A5A5, 0x3C3C3C3C)
# Bound of a task's memos.
MEMO = 1 << 18


def prefix_size(n: int, percent: int) -> int:
    """Tokens of a set of ``n`` among which one is shared by every similar set."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def ordered(tokens: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """A sorted set in the first order: rarer buckets first, then by hash."""
    return tokens[np.argsort(ranks[_bucket(tokens)], kind="stable")]


def _described(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """A fingerprint row for each text; at the end the task's slices of the frequency sketch."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint64)
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens = shingle_set(text, words)
            np.add.at(counts, _bucket(tokens), np.uint64(1))
            digest = np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64).tolist()
            rows.append({"doc": doc, "n": len(tokens), "f1": digest[0], "f2": digest[1]})
        yield pa.RecordBatch.from_pylist(rows, schema=_DESCRIBED)
    low = np.minimum(counts, 65535).astype("<u2").reshape(SLICES, -1)
    rows = [{"slice": i, "counts": part.tobytes()} for i, part in enumerate(low) if part.any()]
    yield pa.RecordBatch.from_pylist(rows, schema=_DESCRIBED)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            add = np.frombuffer(part, "<u2").astype(np.uint64)
            sums[i] = sums[i] + add if i in sums else add
    rows = [{"slice": i, "ranks": np.floor(np.log2(s + 1.0)).astype(np.uint8).tobytes()} for i, s in sums.items()]
    yield pa.RecordBatch.from_pylist(rows, schema=_RANKED)


_DESCRIBED = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())])
_RANKED = pa.schema([("slice", pa.int32()), ("ranks", pa.binary())])
_TOKENS = pa.schema([("token", pa.int64()), ("doc", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
_GROUPS = pa.schema([("grp", pa.int64()), *list(_TOKENS)[1:]])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _prefixes(batches: Iterator[pa.RecordBatch], words: int, percent: int, ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(token, doc, n, pos) of every text's prefix in the first order, once for equal sets of a task."""
    seen: set[bytes] = set()
    for batch in batches:
        held, size = [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens = shingle_set(text, words)
            key = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
            if not len(tokens) or key in seen:
                continue
            if len(seen) >= MEMO:
                seen.clear()
            seen.add(key)
            first = ordered(tokens, ranks)[: prefix_size(len(tokens), percent)]
            held.append((first.view(np.int64), doc, len(tokens)))
            size += len(first)
            if size >= 1 << 16:
                yield _token_rows(held)
                held, size = [], 0
        if held:
            yield _token_rows(held)


def _token_rows(held: list) -> pa.RecordBatch:
    sizes = [len(t) for t, _, _ in held]
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([t for t, _, _ in held])),
        pa.array(np.repeat(np.array([d for _, d, _ in held], np.int64), sizes)),
        pa.array(np.repeat(np.array([n for _, _, n in held], np.int32), sizes)),
        pa.array(np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])),
    ], schema=_TOKENS)


def _may_link(n1, p1, n2, p2, percent: int):
    """Length and place filter of two texts that share a token at places p1 and p2."""
    n1, p1, n2, p2 = (x.astype(np.int64) for x in (n1, p1, n2, p2))  # percents of sizes can pass 2**31
    shared = 1 + np.minimum(n1 - 1 - p1, n2 - 1 - p2)
    # Jaccard >= t needs an overlap of t / (1 + t) of both sizes together.
    return (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & ((100 + percent) * shared >= percent * (n1 + n2))


def _numpy(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {f.name: batch.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(batch.schema)}


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[dict[str, np.ndarray]]:
    """Whole runs of rows that are sorted by ``keys``, some at a time; runs over ``most`` rows may come in pieces."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _numpy(batch)
        if held is not None:
            rows = {k: np.concatenate([held[k], v]) for k, v in rows.items()}
        last = np.ones(len(rows[keys[0]]), bool)
        for c in keys:
            last &= rows[c] == rows[c][-1]
        if most is not None and last.sum() > most:
            last[:] = False
        if not last.all():
            yield {k: v[~last] for k, v in rows.items()}
        held = {k: v[last] for k, v in rows.items()} if last.any() else None
    if held is not None:
        yield held


def _starts(rows: dict[str, np.ndarray], keys: list[str]) -> np.ndarray:
    new = np.zeros(len(rows[keys[0]]), bool)
    new[:1] = True
    for c in keys:
        new[1:] |= rows[c][1:] != rows[c][:-1]
    return np.flatnonzero(new)


def _grouped(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and doc, the groups of two texts or more that may link, under a number for their texts.

    Tokens that the same texts share get one number (two different lists of
    texts with one number would only be compared more than needed).
    """
    giants: set[int] = set()
    for rows in _runs(batches, ["token"], KNOWN_ROWS):
        # Runs over KNOWN_ROWS rows, which may come in pieces, go by their token (counted with the repeats, as the pieces are).
        starts = _starts(rows, ["token"])
        giants.update(rows["token"][starts[np.diff(np.append(starts, len(rows["token"]))) > KNOWN_ROWS]].tolist())
        again = np.zeros(len(rows["token"]), bool)
        again[1:] = (rows["token"][1:] == rows["token"][:-1]) & (rows["doc"][1:] == rows["doc"][:-1]) & (rows["n"][1:] == rows["n"][:-1])
        rows = {k: v[~again] for k, v in rows.items()}
        starts = _starts(rows, ["token"])
        sizes = np.diff(np.append(starts, len(rows["token"])))
        keep = sizes > 1
        two = np.flatnonzero(sizes == 2)
        x, y = starts[two], starts[two] + 1
        keep[two] = (rows["doc"][x] != rows["doc"][y]) & _may_link(rows["n"][x], rows["pos"][x], rows["n"][y], rows["pos"][y], percent)
        large = np.isin(rows["token"][starts], list(giants)) if giants else np.zeros(len(starts), bool)
        keep |= large
        number = mix(np.add.reduceat(mix(rows["doc"].view(np.uint64)), starts) + sizes.astype(np.uint64))
        number = np.where(large, rows["token"][starts].view(np.uint64), number).view(np.int64)
        last = rows["token"][-1]
        giants &= {int(last)}
        chosen = np.repeat(keep, sizes)
        if chosen.any():
            out = {"grp": np.repeat(number, sizes)} | rows
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name][chosen], f.type) for f in _GROUPS], schema=_GROUPS)


def _distinct_pairs(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Pairs, smaller id first, without most of a task's repeats."""
    seen: set[tuple[int, int]] = set()
    for a, b in parts:
        low, high = np.minimum(a, b), np.maximum(a, b)
        new = set(zip(low.tolist(), high.tolist())) - seen
        if len(seen) + len(new) > MEMO:
            seen.clear()
        seen |= new
        if new:
            x, y = zip(*new)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], schema=_PAIRS)


def _toward(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows sorted by grp, comp and order: texts outside a group's first component, with that one's first members."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _numpy(batch)
        if held is not None:
            rows = {k: np.concatenate([held[k], v]) for k, v in rows.items()}
        starts = _starts(rows, ["grp"])
        ends = np.append(starts[1:], len(rows["grp"]))
        run = np.repeat(np.arange(len(starts)), ends - starts)
        first = starts[run]
        out = np.flatnonzero(rows["comp"] != rows["comp"][first])
        for k in range(PIVOTS):
            pivot = first[out] + k
            ok = pivot < ends[run[out]]
            pivot, other = pivot[ok], out[ok]
            ok = (rows["comp"][pivot] == rows["comp"][first[other]]) & (rows["doc"][pivot] != rows["doc"][other])
            ok &= _may_link(rows["n"][pivot], rows["pos"][pivot], rows["n"][other], rows["pos"][other], percent)
            yield rows["doc"][pivot[ok]], rows["doc"][other[ok]]
        # The last group may go on in the next batch: its first members go along.
        lead = starts[-1] + np.arange(min(PIVOTS, ends[-1] - starts[-1]))
        held = {k: v[lead] for k, v in rows.items()}


def _remaining(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows sorted by grp, lo and hi: pairs of different components (and parts, where two meet)."""
    keys = ["grp", "lo", "hi"]
    for rows in _runs(batches, keys):
        starts = _starts(rows, keys)
        ends = np.append(starts[1:], len(rows["grp"]))
        for i, j in run_pairs(np.repeat(ends, ends - starts)):
            ok = (rows["comp"][i] != rows["comp"][j]) & ((rows["lo"][i] == rows["hi"][i]) | (rows["own"][i] != rows["own"][j]))
            i, j = i[ok], j[ok]
            ok = _may_link(rows["n"][i], rows["pos"][i], rows["n"][j], rows["pos"][j], percent)
            yield rows["doc"][i[ok]], rows["doc"][j[ok]]


def bucket_counts(tokens: np.ndarray) -> bytes:
    """Of a set of n tokens: counts in more than n / 2 hash buckets (a power of two; 255 stands for more, too)."""
    size = 1 << max(6, len(tokens).bit_length() - 1)
    counts = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def may_be_similar(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    """False only for sets (of sizes n and m) whose overlap, bounded by their bucket counts, is too small."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if a.max() == 255 or b.max() == 255:
        return True
    size = min(len(a), len(b))
    bound = int(np.minimum(a.reshape(-1, size).sum(axis=0), b.reshape(-1, size).sum(axis=0)).sum())
    return 100 * bound >= percent * (n + m - bound)


def similar(x: np.ndarray, y: np.ndarray, orders: list, percent: int) -> bool:
    """Whether two sorted sets pass the filters of all further orders, and then the exact check."""
    if not len(x) or not len(y):
        return False
    for first, second in orders:
        if not np.isin(first, second, kind="sort").any():
            return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    memo: dict[bytes, list[np.ndarray]] = {}

    def firsts(raw: bytes) -> list[np.ndarray]:
        if raw not in memo:
            if len(memo) >= 64:
                memo.clear()
            tokens = np.frombuffer(raw, np.uint64)
            p = prefix_size(len(tokens), percent)
            memo[raw] = [np.partition(mix(tokens ^ np.uint64(s)), p - 1)[:p] for s in ORDERS] if p else []
        return memo[raw]

    for batch in (part for whole in batches for part in slices(whole)):
        a, b, sa, sb = (batch.column(i).to_pylist() for i in range(4))
        ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), list(zip(firsts(x), firsts(y))), percent) for x, y in zip(sa, sb)]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])


def near_duplicates(
    df: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``df``."""
    spark = df.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = df.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    known = docs.filter("doc is not null")

    described = scratch.keep(docs.mapInArrow(lambda b: _described(b, words), _ddl(_DESCRIBED)), "described")
    sketches = described.filter("slice is not null").select("slice", "counts").repartition(SLICES, "slice")
    ranks = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint8)
    for row in sketches.mapInArrow(_added, _ddl(_RANKED)).collect():  # a sketch of fixed size: SLICES short rows
        ranks[row["slice"]] = np.frombuffer(row["ranks"], np.uint8)
    shared_ranks = spark.sparkContext.broadcast(ranks.ravel())

    tokens = known.mapInArrow(lambda b: _prefixes(b, words, percent, shared_ranks.value), _ddl(_TOKENS))
    sorted_tokens = tokens.repartition("token").sortWithinPartitions("token", "doc")
    grouped = sorted_tokens.mapInArrow(lambda b: _grouped(b, percent), _ddl(_GROUPS))
    # Of the tokens that the same texts share, the first place of each text: no pair is filtered that one of them lets pass.
    groups = scratch.keep(grouped.groupBy("grp", "doc", "n").agg(F.min("pos").alias("pos")), "groups")
    scratch.release()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for whole in batches for part in slices(whole)):
            found = [shingle_set(t, words) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([len(t) for t in found], pa.int32()), pa.array([bucket_counts(t) for t in found], pa.binary()),
            ], names=["doc", "n", "counts"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for whole in batches for part in slices(whole)):
            found = [shingle_set(t, words).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["doc", "set"])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            ok = pa.array([may_be_similar(x, y, n, m, percent) for _, _, n, x, m, y in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ok], names=["a", "b", "ok"])

    def joined(pairs: DataFrame, work, fields: str, *columns: str) -> tuple[DataFrame, DataFrame]:
        """``pairs`` with what ``work`` makes of either text, and the table it was written to."""
        chosen, _ = split_by_ids(known, "doc", pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))))
        stored = scratch.keep(chosen.select("doc", "text").mapInArrow(work, f"doc bigint, {fields}"), "texts")
        for side in ("a", "b"):
            own, _ = split_by_ids(stored, "doc", pairs.select(side))
            pairs = pairs.join(own.withColumnsRenamed({"doc": side} | {c: c + side for c in columns}), side)
        return pairs.select("a", "b", *[c + side for side in ("a", "b") for c in columns]), stored

    def likely(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs, those whose overlap may be large enough."""
        both, stored = joined(pairs, counted, "n int, counts binary", "n", "counts")
        kept = both.mapInArrow(bounded, "a bigint, b bigint, ok boolean").filter("ok").select("a", "b").distinct()
        kept = scratch.keep(kept, "likely")
        scratch.drop(stored)
        return kept

    def verify(pairs: DataFrame) -> DataFrame:
        """The linked ones of distinct pairs."""
        both, stored = joined(pairs, sets, "set binary", "set")
        checked = both.mapInArrow(lambda b: _verified(b, percent), "a bigint, b bigint, linked boolean")
        linked = scratch.keep(checked.filter("linked").select("a", "b"), "linked")
        scratch.drop(stored)
        scratch.release()
        return linked

    def settle(waiting: DataFrame, comp: DataFrame | None, each: bool) -> tuple[DataFrame, DataFrame]:
        """Links among pairs of different components, and the pairs left over.

        With ``each``, of two components' pairs only one is verified: if it is
        a link, the others are not needed.
        """
        between = waiting.withColumns({"ca": F.col("a"), "cb": F.col("b")})
        if comp is not None:
            for side in ("a", "b"):
                own = comp.select(F.col("id").alias(side), F.col("component_id").alias("_c"))
                between = between.join(own, side, "left").withColumn("c" + side, F.coalesce("_c", side)).drop("_c")
        between = scratch.keep(between.filter("ca <> cb").select("a", "b", "ca", "cb"), "between")
        chosen = between.select("a", "b")
        if each:
            ends = (F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y"))
            chosen = scratch.keep(between.groupBy(*ends).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b"), "chosen")
        left = scratch.keep(between.select("a", "b").join(chosen, ["a", "b"], "left_anti"), "left")
        return verify(chosen), left

    def with_comp(comp: DataFrame | None) -> DataFrame:
        if comp is None:
            return groups.withColumn("comp", F.col("doc"))
        own = comp.select(F.col("id").alias("doc"), "component_id")
        return groups.join(own, "doc", "left").withColumn("comp", F.coalesce("component_id", "doc")).drop("component_id")

    # Step 2: texts outside the first component of a group with some of its members.
    links = compared = waiting = comp = None
    for _ in range(ROUNDS):
        placed = with_comp(comp).withColumn("order", F.xxhash64("doc"))
        toward = placed.repartition("grp").sortWithinPartitions("grp", "comp", "order", "doc")
        pairs = toward.mapInArrow(lambda b: _distinct_pairs(_toward(b, percent)), _ddl(_PAIRS)).distinct()
        pairs = scratch.keep(pairs.join(compared, ["a", "b"], "left_anti") if compared else pairs, "pairs")
        fresh = likely(pairs)
        found, waiting = settle(waiting.unionByName(fresh) if waiting else fresh, comp, each=True)
        links = links.unionByName(found) if links else found
        compared = compared.unionByName(pairs) if compared else pairs
        comp = scratch.keep(components(links), "comp")

    # Step 3: all pairs of different components that share a prefix token and were not compared.
    placed = scratch.keep(with_comp(comp), "placed")
    mixed = placed.groupBy("grp").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("rows"))
    mixed = mixed.filter("least <> most").select("grp", F.ceil(F.col("rows") / GROUP_ROWS).cast("int").alias("parts"))
    split = placed.join(mixed, "grp").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    runs = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "grp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "doc", "n", "pos", "comp"
    )
    keys = ["grp", "lo", "hi"]
    left = runs.repartition(*keys).sortWithinPartitions(*keys)
    rest = left.mapInArrow(lambda b: _distinct_pairs(_remaining(b, percent)), _ddl(_PAIRS)).distinct()
    waiting = waiting.unionByName(likely(scratch.keep(rest.join(compared, ["a", "b"], "left_anti"), "rest")))
    found, waiting = settle(waiting, comp, each=True)
    links = links.unionByName(found)
    found, _ = settle(waiting, scratch.keep(components(links), "comp"), each=False)
    links = links.unionByName(found)

    # Equal sets are linked by their class's smallest id.
    classes = described.filter("slice is null and doc is not null and n > 0")
    least = classes.groupBy("f1", "f2").agg(F.min("doc").alias("rep"))
    equal = classes.join(least, ["f1", "f2"]).select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    comp = components(links.unionByName(equal)).withColumnRenamed("id", "doc")
    rows = described.filter("slice is null").select("doc", "n")
    return rows.join(comp, "doc", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id")
    )
